"""Streams against their batch forms."""

import json

from pyspark.sql import functions as F

from gleanline.operators import tracking
from gleanline.sources import markup
from gleanline.streaming import feeds, replies


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_stream_of_postings_drops_repeats_and_sets_bad_lines_aside(spark, tmp_path):
    row = lambda i: {"source": "s", "external_id": str(i), "title": "Dev", "company": "A", "url": "u", "posted_at": "2024-01-01T00:00:00Z"}
    lines = [json.dumps(row(i % 3)) for i in range(9)] + ["{broken", json.dumps({"source": "s"})]
    (tmp_path / "a.json").write_text("\n".join(lines))
    valid, bad = feeds.stream_postings(spark, str(tmp_path))
    kept = drain(feeds.normalised(feeds.without_repeats(valid)), "kept")
    assert sorted(r.external_id for r in kept.collect()) == ["0", "1", "2"]
    assert drain(bad, "quarantine").count() == 2


def test_old_and_undated_postings_are_not_late(spark, tmp_path):
    row = lambda i, at: json.dumps({"source": "s", "external_id": str(i), "title": "Dev", "company": "A", "url": "u", "posted_at": at})
    for k, rows in enumerate([[row(1, "2024-03-01T00:00:00Z")], [row(2, "2024-03-02T00:00:00Z"), row(1, None)], [row(3, "2023-01-01T00:00:00Z"), row(4, None), row(3, None)]]):
        (tmp_path / f"{k}.json").write_text("\n".join(rows))
    valid, _ = feeds.stream_postings(spark, str(tmp_path), max_files=1)
    kept = drain(feeds.without_repeats(valid), "late")
    assert sorted(r.external_id for r in kept.collect()) == ["1", "2", "3", "4"]


def test_stream_of_replies_equals_the_batch_fold(spark, tmp_path):
    rows = [(1, "submitted", "m1", 10, "ack"), (1, "submitted", "m2", 20, "rejection"), (1, "submitted", "m3", 30, "interview"), (2, "interview", "m4", 5, "ack"), (2, "interview", "m5", 6, "interview"), (3, "submitted", "m6", 1, "interview")]
    frame = spark.createDataFrame(rows, "application_id long, status string, message_id string, s long, classification string").withColumn("sent_at", F.timestamp_seconds("s")).drop("s")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    key = lambda df: sorted((r.application_id, r.message_id, r.from_status, r.to_status) for r in df.collect())
    applications = frame.select("application_id", "status").distinct()
    assert key(drain(replies.status_changes(stream), "changes")) == key(tracking.status_changes(applications, frame))


def test_messages(spark):
    multipart = (
        b"From: a@x\r\nSubject: =?utf-8?b?Q2lhbw==?=\r\nDate: Tue, 5 Mar 2024 10:00:00\r\nMIME-Version: 1.0\r\n"
        b'Content-Type: multipart/alternative; boundary="B"\r\n\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--B\r\nContent-Type: text/plain\r\n\r\nplain text\r\n--B--\r\n'
    )
    undated = b"From: a@x\r\nSubject: s\r\n\r\nbody"
    files = spark.createDataFrame([("1", multipart), ("2", undated)], "path string, content binary")
    rows = markup.parse_messages(files).collect()
    assert [(r.path, r.subject, r.body) for r in rows] == [("1", "Ciao", "plain text")]
