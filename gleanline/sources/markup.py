"""Stages that need a Python parser, run on Arrow batches: strict HTML and MIME messages."""

from __future__ import annotations

import email
import email.policy
import encodings
from collections.abc import Iterator
from datetime import UTC
from email.message import EmailMessage
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import collapse, html_to_text, strip


class _Reader(HTMLParser):
    """Collects text outside dropped tags, with line breaks where blocks end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in fv.DROPPED_TAGS:
            self.hidden += 1
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag == "br":
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag not in fv.DROPPED_TAGS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in fv.DROPPED_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag in fv.BREAKING_TAGS and tag != "br":
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def _tag_text(markup: str | None) -> str:
    if not markup or "<" not in markup:
        return markup or ""
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    return "".join(reader.parts)


def html_to_text_strict(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, text) through a tag walker, for markup the regular expressions cannot follow."""

    @F.pandas_udf("string")
    def tag_text(markup: pd.Series) -> pd.Series:
        return markup.map(_tag_text)

    return pages.select(id_column, collapse(tag_text(html_column)).alias("text"))


#: Header fields that are read, and the columns they become.
HEADERS = {"message-id": "message_id", "from": "sender", "subject": "subject", "in-reply-to": "answered", "references": "thread"}


def _seconds(mail: EmailMessage) -> float | None:
    """The Date field as seconds since 1970; a time without a zone is UTC."""
    sent = getattr(mail["date"], "datetime", None)
    return sent and (sent if sent.tzinfo else sent.replace(tzinfo=UTC)).timestamp()


def _content(part: EmailMessage | None) -> str | None:
    if part is None:
        return None
    declared = part.get_content_charset("utf-8")
    known = encodings.search_function(declared.replace("-", "_").lower())
    return str(part.get_payload(decode=True) or b"", known.name if known else "utf-8", "replace")


def parse_messages(files: DataFrame) -> DataFrame:
    """(path, message_id, sender, subject, sent_at, references, body) of (path, content) rows.

    The structure of a message (RFC 5322, 2045, 2047) is read by the mail package's own policy on the executors, a
    batch of files at a time; ids, threads and HTML bodies become columns in the JVM. The body is the plain part, else
    the HTML part as text. Messages without a date are dropped: nothing could tell whether they are new.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            mails = frame["content"].map(lambda raw: email.message_from_bytes(bytes(raw), policy=email.policy.default))
            out = pd.DataFrame({"path": frame["path"]})
            for field, column in HEADERS.items():
                out[column] = mails.map(lambda mail, field=field: str(mail.get(field, "")))
            out["sent"] = mails.map(_seconds).astype(float)
            for kind in ("plain", "html"):
                out[kind] = mails.map(lambda mail, kind=kind: _content(mail.get_body((kind,))))
            yield out

    columns = ["path", *HEADERS.values()]
    schema = ", ".join(f"{c} string" for c in columns) + ", sent double, plain string, html string"
    parsed = files.select("path", "content").mapInPandas(parse, schema).where("sent IS NOT NULL AND NOT isnan(sent)")
    body = F.coalesce(strip(F.col("plain")), html_to_text(F.col("html")), F.lit(""))
    return parsed.select(
        "path",
        F.trim("message_id").alias("message_id"),
        "sender",
        "subject",
        F.timestamp_seconds("sent").alias("sent_at"),
        F.regexp_extract_all(F.concat_ws(" ", "answered", "thread"), F.lit(r"(\S+)"), 1).alias("references"),
        body.alias("body"),
    )


def read_messages(spark, path: str) -> DataFrame:
    """Message files of a folder."""
    return parse_messages(spark.read.format("binaryFile").load(path))
