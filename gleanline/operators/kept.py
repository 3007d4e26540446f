"""What stays from day to day, so that a day's work grows with its postings and not with the store.

Fingerprints: every print of the store lies once under the value of each of its bands, in files by bucket of its block.
A new print asks for the values within two bits of its own; only the files of the blocks' buckets are opened.

Groups: (id, root) of every posting. A day's links are read as links between roots, contracted among the roots they
touch, and only the rows of roots that changed are written.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..session import cut_lineage, shared_folder
from . import resolve

#: Folders of the index of prints. Those of one block share a folder: a day asks for the blocks it has.
BUCKETS = 256
_BANDS, _WIDTH = 4, 16
_MASK = (1 << _WIDTH) - 1
#: Two prints within ten bits differ by two bits at most in one of four bands.
_FLIPS = [0, *(1 << i for i in range(_WIDTH)), *(1 << i | 1 << j for i, j in itertools.combinations(range(_WIDTH), 2))]


def _bucket():
    return F.pmod(F.xxhash64("block"), F.lit(BUCKETS)).cast("int")


def _slots(prints: DataFrame, flips: list[int]) -> DataFrame:
    """The rows of `prints` once for each band and flip, with band, slot and bucket."""
    bands = F.array(
        *[
            F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("simhash", b * _WIDTH).bitwiseAND(F.lit(_MASK)).cast("int").alias("own"))
            for b in range(_BANDS)
        ]
    )
    rows = prints.select(*prints.columns, F.inline(bands))
    if flips == [0]:
        return rows.withColumnRenamed("own", "slot").withColumn("bucket", _bucket())
    some = F.array(*[F.lit(f) for f in flips])
    return rows.select(*prints.columns, "band", F.explode(F.transform(some, lambda f: F.col("own").bitwiseXOR(f))).alias("slot")).withColumn("bucket", _bucket())


class PrintIndex:
    """Prints of the store by band value, in Parquet files by bucket under `path`."""

    SCHEMA = "block string, simhash long, id long, band int, slot int, bucket int"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.empty = spark, path or shared_folder(spark), path is None

    def add(self, prints: DataFrame) -> None:
        """Append block, simhash, id of new postings; earlier files stay as they are. The id of a print is its holder's."""
        rows = _slots(prints.select("block", F.col("simhash").cast("long"), F.col("id").cast("long")), [0])
        spread = rows.repartition("bucket", F.pmod(F.xxhash64("band", "slot"), F.lit(64)))  # a block with a third of the rows has 64 writers
        spread.sortWithinPartitions("bucket", "band", "slot").write.mode("append").partitionBy("bucket").parquet(self.path)
        self.empty = False

    def read(self) -> DataFrame:
        if self.empty:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(T._parse_datatype_string(self.SCHEMA)).parquet(self.path)

    def near(self, prints: DataFrame) -> DataFrame:
        """(block, simhash, near_simhash, near_id, distance) of indexed prints within ten bits of each of `prints`.

        `prints` holds distinct (block, simhash). The buckets that they ask for are collected (BUCKETS numbers at
        most) and become a partition filter, so that no other file is opened. The values asked for are many times their
        prints: they go straight into the join and are not kept.
        """
        own = cut_lineage(prints.select("block", "simhash"))
        hit = [r.bucket for r in own.select(_bucket().alias("bucket")).distinct().collect()]
        asked = _slots(resolve.spread_prints(own), _FLIPS)
        stored = self.read().where(F.col("bucket").isin(hit)).select(
            "bucket", "block", "band", "slot", F.col("simhash").alias("near_simhash"), F.col("id").alias("near_id")
        )
        distance = resolve.hamming(F.col("simhash"), F.col("near_simhash"))
        met = asked.join(stored.hint("merge"), ["bucket", "block", "band", "slot"]).where(distance <= fv.MAX_HAMMING)
        return met.select("block", "simhash", "near_simhash", "near_id", distance.cast("int").alias("distance")).distinct()



def match_kept(incoming: DataFrame, keys: DataFrame, active: DataFrame, index: PrintIndex) -> DataFrame:
    """(id, stored_id, matched_by) like `resolve.match_stored`, from what is kept instead of the store.

    Input: incoming(id, canonical_key, company_normalized, simhash, chars), keys(canonical_key, id) with the smallest
    id of each key, active(id): stored postings that are open. Neither texts nor prints of other buckets are read.
    """
    looked_up = incoming.join(keys.select("canonical_key", F.col("id").alias("key_id")).hint("merge"), "canonical_key", "left")
    eligible = F.col("key_id").isNull() & (F.col("chars") >= fv.MIN_FINGERPRINT_CHARS)
    open_rows = looked_up.where(eligible).select(F.col("company_normalized").alias("block"), "simhash").distinct()
    near = index.near(open_rows).join(active.select(F.col("id").alias("near_id")), "near_id", "left_semi")
    best = near.groupBy(F.col("block").alias("company_normalized"), "simhash").agg(
        F.min_by("near_id", F.struct("distance", "near_id")).alias("near_id")
    )
    found = looked_up.join(best, ["company_normalized", "simhash"], "left")
    near_id = F.when(eligible, F.col("near_id"))
    return found.select(
        "id",
        F.coalesce("key_id", near_id).alias("stored_id"),
        F.when(F.col("key_id").isNotNull(), "key").when(near_id.isNotNull(), "content").otherwise("new").alias("matched_by"),
    )


def extend_components(parents: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) rows to write into `parents`(id, root): new vertices, and old ones whose root changed.

    A root is the smallest id of its component. Edges are read as edges between roots; contraction runs over roots
    that an edge touches, whatever the size of `parents`.
    """
    own = parents.select("id", "root")
    fresh = vertices.select("id").distinct().join(own, "id", "left_anti").select("id", F.col("id").alias("root"))
    known = own.join(
        edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi"
    )
    ends = cut_lineage(known)
    source = edges.join(ends.select(F.col("id").alias("src"), F.col("root").alias("a")), "src", "left")
    both = source.join(ends.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst", "left")
    links = both.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()
    joined = cut_lineage(resolve.connected_components(links).where("id <> component").select(F.col("id").alias("root"), "component"))
    moved = own.join(joined, "root").select("id", F.col("component").alias("root"))
    new = fresh.join(joined, "root", "left").select("id", F.coalesce("component", "root").alias("root"))
    return moved.unionByName(new)


def replace_rows(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with the rows of `changes` in place of those with their key."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*table.columns))


@dataclass(frozen=True)
class Groups:
    """State of grouping: who belongs where, the smallest holder of each key and each print, and the prints' index."""

    parents: DataFrame
    keys: DataFrame
    prints: DataFrame
    index: PrintIndex

    @classmethod
    def start(cls, spark: SparkSession) -> Groups:
        return cls(
            spark.createDataFrame([], "id long, root long"),
            spark.createDataFrame([], "canonical_key string, id long"),
            spark.createDataFrame([], "block string, simhash long, id long"),
            PrintIndex(spark),
        )

    def add_day(self, batch: DataFrame) -> Groups:
        """The state with a day's postings: id, canonical_key, company_normalized, simhash, chars.

        Links are stars around the smallest holder that is known: equal keys, equal prints, and prints within ten bits
        (only of prints that are new). Ids of a day need not be above those of earlier days.
        """
        rows = cut_lineage(batch.select("id", "canonical_key", "company_normalized", "simhash", "chars"))
        long_texts = rows.where((F.col("chars") >= fv.MIN_FINGERPRINT_CHARS) & (F.col("company_normalized") != ""))
        by_key, keys = _stars(self.keys, rows.where(resolve.has_key()), ["canonical_key"])
        held = long_texts.select("id", F.col("company_normalized").alias("block"), "simhash")
        by_print, prints = _stars(self.prints, held, ["block", "simhash"])
        new = cut_lineage(
            held.groupBy("block", "simhash").agg(F.min("id").alias("id")).join(self.prints.select("block", "simhash"), ["block", "simhash"], "left_anti")
        )
        earlier = self.index.near(new).join(new.withColumnRenamed("id", "src"), ["block", "simhash"]).select("src", F.col("near_id").alias("dst"))
        among = resolve.near_prints(new, new, F.col("a_simhash") < F.col("b_simhash")).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
        edges = by_key.unionByName(by_print).unionByName(earlier).unionByName(among)
        changes = cut_lineage(extend_components(self.parents, rows, cut_lineage(edges.distinct())))
        self.index.add(new)
        return replace(
            self,
            parents=cut_lineage(replace_rows(self.parents, changes, ["id"])),
            keys=cut_lineage(replace_rows(self.keys, keys, ["canonical_key"])),
            prints=cut_lineage(replace_rows(self.prints, prints, ["block", "simhash"])),
        )


def _stars(kept: DataFrame, rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges from each row to the smallest known holder of its value, and the holders that are new or smaller."""
    day = rows.groupBy(*by).agg(F.min("id").alias("id"))
    old = kept.select(*by, F.col("id").alias("kept_id"))
    centre = cut_lineage(day.join(old, by, "left").select(*by, F.least("id", F.coalesce("kept_id", "id")).alias("dst"), "kept_id"))
    edges = rows.select(*by, F.col("id").alias("src")).join(centre, by).select("src", "dst")
    # A smaller id of today is the new centre; the earlier one hangs on it.
    handed = centre.where("kept_id > dst").select(F.col("kept_id").alias("src"), "dst")
    changed = centre.where("kept_id IS NULL OR dst < kept_id").select(*by, F.col("dst").alias("id"))
    return edges.unionByName(handed).where("src <> dst"), changed
