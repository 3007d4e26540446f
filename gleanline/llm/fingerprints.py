"""Document fingerprints as invertible Bloom lookup sketches; DataFrame functions only.

A fingerprint is a table of cells. Each line of a text, with the number of its earlier equals, gives a digest that is
added to one cell of each of three ranges: the cell counts it and keeps the exclusive or of the digests and of their
checks. Cells of two versions subtract; what is left holds only the digests that differ, and cells that hold one digest
alone are peeled until none is left. If peeling gets stuck, both sides are sketched again with twice the cells.

Large texts have several tables, each for the digests of one residue, so that work grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import store

#: Cells of each range in a first sketch, digests meant for one table, peeling rounds, doublings.
CELLS, LOAD, ROUNDS, RETRIES = 16, 10, 24, 12
#: Neighbouring ids are brought together in groups of so many numbers.
SPAN = 1024


def with_digests(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with `name`, the digests of the lines of `text` that hold a word; the k-th of equal lines has its own."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    hashed = df.withColumn(name, F.array_sort(F.transform(lines, lambda x: F.xxhash64(x))))
    return hashed.withColumn(name, F.transform(name, lambda x, i: F.xxhash64(x, i - F.array_position(name, x))))


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(7))


def _cell(n: Column, key: Column, check: Column, of: Column) -> Column:
    """A cell with the place of `of`: digests belong to it whose 12 bits from `shift` are `pos` under `mask`."""
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"), *[of[c].alias(c) for c in ("shift", "mask", "pos")])


def _put(cell: Column, n: Column, x: Column) -> Column:
    """The cell after adding digest x to it n times, if it belongs there."""
    hit = F.call_function("shiftright", x, cell["shift"]).bitwiseAND(cell["mask"]) == cell["pos"]
    added = _cell(cell["n"] + n, cell["key"].bitwiseXOR(x), cell["check"].bitwiseXOR(_check(x)), cell)
    return F.when(hit, added).otherwise(cell)


def sketch(digests: Column, cells: Column) -> Column:
    """Array of 3 * cells cells: three ranges that each hold every digest once."""
    zero = F.lit(0).cast("long")

    def empty(i: Column) -> Column:
        place = F.struct(
            (F.floor(i / cells) * 12).cast("int").alias("shift"), (cells - 1).cast("long").alias("mask"), F.pmod(i, cells).cast("long").alias("pos")
        )
        return F.transform(F.array(place), lambda of: _cell(F.lit(0), zero, zero, of))[0]

    blank = F.transform(F.sequence(F.lit(0), cells * 3 - 1), empty)
    return F.transform(blank, lambda cell: F.aggregate(digests, cell, lambda acc, x: _put(acc, F.lit(1), x)))


def peeled(a: Column, b: Column, cells: Column) -> Column:
    """How many digests differ between two arrays, read from the difference of their sketches; null if peeling gets stuck."""
    left = F.zip_with(
        sketch(a, cells),
        sketch(b, cells),
        lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"]), x),
    )

    def step(acc: Column, _: Column) -> Column:
        alone = F.array_distinct(
            F.transform(
                F.filter(acc["left"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))),
                lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key")),
            )
        )
        # The one-element array binds what would be computed again for each cell.
        peel = F.transform(
            F.array(alone),
            lambda found: F.struct(
                F.transform(acc["left"], lambda c: F.aggregate(found, c, lambda s, d: _put(s, -d["n"], d["key"]))).alias("left"),
                (acc["count"] + F.size(found)).alias("count"),
                (F.size(found) == 0).alias("done"),
            ),
        )[0]
        return F.when(acc["done"], acc).otherwise(peel)

    start = F.struct(left.alias("left"), F.lit(0).alias("count"), F.lit(False).alias("done"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        step,
        lambda acc: F.when(F.forall(acc["left"], lambda c: (c["n"] == 0) & (c["key"] == 0)), acc["count"]),
    )


def _tables(n: Column) -> Column:
    """Number of tables for n digests: a power of two."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / LOAD)))).cast("int")


def _of_table(digests: Column, table: Column, tables: Column) -> Column:
    return F.filter(digests, lambda x: F.shiftrightunsigned(x, 40).bitwiseAND((tables - 1).cast("long")) == table.cast("long"))


def difference(a: str, b: str) -> Column:
    """How many digests differ between the columns `a` and `b`, table by table, with as many doublings as a table needs."""
    tables = _tables(F.greatest(F.size(a), F.size(b)))

    def one(table: Column) -> Column:
        pair = F.array(F.struct(_of_table(F.col(a), table, tables).alias("a"), _of_table(F.col(b), table, tables).alias("b")))
        tries = lambda p: F.aggregate(
            F.sequence(F.lit(0), F.lit(RETRIES)),
            F.lit(None).cast("int"),
            lambda acc, k: F.coalesce(acc, peeled(p["a"], p["b"], F.call_function("shiftleft", F.lit(CELLS), k))),
        )
        # Beyond the last doubling the sets are compared as they are.
        exact = lambda p: F.size(F.array_except(p["a"], p["b"])) + F.size(F.array_except(p["b"], p["a"]))
        return F.transform(pair, lambda p: F.coalesce(tries(p), exact(p)))[0]

    return F.aggregate(F.sequence(F.lit(0), tables - 1), F.lit(0), lambda acc, table: acc + one(table))


def likeness(a: str, b: str) -> Column:
    """Shared digests over all digests of both, from the sizes and the recovered difference; 1 if both have none."""
    both, differ = F.size(a) + F.size(b), difference(a, b)
    return F.transform(F.array(differ), lambda d: F.when(both == 0, 1.0).otherwise((both - d) / (both + d)))[0]


def fingerprint(digests: str) -> Column:
    """The cells of all tables as text: count, key and check in hexadecimal; an empty cell is empty."""
    tables = _tables(F.size(digests))
    cell = lambda c: F.when(c["n"] == 0, "").otherwise(F.concat_ws(".", c["n"], F.hex(c["key"]), F.hex(c["check"])))
    table = lambda t: F.array_join(F.transform(sketch(_of_table(F.col(digests), t, tables), F.lit(CELLS)), cell), ",")
    return F.array_join(F.transform(F.sequence(F.lit(0), tables - 1), lambda t: F.transform(F.array(t), table)[0]), ";")


def following(keys: DataFrame, levels: int = 2) -> DataFrame:
    """(key, after): the next smaller of the distinct keys, null after the smallest.

    Keys meet in groups of SPAN numbers; only the largest keys of the groups go to the level above.
    """
    if levels == 0:
        return keys.withColumn("after", F.lead("key").over(Window.orderBy(F.desc("key"))))
    grouped = keys.withColumn("group", F.floor(F.col("key") / SPAN))
    inside = grouped.withColumn("after", F.lead("key").over(Window.partitionBy("group").orderBy(F.desc("key"))))
    heads = grouped.groupBy("group").agg(F.max("key").alias("head"))
    above = following(heads.select(F.col("group").alias("key")), levels - 1).select(F.col("key").alias("group"), F.col("after").alias("lower"))
    beyond = above.join(heads.select(F.col("group").alias("lower"), "head"), "lower", "left").select("group", "head")
    return inside.join(beyond, "group", "left").select("key", F.coalesce("after", "head").alias("after"))


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text, own, edited, next: each text, its digests, its edited text, and the digests of the next document.

    The next document is the one with the next smaller doc_id; after the last comes the first. In the edited text the
    last half of the characters, rounded down, is replaced by as many of the first of the next document's, or all.
    Rows that share a doc_id follow each other in the order of their texts' hashes; rows without doc_id come last.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.floor(F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))) / SPAN)
    rows = with_digests(docs, "text", "own").select("doc_id", "text", "own", key.alias("key"), F.xxhash64("text").alias("hash"))
    order = [F.desc_nulls_last("doc_id"), F.asc("hash")]
    groups = store(following(docs.select(key.alias("key")).distinct()))
    top = groups.agg(F.max("key")).first()[0]
    # The first row of each group is also the last of the group before it, so that texts cross the network once.
    first = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    heads = store(rows.withColumn("place", first).where("place = 1").drop("place")).withColumnRenamed("key", "lower")
    links = groups.select("key", F.coalesce("after", F.lit(top).cast("long")).alias("lower"))
    copies = heads.join(links, "lower").select("doc_id", "text", "own", "key", "hash", F.lit(1).alias("copy"))
    both = rows.withColumn("copy", F.lit(0)).unionByName(copies)
    after = F.lead(F.struct("text", "own")).over(Window.partitionBy("key").orderBy("copy", *order))
    paired = both.withColumn("after", after).where("copy = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("after.text", half))
    return paired.select("doc_id", "text", "own", edited.alias("edited"), F.col("after.own").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    Likeness is the share of common lines among the lines of both texts. Null texts are empty; two texts without lines
    are alike (1), one of them alone is not (0). A single document is its own next one. No rows give no rows.
    """
    rows = with_digests(versions(docs), "edited", "new")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"),
        fingerprint("new").alias("edited_fingerprint"),
        likeness("own", "new").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
    )
