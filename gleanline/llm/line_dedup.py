"""Line dedup as an exact set-similarity join; DataFrame functions only.

A line is the set of its words. Words are ordered by rarity over the whole corpus. Two sets with a Jaccard similarity
of at least t, the larger of n and the smaller of m words, have their first common word among the first
n - ceil(t n) + 1 of the larger and the first m - ceil(2 t m / (1 + t)) + 1 of the smaller. Lines that share such a word
and pass the length and positional filters are compared in full. Equal sets collapse first.

One match is enough for a line to go. So each set is first held against the most repeated lines that hold some of its
words; in a group of like lines that settles nearly all, and only pairs whose later line is still open come out of
the full join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, store

#: Rarity is known for so many hash buckets of words, whatever the size of the corpus.
BUCKETS = 1 << 17
HASH_BITS = 55
#: Prefixes meet in so many parts, by their words, one after the other: only one part's shuffle is on disk.
PARTS = 4


def plain(text: Column) -> Column:
    """Lower-cased text with blanks for all other ASCII white space but the ends of lines; most texts have none."""
    low = F.lower(text)
    odd = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in "\t\r\x0b\x0c"])
    return F.when(odd, F.regexp_replace(low, r"[\t\r\x0b\x0c]", " ")).otherwise(low)


def words(line: Column) -> Column:
    """Words of a line of `plain` text."""
    return F.array_remove(F.split(line, " "), "")


def _bucket(hashed: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(BUCKETS)).cast("int")


def rarity(docs: DataFrame) -> Column:
    """A byte for each bucket: four times the binary logarithm of its occurrences in `docs`, cut to a whole.

    The driver gets at most BUCKETS small numbers.
    """
    counted = (
        docs.select(F.explode(F.split(F.replace(plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
        .where("word <> ''")
        .groupBy(_bucket(F.xxhash64("word")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    ranks = bytearray(BUCKETS)
    for bucket, n in counted.toLocalIterator():
        ranks[bucket] = min(127, int(4 * math.log2(n)))
    return F.lit(bytes(ranks))


def tokens(line: Column, ranks: Column) -> Column:
    """The distinct words of a line as numbers that sort by rarity: rank above, hash below."""
    mask = F.lit((1 << HASH_BITS) - 1)

    def ranked(w: Column) -> Column:
        h = F.xxhash64(w)
        rank = F.ascii(F.substring(ranks, _bucket(h) + 1, F.lit(1)).cast("string"))
        return F.shiftleft(rank.cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(mask))

    return F.sort_array(F.array_distinct(F.transform(words(line), ranked)))


def _probed(n: Column, percent: int) -> Column:
    """Words of the larger set among which the first common one is."""
    return n - F.ceil(n * percent / 100).cast("int") + 1


def _indexed(n: Column, percent: int) -> Column:
    """Words of the smaller set among which the first common one is."""
    return n - F.ceil(n * (2 * percent) / (100 + percent)).cast("int") + 1


def _signature(t: Column) -> Column:
    """128 bits, each the parity of the words that hash to it: sets differ in at least as many words as in bits."""
    one = F.lit(1).cast("long")

    def half(k: int) -> Column:
        def put(acc: Column, x: Column) -> Column:
            bit = F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int"))
            return F.when(x.bitwiseAND(64) == 64 * k, acc.bitwiseXOR(bit)).otherwise(acc)

        return F.aggregate(t, F.lit(0).cast("long"), put)

    return F.struct(half(0).alias("low"), half(1).alias("high"))


def _room(n_a: Column, n_b: Column, percent: int) -> Column:
    """Words that only one of two similar sets can have."""
    return n_a + n_b - 2 * F.ceil((n_a + n_b) * percent / (100 + percent)).cast("int")


def _alike(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """What sizes `n` and signatures `s` of two sets allow."""
    a, b = x["n"], y["n"]
    long_enough = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    differ = sum(F.bit_count(x["s"][half].bitwiseXOR(y["s"][half])) for half in ("low", "high"))
    return long_enough & (differ <= _room(a, b, percent))


def _packed(entries: DataFrame, side: str) -> DataFrame:
    """What the join of all prefixes shuffles and sorts, in six numbers; `_unpacked` has their meaning.

    Words meet as 32-bit hashes; words that only share the hash are told apart by the filters and by the full sets.
    """
    numbers = {
        "low": F.col("s.low"),
        "high": F.col("s.high"),
        "doc": F.col("set.doc_id"),
        "size": F.shiftleft(F.col("set.line_no").cast("long"), 32).bitwiseOR(F.col("n").cast("long")),
        "spot": F.shiftleft(F.col("at").cast("long"), 1).bitwiseOR(F.col("gone").cast("long")),
    }
    return entries.select(F.hash("token").alias("token"), *[v.alias(f"{k}_{side}") for k, v in numbers.items()])


def _unpacked(side: str) -> dict[str, Column]:
    size, spot = F.col(f"size_{side}"), F.col(f"spot_{side}")
    line_no = F.shiftright(size, 32).cast("int")
    return {
        "set": F.struct(F.col(f"doc_{side}").alias("doc_id"), line_no.alias("line_no")),
        "n": size.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"),
        "s": F.struct(F.col(f"low_{side}").alias("low"), F.col(f"high_{side}").alias("high")),
        "at": F.shiftright(spot, 1).cast("int"),
        "gone": spot.bitwiseAND(F.lit(1).cast("long")) == 1,
    }


def _side(entries: DataFrame, side: str) -> DataFrame:
    return entries.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("set", "n", "s")])


def _star_matches(docs: DataFrame, firsts: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """`b`: sets that a repeated line matches, of those that hold one of three of their probed words the one with most copies."""
    held = firsts.where("copies > 1").select("set", "n", "s", "copies", F.explode(F.slice("prefix", F.lit(1), _indexed(F.col("n"), percent))).alias("token"))
    widest = held.groupBy("token").agg(F.max_by(F.struct("set", "n", "s"), F.struct("copies", "set")).alias("m")).select("token", "m.*")
    last = F.size("prefix")
    some = F.array_distinct(F.array(*[F.element_at("prefix", F.ceil(last * part).cast("int")) for part in (0.3, 0.5, 1.0)]))
    asked = firsts.select("set", "n", "s", F.explode(some).alias("token"))
    a, b = ({c: F.col(f"{c}_{side}") for c in ("set", "n", "s")} for side in "ab")
    met = _side(widest, "a").join(_side(asked, "b"), "token").where((a["set"] < b["set"]) & _alike(a, b, percent))
    pairs = store(met.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).distinct())
    sets = store(_sets(docs, pairs, ranks))
    found = store(_similar(pairs, sets, percent).distinct())
    forget(pairs)
    forget(sets)
    return found


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, line_no) of every line that an earlier line matches; see `dedup_lines`."""
    ranks = rarity(docs)
    lines = store(
        docs.select("doc_id", F.posexplode(F.split(plain(F.col("text")), "\n")).alias("line_no", "line"))
        .where(F.trim("line") != "")  # a test of the tokens would be pushed down and compute them twice
        .select("doc_id", "line_no", tokens(F.col("line"), ranks).alias("t"))
        .select("doc_id", "line_no", F.size("t").alias("n"), "t")
        .select(
            "doc_id", "line_no", "n", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2"),
            _signature(F.col("t")).alias("s"), F.slice("t", F.lit(1), _probed(F.col("n"), percent)).alias("prefix"),
        )
    )
    place = F.struct("doc_id", "line_no")
    firsts = store(
        lines.groupBy("k1", "k2", "n")
        .agg(F.min(F.struct("doc_id", "line_no", "s", "prefix")).alias("m"), F.count("*").alias("copies"))
        .select("k1", "k2", "n", "copies", F.struct("m.doc_id", "m.line_no").alias("set"), "m.s", "m.prefix")
    )
    copies = store(
        lines.join(firsts.where("copies > 1").select("k1", "k2", "n", "set"), ["k1", "k2", "n"])
        .where(place != F.col("set"))
        .select("doc_id", "line_no")
    )
    forget(lines)
    settled = _star_matches(docs, firsts, ranks, percent)
    flagged = firsts.select("set", "n", "s", "prefix").join(settled.select(F.col("b").alias("set"), F.lit(True).alias("gone")), "set", "left")
    flagged = store(flagged.select("set", "n", "s", F.coalesce("gone", F.lit(False)).alias("gone"), "prefix"))
    forget(firsts)
    shorter = F.slice("prefix", F.lit(1), _indexed(F.col("n"), percent))
    # Similar sets that differ have so many common words at least; the larger one has another word.
    common = F.lit(percent)
    small = flagged.where(F.col("n") * (100 - percent) >= common).select("set", "n", "s", "gone", F.posexplode(shorter).alias("at", "token"))
    large = flagged.where((F.col("n") - 1) * (100 - percent) >= common).select("set", "n", "s", "gone", F.posexplode("prefix").alias("at", "token"))
    x, y = _unpacked("a"), _unpacked("b")
    # Of sets of one size the earlier is taken for the smaller.
    roles = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["set"] < y["set"]))
    early = x["at"] + y["at"] <= _room(x["n"], y["n"], percent)
    later_open = ~F.when(x["set"] < y["set"], y["gone"]).otherwise(x["gone"])
    parts = []
    for k in range(PARTS):
        here = F.pmod(F.shiftright("token", 8), F.lit(PARTS)) == k
        a, b = _packed(small, "a").where(here), _packed(large, "b").where(here)
        parts.append(
            store(
                a.join(b, (a["token"] == b["token"]) & roles & later_open & early & _alike(x, y, percent))
                .groupBy(F.least(x["set"], y["set"]).alias("a"), F.greatest(x["set"], y["set"]).alias("b"))
                .agg(F.count("*").alias("shared_here"))
            )
        )
    pairs = store(reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.sum("shared_here").alias("shared")))
    sets = store(_sets(docs, pairs, ranks))
    # Each line is held first against the line with which it shares most, and only those that fail there against all others.
    best = store(pairs.groupBy("b").agg(F.max_by("a", "shared").alias("a")))
    found = store(_similar(best, sets, percent))
    others = pairs.join(found, "b", "left_anti").join(best.withColumnRenamed("a", "tried"), "b").where("a <> tried")
    similar = settled.unionByName(found).unionByName(_similar(others, sets, percent)).select("b.doc_id", "b.line_no").distinct()
    out = store(copies.unionByName(similar))
    for old in (copies, flagged, settled, *parts, pairs, sets, best, found):
        forget(old)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later line `b` of the pairs whose full sets are similar enough."""
    common = F.size(F.array_intersect("t_a", "t_b"))
    return (
        pairs.join(sets.select(F.col("place").alias("a"), F.col("t").alias("t_a")), "a")
        .join(sets.select(F.col("place").alias("b"), F.col("t").alias("t_b")), "b")
        .where(common * 100 >= (F.size("t_a") + F.size("t_b") - common) * percent)
        .select("b")
    )


def _sets(docs: DataFrame, pairs: DataFrame, ranks: Column) -> DataFrame:
    """place and token set of the lines in `pairs`."""
    ends = pairs.select(F.col("a").alias("place")).distinct().unionByName(pairs.select(F.col("b").alias("place")).distinct())
    wanted = ends.select("place.doc_id", "place.line_no").distinct().groupBy("doc_id").agg(F.collect_list("line_no").alias("wanted"))
    some = docs.join(wanted, "doc_id").select(
        "doc_id", "wanted", F.posexplode(F.split(plain(F.col("text")), "\n")).alias("line_no", "line")
    )
    return some.where(F.array_contains("wanted", F.col("line_no"))).select(
        F.struct("doc_id", "line_no").alias("place"), tokens(F.col("line"), ranks).alias("t")
    )


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` with repeated lines taken out of `text`; also `n_lines` and `n_removed` (int).

    Lines are split at \\n and ordered by (doc_id, place in the text). A line with a word goes if the word set of any
    earlier line has a Jaccard similarity of at least percent / 100 with its own; the first of equal lines stays.
    Lines without a word stay. A null text has no lines and stays null. A row without doc_id is left as it is. Rows
    that share a doc_id count as one document each: their lines are matched with other documents, and a line that goes
    from one goes from the same place of the other. Columns of these names in `docs` are replaced.
    """
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gone = repeated_lines(known, percent).distinct().groupBy("doc_id").agg(F.collect_list("line_no").alias("gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*own).alias("doc")).join(
        gone.withColumnRenamed("doc_id", "gone_id"), F.col("doc.doc_id") == F.col("gone_id"), "left"
    )
    lines = F.split(F.col("doc.text"), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(kept)
    return rows.select(
        *[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in own],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle(percent: int = 80) -> str:
    """The same rows in DuckDB SQL, by counting the common words of all lines."""
    return f"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
w AS (SELECT doc_id, line_no, line, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS t FROM l),
s AS (SELECT row_number() OVER (ORDER BY min(struct_pack(d := doc_id, l := line_no))) AS id, t, len(t) AS n, min(struct_pack(d := doc_id, l := line_no)) AS first FROM w WHERE len(t) > 0 GROUP BY t),
e AS (SELECT id, n, unnest(t) AS token FROM s),
p AS (SELECT y.id FROM e AS x JOIN e AS y ON x.token = y.token AND x.id < y.id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent}
  GROUP BY x.id, y.id, x.n, y.n HAVING count(*) * 100 >= (x.n + y.n - count(*)) * {percent}),
late AS (SELECT DISTINCT id FROM p),
m AS (SELECT w.doc_id, w.line_no, w.line, s.id IS NOT NULL AND (s.first <> struct_pack(d := w.doc_id, l := w.line_no) OR late.id IS NOT NULL) AS gone
  FROM w LEFT JOIN s ON w.t = s.t LEFT JOIN late ON s.id = late.id)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
