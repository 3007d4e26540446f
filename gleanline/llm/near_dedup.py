"""MinHash near-dedup with SetSketch registers.

A sketch holds `m` registers. Register i is the minimum of the i-th hash over the shingles of a text, read as an
exponential variable of rate `RATE`, and kept as floor(1 - log_b(minimum)) within 0..`TOP`: exponentially spaced,
truncated minima, which merge by maximum. Texts agree in a register with a probability close to their Jaccard
similarity, so bands of registers find candidates. The three counts of registers (equal, larger, smaller) and the
two set sizes give the joint likelihood of the similarity; pairs whose most likely similarity is so far below
the threshold that a pair at the threshold is there with a probability of at most MISS go. The rest are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, mixed, shingles, slices, store, words_of

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
ROWS = 5
MISS = 1e-8


def bands(percent: int) -> int:
    """Number of bands with which a pair at the threshold is missed with a probability of at most MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def registers(hashed: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """(texts, m) registers; texts without shingles have zeros."""
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, m, dtype=np.uint32)
    full = np.flatnonzero(np.diff(starts))
    low = np.zeros((m, len(full)), np.uint32)
    x = (mixed(hashed) >> np.uint64(32)).astype(np.uint32)
    at = starts[full]
    done = 0
    while done < len(full):  # blocks that stay in the cache
        stop = max(done + 1, int(np.searchsorted(at, at[done] + 60_000)))
        end = at[stop] if stop < len(full) else len(x)
        part, cuts = x[at[done] : end], at[done:stop] - at[done]
        buffer = np.empty_like(part)
        for i in range(m):
            np.multiply(part, factors[i], out=buffer)
            np.add(buffer, shifts[i], out=buffer)
            low[i, done:stop] = np.minimum.reduceat(buffer, cuts)
        done = stop
    minimum = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    kept = np.clip(np.floor(1 - np.log(minimum) / math.log(BASE)), 0, TOP).astype(np.int32)
    out = np.zeros((len(starts) - 1, m), np.int32)
    out[full] = kept.T
    return out


def _sketcher(width: int, n_bands: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                hashed, starts = shingles(words_of(part["text"]), width)
                kept = registers(hashed, starts, n_bands * ROWS)
                keys = np.zeros((len(kept), n_bands), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(ROWS):
                        keys = mixed(keys * np.uint64(31) + kept[:, k::ROWS].astype(np.uint64) + np.uint64(1))
                    keys = mixed(keys + np.arange(n_bands, dtype=np.uint64))
                    sums = [
                        np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashed ^ np.uint64(salt)), dtype=np.uint64)])
                        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)
                    ]
                    one, two = (s[starts[1:]] - s[starts[:-1]] for s in sums)
                flat = np.arange(len(kept) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array(np.diff(starts)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.ListArray.from_arrays(flat * n_bands, pa.array(keys.view(np.int64).ravel())),
                        pa.ListArray.from_arrays(flat * (n_bands * ROWS), pa.array(kept.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "keys", "regs"],
                )

    return sketch


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (digest of the set), keys (one per band), regs of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _sketcher(width, bands(percent)),
        "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, regs array<int>",
    )


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and its distinct shingle hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                hashed, starts = shingles(words_of(part["text"]), width)
                sets = pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(hashed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], sets], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        build, "doc_id long, shingles array<long>"
    )


def likely(a: Column, b: Column, n_a: Column, n_b: Column, m: int, percent: int) -> Column:
    """Whether the most likely similarity of two sketches is above `lowest`.

    With shares u = n_a / (n_a + n_b) and v = n_b / (n_a + n_b) a register of the first text is larger with
    probability p(u - vJ), smaller with p(v - uJ), where p(x) = -log_b(1 - x (b - 1) / b). The log-likelihood is
    concave, so its maximum lies above J exactly where its derivative at J is positive.
    """
    j = F.lit(lowest(percent, m))
    c = (BASE - 1) / BASE
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    larger = F.size(F.filter(F.zip_with(a, b, lambda x, y: x > y), lambda x: x)).cast("double")
    smaller = F.size(F.filter(F.zip_with(a, b, lambda x, y: x < y), lambda x: x)).cast("double")

    def p(x: Column) -> Column:
        return -F.log(1 - x * F.lit(c)) / F.lit(math.log(BASE))

    def slope(x: Column) -> Column:
        return F.lit(c / math.log(BASE)) / (1 - x * F.lit(c))

    up, down = F.greatest(u - v * j, F.lit(1e-12)), F.greatest(v - u * j, F.lit(1e-12))
    gain_up, gain_down = -v * slope(up), -u * slope(down)
    equal = F.lit(float(m)) - larger - smaller
    score = (
        larger * gain_up / p(up)
        + smaller * gain_down / p(down)
        - equal * (gain_up + gain_down) / F.greatest(1 - p(up) - p(down), F.lit(1e-12))
    )
    return score > 0


def _close_sizes(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets are similar enough; only texts of the pairs are read."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = store(shingle_sets(docs.join(ends, "doc_id", "left_semi"), width))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    found = store(
        pairs.join(left, "a")
        .join(right, "b")
        .where(common * 100 >= (F.size("s_a") + F.size("s_b") - common) * percent)
        .select("a", "b")
    )
    forget(sets)
    return found


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of edges (a, b): the component is the smallest id that can be reached.

    Alternating large-star and small-star contraction, each half round written to the shared folder. Minima are
    aggregated before the shuffle, and joins have stored tables on both sides, so that a hot end can be split.
    """
    current = store(edges.select(F.greatest("a", "b").alias("s"), F.least("a", "b").alias("d")).where("s <> d").distinct())
    while True:
        ends = current.select(F.inline(F.array(F.struct("s", "d"), F.struct(F.col("d").alias("s"), F.col("s").alias("d")))))
        lowest = store(ends.groupBy("s").agg(F.least(F.min("d"), F.col("s")).alias("low")))
        large = store(ends.join(lowest, "s").where("d > s").select(F.col("d").alias("s"), F.col("low").alias("d")).distinct())
        parent = store(large.groupBy("s").agg(F.min("d").alias("low")))
        both = F.array(F.struct("s", F.col("low").alias("d")), F.struct(F.col("d").alias("s"), F.col("low").alias("d")))
        small = store(large.join(parent, "s").select(F.inline(both)).where("s <> d").distinct())
        for old in (current, lowest, large, parent):
            forget(old)
        current = small
        sources = current.groupBy("s").agg(F.count("*").alias("n"))
        chained = current.select(F.col("d").alias("s")).join(sources.select("s"), "s", "left_semi")
        if sources.where("n > 1").limit(1).count() == 0 and chained.limit(1).count() == 0:
            break
    roots = current.select(F.col("d").alias("id"), F.col("d").alias("component")).distinct()
    return current.select(F.col("s").alias("id"), F.col("d").alias("component")).unionByName(roots)


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of `docs` (doc_id, text).

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; `component_id` is the
    smallest doc_id that links reach. Equal sets collapse to one representative first, so copies cost one row each.
    Every other member of a bucket is compared with the bucket's first member; what these stars leave apart is
    compared within the bucket, where the join itself tests sizes and likelihood, so that pairs never come out
    that cannot be similar.

    Null or empty texts have no shingles and no link. Rows that share a doc_id are one vertex and give a row each;
    a row without doc_id is linked with nothing: its component is null and it is kept. No rows give no rows.
    """
    m = bands(percent) * ROWS
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketched = store(sketches(docs, width, percent))
    real = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = ["h1", "h2", "n_shingles"]
    firsts = store(real.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    copies = store(
        real.select("doc_id", *sets)
        .join(firsts.where("rows > 1"), sets)
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        .where("a <> b")
    )
    reps = store(
        real.join(firsts.select(*sets, F.col("rep").alias("doc_id")), [*sets, "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "keys", "regs")
    )
    rows = reps.select(F.explode("keys").alias("key"), "id", "n")
    first = F.min(F.struct("id", "n")).alias("c")
    centres = store(rows.groupBy("key").agg(first, F.count("*").alias("size")).where("size > 1"))
    members = store(rows.join(centres, "key").select("key", "id", "n", "size", F.col("c.id").alias("c"), F.col("c.n").alias("c_n")))
    stars = members.where((F.col("id") != F.col("c")) & _close_sizes("n", "c_n", percent)).select(
        F.col("id").alias("a"), F.col("c").alias("b")
    )
    regs = reps.select("id", "n", "regs")
    may = store(
        stars.distinct()
        .join(regs.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a")), "a")
        .join(regs.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b")), "b")
        .where(likely(F.col("r_a"), F.col("r_b"), F.col("n_a"), F.col("n_b"), m, percent))
        .select("a", "b")
    )
    links = copies.unionByName(_confirmed(docs, may, width, percent))
    parts = connected(links)
    rest = _rest(docs, members, reps, parts, width, percent)
    if rest.limit(1).count():
        parts = connected(links.unionByName(rest))
    out = sketched.select("doc_id", "n_shingles").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    whole = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(whole == F.col("doc_id"), F.lit(True)).alias("kept"))


def _rest(docs: DataFrame, members: DataFrame, reps: DataFrame, parts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components of `parts` which still meet in a bucket.

    Buckets that hold several components are merged into clusters, in which each set occurs once. Clusters are compared
    cell by cell of a grid with CELL sets to a side, so that no task holds a large one whole. A cell tests its pairs
    as the joins do (common band, sizes, likelihood), confirms them on the full sets and returns a spanning forest of
    the links found: no more rows than it has sets.
    """
    labelled = store(
        members.select("key", "id", "c").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    )
    meeting = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    rows = store(labelled.join(store(meeting.select("key")), "key", "left_semi").select("id", "c", "component").distinct())
    clusters = connected(rows.select(F.col("id").alias("a"), F.col("c").alias("b"))).withColumnRenamed("component", "cluster")
    sizes = store(clusters.groupBy("cluster").agg(F.count("*").alias("size")))
    sets = shingle_sets(docs.join(store(rows.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi"), width)
    placed = store(
        rows.select("id", "component").distinct()
        .join(clusters, "id")
        .join(reps.select("id", "n", "keys", "regs"), "id")
        .join(sets.select(F.col("doc_id").alias("id"), "shingles"), "id")
        .where(F.size("shingles") == F.col("n"))
        .join(sizes, "cluster")
    )
    grid = F.ceil(F.col("size") / CELL).cast("int")
    placed = placed.select("*", F.pmod(F.xxhash64("id"), grid).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), grid - 1)).alias("other"))
    cells = placed.select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("second"), "id", "component", "n", "keys", "regs", "shingles",
    )
    return store(cells.groupBy("cluster", "i", "j").applyInArrow(_cell(percent), "a long, b long"))


#: Sets to a side of a cell.
CELL = 256


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(n, -1)


def outcomes(j: float, u: float, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of larger and of smaller registers and the probability of each, for texts of similarity j and shares u and 1 - u."""
    c, v = (BASE - 1) / BASE, 1 - u
    up, down = (-math.log1p(-max(x, 0.0) * c) / math.log(BASE) for x in (u - v * j, v - u * j))
    larger, smaller = (x.ravel() for x in np.indices((m + 1, m + 1)))
    larger, smaller = larger[larger + smaller <= m], smaller[larger + smaller <= m]
    rest = m - larger - smaller
    factorial = np.array([math.lgamma(k + 1) for k in range(m + 1)])
    logs = factorial[m] - factorial[larger] - factorial[smaller] - factorial[rest]
    for count, share in ((larger, up), (smaller, down), (rest, 1 - up - down)):
        logs += count * math.log(max(share, 1e-300))
    return larger, smaller, np.exp(logs)


@lru_cache
def lowest(percent: int, m: int) -> float:
    """A similarity below which the most likely one of a pair at the threshold is with a probability of at most MISS.

    The exact law of the three counts is summed for sizes from equal to as unlike as the threshold allows.
    """
    target = percent / 100
    laws = [(u, *outcomes(target, u, m)) for u in (r / (1 + r) for r in np.linspace(target, 1, 9))]
    j = target
    while any(law[~likeliest_above(larger, smaller, u, 1 - u, m, j)].sum() > MISS for u, larger, smaller, law in laws):
        j -= 0.005
    return j


def likeliest_above(d_up: np.ndarray, d_down: np.ndarray, u: np.ndarray, v: np.ndarray, m: int, j: float) -> np.ndarray:
    """`likely` for counts of larger and smaller registers."""
    c = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * c) / math.log(BASE)

    up, down = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    gain_up, gain_down = (-v * c / math.log(BASE)) / (1 - up * c), (-u * c / math.log(BASE)) / (1 - down * c)
    rest = np.maximum(1 - p(up) - p(down), 1e-12)
    return d_up * gain_up / p(up) + d_down * gain_down / p(down) - (m - d_up - d_down) * (gain_up + gain_down) / rest > 0


def _cell(percent: int):
    m = bands(percent) * ROWS
    floor = lowest(percent, m)

    def compare(table: pa.Table) -> pa.Table:
        rows = table.num_rows
        ids, part, n = (table[c].to_numpy() for c in ("id", "component", "n"))
        keys, regs = _matrix(table["keys"], rows), _matrix(table["regs"], rows)
        lists = table["shingles"].combine_chunks()
        flat, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
        kinds, flat = np.unique(flat, return_inverse=True)
        second = table["second"].to_numpy(zero_copy_only=False)
        right = np.flatnonzero(second) if second.any() else np.arange(rows)
        left = np.flatnonzero(~second)
        label = np.unique(part, return_inverse=True)[1]
        mark = np.zeros(len(kinds), bool)
        found: list[tuple[int, int]] = []
        for a in left:
            b = right[label[right] != label[a]]
            b = b[np.minimum(n[b], n[a]) * 100 >= np.maximum(n[b], n[a]) * percent]
            b = b[(keys[b] == keys[a]).any(1)]
            if not len(b):
                continue
            d_up, d_down = (regs[b] < regs[a]).sum(1), (regs[b] > regs[a]).sum(1)
            total = n[a] + n[b]
            b = b[likeliest_above(d_up, d_down, n[a] / total, n[b] / total, m, floor)]
            mark[flat[cuts[a] : cuts[a + 1]]] = True
            for k in b:
                if label[k] == label[a]:
                    continue
                common = int(mark[flat[cuts[k] : cuts[k + 1]]].sum())
                if common * 100 >= (n[a] + n[k] - common) * percent:
                    found.append((int(ids[a]), int(ids[k])))
                    label[label == label[k]] = label[a]
            mark[flat[cuts[a] : cuts[a + 1]]] = False
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return compare
