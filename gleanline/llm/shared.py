"""Tables between the steps of one job, and the words of a batch of texts as numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 6 << 20
#: Shuffle files of a finished write go at once instead of with the driver's garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a temporary one only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def store(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends here, and the planner knows the size."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


@dataclass
class Words:
    """Words of some texts: `codes[starts[i]:starts[i + 1]]` index `values` and are the words of text i."""

    codes: np.ndarray
    starts: np.ndarray
    values: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """Words between ASCII white space; null is empty. Only A-Z are lower-cased."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    starts = lists.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    codes, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    starts -= starts[0]
    blank = pc.index(values, pa.scalar("", pa.string())).as_py()
    if blank >= 0:
        real = codes != blank
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        codes = codes[real]
    return Words(codes, starts, values)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def hashes(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string, the same on every machine."""
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered within each text, and where each text starts.

    A text with fewer than `width` words has one shingle, its whole sequence; one without words has none.
    """
    hashed, n = hashes(words.values)[words.codes], words.counts
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(size)])
    rows = np.repeat(np.arange(len(n)), size)
    first = np.arange(starts[-1]) - starts[rows] + words.starts[rows]
    length = np.minimum(n, width)[rows].astype(np.uint64)
    out = length.copy()
    with np.errstate(over="ignore"):
        for k in range(width):
            there = length > k
            at = np.minimum(first + k, max(len(hashed) - 1, 0))
            step = out * np.uint64(0x9E3779B97F4A7C15) + (hashed[at] if len(hashed) else np.uint64(0))
            out = np.where(there, mixed(step), out)
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    out, rows = out[new], rows[new]
    return out, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(n)))])
