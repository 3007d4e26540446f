"""Language by rank profiles: the most frequent character n-grams of a text against those of each language.

A profile is learned from labelled texts. A text is compared by how far its n-grams stand from their place in the
profile; the nearest language counts only if it is near enough and clearly nearer than the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

LONGEST, PLACES = 3, 300
#: Shorter texts say too little.
LEAST_CHARS = 40
#: Mean distance per n-gram, as a share of the farthest, that a text in a known language stays below.
FARTHEST = 0.72
#: How much farther the next language has to be, as a share of the nearest one's distance.
MARGIN = 0.02


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), " "), "")


def _joined(chars: Column, n: int):
    return lambda i: F.concat(*[chars[i + k] for k in range(n)])


def grams(word: Column) -> Column:
    """All runs of 1..LONGEST characters of a word between blanks, but for the blanks alone."""

    def runs(c: Column) -> Column:
        parts = [F.slice(c, F.lit(2), F.size(c) - 2)]
        for n in range(2, LONGEST + 1):
            parts.append(F.transform(F.sequence(F.lit(0), F.size(c) - n), _joined(c, n)))
        return F.concat(*parts)

    # Characters as an array: places in a long string are found by walking through it.
    return let(F.concat(F.array(F.lit(" ")), F.split(word, ""), F.array(F.lit(" "))), runs)


def counts(texts: DataFrame, by: str, text_column: str) -> DataFrame:
    """(by, gram, n): words are counted first, so that each distinct word of a key is cut up once."""
    rows = texts.select(by, F.explode(words(F.col(text_column))).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    return rows.select(by, "n", F.explode(grams(F.col("word"))).alias("gram")).groupBy(by, "gram").agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame, by: str, places: int) -> DataFrame:
    """(by, gram, place): the most frequent n-grams of each key; tasks keep so many of a key before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= places).select(by, "gram", "place")


def profiles(labelled: DataFrame, places: int = PLACES) -> DataFrame:
    """(lang, gram, place) from texts with a language. Input: lang, text. Counts add up map-side."""
    return _ranked(counts(labelled.where("lang IS NOT NULL"), "lang", "text"), "lang", places)


def _key(gram: str) -> int:
    """An n-gram as one number, 21 bits a character; numbers are in the order of the n-grams."""
    codes = [ord(c) for c in gram] + [0] * LONGEST
    return codes[0] << 42 | codes[1] << 21 | codes[2]


def _most_frequent(text: str, places: int) -> np.ndarray:
    """Keys of the most frequent n-grams of words between single blanks, in the order of their places."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    one = c[1:-1][c[1:-1] != 32] << 42
    two = c[:-1] << 42 | c[1:] << 21
    # A run of three with a blank inside belongs to two words.
    three = (two[:-1] | c[2:])[c[1:-1] != 32]
    keys, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
    return keys[np.argsort(-n, kind="stable")[:places]]


def distances(texts: DataFrame, known: DataFrame, id_column: str, text_column: str, places: int = PLACES) -> DataFrame:
    """(id, lang, distance) of each text of LEAST_CHARS characters to each language: mean displacement, 0 to 1.

    An n-gram that the language's profile lacks counts as far as can be. Texts of one id are brought together, then
    n-grams are counted and placed inside the row, one text at a time: only texts are shuffled, and no task sorts or
    keeps more n-grams than those of one text. `known` holds `places` rows for each language and goes to every task.
    """
    profile: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, place in known.select("lang", "gram", "place").collect():  # `places` rows a language
        profile.setdefault(lang, []).append((_key(gram), place))
    by_lang = {lang: np.array(sorted(rows), np.int64).T for lang, rows in profile.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, langs, far = [], [], []
            for i, text in enumerate(batch["words"].to_pylist()):
                if not text:
                    continue
                own = _most_frequent(text, places)
                for lang, (keys, place) in by_lang.items():
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    met = np.flatnonzero(keys[at] == own)
                    if len(met):
                        nearness = int((places - np.abs(met + 1 - place[at[met]])).sum())
                        rows.append(i)
                        langs.append(lang)
                        far.append(1 - nearness / (len(own) * places))
            ids = batch[id_column].take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(far, pa.float64())], names=[id_column, "lang", "distance"])

    long = texts.where(F.length(text_column) >= LEAST_CHARS)
    own = long.groupBy(id_column).agg(F.collect_list(text_column).alias("texts"))
    spaced = F.array_join(F.flatten(F.transform("texts", words)), " ")
    kind = own.schema[id_column].dataType.simpleString()
    return own.select(id_column, spaced.alias("words")).mapInArrow(compare, f"`{id_column}` {kind}, lang string, distance double")


def detect(texts: DataFrame, known: DataFrame, id_column: str, text_column: str, farthest: float = FARTHEST, margin: float = MARGIN) -> DataFrame:
    """(id, lang, distance) for every text; `lang` is NULL for short texts, unknown languages and close calls.

    A language without a common n-gram is as far as can be.
    """
    far = distances(texts, known, id_column, text_column)
    by_distance = Window.partitionBy(id_column).orderBy("distance", "lang")
    judged = far.withColumn("next", F.coalesce(F.lead("distance").over(by_distance), F.lit(1.0))).withColumn("rank", F.row_number().over(by_distance))
    sure = (F.col("distance") <= farthest) & (F.col("next") > F.col("distance") * (1 + margin))
    found = judged.where("rank = 1").select(id_column, F.when(sure, F.col("lang")).alias("lang"), "distance")
    return texts.select(id_column).join(found, id_column, "left")
