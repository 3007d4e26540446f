"""Language identification in two steps: the family first, then one-versus-one linear support vector machines.

A text is the average of the hashed character n-grams of its words. Both steps vote with linear machines for each
pair of classes (families, or languages of one family), trained with the squared hinge loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, words_of
from .subwords import Features, remainder, share

#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "pl cs sk ru uk be bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz",
    "indic": "hi bn pa gu mr ne ur",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
FEATURES = Features(own=0, grams=4096, sizes=range(1, 4))
#: Rows to learn from, per language: chosen by their id's hash, so that about so many are read.
LEARN_ROWS = 800
UNKNOWN = "und"


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the bias) that separate y = 1 from y = -1: squared hinge loss, accelerated gradient."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = v = np.zeros(x.shape[1] + 1)
    step = 0.5 / (penalty + (weight * (np.einsum("ij,ij->i", x, x) + 1)).sum())
    for k in range(rounds):
        # products stay in the type of `x`, which a wider vector would copy
        slack = np.maximum(0, 1 - y * (x @ v[:-1].astype(x.dtype) + v[-1]))
        pull = weight * slack * y
        new = v - step * (penalty * v - 2 * np.append(pull.astype(x.dtype) @ x, pull.sum()))
        v, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Model:
    """`table` has a column and `bias` a number for each pair of classes in `pairs`."""

    classes: list[str]
    pairs: list[tuple[str, str]]
    table: np.ndarray
    bias: np.ndarray

    def predict(self, words) -> tuple[list[str], np.ndarray]:
        margins = FEATURES.projected(words, self.table) + self.bias
        column = {pair: k for k, pair in enumerate(self.pairs)}

        def vote(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """The winner of each text among `names`, and how sure its closest duel is."""
            if len(names) == 1:
                return np.zeros(len(margins), int), np.ones(len(margins))
            wins, least = np.zeros((len(margins), len(names))), np.full((len(margins), len(names)), np.inf)
            for i, j in combinations(range(len(names)), 2):
                m = margins[:, column[names[i], names[j]]]
                wins[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
                wins[:, j] += (m < 0) - 1e-3 * np.tanh(m)
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
            best = wins.argmax(1)
            return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(best)), best], -20, 20)))

        groups: dict[str, list[str]] = {}
        for c in self.classes:
            groups.setdefault(FAMILY.get(c, c), []).append(c)
        families = sorted(groups)
        family, sure = vote(families)
        out = np.empty(len(margins), object)
        for k, name in enumerate(families):
            best, part = vote(groups[name])
            here = family == k
            out[here] = np.array(groups[name], object)[best[here]]
            sure[here] *= part[here]
        return out.tolist(), sure


def learn(docs: DataFrame, rows: int = LEARN_ROWS) -> Model:
    """A model from the texts and non-null languages of `docs`, of which about `rows` per language are read."""
    counts = {lang: n for lang, n in docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").count().collect()}
    if not counts:
        return Model([], [], np.zeros((FEATURES.width, 0)), np.zeros(0))
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, rows / n)])
    chosen = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(share(F.col("doc_id")) < bound[F.col("lang")])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                few = batch.slice(k, 256)
                found = FEATURES.vectors(words_of(few["text"]))
                yield pa.RecordBatch.from_arrays(
                    [few["lang"], few["doc_id"], pa.array([v.tobytes() for v in found], pa.binary())], names=["lang", "doc_id", "v"]
                )

    read = chosen.select("lang", "doc_id", "text").mapInArrow(vectors, "lang string, doc_id long, v binary").toArrow()
    read = read.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    lang = np.array(read["lang"].to_pylist(), object)
    x = np.empty((len(lang), FEATURES.width), np.float32)
    for i, v in enumerate(read["v"]):
        x[i] = np.frombuffer(v.as_buffer(), np.float32)
    del read
    full = x.any(1)
    if not full.all():
        x, lang = x[full], lang[full]
    scale = (1 / ((x.std(0) + 1e-4) * np.float32(FEATURES.width**0.5))).astype(np.float32)
    x *= scale
    classes = sorted(set(lang))
    family = np.array([FAMILY.get(c, c) for c in lang], object)
    duels = [(family, a, b) for a, b in combinations(sorted(set(family)), 2)]
    for name in sorted(set(family)):
        duels += [(lang, a, b) for a, b in combinations(sorted(set(lang[family == name])), 2)]
    table, bias = np.zeros((FEATURES.width, len(duels))), np.zeros(len(duels))
    for k, (label, a, b) in enumerate(duels):
        here = (label == a) | (label == b)
        w = machine(x[here], np.where(label[here] == a, 1.0, -1.0))
        table[:, k], bias[k] = w[:-1] * scale, w[-1]
    return Model(classes, [(a, b) for _, a, b in duels], table, bias)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1) for each row; columns of these names are replaced.

    A text that is null or has no letter is `und` with score 0, as is every text where nothing could be learned.
    Whole texts are read. Rows are scored one by one: repeated rows get equal results, no rows give no rows.
    """

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                texts = pc.fill_null(part["text"].cast(pa.string()), "")
                letter = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                if model.classes:
                    found, score = model.predict(words_of(texts))
                else:
                    found, score = [UNKNOWN] * len(part), np.zeros(len(part))
                found = [f if x else UNKNOWN for f, x in zip(found, letter, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[part[c] for c in own], pa.array(found, pa.string()), pa.array(np.where(letter, score, 0.0))],
                    names=[*own, "lang_pred", "score"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(own).schema)
    return docs.select(own).mapInArrow(predict, f"{fields}, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = learn(docs.where(remainder(F.col("doc_id"), 3) != 1))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
