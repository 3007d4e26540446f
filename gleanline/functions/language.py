"""Language of a text by its most frequent function words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Frequent function words per language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are this be by at from or an which not",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "le la les de des et un une du en que qui dans pour pas sur au par plus est avec ce il",
    "es": "el la los las de que y en un una por con para no se del su al lo como más es o pero",
    "it": "il di che la per una del non con si da come le dei nel alla più anche ma sono gli lo ed",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als bij maar naar uit",
    "pt": "o de que e do da em um para com não uma os no se na por mais as dos como mas ao ele das",
}


def _best(words: Column) -> Column:
    """(hits, code) of the language whose words occur most often."""
    scores = []
    for code, vocabulary in FUNCTION_WORDS.items():
        members = vocabulary.split()
        scores.append(F.struct(_hits(words, members).alias("hits"), F.lit(code).alias("code")))
    return F.array_max(F.array(*scores))


def _hits(words: Column, members: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(members)))


def detect(text: Column, chars: int | None = None) -> Column:
    """Best-scoring language of the text, or of its first `chars`; NULL under 40 characters or no hit."""
    words = F.split(F.lower(text if chars is None else F.substring(text, 1, chars)), r"[^\p{L}]+")
    every = sorted({w for vocabulary in FUNCTION_WORDS.values() for w in vocabulary.split()})
    best = let(F.filter(words, lambda w: w.isin(every)), _best)
    return F.when((F.length(text) >= 40) & (best["hits"] > 0), best["code"])
