"""Ranked search, token counts and periodic runs against brute force on small tables with the awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from gleanline.llm import hybrid_rank, periodic_runs, token_counts
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, n long, codes string, runs string, score string, rank string, n_words string, words string, p string"
ITEMS = "item_id long, text string, doc_id string, score string"
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema, extra):
    """With columns beside the needed ones whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(1, 60)))) for i in range(150)]
    out += [(200, None), (201, ""), (202, " \n\t\x0b"), (203, "One"), (204, "one ONE, one-two"), (205, "--- !!"), (206, "w1 " * 3000), (207, "x" * 30_000)]
    out += [(208, "Éa éa ÉA \x00 \x7f w1\x00w2"), (209, "don't <|endoftext|> ΑΣ İx ﬁ 한국 12 34 \U0001f916!!"), (210, out[0][1]), (211, out[0][1])]
    out += [(300, "two words"), (300, "two words"), (300, "other w5"), (None, "two words"), (None, None), (-4, "w3 w3")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows, SCHEMA, (7, *"cdefghi")).repartition(3)


# ranked search


def terms(text):
    return re.findall(TERM, (text or "").translate(LOW))


def brute_rank(rows, items, top):
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n, total = len(docs), sum(x for _, _, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted: dict = {}
    for item, text in items:
        if text is not None:
            wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for d, c, size in docs:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    out = [(i, " ".join(f"W{rng.randrange(60)}" for _ in range(rng.randint(1, 40)))) for i in range(25)]
    return out + [(100, None), (101, ""), (102, "unheard of"), (103, "two words"), (103, "one"), (None, "w1 w1 éa"), (104, "w1"), (105, "w1")]


@pytest.mark.parametrize("top", [1, 50])
def test_ranking_equals_full_scoring(spark, docs, rows, items, top):
    got = hybrid_rank.ranked(docs, frame(spark, items, ITEMS, "xy"), top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_rank(rows, items, top), key=key)


def test_items_in_several_blocks(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(hybrid_rank, "BLOCK_BYTES", 900)
    got = hybrid_rank.ranked(docs, frame(spark, items, ITEMS, "xy"), 5)
    assert set(map(tuple, got.collect())) == set(brute_rank(rows, items, 5))


def test_ranking_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert hybrid_rank.ranked(docs, none).collect() == []
    assert hybrid_rank.ranked(docs.limit(0), spark.createDataFrame([(1, "w1")], "item_id long, text string")).collect() == []


def test_long_lists_are_skipped():
    """Documents that hold common terms only are not scored once fifty better ones are known."""
    rng = np.random.default_rng(1)
    documents = 40_000
    common = np.arange(documents)
    rare = rng.choice(documents, 900, replace=False)
    row, code = np.concatenate([common, rare]), np.repeat([0, 1], [documents, 900])
    worth = np.where(code == 0, rng.integers(1, 50, len(row)), rng.integers(5_000, 9_000, len(row)))
    lists = hybrid_rank.Postings(code, row, worth, 3, documents)
    best = hybrid_rank.Best(50)
    scored = hybrid_rank.search(lists, np.array([0, 1, 2]), np.arange(documents), best)
    total = np.bincount(row, worth).astype(np.int64)
    order = np.lexsort((np.arange(documents), -total))[:50]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == total[order].tolist()
    assert scored <= 900


def test_equal_scores_keep_the_smaller_ids():
    lists = hybrid_rank.Postings(np.zeros(9000, int), np.arange(9000), np.full(9000, 7), 1, 9000)
    best = hybrid_rank.Best(50)
    hybrid_rank.search(lists, np.array([0]), np.arange(9000)[::-1].copy(), best)
    assert best.ids.tolist() == list(range(50))


def test_terms_of_a_slice():
    texts = pa.array(["A-b", None, "C\x7fd Éé", "", "e"]).slice(1, 3)
    words = hybrid_rank.terms_of(texts)
    got = [words.values.take(pa.array(words.codes[a:b])).to_pylist() for a, b in zip(words.starts, words.starts[1:], strict=False)]
    assert got == [[], ["c", "d", "Éé"], []]


# token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.default_vocabulary())


@pytest.fixture(scope="module")
def counter():
    path = token_counts.default_vocabulary()
    return token_counts.Counter(path, token_counts.whole_tokens(path))


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(docs, rows, library):
    got = token_counts.token_counts(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((t or "").encode()), n, n > 2048) for (d, t), n in zip(rows, lengths(library, [t or "" for _, t in rows]), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_counts_of_no_rows(docs):
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def test_every_assigned_character(counter, library):
    chars = [chr(i) for i in range(0x30000) if unicodedata.category(chr(i)) not in ("Cs", "Cn")]
    texts = [f"a{c}b {c}" for c in chars]
    assert counter(pa.array(texts)).tolist() == lengths(library, texts)


def test_random_mixtures(counter, library):
    rng = random.Random(2)
    bits = ["a", "A", "é", "é", "Σ", "'s", "'VE", "'", "don't", " ", "\n", "\xa0", " ", "<|endoftext|>", "<|", "|>", "<|StartOfText|>", "12", "!!!", "ing", "tion", "the", "İ", "ᄒ", "ᅡ", "\U0001f600", "\x00", "\x1c", "\x85"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert counter(pa.array(texts)).tolist() == lengths(library, texts)


def test_long_words_by_heap_and_by_rounds(counter, library):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (63, 64, 65, 300, 5000)] + ["aaa" * 100, "!" * 5000, "theing" * 30, "x" * 40_000]
    assert counter(pa.array(words)).tolist() == lengths(library, words)


def test_proved_words_are_single_tokens(counter, library):
    """What counts one is one token for the library too, as far as the text of a word comes out of its splits whole."""
    whole = sorted(w for w in counter.whole if w.strip() and counter.split.findall(counter.normal(w)) == [w])
    assert len(whole) > 30_000 and set(lengths(library, whole)) == {1}


def test_only_the_rest_is_merged(counter):
    before = counter.merged
    counter(pa.array(["the house is on the hill " * 50]))
    assert counter.merged == before


# periodic runs


def brute_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_cover_holds_every_difference():
    assert {(a - b) % periodic_runs.PERIOD for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.PERIOD))


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_extensions_equal_word_by_word(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(0, letters, 700)
    text[300:500] = text[100:300]
    codes = np.append(text, letters)
    a, b = rng.integers(0, 700, (2, 3000))
    a, b = a[a != b], b[a != b]
    got = periodic_runs.Extensions(codes)(a, b)
    for i, j, n in zip(a, b, got, strict=True):
        most = min(len(codes) - i, len(codes) - j)
        differ = np.flatnonzero(codes[i : i + most] != codes[j : j + most])
        assert n == (differ[0] if len(differ) else most)


def test_runs_equal_brute_force(spark):
    rng, texts = random.Random(1), []
    for _ in range(300):
        k, n = rng.choice([1, 2, 3, 5, 50]), rng.randint(0, rng.choice([13, 40, 300]))
        words = [f"w{rng.randrange(k)}" for _ in range(n)]
        if rng.random() < 0.5 and n > 20:
            p, a = rng.randint(1, n // 2), rng.randrange(n)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        texts.append(" ".join(words))
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        runs = brute_runs(text.split())
        assert [tuple(r) for r in found[i].runs] == runs and found[i].collapsed == collapsed(text.split(), runs)


def want_runs(doc_id, text):
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words) if n < 3000 else [(0, n, 1)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, n, len(runs), *shown, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs)))


def test_query_equals_brute_force(docs, rows):
    got = periodic_runs.runs_query(docs)
    assert got.columns == ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3], r[-1])
    want = [want_runs(*r) for r in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[2] > 0 for w in want) > 5


def test_runs_of_no_rows(docs):
    assert periodic_runs.runs_query(docs.limit(0)).collect() == []


def test_long_texts():
    """Half a million words, once all equal and once without a run."""
    words = np.random.default_rng(4).integers(0, 5000, 400_000)
    batch = periodic_runs._batch(pa.array([1, 2]), pa.array(["la " * 100_000, " ".join(map(str, words))]))
    first, second = batch["runs"].to_pylist()
    assert first == [{"start": 0, "length": 100_000, "period": 1}] and second == []
    assert batch["collapsed"][0].as_py() == "la" and hashlib.sha1(batch["collapsed"][1].as_py().encode()).digest() == hashlib.sha1(" ".join(map(str, words)).encode()).digest()
