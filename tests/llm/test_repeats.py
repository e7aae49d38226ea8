"""Substring and suffix-array de-duplication against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, s long, spans string"


def make(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cd", "é", "the", "of", "qqq", "zz", "x"]) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.choice([9, 14, 30, 60]))] for _ in range(5)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(0, 50))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = rng.choice(passages)
        if rng.random() < 0.15:
            words += ["is", "onhe."] * rng.randrange(5, 60)
        if rng.random() < 0.15 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "").split()
            if words and rng.random() < 0.6:
                words[rng.randrange(len(words))] = "edit"
        rows.append((i * 3, rng.choice([" ", "  ", "\n", "\t "]).join(words), i, "x"))
    return rows + [(1000, None, 0, None), (1001, "", 0, ""), (1002, "a" * 700, 0, ""), (1003, "b" * 90 + "a" * 300, 0, ""), (None, "lost id " * 40, 0, "")]


def brute_words(rows, length):
    split = {d: (t or "").encode().split() for d, t, *_ in rows}
    least = {}
    for d, w in split.items():
        if d is not None:
            for i in range(len(w) - length + 1):
                k = tuple(w[i : i + length])
                least[k] = min(least.get(k, d), d)
    out = {}
    for d, w in split.items():
        gone = set()
        if d is not None:
            for i in range(len(w) - length + 1):
                if least[tuple(w[i : i + length])] < d:
                    gone.update(range(i, i + length))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def brute_bytes(rows, length):
    seen = Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        if d is not None:
            seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = defaultdict(list)
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if seen[b[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d].append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("seed, max_group", [(1, 20_000), (2, 20_000), (3, 2)])
def test_substring_dedup_equals_brute_force(spark, seed, max_group):
    rows = make(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), 12, max_group).collect()}
    assert got == brute_words(rows, 12)
    assert sum(x[1] for x in got.values()) > 100


@pytest.mark.parametrize("seed, max_group", [(1, 20_000), (2, 20_000), (3, 2)])
def test_suffix_dedup_equals_brute_force(spark, seed, max_group):
    rows = make(seed)
    want = brute_bytes(rows, 50)
    got = defaultdict(list)
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), 50, max_group).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    assert got == want
    assert sum(y[1] for x in got.values() for y in x) > 1000


def test_repeated_rows_and_reused_ids(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text, 0, ""), (1, text, 0, ""), (2, "other " + text, 0, ""), (2, "short", 0, "")], SCHEMA)
    words = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, 50).collect())
    assert words == [(1, 100, 0), (1, 100, 0), (2, 1, 0), (2, 101, 100)]
    removed = sorted((r.doc_id, r.n_removed, r.n_bytes) for r in suffix_dedup.remove_repeats(docs, 200).collect())
    n = len(text)
    assert removed == [(1, n, n), (1, n, n), (2, 0, 5), (2, n, n + 6)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0


def test_long_text_and_whole_table_counts(spark):
    base = " ".join(f"w{i % 977}q{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, base, 0, ""), (2, "head " + base + " tail", 0, "")], SCHEMA)
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 30_000}
    assert suffix_dedup.remove_repeats(docs).agg(F.sum("n_spans")).first()[0] == 2


def test_different_texts_under_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = spark.createDataFrame([(1, a, 0, ""), (2, a, 0, ""), (2, b, 0, ""), (2, b + " " + a, 0, "")], SCHEMA)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(1, 100, 0), (2, 100, 0), (2, 100, 100), (2, 200, 100)]
    docs = spark.createDataFrame([(1, a, 0, ""), (2, a, 0, ""), (2, b, 0, "")], SCHEMA)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted([(1, len(a), len(a)), (2, len(b), 0), (2, len(a), len(a))])
