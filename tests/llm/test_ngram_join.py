"""The parity-sketch join against brute force."""

import random

import numpy as np
import pytest

from millrace.llm import ngram_join
from millrace.llm.components import connected_components


def test_pairs_at_the_threshold_share_a_piece():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        a = int(rng.choice([rng.integers(1, 12), rng.integers(1, 120), rng.integers(1, 1500)]))
        b = int(rng.integers(a, max(a, 4 * a // 3) + 1))
        # the smallest intersection that still links
        both = -(-75 * (a + b) // 175)
        if both > a:
            continue
        x = rng.integers(0, 2**63, a + b - both).astype(np.uint64)
        u, v = np.sort(x[:a]), np.sort(x[a - both :])
        assert len(v) == b
        assert np.isin(ngram_join.piece_keys(u, 75), ngram_join.piece_keys(v, 75)).any(), (a, b)


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, m, c = rng.integers(1, 300, 3)
        x = np.sort(rng.integers(0, 2**63, n + m + c).astype(np.uint64))
        rng.shuffle(x)
        u, v = np.sort(x[: n + c]), np.sort(x[n:])
        s, t = (np.frombuffer(ngram_join.parity_sketch(y), np.uint8)[None] for y in (u, v))
        z = min(s.shape[1], t.shape[1])
        assert np.bitwise_count(ngram_join.fold(s, z) ^ ngram_join.fold(t, z)).sum() <= n + m


def brute(rows):
    sets = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in b).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d) if d is not None else None) for d, s in sets.items()}


def make(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([3, 5, 7, 12, 40, 90, 300]))] for _ in range(14)]
    rows = []
    for i in range(220):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if w:
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
        if rng.random() < 0.3:
            w = w[: len(w) * 9 // 10] + (passage if rng.random() < 0.5 else [])
        rows.append((i, " ".join(w).upper() if rng.random() < 0.1 else "  ".join(w), 0, ""))
    return rows + [(900, None, 1, None), (901, "", 1, ""), (902, " \n", 1, ""), (903, "One", 1, ""), (904, "one ", 1, ""), (None, rows[0][1], 1, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(ngram_join, "SIDE", 3)  # pieces are compared block by block
    rows = make(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < 150
    kept = sorted(r.doc_id for r in ngram_join.keep_first(docs).where("doc_id is not null").collect())
    assert kept == sorted({c for d, (_, c) in want.items() if d is not None})


def test_repeated_rows_long_texts_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(5, long), (5, long), (3, long + " end"), (9, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect()) == [(3, 3), (5, 3), (5, 3), (9, 9)]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(40))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(39)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == dict.fromkeys(range(40), 0) | {100: 100, 101: 100}


def test_a_pair_is_given_under_one_of_its_pieces(spark):
    """Three near sets in different components share hundreds of pieces, which lie in all tasks."""
    sketch = ngram_join.parity_sketch(np.arange(1000, dtype=np.uint64))

    def pairs(members):
        rows = [(p, 10 * n, 10 * n, 1, 1000, sketch, list(pieces)[:16]) for n, pieces in members for p in pieces]
        return ngram_join.cross_pairs(spark.createDataFrame(rows, "piece long, node long, label long, blocks int, n_shingles long, sketch binary, firsts array<long>"), 75, 16)

    def given(node):  # rows that came out of the comparison itself
        if node.nodeName() == "AdaptiveSparkPlan":
            return given(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return given(node.plan())
        if node.nodeName() == "MapInArrow":
            return node.metrics().apply("pythonNumRowsReceived").value()
        return sum(given(node.children().apply(k)) for k in range(node.children().size()))

    got = pairs([(1, range(400)), (2, range(400)), (3, range(0, 400, 2))])
    assert sorted(tuple(r) for r in got.collect()) == [(10, 20), (10, 30), (20, 30)]
    assert given(got._jdf.queryExecution().executedPlan()) == 3
    # sets that share none of their first pieces are given all the same
    assert sorted(tuple(r) for r in pairs([(1, range(400)), (2, range(300, 700))]).collect()) == [(10, 20)]
