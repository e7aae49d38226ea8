"""Line dedup against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup


def brute(rows):
    lines = [(d, i, frozenset(w for w in re.split("[ \t\x0b\f\r]+", x) if w)) for d, t, *_ in rows if t is not None and d is not None for i, x in enumerate(t.split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    gone = {}
    for k, (d, i, s) in enumerate(lines):
        if any(x[:2] < (d, i) and 100 * len(s & x[2]) >= 75 * len(s | x[2]) for x in lines[:k]):
            gone.setdefault(d, set()).add(i)
    return {d: (0 if t is None else len(t.split("\n")), len(gone.get(d, ())), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))) for d, t, *_ in rows}


def make(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(90)}é"
    pool = [[word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40]))] for _ in range(40)]
    rows = []
    for d in range(80):
        out = []
        for _ in range(rng.randrange(0, 8)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            out.append(rng.choice([" ", "\t", "  "]).join(w) + rng.choice(["", "", "\r", " "]))
        rows.append((d * 2, "\n".join(out), f"x{d}", d))
    return rows + [(500, None, "n", 0), (501, "", "e", 0), (502, "\n\n", "b", 0), (503, "one two three four five\nfive four three two one", "o", 0), (None, "one two three four five", "z", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = make(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string, n long")
    out = line_dedup.remove_lines(docs)
    assert out.columns == ["doc_id", "text", "h1", "n", "n_lines", "n_removed"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()}
    assert got == brute(rows)
    assert sum(x[1] for x in got.values()) > 50


def test_repeated_rows_empty_table_and_native_plan(spark):
    line = "alpha beta gamma delta epsilon"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line + "\nshort\n" + line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.text) for r in line_dedup.remove_lines(docs).collect()) == [(1, 0, line), (1, 0, line), (2, 2, "short")]
    assert line_dedup.remove_lines(docs.limit(0)).count() == 0
    plan = line_dedup.remove_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_long_line(spark):
    words = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[3:])), (3, " ".join(words[9_000:]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.remove_lines(docs).collect()} == {1: 0, 2: 1, 3: 0}


def test_different_texts_under_one_id(spark):
    a, b = "one two three four five six", "something else altogether stands in here"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b + "\n" + a), (None, a)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed, r.text) for r in line_dedup.remove_lines(docs).collect()), key=repr)
    assert got == sorted([(1, 0, a), (2, 1, ""), (2, 0, b), (2, 1, b), (None, 0, a)], key=repr)


def test_frequent_ids_are_dealt_to_groups(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_BITS", 2)
    rows = make(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string, h1 string, n long")).collect()}
    assert got == brute(rows)


def test_text_of_very_many_lines(spark):
    lines = [f"line number {i} of a long text with {i * 7919} in it" for i in range(60_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:-1] + ["the last one is new"]))], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.text) for r in line_dedup.remove_lines(docs).collect()}[2] == (59_999, "the last one is new")


def test_rarity_classes_are_short_in_plans(spark, monkeypatch):
    """The driver keeps the text of each plan, which spells the constant out: a few characters a bucket."""
    monkeypatch.setattr(line_dedup, "BUCKETS", 256)
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5000)))], "doc_id long, text string")
    plan = docs.select(line_dedup.word_ids("text", line_dedup.rarity_classes(docs)))._jdf.queryExecution().optimizedPlan().toString()
    assert 256 < len(plan) < 256 * 16  # 2,277 characters; with whole upper id bits it was 10,411


@pytest.mark.parametrize("far", [False, True])
@pytest.mark.parametrize("texts", [1, 2])
def test_classes_are_numbered_by_place(spark, far, texts):
    """Ids that leave no room for line numbers, and ids with two texts each, take the numbering by sorting."""
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 4, 9]))) for _ in range(60)]
    rows = [((d - 15) * (1 << 57 if far else 1), "\n".join(rng.sample(lines, 3)) + f"\n{d} {k}") for d in range(30) for k in range(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.text) for r in line_dedup.remove_lines(docs).collect())
    if texts == 1:
        assert got == sorted((d, n, t) for d, (_, n, t) in brute(rows).items())
    else:
        places = sorted((d, i, frozenset(x.split())) for d, t in rows for i, x in enumerate(t.split("\n")))
        late = lambda d, i, x: any(p[:2] < (d, i) and 100 * len(p[2] & set(x.split())) >= 75 * len(p[2] | set(x.split())) for p in places)
        kept = [(d, [x for i, x in enumerate(t.split("\n")) if not late(d, i, x)]) for d, t in rows]
        assert got == sorted((d, 4 - len(x), "\n".join(x)) for d, x in kept)


def test_join_of_open_classes_takes_fewer_rows(spark):
    """A pair needs an entry of the shorter prefix of its smaller set; before, each of the two gave its whole prefix, one of them once for each size band."""
    rng = random.Random(6)
    rows = [(k, n, 0, 0, sorted(rng.sample(range(10**6), n - (75 * n + 99) // 100 + 1)), None) for k, n in enumerate(rng.choices(range(3, 120), k=300))]
    entries = spark.createDataFrame(rows, "key long, n int, s1 long, s2 long, prefix array<long>, settled boolean").selectExpr("settled", "key", "n", "s1", "s2", "posexplode(prefix) as (pos, id)")
    smaller, larger = line_dedup._by_band(entries, 75)
    assert larger.count() == entries.count()
    assert smaller.count() < entries.count()


def test_settled_classes_of_a_hot_id_do_not_meet(spark):
    hot = line_dedup.HOT << line_dedup.LOW_BITS
    rows = [(settled, k, 20, 0, 0, 0, i) for k, (settled, i) in enumerate([(True, hot), (None, hot), (True, 5), (None, 5)] * 2)]
    smaller, larger = line_dedup._by_band(spark.createDataFrame(rows, "settled boolean, key long, n int, s1 long, s2 long, pos int, id long"), 75)
    met = smaller.alias("x").join(larger.alias("y"), ["id", "band"]).selectExpr("x.settled and y.settled as both", f"id = {hot} as hot", "x.key as x", "y.key as y").where("x <> y").collect()
    assert not [r for r in met if r.hot and r.both]
    pairs = {(r.x, r.y) for r in met}
    assert all((a, b) in pairs for a in range(8) for b in range(8) if a != b and rows[a][6] == rows[b][6] and not (rows[a][0] and rows[b][0]))


def test_texts_are_split_once_and_classes_found_without_sorting(spark, monkeypatch):
    """Before, filters that the optimizer made for the lines split each text twice more, and the classes were found by sort aggregates."""
    plans, write = {}, line_dedup.shared_table
    def noted(df, tag, **more):
        plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag, **more)
    monkeypatch.setattr(line_dedup, "shared_table", noted)
    rows = make(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string, n long")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_lines(docs).collect()}
    assert got == brute(rows)
    assert plans["line-sets"].count("split(") == 2  # texts into lines, lines into words
    assert "SortAggregate" not in plans["line-classes"] and "HashAggregate" in plans["line-classes"]


def test_null_text_under_the_id_of_another(spark):
    a, b = "one two three four five six seven eight", "one two three four five six seven nine"
    docs = spark.createDataFrame([(1, None), (1, a), (1, None), (2, None), (2, b), (2, b)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_lines(docs).collect()), key=repr)
    assert got == sorted([(1, 0, 0, None), (1, 1, 0, a), (1, 0, 0, None), (2, 0, 0, None), (2, 1, 1, ""), (2, 1, 1, "")], key=repr)


def test_words_of_all_documents_are_counted(spark, monkeypatch):
    """Before, one document of 32 gave the counts: words frequent elsewhere passed for rare and their entries were not dealt to groups."""
    monkeypatch.setattr(line_dedup, "BUCKETS", 1 << 12)
    rows = [(d, f"everywhere  in{d}\n\neverywhere\t" + "often " * d) for d in range(64)] + [(None, "everywhere"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = [w for d, t in rows if d is not None and t for w in t.split()]
    asked = spark.createDataFrame([(w,) for w in sorted(set(words))], "w string")
    bucket = F.xxhash64("w").bitwiseAND(F.lit(line_dedup.BUCKETS - 1)).cast("int")
    got = asked.select("w", bucket.alias("b"), F.get(line_dedup.rarity_classes(docs), bucket).alias("rarity")).collect()
    of, counts = {r.w: r.b for r in got}, Counter()
    for w in words:
        counts[of[w]] += 1
    assert {r.w: r.rarity for r in got} == {w: int(3 * math.log2(counts[b] + 1)) for w, b in of.items()}


def test_size_bands_are_wide_and_leave_out_no_partner(spark):
    """Before, bands of a third gave an entry of a smaller set 1.5 rows on average; now 1.3. All sizes that can match still meet."""
    rows = [(n, n, 0, 0, list(range(n - (75 * n + 99) // 100 + 1)), None) for n in range(3, 250)]
    entries = spark.createDataFrame(rows, "key long, n int, s1 long, s2 long, prefix array<long>, settled boolean").selectExpr("settled", "key", "n", "s1", "s2", "posexplode(prefix) as (pos, id)")
    smaller, larger = line_dedup._by_band(entries, 75)
    assert smaller.count() < 1.4 * smaller.select("key", "pos").distinct().count()
    met = {(r.n, r.pos, r.m) for r in smaller.alias("x").join(larger.where("pos = 0").alias("y"), F.expr("x.band = y.band")).selectExpr("x.n", "x.pos", "y.n as m").collect()}
    need = lambda n, m: -(-75 * (n + m) // 175)
    assert all((n, pos, m) in met for n in range(3, 250) for m in range(n, 250) if 75 * m <= 100 * n for pos in range(n) if n - pos >= need(n, m))


def test_each_id_is_sketched_once(spark):
    """Before, both longs of a sketch took all ids, one of them to leave the odd ones out."""
    rng = random.Random(8)
    bound = 20 << line_dedup.LOW_BITS
    every = sorted({rng.randrange(40) << line_dedup.LOW_BITS | rng.randrange(1 << 50) for _ in range(200)} | {bound})
    sets = [sorted(rng.sample(every, rng.choice([0, 1, 5, 40, 150]))) for _ in range(40)] + [[bound], every, [x for x in every if x < bound]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(sets)], "k int, ids array<bigint>").select("*", line_dedup.below("ids", bound).alias("rarer"))
    got = {r.k: r for r in df.select("*", *line_dedup.parity("ids", "rarer")).collect()}
    assert all(got[k].rarer == sum(i < bound for i in x) for k, x in enumerate(sets))
    ones = lambda x: bin(x & (1 << 64) - 1).count("1")
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            differ = set(x) ^ set(y)
            assert ones(got[a].s1 ^ got[b].s1) <= sum(i < bound for i in differ) and ones(got[a].s2 ^ got[b].s2) <= sum(i >= bound for i in differ)
    assert ones(got[len(sets) - 2].s1) and ones(got[len(sets) - 2].s2)


def test_words_are_counted_in_the_fast_map(spark, monkeypatch):
    """Before, an aggregate's fast map held half of the buckets, and the setting is as it was afterwards."""
    seen, frame = [], type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: seen.append(spark.conf.get(line_dedup.FAST_MAP)) or collect(df))
    before = spark.conf.get(line_dedup.FAST_MAP)
    line_dedup.rarity(spark.createDataFrame([(1, "one two\nthree")], "doc_id long, text string"))
    assert [1 << int(bits) > line_dedup.BUCKETS for bits in seen] == [True]
    assert spark.conf.get(line_dedup.FAST_MAP) == before
