"""The pipeline stage by stage against independent brute force, and packing, decontamination and rules alone."""

import zlib

import numpy as np
import pytest
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_components

import corpus_pipeline
from millrace.llm import decontamination, packing, quality_classifier, queries, rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words_of(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in b).split()


def brute_hits(docs, items, window=13):
    wins = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


ITEMS = [(7, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (10, "Short, item!"), (9, "a a a a a a a a a a a a a a a"), (3, None), (4, ""), (5, "uno"), (11, "short item")]
TEXTS = ["x one two three four five six seven eight nine ten eleven twelve thirteen y", "SHORT item short ITEM", "a " * 40, None, "", "uno", "one two three " * 30, "z " * 300 + "short item", "ÀÉ one"]


@pytest.mark.parametrize("block_words", [2_000_000, 3])
def test_decontamination_equals_brute_force(spark, block_words):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame([(*d, "w") for d in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontamination.decontamination_report(frame, bench, block_words=block_words).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out} == brute_hits(docs, ITEMS)
    assert {r.doc_id for r in out if r.contaminated} == {d for d, (n, h, _) in brute_hits(docs, ITEMS).items() if h and 20 * h >= n}
    assert decontamination.decontamination_report(frame, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontamination_report(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_words", [2_000_000, 3])
def test_decontamination_judges_each_row_by_itself(spark, block_words):
    docs = [(1, TEXTS[0]), (1, TEXTS[0]), (1, "clean"), (None, TEXTS[1]), (None, "uno"), (None, None)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontamination.decontamination_report(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_words=block_words)
    want = [(d, *brute_hits([(0, t)], ITEMS)[0]) for d, t in docs]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block_words", [2_000_000, 3])
def test_items_without_id_count_as_in_the_sql(spark, tmp_path, monkeypatch, block_words):
    duckdb = pytest.importorskip("duckdb")
    bench = [*ITEMS, (None, "uno"), (None, "z z"), (None, ITEMS[0][1]), (None, None)]
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    whole = decontamination.decontamination_report
    monkeypatch.setattr(decontamination, "decontamination_report", lambda d, b: whole(d, b, block_words=block_words))
    got = queries.op3_decontamination(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.sql(queries.ORACLE_SQL["op3_decontamination"]).fetchall())


def check_packing(pieces, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted(((d, t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x in docs), key=repr)
    by_doc, filled = {}, {}
    for r in pieces:
        ids = np.frombuffer(r.tokens, "<u2").astype("<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.offset + r.length <= 2048
        by_doc.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    got = []
    for d, parts in by_doc.items():
        parts.sort()
        ids = [x for p in parts for x in p[1]]
        at = 0
        for start, p, n in parts:
            assert start == at or start == 0
            at = start + len(p)
        got.append((d, ids))
    assert sorted(got, key=repr) == want
    for spans in filled.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
    assert sorted(filled) == list(range(len(filled))) and sum(1 for s in filled.values() if sum(n for _, n in s) < 2048) <= 1


def test_packing_round_trip(spark):
    docs = [(1, "hello world"), (2, None), (3, ""), (4, "été Straße! don't <|endoftext|> a\x01b " * 900), (5, "x" * 30_000), (None, "no id"), (6, "ﬁn İx ǅ µ ªb éx")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, tokens int").repartition(3)
    check_packing(packing.pack(frame, queries.tokenizer_path()).collect(), docs)
    assert packing.pack(frame.limit(0), queries.tokenizer_path()).count() == 0


def test_packing_special_strings(spark):
    special = "été Straße! don't <|endoftext|> a\x01b " * 900
    docs = [(1, special), (2, special.replace("<|endoftext|>", "")), (3, "A<|endoftext|>B<|startoftext|>"), (4, "<|ENDOFTEXT|> <|EndOfText|>"), (5, "<|ENDOFTEXT|> <|endoftext|>"), (6, "<|end oftext|>"), (7, "<|endoftext|>"), (8, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check_packing(packing.pack(frame, queries.tokenizer_path()).collect(), docs)


def test_packing_with_a_small_cache(spark, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 12)
    encoder = packing.WordEncoder(queries.tokenizer_path(), "<u2")
    plain = packing.WordEncoder(queries.tokenizer_path(), "<u2").whole
    rng = np.random.default_rng(4)
    docs = [" ".join(f"word{x}, don't" for x in rng.integers(0, 40, 9)) for _ in range(700)]
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_batch([d.encode() for d in docs])]
    assert got == [plain.encode(d, add_special_tokens=False).ids for d in docs]
    assert len(encoder.cache) <= 12


def test_packing_learns_plain_words_without_an_array_each(monkeypatch):
    encoder = packing.WordEncoder(queries.tokenizer_path(), "<u2")
    plain = packing.WordEncoder(queries.tokenizer_path(), "<u2").whole
    text = " ".join(f"{a}{b}{c}{m}" for a in "bdfglm" for b in "aeiou" for c in "nrstx" for m in ("", "ing", "ed,", "é"))
    made, array = [], packing.np.array
    monkeypatch.setattr(packing.np, "array", lambda *a: made.append(a) or array(*a))
    (got,) = encoder.encode_batch([text.encode()])
    monkeypatch.undo()
    assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(made) < 10  # before: one for each of the 600 words


def test_packing_repeated_rows(spark):
    rows = [(1, "a text of some words"), (1, "a text of some words"), (2, None), (2, None)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.tokenizer_path()).collect()
    assert sorted((r.doc_id, r.start, r.length == r.doc_tokens) for r in pieces) == [(1, 0, True), (1, 0, True), (2, 0, True), (2, 0, True)]
    assert sorted(r.offset for r in pieces)[0] == 0 and len({r.offset for r in pieces}) == 4


def test_rules_find_planted_junk(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(f"w{x}" for x in rng.integers(0, 900, 60)) + "." for _ in range(150)]
    junk = [" ".join(f"w{x}###" for x in rng.integers(0, 900, 60)) for _ in range(50)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(good + junk)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 200, 2)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in rules.apply_rules(docs, rules.learn_decision_list(docs, labels)).collect()}
    assert all(out[i] == (i < 150) for i in range(200))
    assert rules.learn_decision_list(docs, labels.limit(0)).rules == ()
    empty = rules.apply_rules(spark.createDataFrame([(1, None, 0), (2, "", 0)], "doc_id long, text string, kept int"), rules.DecisionList(())).collect()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in empty)


def test_rule_statistics():
    text = "a b c d e\na b c d e\n\n x # a|b é\n"
    c = dict(zip(rules.COUNTS, rules.text_counts(text.encode()), strict=True))
    w = text.split()
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 5)}
    assert c["n_words"] == len(w) and c["n_repeat_words"] == len(hit) and c["n_dup_lines"] == 1 and c["n_symbols"] == 2
    assert c["word_chars"] == sum(map(len, w))


def corpus(spark, n=240):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 3000)}"
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(6))
        if i % 8 == 1:
            text = text.replace(" ", "%%% ")
        if i % 8 == 2:
            text = text.replace(" ", " idiot ", 4).replace("\n", " moron\n", 2)
        if i % 16 == 0:
            text = "\n".join(" ".join(word() for _ in range(4)) for _ in range(20))
        if i % 16 == 3:  # a near copy, broken into lines elsewhere, so that line dedup leaves it
            w = rows[i - 3][1].replace("w1", "v1", 1).split()
            text = "\n".join(" ".join(w[max(0, k) : k + 4]) for k in range(-2, len(w), 4))
        if i % 24 == 5:
            text += "\n" + " ".join(word() for _ in range(30)) + " " + ITEMS[0][1] + " tail"
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
    labels = [(i, int(i % 8 != 1), int(i % 8 == 2)) for i in range(n) if i % 5]
    return rows, labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = corpus(spark)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS[:3], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = corpus_pipeline.classify(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert first.columns == COLUMNS
    kept = sorted((r.doc_id, r.text) for r in first.collect())
    bad = [i for i, *_ in rows if i % 8 in (1, 2) and i % 16 != 3]
    ids = {d for d, _ in kept}
    assert len(ids & set(bad)) <= 3 and len(set(range(len(rows))) - ids - set(bad)) <= 3
    lines = [(d, t) for d, (_, _, t) in brute_lines(kept).items()]
    parts = brute_components(lines)
    left = [(d, t) for d, t in lines if parts[d][1] == d]
    hits = brute_hits(left, ITEMS[:3])
    clean = [(d, t) for d, t in left if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])]
    assert len(clean) < len(left) < len(lines)
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), clean)


def test_classifier_handles_nulls_and_no_labels(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    models = quality_classifier.fit(docs, labels)
    assert models == {"quality": None, "toxic": None}
    assert [r.kept for r in quality_classifier.score(docs, models).collect()] == [True] * 3
    assert quality_classifier.reject(docs, labels).count() == 3 and quality_classifier.reject(docs.limit(0), labels).count() == 0


def test_labels_of_absent_documents_leave_the_bound_alone(spark):
    rows, labels = corpus(spark, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    absent = [(10_000 + i, i % 2, 0) for i in range(5_000)]
    alone, among = (quality_classifier.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), max_labelled=100) for x in (labels, labels + absent))
    assert alone["quality"] and among["quality"]
    got = [sorted(map(tuple, quality_classifier.score(docs, m).collect())) for m in (alone, among)]
    assert got[0] == got[1]


def test_fitting_the_text_view_holds_few_copies_of_the_elements():
    import tracemalloc

    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40_000, 1000)).astype(np.int32) for _ in range(2000)]
    y = np.array([float((r < 400).sum() > 10) for r in rows])
    tracemalloc.start()
    model = quality_classifier.fit_text(rows, y, np.ones(len(rows)), rounds=20)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * sum(map(len, rows))  # 40 MB; with temporary arrays over all elements it took 61 MB
    assert np.mean([(model.logit(r) > 0) == v for r, v in zip(rows, y, strict=True)]) > 0.9
