"""The opN_* queries over the standard tables, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, line_dedup, ngram_join, packing, pii, quality_classifier, rules, substring_dedup, suffix_dedup, url_filters
from millrace.llm.common import only, read

#: Tokens of a packed sequence, and the id that ends a document.
SEQUENCE, END_ID = 2048, 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontamination.decontamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return report.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    # all spans in one order: by kind, then start
    of_kind = lambda spans, kind: F.filter(spans, lambda x: x["kind"] == kind)
    everything = found.withColumn("every", F.concat(*[of_kind(c, k) for k in pii.KINDS for c in ("base", "extra")]))
    return everything.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("every").alias("spans"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept", "spans")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


#: The stated URL rules (verdict, host and path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Words of a page's text that mark the page as bad.
SPAM_WORDS = ["casino", "bets", "spam", "pills", "viagra", "porn", "xxx", "malware", "phish", "warez", "torrent"]


def url_labels(pages: DataFrame) -> DataFrame:
    """page_id, bad: whether the page's text outside tags has a spam word. The URL is not looked at; pages without html have no label."""
    shown = F.regexp_replace("html", "<[^<>]*>", " ")
    return only(pages, "page_id", "html").where("html is not null").select("page_id", shown.rlike(r"(?i)\b(" + "|".join(SPAM_WORDS) + r")\b").alias("bad"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    mined = [r[0] for r in url_filters.mine_rules(pages, url_labels(pages), closed=True)]
    return url_filters.judge(pages, URL_RULES, mined)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE, END_ID).drop("tokens")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learned = rules.learn_decision_list(docs, read(spark, sf_dir, "labels"))
    return rules.apply_rules(docs, learned).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "fired", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_filters": op7_url_filters,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_WORDS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format("text"))} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(text=_LOWER.format("text"))} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM grams JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN m USING (s) WHERE doc_id > least),
q AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(w[p], ' ' ORDER BY p) AS kept FROM q ANTI JOIN p USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op6_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op1_line_dedup": r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM a)),
w AS (SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09\x0B-\x0D]+'))) AS ws FROM l),
c AS (SELECT line, ws, len(ws) AS n, row_number() OVER () AS k, min({'d': doc_id, 'i': i}) AS f FROM w WHERE len(ws) >= 1 GROUP BY line, ws),
t AS (SELECT k, n, unnest(ws) AS t FROM c),
v AS (SELECT t, count(*) AS df FROM t GROUP BY t),
r AS (SELECT k, n, t, row_number() OVER (PARTITION BY k ORDER BY df, t) AS p FROM t JOIN v USING (t)),
q AS (SELECT k, n, t FROM r WHERE p <= n - CAST(ceil(0.75 * n) AS INT) + 1),
x AS (SELECT DISTINCT a.k AS a, b.k AS b FROM q a JOIN q b ON a.t = b.t AND a.k <> b.k AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n),
m AS (
  SELECT a.k, min(b.f) AS f FROM x JOIN c a ON a.k = x.a JOIN c b ON b.k = x.b
  WHERE 175 * len(list_intersect(a.ws, b.ws)) >= 75 * (a.n + b.n) GROUP BY a.k),
g AS (
  SELECT w.doc_id, w.i FROM w JOIN c ON c.line = w.line LEFT JOIN m USING (k)
  WHERE {'d': w.doc_id, 'i': w.i} > least(c.f, coalesce(m.f, c.f))),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM l ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM a LEFT JOIN kept USING (doc_id)""",
}
