"""URL filters: stated host-and-path rules first, association rules mined by FP-growth for the rest.

A URL's tokens are its host labels (and their hyphenated parts), its leading domain pairs, all its path segments, its
query keys and its query values; ``#`` stands for each number in segments and values. Labelled URLs become transactions of
their tokens plus a class item; Spark's FP-growth mines frequent token combinations, and rules ``tokens -> bad`` of any
length are kept by support and confidence; a rule that contains a kept, shorter one is redundant and dropped. Tokens that
occur in exactly the same labelled URLs (the segments of one deep path) are mined as one and put back in the rules: each for
itself, or with ``closed`` all together, so that a rule claims no more than its labels show (a word that only one bad host
has been seen with blocks no other host). The kept rules sit in an
inverted index under their rarest token, so a URL is only compared with rules one of its tokens leads to.

Defined results: null or a URL without ``://`` has empty host and path; ties between stated rules of equal
length go to the first one; no labels, or none bad, give no mined rules and everything else is allowed;
repeated rows are judged each by itself; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, column, only

BAD = "=bad"
_HOST = re.compile(rb"://([^/?#]*)([^?#]*)")
_KEY = re.compile(rb"[?&]([^=&#]+)")
_VALUE = re.compile(rb"[?&]([^=&#]+=[^&#]+)")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    m = _HOST.search(url.encode("utf-8", "surrogatepass")) if url else None
    return (m[1].translate(LOWER).decode(), m[2].decode()) if m else ("", "")


def url_tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL, sorted."""
    host, path = split_url(url)
    if not url:
        return []
    labels = [x for x in re.split(r"[.:@]", host) if x]
    out = {f"h:{x}" for x in labels} | {f"w:{y}" for x in labels if "-" in x for y in x.split("-") if y}
    out |= {f"d:{'.'.join(labels[-k:])}" for k in (2, 3) if len(labels) >= k}
    # "#" ends a path or query, so it can't be part of a segment or value
    out |= {"p:" + re.sub(r"\d+", "#", x) for x in path.lower().split("/") if x}
    raw = url.encode("utf-8", "surrogatepass")
    out |= {f"q:{k.decode('utf-8', 'replace').lower()}" for k in _KEY.findall(raw)}
    out |= {"v:" + re.sub(r"\d+", "#", v.decode("utf-8", "replace").lower()) for v in _VALUE.findall(raw)}
    return sorted(out)


def longest_rule(host: str, path: str, rules: list[tuple[str, str]]) -> tuple[str, str] | None:
    """(verdict, rule) of the longest stated rule ``host/path`` that fits."""
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def tokenised(urls: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``tokens``."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    schema = StructType([*[urls.schema[c] for c in keep], StructField("tokens", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), pa.array([url_tokens(u) for u in column(b, "url").to_pylist()], pa.list_(pa.string()))], [*keep, "tokens"])

    return only(urls, *dict.fromkeys([*keep, "url"])).mapInArrow(run, schema)


def _same_urls(marked: DataFrame, least: int) -> list[list[str]]:
    """Groups of tokens that occur in exactly the same rows (their count and two 64-bit hash sums agree), each sorted."""
    rows = marked.select(F.explode("tokens").alias("t"), *[F.xxhash64(F.lit(k), "page_id", "tokens").cast("decimal(20,0)").alias(f"h{k}") for k in (0, 1)])
    found: dict[tuple, list[str]] = {}
    for r in rows.groupBy("t").agg(F.count("*").alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).where(F.col("n") >= least).collect():
        found.setdefault((r.n, r.h0, r.h1), []).append(r.t)
    return [sorted(g) for g in found.values()]


def mine_rules(urls: DataFrame, labels: DataFrame, min_support: float = 0.001, min_confidence: float = 0.9, min_count: int = 5, closed: bool = False) -> list[tuple[frozenset[str], float, float]]:
    """(tokens, confidence, support) of the kept rules. ``labels``: page_id, bad (boolean). A rule must hold for
    ``min_support`` of the labelled URLs and for ``min_count`` of them. ``closed``: tokens of exactly the same labelled
    URLs stand in a rule together.

    The frequent tokens that come to the driver are at most a URL's tokens / min_support, so they are bounded
    by the thresholds, not by the input.
    """
    marked = tokenised(urls, ["page_id"]).join(labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id").persist()
    try:
        if marked.where("bad").isEmpty():
            return []
        n = marked.count()
        support = min(1.0, max(min_support, min_count / n))
        same = {g[0]: g for g in _same_urls(marked, int(support * n))}
        again = [t for g in same.values() for t in g[1:]]
        tokens = F.array_except("tokens", F.array(*map(F.lit, again))) if again else F.col("tokens")
        items = marked.select(F.when(F.col("bad"), F.array_append(tokens, F.lit(BAD))).otherwise(tokens).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
        rows = model.associationRules.where(F.array_contains("consequent", BAD)).select("antecedent", "confidence", "support").collect()
    finally:
        marked.unpersist()
    order = lambda r: (len(r[0]), -r[1], -r[2], sorted(r[0]))
    kept: list[tuple[frozenset[str], float, float]] = []
    for tokens, confidence, support in sorted(((frozenset(r[0]), r[1], r[2]) for r in rows), key=order):
        if not any(k[0] <= tokens for k in kept):
            kept.append((tokens, confidence, support))
    if closed:
        return sorted(((frozenset(t for x in k for t in same.get(x, [x])), c, s) for k, c, s in kept), key=order)
    return sorted(((frozenset(t), c, s) for k, c, s in kept for t in itertools.product(*[same.get(x, [x]) for x in k])), key=order)


class RuleIndex:
    """Mined rules under their rarest token: the one fewest rules hold."""

    def __init__(self, rules: list[frozenset[str]]):
        held: dict[str, int] = {}
        for r in rules:
            for t in r:
                held[t] = held.get(t, 0) + 1
        self.by_token: dict[str, list[frozenset[str]]] = {}
        for r in rules:
            self.by_token.setdefault(min(r, key=lambda t: (held[t], t)), []).append(r)

    def blocks(self, tokens: list[str]) -> str | None:
        """The first mined rule that fits, as text."""
        have = set(tokens)
        for t in tokens:
            for r in self.by_token.get(t, ()):
                if r <= have:
                    return " & ".join(sorted(r))
        return None


def judge(urls: DataFrame, stated: list[tuple[str, str]], mined: list[frozenset[str]]) -> DataFrame:
    """page_id, host, path, rule (the stated rule or null), mined (the mined rule or null), verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(mined)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for url in column(b, "url").to_pylist():
                host, path = split_url(url)
                by = longest_rule(host, path, stated)
                found = None if by else index.blocks(url_tokens(url))
                for c, v in zip(out, (host, path, by[1] if by else None, found, by[0] if by else "block" if found else "allow"), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([column(b, "page_id").cast(pa.int64()), *(pa.array(c, pa.string()) for c in out)], ["page_id", "host", "path", "rule", "mined", "verdict"])

    return only(urls, "page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, mined string, verdict string")
