"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

An item's windows are its runs of ``window`` consecutive words (a shorter item is one window). As a set
of ``SHINGLE``-word shingles a window must be contained whole, so its prefix is one shingle: the rarest
one, with shingles ordered by how many windows hold them. Only these prefix shingles are joined with the
documents. A match at word p of a document fixes the window's start (positional bound) and must leave
room for the whole window (length bound); the words there are then compared one by one (exact).

The benchmark is joined in blocks of at most ``block_words`` words, so what is sent to the executors has
a fixed bound, however large the benchmark is; each block is one pass over the documents. One block
needs no shuffle at all; for several the documents are written with a row key first, and the hit spans put
together per row by one aggregation.

Defined results: null or wordless texts have no words and no hits; wordless or null texts of items have no window;
items without an id count as one item, null, last in ``items``; an empty benchmark leaves every document clean;
repeated rows, and rows with a null doc_id, are judged each by itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ALNUM, column, only, shared_table, texts

#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 3


class WindowIndex:
    """Windows of some items, found by their rarest shingle. Word ids are below 2**21, so a shingle packs into 63 bits."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str | None]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                held.setdefault(tuple(ids[i : i + window]), set()).add(item)
        if len(self.vocabulary) >= 2**21:
            raise ValueError("a block of the benchmark has over 2**21 distinct words: lower block_words")
        self.windows, self.items = list(held), list(held.values())
        pack = lambda g: sum(x << (21 * k) for k, x in enumerate(g))
        size = lambda w: min(SHINGLE, len(w))
        shingles = lambda w: [pack(w[i : i + size(w)]) for i in range(len(w) - size(w) + 1)]
        rarity = Counter(s for w in self.windows for s in set(shingles(w)))
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.windows):
            s = shingles(w)
            at = min(range(len(s)), key=lambda i: (rarity[s[i]], s[i], i))
            by_size.setdefault(size(w), []).append((s[at], k, at))
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.flat = np.array([x for w in self.windows for x in w], np.int32)
        self.base = np.cumsum(self.lengths) - self.lengths
        # per shingle size: sorted keys, and for each key its (window, offset) entries
        self.index = {}
        for s, entries in by_size.items():
            e = np.array(sorted(entries), np.int64).reshape(-1, 3)
            keys, first, n = np.unique(e[:, 0], return_index=True, return_counts=True)
            self.index[s] = (keys, first, n, e[:, 1], e[:, 2])

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and windows of every occurrence in ``words``."""
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, (0 for _ in range(n))), np.int64, n)
        starts, found = [], []
        for s, (keys, first, count, window, offset) in self.index.items():
            if n < s:
                continue
            ok, key = ids[: n - s + 1] > 0, ids[: n - s + 1].copy()
            for k in range(1, s):
                ok &= ids[k : n - s + 1 + k] > 0
                key |= ids[k : n - s + 1 + k] << (21 * k)
            at = np.flatnonzero(ok)
            key = key[at]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[place] == key
            at, place = at[same], place[same]
            for i in range(0, len(at), 50_000):  # a frequent shingle of many windows stays within memory
                a, p = at[i : i + 50_000], place[i : i + 50_000]
                m = count[p]
                entry = np.repeat(first[p] - np.cumsum(m) + m, m) + np.arange(m.sum())
                w, begin = window[entry], np.repeat(a, m) - offset[entry]
                fits = (begin >= 0) & (begin + self.lengths[w] <= n)
                w, begin = w[fits], begin[fits]
                for k in range(int(self.lengths[w].max(initial=0))):
                    inside = k < self.lengths[w]
                    same = ~inside
                    same[inside] = ids[begin[inside] + k] == self.flat[self.base[w[inside]] + k]
                    w, begin = w[same], begin[same]
                starts.append(begin)
                found.append(w)
        none = np.zeros(0, np.int64)
        return (np.concatenate(starts) if starts else none), (np.concatenate(found) if found else none)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of about ``block_words`` words; one partition at a time comes to the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        words = r.text.encode().translate(ALNUM).split()
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((r.item_id, words))
        size += len(words)
    yield block


def find_spans(docs: DataFrame, items: list[tuple[str | None, list[bytes]]], window: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keys`` (long), n_words, starts, ends (merged hit spans in words), items (whose windows occur) for one block."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WindowIndex(sent.value, window)
        for b in batches:
            n_words, begins, ends, items_found = [], [], [], []
            for t in texts(b):
                words = t.translate(ALNUM).split() if t else []
                at, w = index.hits(words) if words and index.windows else (np.zeros(0, np.int64),) * 2
                order = np.argsort(at, kind="stable")
                s, e = at[order], np.maximum.accumulate((at + index.lengths[w])[order]) if len(at) else at
                new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]]) if len(s) else np.zeros(0, np.int64)
                n_words.append(len(words))
                begins.append(s[new].tolist())
                ends.append(e[np.r_[new[1:] - 1, len(e) - 1]].tolist() if len(s) else [])
                items_found.append(sorted(set().union(*(index.items[k] for k in set(w.tolist()))), key=lambda x: (x is None, x)) if len(w) else [])
            yield pa.RecordBatch.from_arrays(
                [*(column(b, k).cast(pa.int64()) for k in keys), pa.array(n_words, pa.int64()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items_found, pa.list_(pa.string()))],
                [*keys, "n_words", "starts", "ends", "items"],
            )

    return only(docs, *keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", n_words long, starts array<long>, ends array<long>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, starts, ends, items per document, over the whole benchmark."""
    blocks = _blocks(benchmark, block_words)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return find_spans(docs, block, window)
    # written once: all blocks then see the same row keys
    keyed = shared_table(only(docs, "doc_id", "text").withColumn("row_key", F.monotonically_increasing_id()), "documents-keyed")
    every = find_spans(keyed, block, window, ("row_key", "doc_id"))
    for block in itertools.chain([following], blocks):
        every = every.unionByName(find_spans(keyed, block, window, ("row_key", "doc_id")))
    together = every.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<starts: bigint, ends: bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= x["starts"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], x["ends"]).alias("ends"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["starts"].alias("starts"), x["ends"].alias("ends"))))),
    )
    return together.withColumn("spans", F.expr("cast(spans as array<struct<starts: bigint, ends: bigint>>)")).withColumn("spans", merged).select("doc_id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: float = 0.05, block_words: int = 2_000_000) -> DataFrame:
    """The spans with n_hit and the verdict: at least one hit word and a share of hit words of ``min_share``."""
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    parts = round(1 / min_share)
    return contamination(docs, benchmark, window, block_words).withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * parts >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: float = 0.05) -> DataFrame:
    """Documents without the contaminated ones, all columns kept."""
    bad = decontamination_report(docs, benchmark, window, min_share).where("contaminated").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti")


