"""Substring dedup: prefix-partitioned suffix trees over words.

Remove each word covered by a window of ``length`` words that also starts in a document with a smaller
doc_id. Suffixes are split into memory-sized groups by a prefix of variable length: in a usual group the
least-hashed 8-word run of the first ``length`` words decides (see ``repeats``); groups over ``max_group``
are split by the whole ``length``-word prefix. In a group the suffix tree is built level by level: nodes
of depth 1, 2, 4, ... are named by sorting pairs of names of half the depth, which keeps exact word
identity; the nodes of depth ``length`` are the deep internal nodes. A node's leaves with a document above
the node's least one are removed; neighbouring removed windows merge into maximal repeats.

Defined results: null text has no words; texts under ``length`` words are kept whole; a null doc_id
matches nothing and is kept whole; rows that repeat an id and text get the same result each; different texts
under one id are judged each by itself, and neither is the smaller document of the other; an empty table
gives an empty result; extra columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm.common import column, shared_table, texts

GRAM = 8


def deep_nodes(tokens: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Name of the depth-``length`` tree node above each suffix: equal names, equal first ``length`` tokens."""
    names = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while 2 * depth <= length:
        pair = names[:-depth] * (int(names.max()) + 1) + names[depth:]
        names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    rest = length - depth
    pair = names[starts] * (int(names.max()) + 1) + names[starts + rest]
    return np.unique(pair, return_inverse=True)[1]


def solve_trees(length: int):
    def solve(c: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pieces = [np.frombuffer(p, np.uint64) for p in c["piece"]]
        sizes = np.array([len(p) for p in pieces], np.int64)
        base = np.cumsum(sizes) - sizes
        n_win = c["n_win"].astype(np.int64)
        row = np.repeat(np.arange(len(pieces)), n_win)
        within = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        node = deep_nodes(np.concatenate(pieces), base[row] + within, length)
        doc = c["doc_id"][row]
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc)
        repeat = doc > least[node]
        # runs of repeated windows of one fragment
        first = repeat & ~(np.r_[False, repeat[:-1]] & np.r_[False, row[1:] == row[:-1]])
        last = repeat & ~(np.r_[repeat[1:], False] & np.r_[row[1:] == row[:-1], False])
        r = row[first]
        return r, c["start"][r] + within[first], c["start"][r] + within[last] + length

    return solve


def find_repeats(docs: DataFrame, length: int = 50, max_group: int = 20_000) -> DataFrame:
    """doc_id, th (hash of the text), s, e: runs of words covered by windows that start in a smaller document too (they may overlap)."""
    frags = shared_table(repeats.fragments(docs, repeats.word_tokens, length, GRAM), "word-fragments")
    placed = shared_table(repeats.classify(frags), "word-repeats")
    whole = placed.where("doc_id > min_doc").select("doc_id", "th", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("n_win") + (length - 1)).cast("long").alias("e"))
    asked = placed.where("n_classes > 1 and doc_id = min_doc").withColumn("sure", F.lit(False))
    pieces = shared_table(repeats.fetch(asked, docs, repeats.word_tokens, length).join(asked.select("anchor", (F.col("n_classes") > max_group).alias("big")).distinct(), "anchor"), "word-pieces")
    small = repeats.grouped(pieces.where("not big").repartition("anchor"), solve_trees(length))
    windows = repeats.by_window(pieces.where("big"), np.uint64, length)
    least = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    big = windows.join(least, ["k1", "k2"]).where("doc_id > least").select("doc_id", "th", "s", "e")
    return whole.unionByName(small).unionByName(big)


def remove_repeats(docs: DataFrame, length: int = 50, max_group: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by a space), spans (removed runs of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, runs = [], [], [], []
            for t, spans in zip(texts(b), column(b, "spans"), strict=True):
                words = t.split() if t else []
                merged = repeats.merge_spans(spans.as_py(), len(words))
                n_words.append(len(words))
                n_removed.append(sum(e - s for s, e in merged))
                runs.append([{"s": s, "e": e} for s, e in merged])
                for s, e in reversed(merged):
                    del words[s:e]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(runs, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    covers = shared_table(find_repeats(docs, length, max_group), "word-covers")
    return repeats.spans_by_document(docs, covers).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<s: long, e: long>>")


