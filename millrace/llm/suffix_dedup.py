"""Suffix-array dedup over bytes: sampled splitters, local multikey quicksort.

Remove each byte covered by a ``length``-byte string that also starts anywhere else (this document
included). Suffixes whose first ``length`` bytes may repeat are found by ``repeats``; those that sit on
one anchor are sorted as two suffix arrays, of the bytes from the anchor on and of the bytes before it,
read backwards. Spark samples the anchors' leading bytes for splitters and range-partitions by them, so
suffixes with equal leading bytes are never parted by a boundary; the boundary comparison is thereby done
by the partitioner. Each bucket is sorted by multikey quicksort on 8-byte characters with the lengths of
common prefixes of neighbours. A window at offset o of its anchor repeats iff another one has a common
prefix of ``length`` - o bytes after the anchor and of o bytes before it. Groups over ``max_group``
different fragments are keyed window by window.

Defined results: null text is empty; texts under ``length`` bytes are kept; a null doc_id matches nothing
and is kept whole; rows that repeat an id and text count as places elsewhere; different
texts under one id are judged each by itself; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm.common import column, partitions, shared_table, texts

GRAM = 32


def multikey_quicksort(chars: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of characters (most significant first).

    Each round sorts the rows that are still tied by their next character, within their ties; rows that
    have become unique drop out.
    """
    order = np.argsort(chars[:, 0], kind="stable")
    tied = np.arange(len(order))
    group = np.cumsum(np.r_[False, chars[order[1:], 0] != chars[order[:-1], 0]])
    for k in range(1, chars.shape[1]):
        same = group[1:] == group[:-1]
        live = np.r_[False, same] | np.r_[same, False]
        tied, group = tied[live], group[live]
        if not len(tied):
            break
        rows = order[tied]
        value = chars[rows, k]
        by = np.lexsort((value, group))
        order[tied] = rows[by]
        value = value[by]
        group = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
    return order


def suffix_array(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each piece and, by rank, the common prefix with the piece before (capped at ``length``)."""
    width = -(-length // 8) * 8
    raw = np.frombuffer(b"".join([p[:length].ljust(width, b"\0") for p in pieces]), np.uint8).reshape(-1, width)
    order = multikey_quicksort(raw.view(">u8").astype(np.uint64))
    lcp = np.zeros(len(pieces), np.int64)
    for i in range(1, len(pieces), 20_000):
        at = order[i - 1 : i + 20_000]
        differ = raw[at[1:]] != raw[at[:-1]]
        lcp[i : i + len(at) - 1] = np.where(differ.any(1), differ.argmax(1), length)
    rank = np.empty(len(pieces), np.int64)
    rank[order] = np.arange(len(pieces))
    return rank, np.minimum(lcp, length)


def solve_arrays(length: int):
    def solve(c: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, most = len(c["piece"]), length - GRAM
        high = c["a_off"].astype(np.int64)
        low = high - c["n_win"].astype(np.int64) + 1
        rank_f, lcp_f = suffix_array([p[a:] for p, a in zip(c["piece"], high.tolist(), strict=True)], length)
        rank_b, lcp_b = suffix_array([p[:a][::-1] for p, a in zip(c["piece"], high.tolist(), strict=True)], length)
        weight = 1 + c["sure"].astype(np.int64)  # a fragment known to repeat stands for two
        repeat = np.zeros((n, most + 2), bool)
        for o in range(int(low.min()), int(high.max()) + 1):
            at = np.flatnonzero((low <= o) & (o <= high))
            front = np.cumsum(lcp_f < length - o)[rank_f[at]]
            back = np.cumsum(lcp_b < o)[rank_b[at]]
            group = np.unique(front * (n + 1) + back, return_inverse=True)[1]
            repeat[at, o + 1] = np.bincount(group, weights=weight[at])[group] > 1
        repeat[c["sure"].astype(bool)] = False  # they are removed already
        change = np.diff(np.concatenate([repeat, np.zeros((n, 1), bool)], 1).astype(np.int8), axis=1)
        row, first = np.nonzero(change == 1)
        _, last = np.nonzero(change == -1)
        anchor = c["start"][row] + high[row]
        return row, anchor - (last - 1), anchor - first + length

    return solve


def find_repeats(docs: DataFrame, length: int = 200, max_group: int = 20_000) -> DataFrame:
    """doc_id, th (hash of the text), s, e: runs of bytes covered by strings that start elsewhere too (they may overlap)."""
    frags = shared_table(repeats.fragments(docs, repeats.byte_tokens, length, GRAM), "byte-fragments")
    placed = shared_table(repeats.classify(frags), "byte-repeats")
    whole = placed.where("n > 1").select("doc_id", "th", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("n_win") + (length - 1)).cast("long").alias("e"))
    asked = placed.where("n_classes > 1 and doc_id = min_doc").withColumn("sure", F.col("n") > 1)
    pieces = shared_table(repeats.fetch(asked, docs, repeats.byte_tokens, length).join(asked.select("anchor", (F.col("n_classes") > max_group).alias("big")).distinct(), "anchor"), "byte-pieces")
    leading = F.expr(f"substring(piece, a_off + 1, {GRAM})")
    buckets = pieces.where("not big").withColumn("leading", leading).repartitionByRange(partitions(docs), "leading", "anchor").drop("leading")
    small = repeats.grouped(buckets, solve_arrays(length))
    windows = repeats.by_window(pieces.where("big"), np.uint8, length)
    counts = windows.groupBy("k1", "k2").agg(F.sum(F.when(F.col("sure"), 2).otherwise(1)).alias("times"))
    big = windows.where("not sure").join(counts, ["k1", "k2"]).where("times > 1").select("doc_id", "th", "s", "e")
    return whole.unionByName(small).unionByName(big)


def remove_repeats(docs: DataFrame, length: int = 200, max_group: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256, spans (removed runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t, spans in zip(texts(b), column(b, "spans"), strict=True):
                t = t or b""
                merged = repeats.merge_spans(spans.as_py(), len(t))
                kept = bytearray(t)
                for s, e in reversed(merged):
                    del kept[s:e]
                kept = bytes(kept)
                for c, v in zip(cols, (len(t), len(t) - len(kept), len(merged), kept, sha256(kept).hexdigest(), [{"s": s, "e": e} for s, e in merged]), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"])

    covers = shared_table(find_repeats(docs, length, max_group), "byte-covers")
    return repeats.spans_by_document(docs, covers).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<s: long, e: long>>")
