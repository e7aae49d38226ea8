"""Exact repeated passages at scale: what substring and suffix-array de-duplication share.

A window is ``length`` consecutive tokens of one document. The suffixes that start at windows are dealt
out by an *anchor* inside their first ``length`` tokens: the ``gram``-token run with the least hash,
leftmost if tied. The anchor depends on the window's own tokens only, so equal windows have equal
anchors at equal offsets. Neighbouring windows mostly share one anchor occurrence and travel as one
*fragment*: about ``2 / (length - gram)`` rows per token instead of one.

1. ``fragments`` (scan): anchor, hash of the fragment's tokens, place. No text leaves the task.
2. ``classify``: fragments are counted by (anchor, hash), partly before the shuffle, and by anchor. Most
   anchors occur once: nothing repeats there. Equal fragments repeat whole: decided without any text.
3. Only anchors with *different* fragments need tokens: one fragment per class (the others are decided),
   fetched by one join with the documents (``fetch``). The operators sort these.
4. Groups over ``max_group`` classes don't go to one task: their windows are keyed one by one by a
   128-bit hash of all ``length`` tokens and aggregated (``by_window``).

Memory is bounded by one document, ``max_group`` fragments or one Arrow batch; the work is linear in the
windows, never in pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column, only, texts

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)
#: Position bits of a sliding-minimum key; a text has under 2**31 bytes.
_POS = 31


class WordHashes(dict):
    """64-bit hash of a word, cached; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


#: The worker process's cache, kept from task to task.
WORDS = WordHashes()


def word_tokens(cache: WordHashes, text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def byte_tokens(_: WordHashes, text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _fold(h: np.ndarray, by: int) -> np.ndarray:
    """Hash of twice ``by`` tokens at each position from the hashes of ``by`` tokens."""
    x = h[:-by] * _M1
    x += h[by:]
    x ^= x >> _S
    x *= _M2
    return x


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` (a power of two) tokens at each position."""
    h = (tokens.astype(np.uint64) + np.uint64(1)) * _M2
    h ^= h >> _S
    by = 1
    while by < gram:
        h = _fold(h, by)
        by *= 2
    return h


def window_keys(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window."""
    out = []
    for seed in (np.uint64(0x51ED270B), np.uint64(0x2545F4914F6CDD1D)):
        h = (tokens.astype(np.uint64) ^ seed) * _M1
        h ^= h >> _S
        by = 1
        while 2 * by <= length:
            h = _fold(h, by)
            by *= 2
        rest = length - by
        if rest:
            h = h[: len(h) - rest] * _M2 + h[rest:]
            h ^= h >> _S
        out.append(h)
    return out[0], out[1]


def split_windows(tokens: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of one document: anchor hash, first window, number of windows, anchor's offset in the first window."""
    n = len(tokens) - length + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    grams = gram_hashes(tokens, gram)
    low = np.uint64((1 << _POS) - 1)
    m = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    place = (m & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    place = place[first]
    return grams[place], first, np.diff(np.r_[first, n]), place - first


def _digest(piece: bytes) -> int:
    return int.from_bytes(blake2b(piece, digest_size=8).digest(), "little", signed=True)


FRAGMENT = "anchor long, f long, doc_id long, th long, start int, n_win int, a_off int"


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text's hash th: with it, different texts that share an id stay apart."""
    return only(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))


def fragments(docs: DataFrame, tokens: Callable, length: int, gram: int) -> DataFrame:
    """All fragments of all documents. (anchor, f) names a fragment's tokens with 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WORDS
        for b in batches:
            ids = column(b, "doc_id").to_numpy(zero_copy_only=False)
            parts, hashes, owner, text = [], [], [], []
            for doc, th, t in zip(ids, column(b, "th").to_numpy(), texts(b), strict=True):
                x = tokens(cache, t or b"")
                a, s, n, o = split_windows(x, length, gram)
                if not len(s):
                    continue
                parts.append((a, s, n, o))
                owner.append(np.full(len(s), doc, np.int64))
                text.append(np.full(len(s), th, np.int64))
                raw, size = x.tobytes(), x.itemsize
                hashes += [_digest(raw[size * i : size * j]) for i, j in zip(s.tolist(), (s + n + length - 1).tolist(), strict=True)]
            if parts:
                a, s, n, o = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(hashes, pa.int64()), pa.array(np.concatenate(owner)), pa.array(np.concatenate(text)), *(pa.array(c.astype(np.int32)) for c in (s, n, o))],
                    ["anchor", "f", "doc_id", "th", "start", "n_win", "a_off"],
                )

    return named(docs).where("doc_id is not null").mapInArrow(run, FRAGMENT)


def classify(frags: DataFrame) -> DataFrame:
    """The fragments whose anchor occurs twice or more, with n (equal fragments), min_doc (least document that
    has one) and n_classes (different fragments of the anchor)."""
    classes = frags.groupBy("anchor", "f").agg(F.count("*").alias("n"), F.min("doc_id").alias("min_doc"))
    groups = classes.groupBy("anchor").agg(F.count("*").alias("n_classes"), F.sum("n").alias("total")).where("total > 1").drop("total")
    return frags.join(classes.join(groups, "anchor"), ["anchor", "f"])


def fetch(asked: DataFrame, docs: DataFrame, tokens: Callable, length: int) -> DataFrame:
    """The asked fragments (columns of FRAGMENT and ``sure``) with ``piece``, their tokens as bytes.

    One row per text on the asking side.
    """
    wanted = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "f", "start", "n_win", "a_off", "sure")).alias("wanted"))
    joined = named(docs).join(wanted, ["doc_id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WORDS
        for b in batches:
            for doc, th, t, w in zip(column(b, "doc_id").to_pylist(), column(b, "th").to_pylist(), texts(b), column(b, "wanted"), strict=True):
                x = tokens(cache, t or b"")
                raw, size, rows = x.tobytes(), x.itemsize, []
                for r in w.as_py():
                    piece = raw[size * r["start"] : size * (r["start"] + r["n_win"] + length - 1)]
                    if _digest(piece) == r["f"]:
                        rows.append((r["anchor"], r["f"], doc, th, r["start"], r["n_win"], r["a_off"], r["sure"], piece))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "f", "doc_id", "th", "start", "n_win", "a_off", "sure", "piece"])

    return joined.mapInArrow(run, FRAGMENT + ", sure boolean, piece binary")


def grouped(pieces: DataFrame, solve: Callable[[dict], tuple], flush: int = 30_000) -> DataFrame:
    """Run ``solve`` over whole anchor groups, about ``flush`` fragments at a time, of pieces sorted by anchor in each task.

    ``solve`` gets the columns as arrays and returns (row, first token, end) of the repeats it finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def out(t: pa.Table) -> pa.RecordBatch:
            c = {k: t.column(k).to_numpy() for k in ("anchor", "doc_id", "th", "start", "n_win", "a_off", "sure")} | {"piece": t.column("piece").to_pylist()}
            row, lo, hi = solve(c)
            return pa.RecordBatch.from_arrays([pa.array(c["doc_id"][row]), pa.array(c["th"][row]), pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], ["doc_id", "th", "s", "e"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= flush:
                t = pa.Table.from_batches(held)
                a = t.column("anchor").to_numpy()
                cut = int(np.searchsorted(a, a[-1]))  # the last group may go on in the next batch
                if cut:
                    yield out(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                n -= cut
        if n:
            yield out(pa.Table.from_batches(held))

    return pieces.sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, th long, s long, e long")


def by_window(pieces: DataFrame, dtype, length: int) -> DataFrame:
    """One row per window of the pieces: k1, k2 (128-bit hash of its tokens), doc_id, s, e, sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, th, start, sure, piece in zip(*[column(b, c).to_pylist() for c in ("doc_id", "th", "start", "sure", "piece")], strict=True):
                k1, k2 = window_keys(np.frombuffer(piece, dtype), length)
                s = start + np.arange(len(k1), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.full(len(s), doc, np.int64)), pa.array(np.full(len(s), th, np.int64)), pa.array(s), pa.array(s + length), pa.array(np.full(len(s), sure))],
                    ["k1", "k2", "doc_id", "th", "s", "e", "sure"],
                )

    return pieces.mapInArrow(run, "k1 long, k2 long, doc_id long, th long, s long, e long, sure boolean")


def spans_by_document(docs: DataFrame, covers: DataFrame) -> DataFrame:
    """doc_id, text and ``spans``: the merged-later (s, e) covers of the document, null if none."""
    spans = covers.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return named(docs).join(spans, ["doc_id", "th"], "left").drop("th")


def merge_spans(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Disjoint, ordered runs within 0..n; touching runs become one."""
    out: list[tuple[int, int]] = []
    for x in sorted((x["s"], x["e"]) for x in spans or ()):
        s, e = max(0, x[0]), min(n, x[1])
        if s >= e:
            continue
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out
