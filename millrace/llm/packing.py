"""Packing: concatenate and cut.

Two passes. The first tokenises every document once, keeps the ids as 16- or 32-bit binaries in a
written table and, per task, a running token offset. The sum of each task's tokens (one number per
task) gives every task its global start by a prefix sum; the second pass, row by row without any
shuffle, cuts each document at the fixed windows and emits one boundary record per piece.

Defined results: null text is empty text (one piece holding the end id); an empty table gives an empty
result; repeated rows are packed again; extra columns are ignored; a document longer than a window
gives as many pieces as windows it touches, however long it is.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, column, only, shared_table, texts

#: Entries of a worker's word cache; one that holds more is given up after its group of texts. It bounds memory, results don't depend on it.
CACHE_WORDS = 1_000_000
#: Put between the words that are learnt together; words that hold it are encoded alone.
MARK = "\x01"
#: A word that ends in a letter a-z and marks: the tokenizer parts it there.
TAILED = re.compile(rb"(.*[a-z])([.,;:!?%&*$#|()\"]+)", re.S)
#: Byte-level models' characters for bytes: printable ones stand for themselves, the rest follow from 256 on.
BYTE_CHARS = {c: chr(c) for c in (*range(33, 127), *range(161, 173), *range(174, 256))}
BYTE_CHARS |= {c: chr(256 + k) for k, c in enumerate(c for c in range(256) if c not in BYTE_CHARS)}


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, tokens binary"
)


class WordEncoder:
    """Ids of a text, put together from cached ids of its white-space separated words.

    Valid for tokenizers that drop case and white space and never merge across it (the word-level BPE here):
    the ids of a text are then the concatenation of its words' ids. Misses are encoded together. Texts that hold
    one of the tokenizer's special strings as they stand go through the whole tokenizer; words never give a special id,
    as a lower-cased ``<|ENDOFTEXT|>`` is none.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.whole = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.whole.get_added_tokens_decoder().values()]
        self.dtype = dtype
        every = np.arange(max(self.whole.get_vocab().values()) + 1, dtype=dtype)
        #: The bytes of each id.
        self.bytes_of = [x.tobytes() for x in every]
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        """Add the ids of the words to the cache.

        Plain lower-case Latin words are single pieces to the tokenizer, so its model is asked directly; a
        tail of marks after a letter is a piece of its own. All others go through the whole tokenizer, in strings
        of 500, a mark after each, and the ids are cut at the mark's id.
        """
        cache, tokenize, bytes_of, other = self.cache, self.tokenizer.model.tokenize, self.bytes_of, {}
        for w in words:
            if w.isalpha():  # no marks; it may be the core of an earlier one
                if w not in cache:
                    cache[w] = b"".join([bytes_of[x.id] for x in tokenize(w.decode())])
                continue
            m = TAILED.fullmatch(w)
            core, tail = (m[1], m[2]) if m else (w, b"")
            ids = cache.get(core)
            if ids is None:
                s = core.decode("utf-8", "replace")
                if core.isalpha() or (s.isalpha() and max(s) < "\u0250" and s == s.lower() and unicodedata.is_normalized("NFC", s)):
                    plain = s if core.isalpha() else "".join([BYTE_CHARS[c] for c in core])
                    ids = cache[core] = b"".join([bytes_of[x.id] for x in tokenize(plain)])
            if ids is None or tail and tail not in cache:
                other[w] = core, tail
            elif tail:
                cache[w] = ids + cache[tail]
        self._learn_whole([x for x in dict.fromkeys(chain.from_iterable(other.values())) if x and x not in cache])
        for w, (core, tail) in other.items():
            if tail:
                cache[w] = cache[core] + cache[tail]

    def _learn_whole(self, words: list[bytes]) -> None:
        ids = lambda s: np.array(s.ids, self.dtype)
        (mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        plain = []
        for w in words:
            s = w.decode("utf-8", "replace")
            if MARK in s:
                self.cache[w] = ids(self.tokenizer.encode(s, add_special_tokens=False)).tobytes()
            else:
                plain.append((w, s))
        parts = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        joined = ["".join([f"{s} {MARK} " for _, s in part]) for part in parts]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            found = ids(e)
            ends = np.flatnonzero(found == mark).tolist()
            if len(ends) != len(part):
                raise ValueError("the mark's id is not unique among the words' ids")
            start, blob, size = 0, found.tobytes(), found.itemsize
            for (w, _), end in zip(part, ends, strict=True):
                self.cache[w] = blob[size * start : size * end]
                start = end + 1

    def encode_batch(self, batch: list[bytes | None]) -> Iterator[bytes]:
        """The little-endian ids of each text; words new to the cache are learnt in groups of texts."""
        for i in range(0, len(batch), 256):
            group = [t or b"" for t in batch[i : i + 256]]
            whole = {k for k, t in enumerate(group) if any(s in t for s in self.special)}
            split = [[] if k in whole else t.translate(LOWER).split() for k, t in enumerate(group)]
            # the group's own cache: its words stay in it, whatever there is room for later
            cache = self.cache
            if new := set().union(*split).difference(cache):
                self._learn(new)
                if len(cache) > CACHE_WORDS:
                    self.cache = {}
            for k, words in enumerate(split):
                if k in whole:
                    yield np.array(self.whole.encode(group[k].decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()
                    continue
                yield b"".join(map(cache.__getitem__, words))


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, dtype: str) -> WordEncoder:
    """The worker process's encoder: its word cache lives on from task to task."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = WordEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """task, doc_id, within (tokens of this task before the document), n_tokens, tokens (uint16 ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path, "<u2")
        task, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u2").tobytes()
        for b in batches:
            ids = [x + end for x in words.encode_batch(texts(b))]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), task, np.int32)), column(b, "doc_id").cast(pa.int64()), pa.array(before), pa.array(n), pa.array(ids, pa.binary())],
                ["task", "doc_id", "within", "n_tokens", "tokens"],
            )

    return only(docs, "doc_id", "text").mapInArrow(run, "task int, doc_id long, within long, n_tokens long, tokens binary")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of ``length``-token sequences; ``tokens`` holds a piece's ids as little-endian uint16.

    Only the last sequence of all can be short, so padding is under one sequence in total.
    """
    tokens = shared_table(tokenise(docs, tokenizer_path, end_id), "tokens")
    # one row per task: as many as the scheduler keeps itself
    totals = sorted((r.task, r.n) for r in tokens.groupBy("task").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = {}, 0
    for task, n in totals:
        starts[task] = at
        at += n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for task, doc, within, n, ids in zip(*[column(b, c).to_pylist() for c in ("task", "doc_id", "within", "n_tokens", "tokens")], strict=True):
                g, done = starts[task] + within, 0
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                while done < n:
                    seq, offset = divmod(g + done, length)
                    m = min(length - offset, n - done)
                    for c, v in zip(out, (doc, done, m, zlib.crc32(wide[4 * done : 4 * (done + m)]), n, seq, offset, ids[2 * done : 2 * (done + m)]), strict=True):
                        c.append(v)
                    done += m
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(out[7], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens"],
            )

    return tokens.mapInArrow(cut, PIECES)
