r"""N-gram Jaccard join by parity sketches.

A document's set is its distinct ``shingle``-word runs. Every element toggles one bit of a long bit
sketch; the Hamming distance of two sketches never exceeds the symmetric difference of the sets. For
Jaccard >= t and sizes a <= b the symmetric difference is at most (1 - t) / (1 + t) * (a + b). Sizes are
cut into bands (ratio ``BAND``); a band's sketch has so many pieces that, by the pigeonhole principle, two
sets within the bound agree on at least one piece that isn't empty in both (a set with too few non-empty
pieces for that also joins on its empty ones). A set joins in its own band, and in those below that a
partner within the size bound can be in. Pieces are XOR hashes of their toggled bits.

1. ``describe_and_meet``, one pass: size, digest and a foldable parity sketch per document (equal sets
   become one node); the pieces of each node, packed by bucket, meet by bucket. Pieces shared within one
   block of documents are pre-aggregated before the shuffle (one entry goes on), so a frequent piece costs
   one entry per block. Result: (piece, node) of pieces that two nodes share, with the piece's least node.
2. Every node is verified against the least nodes of its pieces that the size and Hamming bounds allow;
   links give components. Then nodes that share a piece but lie in different components are verified: each
   component's nearest pairs first and more in each round, until no untested pair within the bounds between
   different components is left. Large pieces are compared block by block. So no link between different components is lost.

Work is linear in shingles and in matches; no stage emits the pairs of a group. Nodes are named by 64-bit
digests of their sets, shingles and words by 64-bit hashes.

Defined results: null or wordless texts have the empty set and no links; fewer words than a shingle: the
whole sequence is one; a null doc_id isn't linked and has a null component; repeated rows share one node;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, column, drop_tables, only, partitions, shared_table, texts
from millrace.llm.components import connected_components
from millrace.llm.repeats import WORDS, WordHashes

_M1, _M2, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)
#: Sizes of one band differ by this factor at most. Narrow bands keep some 2 to 3.5 elements in a piece, so that
#: unrelated sets seldom agree on one.
BAND = 4 / 3
#: Pieces of a band's sketch per element of its largest set: some more than the 1/3 that may differ, as some are empty.
PIECES = 0.38
#: Entries of a block before it is packed and sent.
BLOCK = 1_000_000
#: Members of a piece that are compared as one block.
SIDE = 2_000
#: A node's least pieces that go with each of its rows. Sets near the bound share some two fifths of their pieces, so that the first
#: one they share is nearly always among these; if it isn't, the pair is given more than once, but never lost.
FIRST = 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> _S)


def shingle_set(cache: WordHashes, text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(w))
    x = w[: len(w) - k + 1] + np.uint64(k)
    for i in range(1, k):
        x = x * _M1 + w[i : len(w) - k + 1 + i]
        x ^= x >> _S
    x = mix(x)
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]]


def set_name(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_sketch(s: np.ndarray) -> bytes:
    """One to two bits an element, a power of two of bytes: halves XOR to the sketch of half the length."""
    bits = 64
    while bits < len(s):
        bits *= 2
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(sketches: np.ndarray, size: int) -> np.ndarray:
    """Rows of bytes folded to ``size`` bytes."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def band_of(n: int) -> int:
    """Least b with n <= top(b)."""
    b = max(0, int(np.log(n) / np.log(BAND)) - 1)
    while top(b) < n:
        b += 1
    return b


def top(b: int) -> int:
    """Largest size of band b."""
    return int(BAND**b)


def allowed(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of sets of sizes a and b with Jaccard of ``percent`` hundredths or more."""
    return (100 - percent) * (a + b) // (100 + percent)


def piece_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The 64-bit keys on which a set joins."""
    out, n = [], len(s)
    own = band_of(n)
    for b in range(own, -1, -1):
        if b < own and 100 * top(b) < percent * n:
            break
        pieces = int(PIECES * top(b)) + 1
        x = mix(s + np.uint64(b + 1))
        piece = ((x >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
        order = np.argsort(piece.astype(np.uint16) if pieces <= 65_536 else piece, kind="stable")
        piece = piece[order]
        toggled = mix((x[order] & np.uint64(0xFFFF)) + np.uint64(77))  # one of 65536 bits of the piece
        first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        value = np.bitwise_xor.reduceat(toggled, first)
        full = value != 0
        where, value = piece[first][full], value[full]
        # the largest difference to a partner: in the own band up to the size bound, else the smaller set, of this band
        partner = 100 * n // percent if b == own else top(b)
        if len(where) <= allowed(n, partner, percent):
            empty = np.setdiff1d(np.arange(pieces, dtype=np.uint64), where)
            where, value = np.r_[where, empty], np.r_[value, np.zeros(len(empty), np.uint64)]
        out.append(mix(value ^ mix(where + (np.uint64(b + 1) << np.uint64(40)))))
    return np.concatenate(out)


_COLUMNS = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "sketch": pa.binary(), "bucket": pa.int32(), "keys": pa.binary(), "places": pa.binary(), "nodes": pa.binary(), "piece": pa.int64(), "node": pa.int64(), "least": pa.int64()}
_OUT = {k: _COLUMNS[k] for k in ("doc_id", "n_shingles", "sketch", "piece", "node", "least")}
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def _rows(n: int, schema: dict, **given) -> pa.RecordBatch:
    """A batch of ``n`` rows with nulls in all columns that aren't given."""
    return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in schema.items()], list(schema))


def _ddl(schema: dict) -> str:
    return ", ".join(f"{k} {_DDL[t]}" for k, t in schema.items())


def _groups(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, first row of each key, its least node, and rows (in that order) of keys that two nodes share."""
    order = np.argsort(key)
    k, v = key[order], node[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    least = np.minimum.reduceat(v, first)
    n = np.diff(np.r_[first, len(k)])
    most = np.maximum.reduceat(v, first)
    return order, first, least, np.flatnonzero(np.repeat((n > 1) & (least < most), n))


def describe_and_meet(docs: DataFrame, shingle: int, percent: int, buckets: int) -> DataFrame:
    """Two kinds of rows: doc_id, n_shingles, node, sketch of every document (node and sketch null for an empty
    set), and piece, node, least of the pieces that two nodes or more share (may repeat)."""

    def short(key: np.ndarray) -> np.ndarray:
        """A piece's name: its bucket and the lower 32 bits of its key. Chance matches are verified away."""
        return ((key >> np.uint64(33)).astype(np.int64) % buckets << 32) | key.astype(np.uint32).astype(np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WORDS, set()
        keys: list[np.ndarray] = []
        nodes: list[int] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, node = np.concatenate(keys), np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
            order, first, least, many = _groups(key, node)
            if len(many):  # matches within the block; only the least node of a piece goes on
                at = order[many]
                yield _rows(len(at), _COLUMNS, piece=short(key[at]), node=node[at], least=least[np.searchsorted(first, many, "right") - 1])
            key, node = key[order[first]], least
            bucket = (key >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 65_536 else bucket, kind="stable")
            key, node, bucket = key[order].astype(np.uint32), node[order], bucket[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[at[1:], len(bucket)].tolist()
            kinds: list[list] = [[], [], [], []]
            for i, j in zip(at.tolist(), ends, strict=True):
                own, place = np.unique(node[i:j], return_inverse=True)
                for c, v in zip(kinds, (int(bucket[i]), key[i:j].tobytes(), place.astype(np.uint16).tobytes(), own.tobytes()), strict=True):
                    c.append(v)
            yield _rows(len(at), _COLUMNS, bucket=kinds[0], keys=kinds[1], places=kinds[2], nodes=kinds[3])

        for b in batches:
            ids = column(b, "doc_id").to_pylist()
            n, names, sketches = [], [], []
            for doc, t in zip(ids, texts(b), strict=True):
                s = shingle_set(cache, t, shingle)
                name = set_name(s) if len(s) else None
                n.append(len(s))
                names.append(name)
                sketches.append(parity_sketch(s) if len(s) else None)
                if name is None or doc is None or name in seen:
                    continue
                seen.add(name)
                keys.append(piece_keys(s, percent))
                nodes.append(name)
                held += len(keys[-1])
                if held >= BLOCK or len(nodes) == 65_535:
                    yield from flush()
                    keys, nodes, held = [], [], 0
            yield _rows(len(n), _COLUMNS, doc_id=ids, n_shingles=n, node=names, sketch=sketches)
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, nodes = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if keys:
                key, node = np.concatenate(keys), np.concatenate(nodes)
                order, first, least, many = _groups(key, node)
                if len(many):
                    at = order[many]
                    yield _rows(len(at), _OUT, piece=(bucket << 32) | key[at].astype(np.int64), node=node[at], least=least[np.searchsorted(first, many, "right") - 1])

        for b in batches:
            ready = []
            for i, at in enumerate(column(b, "bucket").to_pylist()):
                if at is None:
                    ready.append(i)
                    continue
                if at != bucket:
                    yield from done()
                    bucket, keys, nodes = at, [], []
                keys.append(np.frombuffer(column(b, "keys")[i].as_py(), np.uint32))
                nodes.append(np.frombuffer(column(b, "nodes")[i].as_py(), np.int64)[np.frombuffer(column(b, "places")[i].as_py(), np.uint16)])
            if ready:
                yield b.select(list(_OUT)).take(pa.array(ready))
        yield from done()

    sent = only(docs, "doc_id", "text").mapInArrow(packed, _ddl(_COLUMNS))
    spread = F.coalesce(F.col("bucket").cast("long"), F.xxhash64("doc_id", "piece", "node"))
    return sent.repartition(partitions(docs), spread).sortWithinPartitions("bucket").mapInArrow(meet, _ddl(_OUT))


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard of ``percent`` hundredths or more, checked on the sets themselves."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "doc_id"), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WORDS
        for b in batches:
            found = [shingle_set(cache, t, shingle) for t in texts(b)]
            # an id given twice with different texts: only the text the node was made from counts
            keep = [i for i, (s, n) in enumerate(zip(found, column(b, "node").to_pylist(), strict=True)) if len(s) and set_name(s) == n]
            yield pa.RecordBatch.from_arrays([column(b, "node").take(pa.array(keep, pa.int64())), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["node", "elements"])

    elements = shared_table(only(docs, "doc_id", "text").join(wanted, "doc_id").mapInArrow(sets, "node long, elements binary"), "sets")  # a repeated row repeats a link at most

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(column(b, "x").to_pylist(), column(b, "y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = elements.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    links = shared_table(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
    drop_tables(elements)
    return links


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bounds on sizes and on the Hamming distance of the parity sketches let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for m, n, x, y in zip(*[column(b, c).to_pylist() for c in ("m", "n", "x", "y")], strict=True):
                ok.append(100 * min(m, n) >= percent * max(m, n))
                if ok[-1]:
                    u, v = np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8)[None]
                    size = min(u.shape[1], v.shape[1])
                    ok[-1] = int(np.bitwise_count(fold(u, size) ^ fold(v, size)).sum()) <= allowed(m, n, percent)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("m"), F.col("sketch").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def mixed_pieces(matches: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of pieces with untested pairs of nodes in different components: label, size, sketch, number of blocks, and
    the node's least pieces among these rows.

    Pairs with a piece's least node are tested already, so that node is left out (unless blocks of documents
    named different least nodes for one piece), and with it all pieces of two nodes.
    """
    placed = matches.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    other = F.when(F.col("node") != F.col("least"), F.col("label"))
    per_piece = placed.groupBy("piece").agg(F.min("least").alias("l1"), F.max("least").alias("l2"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(other).alias("lo2"), F.max(other).alias("hi2"), F.count("*").alias("members"))
    mixed = per_piece.where("(l1 = l2 and lo2 < hi2) or (l1 < l2 and lo < hi)").select("piece", "l1", "l2", F.expr(f"cast(ceil(members / {SIDE}) as int)").alias("blocks"))
    rows = placed.join(mixed, "piece").where("l1 < l2 or node <> least").select("piece", "node", "label", "blocks").distinct()
    rows = shared_table(rows, "mixed-pieces")
    firsts = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("piece")), 1, FIRST).alias("firsts"))  # bounded by the pieces of one text
    return rows.join(nodes.select("node", "n_shingles", "sketch").join(firsts, "node"), "node")


def cross_pairs(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a, b) that share a piece, lie in different components and pass the size and Hamming bounds.

    Under one piece, each component gives the ``most`` pairs nearest in sketches to any others: links merge at
    least half of what can be linked, so further pairs are only needed in later rounds; a pair of nulls says that some were
    left. A pair is given under the least piece it shares only: under another one it is passed over if the ``firsts`` of both
    nodes have a lesser piece in common, where the two meet as well. A piece of over SIDE members is dealt into
    blocks; each pair of blocks is compared by itself.
    """
    i = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = rows.withColumn("i", i).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"p": F.least("i", "j"), "q": F.greatest("i", "j")}).select("piece", "p", "q", "i", "node", "label", "n_shingles", "sketch", "firsts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("piece", "p", "q", "i", "node", "label", "n_shingles")
        known: dict[tuple[int, int], float | None] = {}  # pairs of small pieces that were compared already

        def pair_distance(x: int, y: int, sk: list[bytes], n: np.ndarray, node: np.ndarray) -> float | None:
            """Share of the bound for two members, None if over it."""
            key = (int(node[x]), int(node[y]))
            if key not in known:
                if len(known) > 500_000:
                    known.clear()
                m, k = int(n[x]), int(n[y])
                known[key] = None
                if 100 * min(m, k) >= percent * max(m, k):
                    u, v = sorted((sk[x], sk[y]), key=len)
                    small, large, bits = int.from_bytes(u, "little"), int.from_bytes(v, "little"), 8 * len(v)
                    while bits > 8 * len(u):
                        bits //= 2
                        large = (large >> bits) ^ (large & ((1 << bits) - 1))
                    far = (small ^ large).bit_count()
                    if far * (100 + percent) <= (100 - percent) * (m + k):
                        known[key] = far / (m + k)
            return known[key]

        def solve(block: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, sk: list[bytes], lesser: list[set[int]], apart: bool) -> Iterator[tuple]:
            found = []
            if len(node) <= 4:
                for x in range(len(node)):
                    for y in range(x + 1, len(node)):
                        if label[x] != label[y] and (not apart or block[x] != block[y]) and lesser[x].isdisjoint(lesser[y]) and (d := pair_distance(x, y, sk, n, node)) is not None:
                            found.append((d, x, y))
            else:
                sizes = np.array([len(x) for x in sk])
                by_size = {int(z): np.flatnonzero(sizes == z) for z in np.unique(sizes)}
                bits = {z: np.frombuffer(b"".join([sk[k] for k in at]), np.uint8).reshape(-1, z) for z, at in by_size.items()}
                for z, small in by_size.items():
                    for y, large in by_size.items():
                        if y < z:
                            continue
                        folded, step = fold(bits[y], z), max(1, 4_000_000 // (len(large) * z))  # bounded memory
                        for k in range(0, len(small), step):
                            at = small[k : k + step]
                            ok = label[at][:, None] != label[large]
                            if y == z:
                                ok &= at[:, None] < large
                            if apart:
                                ok &= block[at][:, None] != block[large]
                            ok &= np.minimum(n[at][:, None], n[large]) * 100 >= np.maximum(n[at][:, None], n[large]) * percent
                            r, c = np.nonzero(ok)
                            if len(r):
                                far = np.bitwise_count(bits[z][k + r].view(np.uint64) ^ folded[c].view(np.uint64)).sum(1, dtype=np.int64)
                                total = n[at[r]] + n[large[c]]
                                near = far * (100 + percent) <= (100 - percent) * total
                                close = zip((far[near] / total[near]).tolist(), at[r[near]].tolist(), large[c[near]].tolist(), strict=True)
                                found += [f for f in close if lesser[f[1]].isdisjoint(lesser[f[2]])]
            given: dict[int, int] = {}
            for _, x, y in sorted(found):
                own, other = given.get(int(label[x]), 0), given.get(int(label[y]), 0)
                if own >= most and other >= most:
                    yield (None, None)  # some are left for the next round
                    continue
                given[int(label[x])], given[int(label[y])] = own + 1, other + 1
                yield (int(min(node[x], node[y])), int(max(node[x], node[y])))

        def done(t: pa.Table) -> pa.RecordBatch:
            """All groups of a table of whole groups, sorted by group."""
            piece, p, q, *rest = (t.column(c).to_numpy() for c in names)
            sk, firsts = t.column("sketch").to_pylist(), t.column("firsts").to_pylist()
            first = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            out: dict[tuple, None] = {}
            for s, e in zip(first.tolist(), np.r_[first[1:], len(piece)].tolist(), strict=True):
                if e - s > 1:
                    lesser = [{x for x in f if x < piece[s]} for f in firsts[s:e]]
                    out.update(dict.fromkeys(solve(*[c[s:e] for c in rest], sk[s:e], lesser, bool(p[s] != q[s]))))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            t = pa.Table.from_batches([*held, b])
            same = np.logical_and.reduce([(v := t.column(c).to_numpy()) == v[-1] for c in names[:3]])
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut:
                yield done(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return dealt.repartition(partitions(rows), "piece", "p", "q").sortWithinPartitions("piece", "p", "q").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), per row of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * partitions(docs), size // 15_000_000 + 1)  # about 1.5 million pieces each
    both = shared_table(describe_and_meet(docs, shingle, percent, buckets), "pieces")
    described = both.where("piece is null").select("doc_id", "n_shingles", "node", "sketch")
    matches = both.where("piece is not null").select("piece", "node", "least")
    nodes = shared_table(described.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "nodes")
    sizes = nodes.select("node", "n_shingles")
    met = matches.where("least < node").select("node", "least").distinct().join(sizes.toDF("node", "n"), "node").join(sizes.toDF("least", "m"), "least")
    met = shared_table(met.where(f"100 * least(m, n) >= {percent} * greatest(m, n)").select("node", "least"), "met")
    # first each node against the least nodes of its pieces; then all members of a piece, few pairs at a time
    more = shared_table(plausible(met.select(F.col("least").alias("a"), F.col("node").alias("b")), nodes, percent), "stars")
    drop_tables(met)
    tested, links = more, verify(more, docs, nodes, shingle, percent)
    labels, most, left = connected_components(links), 1, True
    for turn in itertools.count():
        if turn and not more.isEmpty():
            found = verify(more, docs, nodes, shingle, percent)
            tested, links = tested.unionByName(more), links.unionByName(found)
            if not found.isEmpty():
                labels = connected_components(links)
        if not left:
            break
        rows = shared_table(mixed_pieces(matches, labels, nodes), "mixed")
        cross = shared_table(cross_pairs(rows, percent, most), "cross")
        drop_tables(rows)
        more, left, most = shared_table(cross.where("a is not null").join(tested, ["a", "b"], "left_anti"), "untested"), not cross.where("a is null").isEmpty(), most * 16
    named = nodes.select("node", "doc_id").join(labels, "node").select("node", "label", "doc_id")
    least = named.groupBy("label").agg(F.min("doc_id").alias("least"))
    # nodes without links stand for their equal sets only
    single = nodes.select("node", F.col("doc_id").alias("own"))
    component = single.join(named.join(least, "label").select("node", "least"), "node", "left").select("node", F.coalesce("least", "own").alias("component"))
    return described.join(component, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """One document of each component: the one with the least doc_id (all rows of it). Columns as given."""
    gone = near_duplicates(docs, shingle, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
