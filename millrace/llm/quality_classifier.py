"""Quality classifier by co-training.

Two views of a document: its text content (which words and marks occur, hashed) and its page metadata
(language, source, size and layout statistics). For each target (``quality`` and ``toxic``) a logistic
model per view starts from labelled documents; in each round, each model's confident predictions on
unlabelled documents become pseudo-labels for the *other* view's model. In the end each view is
calibrated on labelled documents it never trained on, and a small logistic model combines the two calibrated
views. Every document is then scored in one scan, without a shuffle.

Fitting uses at most ``max_labelled`` labelled and ``max_pool`` unlabelled documents (documented bounds),
both taken by a hash of doc_id over all documents; only their hashed features come to the driver. The bounds are the
same at every input size: pseudo-labels, bucket counts and layout means come from these documents only.

Defined results: null text is empty text; null language, source or size are values of their own; a document
labelled twice has its worst label; without labels of both classes a target's model says "good" with 0.5 for
everything, so nothing is rejected; repeated rows get equal scores; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ALNUM, column, only, texts
from millrace.llm.pii import logistic

BITS = 18
MARKS = bytes(32 if chr(c).isalnum() and c < 128 or c >= 128 else c for c in range(256))
UPPER, LOWERS, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
#: One-hot slots of hashed language and source; layout statistics follow.
LANGS, SOURCES, LAYOUT = 32, 256, 12
#: Rows whose elements are worked on at once in fitting.
BLOCK = 500


class Buckets(dict):
    """Hash bucket of a word or mark; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        b = self[word] = zlib.crc32(word) & ((1 << BITS) - 1)
        return b


def text_view(cache: Buckets, t: bytes) -> np.ndarray:
    """Distinct buckets of the words, and of the marks (runs of other characters)."""
    found = set(t.translate(ALNUM).split())
    found.update([b"\0" + m for m in set(t.translate(MARKS).split())])
    return np.unique(np.fromiter(map(cache.__getitem__, found), np.int32, len(found)))


def metadata_view(t: bytes, lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, list[float]]:
    """Slots of language and source, and layout statistics."""
    n = max(1, len(t))
    strip = lambda drop: (n - len(t.translate(None, drop))) / n if t else 0.0
    words, lines = t.count(b" ") + 1, t.count(b"\n") + 1
    slot = lambda v, m: zlib.crc32(repr(v).encode()) % m
    size = np.log1p(max(0, n_chars)) if n_chars is not None else -1.0
    layout = [size, np.log1p(words), np.log1p(lines), np.log1p(words / lines), strip(UPPER), strip(LOWERS), strip(DIGITS), strip(b".,;:"), strip(b"!?"), strip(b"#*$%&<>"), strip(b"|"), n / words / 10]
    return slot(lang, LANGS), slot(source, SOURCES), [float(x) for x in layout]


_META = ["lang", "source", "n_chars"]


def views(docs: DataFrame, extra: list[str]) -> DataFrame:
    """doc_id, buckets, slots, layout and the ``extra`` columns, for the (bounded) documents to fit on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Buckets()
        for b in batches:
            buckets, slots, layout = [], [], []
            for t, *meta in zip(texts(b), *[column(b, c).to_pylist() for c in _META], strict=True):
                buckets.append(text_view(cache, t or b""))
                i, j, x = metadata_view(t or b"", *meta)
                slots.append([i, j])
                layout.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.list_(pa.int32())), pa.array(slots, pa.list_(pa.int32())), pa.array(layout, pa.list_(pa.float64())), *(column(b, c).cast(pa.int32()) for c in extra)], ["buckets", "slots", "layout", *extra])

    return docs.select("text", *_META, *extra).mapInArrow(run, ", ".join(["buckets array<int>, slots array<int>, layout array<double>", *(f"{c} int" for c in extra)]))


@dataclass
class TextModel:
    w: np.ndarray
    b: float

    def logit(self, buckets: np.ndarray) -> float:
        return float(self.w[buckets].sum()) + self.b


def fit_text(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, l2: float = 2e-4, rounds: int = 120, min_rows: int = 3) -> TextModel:
    """Sparse logistic regression by full-batch AdaGrad; buckets in fewer than ``min_rows`` rows have no weight."""
    size = 1 << BITS
    sizes = np.array([len(r) for r in rows], np.int64)
    seen = np.zeros(size, np.int64)
    for r in rows:
        seen[r] += 1  # distinct in a row
    used = np.flatnonzero(seen >= min_rows)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    # rows in blocks: only the places of all elements are held at once, as 32-bit numbers
    blocks = []
    for k in range(0, len(rows), BLOCK):
        flat = place[np.concatenate(rows[k : k + BLOCK])]
        known = flat >= 0
        row = np.repeat(np.arange(len(rows[k : k + BLOCK]), dtype=np.int32), sizes[k : k + BLOCK])
        blocks.append((k, flat[known], row[known]))
    w, b = np.zeros(len(used)), 0.0
    g2, gb2 = np.full(len(used), 1e-8), 1e-8
    total = weight.sum()
    for _ in range(rounds):
        g, gb = l2 * w, 0.0
        for k, col, row in blocks:
            n = len(rows[k : k + BLOCK])
            z = np.bincount(row, weights=w[col], minlength=n) + b
            e = weight[k : k + n] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k : k + n]) / total
            g += np.bincount(col, weights=e[row], minlength=len(used))
            gb += e.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.5 * gb / np.sqrt(gb2)
    out = np.zeros(size)
    out[used] = w
    return TextModel(out, float(b))


@dataclass
class MetaModel:
    w: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def design(self, slots: np.ndarray, layout: np.ndarray) -> np.ndarray:
        x = np.zeros((len(layout), 1 + LANGS + SOURCES + 2 * LAYOUT))
        at = np.arange(len(layout))
        x[:, 0] = 1
        x[at, 1 + slots[:, 0]] = 1
        x[at, 1 + LANGS + slots[:, 1]] = 1
        z = np.clip((layout - self.mean) / self.scale, -6, 6)
        x[:, 1 + LANGS + SOURCES :] = np.concatenate([z, z * z / 6], 1)
        return x

    def logits(self, slots: np.ndarray, layout: np.ndarray) -> np.ndarray:
        return self.design(slots, layout) @ self.w


def fit_meta(slots: np.ndarray, layout: np.ndarray, y: np.ndarray, weight: np.ndarray) -> MetaModel:
    m = MetaModel(np.zeros(0), layout.mean(0), layout.std(0) + 1e-6)
    m.w = _weighted(m.design(slots, layout), y, weight)
    return m


def _weighted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 25) -> np.ndarray:
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (weight * (p - y)) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class CoTrained:
    """Both views' models of one target and how to combine them; ``pseudo`` counts pseudo-labels by round."""

    text: TextModel
    meta: MetaModel
    combine: np.ndarray  # bias, calibrated text logit, calibrated metadata logit
    calibrate: np.ndarray  # 2 x (bias, slope)
    pseudo: list[tuple[int, int]]

    def probability(self, text_logits: np.ndarray, meta_logits: np.ndarray) -> np.ndarray:
        a, b = (np.clip(c[0] + c[1] * z, -12, 12) for c, z in zip(self.calibrate, (text_logits, meta_logits), strict=True))
        return 1 / (1 + np.exp(-np.clip(self.combine[0] + self.combine[1] * a + self.combine[2] * b, -30, 30)))


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    c = logistic(np.stack([np.ones(len(z)), np.clip(z, -30, 30)], 1), np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)), 1e-3)
    return np.array([c[0], max(0.0, c[1])])


def co_train(buckets: list[np.ndarray], slots: np.ndarray, layout: np.ndarray, y: np.ndarray, rounds: int = 3, confident: float = 0.97, weight: float = 0.5) -> CoTrained | None:
    """``y``: 0 or 1, or -1 for the unlabelled pool. Every fourth labelled row calibrates and never trains."""
    labelled, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    held, train = labelled[::4], np.setdiff1d(labelled, labelled[::4])
    if min((y[train] == 0).sum(), (y[train] == 1).sum(), (y[held] == 0).sum(), (y[held] == 1).sum()) < 1:
        return None
    pseudo: list[dict[int, int]] = [{}, {}]  # for the text model, for the metadata model
    history = []
    for r in range(rounds + 1):
        sets = []
        for p in pseudo:
            idx = np.concatenate([train, np.array(sorted(p), np.int64)])
            sets.append((idx, np.concatenate([y[train], [p[i] for i in sorted(p)]]).astype(float), np.concatenate([np.ones(len(train)), np.full(len(p), weight)])))
        text = fit_text([buckets[i] for i in sets[0][0]], sets[0][1], sets[0][2])
        meta = fit_meta(slots[sets[1][0]], layout[sets[1][0]], sets[1][1], sets[1][2])
        z = [np.array([text.logit(b) for b in buckets]), meta.logits(slots, layout)]
        cal = np.array([_platt(v[held], y[held]) for v in z])
        if r == rounds or not len(pool):
            break
        for giver in (0, 1):
            q = 1 / (1 + np.exp(-np.clip(cal[giver][0] + cal[giver][1] * z[giver][pool], -30, 30)))
            sure = {int(i): 1 for i in pool[q >= confident]} | {int(i): 0 for i in pool[q <= 1 - confident]}
            pseudo[1 - giver] = sure
        history.append((len(pseudo[0]), len(pseudo[1])))
    both = np.stack([np.ones(len(held)), *(np.clip(c[0] + c[1] * v[held], -12, 12) for c, v in zip(cal, z, strict=True))], 1)
    return CoTrained(text, meta, logistic(both, y[held].astype(float), 1e-3), cal, history)


TARGETS = ("quality", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, max_pool: int = 6_000, rounds: int = 3) -> dict[str, CoTrained | None]:
    """A co-trained model per target."""
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = only(docs, "doc_id").where("doc_id is not null")
    # labels of absent documents don't use up the bound
    sample = marked.join(ids, "doc_id", "left_semi").orderBy(*by_hash).limit(max_labelled)
    free = ids.join(marked.select("doc_id"), "doc_id", "left_anti").distinct().orderBy(*by_hash).limit(max_pool)
    chosen = sample.unionByName(free.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic")))
    base = only(docs, "doc_id", "text", *_META).join(F.broadcast(chosen), "doc_id")
    rows = views(base.select("text", *_META, F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.hash("doc_id").alias("place")), ["quality", "toxic", "place"]).toArrow()
    if not rows.num_rows:
        return dict.fromkeys(TARGETS)
    y = {c: rows.column(c).to_numpy() for c in ("place", "quality", "toxic")}
    order = np.lexsort((y["toxic"], y["quality"], y["place"]))  # stable
    flat = lambda c, width: rows.column(c).combine_chunks().flatten().to_numpy().reshape(-1, width)[order]
    slots, layout = flat("slots", 2), flat("layout", LAYOUT)
    lists = rows.column("buckets").combine_chunks()
    del rows
    at, every = lists.offsets.to_numpy(), lists.values.to_numpy()
    buckets = [every[at[i] : at[i + 1]] for i in order.tolist()]  # views: the elements are held once
    return {t: co_train(buckets, slots, layout, y[t][order], rounds) for t in TARGETS}


def score(docs: DataFrame, models: dict[str, CoTrained | None], threshold: float = 0.5) -> DataFrame:
    """doc_id, quality_score and toxic_score (combined probabilities), kept: good and not toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, models = Buckets(), sent.value
        for b in batches:
            n = b.num_rows
            logits, slots, layout = np.zeros((2, n)), np.zeros((n, 2), np.int64), np.zeros((n, LAYOUT))
            for k, (t, *meta) in enumerate(zip(texts(b), *[column(b, c).to_pylist() for c in _META], strict=True)):
                words = text_view(cache, t or b"")
                for m, target in enumerate(TARGETS):
                    if models[target]:
                        logits[m, k] = models[target].text.logit(words)
                slots[k, 0], slots[k, 1], layout[k] = metadata_view(t or b"", *meta)
            p = {}
            for m, target in enumerate(TARGETS):
                model = models[target]
                p[target] = model.probability(logits[m], model.meta.logits(slots, layout)) if model and n else np.full(n, 0.5)
            kept = (p["quality"] >= threshold) & ((p["toxic"] < threshold) if models["toxic"] else np.ones(n, bool))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), pa.array(p["quality"]), pa.array(p["toxic"]), pa.array(kept)], ["doc_id", "quality_score", "toxic_score", "kept"])

    return only(docs, "doc_id", "text", *_META).mapInArrow(run, "doc_id long, quality_score double, toxic_score double, kept boolean")


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents the classifier rejects; all columns kept. Rows with a null doc_id stay."""
    gone = score(docs, fit(docs, labels, **options)).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
