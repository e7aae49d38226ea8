"""Quality rules: a learned decision list over per-document statistics.

``document_stats`` measures every document whole. ``learn_decision_list`` does sequential covering on a
bounded sample of labelled documents: a rule (a conjunction of threshold tests) is grown test by test on
the growing set by information gain, pruned from its end on the pruning set, accepted if precise enough,
and the documents it covers leave the set; then the next rule. ``DecisionList.column`` emits the rules as
one ordered Spark ``CASE WHEN``, so scoring is plain code-generated Spark.

Defined results: null text has no words (all statistics 0); an empty or one-class label table gives an
empty list, which keeps everything; ties between tests go to the first statistic and lowest threshold;
repeated rows are judged each by itself; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column, only, texts

#: The symbols that are counted, and white space.
SYMBOLS = b"#*$%&|<>"
SPACE = bytes(range(0x09, 0x0E)) + b" "
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LOWER_CASE = bytes(range(97, 123))
DIGITS = b"0123456789"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_bars", "n_bangs", "n_stops", "n_distinct", "longest_line"]
#: Ratios the rules test, as (name, numerator, denominator).
RATIOS = [
    ("symbols_per_word", "n_symbols", "n_words"), ("dup_lines_share", "n_dup_lines", "n_lines"), ("repeat_words_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"), ("digits_share", "n_digits", "word_chars"), ("bars_per_word", "n_bars", "n_words"), ("bangs_per_word", "n_bangs", "n_words"),
    ("stops_per_word", "n_stops", "n_words"), ("distinct_share", "n_distinct", "n_words"), ("word_length", "word_chars", "n_words"), ("words", "n_words", None), ("words_per_line", "n_words", "n_lines"),
]


def text_counts(t: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one UTF-8 text."""
    if not t:
        return (0,) * len(COUNTS)
    words = t.split()
    n = len(words)
    strip = lambda drop: len(t) - len(t.translate(None, drop))
    lines = [x for x in t.split(b"\n") if x and not x.isspace()]
    repeat = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + 5 - max(i, end)
                    end = i + 5
    return (
        n, len(t.translate(None, SPACE + CONTINUATION)), strip(SYMBOLS), len(lines) - len(set(lines)), repeat,
        len(lines), strip(UPPER), strip(LOWER_CASE), strip(DIGITS), t.count(b"|"), t.count(b"!"), t.count(b"."), len(set(words)), max(map(len, lines), default=0),
    )


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS (long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(t) for t in texts(b)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *COUNTS])

    return only(docs, "doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)]))


@dataclass(frozen=True)
class Test:
    stat: str
    above: bool
    threshold: float

    def column(self) -> Column:
        _, top, under = next(r for r in RATIOS if r[0] == self.stat)
        value = F.col(top).cast("double") if under is None else F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(F.lit(0.0))
        return value >= self.threshold if self.above else value < self.threshold

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.stat] >= self.threshold if self.above else x[self.stat] < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first whose tests all hold rejects the document."""

    rules: tuple[tuple[Test, ...], ...]

    def column(self) -> Column:
        """Number of the first rule that fires, from 1; 0 for none."""
        case = None
        for k, rule in enumerate(self.rules, 1):
            cond = F.lit(True)
            for t in rule:
                cond = cond & t.column()
            case = F.when(cond, k) if case is None else case.when(cond, k)
        return F.lit(0) if case is None else case.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(" and ".join(f"{t.stat} {'>=' if t.above else '<'} {t.threshold:.6g}" for t in r) for r in self.rules)


def ratios(counts: np.ndarray) -> dict[str, np.ndarray]:
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    return {name: c[top] if under is None else np.divide(c[top], c[under], out=np.zeros(len(counts)), where=c[under] > 0) for name, top, under in RATIOS}


def _gain(tp: np.ndarray, fp: np.ndarray, tp0: float, fp0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(tp > 0, tp * (np.log2(tp / (tp + fp)) - np.log2(tp0 / (tp0 + fp0))), -np.inf)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int) -> list[Test]:
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < max_tests and (~bad & inside).any():
        tp0, fp0 = float((bad & inside).sum()), float((~bad & inside).sum())
        best, chosen = 1e-9, None
        for stat, v in x.items():
            v, y = v[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            below_tp = np.cumsum(y)[cut - 1].astype(float)
            below_fp = cut - below_tp
            for above, tp, fp in ((False, below_tp, below_fp), (True, tp0 - below_tp, fp0 - below_fp)):
                g = _gain(tp, fp, tp0, fp0)
                k = int(np.argmax(g))
                if g[k] > best:
                    best, chosen = g[k], Test(stat, above, float((v[cut[k] - 1] + v[cut[k]]) / 2))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.covers(x)
    return rule


def learn(counts: np.ndarray, bad: np.ndarray, min_precision: float = 0.9, min_support: int = 3, max_tests: int = 4, max_rules: int = 20) -> DecisionList:
    """Sequential covering of the ``bad`` rows. Every third row prunes, the others grow."""
    x, rules = ratios(counts), []
    left, prune = np.ones(len(bad), bool), np.arange(len(bad)) % 3 == 2
    cover = lambda rule, m: m & np.logical_and.reduce([t.covers(x) for t in rule])
    while len(rules) < max_rules and (bad & left & ~prune).sum() >= min_support:
        grow = left & ~prune
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_tests)
        if not rule:
            break

        def worth(r: list[Test]) -> float:
            c = cover(r, left & prune)
            tp, fp = (bad & c).sum(), (~bad & c).sum()
            return (tp - fp) / max(1, tp + fp)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        c = cover(rule, left)
        if (bad & c).sum() < min_support or (bad & c).sum() < min_precision * c.sum():
            break
        rules.append(tuple(rule))
        left &= ~c
    return DecisionList(tuple(rules))


def learn_decision_list(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **options) -> DecisionList:
    """Learn from at most ``max_labelled`` labelled documents (the bound of the sample), chosen by a hash of doc_id.

    A document is bad if its ``quality`` label is 0. Conflicting labels of one document: the lowest counts.
    """
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = document_stats(only(docs, "doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(sample), "doc_id").select("doc_id", *COUNTS, "quality").toPandas()
    if not len(rows):
        return DecisionList(())
    rows = rows.sort_values(["doc_id", *COUNTS], kind="stable")
    rows = rows.iloc[np.random.default_rng(7).permutation(len(rows))]
    return learn(rows[COUNTS].to_numpy(), (rows["quality"] == 0).to_numpy(), **options)


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the COUNTS, base_failed, fired (number of the rule, 0: none), kept."""
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return document_stats(docs).withColumns({"base_failed": base, "fired": rules.column()}).withColumn("kept", ~F.col("base_failed") & (F.col("fired") == 0))
