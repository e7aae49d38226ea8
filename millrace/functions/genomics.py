"""Genomics aggregates as compositions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases in test order; X stands for a deletion.
BASES = ("A", "C", "G", "T", "X")


def _counts(base: Column) -> dict[str, Column]:
    return {b: F.count_if(base == b) for b in BASES}


def genotype(base: Column, high: float = 0.8, low: float = 0.2) -> Column:
    """One base with a share of ``high`` or more, tested in order; else those with ``low`` or more (X needs ``high``); else N."""
    counts = _counts(base)
    total = sum(counts.values(), F.lit(0))
    share = {b: F.when(total > 0, counts[b] / total).otherwise(F.lit(0.0)) for b in BASES}
    out = None
    for b in BASES:
        out = F.when(share[b] >= high, b) if out is None else out.when(share[b] >= high, b)
    mixed = F.concat(*[F.when(share[b] >= low, b).otherwise("") for b in BASES if b != "X"])
    return out.otherwise(F.when(mixed != "", mixed).otherwise("N"))


def genotype_statistics(base: Column) -> Column:
    counts = _counts(base)
    parts = [F.lit("[")] + [x for b in BASES for x in (F.lit(f"{b}:"), counts[b].cast("string"), F.lit(", "))]
    return F.concat(*parts, F.lit("SUM:"), sum(counts.values(), F.lit(0)).cast("string"), F.lit("]"))


def concat_bases(base: Column, order: Column) -> Column:
    """The bases in the order of ``order`` (ties by base)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), base.alias("b")))), lambda x: x["b"]), "")


def is_homopolymer(base: Column, order: Column) -> Column:
    """1 if the last run of one base (A, C, G, T) is longer than 3."""
    return F.when(concat_bases(base, order).rlike("(A{4,}|C{4,}|G{4,}|T{4,})$"), 1).otherwise(0)
