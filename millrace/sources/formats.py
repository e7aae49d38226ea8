"""Text of a result: table, csv or sam."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame

from millrace.types import PlanError


def render(df: DataFrame, kind: str = "table", limit: int = 10_000) -> Iterator[str]:
    """The text of a result, in parts of at most ``limit`` rows: csv and sam hold all rows, a partition at a time
    on the driver; a table, for a person to read, is one part, and says if there are more rows than that."""
    text = lambda r: ["" if v is None else str(v) for v in r]
    if kind in ("csv", "sam"):
        lines = ("|".join(text(r)) if kind == "csv" else "\t".join(text(r)) for r in df.toLocalIterator())
        yield "\n".join([*(["|".join(df.columns)] if kind == "csv" else []), *itertools.islice(lines, limit)])
        while part := list(itertools.islice(lines, limit)):
            yield "\n".join(part)
        return
    if kind != "table":
        raise PlanError(f"unknown format {kind}")
    rows = [text(r) for r in df.limit(limit + 1).collect()]
    more, rows = len(rows) > limit, rows[:limit]
    width = [max(len(x) for x in c) for c in zip(df.columns, *rows, strict=True)] if df.columns else []
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) + " |"
    bar = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    yield "\n".join([bar, line(df.columns), bar, *map(line, rows), bar, f"first {len(rows)} rows, more left out" if more else f"{len(rows)} rows"])
