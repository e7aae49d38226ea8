"""Order-insensitive comparison of two results, with a tolerance for floating numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def same_rows(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> bool:
    """Same column names and the same rows in any order. For test-sized results: both come to the driver."""
    if [c.upper() for c in a.columns] != [c.upper() for c in b.columns]:
        return False
    key = lambda r: tuple((v is None, f"{v:.4g}" if isinstance(v, float) else str(v)) for v in r)
    x, y = (sorted(map(tuple, d.collect()), key=key) for d in (a, b))
    near = lambda u, v: math.isclose(u, v, rel_tol=tolerance, abs_tol=tolerance) if isinstance(u, float) and isinstance(v, (int, float)) else u == v
    return len(x) == len(y) and all(near(u, v) for r, s in zip(x, y, strict=True) for u, v in zip(r, s, strict=True))
