"""Rewrites that need the catalog's keys; all others are Catalyst's."""

from __future__ import annotations

from millrace.catalog import Catalog


#: Types that fit an aggregation buffer in place; ``first`` over others would force a sort instead of hashing.
FIXED = ("int", "bigint", "smallint", "float", "double", "date", "boolean")


def reduced_keys(catalog: Catalog, keys: list, types: dict[str, str]) -> tuple[list, list]:
    """Split grouping columns into those to group by and fixed-width ones that a table's primary key among them determines."""
    primary = {t.name: t.primary_key for t in catalog.tables.values()}
    keyed = {(k.table, k.version) for k in keys if k.table and primary.get(k.table) == k.origin}
    dependent = [k for k in keys if (k.table, k.version) in keyed and primary[k.table] != k.origin and types[k.column] in FIXED]
    return [k for k in keys if k not in dependent], dependent
