"""The logical plan: what every front end produces and ``lower`` turns into DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Attr:
    """A column by name; ``table`` and ``version`` narrow it down (a version tells two scans of one table apart)."""

    name: str
    table: str | None = None
    version: int | None = None

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: Any

    def __str__(self) -> str:
        return str(self.value)


@dataclass(frozen=True)
class Arith:
    """``+ - * /`` of two expressions, in double precision."""

    op: str
    left: Any
    right: Any

    def __str__(self) -> str:
        return f"({self.left}{self.op}{self.right})"


@dataclass(frozen=True)
class Call:
    """A scalar function by name."""

    name: str
    args: tuple

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.args))})"


@dataclass(frozen=True)
class Compare:
    """``left op right``; op is one of ``< > = <= >= <>``."""

    left: Any
    op: str
    right: Any


@dataclass(frozen=True)
class Matches:
    """The whole string matches a regular expression (what the dialect calls LIKE)."""

    attr: Any
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


@dataclass(frozen=True)
class Aggregate:
    """``func(arg) AS name``; ``by`` orders CONCAT_BASES and IS_HOMOPOLYMER and is the key of MIN_BY."""

    func: str
    arg: Any
    name: str
    by: Any = None
    udf: Any = None


class Node:
    """Any plan node."""


@dataclass(frozen=True)
class Scan(Node):
    table: str
    version: int = 1
    alias: str | None = None


@dataclass(frozen=True)
class Filter(Node):
    child: Node
    predicate: Any


@dataclass(frozen=True)
class Project(Node):
    """Columns in order, as (expression, result name)."""

    child: Node
    columns: tuple


@dataclass(frozen=True)
class Rename(Node):
    child: Node
    names: tuple  # (old, new)


@dataclass(frozen=True)
class Compute(Node):
    """One more column: column algebra, constants, functions."""

    child: Node
    name: str
    expr: Any


@dataclass(frozen=True)
class Join(Node):
    """``how``: inner, left, right, full, left_semi, right_semi, left_anti, right_anti, cross. ``hint``: broadcast the
    right side (dense-key joins), only taken if the right side is a base table below the broadcast bound."""

    left: Node
    right: Node
    how: str = "inner"
    on: Any = None
    dense: bool = False


@dataclass(frozen=True)
class GroupBy(Node):
    """``empty_rows``: a global aggregate over no rows gives no row (the interpreter's way) instead of one."""

    child: Node
    keys: tuple
    aggregates: tuple
    empty_rows: bool = True


@dataclass(frozen=True)
class Sort(Node):
    child: Node
    keys: tuple  # (expression, ascending)


@dataclass(frozen=True)
class Limit(Node):
    child: Node
    n: int


@dataclass(frozen=True)
class Distinct(Node):
    child: Node


@dataclass(frozen=True)
class Append(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class MapUdf(Node):
    """A row-preserving snippet (list of lines) or a Python callable DataFrame -> DataFrame, with declared outputs."""

    child: Node
    outputs: tuple  # (name, type name)
    code: tuple


@dataclass(frozen=True)
class ReduceUdf:
    payload: tuple  # (name, type name, initial value)
    outputs: tuple  # (name, type name)
    code: tuple
    final: tuple


@dataclass(frozen=True)
class TableUdf(Node):
    child: Node
    name: str
    params: tuple = ()


@dataclass(frozen=True)
class Create(Node):
    table: str
    columns: tuple  # (name, type name)
    path: str | None = None
    separator: str = "|"
    register: bool = False


@dataclass(frozen=True)
class Insert(Node):
    table: str
    values: tuple


@dataclass(frozen=True)
class Store(Node):
    child: Node
    table: str
    persist: bool = False


@dataclass(frozen=True)
class Drop(Node):
    table: str


@dataclass(frozen=True)
class RenameTable(Node):
    old: str
    new: str


@dataclass(frozen=True)
class Export(Node):
    child: Node
    path: str
    separator: str = "|"


@dataclass(frozen=True)
class Sink(Node):
    child: Node


@dataclass
class Registry:
    """Table functions by name: DataFrame, parameters -> DataFrame."""

    functions: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, function: Callable) -> None:
        from millrace.types import PlanError

        if name.upper() in self.functions:
            raise PlanError(f"table function {name} exists already")
        self.functions[name.upper()] = function
