"""JSON query plans -> logical plans, with a check of the required members first."""

from __future__ import annotations

import json

from millrace.plans import nodes as N
from millrace.types import PlanError

#: Comparator, join and aggregate names of the plan format.
COMPARATORS = {"LESSER": "<", "LESSER_EQUAL": "<=", "GREATER": ">", "GREATER_EQUAL": ">=", "EQUAL": "=", "UNEQUAL": "<>"}
JOINS = {
    "INNER_JOIN": "inner", "LEFT_OUTER_JOIN": "left", "RIGHT_OUTER_JOIN": "right", "FULL_OUTER_JOIN": "full", "LEFT_SEMI_JOIN": "left_semi",
    "RIGHT_SEMI_JOIN": "right_semi", "LEFT_ANTI_SEMI_JOIN": "left_anti", "RIGHT_ANTI_SEMI_JOIN": "right_anti", "GATHER_JOIN": "inner",
}
#: Members every operator must have, besides its children.
REQUIRED = {
    "TABLE_SCAN": ["TABLE_NAME"], "CREATE_TABLE": ["TABLE_NAME", "TABLE_SCHEMA"], "STORE_TABLE": ["TABLE_NAME"], "DELETE_TABLE": ["TABLE_NAME"], "RENAME_TABLE": ["TABLE_NAME", "NEW_TABLE_NAME"],
    "EXPORT_INTO_FILE": ["PATH_TO_DATA_FILE"], "SINK": [], "GENERIC_SELECTION": ["PREDICATE"], "GENERIC_JOIN": ["PREDICATE"], "CROSS_JOIN": [], "GENERIC_GROUPBY": ["GROUPING_COLUMNS", "AGGREGATION_SPECIFICATION"],
    "PROJECTION": ["ATTRIBUTES"], "RENAME": ["RENAME"], "SORT BY": ["SORT_COLUMNS"], "LIMIT": ["LIMIT"], "MAP_UDF": ["MAP_UDF_OUTPUT_ATTRIBUTES", "MAP_UDF_CODE"],
}
_TWO = {"GENERIC_JOIN", "CROSS_JOIN"}
_NONE = {"TABLE_SCAN", "CREATE_TABLE", "DELETE_TABLE", "RENAME_TABLE"}


def check(plan: dict) -> None:
    """Raise ``PlanError`` at the first operator that is unknown or incomplete."""
    name = plan.get("OPERATOR_NAME")
    if name not in REQUIRED:
        raise PlanError(f"unknown operator {name}")
    missing = [m for m in REQUIRED[name] if m not in plan]
    sides = [] if name in _NONE else ["LEFT_CHILD", "RIGHT_CHILD"] if name in _TWO else ["LEFT_CHILD"]
    missing += [s for s in sides if not plan.get(s)]
    if missing:
        raise PlanError(f"{name} lacks {', '.join(missing)}")
    for s in sides:
        check(plan[s])


def attribute(ref: dict) -> N.Attr:
    return N.Attr(ref["COLUMN_NAME"].upper(), ref["TABLE_NAME"].upper() if ref.get("TABLE_NAME") else None, ref.get("VERSION"))


def constant(value, kind: str | None):
    text = str(value)
    kind = (kind or "").upper()
    if kind in ("INT", "UINT32", "OID", "INTEGER"):
        return int(float(text))
    if kind in ("FLOAT", "DOUBLE", "REAL"):
        return float(text)
    return value if kind == "" and not isinstance(value, str) else text


def predicate(p: dict):
    p = p.get("PREDICATE", p)
    kind = p["PREDICATE_TYPE"].upper()
    if kind in ("AND_PREDICATE", "OR_PREDICATE"):
        return (N.All if kind[0] == "A" else N.AnyOf)(tuple(predicate(x) for x in p["PREDICATES"]))
    op = p["PREDICATE_COMPARATOR"].upper()
    if op not in COMPARATORS:
        raise PlanError(f"unknown comparator {op}")
    left = attribute(p["LEFT_HAND_SIDE_ATTRIBUTE_REFERENCE"])
    if kind == "COLUMN_COLUMN_PREDICATE":
        return N.Compare(left, COMPARATORS[op], attribute(p["RIGHT_HAND_SIDE_ATTRIBUTE_REFERENCE"]))
    if kind == "COLUMN_CONSTANT_PREDICATE":
        return N.Compare(left, COMPARATORS[op], N.Const(constant(p["CONSTANT"], p.get("CONSTANT_TYPE"))))
    raise PlanError(f"unknown predicate {kind}")


def _outputs(items: list[dict]) -> tuple:
    return tuple((x["ATTRIBUTE_NAME"], x["ATTRIBUTE_TYPE"]) for x in items)


def aggregate(x: dict) -> N.Aggregate:
    func = x["AGGREGATION_FUNCTION"].upper()
    if func == "UDF":
        u = x["REDUCE_UDF"]
        payload = tuple((a["ATTRIBUTE_NAME"], a["ATTRIBUTE_TYPE"], float(a["ATTRIBUTE_INIT_VALUE"])) for a in u["REDUCE_UDF_PAYLOAD_ATTRIBUTES"])
        return N.Aggregate("UDF", None, "UDF", udf=N.ReduceUdf(payload, _outputs(u["REDUCE_UDF_OUTPUT_ATTRIBUTES"]), tuple(u["REDUCE_UDF_CODE"]), tuple(u["REDUCE_UDF_FINAL_CODE"])))
    ref = x["ATTRIBUTE_REFERENCE"]
    return N.Aggregate(func, attribute(ref), ref.get("RESULT_NAME") or f"{func}_{ref['COLUMN_NAME']}.{ref.get('VERSION', 1)}")


def build(p: dict) -> N.Node:
    name = p["OPERATOR_NAME"]
    left = build(p["LEFT_CHILD"]) if name not in _NONE else None
    if name == "TABLE_SCAN":
        return N.Scan(p["TABLE_NAME"], p.get("VERSION", 1))
    if name == "GENERIC_SELECTION":
        return N.Filter(left, predicate(p["PREDICATE"]))
    if name == "GENERIC_JOIN":
        how = p.get("JOIN_TYPE", "INNER_JOIN").upper()
        if how not in JOINS:
            raise PlanError(f"unknown join type {how}")
        return N.Join(left, build(p["RIGHT_CHILD"]), JOINS[how], predicate(p["PREDICATE"]), how == "GATHER_JOIN")
    if name == "CROSS_JOIN":
        return N.Join(left, build(p["RIGHT_CHILD"]), "cross")
    if name == "GENERIC_GROUPBY":
        refs = [x["ATTRIBUTE_REFERENCE"] for x in p["GROUPING_COLUMNS"]]
        out = N.GroupBy(left, tuple(attribute(r) for r in refs), tuple(aggregate(x) for x in p["AGGREGATION_SPECIFICATION"]))
        names = tuple((attribute(r), r["RESULT_NAME"]) for r in refs if r.get("RESULT_NAME", r["COLUMN_NAME"]) != r["COLUMN_NAME"])
        return N.Rename(out, names) if names else out
    if name == "PROJECTION":
        refs = [x["ATTRIBUTE_REFERENCE"] for x in p["ATTRIBUTES"]]
        return N.Project(left, tuple((attribute(r), r.get("RESULT_NAME")) for r in refs))
    if name == "RENAME":
        return N.Rename(left, tuple((attribute(x["ATTRIBUTE_REFERENCE"]), x["NEW_NAME"]) for x in p["RENAME"]))
    if name == "SORT BY":
        keys = []
        for c in p["SORT_COLUMNS"]:
            ref = c.get("ATTRIBUTE_REFERENCE", c)
            keys.append((attribute(ref), c.get("ORDER", "ASCENDING").upper().startswith("ASC")))
        return N.Sort(left, tuple(keys))
    if name == "LIMIT":
        return N.Limit(left, int(p["LIMIT"]))
    if name == "MAP_UDF":
        return N.MapUdf(left, _outputs(p["MAP_UDF_OUTPUT_ATTRIBUTES"]), tuple(p["MAP_UDF_CODE"]))
    if name == "CREATE_TABLE":
        return N.Create(p["TABLE_NAME"], _outputs(p["TABLE_SCHEMA"]), p.get("PATH_TO_DATA_FILE"), p.get("FIELD_SEPARATOR", "|"))
    if name == "STORE_TABLE":
        return N.Store(left, p["TABLE_NAME"], bool(p.get("PERSIST_TABLE_ON_DISK", False)))
    if name == "DELETE_TABLE":
        return N.Drop(p["TABLE_NAME"])
    if name == "RENAME_TABLE":
        return N.RenameTable(p["TABLE_NAME"], p["NEW_TABLE_NAME"])
    if name == "EXPORT_INTO_FILE":
        return N.Export(left, p["PATH_TO_DATA_FILE"], p.get("FIELD_SEPARATOR", "|"))
    return N.Sink(left)


def load(text: str) -> N.Node:
    plan = json.loads(text).get("QUERY_PLAN")
    if not plan:
        raise PlanError("no QUERY_PLAN")
    check(plan)
    return build(plan)
