"""The SQL dialect: a recursive-descent parser from text to logical plans.

Names are upper-cased unless double-quoted. LIKE is a regular expression over the whole string. Joins are
``JOIN ... ON`` (INNER, and LEFT/RIGHT/FULL OUTER) or a comma list. Constructs outside the dialect raise ``PlanError``.
"""

from __future__ import annotations

import re

from millrace.plans import nodes as N
from millrace.types import PlanError

_TOKEN = re.compile(r"\s+|--[^\n]*|(?P<str>'(?:[^']|'')*')|(?P<quoted>\"[^\"]+\")|(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|<>|!=|[-+*/(),.;=<>])")
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "GENOTYPE", "GENOTYPE_STATISTICS", "CONCAT_BASES", "IS_HOMOPOLYMER", "MIN_BY"}
_RESERVED = {"SELECT", "FROM", "WHERE", "GROUP", "ORDER", "SORT", "BY", "HAVING", "LIMIT", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "ON", "AND", "OR", "NOT", "AS", "LIKE", "BETWEEN", "IN", "IS", "UNION", "ASC", "DESC", "CROSS", "NATURAL", "EXISTS"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PlanError(f"not understood: {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup == "str":
            out.append(("str", m["str"][1:-1].replace("''", "'")))
        elif m.lastgroup == "quoted":
            out.append(("name", m["quoted"][1:-1]))
        elif m.lastgroup == "name":
            word = m["name"].upper()
            out.append(("word" if word in _RESERVED else "name", word))
        elif m.lastgroup:
            out.append((m.lastgroup, "<>" if m.group() == "!=" else m.group()))
    return out


class Parser:
    def __init__(self, text: str):
        self.t, self.at = _tokens(text), 0

    def peek(self, k: int = 0) -> str | None:
        return self.t[self.at + k][1] if self.at + k < len(self.t) and self.t[self.at + k][0] != "str" else None

    def accept(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.accept(word):
            raise PlanError(f"expected {word}, got {self.t[self.at][1] if self.at < len(self.t) else 'the end'}")

    def take(self, kind: str) -> str:
        if self.at >= len(self.t) or self.t[self.at][0] != kind:
            raise PlanError(f"expected a {kind}, got {self.t[self.at][1] if self.at < len(self.t) else 'the end'}")
        self.at += 1
        return self.t[self.at - 1][1]

    # statements

    def statement(self) -> N.Node:
        if self.accept("CREATE", "TABLE"):
            out = self.create()
        elif self.accept("INSERT", "INTO"):
            out = self.insert()
        elif self.accept("DROP", "TABLE"):
            out = N.Drop(self.take("name"))
        elif self.peek() == "SELECT":
            out = self.select()
        else:
            raise PlanError(f"unsupported statement {self.t[0][1] if self.t else ''}")
        self.accept(";")
        if self.at != len(self.t):
            raise PlanError(f"unsupported: {self.t[self.at][1]}")
        return out

    def create(self) -> N.Node:
        table, columns = self.take("name"), []
        self.expect("(")
        while True:
            name, kind = self.take("name"), self.take("name")
            if kind in ("UNSIGNED", "DOUBLE") and self.at < len(self.t) and self.t[self.at][0] == "name":
                kind += f" {self.take('name')}"
            if self.accept("("):
                self.take("num")
                self.expect(")")
            columns.append((name, kind))
            if not self.accept(","):
                break
        self.expect(")")
        return N.Create(table, tuple(columns), register=True)

    def insert(self) -> N.Node:
        table = self.take("name")
        self.expect("VALUES")
        self.expect("(")
        values = []
        while True:
            sign = -1 if self.accept("-") else 1
            kind, v = self.t[self.at]
            if kind not in ("num", "str"):
                raise PlanError(f"{v} is not a literal value")
            self.at += 1
            values.append(v if kind == "str" else sign * _number(v))
            if not self.accept(","):
                break
        self.expect(")")
        return N.Insert(table, tuple(values))

    def select(self) -> N.Node:
        self.expect("SELECT")
        distinct = self.accept("DISTINCT")
        self.accept("ALL")
        star, items = self.accept("*"), []
        while not star:
            e = self.expression(aggregates=True)
            named = self.accept("AS")
            name = self.take("name") if named or (self.at < len(self.t) and self.t[self.at][0] == "name" and self.peek() not in ("SORT",)) else None
            items.append((e, name))
            if not self.accept(","):
                break
        self.expect("FROM")
        plan = self.table()
        while self.accept(","):
            plan = N.Join(plan, self.table(), "cross")
        if self.accept("WHERE"):
            plan = N.Filter(plan, self.condition())
        keys = []
        if self.accept("GROUP", "BY"):
            keys = self.names()
        having = self.condition(True) if self.accept("HAVING") else None
        order = []
        if self.accept("ORDER", "BY") or self.accept("SORT", "BY"):
            while True:
                e = self.expression(aggregates=True)
                up = not self.accept("DESC")
                self.accept("ASC")
                order.append((e, up))
                if not self.accept(","):
                    break
        limit = int(self.take("num")) if self.accept("LIMIT") else None
        return build_select(plan, star, items, keys, having, order, limit, distinct)

    def names(self) -> list[N.Attr]:
        out = [self.attribute()]
        while self.accept(","):
            out.append(self.attribute())
        return out

    def table(self) -> N.Node:
        left = self.primary_table()
        while True:
            how = None
            if self.accept("JOIN") or self.accept("INNER", "JOIN"):
                how = "inner"
            for side in ("LEFT", "RIGHT", "FULL"):
                if self.accept(side, "OUTER", "JOIN") or self.accept(side, "JOIN"):
                    how = side.lower()
            if self.accept("CROSS", "JOIN"):
                left = N.Join(left, self.primary_table(), "cross")
                continue
            if how is None:
                return left
            right = self.primary_table()
            self.expect("ON")
            left = N.Join(left, right, how, self.condition())

    def primary_table(self) -> N.Node:
        if self.accept("("):
            inner = self.select() if self.peek() == "SELECT" else self.table()
            self.expect(")")
            return inner
        name = self.take("name")
        self.accept("AS")
        alias = self.take("name") if self.at < len(self.t) and self.t[self.at][0] == "name" else None
        return N.Scan(name, 1, alias)

    # conditions and expressions

    def condition(self, aggregates: bool = False):
        parts = [self.conjunction(aggregates)]
        while self.accept("OR"):
            parts.append(self.conjunction(aggregates))
        return parts[0] if len(parts) == 1 else N.AnyOf(tuple(parts))

    def conjunction(self, aggregates: bool):
        parts = [self.test(aggregates)]
        while self.accept("AND"):
            parts.append(self.test(aggregates))
        return parts[0] if len(parts) == 1 else N.All(tuple(parts))

    def test(self, aggregates: bool):
        if self.peek() in ("NOT", "EXISTS"):
            raise PlanError(f"unsupported: {self.peek()}")
        if self.peek() == "(":
            start = self.at
            try:
                self.accept("(")
                inner = self.condition(aggregates)
                self.expect(")")
                return inner
            except PlanError:  # an expression in parentheses, not a condition
                self.at = start
        left = self.expression(aggregates)
        negated = self.accept("NOT")
        if self.accept("LIKE"):
            pattern = self.take("str")
            if self.accept("ESCAPE"):
                self.take("str")
            return N.Matches(left, pattern, negated)
        if self.accept("BETWEEN"):
            low = self.expression(aggregates)
            self.expect("AND")
            high = self.expression(aggregates)
            return N.AnyOf((N.Compare(left, "<", low), N.Compare(left, ">", high))) if negated else N.All((N.Compare(left, ">=", low), N.Compare(left, "<=", high)))
        if negated or self.peek() in ("IN", "IS"):
            raise PlanError(f"unsupported: {'NOT ' * negated}{self.peek()}")
        op = self.take("op")
        if op not in ("<", ">", "=", "<=", ">=", "<>"):
            raise PlanError(f"not a comparison: {op}")
        return N.Compare(left, op, self.expression(aggregates))

    def expression(self, aggregates: bool = False):
        e = self.term(aggregates)
        while self.peek() in ("+", "-"):
            e = N.Arith(self.take("op"), e, self.term(aggregates))
        return e

    def term(self, aggregates: bool):
        e = self.factor(aggregates)
        while self.peek() in ("*", "/"):
            e = N.Arith(self.take("op"), e, self.factor(aggregates))
        return e

    def factor(self, aggregates: bool):
        if self.accept("-"):
            e = self.factor(aggregates)
            return N.Const(-e.value) if isinstance(e, N.Const) else N.Arith("-", N.Const(0), e)
        if self.accept("+"):
            return self.factor(aggregates)
        if self.accept("("):
            if self.peek() == "SELECT":
                raise PlanError("unsupported: scalar subquery")
            e = self.expression(aggregates)
            self.expect(")")
            return e
        kind, v = self.t[self.at] if self.at < len(self.t) else ("end", "the end")
        if kind == "num":
            self.at += 1
            return N.Const(_number(v))
        if kind == "str":
            self.at += 1
            return N.Const(v)
        if kind == "name" and self.peek(1) == "(":
            return self.call(aggregates)
        return self.attribute()

    def call(self, aggregates: bool):
        name = self.take("name")
        self.expect("(")
        if name in AGGREGATES:
            if not aggregates:
                raise PlanError(f"{name} is not allowed here")
            if name == "COUNT" and self.accept("*"):
                self.expect(")")
                return N.Aggregate("COUNT", None, "COUNT")
            unique = self.accept("DISTINCT")
            if unique and name != "COUNT":
                raise PlanError(f"unsupported: {name}(DISTINCT ...)")
            arg = self.expression()
            by = self.expression() if self.accept(",") else None
            self.expect(")")
            return N.Aggregate("COUNT_DISTINCT" if unique else name, arg, str(arg), by)
        args = [self.expression()]
        while self.accept(","):
            args.append(self.expression())
        self.expect(")")
        return N.Call(name, tuple(args))

    def attribute(self) -> N.Attr:
        name = self.take("name")
        return N.Attr(self.take("name"), name) if self.accept(".") else N.Attr(name)


def _number(text: str):
    return float(text) if re.search("[.eE]", text) else int(text)


def build_select(plan, star, items, keys, having, order, limit, distinct) -> N.Node:
    """Clauses in the dialect's order: arithmetic, grouping, having, sort, limit, projection."""
    aggregates = [(e, n) for e, n in items if isinstance(e, N.Aggregate)]
    if not aggregates and not keys:
        if having is not None:
            raise PlanError("HAVING needs a grouping")
        names = {n: e for e, n in items if n}
        order = [(names.get(e.name, e) if isinstance(e, N.Attr) and not e.table else e, up) for e, up in order]
        if distinct:  # rows must be distinct before they are counted, so the sort sees only what is selected
            plan = N.Distinct(plan if star else N.Project(plan, tuple(items)))
            plan = N.Sort(plan, tuple((N.Attr(next((n or e.name) for f, n in items if f == e)) if not star and any(f == e for f, _ in items) else e, up) for e, up in order)) if order else plan
            return N.Limit(plan, limit) if limit is not None else plan
        plan = N.Sort(plan, tuple(order)) if order else plan
        plan = N.Limit(plan, limit) if limit is not None else plan
        return plan if star else N.Project(plan, tuple(items))
    if star:
        raise PlanError("SELECT * can't be grouped")
    plain = [(e, n) for e, n in items if not isinstance(e, N.Aggregate)]
    if any(not isinstance(e, N.Attr) for e, _ in plain):
        raise PlanError("only plain columns may be grouped, and aggregates can't be part of an expression")
    if sorted(e.name for e, _ in plain) != sorted(k.name for k in keys):
        raise PlanError("GROUP BY columns must be the non-aggregate SELECT columns")
    if not aggregates:
        raise PlanError("GROUP BY needs an aggregate")
    made, seen = [], {}
    for k, (a, name) in enumerate(aggregates):
        arg = a.arg
        if arg is not None and not isinstance(arg, N.Attr):
            column = f"~arg{k}"
            plan = N.Compute(plan, column, arg)
            arg = N.Attr(column)
        seen[a] = name or a.name
        made.append(N.Aggregate(a.func, arg, name or a.name, a.by))
    plan = N.GroupBy(plan, tuple(keys), tuple(made))
    out = lambda e: N.Attr(seen[e]) if isinstance(e, N.Aggregate) and e in seen else e
    if having is not None:
        plan = N.Filter(plan, _replace(having, out))
    plan = N.Sort(plan, tuple((out(e), up) for e, up in order)) if order else plan
    plan = N.Limit(plan, limit) if limit is not None else plan
    renamed = {e.name: n for e, n in plain if n and n != e.name}
    plan = N.Rename(plan, tuple(renamed.items())) if renamed else plan
    return N.Distinct(plan) if distinct else plan


def _replace(p, out):
    if isinstance(p, (N.All, N.AnyOf)):
        return type(p)(tuple(_replace(x, out) for x in p.parts))
    if isinstance(p, N.Compare):
        return N.Compare(out(p.left), p.op, out(p.right))
    return p


def parse(text: str) -> N.Node:
    return Parser(text).statement()
