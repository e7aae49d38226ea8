"""Map and reduce snippets: a small C-like grammar translated to Spark expressions.

Statements: assignments ``target = expression;`` and ``if (condition) { ... } else { ... }``. Expressions:
numbers, quoted strings, ``+ - * /``, comparisons, ``&& || !``, ``c ? a : b``, sqrt, pow, abs, min, max, ``#TABLE.COL#``,
``#TABLE.COL.version#``, ``#<hash_entry>.field#``, ``#<OUT>.name#``, ``computed_var_NAME`` and local names. Anything else is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.types import PlanError

_TOKEN = re.compile(r"\s*(?:(#[^#]+#)|(\d+\.?\d*(?:[eE][+-]?\d+)?[fFlLuU]?)|(\"[^\"]*\"|'[^']*')|([A-Za-z_]\w*)|(<=|>=|==|!=|&&|\|\||[-+*/(){};=<>!?:,]))")
_FUNCTIONS = {"sqrt": F.sqrt, "pow": F.pow, "abs": F.abs, "fabs": F.abs, "min": F.least, "max": F.greatest}
_TYPES = {"double", "float", "int", "long", "uint32_t", "uint64_t", "auto"}


class Snippet:
    """Runs a snippet symbolically: ``state`` maps target names to Columns."""

    def __init__(self, code: str, resolve: Callable[[str], Column], state: dict[str, Column]):
        self.tokens, at = [], 0
        code = code.rstrip()
        while at < len(code):
            m = _TOKEN.match(code, at)
            if not m:
                raise PlanError(f"snippet not understood at: {code[at : at + 30]}")
            self.tokens.append(next((k, v) for k, v in zip(("ref", "num", "str", "name", "op"), m.groups(), strict=True) if v is not None))
            at = m.end()
        self.at, self.resolve, self.state = 0, resolve, state

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want and self.tokens[self.at][1] != want:
            raise PlanError(f"snippet: expected {want or 'more'}, got {self.peek()}")
        self.at += 1
        return self.tokens[self.at - 1]

    def run(self) -> dict[str, Column]:
        while self.peek() is not None:
            self.statement(None)
        return self.state

    def block(self, guard: Column) -> None:
        if self.peek() == "{":
            self.take("{")
            while self.peek() != "}":
                self.statement(guard)
            self.take("}")
        else:
            self.statement(guard)

    def statement(self, guard: Column | None) -> None:
        if self.peek() == ";":
            self.take()
        elif self.peek() == "if":
            self.take()
            self.take("(")
            test = self.expression()
            self.take(")")
            before = dict(self.state)
            self.block(test)
            then, self.state = self.state, before
            if self.peek() == "else":
                self.take()
                self.block(~test)
            merged = {}
            for k in {**then, **self.state}:
                a, b = then.get(k), self.state.get(k)
                if a is None or b is None:
                    merged[k] = F.when(test, a) if b is None else F.when(~test, b)
                else:
                    merged[k] = a if a is b else F.when(test, a).otherwise(b)
            self.state = merged
        else:
            kind, name = self.take()
            if name in _TYPES:
                kind, name = self.take()
            if kind not in ("ref", "name"):
                raise PlanError(f"snippet: can't assign to {name}")
            self.take("=")
            value = self.expression()
            self.take(";")
            self.state[self.target(name)] = value

    @staticmethod
    def target(name: str) -> str:
        return name.strip("#").lower().replace("<out>.", "out:").replace("<hash_entry>.", "entry:")

    def expression(self) -> Column:
        test = self.either()
        if self.peek() != "?":
            return test
        self.take()
        a = self.expression()
        self.take(":")
        return F.when(test, a).otherwise(self.expression())

    def either(self) -> Column:
        x = self.both()
        while self.peek() == "||":
            self.take()
            x = x | self.both()
        return x

    def both(self) -> Column:
        x = self.comparison()
        while self.peek() == "&&":
            self.take()
            x = x & self.comparison()
        return x

    def comparison(self) -> Column:
        x = self.sum()
        ops = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}
        while self.peek() in ops:
            op = ops[self.take()[1]]
            x = op(x, self.sum())
        return x

    def sum(self) -> Column:
        x = self.product()
        while self.peek() in ("+", "-"):
            x = x + self.product() if self.take()[1] == "+" else x - self.product()
        return x

    def product(self) -> Column:
        x = self.unary()
        while self.peek() in ("*", "/"):
            x = x * self.unary() if self.take()[1] == "*" else x / self.unary()
        return x

    def unary(self) -> Column:
        if self.peek() in ("-", "!", "+"):
            op = self.take()[1]
            x = self.unary()
            return -x if op == "-" else ~x if op == "!" else x
        kind, v = self.take()
        if v == "(":
            x = self.expression()
            self.take(")")
            return x
        if kind == "num":
            return F.lit(float(v.rstrip("fFlLuU")))
        if kind == "str":
            return F.lit(v[1:-1])
        if kind == "name" and self.peek() == "(":
            if v not in _FUNCTIONS:
                raise PlanError(f"snippet: unknown function {v}")
            self.take("(")
            args = [self.expression()]
            while self.peek() == ",":
                self.take()
                args.append(self.expression())
            self.take(")")
            return _FUNCTIONS[v](*args)
        if kind in ("ref", "name"):
            key = self.target(v)
            return self.state[key] if key in self.state else self.resolve(v.strip("#"))
        raise PlanError(f"snippet: unexpected {v}")


def references(code: str) -> list[str]:
    """Input references of a snippet, in order, each once."""
    found = [m[1] for m in re.finditer(r"#([^#]+)#", code)] + re.findall(r"\bcomputed_var_\w+", code)
    return list(dict.fromkeys(x for x in found if not x.lower().startswith(("<out>", "<hash_entry>"))))
