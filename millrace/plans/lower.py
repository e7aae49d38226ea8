"""Logical plan -> DataFrame. Nothing runs here but Store, Export and Sink; Catalyst plans the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.functions import genomics
from millrace.functions.snippets import Snippet, references
from millrace.plans import nodes as N
from millrace.plans.rewrite import reduced_keys
from millrace.types import PlanError, spark_type, struct

#: A dense-key side is broadcast only below this many bytes by Spark's own size estimate.
BROADCAST_BYTES = 64 * 1024 * 1024
#: A join on more than equalities deals its streamed side over all cores from this product of Spark's size estimates on.
DEALT_BYTES = 1 << 34


@dataclass(frozen=True)
class Field:
    """Where a column comes from (table, version), its name, and its physical name in the frame."""

    name: str
    column: str
    table: str | None = None
    version: int | None = None
    origin: str | None = None  # its name in the table


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    fields: tuple[Field, ...]

    def find(self, a: N.Attr) -> Field:
        name, table = a.name.upper(), a.table.upper() if a.table else None
        same = [f for f in self.fields if f.name.upper() == name]
        if table == "<COMPUTED>":
            hits = [f for f in same if f.table is None] or same
        elif table:
            hits = [f for f in self.fields if f.table == table and (f.origin == name or f.name.upper() == name) and (a.version is None or f.version == a.version)]
            hits = hits or (same if len(same) == 1 and a.version in (None, 1) else [])
        else:
            hits = [f for f in same if a.version is None or f.version == a.version]
        if not hits:
            raise PlanError(f"no column {f'{a.table}.' if a.table else ''}{a.name} among {', '.join(f.name for f in self.fields)}")
        if len({f.column for f in hits}) > 1:
            raise PlanError(f"column {a.name} is ambiguous: {', '.join(f'{f.table}.{f.origin}.{f.version}' for f in hits)}")
        return hits[0]

    def col(self, a: N.Attr) -> Column:
        return self.df[f"`{self.find(a).column}`"]

    def result(self) -> DataFrame:
        """Columns under their own names; a name that occurs twice gets its table in front."""
        names = [f.name for f in self.fields]
        out = [f.name if names.count(f.name) == 1 else f"{f.table}.{f.name}" + (f".{f.version}" if (f.version or 1) > 1 else "") for f in self.fields]
        return self.df.select(*[F.col(f"`{f.column}`").alias(n) for f, n in zip(self.fields, out, strict=True)])


def _fresh(name: str, taken: set[str]) -> str:
    k, out = 1, name
    while out in taken:
        k += 1
        out = f"{name}~{k}"
    return out


def _parts(p) -> list:
    """The conditions that a condition joins by AND."""
    return [y for x in p.parts for y in _parts(x)] if isinstance(p, N.All) else [p]


def _attrs(x) -> list[N.Attr]:
    """The columns that an expression or a condition names."""
    if isinstance(x, N.Attr):
        return [x]
    inner = [getattr(x, f.name) for f in fields(x)] if is_dataclass(x) else x if isinstance(x, (tuple, list)) else []
    return [a for y in inner for a in _attrs(y)]


SCALARS: dict[str, Callable[..., Column]] = {"EXTRACT_YEAR": lambda c: F.year(c).cast("long"), "COALESCE": F.coalesce, "SQRT": F.sqrt, "POW": F.pow, "ABS": F.abs}
_COMPARE = {"<": Column.__lt__, ">": Column.__gt__, "=": Column.__eq__, "<=": Column.__le__, ">=": Column.__ge__, "<>": Column.__ne__}


class Engine:
    """A catalog, its table functions, and the lowering of plans over them."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark
        self.udfs = N.Registry()
        self.settings: dict[str, str] = {}
        self.udfs.register("LIMIT", lambda df, n: df.limit(int(n)))
        self.udfs.register("EXTRACT_YEAR", lambda df, column, name: df.withColumn(name, F.year(column).cast("long")))

    def execute(self, plan: N.Node) -> DataFrame:
        return self.lower(plan).result()

    # expressions

    def expr(self, f: Frame, e) -> Column:
        if isinstance(e, N.Attr):
            return f.col(e)
        if isinstance(e, N.Const):
            return F.lit(e.value)
        if isinstance(e, N.Arith):
            a, b = (self.expr(f, x).cast("double") for x in (e.left, e.right))
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[e.op]
        if isinstance(e, N.Call) and e.name.upper() in SCALARS:
            return SCALARS[e.name.upper()](*[self.expr(f, x) for x in e.args])
        raise PlanError(f"not an expression: {e}")

    def predicate(self, f: Frame, p) -> Column:
        if isinstance(p, N.All):
            return reduce(Column.__and__, [self.predicate(f, x) for x in p.parts], F.lit(True))
        if isinstance(p, N.AnyOf):
            return reduce(Column.__or__, [self.predicate(f, x) for x in p.parts]) if p.parts else F.lit(True)
        if isinstance(p, N.Matches):
            hit = self.expr(f, p.attr).rlike(rf"\A(?s:{p.pattern})\z")
            return ~hit if p.negated else hit
        if isinstance(p, N.Compare):
            left, right = p.left, p.right
            if isinstance(left, N.Const) and not isinstance(right, N.Const):
                left, right, flip = right, left, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
                return self.predicate(f, N.Compare(left, flip.get(p.op, p.op), right))
            a = self.expr(f, left)
            b = self._constant(f, left, right.value) if isinstance(right, N.Const) else self.expr(f, right)
            return _COMPARE[p.op](a, b)
        raise PlanError(f"not a predicate: {p}")

    def _constant(self, f: Frame, left, value) -> Column:
        """A constant in the column's type: text converts to it, numbers stay numbers."""
        if not isinstance(left, N.Attr):
            return F.lit(value)
        kind = f.df.schema[f.find(left).column].dataType.simpleString()
        if isinstance(value, str) and kind != "string":
            return F.lit(value).cast(kind)
        if not isinstance(value, str) and kind == "string":
            raise PlanError(f"{left} is text, {value} is not")
        return F.lit(value).cast("float") if kind == "float" and isinstance(value, float) else F.lit(value)

    # nodes

    def lower(self, p: N.Node) -> Frame:
        method = getattr(self, f"_{type(p).__name__.lower()}", None)
        if method is None:
            raise PlanError(f"no lowering for {type(p).__name__}")
        return method(p)

    def _wrap(self, df: DataFrame, table: str | None = None) -> Frame:
        return Frame(df, tuple(Field(c, c, table, 1 if table else None, c) for c in df.columns))

    def _scan(self, p: N.Scan) -> Frame:
        t = self.catalog.table(p.table)
        label = (p.alias or t.name).upper()
        names = {c: f"{label}${p.version}${c}" for c in t.df.columns}
        df = t.df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        return Frame(df, tuple(Field(c, n, label, p.version, c) for c, n in names.items()))

    def _filter(self, p: N.Filter) -> Frame:
        f = self.lower(p.child)
        return replace(f, df=f.df.where(self.predicate(f, p.predicate)))

    def _project(self, p: N.Project) -> Frame:
        f = self.lower(p.child)
        cols, fields, taken = [], [], set()
        for e, name in p.columns:
            source = f.find(e) if isinstance(e, N.Attr) else None
            name = name or (source.name if source else str(e))
            column = _fresh(source.column if source else name, taken)
            taken.add(column)
            cols.append(self.expr(f, e).alias(column))
            fields.append(replace(source, name=name, column=column) if source else Field(name, column))
        return Frame(f.df.select(*cols), tuple(fields))

    def _rename(self, p: N.Rename) -> Frame:
        f = self.lower(p.child)
        new = {f.find(N.Attr(o) if isinstance(o, str) else o).column: n for o, n in p.names}
        return replace(f, fields=tuple(replace(x, name=new.get(x.column, x.name)) for x in f.fields))

    def _compute(self, p: N.Compute) -> Frame:
        f = self.lower(p.child)
        column = _fresh(f"<COMPUTED>${p.name}", {x.column for x in f.fields})
        return Frame(f.df.withColumn(column, self.expr(f, p.expr)), (*f.fields, Field(p.name, column)))

    def _join(self, p: N.Join) -> Frame:
        left, right = self.lower(p.left), self.lower(p.right)
        taken = {x.column for x in left.fields}
        moved = {x.column: _fresh(x.column, taken) for x in right.fields}
        if any(a != b for a, b in moved.items()):
            right = Frame(right.df.withColumnsRenamed({a: b for a, b in moved.items() if a != b}), tuple(replace(x, column=moved[x.column]) for x in right.fields))
        both = Frame(left.df, (*left.fields, *right.fields))
        how = p.how.lower()
        if p.on is None and how != "cross":
            raise PlanError("a join needs a condition")
        left, right = self._dealt(left, right, p)
        right_df = self._dense(right.df) if p.dense else right.df
        # the condition names columns of either side; names are unique by now
        on = self._named(both, p.on) if p.on is not None else None
        if how == "cross":
            df = left.df.crossJoin(right.df)
            return Frame(df.where(on) if on is not None else df, both.fields)
        if how in ("right_semi", "right_anti"):
            return Frame(right.df.join(left.df, on, how.replace("right", "left")), right.fields)
        if how in ("left_semi", "left_anti"):
            return Frame(left.df.join(right.df, on, how), left.fields)
        return Frame(left.df.join(right_df, on, how), both.fields)

    def _named(self, f: Frame, p) -> Column:
        class Names(Frame):
            def col(self, a: N.Attr) -> Column:
                return F.col(f"`{self.find(a).column}`")

        names = Names(f.df, f.fields)

        def build(x) -> Column:
            if isinstance(x, N.All):
                return reduce(Column.__and__, [build(y) for y in x.parts], F.lit(True))
            if isinstance(x, N.AnyOf):
                return reduce(Column.__or__, [build(y) for y in x.parts])
            if isinstance(x, N.Compare):
                return _COMPARE[x.op](self.expr(names, x.left), self.expr(names, x.right))
            return self.predicate(names, x)

        return build(p)

    def _dealt(self, left: Frame, right: Frame, p: N.Join) -> tuple[Frame, Frame]:
        """Both sides of a join; where a condition between them is no equality, so that it can give far more rows than it reads,
        the side that Spark does not broadcast is dealt evenly: a small file would make all the pairs in one task."""
        both = Frame(left.df, (*left.fields, *right.fields))
        between = lambda x: len({both.find(a) in left.fields for a in _attrs(x)}) == 2
        if p.how.lower() != "inner" or not any(between(x) for x in _parts(p.on) if not (isinstance(x, N.Compare) and x.op == "=")):
            return left, right
        a, b = self._bytes(left.df), self._bytes(right.df)
        # beyond this limit both sides are shuffled anyway
        if a * b < DEALT_BYTES or min(a, b) > self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
            return left, right
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2 * self.spark.sparkContext.defaultParallelism)
        deal = lambda f: replace(f, df=f.df.repartition(tasks))
        return (deal(left), right) if a >= b else (left, deal(right))

    @staticmethod
    def _bytes(df: DataFrame) -> int:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def _dense(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self._bytes(df) <= BROADCAST_BYTES else df

    def _groupby(self, p: N.GroupBy) -> Frame:
        f = self.lower(p.child)
        keys = [f.find(k) for k in p.keys]
        aggs, fields = [], [replace(k) for k in keys]
        taken = {k.column for k in keys}
        for a in p.aggregates:
            for name, col in self._aggregate(f, a):
                column = _fresh(name, taken)
                taken.add(column)
                aggs.append(col.alias(column))
                fields.append(Field(name, column))
        if not keys:
            if not aggs:
                raise PlanError("a global aggregate needs an aggregate")
            df = f.df.agg(*aggs)
            if not p.empty_rows:
                df = f.df.agg(*aggs, F.count(F.lit(1)).alias("~rows")).where("`~rows` > 0").drop("~rows")
            return Frame(df, tuple(fields))
        kept, dependent = reduced_keys(self.catalog, keys, dict(f.df.dtypes))
        out = f.df.groupBy(*[F.col(f"`{k.column}`") for k in kept]).agg(*[F.first(F.col(f"`{k.column}`")).alias(k.column) for k in dependent], *aggs) if aggs or dependent else f.df.select(*[F.col(f"`{k.column}`") for k in keys]).distinct()
        return Frame(out.select(*[F.col(f"`{x.column}`") for x in fields]), tuple(fields))

    def _aggregate(self, f: Frame, a: N.Aggregate) -> list[tuple[str, Column]]:
        func = a.func.upper()
        if func == "UDF":
            return self._reduce(f, a.udf)
        if func == "COUNT" and a.arg is None:
            return [(a.name, F.count(F.lit(1)))]
        x = self.expr(f, a.arg)
        by = self.expr(f, a.by) if a.by is not None else None
        if func in ("CONCAT_BASES", "IS_HOMOPOLYMER", "MIN_BY") and by is None:
            raise PlanError(f"{func} needs an order column")
        made = {
            "COUNT": lambda: F.count(x), "SUM": lambda: F.sum(x.cast("double")), "MIN": lambda: F.min(x), "MAX": lambda: F.max(x), "AVG": lambda: F.avg(x.cast("double")),
            "AVERAGE": lambda: F.avg(x.cast("double")), "COUNT_DISTINCT": lambda: F.count_distinct(x), "GENOTYPE": lambda: genomics.genotype(x, float(self.settings.get("genotype_frequency_max", 0.8)), float(self.settings.get("genotype_frequency_min", 0.2))),
            "GENOTYPE_STATISTICS": lambda: genomics.genotype_statistics(x), "CONCAT_BASES": lambda: genomics.concat_bases(x, by), "IS_HOMOPOLYMER": lambda: genomics.is_homopolymer(x, by),
        }
        if func == "MIN_BY":
            return [("MIN_VALUE", F.min(by)), (a.name, F.min_by(x, F.struct(by, x)))]
        if func not in made:
            raise PlanError(f"unknown aggregate {a.func}")
        return [(a.name, made[func]())]

    def _snippet_reference(self, f: Frame) -> Callable[[str], Column]:
        def resolve(text: str) -> Column:
            if text.startswith("computed_var_"):
                return f.col(N.Attr(text.removeprefix("computed_var_"), "<COMPUTED>"))
            parts = text.split(".")
            if len(parts) == 1:
                return f.col(N.Attr(parts[0]))
            version = int(parts[2]) if len(parts) > 2 else None
            return f.col(N.Attr(parts[1], parts[0], version))

        return resolve

    def _reduce(self, f: Frame, u: N.ReduceUdf) -> list[tuple[str, Column]]:
        """The general form: fold the group's rows in the payload, then the final code.

        A snippet that keeps the values at a minimum or maximum is an argument of an extreme and becomes ``min_by`` or
        ``max_by``, which aggregates before the shuffle; any other fold needs the group's rows in one place.
        """
        inputs = references("".join(u.code))
        resolve = self._snippet_reference(f)
        known = self._extreme(u, resolve)
        if known is None:
            rows = F.collect_list(F.struct(*[resolve(r).alias(f"i{k}") for k, r in enumerate(inputs)]))
            start = F.struct(*[F.lit(v).cast(spark_type(t)).alias(n.lower()) for n, t, v in u.payload])

            def merge(acc: Column, row: Column) -> Column:
                state = {f"entry:{n.lower()}": acc[n.lower()] for n, _, _ in u.payload}
                at = {r: row[f"i{k}"] for k, r in enumerate(inputs)}
                state = Snippet("".join(u.code), lambda t: at[t], state).run()
                return F.struct(*[state[f"entry:{n.lower()}"].cast(spark_type(t)).alias(n.lower()) for n, t, _ in u.payload])

            total = F.aggregate(rows, start, merge)
            known = {f"entry:{n.lower()}": total[n.lower()] for n, _, _ in u.payload}
        state = Snippet("".join(u.final), lambda t: known[t], dict(known)).run()
        return [(n, state[f"out:{n.lower()}"].cast(spark_type(t))) for n, t in u.outputs]

    @staticmethod
    def _extreme(u: N.ReduceUdf, resolve) -> dict[str, Column] | None:
        """Payload values if the code is ``if (entry.m > x) { entry.m = x; entry.i = y; ... }`` (or ``<``)."""
        import re

        ref = r"(#[^#<>]+#|computed_var_\w+)"
        m = re.fullmatch(rf"if\(#<hash_entry>\.(\w+)#([<>]){ref}\)\{{((?:#<hash_entry>\.\w+#={ref};)+)\}}", re.sub(r"\s+", "", "".join(u.code)), re.I)
        if not m:
            return None
        moved = {n.lower(): resolve(r.strip("#")) for n, r in re.findall(rf"#<hash_entry>\.(\w+)#={ref};", m[4], re.I)}
        if m[1].lower() not in moved or re.search(rf"#<hash_entry>\.{m[1]}#={re.escape(m[3])};", m[4], re.I) is None or set(moved) != {n.lower() for n, _, _ in u.payload}:
            return None
        key, pick, best = resolve(m[3].strip("#")), (F.min_by if m[2] == ">" else F.max_by), {}
        first = {n.lower(): F.lit(v).cast(spark_type(t)) for n, t, v in u.payload}
        tie = F.struct(key, *[moved[n] for n in sorted(moved)]) if m[2] == ">" else F.struct(key, *[-moved[n] for n in sorted(moved)])
        extreme = F.min(key) if m[2] == ">" else F.max(key)
        passes = extreme < first[m[1].lower()] if m[2] == ">" else extreme > first[m[1].lower()]
        for n, col in moved.items():
            best[f"entry:{n}"] = F.when(passes, pick(col, tie)).otherwise(first[n])
        return best

    def _sort(self, p: N.Sort) -> Frame:
        f = self.lower(p.child)
        return replace(f, df=f.df.orderBy(*[(self.expr(f, e).asc() if up else self.expr(f, e).desc()) for e, up in p.keys]))

    def _limit(self, p: N.Limit) -> Frame:
        f = self.lower(p.child)
        return replace(f, df=f.df.limit(p.n))

    def _distinct(self, p: N.Distinct) -> Frame:
        f = self.lower(p.child)
        return replace(f, df=f.df.distinct())

    def _append(self, p: N.Append) -> Frame:
        a, b = self.lower(p.left), self.lower(p.right)
        if [(x.name, a.df.schema[x.column].dataType) for x in a.fields] != [(x.name, b.df.schema[x.column].dataType) for x in b.fields]:
            raise PlanError("only tables of one schema can be appended")
        return Frame(a.df.select(*[F.col(f"`{x.column}`") for x in a.fields]).union(b.df.select(*[F.col(f"`{x.column}`") for x in b.fields])), a.fields)

    def _mapudf(self, p: N.MapUdf) -> Frame:
        f = self.lower(p.child)
        if callable(p.code):
            df = p.code(f.result())
            return self._wrap(df)
        state = Snippet("".join(p.code), self._snippet_reference(f), {}).run()
        cols, fields, taken = {}, list(f.fields), {x.column for x in f.fields}
        for name, kind in p.outputs:
            if f"out:{name.lower()}" not in state:
                raise PlanError(f"the snippet never sets {name}")
            column = _fresh(f"<COMPUTED>${name}", taken)
            taken.add(column)
            cols[column] = state[f"out:{name.lower()}"].cast(spark_type(kind))
            fields.append(Field(name, column))
        return Frame(f.df.withColumns(cols), tuple(fields))

    def _tableudf(self, p: N.TableUdf) -> Frame:
        if p.name.upper() not in self.udfs.functions:
            raise PlanError(f"no table function {p.name}")
        return self._wrap(self.lower(p.child).result().transform(self.udfs.functions[p.name.upper()], *p.params))

    # statements

    def _create(self, p: N.Create) -> Frame:
        from millrace.sources.pipe_csv import read_pipe_csv

        schema = struct([(n.upper(), t) for n, t in p.columns])
        df = read_pipe_csv(self.spark, p.path, schema, p.separator) if p.path else self.spark.createDataFrame([], schema)
        if p.register:
            self.catalog.register(p.table, df)
        return self._wrap(df, p.table.upper())

    def _insert(self, p: N.Insert) -> Frame:
        self.catalog.insert(p.table, p.values)
        return self._scan(N.Scan(p.table))

    def _store(self, p: N.Store) -> Frame:
        f = self.lower(p.child)
        if p.table.upper() in {*self.catalog.tables, *self.catalog.pending}:
            raise PlanError(f"table {p.table} exists already")
        self.catalog.register(p.table, f.result())
        if p.persist:
            folder = self.settings.get("path_to_database")
            if not folder:
                raise PlanError("set path_to_database first")
            self.catalog.save(p.table, folder)
        return f

    def _drop(self, p: N.Drop) -> Frame:
        self.catalog.drop(p.table)
        return self._wrap(self.spark.createDataFrame([(1,)], "RETURN_VALUE int"))

    def _renametable(self, p: N.RenameTable) -> Frame:
        done = self.catalog.rename(p.old, p.new)
        return self._wrap(self.spark.createDataFrame([(int(done),)], "RETURN_VALUE int"))

    def _export(self, p: N.Export) -> Frame:
        from millrace.sources.pipe_csv import write_pipe_csv

        f = self.lower(p.child)
        write_pipe_csv(f.result(), p.path, p.separator)
        return f

    def _sink(self, p: N.Sink) -> Frame:
        f = self.lower(p.child)
        f.result().write.format("noop").mode("overwrite").save()
        return Frame(f.df.limit(0), f.fields)
