"""The query catalogue over the standard tables, each with equivalent SQL for the oracle.

Every entry is a plan, dialect text or JSON plan run by the engine; result columns are lower-cased.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.kmeans import assign, kmeans
from millrace.plans import nodes as N
from millrace.session import Session
from millrace.sources.pipe_csv import read_self_describing, write_pipe_csv, write_self_describing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

A, C = N.Attr, N.Const
LINEITEM, ORDERS, CUSTOMER, PART, SUPPLIER, NATION, REGION = (N.Scan(t) for t in ("lineitem", "orders", "customer", "part", "supplier", "nation", "region"))


#: Doubles are cut to cents as floor(x * 100 + SHIFT) / 100 on both sides: sums may differ in their last bits, and their
#: exact values (multiples of 1e-6 at most) never lie on this boundary, as they often do on halves of a cent.
SHIFT = 0.50337


def cents(c: Column) -> Column:
    return F.floor(c * 100 + SHIFT) / 100


def lowered(df: DataFrame) -> DataFrame:
    """Lower-case names; doubles in cents, dates as text."""
    cols = [F.col(f"`{c}`").cast("string").alias(c.lower()) if t == "date" else cents(F.col(f"`{c}`")).alias(c.lower()) if t == "double" else F.col(f"`{c}`").alias(c.lower()) for c, t in df.dtypes]
    return df.select(*cols)


def add(name: str, oracle: str | None, plan: N.Node | str | Callable[[Session], DataFrame], views: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session.over(spark, sf_dir)
        if views:
            star_schema(s)
        if isinstance(plan, str):
            return lowered(s.json(plan) if plan.lstrip().startswith("{") else s.sql(plan))
        return lowered(s.run(plan) if isinstance(plan, N.Node) else plan(s))

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = _cents_sql(oracle)


def _cents_sql(sql: str) -> str:
    """``round(x, 2)`` written out as the catalogue's cut to cents."""
    while (at := sql.find("round(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}floor(({sql[at + 6 : end - 4]}) * 100 + {SHIFT}) / 100{sql[end:]}"
    return sql


def star_schema(s: Session) -> None:
    """The star schema as views over the standard tables; nothing is materialised."""
    t = {n: s.catalog.table(n).df for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    place = t["nation"].join(t["region"], F.col("N_REGIONKEY") == F.col("R_REGIONKEY"))
    place = place.select("N_NATIONKEY", "N_NAME", "R_NAME")
    views = {
        "S_CUSTOMER": t["customer"].join(place, F.col("C_NATIONKEY") == F.col("N_NATIONKEY")).select(F.col("C_CUSTKEY").alias("SC_CUSTKEY"), F.col("N_NAME").alias("SC_NATION"), F.col("R_NAME").alias("SC_REGION"), F.col("C_MKTSEGMENT").alias("SC_CITY")),
        "S_SUPPLIER": t["supplier"].join(place, F.col("S_NATIONKEY") == F.col("N_NATIONKEY")).select(F.col("S_SUPPKEY").alias("SS_SUPPKEY"), F.col("N_NAME").alias("SS_NATION"), F.col("R_NAME").alias("SS_REGION"), F.col("S_NAME").alias("SS_CITY")),
        "S_PART": t["part"].select(F.col("P_PARTKEY").alias("SP_PARTKEY"), F.col("P_BRAND").alias("SP_BRAND"), F.col("P_TYPE").alias("SP_CATEGORY"), F.col("P_NAME").alias("SP_MFGR")),
        "DATES": t["orders"].select(F.col("O_ORDERDATE").alias("D_DATEKEY")).distinct().select("D_DATEKEY", F.year("D_DATEKEY").cast("long").alias("D_YEAR"), (F.year("D_DATEKEY") * 100 + F.month("D_DATEKEY")).cast("long").alias("D_YEARMONTHNUM"), F.weekofyear("D_DATEKEY").cast("long").alias("D_WEEKNUMINYEAR")),
        "LINEORDER": t["lineitem"].join(t["orders"], F.col("L_ORDERKEY") == F.col("O_ORDERKEY")).select(
            F.col("L_ORDERKEY").alias("LO_ORDERKEY"), F.col("O_CUSTKEY").alias("LO_CUSTKEY"), F.col("L_PARTKEY").alias("LO_PARTKEY"), F.col("L_SUPPKEY").alias("LO_SUPPKEY"), F.col("O_ORDERDATE").alias("LO_ORDERDATE"),
            F.col("L_QUANTITY").alias("LO_QUANTITY"), F.col("L_EXTENDEDPRICE").alias("LO_EXTENDEDPRICE"), F.col("L_DISCOUNT").alias("LO_DISCOUNT"), (F.col("L_EXTENDEDPRICE") * (1 - F.col("L_DISCOUNT"))).alias("LO_REVENUE"), (F.col("L_EXTENDEDPRICE") * F.lit(0.6)).alias("LO_SUPPLYCOST")),
    }
    for name, df in views.items():
        s.catalog.register(name, df)


_STAR = """WITH place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
s_customer AS (SELECT c_custkey sc_custkey, n_name sc_nation, r_name sc_region, c_mktsegment sc_city FROM customer JOIN place ON c_nationkey = n_nationkey),
s_supplier AS (SELECT s_suppkey ss_suppkey, n_name ss_nation, r_name ss_region, s_name ss_city FROM supplier JOIN place ON s_nationkey = n_nationkey),
s_part AS (SELECT p_partkey sp_partkey, p_brand sp_brand, p_type sp_category, p_name sp_mfgr FROM part),
dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) d_datekey, year(o_orderdate) d_year, year(o_orderdate) * 100 + month(o_orderdate) d_yearmonthnum, weekofyear(o_orderdate) d_weeknuminyear FROM orders),
lineorder AS (SELECT l_orderkey lo_orderkey, o_custkey lo_custkey, l_partkey lo_partkey, l_suppkey lo_suppkey, CAST(o_orderdate AS DATE) lo_orderdate, l_quantity lo_quantity, l_extendedprice lo_extendedprice, l_discount lo_discount,
  l_extendedprice * (1 - l_discount) lo_revenue, l_extendedprice * 0.6 lo_supplycost FROM lineitem JOIN orders ON l_orderkey = o_orderkey) """

# scans, projection, computed columns

add("scan_all", "SELECT * FROM nation", NATION)
add("project", "SELECT c_name, c_custkey FROM customer", N.Project(CUSTOMER, ((A("C_NAME"), None), (A("C_CUSTKEY"), None))))
add("project_alias", "SELECT c_name AS who, c_custkey AS id FROM customer", "select c_name as who, c_custkey as id from customer")
add("rename", "SELECT r_regionkey AS key, r_name AS label FROM region", N.Rename(REGION, (("R_REGIONKEY", "KEY"), ("R_NAME", "LABEL"))))
add("const_column", "SELECT r_regionkey, r_name, CAST(7 AS INTEGER) AS seven, 'x' AS tag FROM region", N.Compute(N.Compute(REGION, "SEVEN", C(7)), "TAG", C("x")))
for _n, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    add(f"col_algebra_{_n}", f"SELECT p_partkey, round(p_retailprice {_op} p_size, 2) AS v FROM part", N.Project(N.Compute(PART, "V", N.Arith(_op, A("P_RETAILPRICE"), A("P_SIZE"))), ((A("P_PARTKEY"), None), (A("V"), None))))
    add(f"col_const_{_n}", f"SELECT p_partkey, round(p_retailprice {_op} 3, 2) AS v FROM part", f"select p_partkey, p_retailprice {_op} 3 as v from part")
add("unary_minus", "SELECT c_custkey, round(-c_acctbal, 2) AS v FROM customer", "select c_custkey, -c_acctbal as v from customer")
add("extract_year", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders", "select o_orderkey, extract_year(o_orderdate) as y from orders")

# selections

for _n, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "<>")):
    add(f"sel_{_n}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 20", f"select p_partkey, p_size from part where p_size {_op} 20")
add("sel_literal_first", "SELECT p_partkey FROM part WHERE p_size > 40", "select p_partkey from part where 40 < p_size")
add("sel_ne_absent", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'NONE SUCH'", "select c_custkey from customer where c_mktsegment <> 'NONE SUCH'")
add("sel_col_col", "SELECT count(*) AS n FROM lineitem WHERE l_tax < l_discount", "select count(l_orderkey) as n from lineitem where l_tax < l_discount")
add("sel_cnf", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity < 5 OR l_discount > 0.09) AND (l_returnflag = 'R' OR l_linestatus = 'O')", "select l_orderkey, l_linenumber, l_quantity from lineitem where (l_quantity < 5 or l_discount > 0.09) and (l_returnflag = 'R' or l_linestatus = 'O')")
add("sel_tree", "SELECT p_partkey FROM part WHERE (p_size < 5 AND p_brand = 'Brand#1') OR (p_size > 45 AND (p_brand = 'Brand#2' OR p_retailprice > 1500))",
    N.Project(N.Filter(PART, N.AnyOf((N.All((N.Compare(A("P_SIZE"), "<", C(5)), N.Compare(A("P_BRAND"), "=", C("Brand#1")))), N.All((N.Compare(A("P_SIZE"), ">", C(45)), N.AnyOf((N.Compare(A("P_BRAND"), "=", C("Brand#2")), N.Compare(A("P_RETAILPRICE"), ">", C(1500))))))))), ((A("P_PARTKEY"), None),)))
add("sel_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", "select p_partkey from part where p_size between 10 and 20")
add("sel_not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20", "select p_partkey from part where p_size not between 10 and 20")
add("sel_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '1998-09-02' AND o_orderdate < DATE '1999-01-01'", "select o_orderkey, o_orderdate from orders where o_orderdate >= '1998-9-02' and o_orderdate < '1999-01-01'")
add("sel_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, 'red.*|.*widget')", "select p_partkey, p_name from part where p_name like 'red.*|.*widget'")
add("sel_not_regex", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_full_match(p_name, 'red.*')", "select p_partkey, p_name from part where p_name not like 'red.*'")
add("sel_empty_cnf", "SELECT * FROM region", N.Filter(REGION, N.All(())))

# joins

_OL = N.Compare(A("O_ORDERKEY"), "=", A("L_ORDERKEY"))
_EARLY = N.Filter(ORDERS, N.Compare(A("O_ORDERDATE"), "<", C("1995-07-01")))
_CUST_ORDER = N.Compare(A("C_CUSTKEY"), "=", A("O_CUSTKEY"))
_ONE = ((A("C_CUSTKEY"), None), (A("C_NAME"), None))
_TWO = tuple((N.Call("COALESCE", (A(c), C(-1))), c) for c in ("C_CUSTKEY", "O_ORDERKEY"))
_DEAR = N.Filter(ORDERS, N.Compare(A("O_TOTALPRICE"), ">", C(400000)))
add("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "select n_name, r_name from nation join region on (n_regionkey = r_regionkey)")
add("join_two_conditions", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal", N.Project(N.Join(CUSTOMER, SUPPLIER, "inner", N.All((N.Compare(A("C_NATIONKEY"), "=", A("S_NATIONKEY")), N.Compare(A("C_ACCTBAL"), "<", A("S_ACCTBAL"))))), ((A("C_CUSTKEY"), None), (A("S_SUPPKEY"), None))))
for _how, _sql in (("left_semi", "EXISTS"), ("left_anti", "NOT EXISTS")):
    _q = f"SELECT c_custkey, c_name FROM customer WHERE {_sql} (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < DATE '1995-07-01')"
    add(f"join_{_how}", _q, N.Project(N.Join(CUSTOMER, _EARLY, _how, _CUST_ORDER), _ONE))
    add(f"join_{_how.replace('left', 'right')}", _q, N.Project(N.Join(_EARLY, CUSTOMER, _how.replace("left", "right"), _CUST_ORDER), _ONE))
for _how in ("left", "right", "full"):
    add(f"join_{_how}_outer", f"SELECT coalesce(c_custkey, -1) AS c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) {_how.upper()} JOIN (SELECT * FROM orders WHERE o_orderdate < DATE '1995-07-01') ON c_custkey = o_custkey", N.Project(N.Join(N.Filter(CUSTOMER, N.Compare(A("C_ACCTBAL"), ">", C(0))), _EARLY, _how, _CUST_ORDER), _TWO))
add("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", N.Project(N.Join(NATION, REGION, "cross"), ((A("N_NAME"), None), (A("R_NAME"), None))))
add("join_comma_list", "SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'", "select c_custkey, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'")
add("join_gather", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", N.Project(N.Join(CUSTOMER, NATION, "inner", N.Compare(A("C_NATIONKEY"), "=", A("N_NATIONKEY")), dense=True), ((A("C_CUSTKEY"), None), (A("N_NAME"), None))))
add("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", N.Project(N.Filter(N.Join(N.Scan("nation", 1), N.Scan("nation", 2), "inner", N.Compare(A("N_REGIONKEY", "NATION", 1), "=", A("N_REGIONKEY", "NATION", 2))), N.Compare(A("N_NATIONKEY", "NATION", 1), "<", A("N_NATIONKEY", "NATION", 2))), ((A("N_NAME", "NATION", 1), "X"), (A("N_NAME", "NATION", 2), "Y"))))
add("join_theta", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey", N.Project(N.Join(NATION, REGION, "inner", N.Compare(A("N_REGIONKEY"), "<", A("R_REGIONKEY"))), ((A("N_NATIONKEY"), None), (A("R_REGIONKEY"), None))))
add("join_star", "SELECT n_name, p_brand, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size < 10 GROUP BY ALL", "select n_name, p_brand, sum(l_extendedprice) as v from lineitem join part on (l_partkey = p_partkey) join supplier on (l_suppkey = s_suppkey) join nation on (s_nationkey = n_nationkey) where p_size < 10 group by n_name, p_brand")
add("join_subselect", "SELECT c_custkey, total FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey", "select c_custkey, total from customer join (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey) on (c_custkey = o_custkey)")

# aggregation

for _f in ("count", "sum", "min", "max", "avg"):
    _v = "l_extendedprice" if _f != "count" else "l_quantity"
    _o = f"{_f}({_v})" if _f == "count" else f"round({_f}({_v}), 2)"
    add(f"agg_{_f}", f"SELECT {_o} AS v FROM lineitem", f"select {_f}({_v}) as v from lineitem")
    add(f"agg_{_f}_grouped", f"SELECT l_returnflag, l_linestatus, {_o} AS v FROM lineitem GROUP BY ALL", f"select l_returnflag, l_linestatus, {_f}({_v}) as v from lineitem group by l_returnflag, l_linestatus")
add("agg_empty_input", "SELECT sum(p_size)::DOUBLE AS s, count(p_size) AS n FROM part WHERE p_size > 1000", "select sum(p_size) as s, count(p_size) as n from part where p_size > 1000")
add("agg_empty_rows", "SELECT sum(p_size)::DOUBLE AS s FROM part WHERE p_size > 1000 HAVING count(*) > 0", N.GroupBy(N.Filter(PART, N.Compare(A("P_SIZE"), ">", C(1000))), (), (N.Aggregate("SUM", A("P_SIZE"), "S"),), empty_rows=False))
add("agg_having", "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 12", "select o_custkey, count(o_orderkey) as n from orders group by o_custkey having n > 12")
add("agg_keeps_argument_name", "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY l_returnflag", "select sum(l_quantity), l_returnflag from lineitem group by l_returnflag order by l_quantity")
add("agg_min_by", "SELECT c_nationkey, round(min(c_acctbal), 2) AS min_value, arg_min(c_custkey, (c_acctbal, c_custkey)) AS cid FROM customer GROUP BY c_nationkey", N.GroupBy(CUSTOMER, (A("C_NATIONKEY"),), (N.Aggregate("MIN_BY", A("C_CUSTKEY"), "CID", by=A("C_ACCTBAL")),)))
add("agg_pk_reduced", "SELECT c_custkey, c_name, c_mktsegment, round(sum(o_totalprice), 2) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL", "select c_custkey, c_name, c_mktsegment, sum(o_totalprice) as v from customer join orders on (c_custkey = o_custkey) group by c_custkey, c_name, c_mktsegment")
add("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "select distinct l_returnflag, l_linestatus from lineitem")
add("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag", "select l_returnflag, count(distinct l_partkey) as n from lineitem group by l_returnflag")

# genomics


def _bases(s: Session) -> N.Node:
    base = F.element_at(F.array(*map(F.lit, "ACGTX")), (F.pmod("L_PARTKEY", F.lit(5)) + 1).cast("int"))
    s.catalog.register("SAMPLE", s.catalog.table("lineitem").df.select(base.alias("BASE"), F.col("L_SUPPKEY").alias("PLACE")))
    ordered = F.element_at(F.array(*map(F.lit, "ACGT")), (F.pmod("O_CUSTKEY", F.lit(4)) + 1).cast("int"))
    s.catalog.register("ORDERED", s.catalog.table("orders").df.select(ordered.alias("BASE"), F.pmod("O_CUSTKEY", F.lit(50)).alias("PLACE"), F.col("O_ORDERKEY").alias("AT")))
    return N.Scan("SAMPLE")


def _grouped(func: str, table: str, by: str | None = None) -> Callable[[Session], DataFrame]:
    def run(s: Session) -> DataFrame:
        _bases(s)
        return s.run(N.GroupBy(N.Scan(table), (A("PLACE"),), (N.Aggregate(func, A("BASE"), "V", by=A(by) if by else None),)))

    return run


_SAMPLE = "SELECT l_suppkey AS place, substr('ACGTX', CAST(l_partkey % 5 + 1 AS INTEGER), 1) AS b FROM lineitem"
_ORDERED = "SELECT o_custkey % 50 AS place, o_orderkey AS pos, substr('ACGT', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS b FROM orders"
_COUNTS = "SELECT place, " + ", ".join(f"count(*) FILTER (b = '{b}') AS {b.lower()}" for b in "ACGTX") + f", count(*) AS t FROM ({_SAMPLE}) GROUP BY place"
_GENOTYPE = "CASE " + " ".join(f"WHEN {b} >= 0.8 * t THEN '{b.upper()}'" for b in "acgtx") + " ELSE coalesce(nullif(" + " || ".join(f"CASE WHEN {b} >= 0.2 * t THEN '{b.upper()}' ELSE '' END" for b in "acgt") + ", ''), 'N') END"
add("genotype", f"SELECT place, {_GENOTYPE} AS v FROM ({_COUNTS})", _grouped("GENOTYPE", "SAMPLE"))
add("genotype_statistics", f"SELECT place, format('[A:{{}}, C:{{}}, G:{{}}, T:{{}}, X:{{}}, SUM:{{}}]', a, c, g, t0, x, t) AS v FROM (SELECT place, " + ", ".join(f"count(*) FILTER (b = '{b}') AS {'t0' if b == 'T' else b.lower()}" for b in "ACGTX") + f", count(*) AS t FROM ({_SAMPLE}) GROUP BY place)", _grouped("GENOTYPE_STATISTICS", "SAMPLE"))
ORACLE_SQL["genotype"] = f"SELECT place, {_GENOTYPE.replace('t >= ', 't0 >= ')} AS v FROM ({_COUNTS.replace(' AS t,', ' AS t0,', 1)})"
add("concat_bases", f"SELECT place, string_agg(b, '' ORDER BY pos) AS v FROM ({_ORDERED}) GROUP BY place", _grouped("CONCAT_BASES", "ORDERED", "AT"))
add("is_homopolymer", f"SELECT place, CAST(regexp_matches(string_agg(b, '' ORDER BY pos), '(A{{4,}}|C{{4,}}|G{{4,}}|T{{4,}})$') AS INTEGER) AS v FROM ({_ORDERED}) GROUP BY place", _grouped("IS_HOMOPOLYMER", "ORDERED", "AT"))


def _variants(s: Session) -> DataFrame:
    """Places whose called genotype differs from the reference base (place mod 5)."""
    _bases(s)
    called = s.run(N.GroupBy(N.Scan("SAMPLE"), (A("PLACE"),), (N.Aggregate("GENOTYPE", A("BASE"), "CALLED"),)))
    s.catalog.register("CALLS", called.withColumn("REF", F.element_at(F.array(*map(F.lit, "ACGTX")), (F.pmod("PLACE", F.lit(5)) + 1).cast("int"))))
    return s.sql("select place, ref, called from calls where called <> ref")


add("variant_call", f"SELECT place, ref, v AS called FROM (SELECT *, substr('ACGTX', CAST(place % 5 + 1 AS INTEGER), 1) AS ref FROM ({ORACLE_SQL['genotype']})) WHERE v <> ref", _variants)

# sort, limit, append

add("sort_asc", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey", "select p_partkey, p_retailprice from part order by p_retailprice, p_partkey")
add("sort_multi_mixed", "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand, p_size DESC, p_partkey", "select p_brand, p_size, p_partkey from part sort by p_brand asc, p_size desc, p_partkey")
add("limit_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 25")
add("topk", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", N.Project(N.Limit(N.Sort(CUSTOMER, ((A("C_ACCTBAL"), False), (A("C_CUSTKEY"), True))), 10), ((A("C_CUSTKEY"), None), (A("C_ACCTBAL"), None))))
add("append_tables", "SELECT * FROM nation UNION ALL SELECT * FROM nation", N.Append(NATION, NATION))

# functions of the user

add("udf_table", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 5", N.Project(N.TableUdf(N.Sort(CUSTOMER, ((A("C_CUSTKEY"), True),)), "LIMIT", (5,)), ((A("C_CUSTKEY"), None), (A("C_ACCTBAL"), None))))
add("udf_map", "SELECT p_partkey, round(CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE sqrt(p_retailprice) END, 2) AS v FROM part",
    N.Project(N.MapUdf(PART, (("V", "double"),), ("if(#PART.P_SIZE#>25){", "#<OUT>.V#=#PART.P_RETAILPRICE#*2;", "}else{", "#<OUT>.V#=sqrt(#PART.P_RETAILPRICE#);", "}")), ((A("P_PARTKEY"), None), (A("V"), None))))
add("udf_map_euclid", "SELECT p_partkey, round(sqrt(power(p_retailprice - p_size, 2) + power(p_size - p_partkey, 2)), 2) AS dist FROM part",
    N.Project(N.MapUdf(PART, (("DIST", "double"),), ("#<OUT>.DIST#=sqrt(pow(#PART.P_RETAILPRICE#-#PART.P_SIZE#,2)+pow(#PART.P_SIZE#-#PART.P_PARTKEY#,2));",)), ((A("P_PARTKEY"), None), (A("DIST"), None))))
_ARGMIN = N.ReduceUdf((("who", "OID", 0), ("poorest", "double", float("inf"))), (("CID", "OID"),), ("if(#<hash_entry>.poorest#>#CUSTOMER.C_ACCTBAL#){", "#<hash_entry>.who#=#CUSTOMER.C_CUSTKEY#;", "#<hash_entry>.poorest#=#CUSTOMER.C_ACCTBAL#;", "}"), ("#<out>.CID#=#<hash_entry>.who#;",))
add("udf_reduce", "SELECT c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) AS cid FROM customer GROUP BY c_nationkey", N.GroupBy(CUSTOMER, (A("C_NATIONKEY"),), (N.Aggregate("UDF", None, "UDF", udf=_ARGMIN),)))
_SQUARES = N.ReduceUdf((("total", "double", 0.0), ("n", "double", 0.0)), (("RMS", "double"),), ("#<hash_entry>.total#=#<hash_entry>.total#+#PART.P_SIZE#*#PART.P_SIZE#;", "#<hash_entry>.n#=#<hash_entry>.n#+1;"), ("#<out>.RMS#=sqrt(#<hash_entry>.total#/#<hash_entry>.n#);",))
add("udf_reduce_fold", "SELECT p_brand, round(sqrt(sum(p_size * p_size) / count(*)), 2) AS rms FROM part GROUP BY p_brand", N.GroupBy(PART, (A("P_BRAND"),), (N.Aggregate("UDF", None, "UDF", udf=_SQUARES),)))

# tables


def _stored(s: Session) -> DataFrame:
    s.run(N.Store(N.Filter(NATION, N.Compare(A("N_REGIONKEY"), "=", C(2))), "KEPT"))
    s.run(N.RenameTable("KEPT", "ASIAN"))
    return s.sql("select n_nationkey, n_name from asian")


def _inserted(s: Session) -> DataFrame:
    s.sql("create table pets (id int, name varchar(20), weight double precision, born date)")
    s.sql("insert into pets values (1, 'cat', 4.5, '2020-1-31')")
    s.sql("insert into pets values (2, 'dog', -1, '2021-02-01')")
    return s.sql("select * from pets")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared ``spark.checkpoint.dir`` (a local default only where it is unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/millrace-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_ORDER_COLUMNS = (("O_ORDERKEY", "OID"), ("O_CUSTKEY", "OID"), ("O_ORDERSTATUS", "CHAR"), ("O_TOTALPRICE", "DOUBLE"), ("O_ORDERDATE", "DATE"), ("O_ORDERPRIORITY", "VARCHAR"))


def _export_csv(s: Session) -> DataFrame:
    """Export with a header, read back as text."""
    path = _scratch(s.catalog.spark, "nation-csv")
    s.run(N.Export(NATION, path))
    return s.catalog.spark.read.option("sep", "|").option("header", True).csv(path)


def _create_csv(s: Session) -> DataFrame:
    """Read separated text with a fixed schema."""
    path = _scratch(s.catalog.spark, "orders-csv")
    write_pipe_csv(s.catalog.table("orders").df, path, header=False)
    return s.run(N.Create("ORDERS_CSV", _ORDER_COLUMNS, path))


def _self_csv(s: Session) -> DataFrame:
    path = _scratch(s.catalog.spark, "part-table")
    write_self_describing(s.catalog.table("part").df, path)
    return read_self_describing(s.catalog.spark, path)


add("export_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation", _export_csv)
add("create_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, floor(o_totalprice * 100 + 0.50337) / 100 AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders", _create_csv)
add("self_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, floor(p_retailprice * 100 + 0.50337) / 100 AS p_retailprice FROM part", _self_csv)
add("store_rename_table", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2", _stored)
add("insert_values", "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'cat', CAST(4.5 AS DOUBLE), '2020-01-31'), (2, 'dog', -1, '2021-02-01')) t(id, name, weight, born)", _inserted)
add("system_schema", "SELECT 'REGION' AS table_name, upper(name) AS column_name, CASE type WHEN 'INTEGER' THEN 'INT' ELSE 'VARCHAR' END AS attribute_type FROM pragma_table_info('region')", "select table_name, column_name, attribute_type from sys_database_schema where table_name = 'REGION'")
add("constraints", "SELECT * FROM (VALUES ('REGION', 'R_REGIONKEY', 'PRIMARY KEY'), ('NATION', 'N_NATIONKEY', 'PRIMARY KEY'), ('CUSTOMER', 'C_CUSTKEY', 'PRIMARY KEY'), ('SUPPLIER', 'S_SUPPKEY', 'PRIMARY KEY'), ('PART', 'P_PARTKEY', 'PRIMARY KEY'), ('ORDERS', 'O_ORDERKEY', 'PRIMARY KEY')) t(table_name, column_name, kind)", "select table_name, column_name, kind from sys_integrity_constraints")

# star schema queries

_REV = ("LO_EXTENDEDPRICE*LO_DISCOUNT", "sum(lo_extendedprice*lo_discount)")
_Q1 = {
    "11": "d_year = 1996 and lo_discount between 0.01 and 0.03 and lo_quantity < 25",
    "12": "d_yearmonthnum = 199701 and lo_discount between 0.04 and 0.06 and lo_quantity between 26 and 35",
    "13": "d_weeknuminyear = 6 and d_year = 1998 and lo_discount between 0.05 and 0.07 and lo_quantity between 26 and 35",
}
_DWIDE = "dates JOIN (s_part JOIN (s_supplier JOIN (s_customer JOIN lineorder ON (sc_custkey = lo_custkey)) ON (ss_suppkey = lo_suppkey)) ON (sp_partkey = lo_partkey)) ON (d_datekey = lo_orderdate)"


def _ssb(name: str, keys: str, measure: str, tables: str, where: str, order: str) -> None:
    """One star schema query over the joined views and over the wide table."""
    group = f" group by {keys}" if keys else ""
    pick = f"{measure} as v" + (f", {keys}" if keys else "")
    tail = f" order by {order}" if order else ""
    oracle = f"{_STAR} SELECT {keys + ', ' if keys else ''}round({measure}, 2) AS v FROM {tables} WHERE {where}{group.replace('group by', 'GROUP BY')}"
    add(f"ssb_q{name}", oracle, f"select {pick} from {tables} where {where}{group}{tail}", views=True)

    def wide(s: Session) -> DataFrame:
        star_schema(s)
        joined = s.sql(f"select * from {_DWIDE}")
        s.catalog.register("WIDE", joined)
        return s.sql(f"select {pick} from wide where {where}{group}{tail}")

    add(f"dssb_q{name}", oracle, wide)


for _n, _w in _Q1.items():
    _ssb(_n, "", "sum(lo_extendedprice*lo_discount)", "lineorder JOIN dates ON (lo_orderdate = d_datekey)", _w, "")
_T2 = "dates JOIN (s_part JOIN (s_supplier JOIN lineorder ON (ss_suppkey = lo_suppkey)) ON (sp_partkey = lo_partkey)) ON (d_datekey = lo_orderdate)"
_T3 = "dates JOIN (s_supplier JOIN (s_customer JOIN lineorder ON (sc_custkey = lo_custkey)) ON (ss_suppkey = lo_suppkey)) ON (d_datekey = lo_orderdate)"
for _n, _w in {"21": "sp_category = 'STANDARD' and ss_region = 'AMERICA'", "22": "sp_brand between 'Brand#2' and 'Brand#22' and ss_region = 'ASIA'", "23": "sp_brand = 'Brand#11' and ss_region = 'EUROPE'"}.items():
    _ssb(_n, "d_year, sp_brand", "sum(lo_revenue)", _T2, _w, "d_year, sp_brand")
for _n, _k, _w in (
    ("31", "sc_nation, ss_nation, d_year", "sc_region = 'ASIA' and ss_region = 'ASIA' and d_year >= 1996 and d_year <= 1999"),
    ("32", "sc_city, ss_city, d_year", "sc_nation = 'NATION_7' and ss_nation = 'NATION_7' and d_year >= 1996 and d_year <= 1999"),
    ("33", "sc_city, ss_city, d_year", "(sc_city = 'BUILDING' or sc_city = 'MACHINERY') and (ss_nation = 'NATION_1' or ss_nation = 'NATION_5') and d_year >= 1996 and d_year <= 1999"),
    ("34", "sc_city, ss_city, d_year", "(sc_city = 'BUILDING' or sc_city = 'MACHINERY') and (ss_nation = 'NATION_1' or ss_nation = 'NATION_5') and d_yearmonthnum = 199712"),
):
    _ssb(_n, _k, "sum(lo_revenue)", _T3, _w, f"d_year asc, {_k.split(',')[0]}")
for _n, _k, _w in (
    ("41", "d_year, sc_nation", "sc_region = 'AMERICA' and ss_region = 'AMERICA' and (sp_brand = 'Brand#1' or sp_brand = 'Brand#2')"),
    ("42", "d_year, ss_nation, sp_category", "sc_region = 'AMERICA' and ss_region = 'AMERICA' and (d_year = 1997 or d_year = 1998) and (sp_brand = 'Brand#1' or sp_brand = 'Brand#2')"),
    ("43", "d_year, ss_city, sp_brand", "sc_region = 'AMERICA' and ss_nation = 'NATION_1' and (d_year = 1997 or d_year = 1998) and sp_category = 'STANDARD'"),
):
    _ssb(_n, _k, "sum(lo_revenue-lo_supplycost)", _DWIDE, _w, _k)
add("ssb_semi_join", f"{_STAR} SELECT count(*) AS n FROM lineorder WHERE lo_suppkey IN (SELECT ss_suppkey FROM s_supplier WHERE ss_region = 'ASIA')", N.GroupBy(N.Join(N.Scan("lineorder"), N.Filter(N.Scan("s_supplier"), N.Compare(A("SS_REGION"), "=", C("ASIA"))), "left_semi", N.Compare(A("LO_SUPPKEY"), "=", A("SS_SUPPKEY"))), (), (N.Aggregate("COUNT", None, "N"),)), views=True)

add("ssb_select_only", f"{_STAR} SELECT lo_orderkey, lo_custkey, lo_partkey, lo_suppkey, CAST(lo_orderdate AS VARCHAR) AS lo_orderdate, round(lo_quantity, 2) AS lo_quantity, round(lo_extendedprice, 2) AS lo_extendedprice, round(lo_discount, 2) AS lo_discount, round(lo_revenue, 2) AS lo_revenue, round(lo_supplycost, 2) AS lo_supplycost FROM lineorder WHERE lo_discount BETWEEN 0.04 AND 0.06 AND lo_quantity BETWEEN 26 AND 35",
    "select * from lineorder where lo_discount between 0.04 and 0.06 and lo_quantity between 26 and 35", views=True)

# single operators: few and many groups, medium and high selectivity

for _n, _k in {"few": "l_returnflag", "many": "l_partkey"}.items():
    add(f"micro_{_n}_groups", f"SELECT {_k}, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY {_k}", f"select {_k}, sum(l_quantity) as v from lineitem group by {_k}")
for _n, _w in {"medium": "l_quantity < 25", "high": "l_quantity < 25 and l_discount <= 0.03 and l_discount >= 0.01 and l_extendedprice > 40000"}.items():
    _picked = ("l_quantity", "l_discount", "l_extendedprice")
    add(f"micro_{_n}_selectivity", f"SELECT {', '.join(f'round({c}, 2) AS {c}' for c in _picked)} FROM lineitem WHERE {_w}", f"select {', '.join(_picked)} from lineitem where {_w}")

# decision support queries

_DISC = "l_extendedprice * (1 - l_discount)"
add("tpch_q01", f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({_DISC}), 2) AS sum_disc_price, round(sum({_DISC} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 2) AS avg_qty, round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 2) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY ALL",
    "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base_price, sum(l_extendedprice*(1-l_discount)) as sum_disc_price, sum(l_extendedprice*(1-l_discount)*(1+l_tax)) as sum_charge, avg(l_quantity) as avg_qty, avg(l_extendedprice) as avg_price, avg(l_discount) as avg_disc, count(l_orderkey) as count_order from lineitem where l_shipdate <= '2001-9-02' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus")
_PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_cost, sum(l_quantity) AS ps_avail FROM lineitem GROUP BY ALL)"


def _partsupp(s: Session) -> None:
    cost = N.Compute(LINEITEM, "UNIT", N.Arith("/", A("L_EXTENDEDPRICE"), A("L_QUANTITY")))
    made = N.GroupBy(cost, (A("L_PARTKEY"), A("L_SUPPKEY")), (N.Aggregate("MIN", A("UNIT"), "PS_COST"), N.Aggregate("SUM", A("L_QUANTITY"), "PS_AVAIL")))
    s.catalog.register("PARTSUPP", s.run(N.Rename(made, (("L_PARTKEY", "PS_PARTKEY"), ("L_SUPPKEY", "PS_SUPPKEY")))))


def _q02(s: Session) -> DataFrame:
    """The least cost per part, decorrelated: a grouped subplan joined back."""
    _partsupp(s)
    s.catalog.register("LEAST_COST", s.sql("select ps_partkey as m_partkey, min(ps_cost) as m_cost from partsupp join supplier on (ps_suppkey = s_suppkey) join nation on (s_nationkey = n_nationkey) join region on (n_regionkey = r_regionkey) where r_name = 'EUROPE' group by ps_partkey"))
    return s.sql("select s_suppkey, p_partkey, n_name, ps_cost from part join partsupp on (p_partkey = ps_partkey) join supplier on (ps_suppkey = s_suppkey) join nation on (s_nationkey = n_nationkey) join region on (n_regionkey = r_regionkey) join least_cost on (m_partkey = p_partkey) where r_name = 'EUROPE' and p_size > 15 and p_type like '.*A.*' and ps_cost = m_cost")


add("tpch_q02", f"WITH ps AS {_PARTSUPP} SELECT s_suppkey, p_partkey, n_name, round(ps_cost, 2) AS ps_cost FROM part JOIN ps ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND p_size > 15 AND p_type LIKE '%A%' AND ps_cost = (SELECT min(i.ps_cost) FROM ps i JOIN supplier ON s_suppkey = i.ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND i.ps_partkey = p_partkey)", _q02)
add("tpch_q03", f"SELECT l_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, round(sum({_DISC}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15' GROUP BY ALL",
    "select l_orderkey, sum(l_extendedprice*(1-l_discount)) as revenue, o_orderdate from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < '1997-3-15' and l_shipdate > '1997-3-15' group by l_orderkey, o_orderdate order by revenue desc, o_orderdate")
add("tpch_q04", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax < l_discount) GROUP BY o_orderpriority",
    N.Sort(N.GroupBy(N.Join(N.Filter(ORDERS, N.All((N.Compare(A("O_ORDERDATE"), ">=", C("1997-07-01")), N.Compare(A("O_ORDERDATE"), "<", C("1997-10-01"))))), N.Filter(LINEITEM, N.Compare(A("L_TAX"), "<", A("L_DISCOUNT"))), "left_semi", _OL), (A("O_ORDERPRIORITY"),), (N.Aggregate("COUNT", A("O_ORDERKEY"), "ORDER_COUNT"),)), ((A("O_ORDERPRIORITY"), True),)))
add("tpch_q05", f"SELECT n_name, round(sum({_DISC}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name",
    "select n_name, sum(l_extendedprice*(1-l_discount)) as revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' and o_orderdate >= '1996-1-01' and o_orderdate < '1998-1-01' group by n_name order by revenue desc")
_Q6W = "l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"
add("tpch_q06", f"SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE {_Q6W}", "select sum(l_extendedprice*l_discount) as revenue from lineitem where l_shipdate >= '1996-1-01' and l_shipdate < '1997-1-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
_N1, _N2 = N.Scan("nation", 1), N.Scan("nation", 2)
_Q7 = N.Join(N.Join(N.Join(N.Join(N.Join(SUPPLIER, LINEITEM, "inner", N.Compare(A("S_SUPPKEY"), "=", A("L_SUPPKEY"))), ORDERS, "inner", _OL), CUSTOMER, "inner", _CUST_ORDER), _N1, "inner", N.Compare(A("S_NATIONKEY"), "=", A("N_NATIONKEY", "NATION", 1))), _N2, "inner", N.Compare(A("C_NATIONKEY"), "=", A("N_NATIONKEY", "NATION", 2)))
_PAIR = lambda x, y: N.All((N.Compare(A("N_NAME", "NATION", 1), "=", C(x)), N.Compare(A("N_NAME", "NATION", 2), "=", C(y))))
_Q7 = N.Compute(N.Compute(N.Filter(_Q7, N.All((N.AnyOf((_PAIR("NATION_6", "NATION_7"), _PAIR("NATION_7", "NATION_6"))), N.Compare(A("L_SHIPDATE"), ">=", C("1996-01-01")), N.Compare(A("L_SHIPDATE"), "<=", C("1999-12-31"))))), "L_YEAR", N.Call("EXTRACT_YEAR", (A("L_SHIPDATE"),))), "VOLUME", N.Arith("*", A("L_EXTENDEDPRICE"), N.Arith("-", C(1), A("L_DISCOUNT"))))
add("tpch_q07", f"SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, year(l_shipdate) AS l_year, round(sum({_DISC}), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE ((a.n_name = 'NATION_6' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_6')) AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY ALL",
    N.GroupBy(N.Project(_Q7, ((A("N_NAME", "NATION", 1), "SUPP_NATION"), (A("N_NAME", "NATION", 2), "CUST_NATION"), (A("L_YEAR"), None), (A("VOLUME"), None))), (A("SUPP_NATION"), A("CUST_NATION"), A("L_YEAR")), (N.Aggregate("SUM", A("VOLUME"), "REVENUE"),)))


def _q09(s: Session) -> DataFrame:
    _partsupp(s)
    joined = s.sql("select n_name, extract_year(o_orderdate) as o_year, l_extendedprice*(1-l_discount)-ps_cost*0.1*l_quantity as amount from part, supplier, lineitem, partsupp, orders, nation where s_suppkey = l_suppkey and ps_suppkey = l_suppkey and ps_partkey = l_partkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '.*red.*'")
    s.catalog.register("PROFIT", joined)
    return s.sql("select n_name, o_year, sum(amount) as sum_profit from profit group by n_name, o_year order by n_name, o_year desc")


add("tpch_q09", f"WITH ps AS {_PARTSUPP} SELECT n_name, year(o_orderdate) AS o_year, round(sum({_DISC} - ps_cost * 0.1 * l_quantity), 2) AS sum_profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%red%' GROUP BY ALL", _q09)
add("tpch_q10", f"SELECT c_custkey, c_name, n_name, round(sum({_DISC}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20",
    "select c_custkey, c_name, n_name, sum(l_extendedprice*(1-l_discount)) as revenue from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey and c_nationkey = n_nationkey and o_orderdate >= '1997-10-01' and o_orderdate < '1998-01-01' and l_returnflag = 'R' group by c_custkey, c_name, n_name order by revenue desc, c_custkey limit 20")


def _q13(s: Session) -> DataFrame:
    s.catalog.register("C_ORDERS", s.run(N.GroupBy(N.Join(CUSTOMER, _DEAR, "left", _CUST_ORDER), (A("C_CUSTKEY"),), (N.Aggregate("COUNT", A("O_ORDERKEY"), "C_COUNT"),))))
    return s.sql("select c_count, count(c_custkey) as custdist from c_orders group by c_count")


add("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY c_count", _q13)


def _q15(s: Session) -> DataFrame:
    """A subplan used twice: grouped revenue, and its maximum joined back."""
    s.catalog.register("REVENUE", s.sql("select l_suppkey, sum(l_extendedprice*(1-l_discount)) as total from lineitem where l_shipdate >= '1998-01-01' and l_shipdate < '1998-04-01' group by l_suppkey"))
    s.catalog.register("BEST", lowered(s.sql("select max(total) as best from revenue")))
    rounded = s.catalog.table("REVENUE").df.withColumn("TOTAL", cents(F.col("TOTAL")))
    s.catalog.register("REVENUE", rounded, replace=True)
    return s.sql("select s_suppkey, s_name, total from supplier join revenue on (s_suppkey = l_suppkey) join best on (total = best)")


add("tpch_q15", f"WITH r AS (SELECT l_suppkey, round(sum({_DISC}), 2) AS total FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r)", _q15)


def _q17(s: Session) -> DataFrame:
    s.catalog.register("USUAL", s.sql("select l_partkey as u_partkey, avg(l_quantity) as usual from lineitem group by l_partkey"))
    s.catalog.register("FEW", s.sql("select l_extendedprice from lineitem join part on (l_partkey = p_partkey) join usual on (l_partkey = u_partkey) where p_brand = 'Brand#23' and l_quantity < 0.4*usual"))
    return s.sql("select sum(l_extendedprice) as total from few")


add("tpch_q17", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.4 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)", _q17)


def _q18(s: Session) -> DataFrame:
    s.catalog.register("LARGE", s.sql("select l_orderkey as k, sum(l_quantity) as q from lineitem group by l_orderkey having q > 200"))
    kept = N.Join(N.Scan("LARGE"), ORDERS, "right_semi", N.Compare(A("K"), "=", A("O_ORDERKEY")))
    joined = N.Join(N.Join(CUSTOMER, kept, "inner", _CUST_ORDER), LINEITEM, "inner", _OL)
    return s.run(N.GroupBy(joined, (A("C_NAME"), A("C_CUSTKEY"), A("O_ORDERKEY"), A("O_TOTALPRICE")), (N.Aggregate("SUM", A("L_QUANTITY"), "QTY"),)))


add("tpch_q18", "SELECT c_name, c_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY ALL", _q18)
_Q19 = "(p_brand = 'Brand#12' and l_quantity >= 1 and l_quantity <= 11 and p_size between 1 and 15) or (p_brand = 'Brand#23' and l_quantity >= 10 and l_quantity <= 20 and p_size between 1 and 30) or (p_brand = 'Brand#4' and l_quantity >= 20 and l_quantity <= 30 and p_size between 1 and 45)"
add("tpch_q19", f"SELECT round(sum({_DISC}), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {_Q19}", f"select sum(l_extendedprice*(1-l_discount)) as revenue from lineitem join part on (p_partkey = l_partkey) where {_Q19}")


def _q20(s: Session) -> DataFrame:
    _partsupp(s)
    s.catalog.register("SOLD", s.sql("select l_partkey as k_part, l_suppkey as k_supp, sum(l_quantity) as sold from lineitem where l_shipdate >= '1997-01-01' and l_shipdate < '1998-01-01' group by l_partkey, l_suppkey"))
    ps = N.Join(N.Scan("PARTSUPP"), N.Filter(PART, N.Matches(A("P_NAME"), "red.*")), "left_semi", N.Compare(A("PS_PARTKEY"), "=", A("P_PARTKEY")))
    both = N.Join(ps, N.Scan("SOLD"), "inner", N.All((N.Compare(A("PS_PARTKEY"), "=", A("K_PART")), N.Compare(A("PS_SUPPKEY"), "=", A("K_SUPP")))))
    many = N.Filter(N.Compute(both, "HALF", N.Arith("*", C(0.5), A("SOLD"))), N.Compare(A("PS_AVAIL"), ">", A("HALF")))
    return s.run(N.Project(N.Join(SUPPLIER, many, "left_semi", N.Compare(A("S_SUPPKEY"), "=", A("PS_SUPPKEY"))), ((A("S_SUPPKEY"), None), (A("S_NAME"), None))))


add("tpch_q20", f"WITH ps AS {_PARTSUPP} SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') AND ps_avail > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'))", _q20)


def _q21(s: Session) -> DataFrame:
    """Suppliers that alone kept an order of several suppliers waiting (tax over discount stands for late)."""
    late = N.Filter(LINEITEM, N.Compare(A("L_TAX"), ">", A("L_DISCOUNT")))
    s.catalog.register("ALL_SUPP", s.run(N.GroupBy(LINEITEM, (A("L_ORDERKEY"),), (N.Aggregate("COUNT_DISTINCT", A("L_SUPPKEY"), "N_SUPP"),))))
    s.catalog.register("LATE_SUPP", s.run(N.GroupBy(late, (A("L_ORDERKEY"),), (N.Aggregate("COUNT_DISTINCT", A("L_SUPPKEY"), "N_LATE"),))))
    key = lambda t: N.Compare(A("L_ORDERKEY", "LINEITEM"), "=", A("L_ORDERKEY", t))
    plan = N.Join(N.Join(N.Join(N.Join(late, SUPPLIER, "inner", N.Compare(A("L_SUPPKEY"), "=", A("S_SUPPKEY"))), N.Filter(ORDERS, N.Compare(A("O_ORDERSTATUS"), "=", C("F"))), "left_semi", _OL), N.Scan("ALL_SUPP"), "inner", key("ALL_SUPP")), N.Scan("LATE_SUPP"), "inner", key("LATE_SUPP"))
    plan = N.Filter(plan, N.All((N.Compare(A("N_SUPP"), ">", C(1)), N.Compare(A("N_LATE"), "=", C(1)))))
    return s.run(N.GroupBy(plan, (A("S_NAME"),), (N.Aggregate("COUNT", A("S_NAME"), "NUMWAIT"),)))


add("tpch_q21", "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey WHERE o_orderstatus = 'F' AND a.l_tax > a.l_discount AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_tax > c.l_discount) GROUP BY s_name", _q21)

# JSON plans


def _ref(column: str, table: str, result: str | None = None, version: int = 1) -> dict:
    return {"ATTRIBUTE_REFERENCE": {"COLUMN_NAME": column, "TABLE_NAME": table, "VERSION": version, "RESULT_NAME": result or column}}


def _cond(column: str, table: str, op: str, value: str, kind: str) -> dict:
    return {"PREDICATE": {"PREDICATE_TYPE": "COLUMN_CONSTANT_PREDICATE", "LEFT_HAND_SIDE_ATTRIBUTE_REFERENCE": _ref(column, table)["ATTRIBUTE_REFERENCE"], "PREDICATE_COMPARATOR": op, "CONSTANT": value, "CONSTANT_TYPE": kind}}


def _select(child: dict, *parts: dict, kind: str = "AND_PREDICATE") -> dict:
    return {"OPERATOR_NAME": "GENERIC_SELECTION", "PREDICATE": {"PREDICATE_TYPE": kind, "PREDICATES": list(parts)}, "LEFT_CHILD": child, "RIGHT_CHILD": None}


def _jscan(table: str) -> dict:
    return {"OPERATOR_NAME": "TABLE_SCAN", "TABLE_NAME": table}


def _jjoin(left: dict, right: dict, a: tuple[str, str], b: tuple[str, str], how: str = "INNER_JOIN") -> dict:
    return {"OPERATOR_NAME": "GENERIC_JOIN", "JOIN_TYPE": how, "PREDICATE": {"PREDICATE_TYPE": "COLUMN_COLUMN_PREDICATE", "LEFT_HAND_SIDE_ATTRIBUTE_REFERENCE": _ref(*a)["ATTRIBUTE_REFERENCE"], "PREDICATE_COMPARATOR": "EQUAL", "RIGHT_HAND_SIDE_ATTRIBUTE_REFERENCE": _ref(*b)["ATTRIBUTE_REFERENCE"]}, "LEFT_CHILD": left, "RIGHT_CHILD": right}


def _jmap(child: dict, name: str, code: str) -> dict:
    return {"OPERATOR_NAME": "MAP_UDF", "MAP_UDF_OUTPUT_ATTRIBUTES": [{"ATTRIBUTE_TYPE": "double", "ATTRIBUTE_NAME": name}], "MAP_UDF_CODE": [code], "LEFT_CHILD": child}


def _jgroup(child: dict, keys: list[dict], *aggs: tuple[str, dict]) -> dict:
    return {"OPERATOR_NAME": "GENERIC_GROUPBY", "GROUPING_COLUMNS": keys, "AGGREGATION_SPECIFICATION": [{"AGGREGATION_FUNCTION": f, **r} for f, r in aggs], "LEFT_CHILD": child, "RIGHT_CHILD": None}


def _jsort(child: dict, *keys: tuple[str, str]) -> dict:
    return {"OPERATOR_NAME": "SORT BY", "SORT_COLUMNS": [{"COLUMN_NAME": c, "ORDER": o} for c, o in keys], "LEFT_CHILD": child}


_JSHIP = [_cond("L_SHIPDATE", "LINEITEM", "GREATER_EQUAL", "1996-01-01", "DATE"), _cond("L_SHIPDATE", "LINEITEM", "LESSER", "1997-01-01", "DATE")]
_JDISC = "#<OUT>.D#=#LINEITEM.L_EXTENDEDPRICE#*(1-#LINEITEM.L_DISCOUNT#);"
_J6 = _jgroup(_jmap(_select(_jscan("LINEITEM"), *_JSHIP, _cond("L_DISCOUNT", "LINEITEM", "GREATER_EQUAL", "0.05", "DOUBLE"), _cond("L_DISCOUNT", "LINEITEM", "LESSER_EQUAL", "0.07", "DOUBLE"), _cond("L_QUANTITY", "LINEITEM", "LESSER", "24", "DOUBLE")), "MULT", "#<OUT>.MULT#=#LINEITEM.L_DISCOUNT#*#LINEITEM.L_EXTENDEDPRICE#;"), [], ("SUM", _ref("MULT", "<COMPUTED>", "REVENUE")))
add("json_q6", ORACLE_SQL["tpch_q06"], json.dumps({"QUERY_PLAN": {"OPERATOR_NAME": "PROJECTION", "ATTRIBUTES": [_ref("REVENUE", "<COMPUTED>")], "LEFT_CHILD": _J6}}))
add("json_q1", f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_DISC}), 2) AS sum_disc, round(avg(l_discount), 2) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY ALL",
    json.dumps({"QUERY_PLAN": _jsort(_jgroup(_jmap(_select(_jscan("LINEITEM"), _cond("L_SHIPDATE", "LINEITEM", "LESSER_EQUAL", "2001-9-02", "DATE")), "D", _JDISC), [_ref("L_RETURNFLAG", "LINEITEM"), _ref("L_LINESTATUS", "LINEITEM")], ("SUM", _ref("L_QUANTITY", "LINEITEM", "SUM_QTY")), ("SUM", _ref("D", "<COMPUTED>", "SUM_DISC")), ("AVG", _ref("L_DISCOUNT", "LINEITEM", "AVG_DISC")), ("COUNT", _ref("L_ORDERKEY", "LINEITEM", "N"))), ("L_RETURNFLAG", "ASCENDING"), ("L_LINESTATUS", "DESCENDING"))}))
_J4 = _jjoin(_select(_jscan("ORDERS"), _cond("O_ORDERDATE", "ORDERS", "GREATER_EQUAL", "1997-07-01", "DATE"), _cond("O_ORDERDATE", "ORDERS", "LESSER", "1997-10-01", "DATE")), _select(_jscan("LINEITEM"), {"PREDICATE": {"PREDICATE_TYPE": "COLUMN_COLUMN_PREDICATE", "LEFT_HAND_SIDE_ATTRIBUTE_REFERENCE": _ref("L_TAX", "LINEITEM")["ATTRIBUTE_REFERENCE"], "PREDICATE_COMPARATOR": "LESSER", "RIGHT_HAND_SIDE_ATTRIBUTE_REFERENCE": _ref("L_DISCOUNT", "LINEITEM")["ATTRIBUTE_REFERENCE"]}}), ("O_ORDERKEY", "ORDERS"), ("L_ORDERKEY", "LINEITEM"), "LEFT_SEMI_JOIN")
add("json_q4", ORACLE_SQL["tpch_q04"], json.dumps({"QUERY_PLAN": _jgroup(_J4, [_ref("O_ORDERPRIORITY", "ORDERS")], ("COUNT", _ref("O_ORDERKEY", "ORDERS", "ORDER_COUNT")))}))
_J5 = _jjoin(_jjoin(_jjoin(_jjoin(_jjoin(_select(_jscan("REGION"), _cond("R_NAME", "REGION", "EQUAL", "ASIA", "VARCHAR")), _jscan("NATION"), ("R_REGIONKEY", "REGION"), ("N_REGIONKEY", "NATION")), _jscan("SUPPLIER"), ("N_NATIONKEY", "NATION"), ("S_NATIONKEY", "SUPPLIER")), _jscan("LINEITEM"), ("S_SUPPKEY", "SUPPLIER"), ("L_SUPPKEY", "LINEITEM")), _select(_jscan("ORDERS"), _cond("O_ORDERDATE", "ORDERS", "GREATER_EQUAL", "1996-01-01", "DATE"), _cond("O_ORDERDATE", "ORDERS", "LESSER", "1998-01-01", "DATE")), ("L_ORDERKEY", "LINEITEM"), ("O_ORDERKEY", "ORDERS")), _jscan("CUSTOMER"), ("O_CUSTKEY", "ORDERS"), ("C_CUSTKEY", "CUSTOMER"))
_J5 = _select(_J5, {"PREDICATE": {"PREDICATE_TYPE": "COLUMN_COLUMN_PREDICATE", "LEFT_HAND_SIDE_ATTRIBUTE_REFERENCE": _ref("C_NATIONKEY", "CUSTOMER")["ATTRIBUTE_REFERENCE"], "PREDICATE_COMPARATOR": "EQUAL", "RIGHT_HAND_SIDE_ATTRIBUTE_REFERENCE": _ref("S_NATIONKEY", "SUPPLIER")["ATTRIBUTE_REFERENCE"]}})
add("json_q5", ORACLE_SQL["tpch_q05"], json.dumps({"QUERY_PLAN": _jsort(_jgroup(_jmap(_J5, "D", _JDISC), [_ref("N_NAME", "NATION")], ("SUM", _ref("D", "<COMPUTED>", "REVENUE"))), ("REVENUE", "DESCENDING"))}))
_J19 = [{"PREDICATE": {"PREDICATE_TYPE": "AND_PREDICATE", "PREDICATES": [_cond("P_BRAND", "PART", "EQUAL", b, "VARCHAR"), _cond("L_QUANTITY", "LINEITEM", "GREATER_EQUAL", lo, "DOUBLE"), _cond("L_QUANTITY", "LINEITEM", "LESSER_EQUAL", hi, "DOUBLE"), _cond("P_SIZE", "PART", "GREATER_EQUAL", "1", "INT"), _cond("P_SIZE", "PART", "LESSER_EQUAL", size, "INT")]}} for b, lo, hi, size in (("Brand#12", "1", "11", "15"), ("Brand#23", "10", "20", "30"), ("Brand#4", "20", "30", "45"))]
add("json_q19", ORACLE_SQL["tpch_q19"], json.dumps({"QUERY_PLAN": _jgroup(_jmap(_select(_jjoin(_jscan("PART"), _jscan("LINEITEM"), ("P_PARTKEY", "PART"), ("L_PARTKEY", "LINEITEM")), *_J19, kind="OR_PREDICATE"), "D", _JDISC), [], ("SUM", _ref("D", "<COMPUTED>", "REVENUE")))}))
_J7 = _jjoin(_jjoin(_jjoin(_jjoin(_jjoin(_jscan("SUPPLIER"), _jscan("LINEITEM"), ("S_SUPPKEY", "SUPPLIER"), ("L_SUPPKEY", "LINEITEM")), _jscan("ORDERS"), ("L_ORDERKEY", "LINEITEM"), ("O_ORDERKEY", "ORDERS")), _jscan("CUSTOMER"), ("O_CUSTKEY", "ORDERS"), ("C_CUSTKEY", "CUSTOMER")), _jscan("NATION"), ("S_NATIONKEY", "SUPPLIER"), ("N_NATIONKEY", "NATION")), {"OPERATOR_NAME": "TABLE_SCAN", "TABLE_NAME": "NATION", "VERSION": 2}, ("C_NATIONKEY", "CUSTOMER"), ("N_NATIONKEY", "NATION", None, 2))
_J7 = _jgroup(_jmap(_J7, "D", _JDISC), [_ref("N_NAME", "NATION", "SUPP_NATION", 1), _ref("N_NAME", "NATION", "CUST_NATION", 2)], ("SUM", _ref("D", "<COMPUTED>", "REVENUE")))
add("json_q7", f"SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, round(sum({_DISC}), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY ALL", json.dumps({"QUERY_PLAN": _J7}))

# k-means: one assignment over two numeric columns of part, with fixed centroids

_CENTROIDS = [(100.0, 5.0), (400.0, 25.0), (700.0, 30.0), (900.0, 45.0)]
add("kmeans_step", "SELECT CAST(cid AS BIGINT) AS cid, count(*) AS n, round(avg(p_retailprice), 2) AS c0, round(avg(p_size), 2) AS c1 FROM (SELECT p_retailprice, p_size, (SELECT arg_min(k, (sqrt(power(p_retailprice - x, 2) + power(p_size - y, 2)), k)) FROM (VALUES "
    + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(_CENTROIDS)) + ") c(k, x, y)) AS cid FROM part) GROUP BY cid",
    lambda s: assign(s.catalog.table("part").df, _CENTROIDS, ["P_RETAILPRICE", "P_SIZE"]).groupBy("CID").agg(F.count("*").alias("N"), F.avg("P_RETAILPRICE").alias("C0"), F.avg("P_SIZE").alias("C1")))


# k-means: rounds until no centroid moves, or as many as the SQL writes out

_ROUNDS = 12
_STARTS = [(920.0, 5.0), (930.0, 40.0), (970.0, 10.0), (980.0, 45.0)]


def _kmeans_sql() -> str:
    sql = "WITH c0(k, x, y) AS (VALUES " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(_STARTS)) + ")"
    for r in range(_ROUNDS):
        near = f"(SELECT arg_min(k, (sqrt(power(p_retailprice - x, 2) + power(p_size - y, 2)), k)) FROM c{r})"
        sql += (
            f",\nm{r} AS MATERIALIZED (SELECT cid, avg(p_retailprice) AS x, avg(p_size) AS y FROM (SELECT p_retailprice, p_size, {near} AS cid FROM part) GROUP BY cid)"
            f",\nc{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN m{r} m ON m.cid = c.k)"
        )
    return f"{sql}\nSELECT CAST(k AS BIGINT) AS cid, round(x, 2) AS c0, round(y, 2) AS c1 FROM c{_ROUNDS}"


def _kmeans(s: Session) -> DataFrame:
    centroids = kmeans(s.catalog.table("part").df, _STARTS, ["P_RETAILPRICE", "P_SIZE"], _ROUNDS, 0.0)
    return s.catalog.spark.createDataFrame([(k, *c) for k, c in enumerate(centroids)], "CID long, C0 double, C1 double")


add("kmeans", _kmeans_sql(), _kmeans)
