"""The engine's front ends, rules and sources on small tables."""

import bisect
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.cli import Interpreter
from millrace.compare import same_rows
from millrace.operators.kmeans import kmeans
from millrace.plans import jsonplan, sql
from millrace.plans import nodes as N
from millrace.session import Session
from millrace.sources import genome
from millrace.sources.pipe_csv import read_pipe_csv, read_self_describing, write_self_describing
from millrace.types import PlanError, struct


@pytest.fixture
def s(spark):
    s = Session(spark)
    s.catalog.register("emp", spark.createDataFrame([(1, "ann", 10, 5.0), (2, "bob", 20, 7.5), (3, "cid", 10, 1.0)], "id int, name string, dept int, pay double"))
    s.catalog.register("dept", spark.createDataFrame([(10, "x"), (20, "y"), (30, "z")], "dept_id int, dname string"))
    return s


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_names_case_and_aliases(s):
    df = s.sql('select NAME as who, "PAY"*2 from EMP e where e.id < 3;')
    assert df.columns == ["who".upper(), "(PAY*2)"]
    assert rows(df) == [("ann", 10.0), ("bob", 15.0)]
    assert s.sql("select name from emp order by pay desc limit 1").first()[0] == "bob"


def test_group_by_puts_keys_first_and_keeps_argument_names(s):
    df = s.sql("select sum(pay), dept from emp group by dept order by pay")
    assert df.columns == ["DEPT", "PAY"] and [tuple(r) for r in df.collect()] == [(10, 6.0), (20, 7.5)]


@pytest.mark.parametrize("text", [
    "select name from emp where pay is null", "select name from emp where not pay > 1", "select name from emp where id in (1, 2)", "select name from emp union select dname from dept",
    "select name, sum(pay) from emp", "select name from emp group by name", "select nothing from emp", "select name from nowhere", "update emp set pay = 1", "select name + sum(pay) from emp group by name",
    "select * from emp join dept", "create table t (a decimal)", "insert into emp values (1)", "insert into emp values (null, 'a', 1, 1)", "select name from emp where name > 5", "select name from emp where exists (select 1 from dept)",
])
def test_refused_statements_raise(s, text):
    with pytest.raises(PlanError):
        s.sql(text)


def test_ambiguous_columns_need_a_version(s):
    two = N.Join(N.Scan("dept", 1), N.Scan("dept", 2), "inner", N.Compare(N.Attr("DEPT_ID", "DEPT", 1), "<", N.Attr("DEPT_ID", "DEPT", 2)))
    assert s.run(two).count() == 3
    with pytest.raises(PlanError):
        s.run(N.Project(two, ((N.Attr("DNAME"), None),)))


def test_keys_reduce_grouping(s):
    s.catalog.add_primary_key("emp", "id")
    df = s.sql("select id, name, dept, sum(pay) as v from emp group by id, name, dept")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "first(EMP$1$DEPT" in plan and "first(EMP$1$NAME" not in plan
    assert rows(df) == [(1, "ann", 10, 5.0), (2, "bob", 20, 7.5), (3, "cid", 10, 1.0)]
    with pytest.raises(PlanError):
        s.catalog.add_primary_key("emp", "dept")
    s.catalog.add_primary_key("dept", "dept_id")
    s.catalog.add_foreign_key("emp", "dept", "dept", "dept_id")
    assert rows(s.sql("select table_name, column_name, kind from sys_integrity_constraints")) == [("DEPT", "DEPT_ID", "PRIMARY KEY"), ("EMP", "DEPT", "FOREIGN KEY"), ("EMP", "ID", "PRIMARY KEY")]


def test_filters_and_columns_are_pushed_down(spark, tmp_path):
    spark.range(1000).select(F.col("id"), (F.col("id") * 2).alias("twice"), F.lit("x").alias("unused")).write.parquet(f"{tmp_path}/t.parquet")
    s = Session.over(spark, str(tmp_path), ("t",))
    plan = s.sql("select sum(twice) as v from t where id < 10")._jdf.queryExecution().executedPlan().toString().replace(str(tmp_path), "")
    assert "LessThan(id,10)" in plan and "unused" not in plan


def test_json_plans(s):
    plan = {"QUERY_PLAN": {"OPERATOR_NAME": "LIMIT", "LIMIT": 1, "LEFT_CHILD": {"OPERATOR_NAME": "SORT BY", "SORT_COLUMNS": [{"COLUMN_NAME": "PAY", "ORDER": "DESCENDING"}], "LEFT_CHILD": {"OPERATOR_NAME": "CROSS_JOIN", "LEFT_CHILD": {"OPERATOR_NAME": "TABLE_SCAN", "TABLE_NAME": "EMP"}, "RIGHT_CHILD": {"OPERATOR_NAME": "TABLE_SCAN", "TABLE_NAME": "DEPT"}}}}}
    assert s.json(json.dumps(plan)).first()["NAME"] == "bob"
    for bad in ({}, {"QUERY_PLAN": {"OPERATOR_NAME": "NONE"}}, {"QUERY_PLAN": {"OPERATOR_NAME": "SINK"}}, {"QUERY_PLAN": {"OPERATOR_NAME": "TABLE_SCAN"}}):
        with pytest.raises(PlanError):
            jsonplan.load(json.dumps(bad))
    stored = {"QUERY_PLAN": {"OPERATOR_NAME": "STORE_TABLE", "TABLE_NAME": "COPY", "LEFT_CHILD": {"OPERATOR_NAME": "TABLE_SCAN", "TABLE_NAME": "DEPT"}}}
    s.json(json.dumps(stored))
    with pytest.raises(PlanError):
        s.json(json.dumps(stored))
    assert s.json(json.dumps({"QUERY_PLAN": {"OPERATOR_NAME": "RENAME_TABLE", "TABLE_NAME": "COPY", "NEW_TABLE_NAME": "DEPT"}})).first()[0] == 0
    assert s.json(json.dumps({"QUERY_PLAN": {"OPERATOR_NAME": "DELETE_TABLE", "TABLE_NAME": "COPY"}})).count() == 1 and "COPY" not in s.catalog.tables
    assert s.json(json.dumps({"QUERY_PLAN": {"OPERATOR_NAME": "SINK", "LEFT_CHILD": {"OPERATOR_NAME": "TABLE_SCAN", "TABLE_NAME": "DEPT"}}})).count() == 0


def test_snippets_reject_what_they_do_not_know(s):
    for code in ("#<OUT>.V#=system(1);", "#<OUT>.V#=#EMP.PAY#", "while(1){}", "#<OUT>.W#=1;"):
        with pytest.raises(PlanError):
            s.run(N.MapUdf(N.Scan("emp"), (("V", "double"),), (code,)))
    two = N.MapUdf(N.Scan("emp"), (("A", "double"), ("B", "double")), ("double t = #EMP.PAY# > 4 && !(#EMP.DEPT# == 20) ? 1 : -2;", "#<OUT>.B#=t*3; #<OUT>.A#=t;"))
    assert rows(s.run(N.Project(two, ((N.Attr("A"), None), (N.Attr("B"), None))))) == [(-2.0, -6.0), (-2.0, -6.0), (1.0, 3.0)]


def test_csv_sources(spark, s, tmp_path):
    (tmp_path / "p.tbl").write_text("# note\n1|a b |1998-9-02|\n\n2||1999-12-31|\n")
    schema = struct([("K", "INT"), ("V", "VARCHAR"), ("D", "DATE")])
    assert [tuple(map(str, r)) for r in read_pipe_csv(spark, f"{tmp_path}/p.tbl", schema).collect()] == [("1", "a b", "1998-09-02"), ("2", "", "1999-12-31")]
    df = s.catalog.table("emp").df
    write_self_describing(df, f"{tmp_path}/self")
    assert same_rows(read_self_describing(spark, f"{tmp_path}/self"), df)
    with pytest.raises(PlanError):
        read_pipe_csv(spark, f"{tmp_path}/p.tbl", schema, ",")


def test_persistence_and_statistics(spark, s, tmp_path):
    s.catalog.add_primary_key("emp", "id")
    s.catalog.save("emp", str(tmp_path))
    other = Session(spark)
    assert other.catalog.load_database(str(tmp_path)) == ["EMP"]
    assert other.catalog.table("emp").primary_key == "ID" and other.sql("select * from emp").count() == 3
    stats = {r.COLUMN_NAME: r for r in other.catalog.analyze("emp").collect()}
    assert stats["PAY"].MIN == 1.0 and stats["PAY"].ROW_COUNT == 3
    assert other.catalog.histogram("emp", "pay", 2) == [1.0, 5.0, 7.5]
    other.catalog.drop("emp")
    assert not (Path(tmp_path) / "EMP").exists()


def test_command_interpreter(spark, s, tmp_path):
    said = []
    it = Interpreter(s, said.append)
    (tmp_path / "d.tbl").write_text("40|w|\n")
    (tmp_path / "script2").write_text("select name from emp\nselect pay from emp\n")
    (tmp_path / "script").write_text("# comment\n\nset result_output_format=csv\nselect dname from dept order by dname\n")
    for line in (f"import_csv_file dept {tmp_path}/d.tbl", f"execute_script {tmp_path}/script", "print result_output_format", "rename_table dept divisions", "setdevice cpu", "starttimer", "stoptimer", "explain select * from emp", "printschema", "version", "insert into emp values (9, 'zed', 40, 2)"):
        it.execute(line)
    assert said[0] == "DNAME\nw\nx\ny\nz" and said[1] == "result_output_format=csv" and said[2] == "1"
    assert s.sql("select name from emp where pay between 1.5 and 2.5").first()[0] == "zed"
    it.execute(f"parallelexec 2 {tmp_path}/script2")
    it.execute("drop_table divisions")
    for bad in ("nonsense", "drop_table divisions"):
        with pytest.raises(PlanError):
            it.execute(bad)


def test_large_results_are_whole_or_say_so(spark, s):
    s.catalog.register("big", spark.range(10_003).selectExpr("id as K"))
    said = []
    it = Interpreter(s, said.append)
    it.execute("exec select k from big")
    assert said[-1].endswith("\nfirst 10000 rows, more left out")
    for kind, head in (("csv", ["K"]), ("sam", [])):
        said.clear()
        it.execute(f"set result_output_format={kind}")
        it.execute("exec select k from big")
        lines = "\n".join(said).split("\n")
        assert lines[: len(head)] == head and sorted(lines[len(head) :], key=int) == [str(k) for k in range(10_003)]


def test_kmeans_finds_separate_clusters(spark):
    points = spark.createDataFrame([(float(c * 10 + i % 3), float(c * 5 + i % 2)) for c in range(4) for i in range(30)], "x double, y double")
    centres = kmeans(points, [(0.0, 0.0), (9.0, 4.0), (21.0, 9.0), (33.0, 20.0)], ["x", "y"])
    assert [tuple(round(v, 6) for v in c) for c in centres] == [(c * 10 + 1.0, c * 5 + 0.5) for c in range(4)]


def test_genome_round_trip(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 length=12\nACGTAC\nGTACGT\n>c2\nTTTT\n")
    sam = ["@HD\tVN:1", "r1\t1\tc1\t2\t60\t2S3M1I2M2D1M\t*\t0\t0\tNNCGTACGA\tIIIIIIIII", "r1\t1\tc2\t1\t9\t4M\t*\t0\t0\tTTAT\tABCD", "u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII"]
    (tmp_path / "s.sam").write_text("\n".join(sam) + "\n")
    t = genome.import_reference(spark, f"{tmp_path}/r.fa")
    assert t["REFERENCE_BASE"].count() == 16 and t["CONTIG"].count() == 2
    t |= genome.import_sample(genome.read_sam(spark, f"{tmp_path}/s.sam"), t["CONTIG"])
    assert t["READ"].count() == 2 and t["READ"].where("R_MATE_ID <> 0").count() == 2
    assert t["SAMPLE_BASE"].where("SB_BASE_VALUE = 'X'").count() == 2 and t["SAMPLE_BASE"].where("SB_INSERT_OFFSET = 1").count() == 1
    lines = sorted(r.value.split("\t")[2:6] + r.value.split("\t")[9:10] for r in genome.export_sam(t).collect())
    assert lines == [["c1", "2", "60", "3M1I2M2D1M", "CGTACGA"], ["c2", "1", "9", "4M", "TTAT"]]
    assert genome.export_sam(t, "c2").count() == 1 and genome.export_sam(t, "c1", 100, 200).count() == 0


def test_plans_run_over_streams(spark, tmp_path):
    from millrace.streaming.tables import start, stream_table

    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "k int, v double")
    df.write.parquet(f"{tmp_path}/in")
    s = Session(spark)
    stream_table(s.catalog, "ev", f"{tmp_path}/in", df.schema)
    q = start(s.engine, sql.parse("select k, sum(v) as total from ev group by k"), "totals")
    q.awaitTermination(60)
    assert rows(spark.table("totals")) == [(1, 5.0), (2, 4.0)]


def test_empty_global_aggregate(s):
    none = N.Filter(N.Scan("emp"), N.Compare(N.Attr("PAY"), ">", N.Const(99)))
    total = (N.Aggregate("SUM", N.Attr("PAY"), "V"),)
    assert [tuple(r) for r in s.run(N.GroupBy(none, (), total)).collect()] == [(None,)]
    assert s.run(N.GroupBy(none, (), total, empty_rows=False)).count() == 0


def test_join_on_a_comparison_is_dealt_to_many_tasks(spark, tmp_path):
    """Before, a table in one small file met the broadcast one in one task, however many pairs they make."""
    rng, s, made = random.Random(8), Session(spark), {}
    for name, n in (("many", 15_000), ("few", 10_000)):
        made[name] = [(i, rng.randrange(25), rng.random()) for i in range(n)]
        spark.createDataFrame(made[name], f"{name}_id long, {name}_at int, {name}_x double").coalesce(1).write.parquet(str(tmp_path / name))
        s.catalog.register(name, spark.read.parquet(str(tmp_path / name)))
    for a, b in (("many", "few"), ("few", "many")):
        pairs = s.sql(f"select many_id, few_id from {a} join {b} on (many_at = few_at and many_x < few_x)")
        assert pairs.rdd.getNumPartitions() >= 4
        of = [sorted(x for _, at, x in made["few"] if at == k) for k in range(25)]
        assert pairs.count() == pairs.distinct().count() == sum(len(of[k]) - bisect.bisect_right(of[k], x) for _, k, x in made["many"])
    # ids alone and a comparison of one side are left to Spark
    for on in ("many_id = few_id", "many_id = few_id and many_x < 0.5"):
        assert "RoundRobin" not in s.sql(f"select many_id from many join few on ({on})")._jdf.queryExecution().executedPlan().toString()
