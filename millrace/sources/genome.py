"""Genome data: FASTA references and SAM reads into base-centric tables, and back to SAM.

Only text formats are read. Every row-producing step is a distributed explode; the only order that matters, lines of one
FASTA contig, is kept by reading contigs as records split at ``>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bases of a contig are numbered from contig id times this.
CONTIG_STRIDE = 10_000_000_000


def import_reference(spark: SparkSession, path: str, genome: str = "reference", genome_id: int = 1) -> dict[str, DataFrame]:
    """REFERENCE_GENOME, CONTIG and REFERENCE_BASE of a FASTA file. Contig ids follow the order of names."""
    records = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    parts = records.select(F.regexp_extract("value", r"^(\S+)", 1).alias("C_NAME"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    # one row per contig goes through the numbering, never its bases
    named = parts.select("C_NAME").withColumn("C_ID", F.row_number().over(Window.orderBy("C_NAME")).cast("long"))
    contig = named.select("C_ID", "C_NAME", F.lit(genome_id).cast("long").alias("C_RG_ID"))
    bases = parts.join(named, "C_NAME").select("C_ID", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    base = bases.select((F.col("C_ID") * CONTIG_STRIDE + F.col("pos")).alias("RB_ID"), F.upper("base").alias("RB_BASE_VALUE"), (F.col("pos") + 1).cast("int").alias("RB_POSITION"), F.col("C_ID").alias("RB_C_ID"))
    head = spark.createDataFrame([(genome_id, genome)], "RG_ID long, RG_NAME string")
    return {"REFERENCE_GENOME": head, "CONTIG": contig, "REFERENCE_BASE": base}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The alignment lines of a SAM file, with a read id."""
    f = F.split("value", "\t")
    names = ["QNAME", "FLAG", "RNAME", "POS", "MAPQ", "CIGAR", "RNEXT", "PNEXT", "TLEN", "SEQ", "QUAL"]
    rows = spark.read.text(path).where("value not like '@%' and value <> ''").select(F.xxhash64("value").alias("R_ID"), *[f[i].alias(n) for i, n in enumerate(names)])
    return rows.withColumns({n: F.col(n).cast("int") for n in ("FLAG", "POS", "MAPQ", "PNEXT", "TLEN")})


def _steps(cigar: str) -> Column:
    """A CIGAR as structs (op, n, read, ref): offsets of each run in the read and in the reference."""
    runs = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), 0), lambda r: F.struct(F.regexp_extract(r, "[A-Z=]", 0).alias("op"), F.regexp_extract(r, r"\d+", 0).cast("int").alias("n")))
    start = F.struct(F.lit(0).alias("read"), F.lit(0).alias("ref"), F.expr("cast(array() as array<struct<op: string, n: int, read: int, ref: int>>)").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        on_read = F.when(r["op"].isin("M", "I", "S", "=", "X"), r["n"]).otherwise(0)
        on_ref = F.when(r["op"].isin("M", "D", "N", "=", "X"), r["n"]).otherwise(0)
        return F.struct((acc["read"] + on_read).alias("read"), (acc["ref"] + on_ref).alias("ref"), F.array_append(acc["out"], F.struct(r["op"].alias("op"), r["n"].alias("n"), acc["read"].alias("read"), acc["ref"].alias("ref"))).alias("out"))

    return F.aggregate(runs, start, step, lambda acc: acc["out"])


def import_sample(sam: DataFrame, contig: DataFrame, genome: str = "sample", genome_id: int = 1) -> dict[str, DataFrame]:
    """SAMPLE_GENOME, READ and SAMPLE_BASE. Unmapped reads (flag 4, or no contig) are left out; mates share a name.

    Matches give one base each, insertions have the last reference base and an insert offset from 1, deletions
    are base X with the read's average quality; clipped bases are left out.
    """
    mapped = sam.where("(FLAG & 4) = 0 and RNAME <> '*'").join(contig.select("C_ID", F.col("C_NAME").alias("RNAME")), "RNAME")
    pair = Window.partitionBy("QNAME").orderBy("FLAG", "R_ID")
    mate = F.coalesce(F.lead("R_ID").over(pair), F.lag("R_ID").over(pair), F.lit(0))
    reads = mapped.withColumn("R_MATE_ID", F.when((F.col("FLAG").bitwiseAND(F.lit(1))) == 1, mate).otherwise(F.lit(0)).cast("long"))
    read = reads.select("R_ID", F.col("QNAME").alias("R_QNAME"), F.col("MAPQ").alias("R_MAPQ"), F.col("FLAG").alias("R_FLAG"), F.lit(genome_id).cast("long").alias("R_SG_ID"), "R_MATE_ID")
    quality = F.transform(F.split("QUAL", ""), lambda c: F.ascii(c) - 33)
    average = F.aggregate(quality, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(quality), F.lit(1))
    runs = mapped.select("R_ID", "C_ID", "POS", "SEQ", quality.alias("q"), average.cast("int").alias("avg"), F.explode(_steps("CIGAR")).alias("s"))
    each = runs.where("s.op in ('M', '=', 'X', 'I', 'D')").select("*", F.explode(F.sequence(F.lit(0), F.col("s.n") - 1)).alias("k"))
    first = F.col("C_ID") * CONTIG_STRIDE + F.col("POS") - 1
    inserted, deleted = F.col("s.op") == "I", F.col("s.op") == "D"
    place = first + F.col("s.ref") + F.when(inserted, F.lit(-1)).otherwise(F.col("k"))
    at = F.col("s.read") + F.col("k")
    base = each.select(
        F.xxhash64("R_ID", "s.read", "s.ref", "k").alias("SB_ID"), F.when(deleted, "X").otherwise(F.upper(F.substring("SEQ", at + 1, F.lit(1)))).alias("SB_BASE_VALUE"),
        F.when(deleted, F.col("avg")).otherwise(F.coalesce(F.get("q", at), F.lit(0))).cast("int").alias("SB_BASE_CALL_QUALITY"), F.when(inserted, F.col("k") + 1).otherwise(0).cast("int").alias("SB_INSERT_OFFSET"),
        F.col("R_ID").alias("SB_READ_ID"), place.alias("SB_RB_ID"),
    )
    head = sam.sparkSession.createDataFrame([(genome_id, genome)], "SG_ID long, SG_NAME string")
    return {"SAMPLE_GENOME": head, "READ": read, "SAMPLE_BASE": base}


def export_sam(tables: dict[str, DataFrame], contig: str | None = None, start: int = -1, end: int = -1) -> DataFrame:
    """SAM lines (``value``) of the reads with a base in the chosen region; -1 and None choose everything.

    A read's bases are put in order within one row: a read has bounded length.
    """
    bases = tables["SAMPLE_BASE"].join(tables["REFERENCE_BASE"].join(tables["CONTIG"], F.col("RB_C_ID") == F.col("C_ID")), F.col("SB_RB_ID") == F.col("RB_ID"))
    inside = F.lit(True) if contig is None else F.col("C_NAME") == contig
    inside = inside & ((F.col("RB_POSITION") >= start) if start >= 0 else F.lit(True)) & ((F.col("RB_POSITION") <= end) if end >= 0 else F.lit(True))
    op = F.when(F.col("SB_BASE_VALUE") == "X", "D").when(F.col("SB_INSERT_OFFSET") > 0, "I").otherwise("M")
    per_read = bases.where(inside).groupBy("SB_READ_ID", "C_NAME").agg(F.array_sort(F.collect_list(F.struct("RB_POSITION", "SB_INSERT_OFFSET", op.alias("op"), "SB_BASE_VALUE", "SB_BASE_CALL_QUALITY"))).alias("b"))
    return (
        per_read.join(tables["READ"], F.col("SB_READ_ID") == F.col("R_ID"))
        .select(F.concat_ws("\t", "R_QNAME", F.col("R_FLAG").cast("string"), "C_NAME", F.col("b")[0]["RB_POSITION"].cast("string"), F.col("R_MAPQ").cast("string"), cigar(F.transform("b", lambda x: x["op"])), F.lit("*"), F.lit("0"), F.lit("0"),
            F.array_join(F.transform(F.filter("b", lambda x: x["op"] != "D"), lambda x: x["SB_BASE_VALUE"]), ""), F.array_join(F.transform(F.filter("b", lambda x: x["op"] != "D"), lambda x: F.chr(x["SB_BASE_CALL_QUALITY"] + 33)), "")).alias("value"))
    )


def cigar(ops: Column) -> Column:
    """Run lengths of an array of operations, as text."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("op"), F.lit(0).alias("n"))
    close = lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], acc["n"].cast("string"), acc["op"])).otherwise(acc["out"])
    step = lambda acc, x: F.when(acc["op"] == x, F.struct(acc["out"].alias("out"), acc["op"].alias("op"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(close(acc).alias("out"), x.alias("op"), F.lit(1).alias("n")))
    return F.aggregate(ops, start, step, close)
