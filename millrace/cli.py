"""The command interpreter: one command per line; anything that starts like SQL is SQL.

    python -m millrace.cli [script ...]
"""

from __future__ import annotations

import shlex
import sys
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from millrace.session import Session
from millrace.sources import genome
from millrace.sources.formats import render
from millrace.sources.pipe_csv import read_pipe_csv, read_self_describing, write_pipe_csv, write_self_describing
from millrace.types import PlanError

VERSION = "1.0"
SQL_STARTS = ("select", "create", "insert", "update", "drop")
#: Settings of other hardware are accepted and change nothing.
IGNORED = ("setdevice", "setparallelizationmode")


class Interpreter:
    def __init__(self, session: Session, out: Callable[[str], None] = print):
        self.s, self.out, self.history, self.started = session, out, [], 0.0
        self.printing = threading.Lock()
        self.settings = session.engine.settings
        self.settings.update({"result_output_format": "table", "genotype_frequency_min": "0.2", "genotype_frequency_max": "0.8"})
        c = self.s.catalog
        self.commands: dict[str, Callable[[list[str]], object]] = {
            "loaddatabase": lambda a: c.load_database(a[0] if a else self.settings["path_to_database"]), "unloaddatabase": lambda a: c.unload(),
            "import_csv_file": self.import_csv, "export_csv_file": lambda a: write_pipe_csv(c.table(a[0]).df, a[1]), "import_table_file": lambda a: c.register(a[0], read_self_describing(c.spark, a[1])) and None, "export_table_file": lambda a: write_self_describing(c.table(a[0]).df, a[1]),
            "rename_table": lambda a: int(c.rename(*a)), "drop_table": lambda a: c.drop(a[0]), "store_table": lambda a: c.save(a[0], a[1] if len(a) > 1 else self.settings["path_to_database"]),
            "add_primary_key_constraint": lambda a: c.add_primary_key(*a), "add_foreign_key_constraint": lambda a: c.add_foreign_key(*a), "analyze_table": lambda a: c.analyze(a[0]),
            "integrityconstraints": lambda a: c.table("SYS_INTEGRITY_CONSTRAINTS").df, "printschema": lambda a: c.table("SYS_DATABASE_SCHEMA").df, "databasestatus": lambda a: "\n".join(f"{t.name}: {len(t.df.columns)} columns" for t in c.tables.values()),
            "exec": lambda a: self.s.sql(" ".join(a)), "explain": lambda a: self.explain(" ".join(a), "formatted"), "explain_unoptimized": lambda a: self.explain(" ".join(a), "extended"),
            "execute_query_from_json": lambda a: self.s.json("\n".join(r[0] for r in c.spark.read.text(a[0], wholetext=True).collect())), "execute_script": lambda a: self.script(a[0]),
            "set": self.set, "print": lambda a: f"{a[0]}={self.settings.get(a[0], '')}", "parallelexec": self.parallel,
            "import_reference_genome": lambda a: self.register(genome.import_reference(c.spark, a[0])), "import_sample_genome": lambda a: self.register(genome.import_sample(genome.read_sam(c.spark, a[0]), c.table("CONTIG").df)),
            "export_sample_genome": lambda a: genome.export_sam({t: c.table(t).df for t in ("SAMPLE_BASE", "REFERENCE_BASE", "CONTIG", "READ")}, *[None if i == 0 and x == "-1" else x if i == 0 else int(x) for i, x in enumerate(a[1:])]).write.mode("overwrite").text(a[0]),
            "starttimer": lambda a: setattr(self, "started", time.time()), "stoptimer": lambda a: f"{time.time() - self.started:.3f} s", "history": lambda a: "\n".join(self.history),
            "help": lambda a: " ".join(sorted(self.commands)), "version": lambda a: VERSION, "about": lambda a: "A Spark-native engine for star-schema queries",
        } | {k: (lambda a: None) for k in IGNORED}

    def execute(self, line: str) -> object:
        """Run one line; results are printed and returned. Comments and empty lines do nothing."""
        line = line.strip()
        if not line or line.startswith("#"):
            return None
        self.history.append(line)
        name, _, rest = line.partition(" ")
        if name.lower() in self.commands:
            rest = rest.strip()
            args = [rest] if name.lower() in ("exec", "explain", "explain_unoptimized", "set") else shlex.split(rest)
            result = self.commands[name.lower()](args)
        elif name.lower() in SQL_STARTS:
            result = self.s.sql(line)
        else:
            raise PlanError(f"unknown command {name}")
        if hasattr(result, "collect"):
            with self.printing:  # the parts of a result stay together
                for part in render(result, self.settings["result_output_format"]):
                    self.out(part)
        elif result is not None:
            self.out(str(result))
        return result

    def register(self, tables: dict) -> None:
        for name, df in tables.items():
            self.s.catalog.register(name, df)

    def import_csv(self, a: list[str]) -> None:
        """Rows of a file into a table that exists already."""
        t = self.s.catalog.table(a[0])
        t.df, t.rows = t.df.unionByName(read_pipe_csv(self.s.catalog.spark, a[1], t.df.schema)), None

    def set(self, a: list[str]) -> None:
        key, _, value = a[0].partition("=")
        self.settings[key.strip()] = value.strip()

    def explain(self, text: str, mode: str) -> str:
        query = self.s.sql(text)._jdf.queryExecution()
        return query.toString() if mode == "extended" else query.simpleString()

    def script(self, path: str) -> None:
        for row in self.s.catalog.spark.read.text(path, wholetext=True).collect():
            for line in row[0].splitlines():
                self.execute(line)

    def parallel(self, a: list[str]) -> None:
        """``parallelexec N script``: N threads take the script's commands from one queue."""
        lines = [x for r in self.s.catalog.spark.read.text(a[1], wholetext=True).collect() for x in r[0].splitlines()]
        with ThreadPoolExecutor(int(a[0])) as pool:
            list(pool.map(self.execute, lines))


def main(paths: list[str]) -> None:
    spark = SparkSession.builder.appName("millrace").config("spark.scheduler.mode", "FAIR").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    it = Interpreter(Session(spark))
    lines = (line for p in paths for line in open(p)) if paths else sys.stdin
    for line in lines:
        if line.strip().lower() in ("quit", "exit"):
            break
        try:
            it.execute(line)
        except PlanError as e:
            print(f"error: {e}")


if __name__ == "__main__":
    main(sys.argv[1:])
