"""Queries of parsing and taint operators on code files that are literals here; the tables of the benchmark hold no code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import taint
from quern.registry import query
from quern.sources import python_code

FILES = [
    ("app.py", "import sys\nimport lib as helper\nfrom lib import run\n\ndef main(argv):\n    code = sys.argv[1]\n    text = code.strip()\n    run(text)\n    helper.run(code)\n\nclass Page:\n    def get(self, name):\n        q = input()\n        if name:\n            eval(q)\n        return self.show(q)\n\n    def show(self, q):\n        print(q)\n"),
    ("lib.py", "def run(code, mode='x'):\n    eval(code)\n    again(code)\n\ndef again(c):\n    exec(c)\n    third(c)\n\ndef third(c):\n    os.system(c)\n    fourth(c)\n\ndef fourth(c):\n    compile(c)\n"),
    ("bad.py", "def broken(:\n    pass\n"),
    ("clean.py", "def add(a, b):\n    return a + b\n"),
    ("empty.py", None),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, source string")


@query(
    "S6_python_functions",
    "SELECT * FROM (VALUES ('app.py', 'function', 'main', 5, 'argv'), ('app.py', 'class', 'Page', 11, ''), ('app.py', 'function', 'Page.get', 12, 'self,name'), ('app.py', 'function', 'Page.show', 18, 'self,q'), ('lib.py', 'function', 'run', 1, 'code,mode'), ('lib.py', 'function', 'again', 5, 'c'), ('lib.py', 'function', 'third', 9, 'c'), ('lib.py', 'function', 'fourth', 13, 'c'), ('bad.py', 'parse_error', '', 1, ''), ('clean.py', 'function', 'add', 1, 'a,b')) v(file, kind, fullname, line, params)",
)
def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = python_code.parse(files(spark)).filter("kind IN ('function', 'class', 'parse_error')")
    return rows.select("file", "kind", "fullname", "line", F.array_join("params", ",").alias("params"))


@query("S9_imports", "SELECT * FROM (VALUES ('app.py', 'sys', 'sys'), ('app.py', 'helper', 'lib'), ('app.py', 'run', 'lib.run')) v(file, alias, module)")
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.parse(files(spark)).filter("kind = 'import'").select("file", F.col("name").alias("alias"), F.col("fullname").alias("module"))


@query("F14_recursive_functions", "SELECT 'r.py' AS file, 'walk' AS fn")
def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that hold a call of their own name, by containment of lines."""
    more = spark.createDataFrame([("r.py", "def walk(n):\n    return walk(n - 1)\n\ndef top():\n    walk(3)\n")], "path string, source string")
    rows = python_code.parse(files(spark).union(more))
    fns = rows.filter("kind = 'function'").select("file", F.col("name").alias("fn"), F.col("line").alias("low"), F.col("end_line").alias("high"))
    calls = rows.filter("kind = 'call'").select("file", "name", "line")
    return fns.join(calls, "file").filter("fn = name AND line BETWEEN low AND high").select("file", "fn").distinct()


@query(
    "T1_T5_taint_paths",
    "SELECT * FROM (VALUES ('sys.argv', 6, 'eval', 'lib.py', 2, 1), ('input', 13, 'eval', 'app.py', 15, 0), ('sys.argv', 6, 'exec', 'lib.py', 6, 2), ('sys.argv', 6, 'os.system', 'lib.py', 10, 3)) v(source, origin_line, sink, file, line, depth)",
)
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.taint_paths(python_code.parse(files(spark))).select("source", "origin_line", "sink", "file", "line", "depth")
