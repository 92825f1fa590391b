"""File, rule, graph and finding readers; report and store writers. Everything goes through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import classify as C
from quern.operators.graph import climb

#: Directories that are not entered and languages by extension.
EXCLUDED_DIRS = [".git", ".svn", "__pycache__", "node_modules", "venv", ".venv", ".env", "dist", "build", ".tox", ".eggs", "egg-info", ".idea", ".vscode", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".terraform", ".next", ".nuxt"]
LANGUAGES = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript"}


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return C.first_of([(ext == e, name) for e, name in LANGUAGES.items()])


def source_files(spark: SparkSession, root: str, keep_noise: bool = False) -> DataFrame:
    """(path, language, size, source) of the source files below ``root``, without excluded directories and noise.

    Names are filtered before contents are read into columns; undecodable bytes are replaced.
    """
    names = "{" + ",".join(f"*.{e}" for e in LANGUAGES) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    inside = F.concat(F.lit("(^|/)("), F.lit("|".join(d.replace(".", "\\.") for d in EXCLUDED_DIRS)), F.lit(")/"))
    rows = raw.filter(~F.regexp_like("path", inside)).select("path", language_of(F.col("path")).alias("language"), F.col("length").alias("size"), F.col("content").cast("string").alias("source"))
    return rows if keep_noise else rows.filter(~C.is_noise_file(F.col("path"), F.col("size"), F.col("source")))


def call_graph_csv(spark: SparkSession, functions: str, calls: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, name, line, id) and edges (src, dst) of two CSV files; bad rows are dropped, edges need both nodes."""
    read = lambda path, schema: spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(path)
    nodes = read(functions, "file string, name string, line int").filter("file is not null AND name is not null AND line is not null").withColumn("id", F.concat("file", F.lit("::"), "name")).dropDuplicates(["id"])
    edges = read(calls, "caller_file string, caller string, callee_file string, callee string").filter("callee is not null")
    edges = edges.select(F.concat("caller_file", F.lit("::"), "caller").alias("src"), F.concat("callee_file", F.lit("::"), "callee").alias("dst"))
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges


def findings_csv(spark: SparkSession, sinks: str, flows: str, kind: str) -> DataFrame:
    """Paths of a sink file (confidence .6) and a flow file (.8, whole paths); of equal keys the first row stays, flows before sinks."""
    s = spark.read.schema("name string, file string, line int, text string").option("mode", "DROPMALFORMED").csv(sinks).filter("line is not null")
    f = spark.read.schema("source string, source_file string, source_line int, sink string, file string, line int").option("mode", "DROPMALFORMED").csv(flows).filter("line is not null")
    flat = lambda df, name, p, conf, whole: df.select(F.lit(kind).alias("kind"), F.col(name).alias("sink"), "file", "line", F.lit(conf).alias("confidence"), F.lit(whole).alias("is_full"), F.lit(p).alias("p"))
    rows = flat(f, "sink", 0, 0.8, True).unionByName(flat(s, "name", 1, 0.6, False))
    key = F.concat_ws(":", "kind", "file", "line").alias("key")
    return rows.groupBy(key).agg(F.min_by(F.struct("kind", "sink", "file", "line", "confidence", "is_full"), F.struct("p", "sink")).alias("r")).select("key", "r.*")


def graphson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Methods (id, name) and calls (src, dst) of a code property graph with one JSON object of vertices and edges.

    External methods are dropped. A call edge starts at the nearest method above its vertex; it goes to the method with
    its target's id, else to the last one with its target's name.
    """
    schema = "vertices array<struct<id:long,label:string,name:string,external:boolean>>, edges array<struct<label:string,outV:long,inV:long>>"
    g = spark.read.schema(schema).option("multiLine", "true").json(path)
    v = g.select(F.posexplode("vertices").alias("at", "v")).select("at", "v.*")
    e = g.select(F.inline("edges"))
    methods = v.filter((F.col("label") == "METHOD") & ~F.coalesce("external", F.lit(False))).select("id", "name", "at")
    tree = e.filter("label = 'CONTAINS'").select(F.col("inV").alias("child"), F.col("outV").alias("parent"))
    callers = climb(tree, v.select(F.col("id").alias("node"), F.col("label").alias("kind")), "METHOD")
    calls = e.filter("label = 'CALL'").select(F.col("outV").alias("node"), F.col("inV").alias("target"))
    calls = calls.join(callers, "node").select(F.col("ancestor").alias("src"), "target")
    by_name = methods.groupBy("name").agg(F.max_by("id", "at").alias("named"))
    names = v.select(F.col("id").alias("target"), "name")
    found = calls.join(methods.select(F.col("id").alias("target"), F.col("id").alias("same")), "target", "left").join(names, "target", "left").join(by_name, "name", "left")
    edges = found.select("src", F.coalesce("same", "named").alias("dst")).filter("dst is not null").join(methods.select(F.col("id").alias("src")), "src", "left_semi")
    return methods.drop("at"), edges.distinct()


def rules_yaml(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(id, name, lang, severity, query, capture_group, match_any) of rule files (path, text); a file holds one rule or a list, bad files have none."""
    from collections.abc import Iterator

    import pandas as pd

    schema = "id string, name string, lang string, severity string, query string, capture_group string, match_any array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for f in frames:
            rows = []
            for text in f["text"]:
                try:
                    found = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                for r in found if isinstance(found, list) else [found]:
                    if isinstance(r, dict) and r.get("id"):
                        rows.append([str(r["id"]), r.get("name"), r.get("lang", "python"), r.get("severity", "medium"), r.get("query"), r.get("capture_group"), r.get("match_any")])
            yield pd.DataFrame(rows, columns=["id", "name", "lang", "severity", "query", "capture_group", "match_any"])

    return texts.select("path", "text").mapInPandas(run, schema)


def write_report(findings: DataFrame, folder: str) -> None:
    """Findings as JSON lines, and their counts by severity beside them."""
    findings.write.mode("overwrite").json(f"{folder}/findings")
    findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{folder}/summary")


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store's table; a missing one is empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def call_graph_markdown(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(value): one Markdown table row for each function with its degrees and rank."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    rows = nodes.join(out, "id", "left").join(into, "id", "left").join(ranks.withColumnRenamed("node", "id"), "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", "file", "name", zero("i"), zero("o"), F.format_number(F.coalesce("rank", F.lit(0.0)), 4)), F.lit(" |")).alias("value"))


#: Text that asks for a file's functions wherever it stands.
DANGEROUS_IMPORTS = ["import shelve", "from shelve", "import pickle", "from pickle", "import marshal", "from marshal", "import yaml", "from yaml", "import subprocess", "from subprocess", "import tarfile", "from tarfile", "import zipfile", "from zipfile"]


def build_index(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``files`` (path, language, size, source) of an index with ``full``: whether functions are extracted from the file.

    Files in excluded directories, of unknown languages, noise and texts that aren't UTF-8 (null or with replacement marks) are
    left out. ``wanted``: (path) of the files to extract in full; others are only if they hold a dangerous import. Without it all are.
    """
    inside = F.concat(F.lit("(^|/)("), F.lit("|".join(d.replace(".", "\\.") for d in EXCLUDED_DIRS)), F.lit(")/"))
    known = files.filter(~F.regexp_like("path", inside) & language_of(F.col("path")).isNotNull() & F.col("source").isNotNull() & ~F.col("source").contains("�"))
    known = known.filter(~C.is_noise_file(F.col("path"), F.col("size"), F.col("source")))
    if wanted is None:
        return known.withColumn("full", F.lit(True))
    asked = wanted.select(F.regexp_replace("path", "^(\\./)+", "").alias("path"), F.lit(True).alias("__asked")).distinct()
    dangerous = F.exists(F.array(*[F.lit(p) for p in DANGEROUS_IMPORTS]), lambda p: F.col("source").contains(p))
    return known.join(asked, "path", "left").withColumn("full", F.coalesce("__asked", F.lit(False)) | dangerous).drop("__asked")


def write_checkpoint(state: DataFrame, path: str) -> None:
    """A state's rows as JSON lines; what stood at ``path`` is replaced."""
    state.write.mode("overwrite").json(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A checkpoint's rows; a missing one is empty, fields that don't fit are null, lines that aren't JSON are left out."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
