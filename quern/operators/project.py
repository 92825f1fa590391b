"""Facts of projects from their files, tags and calls. ``files`` have a column project (several can be told at once) and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import first_rows

#: Languages by extension, entry names, signals of entries, directories that don't tell the project's type, and web code.
LANGUAGE_EXTENSIONS = {"java": ["java", "kt", "scala"], "js": ["js", "jsx", "ts", "tsx"], "cpp": ["c", "h", "cpp", "hpp", "cc", "cxx"], "go": ["go"], "python": ["py", "pyw"]}
ENTRY_STEMS = ["main", "app", "cli", "server", "index", "__main__"]
ENTRY_SIGNALS = ["network_operation", "cmd_exec"]
UNTOLD_DIRS = [".git", "__pycache__", "node_modules", "venv", ".venv", "dist", "build", ".tox", ".eggs", "egg-info", ".mypy_cache", ".pytest_cache", "tests", "test", "docs", "examples"]
MANIFESTS = ["setup.py", "pyproject.toml", "package.json", "pom.xml", "go.mod", "Cargo.toml", "requirements.txt"]


def extension(path: Column) -> Column:
    """The lower-case extension of the last component, '' without one."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def context(files: DataFrame, supported: dict[str, str]) -> DataFrame:
    """(project, files, supported, languages, manifests): counts of all files and of those with a known extension (extension: language), the sorted set
    of languages, and the paths of manifests. Null paths count as files."""
    language = F.element_at(F.create_map(*[F.lit(x) for kv in supported.items() for x in kv]), extension(F.col("path")))
    name = F.substring_index("path", "/", -1)
    return files.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"),
        F.count(language).alias("supported"),
        F.array_sort(F.collect_set(language)).alias("languages"),
        F.array_sort(F.collect_set(F.when(name.isin(MANIFESTS), F.col("path")))).alias("manifests"),
    )


def main_language(files: DataFrame) -> DataFrame:
    """(project, language): the language of most files, of equal ones that of the first path; projects without any are left out."""
    kind = F.lit(None).cast("string")
    for language, endings in LANGUAGE_EXTENSIONS.items():
        kind = F.when(extension(F.col("path")).isin(endings), language).otherwise(kind)
    counts = files.withColumn("language", kind).filter("language is not null").groupBy("project", "language").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    return counts.groupBy("project").agg(F.min_by("language", F.struct(-F.col("n"), "first")).alias("language"))


def project_type(files: DataFrame, patterns: list[str], most: int = 50) -> DataFrame:
    """(project, kind): app if one of the first ``most`` Python files by path outside of test and tool directories matches a web pattern, else lib."""
    inside = "(^|/)(" + "|".join(d.replace(".", "\\.") for d in UNTOLD_DIRS) + ")/"
    python = files.filter(F.col("path").endswith(".py") & ~F.col("path").rlike(inside))
    first = first_rows(python.select("project", "path"), ["project"], ["path"], most)
    web = F.lit(False)
    for p in patterns:
        web = web | F.coalesce(F.col("source").rlike(p), F.lit(False))
    found = python.join(first, ["project", "path"], "left_semi").groupBy("project").agg(F.bool_or(web).alias("web"))
    return files.select("project").distinct().join(found, "project", "left").select("project", F.when(F.col("web"), "app").otherwise("lib").alias("kind"))


def entry_points(files: DataFrame, tags: DataFrame) -> DataFrame:
    """(project, path): files named like entries, that define main, or with a network or command signal; the first path of a project without any.

    ``tags``: file (a path), name, kind, signal.
    """
    named = files.filter(F.lower(stem(F.col("path"))).isin(ENTRY_STEMS)).select("project", "path")
    told = tags.filter(((F.col("kind") == "def") & (F.col("name") == "main")) | ((F.col("kind") == "signal") & F.col("signal").isin(ENTRY_SIGNALS)))
    by_tag = files.select("project", "path").join(told.select(F.col("file").alias("path")).distinct(), "path", "left_semi").select("project", "path")
    found = named.union(by_tag).distinct()
    first = files.groupBy("project").agg(F.min("path").alias("path")).join(found.select("project").distinct(), "project", "left_anti")
    return found.unionByName(first)


def call_projection(calls: DataFrame) -> DataFrame:
    """(callee, caller): distinct names on both sides of calls (caller_name, callee_name); rows without a name are left out."""
    return calls.filter("caller_name is not null AND callee_name is not null").select(F.col("callee_name").alias("callee"), F.col("caller_name").alias("caller")).distinct()


def lookup(functions: DataFrame, name: str, part: bool, most: int = 20) -> DataFrame:
    """The first ``most`` functions (file, name, line) of a name, or with it as a part in any case, by file and line."""
    hit = F.lower("name").contains(name.lower()) if part else F.col("name") == name
    return functions.filter(hit).orderBy("file", "line").limit(most)


def callers_of(calls: DataFrame, name: str, most: int = 20) -> DataFrame:
    """The first ``most`` names that call ``name``."""
    return call_projection(calls).filter(F.col("callee") == name).select("caller").orderBy("caller").limit(most)


def callees_of(calls: DataFrame, name: str, most: int = 20) -> DataFrame:
    """The first ``most`` names that ``name`` calls."""
    return call_projection(calls).filter(F.col("caller") == name).select("callee").orderBy("callee").limit(most)


def flows(paths: DataFrame, severity: str | None = None, file: str | None = None, sink: str | None = None, most: int = 20) -> DataFrame:
    """The first ``most`` taint paths (file, line, sink, severity) that have the severity and the parts of file and sink that are asked for."""
    for column, part in (("file", file), ("sink", sink)):
        if part:
            paths = paths.filter(F.col(column).contains(part))
    if severity:
        paths = paths.filter(F.col("severity") == severity)
    return paths.orderBy("file", "line", "sink").limit(most)


def listing(paths: DataFrame, folder: str) -> DataFrame:
    """(name, is_dir, place) of what stands in ``folder``: directories first, then by lower-case name; names that begin with a dot are hidden."""
    prefix = folder.rstrip("/") + "/" if folder else ""
    below = paths.filter(F.col("path").startswith(prefix)).select(F.substring("path", len(prefix) + 1, 1 << 30).alias("rest"))
    names = below.select(F.substring_index("rest", "/", 1).alias("name"), F.col("rest").contains("/").alias("is_dir")).filter("name <> '' AND NOT startswith(name, '.')")
    return names.groupBy("name").agg(F.max("is_dir").alias("is_dir")).orderBy(F.desc("is_dir"), F.lower("name"), "name")
