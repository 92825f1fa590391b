"""Classifiers as Spark columns. Ordered rule lists become one CASE, so they stay in generated code and need no join."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

#: Python's \\w, \\d and \\s hold Unicode characters, Java's only with this flag.
UNICODE = "(?U)"


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def first_of(rules: list[tuple[Column, object]], otherwise: Column | None = None) -> Column:
    out = F
    for condition, value in rules:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise) if otherwise is not None else out


def named(name: Column, value: str) -> Column:
    """The name itself or a dotted name that ends in it."""
    return (name == value) | name.endswith(f".{value}")


def classify_sink(name: Column) -> Column:
    exact = [(named(name, p), kind) for p, kind in T.EXACT_SINKS]
    return first_of(exact + [(name.rlike(f"(?i){p}"), kind) for p, kind in T.SINK_REGEX])


def is_entry_point(name: Column) -> Column:
    return name.rlike("|".join(f"(?:{p})" for p in T.ENTRY_POINTS))


def classify_body(source: Column) -> Column:
    return first_of([(source.rlike(UNICODE + p), kind) for p, kind in T.SENSITIVE_CALLS])


def source_of(expression: Column, sources: list[str] = T.PYTHON_SOURCES) -> Column:
    """The first source that the expression equals or starts with; ``f(...)`` starts with f."""
    return first_of([(expression.startswith(s), s) for s in sources])


def sink_of(call: Column, sinks: dict[str, str] = T.PYTHON_SINKS) -> Column:
    """The sink: equal, or a dotted call whose end is a sink without a dot."""
    return first_of([(call == s if "." in s else named(call, s), s) for s in sinks])


def is_sanitizer(call: Column, sanitizers: list[str] = T.PYTHON_SANITIZERS) -> Column:
    return any_of([named(call, s) for s in sanitizers])


def is_noise_call(call: Column) -> Column:
    name = F.lower(F.trim(call))
    return name.isin(T.NOISE_CALLS) | name.rlike(f"^(log|logger|logging)\\.({'|'.join(T.LOG_LEVELS)})$")


def has_term(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    return any_of([low.contains(t) for t in terms])


def has_depth_guard(text: Column) -> Column:
    return any_of([text.rlike(UNICODE + p) for p in T.DEPTH_GUARDS])


def sink_type(name: Column) -> Column:
    low = F.lower(name)
    exact = [(name == k, v) for k, v in T.SINK_TYPES.items()]
    return first_of(exact + [(any_of([low.contains(p) for p in parts]), kind) for parts, kind in T.SINK_TYPE_PARTS], F.lit("sink"))


def rule_id(sink: Column) -> Column:
    return first_of([(sink == k, v) for k, v in T.RULE_IDS.items()], F.concat(F.lit("taint-to-"), F.replace(sink, F.lit("."), F.lit("-"))))


def glob_regex(glob: str) -> str:
    """A file name pattern with * as a regular expression on the whole path."""
    return "(?s)^" + ".*".join(re.escape(p) for p in glob.split("*")) + "$"


def file_score(path: Column, relative: Column) -> tuple[Column, Column]:
    """(score before the filter on > 0, reasons) of a path."""
    high = F.filter(F.array(*[F.when(path.rlike(glob_regex(g)), F.lit(f"matches {g}")) for g in T.HIGH_GLOBS]), lambda x: x.isNotNull())
    score = F.least(20 * F.size(high), F.lit(80))
    score = F.when(any_of([path.rlike(glob_regex(g)) for g in T.LOW_GLOBS]), F.greatest(score - 30, F.lit(0))).otherwise(score)
    depth = F.length(relative) - F.length(F.replace(relative, F.lit("/"), F.lit("")))
    score = score + F.when(depth >= 3, 5).otherwise(0) + F.when(any_of([path.endswith(e) for e in T.CODE_EXTENSIONS]), 10).otherwise(0)
    reasons = F.when(F.size(high) == 0, F.lit("heuristic match")).otherwise(F.array_join(F.slice(high, 1, 3), "; "))
    return F.least(score, F.lit(100)), reasons


def is_noise_file(path: Column, size: Column, text: Column) -> Column:
    """Cheapest tests first: name, directory, size, then mean length of the non-blank lines among the first 20."""
    lines = F.filter(F.slice(F.split(text, "\r\n|\n|\r"), 1, 20), lambda x: F.trim(x) != "")
    mean = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) / F.size(lines)
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        any_of([path.endswith(n) for n in T.NOISE_NAMES])
        | any_of([slashed.contains(d) for d in T.NOISE_DIRS])
        | (size > T.MAX_FILE_SIZE)
        | F.coalesce(F.when(F.size(lines) > 0, mean > T.MAX_MEAN_LINE), F.lit(False))
    )


def bridge_evidence(storer: Column, reader: Column) -> dict[str, Column]:
    """External source in the storer; dangerous sink in the reader, whose last matching pattern sets the type."""
    hits = F.filter(F.array(*[F.when(reader.rlike(p), F.lit(kind)) for p, kind in T.BRIDGE_SINKS]), lambda x: x.isNotNull())
    return {
        "storer_external_source": any_of([storer.rlike(p) for p in T.STORER_SOURCES]),
        "reader_dangerous_sink": F.size(hits) > 0,
        "sink_type": F.coalesce(F.get(hits, F.size(hits) - 1), F.lit("unknown")),
    }


def path_bridge(block: Column) -> Column:
    """The first consumer's type where a path is built and consumed in one block, else null."""
    builds = any_of([block.rlike(p) for p in T.PATH_BUILDERS])
    return F.when(builds, first_of([(block.rlike(p), kind) for p, kind in T.PATH_CONSUMERS]))


def normalise_vuln_type(raw: Column) -> Column:
    low = F.trim(F.lower(raw))
    return first_of([(low == k, v) for k, v in T.VULN_ALIASES.items()], low)
