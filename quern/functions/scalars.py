"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .classify import first_of


def join_paths(outer: Column, inner: Column) -> Column:
    """Class path and method path as one route; an inner path that starts with the outer one is whole already."""
    a, b, slash = F.btrim(outer, F.lit("/")), F.btrim(inner, F.lit("/")), F.lit("/")
    return first_of([((b == "") & (a == ""), "/"), (b == "", F.concat(slash, a)), ((a == "") | F.startswith(b, a), F.concat(slash, b))], F.concat(slash, a, slash, b))


def normalize_route(path: Column) -> Column:
    p = F.trim(F.lower(path))
    p = F.regexp_replace(p, "/$", "")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def resolve_params(path: Column) -> Column:
    """``${x}`` and ``:x`` become {param}; ``{x}`` is left as it is."""
    return F.regexp_replace(F.regexp_replace(path, r"\$\{[^}]+\}", "{param}"), r"(?U):\w+", "{param}")


def signal_confidence(hits: Column, weight: Column) -> Column:
    return weight * first_of([(hits >= 5, 1.0), (hits >= 2, 0.7)], F.lit(0.3))


def severity_of(raw: Column) -> Column:
    low = F.trim(F.lower(F.coalesce(raw, F.lit("medium"))))
    rules = [(low == s, s) for s in T.SEVERITY_MULTIPLIERS]
    rules += [(low.isin(*names), s) for s, names in (("critical", ("crit", "c")), ("high", ("h",)), ("medium", ("med", "m")), ("low", ("l",)))]
    return first_of(rules, F.lit("info"))


def exploitability(score: Column, severity: Column) -> tuple[Column, Column]:
    """(score by severity, rounded half to even as the scale demands; rating)."""
    times = first_of([(severity == s, m) for s, m in T.SEVERITY_MULTIPLIERS.items()], F.lit(0.7))
    adjusted = F.bround(score * times, 2)
    return adjusted, first_of([(adjusted >= t, name) for t, name in T.RATINGS], F.lit("none"))


def recommendation(adjusted: Column, blocked: Column) -> Column:
    """The band's name. As in what is matched, rows that are *not* blocked are called uncontrollable."""
    return first_of([(~blocked, "not controllable"), (adjusted >= 0.7, "high"), (adjusted >= 0.4, "medium"), (adjusted >= 0.1, "low")], F.lit("none"))


def top_module(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", 1)


def node_id(file: Column, function: Column) -> Column:
    return F.concat(file, F.lit("::"), function)


def node_parts(node: Column) -> tuple[Column, Column]:
    """(file, function) of a node id, cut at the last separator."""
    name = F.substring_index(node, "::", -1)
    return F.when(node.contains("::"), F.substring(node, F.lit(1), F.length(node) - F.length(name) - 2)).otherwise(F.lit("")), name


def parameter_names(signature: Column) -> Column:
    """Names of the parameters in the first parentheses, without self, cls, starred ones, defaults and annotations."""
    inside = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    names = F.transform(F.split(inside, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), "[:=].*$", "")))
    return F.filter(names, lambda n: (n != "") & ~n.isin("self", "cls") & ~n.startswith("*"))


def chunk_size(mean_tokens: Column, pressure: Column, seconds: Column, large: Column, target: int = 30_000, least: int = 5, most: int = 50) -> Column:
    size = F.lit(float(target)) / F.greatest(mean_tokens, F.lit(1.0))
    size = size * first_of([(pressure > 0.7, 0.5), (pressure > 0.5, 0.7)], F.lit(1.0))
    size = size * F.when(seconds > 300, 0.8).otherwise(1.0)
    size = size * first_of([(large > 0.3, 0.7), (large > 0.1, 0.85)], F.lit(1.0))
    return F.greatest(F.lit(least), F.least(F.lit(most), size.cast("int")))


def body_hash(code: Column) -> Column:
    """Key of a function's text: its first 200 characters without comments and blanks."""
    return F.md5(F.regexp_replace(F.regexp_replace(F.substring(code, 1, 200), "(?m)#.*$", ""), r"(?U)\s+", "").cast("binary"))


#: Code in back quotes, else in single or double ones from ten characters on.
HINTS = ["`([^`]+)`", "'([^']{10,})'", '"([^"]{10,})"']


def code_hint(text: Column) -> Column:
    """The longest quoted piece of the first sort of quotes that has any, the first of equal length; null without one."""
    longest = []
    for pattern in HINTS:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        best = F.aggregate(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
        longest.append(F.when(best != "", best))
    return F.coalesce(*longest)


def fuzzy_match(hint: Column, text: Column) -> Column:
    """Whether six in ten of the hint's distinct names of three letters and more stand in the text; false without any, and for nulls."""
    tokens = F.array_distinct(F.regexp_extract_all(hint, F.lit("[a-zA-Z_][a-zA-Z0-9_]{2,}"), F.lit(0)))
    return F.coalesce((F.size(tokens) > 0) & (F.size(F.filter(tokens, lambda k: text.contains(k))) >= 0.6 * F.size(tokens)), F.lit(False))
