"""Taint dataflow over parsed functions: one ordered pass within a function, rounds of calls between them.

The pass within a function is a fold over its statements; between functions a round per call depth joins the calls that
carry taint to the functions that they may mean. The table of (function, tainted parameters) is the frontier.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import tables as T

from .storage import materialise

_SCHEMA = "file string, fn string, kind string, line int, call string, sink string, source string, origin_line int, args string, seq long"


def _source(expression: str | None, sources: list[str]) -> str | None:
    return next((s for s in sources if expression and expression.startswith(s)), None)


def _sink(call: str, sinks: list[str]) -> str | None:
    return next((s for s in sinks if call == s or "." not in s and call.endswith("." + s)), None)


def follow(statements: list[dict], tainted: dict[str, tuple[str, int]], sources: list[str], sinks: list[str]) -> list[tuple]:
    """(kind, line, call, sink, source, origin line, arguments) of a function's tainted calls; ``tainted``: name to (source, line), grown in place.

    A target becomes tainted by a source, by a tainted name or a tainted part before a dot of it, or by a tainted name anywhere in the value;
    nothing makes it clean again. An argument is tainted only as a plain or dotted name, or, where it is given as a list of names, by any of them.
    A seed is a parameter that is a source itself.
    """
    out = []
    for s in statements:
        if s["do"] == "seed":
            tainted.setdefault(s["target"], (s["source"], s["line"]))
            continue
        if s["do"] == "assign":
            if source := _source(s["begins"], sources):
                tainted[s["target"]] = (source, s["line"])
                continue
            parts = (s["value"] or "").split(".")
            ways = [s["value"], *(".".join(parts[:i]) for i in range(1, len(parts))), *s["names"]]
            if origin := next((tainted[w] for w in ways if w in tainted), None):
                tainted[s["target"]] = origin
            continue
        args = [next((x for x in a if x in tainted), None) if isinstance(a, list) else a if a in tainted else None for a in s["args"]]
        hits = [a for a in [*args, *(k for k in s["kwargs"] if k in tainted)] if a]
        if not hits:
            continue
        source, line = tainted[hits[0]]
        if sink := _sink(s["call"], sinks):
            out.append(("sink", s["line"], s["call"], sink, source, line, ""))
        positional = {str(i): tainted[a] for i, a in enumerate(args) if a}
        if positional:
            out.append(("call", s["line"], s["call"], None, source, line, json.dumps(positional)))
    return out


def _pass(work: DataFrame, sources: list[str], sinks: list[str]) -> DataFrame:
    """Tainted calls of rows (file, fn, params, detail, seeds)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                seeds = {r.params[int(i)]: tuple(origin) for i, origin in json.loads(r.seeds or "{}").items() if int(i) < len(r.params)}
                if r.seeds is not None and not seeds:
                    continue
                for k, found in enumerate(follow(json.loads(r.detail or "[]"), seeds, sources, sinks)):
                    rows.append([r.file, r.fn, *found, r.ordinal * 100_000 + k])
            yield pd.DataFrame(rows, columns=["file", "fn", "kind", "line", "call", "sink", "source", "origin_line", "args", "seq"])

    return work.mapInPandas(run, _SCHEMA)


def taint_paths(parsed: DataFrame, max_depth: int = 3, most: int | None = 100, sources: list[str] = T.PYTHON_SOURCES, sinks: dict[str, str] = T.PYTHON_SINKS) -> DataFrame:
    """(source, origin_line, sink, call, file, line, depth, confidence): the first path of each (file, line, call).

    Callees: the function of that qualified name, else the first one by file and order whose name ends in it. Only
    positional arguments carry over. The first ``most`` paths by depth, file and order are returned (all, if None); a run that
    stops between functions may give a few more, so the cap here is exact where that one overshoots. Functions are reduced to one
    for each name and each end of a name before calls are joined to them.
    """
    functions = parsed.filter("kind = 'function'").select("file", F.col("fullname").alias("fn"), "params", "detail", "ordinal")
    functions = materialise(functions, "functions")
    first = F.min_by(F.struct(*functions.columns), F.struct("file", "ordinal")).alias("f")
    parts = F.split("fn", "\\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    exact = functions.groupBy(F.col("fn").alias("call")).agg(first)
    by_end = functions.filter(F.size(parts) > 1).withColumn("call", F.explode(ends)).groupBy("call").agg(first)
    known = materialise(exact.select("call", "f.*").withColumn("p", F.lit(0)).unionByName(by_end.select("call", "f.*").withColumn("p", F.lit(1))), "callees")
    names = list(sinks)
    found = materialise(_pass(functions.withColumn("seeds", F.lit(None).cast("string")), sources, names), "taint-0")
    levels = [found.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        calls = found.filter("kind = 'call'").select("call", "args").distinct()
        best = calls.join(known, "call").groupBy("call", "args").agg(F.min_by(F.struct(*functions.columns), "p").alias("f"))
        work = best.select("f.*", F.col("args").alias("seeds")).distinct()
        found = materialise(_pass(work, sources, names), f"taint-{depth}")
        if found.isEmpty():
            break
        levels.append(found.withColumn("depth", F.lit(depth)))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    order = Window.partitionBy("file", "line", "call").orderBy("depth", "seq")
    paths = every.filter("kind = 'sink'").withColumn("r", F.row_number().over(order)).filter("r = 1")
    if most is not None:
        paths = paths.orderBy("depth", "file", "seq").limit(most)
    return paths.select("source", "origin_line", "sink", "call", "file", "line", "depth", F.lit("high").alias("confidence"))
