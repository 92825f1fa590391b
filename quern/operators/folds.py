"""Ordered folds: greedy proximity dedup, moving averages, conversation windows, queues."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_keep(df: DataFrame, keys: list[str], line: str, order: str, within: int = 3) -> DataFrame:
    """``df`` with kept: a row stays unless an earlier kept row of its keys lies within ``within`` lines, or at the same one.

    Rows without a line (null, 0 or less) always stay. Greedy and order-dependent. A line can only be dropped by
    lines of its own run, a run being lines with gaps of ``within`` at most, so runs and not keys are gathered;
    of rows with equal lines only the first can stay, so a run has one entry for each line.
    """
    lines = df.filter(F.col(line) > 0).groupBy(*keys, line).agg(F.min(order).alias("__first"))
    at = Window.partitionBy(*keys).orderBy(line)
    gap = F.col(line) - F.lag(line).over(at)
    runs = lines.withColumn("__run", F.sum(F.when(gap <= within, 0).otherwise(1)).over(at))
    folded = runs.groupBy(*keys, "__run").agg(F.sort_array(F.collect_list(F.struct(F.col("__first"), F.col(line).cast("long").alias("line")))).alias("__rows"))
    keep = F.aggregate("__rows", F.array().cast("array<bigint>"), lambda kept, r: F.when(F.exists(kept, lambda k: F.abs(k - r["line"]) <= within), kept).otherwise(F.array_append(kept, r["line"])))
    stays = folded.select(*keys, F.explode(keep).alias("__line")).withColumn("__stays", F.lit(True))
    marked = df.alias("d").join(lines.alias("l"), [F.col(f"d.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys] + [F.col(f"d.{line}") == F.col(f"l.{line}")], "left").select("d.*", "__first")
    out = marked.alias("d").join(stays.alias("s"), [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col(f"d.{line}") == F.col("s.__line")], "left")
    free = F.coalesce(F.col(f"d.{line}") <= 0, F.lit(True))
    return out.select("d.*", (free | (F.coalesce("__stays", F.lit(False)) & (F.col(f"d.{order}") == F.col("__first")))).alias("kept")).drop("__first")


def near_existing(new: DataFrame, old: DataFrame, keys: list[str], line: str, within: int = 3) -> DataFrame:
    """Rows of ``new`` with no row of ``old`` of equal keys within ``within`` lines. Lines meet in buckets, so a key with many rows isn't paired with itself."""
    width = within + 1
    spread = old.filter(F.col(line) > 0).select(*keys, F.col(line).alias("__old"), F.explode(F.sequence(F.floor((F.col(line) - within) / width), F.floor((F.col(line) + within) / width))).alias("__bucket")).distinct()
    laid = new.withColumn("__bucket", F.floor(F.col(line) / width))
    close = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in [*keys, "__bucket"]] + [F.abs(F.col(f"n.{line}") - F.col("__old")) <= within, F.col(f"n.{line}") > 0]
    return laid.alias("n").join(spread.alias("o"), close, "left_anti").drop("__bucket")


def title_ratio(df: DataFrame, a: str, b: str, least: float = 0.70) -> DataFrame:
    """Rows of pairs whose titles are alike by the sequence matcher's ratio, which has no built-in counterpart. Its two quick upper bounds are asked first."""

    def alike(x: str, y: str) -> bool:
        if not x or not y:
            return least <= 0
        m = difflib.SequenceMatcher(None, x.lower(), y.lower())
        return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[pd.Series([alike(x, y) for x, y in zip(f[a], f[b], strict=True)], index=f.index, dtype=bool)]

    return df.mapInPandas(run, df.schema)


def title_pairs(df: DataFrame, title: str, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(held, compared): the pairs (x, y) of different rows' titles in a group of equal ``same``, with the group and without it.

    Null and empty titles are like none. Titles are made distinct first, so copies of a title add no pair. The ratio isn't symmetric: both orders are there.
    """
    titles = df.filter(F.col(title) != "").groupBy(*same, title).agg(F.count(F.lit(1)).alias("__n"))
    x = titles.select(*same, F.col(title).alias("x"), F.col("__n").alias("__many"))
    y = titles.select(*same, F.col(title).alias("y"))
    held = x.join(y, same).filter((F.col("x") != F.col("y")) | (F.col("__many") > 1)).drop("__many")
    return held, held.select("x", "y").distinct()


def similar_titles(df: DataFrame, key: str, title: str, same: list[str], least: float = 0.70) -> DataFrame:
    """(a, b): keys of rows of equal ``same``, a before b, whose titles are alike. Each pair of titles is compared once, whatever rows have it."""
    held, compared = title_pairs(df, title, same)
    alike = held.join(title_ratio(compared, "x", "y", least), ["x", "y"])
    a = df.select(*same, F.col(title).alias("x"), F.col(key).alias("a"))
    b = df.select(*same, F.col(title).alias("y"), F.col(key).alias("b"))
    return a.join(alike, [*same, "x"]).join(b, [*same, "y"]).filter("a < b").select("a", "b")


def ema(values: Column, alpha: float = 0.3, start: float = 500.0) -> Column:
    """Exponential moving average over an array in its order."""
    return F.aggregate(values, F.lit(start), lambda avg, x: alpha * x + (1 - alpha) * avg)


def compressed(messages: DataFrame, conv: str, turn: str, role: str) -> DataFrame:
    """Messages that stay when a conversation is compressed: the first two, and the last third from its first assistant on.

    Conversations of fewer than three messages, or with no assistant in the last third, have none.
    """
    counts = messages.groupBy(conv).agg(F.count(F.lit(1)).alias("__n"))
    numbered = messages.withColumn("__i", F.row_number().over(Window.partitionBy(conv).orderBy(turn)) - 1).join(counts, conv)
    late = (F.col(role) == "assistant") & (F.col("__i") >= F.floor(2 * F.col("__n") / 3))
    firsts = numbered.filter(late & (F.col("__n") >= 3)).groupBy(conv).agg(F.min("__i").alias("__from"))
    return numbered.join(firsts, conv).filter((F.col("__i") < 2) | (F.col("__i") >= F.col("__from"))).withColumn("position", F.when(F.col("__i") < 2, F.col("__i")).otherwise(F.col("__i") - F.col("__from") + 3)).drop("__n", "__i", "__from")


def cached(messages: DataFrame, conv: str, turn: str, role: str) -> DataFrame:
    """``messages`` with cached: the first system message, and the last two user or tool messages that an assistant follows."""
    at = Window.partitionBy(conv).orderBy(turn)
    rows = messages.withColumn("__next", F.lead(role).over(at))
    rows = rows.withColumn("__hit", F.col(role).isin("user", "tool") & F.coalesce(F.col("__next") == "assistant", F.lit(False)))
    back = Window.partitionBy(conv).orderBy(F.desc(turn))
    rows = rows.withColumn("__k", F.sum(F.col("__hit").cast("int")).over(back))
    first = F.min(F.when(F.col(role) == "system", F.col(turn))).over(Window.partitionBy(conv))
    return rows.withColumn("cached", (F.col("__hit") & (F.col("__k") <= 2)) | F.coalesce(F.col(turn) == first, F.lit(False))).drop("__next", "__hit", "__k")


def poll(tasks: DataFrame, kind: str, order: list, limits: DataFrame) -> DataFrame:
    """``tasks`` with starts: the first ones of each kind up to its free places; ``limits`` (kind, free)."""
    r = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return tasks.withColumn("__r", r).join(limits, kind).withColumn("starts", F.col("__r") <= F.col("free")).drop("__r", "free")


def after_failure(failures: Column, most: Column, now: Column, base: Column) -> tuple[Column, Column]:
    """(status, time of the next try): requeued at now + base ** (failures - 1) while failures stay below ``most``."""
    again = failures < most
    return F.when(again, "pending").otherwise("failed"), F.when(again, now + F.pow(base, failures - 1))
