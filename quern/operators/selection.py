"""Selections: caps in stages, guarded budgets, phases, chunks and batches. Ties go by the order columns given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_rows


def prune(df: DataFrame, key: str, group: str, order: list, entry: Column, test: Column, most: int = 30, each: int = 2) -> DataFrame:
    """``df`` with place, ``most`` rows: ``each`` of every entry group, up to half the cap; then the best others; then those in tests."""
    sure = first_rows(df.filter(~test & entry), [group], order, each).orderBy(*order).limit(most // 2).withColumn("__stage", F.lit(0))
    # Each stage gives its best ``most`` at most, so the last ranking is over a bounded number of rows.
    rest = df.filter(~test).join(sure.select(key), key, "left_anti").orderBy(*order).limit(most).withColumn("__stage", F.lit(1))
    tests = df.filter(test).orderBy(*order).limit(most).withColumn("__stage", F.lit(2))
    both = sure.select(*rest.columns).unionByName(rest).unionByName(tests)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__stage", *order))
    return both.withColumn("place", place).filter(F.col("place") <= most).drop("__stage")


def capped(df: DataFrame, group: str, order: list, each: int, most: int) -> DataFrame:
    """The best ``most`` rows with no more than ``each`` of a group."""
    return first_rows(df, [group], order, each).orderBy(*order).limit(most)


def first_by_severity(df: DataFrame, keys: list[str], severity: Column, order: str) -> DataFrame:
    """(keys, order): the first row of the least severity number of each group."""
    return df.groupBy(*keys).agg(F.min_by(order, F.struct(severity, order)).alias(order))


def phase_split(df: DataFrame, key: str, order: list, least: int = 20, most: int = 200, share: float = 0.3) -> DataFrame:
    """(key, phase): high for the first share of the rows, ``least`` at least and ``most`` at most; the others remain."""
    n = max(least, min(most, int(df.count() * share)))
    high = df.orderBy(*order).limit(n).select(key, F.lit("high").alias("phase"))
    return df.select(key).join(F.broadcast(high), key, "left").withColumn("phase", F.coalesce("phase", F.lit("remaining")))


def best_or(df: DataFrame, key: str, order: list, most: int, always: Column, among: Column | None = None) -> DataFrame:
    """(key): the best ``most`` rows (of those ``among``), and all for which ``always`` holds, once each."""
    top = (df.filter(among) if among is not None else df).orderBy(*order).limit(most)
    return top.select(key).union(df.filter(always).select(key)).distinct()


def nearby_lines(df: DataFrame, key: str, text: str, line: Column, before: int = 20, after: int = 5) -> DataFrame:
    """(key, no, line): the lines from ``before`` before to below ``after`` after the given one."""
    lines = df.select(key, line.alias("__at"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("no", (F.col("pos") + 1).cast("long"))
    return lines.filter((F.col("no") >= F.col("__at") - before) & (F.col("no") < F.col("__at") + after)).select(key, "no", "line")


def chunks(df: DataFrame, group: str, key: str, size: int = 10, parts: int = 64) -> DataFrame:
    """(key, group, chunk): chunks of ``size`` within the ``parts`` parts of each group by key, so no group is numbered in one task."""
    order = Window.partitionBy(group, F.col(key) % parts).orderBy(key)
    return df.withColumn("__r", (F.row_number().over(order) - 1).cast("long")).select(key, group, F.expr(f"__r div {int(size)}").alias("chunk"))


def two_pools(df: DataFrame, group: str, order: list, warm: Column, first: int = 10, second: int = 5) -> DataFrame:
    """The best ``first`` warm rows, and the best ``second`` others of groups that these don't have."""
    a = df.filter(warm).orderBy(*order).limit(first)
    b = df.filter(~warm).join(F.broadcast(a.select(group)), group, "left_anti").orderBy(*order).limit(second)
    return a.unionByName(b)


def priority_map(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, priority, cap): the largest score of each key; 400 and 200 are the caps from 500 and 200 keys on."""
    best = df.groupBy(key).agg(F.max(score).alias("priority"))
    n = F.col("__keys")
    return best.crossJoin(F.broadcast(best.agg(F.count(F.lit(1)).alias("__keys")))).select(key, "priority", F.when(n >= 500, 400).when(n >= 200, 200).alias("cap"))


def batches(df: DataFrame, group: str, least: int = 2) -> DataFrame:
    """(group, n, kind): batch for groups of ``least`` rows and more, else single."""
    n = F.count(F.lit(1))
    return df.groupBy(group).agg(n.alias("n"), F.when(n >= least, "batch").otherwise("single").alias("kind"))


def stage_of(df: DataFrame, key: str, collected: Column, verified: Column, found: Column, doubtful: Column) -> DataFrame:
    """(key, stage): what may run next, by what earlier stages have left; a second round only if nothing was found and doubtful rows remain."""
    none = lambda c: F.count_if(c) == 0
    stage = F.when(none(collected), "collect").when(none(verified), "verify").when(none(found) & ~none(doubtful), "second round").otherwise("report")
    return df.groupBy(key).agg(stage.alias("stage"))


def first_versions(df: DataFrame, path: str, stamp: Column, key: str) -> DataFrame:
    """(key): files that aren't in the snapshot under their path and stamp; of equal ones the first is new."""
    return df.groupBy(path, stamp.alias("__stamp")).agg(F.min(key).alias(key)).select(key)
