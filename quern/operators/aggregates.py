"""Counts, votes and rates of findings, signals and caches. Every function takes the names of its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_rows


def count_by(df: DataFrame, keys: dict[str, str], name: str = "n", **marked: Column) -> DataFrame:
    """Rows by ``keys`` (new name: column), and of them those for which each of ``marked`` holds. Null keys are a group."""
    counts = [F.count(F.lit(1)).alias(name), *(F.count_if(c).alias(k) for k, c in marked.items())]
    return df.groupBy(*[F.col(c).alias(k) for k, c in keys.items()]).agg(*counts)


def distinct_by(df: DataFrame, keys: list[str], value: str, name: str = "n") -> DataFrame:
    """Distinct ``value`` by ``keys``; pairs first, so that a key with many rows is counted in parts. A null value counts as one."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def rule_marks(evidence: Column) -> Column:
    """Rules named by ``[SAST:rule]`` marks in a text."""
    return F.regexp_extract_all(evidence, F.lit(r"\[SAST:([^\]]+)\]"), F.lit(1))


def false_positives(df: DataFrame, file: str, evidence: str, triggerable: str, least: int = 2) -> DataFrame:
    """(file, rule, n, suppressed): marks in the evidence of rows that aren't triggerable; a file with a rule of ``least`` or more is suppressed."""
    rules = df.filter(~F.col(triggerable)).select(file, F.explode(rule_marks(F.col(evidence))).alias("rule"))
    counts = rules.groupBy(file, "rule").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.groupBy(file).agg((F.max("n") >= least).alias("suppressed")), file)


def outcome_buckets(df: DataFrame, vulnerable: Column, confidence: Column) -> DataFrame:
    """One row: total, vulnerable, interesting (confidence from 4 to below 7) and safe (below 4)."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(vulnerable).alias("vulnerable"), F.count_if((confidence >= 4) & (confidence < 7)).alias("interesting"), F.count_if(confidence < 4).alias("safe"))


def running_quota(df: DataFrame, key: str, order: str, value: str, limit: float) -> DataFrame:
    """``df`` with spent, the sum of its key up to the row, and exhausted (from ``limit`` on)."""
    spent = F.sum(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("spent", spent).withColumn("exhausted", F.col("spent") >= limit)


def route_kpis(df: DataFrame, project: str, authed: Column, public: Column) -> DataFrame:
    """(project, total, authed, public, no_auth). Rows that are both are taken off twice, as in what is matched."""
    counts = count_by(df, {"project": project}, "total", authed=authed, public=public)
    return counts.withColumn("no_auth", F.col("total") - F.col("authed") - F.col("public"))


def top_counts(df: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The ``most`` values of ``key`` with the most rows, by name where equal."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(most)


def first_places(df: DataFrame, key: str, place: Column, order: str) -> DataFrame:
    """(key, place): the first place of each name."""
    return df.groupBy(key).agg(F.min_by(place, order).alias("place"))


def score_cascade(df: DataFrame, keys: list[str], blocking: Column, scoring: Column) -> DataFrame:
    """(keys, score): 0.6 if ``blocking`` holds in all rows, and 0.4 times the share of rows in which ``scoring`` does."""
    sure = F.min(F.when(blocking, 1).otherwise(0))
    return df.groupBy(*keys).agg(F.round(sure * 0.6 + 0.4 * (F.count_if(scoring) / F.count(F.lit(1))), 2).alias("score"))


def majority_vote(df: DataFrame, key: str, order: str, vulnerable: str, confidence: str, votes: int = 3) -> DataFrame:
    """(key, vuln, conf) of the first ``votes`` rows: a first result in the grey zone (4 to 7) gives way to two votes, which raise its confidence to
    the mean, 7 at least, or lower it to the mean, 3 at most."""
    some = first_rows(df.select(key, order, vulnerable, confidence), [key], [order], votes)
    a = some.groupBy(key).agg(F.min_by(vulnerable, order).alias("v"), F.min_by(confidence, order).alias("c"), (F.count_if(F.col(vulnerable)) >= 2).alias("major"), F.floor(F.avg(confidence)).alias("mean"))
    grey = F.col("c").between(4, 7)
    conf = F.when(grey & F.col("major") & ~F.col("v"), F.greatest("mean", F.lit(7))).when(grey & ~F.col("major") & F.col("v"), F.least("mean", F.lit(3))).otherwise(F.col("c"))
    return a.select(key, F.when(grey, F.col("major")).otherwise(F.col("v")).alias("vuln"), conf.alias("conf"))


def repeat_ratio(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, ratio): the share of rows that repeat a content, told by digest; null contents are one."""
    each = df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("h")).groupBy(key, "h").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("ratio"))


def cache_counts(df: DataFrame, content: str) -> DataFrame:
    """One row: entries a cache by digest would have, and its hits."""
    per = df.groupBy(F.md5(F.col(content).cast("binary")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("n") - 1).alias("hits"))


def longest_runs(df: DataFrame, key: str, order: str, step: str) -> DataFrame:
    """(key, longest): the longest run of equal steps."""
    at = Window.partitionBy(key).orderBy(order)
    new = F.coalesce(~F.col(step).eqNullSafe(F.lag(step).over(at)) | (F.row_number().over(at) == 1), F.lit(True))
    runs = df.select(key, order, new.cast("int").alias("__new")).withColumn("__run", F.sum("__new").over(at))
    return runs.groupBy(key, "__run").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("longest"))
