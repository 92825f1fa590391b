"""Percentiles, tiers, scores and guarded top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import tables as T
from quern.functions.classify import first_of

from .storage import materialise


def percentile_at(df: DataFrame, column: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """One row a group with columns p<percent>: the value at index int((n - 1) * percent / 100) of the sorted values.

    Values are counted first, so equal values are shuffled once a task, and the running count goes over distinct values
    of a group. Without groups, values are dealt to ranges first and only the range that holds an index is looked into, so
    no task sees all of them. Null values are left out; a group without values has no row.
    """
    keys = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    if not keys:
        return _percentile_of_all(counts, column, percents)
    order = Window.partitionBy(*keys).orderBy(column)
    seen = counts.withColumn("__upto", F.sum("__n").over(order))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    # The first value whose running count passes the index.
    found = [F.min(F.when(F.col("__upto") > F.floor((F.col("__total") - 1) * p / 100), F.col(column))).alias(f"p{p}") for p in percents]
    return seen.join(totals, keys).groupBy(*keys).agg(*found)


def _percentile_of_all(counts: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """One row, or none without values. What the driver sees is a row for each range."""
    spark = counts.sparkSession
    dealt = counts.repartitionByRange(F.col(column)).withColumn("__range", F.spark_partition_id())
    dealt = materialise(dealt, "percentile-ranges")
    ranges = dealt.groupBy("__range").agg(F.sum("__n").alias("n"), F.min(column).alias("low")).orderBy("low").collect()
    schema = ", ".join(f"p{p} {counts.schema[column].dataType.simpleString()}" for p in percents)
    if not ranges:
        return spark.createDataFrame([], schema)
    total, out = sum(r["n"] for r in ranges), []
    for p in percents:
        left = (total - 1) * p // 100
        for r in ranges:
            if left < r["n"]:
                break
            left -= r["n"]
        order = Window.partitionBy("__range").orderBy(column)
        held = dealt.filter(F.col("__range") == r["__range"]).withColumn("__upto", F.sum("__n").over(order))
        out.append(held.filter(F.col("__upto") > left).agg(F.min(column)).collect()[0][0])
    return spark.createDataFrame([tuple(out)], schema)


def tiers(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with tier: hot from the 80th percentile on, warm from the 40th, else cold."""
    marks = percentile_at(df, column, [80, 40], by)
    joined = df.join(marks, by) if by else df.join(F.broadcast(marks))
    tier = F.when(F.col(column) >= F.col("p80"), "hot").when(F.col(column) >= F.col("p40"), "warm").otherwise("cold")
    return joined.withColumn("tier", tier).drop("p80", "p40")


def budget(tier: Column, base: int = 10) -> Column:
    return F.when(tier == "hot", base).when(tier == "warm", 3).otherwise(0)


def sink_weight(sink: Column) -> Column:
    return first_of([(sink == k, w) for k, w in T.SINK_WEIGHTS.items()], F.lit(0.3))


def path_score(sink: Column, functions: Column, files: Column, is_full: Column) -> Column:
    """Score of a path with ``functions`` and ``files`` (arrays) of its nodes; files hold the source's and sink's too."""
    nodes = F.when(F.size(functions) > 0, F.size(functions)).otherwise(1)
    valid = sink.rlike(T.VALIDATION) | F.exists(functions, lambda f: f.rlike(T.VALIDATION))
    score = 0.4 * sink_weight(sink) + 0.2 / (1 + 0.1 * F.greatest(F.lit(0), nodes - 3)) + F.when(valid, 0.2).otherwise(0.0) + F.when(is_full, 0.15).otherwise(0.0)
    return F.least(score + F.when(F.size(F.array_distinct(files)) >= 3, 0.05).otherwise(0.0), F.lit(1.0))


def anomalies(sink: Column, functions: Column, files: Column) -> Column:
    """Reasons for which a path is unusual, in fixed order. The size reason can't arise, as in what is matched."""
    common = F.array(*[F.lit(n) for n in T.COMMON_NAMES])
    odd = F.filter(functions, lambda f: (F.size(F.split(F.replace(f, F.lit("-"), F.lit("_")), "_")) >= 2) & ~F.arrays_overlap(F.transform(F.split(F.replace(f, F.lit("-"), F.lit("_")), "_"), lambda p: F.lower(p)), common))
    modules = F.size(F.array_distinct(F.transform(files, lambda f: F.substring_index(F.replace(f, F.lit("\\"), F.lit("/")), "/", 1))))
    return F.array_compact(
        F.array(
            F.when(~sink.isin(list(T.SINK_WEIGHTS)), F.lit("non_std_sink")),
            F.when((F.size(functions) > 1) & (F.size(odd) * 2 > F.size(functions)), F.lit("unusual_naming")),
            F.when(modules > 3, F.lit("multi_module_flow")),
        )
    )


def guarded_top_k(df: DataFrame, kind: str, key: str, known: str, score: str, order: str, most: int = 25, explore: int = 0, reasons: str | None = None) -> DataFrame:
    """``df`` rows with slot and place: the exploit rows, that is one guaranteed row of each kind (known sinks first, then score),
    then the best others; with ``explore``, as many explore rows.

    Guaranteed rows come in the order of kinds, the fill by score; ``order`` breaks ties. Rows that share a key with a
    guaranteed one are not filled in; of more kinds than places the first stay. Explore rows are those whose key isn't
    chosen yet and that have ``reasons`` (a number) to be unusual, most reasons first, then by score; what is missing is repeated from
    the last ``explore`` exploit places. Places count from 1 in each slot.
    """
    first = Window.partitionBy(kind).orderBy(F.desc(known), F.desc(score), order)
    ranked = materialise(df.withColumn("__r", F.row_number().over(first)), "guarded")
    # Of the guaranteed rows no more than ``most`` have a place, but all their keys are taken.
    sure = ranked.filter("__r = 1").drop("__r").withColumn("__sort", F.lit(0)).orderBy(kind).limit(most)
    others = ranked.drop("__r").join(ranked.filter("__r = 1").select(key).distinct(), key, "left_anti")
    fill = others.withColumn("__sort", F.lit(1)).orderBy(F.desc(score), order).limit(most)
    both = sure.unionByName(fill)
    place = Window.partitionBy(F.lit(0)).orderBy("__sort", F.when(F.col("__sort") == 0, F.col(kind)), F.desc(score), order)
    chosen = both.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).drop("__sort").withColumn("slot", F.lit("exploit"))
    if not explore:
        return chosen
    chosen = materialise(chosen, "exploit")
    left = others.join(chosen.select(key).distinct(), key, "left_anti")
    odd = left.filter(F.col(reasons) > 0).orderBy(F.desc(reasons), F.desc(score), order).limit(explore).withColumns({"__sort": F.lit(0), "__at": F.lit(0)})
    tail = chosen.filter(F.col("place") > most - explore).drop("slot").withColumn("__sort", F.lit(1)).withColumnRenamed("place", "__at")
    place = Window.partitionBy(F.lit(0)).orderBy("__sort", "__at", F.desc(reasons), F.desc(score), order)
    pool = odd.unionByName(tail).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= explore)
    return chosen.unionByName(pool.drop("__sort", "__at").withColumn("slot", F.lit("explore")))


def stratified(df: DataFrame, stratum: str, id_col: str, size: int, seed: int = 7) -> DataFrame:
    """Just ``size`` rows (all, if there are fewer): from each stratum its share but one at least, then others until there are
    enough; of more strata than rows, those with the smallest hash of their first row.

    The order is a keyed hash of the id, then the id: the same rows on every run. Null is a stratum like others. All strata
    count, however many there are: what is ranked is the candidates that a stratum's share lets through.
    """
    low = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = df.withColumn("__h", low).withColumn("__s", F.struct(F.col(stratum)))
    counts = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("__c"))
    total = df.count()
    share = F.greatest(F.lit(1), F.expr(f"cast(__c * {int(size)} div {max(total, 1)} as int)"))
    # Candidates by hash first: about three times the share and 64 more of a large stratum, so ranks are taken of a bounded part.
    near = (F.col("__c") <= 64) | (F.col("__h") * F.col("__c") <= (3 * share + 64) * (1 << 32))
    held = rows.join(counts, "__s").filter(near)
    held = held.withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy("__h", id_col)))
    sure = (F.col("__r") <= share).cast("int")
    chosen = held.withColumn("__first", F.when(F.col("__r") == 1, 2).otherwise(sure))
    # The first of each stratum, the shares, then the rest by hash.
    found = chosen.orderBy(F.desc("__first"), "__h", id_col).limit(size)
    return found.drop("__h", "__s", "__c", "__r", "__first")
