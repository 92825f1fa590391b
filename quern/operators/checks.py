"""Checks of findings against files, lines, static results and other models' answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_check(findings: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """``findings`` with found, and corrected: for a file that isn't there, the first one of the same base name. Both sides hold ``path``."""
    there = files.select(path).distinct().withColumn("__hit", F.lit(True))
    fixed = files.groupBy(base_name(F.col(path)).alias("__base")).agg(F.min(path).alias("__fixed"))
    found = findings.join(there, path, "left").withColumn("__base", base_name(F.col(path))).join(fixed, "__base", "left")
    hit = F.col("__hit").isNotNull()
    return found.withColumn("found", hit).withColumn("corrected", F.when(~hit, F.col("__fixed"))).drop("__hit", "__base", "__fixed")


def inside_root(path: Column, root: str) -> Column:
    """Whether a path begins with the root, as text."""
    return path.startswith(root)


def line_exists(line: Column, text: Column) -> Column:
    """Whether a line number is one of the text's."""
    return line.between(F.lit(1), F.size(F.split(text, "\n")))


def static_check(has_static: Column, same_line: Column, severity: Column, static_severity: Column) -> Column:
    """skipped without static results; agree on the same line; contradiction where a severe finding meets weak ones; else uncertain."""
    weak = (severity >= 4) & (F.coalesce(static_severity, F.lit(0)) <= 0)
    return F.when(~has_static, "skipped").when(same_line, "agree").when(weak, "contradiction").otherwise("uncertain")


def final_status(check: Column, confirmed: Column) -> Column:
    return F.when(check == "contradiction", "uncertain").when(confirmed, "verified").otherwise("uncertain")


def first_word(text: Column, words: list[tuple[str, str]], otherwise: str = "unclear") -> Column:
    """The verdict of the first of ``words`` (word, verdict) that a response has, in any case."""
    out = F.lit(otherwise)
    for word, verdict in reversed(words):
        out = F.when(F.upper(text).contains(word.upper()), verdict).otherwise(out)
    return out


def rebutted(conf: Column, vulnerable: Column, rebuttal: Column, evidence: Column) -> dict[str, Column]:
    """conf, vuln and rebuttal after the adversary (3 at most, not vulnerable) and then evidence (5 at least, vulnerable, no rebuttal)."""
    low = F.when(rebuttal, F.least(conf, F.lit(3))).otherwise(conf)
    return {"conf": F.when(evidence, F.greatest(low, F.lit(5))).otherwise(low), "vuln": (vulnerable & ~rebuttal) | evidence, "rebuttal": rebuttal & ~evidence}


def agreement(findings: DataFrame, static: DataFrame, key: str, same: Column) -> DataFrame:
    """(key, agrees, n_static): static results of the same file; agrees if one is the same (an expression over both sides)."""
    held = findings.join(static.withColumn("__hit", F.lit(1)), key, "left")
    return held.groupBy(key).agg(F.bool_or(F.coalesce(same, F.lit(False))).alias("agrees"), F.count("__hit").alias("n_static"))


def callers_of_name(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, callers): every row of a name with the number of its overloads, counted before the join rather than paired."""
    sizes = df.groupBy(*names).agg(F.count(F.lit(1)).alias("callers"))
    return df.join(sizes, names).select(key, "callers")


def _matches(candidates: DataFrame, cards: DataFrame, keys: list[str], file: str, function: str) -> DataFrame:
    names = F.split(file, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "/"))
    by_file = candidates.select(*keys, F.explode(suffixes).alias("__at")).join(cards.select("card", F.col("file").alias("__at")), "__at").select(*keys, "card")
    by_name = candidates.select(*keys, F.col(function).alias("__fn")).join(cards.select("card", F.explode("functions").alias("__fn")), "__fn").select(*keys, "card")
    return by_file.union(by_name).distinct()


def candidate_cards(candidates: DataFrame, cards: DataFrame, key: str, file: str, function: str, buckets: int = 64) -> DataFrame:
    """(key, card) for each candidate whose file is the card's or ends in it at a folder, or whose function is among the card's.

    ``cards``: card, file, functions (array). Both ways are equi-joins: of the function's name, and of each suffix of the
    candidate's path that begins after a separator.

    Cards are found and made distinct for each pair of file and function, kept as arrays of a bucket's cards, and laid out
    for the candidates of the pair last, so the result itself isn't shuffled. Keys with several pairs go the plain way.
    """
    pair = F.struct(F.col(file).alias("f"), F.col(function).alias("n"))
    pairs = candidates.groupBy(F.col(key).alias("__key")).agg(F.min(pair).alias("__pair"), F.max(pair).alias("__last"))
    one = F.col("__pair").eqNullSafe(F.col("__last"))
    single = pairs.filter(one).select("__key", "__pair")
    found = _matches(single.select("__pair", "__pair.f", "__pair.n").distinct(), cards, ["__pair"], "f", "n")
    found = found.groupBy(F.col("__pair").alias("__of"), F.pmod(F.hash("card"), F.lit(buckets))).agg(F.collect_list("card").alias("__cards"))
    same = [F.col(f"__pair.{c}").eqNullSafe(F.col(f"__of.{c}")) for c in "fn"]
    laid = single.join(found, same).select(F.col("__key").alias(key), F.explode("__cards").alias("card"))
    several = candidates.join(pairs.filter(~one).select("__key"), F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    return laid.union(_matches(several, cards, [key], file, function))


def injected(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, origin) of the rows that no known one covers."""
    return df.join(known, key, "left_anti").select(key, F.lit("injected").alias("origin"))
