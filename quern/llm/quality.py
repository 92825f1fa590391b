"""Quality rules: base counts of each text and cross-document line frequency by host; native.

A line is normalised (lower case of A-Z, blanks collapsed) and hashed. For each host, the distinct documents that
hold a line are counted, and it is removed if they are more than ``min_docs`` and than ``share`` of the host's
distinct documents that have a line. Documents are told apart by a 64-bit hash of all their normalised lines, so copies
of one document count once and are left to deduplication; near copies that differ count as documents each.
A document that loses more than ``depleted`` of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, documents, lower_ascii, materialise, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Up to so many repeated windows, each window of a text is looked up among them; beyond, windows are sorted.
_FEW = 12


def _repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: the words that stand in a 3-word window which the same text has twice or more."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn("__win", F.when(F.size(words) >= 3, hashed).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__sorted", F.sort_array("__win"))
    df = df.withColumn("__again", F.array_distinct(F.filter("__sorted", lambda x, i: x == F.get("__sorted", i - 1))))
    df = df.withColumn("__runs", F.when(F.size("__again") > _FEW, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, j: F.coalesce(x["h"] == F.get("__runs", j)["h"], F.lit(False))
    sorted_starts = F.sort_array(F.transform(F.filter("__runs", lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["i"]))
    looked_up = F.filter(F.sequence(F.lit(0), F.size("__win") - 1), lambda i: F.array_contains("__again", F.get("__win", i)))
    starts = F.when(F.size("__again") == 0, F.array().cast("array<int>")).when(F.col("__runs").isNull(), looked_up).otherwise(sorted_starts)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    new = lambda s, p: F.least(F.lit(3), p - s["last"])  # noqa: E731  words that no earlier start has covered
    covered = F.aggregate(starts, zero, lambda s, p: F.struct((s["n"] + new(s, p)).alias("n"), p.alias("last")), lambda s: s["n"])
    return df.withColumn(out, covered).drop("__win", "__sorted", "__again", "__runs")


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Whole texts are read; null counts as empty. Windows are compared by 64-bit hashes within one text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumns(
        {
            "__words": words_of(F.col(text)),
            "__lines": lines,
            "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    )
    df = _repeat_words(df, "__words", "n_repeat_words").drop("__words", "__lines")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(lower_ascii(line), "[\\x20\\x09-\\x0D]+", " "))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def _row_key(id_col: str, host: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(host), F.col(text))


def host_lines(df: DataFrame, id_col: str, host: str, text: str) -> DataFrame:
    """(doc_id, row_key, host, digest, line, words): one row for each distinct line of each document.

    ``words`` counts those of all the document's occurrences of the line; ``digest`` is that of all its lines.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), normalised), lambda x: x != "")
    rows = df.select(F.col(id_col).alias("doc_id"), _row_key(id_col, host, text).alias("row_key"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(lines).alias("digest"), lines.alias("lines"))
    each = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")))
    rows = rows.withColumn("runs", F.sort_array(each))
    at = F.transform("runs", lambda x, i: F.struct(x["line"].alias("line"), x["words"].alias("words"), i.alias("at"), F.coalesce(x["line"] != F.get("runs", i - 1)["line"], F.lit(True)).alias("new")))
    rows = rows.withColumn("firsts", F.filter(at, lambda x: x["new"]))
    one = F.transform("firsts", lambda x, i: F.struct(x["line"].alias("line"), ((F.coalesce(F.get("firsts", i + 1)["at"], F.size("runs")) - x["at"]) * x["words"]).cast("long").alias("words")))
    return rows.select("doc_id", "row_key", "host", "digest", F.explode(one).alias("x")).select("doc_id", "row_key", "host", "digest", "x.line", "x.words")


def frequent_lines(lines: DataFrame, min_docs: int = 4, share: float = 0.01) -> DataFrame:
    """(host, line) to remove, of rows of ``host_lines``. Documents of a common line are told apart, then counted by task."""
    held = lines.select("host", "line", "digest").distinct()
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > min_docs)
    hosts = lines.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return materialise(counts.join(hosts, "host").filter(F.col("docs") > share * F.col("host_docs")).select("host", "line"), "frequent-lines")


def removals(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, row_key, removed_words, removed_lines) of the documents that hold lines of ``frequent``.

    ``frequent`` is a written table: adaptive execution broadcasts it below the threshold, else splits the hot lines' partitions.
    """
    held = lines.select("doc_id", "row_key", "host", "line", "words").join(frequent, ["host", "line"])
    # Rows repeated in the input have the same key and lines; each line counts once.
    once = held.groupBy("doc_id", "row_key", "line").agg(F.max("words").alias("words"))
    return once.groupBy("doc_id", "row_key").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", min_docs: int = 4, share: float = 0.01, depleted: float = 0.5) -> DataFrame:
    """Base counts, removed_words, removed_lines (hashes) and kept for every row of ``df``; other columns are left out.

    Null text counts as empty (and fails the base rules), a null host is a host of its own with the empty one,
    a null id is an id. Repeated rows get a result each. An empty input gives no rows.
    """
    plain = df.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    # Lines are split off once, as hashes; both steps on them read this table.
    lines = materialise(host_lines(plain, "doc_id", "host", "text"), "lines")
    gone = removals(lines, frequent_lines(lines, min_docs, share)).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "removed_words", "removed_lines")
    # Written, since a caller's filter on the counts would else be pushed into their expressions and evaluate these anew for each word.
    counted = materialise(base_counts(plain.withColumn("row_key", _row_key("doc_id", "host", "text"))).drop("text"), "base-counts")
    both = counted.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__key")), "left").drop("__id", "__key")
    lost = F.coalesce("removed_words", F.lit(0))
    return both.withColumn("removed_words", lost).withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= depleted * F.col("n_words")))


def clean(df: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The kept rows of ``df`` with all their columns, their texts without the removed lines.

    Null texts fail the base rules and go, as do empty ones; a null id or host is a value like others. Of repeated rows all are
    kept or none. An empty input gives no rows. Names with two leading underscores are reserved for this function.
    """
    verdict = quality_rules(df, id_col, host, text, **limits).filter("kept").select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("__gone")).dropDuplicates(["__id", "__key"])
    held = df.withColumn("__row", _row_key(id_col, host, text)).join(verdict, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key")))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("__gone", _line_hash(x))), "\n")
    return held.withColumn(text, F.when(F.size("__gone") == 0, F.col(text)).otherwise(left)).select(*df.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, removed_words and kept."""
    found = quality_rules(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
