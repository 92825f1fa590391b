"""Queries of folds, queues, deduplication by order, and the validators of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import aggregates as A
from quern.operators import checks as K
from quern.operators import folds as O
from quern.operators import selection as L
from quern.registry import query, table


@query(
    "D1_greedy_dedup",
    "WITH e AS (SELECT event_id, user_id, event_type, CAST(trunc(date_diff('minute', TIMESTAMP '2024-01-01', ts) / 60) AS BIGINT) AS line FROM events), "
    "k AS (SELECT user_id, event_type, list_reduce(list_prepend(CAST([] AS BIGINT[]), list([line] ORDER BY event_id) FILTER (line > 0)), lambda a, x: CASE WHEN len(list_filter(a, lambda v: abs(v - x[1]) <= 3)) > 0 THEN a ELSE list_concat(a, x) END) AS lines FROM e GROUP BY 1, 2), "
    "f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type, line) AS first FROM e) SELECT event_id, user_id, event_type, line, line <= 0 OR list_contains(lines, line) AND event_id = first AS kept FROM f JOIN k USING (user_id, event_type)",
)
def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: events at a line (minute), by file (user) and type, in the order of their ids."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.timestamp_diff("MINUTE", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 60).cast("long").alias("line"))
    return O.greedy_keep(e, ["user_id", "event_type"], "line", "event_id")


@query("D1_near_existing", "WITH e AS (SELECT event_id, user_id, event_type, date_diff('minute', TIMESTAMP '2024-01-01', ts) // 60 AS line FROM events) SELECT event_id, line FROM e n WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.event_id % 2 = 1 AND o.user_id = n.user_id AND o.event_type = n.event_type AND o.line > 0 AND n.line > 0 AND abs(o.line - n.line) <= 3)")
def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.timestamp_diff("MINUTE", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 60).alias("line"))
    return O.near_existing(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "line").select("event_id", "line")


@query("D1_title_ratio")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names of one brand, type and size with similar titles."""
    return O.similar_titles(table(spark, sf_dir, "part"), "p_partkey", "p_name", ["p_brand", "p_type", "p_size"])


@query("D4_knowledge_merge", "SELECT user_id, string_agg(event_type, chr(10) || chr(10) ORDER BY event_id) AS entry FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1")
def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a key in order. The result is that list, so it is as long as the key has entries."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('signup', 'purchase')")
    listed = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("l"))
    return listed.select("user_id", F.array_join(F.transform("l", lambda x: x["event_type"]), "\n\n").alias("entry"))


@query("D5_D6_D7_merge", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS last_value, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS states, count(DISTINCT o_orderpriority || ':' || o_orderstatus) AS submissions FROM orders GROUP BY 1")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later scalar wins, lists are united, equal submission keys count once."""
    pairs = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(F.max("o_orderkey").alias("k"))
    found = pairs.groupBy("o_custkey").agg(F.max_by("o_orderpriority", "k").alias("last_value"), F.sort_array(F.collect_set("o_orderstatus")).alias("s"), F.count(F.lit(1)).alias("submissions"))
    return found.select("o_custkey", "last_value", F.array_join("s", ",").alias("states"), "submissions")


@query("E1_ema", "SELECT user_id, round(list_reduce(list_prepend(500.0, list(value ORDER BY event_id)), lambda a, x: 0.3 * x + 0.7 * a), 6) AS ema FROM events WHERE event_type = 'purchase' GROUP BY 1")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return e.select("user_id", F.round(O.ema(F.transform("v", lambda x: x["value"])), 6).alias("ema"))


_CH = "30000.0 / greatest(l_extendedprice / 20, 1.0) * CASE WHEN l_tax > 0.7 THEN 0.5 WHEN l_tax * 10 > 0.5 THEN 0.7 ELSE 1.0 END * CASE WHEN l_quantity * 10 > 300 THEN 0.8 ELSE 1.0 END * CASE WHEN l_discount * 5 > 0.3 THEN 0.7 WHEN l_discount * 5 > 0.1 THEN 0.85 ELSE 1.0 END"


@query("E2_chunk_size", f"SELECT l_orderkey, l_linenumber, greatest(5, least(50, CAST(floor({_CH}) AS INTEGER))) AS size FROM lineitem")
def chunk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    pressure = F.when(F.col("l_tax") > 0.7, F.lit(0.8)).when(F.col("l_tax") * 10 > 0.5, 0.6).otherwise(0.0)
    size = S.chunk_size(F.col("l_extendedprice") / 20, pressure, F.col("l_quantity") * 10, F.col("l_discount") * 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", size.alias("size"))


@query(
    "E3_compress_context",
    "WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), f AS (SELECT conv_id, min(i) AS s FROM m WHERE role = 'assistant' AND n >= 3 AND i >= 2 * n // 3 GROUP BY 1) SELECT conv_id, turn, role, CASE WHEN i < 2 THEN i ELSE i - s + 3 END AS position FROM m JOIN f USING (conv_id) WHERE i < 2 OR i >= s",
)
def compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.compressed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query(
    "E4_cache_annotation",
    "WITH m AS (SELECT *, role IN ('user', 'tool') AND coalesce(lead(role) OVER w = 'assistant', false) AS hit FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), k AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS s FROM m) SELECT conv_id, turn, (hit AND k <= 2) OR coalesce(turn = s, false) AS cached FROM k",
)
def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cached(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "turn", "cached")


@query("Q1_Q3_poll", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY least(greatest(o_totalprice / 400000, 0), 1), o_orderdate, o_orderkey) <= 7 AS starts FROM orders WHERE o_orderstatus = 'O'")
def poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as tasks: priority clamped to [0, 1], then time, then id, seven places for each kind."""
    tasks = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").withColumn("p", F.least(F.greatest(F.col("o_totalprice") / 400000, F.lit(0.0)), F.lit(1.0)))
    limits = tasks.select("o_orderpriority").distinct().withColumn("free", F.lit(7))
    return O.poll(tasks, "o_orderpriority", ["p", "o_orderdate", "o_orderkey"], limits).select("o_orderkey", "starts")


@query("Q2_after_failure", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 3 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN l_linenumber < 3 THEN 1000 + pow(2.0, l_linenumber - 1) END AS due FROM lineitem")
def failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, due = O.after_failure(F.col("l_linenumber"), F.lit(3), F.lit(1000.0), F.lit(2.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"), due.alias("due"))


@query("Q4_Q5_stages", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN 'collect' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'verify' WHEN count(*) FILTER (o_totalprice > 200000) = 0 AND count(*) FILTER (o_totalprice < 50000) > 0 THEN 'second round' ELSE 'report' END AS stage FROM orders GROUP BY 1")
def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stage may run: by what the earlier ones have left; a second round only if the first found nothing and doubtful rows remain."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return L.stage_of(table(spark, sf_dir, "orders"), "o_custkey", status == "P", status == "F", price > 200000, price < 50000)


@query("Q6_changed_files", "SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages o WHERE o.url = p.url AND o.page_id < p.page_id AND length(o.html) = length(p.html))")
def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files not in the snapshot under their path and stamp: of equal ones the first is new."""
    return L.first_versions(table(spark, sf_dir, "pages"), "url", F.length("html"), "page_id")


@query("Q7_repeated_patterns", "SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) GROUP BY ALL) GROUP BY 1")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of equal steps of each agent (user)."""
    return A.longest_runs(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("A8_quota", "SELECT event_id, round(sum(value) OVER w, 4) AS spent, sum(value) OVER w >= 1000 AS exhausted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.running_quota(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 1000)
    return found.select("event_id", F.round("spent", 4).alias("spent"), "exhausted")


@query("V2_line_check", "SELECT doc_id, doc_id % 40 BETWEEN 1 AND len(string_split(text, chr(10))) AS valid FROM documents")
def line_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", K.line_exists(F.col("doc_id") % 40, F.col("text")).alias("valid"))


_V = "WITH f AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS static, l.quality = 1 AS same_line, d.n_chars % 5 AS sev, coalesce(l.toxic, 0) AS smax FROM documents d LEFT JOIN labels l USING (doc_id)), c AS (SELECT *, CASE WHEN NOT static THEN 'skipped' WHEN same_line THEN 'agree' WHEN sev >= 4 AND smax <= 0 THEN 'contradiction' ELSE 'uncertain' END AS check_result FROM f) "


@query("V3_V5_final_status", _V + "SELECT doc_id, check_result, CASE WHEN check_result = 'contradiction' THEN 'uncertain' WHEN doc_id % 3 <> 0 THEN 'verified' ELSE 'uncertain' END AS status FROM c")
def final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against static results: none, same line, strong finding against weak ones; then the final status."""
    labels = table(spark, sf_dir, "labels").withColumn("hit", F.lit(True))
    f = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    check = K.static_check(F.col("hit").isNotNull(), F.col("quality") == 1, F.col("n_chars") % 5, F.col("toxic"))
    return f.withColumn("check_result", check).select("doc_id", "check_result", K.final_status(F.col("check_result"), F.col("doc_id") % 3 != 0).alias("status"))


@query("V4_cross_model", "SELECT doc_id, CASE WHEN contains(upper(text), 'VERIFIED') THEN 'verified' WHEN contains(upper(text), 'THE') THEN 'rejected' ELSE 'unclear' END AS verdict FROM documents")
def cross_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of a response by the first word found in it."""
    return table(spark, sf_dir, "documents").select("doc_id", K.first_word(F.col("text"), [("VERIFIED", "verified"), ("THE", "rejected")]).alias("verdict"))


@query("V7_postprocessing", "WITH r AS (SELECT event_id, event_id % 11 AS conf, event_id % 2 = 0 AS vuln, event_type = 'error' AS rebutted, user_id % 3 = 0 AS evidence FROM events), a AS (SELECT event_id, CASE WHEN rebutted THEN least(conf, 3) ELSE conf END AS conf, vuln AND NOT rebutted AS vuln, rebutted, evidence FROM r) SELECT event_id, CASE WHEN evidence THEN greatest(conf, 5) ELSE conf END AS conf, vuln OR evidence AS vuln, rebutted AND NOT evidence AS rebuttal FROM a")
def postprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adversary first, evidence second: evidence raises a rebutted row again and drops its rebuttal."""
    after = K.rebutted(F.col("event_id") % 11, F.col("event_id") % 2 == 0, F.col("event_type") == "error", F.col("user_id") % 3 == 0)
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in after.items()])
