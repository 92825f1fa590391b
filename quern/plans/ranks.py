"""Queries of percentiles, tiers, scores, guarded top-k and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import tables as T
from quern.operators import ranking as R
from quern.operators import selection as L
from quern.registry import query, table

from .classifiers import pick, sql_case, sql_list, sql_text

_AT = "max(CASE WHEN i = CAST(floor((n - 1) * {p} / 100) AS BIGINT) THEN o_totalprice END)"
_MARKS = f"n AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), q AS (SELECT o_orderpriority, {_AT.format(p=80)} AS p80, {_AT.format(p=40)} AS p40 FROM n GROUP BY 1)"


@query("W1_percentile", f"WITH {_MARKS} SELECT o_orderpriority, p80, p40 FROM q")
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.percentile_at(table(spark, sf_dir, "orders"), "o_totalprice", [80, 40], ["o_orderpriority"]).select("o_orderpriority", "p80", "p40")


_TIER = "CASE WHEN o_totalprice >= p80 THEN 'hot' WHEN o_totalprice >= p40 THEN 'warm' ELSE 'cold' END"


@query("W2_W3_tiers", f"WITH {_MARKS}, t AS (SELECT o_orderkey, {_TIER} AS tier FROM orders JOIN q USING (o_orderpriority)) SELECT o_orderkey, tier, CASE tier WHEN 'hot' THEN 10 WHEN 'warm' THEN 3 ELSE 0 END AS iterations FROM t")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.tiers(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"])
    return rows.select("o_orderkey", "tier", R.budget(F.col("tier")).alias("iterations"))


#: Source-to-sink paths made of parts: each part is a path whose sink, functions and files follow from its columns.
SINKS = ["exec", "open", "re.match", "custom_call", "cursor.execute", "check_access", "Markup"]
FUNCS = ["get_user", "strange_name_here", "validate_input", "odd-thing", "run", "zig_zag"]
KINDS = ["rce", "lfi", "redos", "unknown", "sqli", "idor", "xss"]
FILES = ["app/a.py", "lib/b.py", "core/c.py", "web/tests/d.py", "etc/e.py"]


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, key, sink, functions, files, is_full) from `part`."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "event_id")
    one = lambda values, shift: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col("event_id") * shift + F.col("p_size"), F.lit(len(values))).cast("int"))
    n = F.col("p_size") % 4
    functions = F.slice(F.array(one(FUNCS, 1), one(FUNCS, 3), one(FUNCS, 5)), F.lit(1), n.cast("int"))
    files = F.array(one(FILES, 1), one(FILES, 2), one(FILES, 3), one(FILES, 4))
    rows = part.select(F.col("event_id").alias("id"), pick(KINDS).alias("kind"), pick(SINKS).alias("sink"), functions.alias("functions"), files.alias("files"), (F.col("p_size") % 2 == 0).alias("is_full"), "p_size")
    return rows.withColumn("key", F.concat_ws(":", "kind", F.get("files", F.lit(1)), "p_size"))


def _one(values: list[str], shift: int) -> str:
    return f"{sql_list(values)}[1 + (p_partkey * {shift} + p_size) % {len(values)}]"


_PATHS = (
    f"pt AS (SELECT p_partkey AS id, {sql_list(KINDS)}[1 + p_partkey % {len(KINDS)}] AS kind, {sql_list(SINKS)}[1 + p_partkey % {len(SINKS)}] AS sink, [{_one(FUNCS, 1)}, {_one(FUNCS, 3)}, {_one(FUNCS, 5)}][1:p_size % 4] AS functions, [{', '.join(_one(FILES, k) for k in (1, 2, 3, 4))}] AS files, p_size % 2 = 0 AS is_full, p_size FROM part), "
    "pk AS (SELECT *, kind || ':' || files[2] || ':' || p_size AS key FROM pt), "
    f"ps AS (SELECT *, {sql_case([(f'sink = {sql_text(k)}', str(w)) for k, w in T.SINK_WEIGHTS.items()], '0.3')} AS w, sink IN ({', '.join(map(sql_text, T.SINK_WEIGHTS))}) AS known, regexp_matches(sink || ' ' || coalesce(array_to_string(functions, ' '), ''), {sql_text(T.VALIDATION)}) AS valid FROM pk), "
    "sc AS (SELECT *, round(least(0.4 * w + 0.2 / (1 + 0.1 * greatest(0, greatest(len(functions), 1) - 3)) + CASE WHEN valid THEN 0.2 ELSE 0 END + CASE WHEN is_full THEN 0.15 ELSE 0 END + CASE WHEN len(list_distinct(files)) >= 3 THEN 0.05 ELSE 0 END, 1), 6) AS score FROM ps)"
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(R.path_score(F.col("sink"), F.col("functions"), F.col("files"), F.col("is_full")), 6)
    return paths(spark, sf_dir).withColumns({"score": score, "known": F.col("sink").isin(list(T.SINK_WEIGHTS))})


@query("W4_path_score", f"WITH {_PATHS} SELECT id, sink, score FROM sc")
def path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "sink", "score")


_TOPK = (
    f"WITH {_PATHS}, f AS (SELECT * FROM sc WHERE len(list_filter(files, lambda x: regexp_matches(x, {sql_text(T.EXCLUDED_DIR)}))) = 0), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY known DESC, score DESC, id) AS r FROM f) WHERE r = 1), "
    "fill AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r2 FROM f WHERE key NOT IN (SELECT key FROM g)), "
    "b AS (SELECT id, kind, score, 0 AS sure FROM g UNION ALL SELECT id, kind, score, 1 FROM fill) "
)


@query("W5_W8_guarded_top_k", _TOPK + "SELECT id, kind, score, place, kind || '-' || lpad(CAST(place - 1 AS VARCHAR), 3, '0') AS slice FROM (SELECT *, row_number() OVER (ORDER BY sure, CASE WHEN sure = 0 THEN kind END, score DESC, id) AS place FROM b) WHERE place <= 25")
def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).filter(~F.exists("files", lambda f: f.rlike(T.EXCLUDED_DIR)))
    top = R.guarded_top_k(rows, "kind", "key", "known", "score", "id")
    return top.select("id", "kind", "score", "place", F.format_string("%s-%03d", "kind", F.col("place") - 1).alias("slice"))


_ODD = "list_filter(functions, lambda f: len(string_split(replace(f, '-', '_'), '_')) >= 2 AND NOT list_has_any(list_transform(string_split(replace(f, '-', '_'), '_'), lambda p: lower(p)), {names}))".format(names=sql_list(T.COMMON_NAMES))


@query(
    "W6_W7_anomalies",
    f"WITH {_PATHS} SELECT id, array_to_string(list_filter([CASE WHEN NOT known THEN 'non_std_sink' END, CASE WHEN len(functions) > 1 AND len({_ODD}) * 2 > len(functions) THEN 'unusual_naming' END, CASE WHEN len(list_distinct(list_transform(files, lambda f: split_part(f, '/', 1)))) > 3 THEN 'multi_module_flow' END], lambda e: e IS NOT NULL), ',') AS reasons FROM sc",
)
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", F.array_join(R.anomalies(F.col("sink"), F.col("functions"), F.col("files")), ",").alias("reasons"))


_W9 = "score DESC, p_partkey"


@query(
    "W9_prune_candidates",
    f"WITH c AS (SELECT p_partkey, p_brand AS file, ({sql_case([(f'p_partkey % 5 = {i}', str(5 - i)) for i in range(5)])}) * (1 + p_size % 3) + CASE p_partkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 7 WHEN 2 THEN 5 ELSE 0 END AS score, p_size > 45 AS test FROM part), "
    f"e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY {_W9}) AS r FROM c WHERE NOT test AND file < 'Brand#2') WHERE r <= 2), r0 AS (SELECT * FROM e ORDER BY {_W9} LIMIT 15), "
    f"o AS (SELECT *, 1 AS stage FROM c WHERE NOT test AND p_partkey NOT IN (SELECT p_partkey FROM r0) UNION ALL SELECT *, 2 FROM c WHERE test UNION ALL SELECT p_partkey, file, score, test, 0 FROM r0) "
    f"SELECT p_partkey, file, score, place FROM (SELECT *, row_number() OVER (ORDER BY stage, {_W9}) AS place FROM o) WHERE place <= 30",
)
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates of each entry file, up to half the cap; then the best others; then those in tests."""
    score = F.get(F.array(*[F.lit(5 - i) for i in range(5)]), (F.col("p_partkey") % 5).cast("int")) * (1 + F.col("p_size") % 3) + F.get(F.array(F.lit(8), F.lit(7), F.lit(5), F.lit(0)), (F.col("p_partkey") % 4).cast("int"))
    c = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file"), score.alias("score"), (F.col("p_size") > 45).alias("test"))
    return L.prune(c, "p_partkey", "file", [F.desc("score"), "p_partkey"], F.col("file") < "Brand#2", F.col("test")).select("p_partkey", "file", "score", "place")


@query("W10_two_level_cap", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE event_type = 'error'), b AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS k FROM a WHERE r <= 5) SELECT event_id, user_id FROM b WHERE k <= 30")
def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.capped(table(spark, sf_dir, "events").filter("event_type = 'error'"), "user_id", [F.desc("value"), "event_id"], 5, 30).select("event_id", "user_id")


@query("W11_first_by_severity", "SELECT l_orderkey, l_returnflag, arg_min(l_linenumber, (CASE l_shipmode WHEN 1 THEN 0 ELSE 1 END, l_linenumber)) AS l_linenumber FROM (SELECT *, l_linenumber % 2 AS l_shipmode FROM lineitem) GROUP BY 1, 2")
def by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_by_severity(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], F.when(F.col("l_linenumber") % 2 == 1, 0).otherwise(1), "l_linenumber")


@query("W12_phase_split", "WITH s AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER () AS n FROM part) SELECT p_partkey, CASE WHEN r <= greatest(20, least(200, CAST(floor(n * 0.3) AS BIGINT))) THEN 'high' ELSE 'remaining' END AS phase FROM s")
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first max(20, min(200, 30 %)) files: 200 at most, so they are found by a bounded top-k."""
    return L.phase_split(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey", [F.desc("p_retailprice"), "p_partkey"])


@query(
    "W13_stratified_sample",
    "WITH r AS (SELECT doc_id, source, CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r, greatest(1, count(*) OVER (PARTITION BY source) * 200 // count(*) OVER ()) AS share FROM r) "
    "SELECT doc_id, source FROM k ORDER BY CASE WHEN r = 1 THEN 2 WHEN r <= share THEN 1 ELSE 0 END DESC, h, doc_id LIMIT 200",
)
def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified(table(spark, sf_dir, "documents"), "source", "doc_id", 200).select("doc_id", "source")


@query("W14_budget_or_danger", "SELECT p_partkey FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 100 OR contains(p_type, 'BRASS')")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_or(table(spark, sf_dir, "part"), "p_partkey", [F.desc("p_retailprice"), "p_partkey"], 100, F.col("p_type").contains("BRASS"))


@query("W15_library_guard", "WITH e AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey FROM (SELECT c_custkey FROM e ORDER BY c_acctbal DESC, c_custkey LIMIT 10) UNION SELECT c_custkey FROM customer WHERE c_acctbal < -950")
def library_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_or(table(spark, sf_dir, "customer"), "c_custkey", [F.desc("c_acctbal"), "c_custkey"], 10, F.col("c_acctbal") < -950, F.col("c_mktsegment") == "BUILDING")


@query("W16_nearby_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) SELECT doc_id, no, line FROM l WHERE no >= doc_id % 30 - 20 AND no < doc_id % 30 + 5")
def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nearby_lines(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("doc_id") % 30)


@query("W17_chunks", "SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority, o_orderkey % 64 ORDER BY o_orderkey) - 1) // 10 AS chunk FROM orders")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ten within the 64 parts of each priority, so no priority is numbered in one task."""
    return L.chunks(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query("W18_card_selection", "WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority IN ('1-URGENT', '2-HIGH') AS warm FROM orders), a AS (SELECT * FROM p WHERE warm ORDER BY o_totalprice DESC, o_orderkey LIMIT 10), b AS (SELECT * FROM p WHERE NOT warm AND o_custkey NOT IN (SELECT o_custkey FROM a) ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) SELECT o_orderkey, warm FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").withColumn("warm", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return L.two_pools(p, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], F.col("warm")).select("o_orderkey", "warm")


@query("W19_priority_map", "WITH m AS (SELECT p_type, max(p_retailprice) AS priority, count(*) OVER () AS n FROM part GROUP BY 1) SELECT p_type, priority, CASE WHEN n >= 500 THEN 400 WHEN n >= 200 THEN 200 END AS cap FROM m")
def priority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.priority_map(table(spark, sf_dir, "part"), "p_type", "p_retailprice")


@query("W20_batches", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 2 THEN 'batch' ELSE 'single' END AS kind FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.batches(table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'"), "o_custkey")
