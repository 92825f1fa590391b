"""Queries of joins, set operations and aggregations on the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import aggregates as A
from quern.operators import checks as K
from quern.operators import joins as J
from quern.registry import query, table

_ROUTE = r"regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '\d+', '${id}', 'g')"
_KEY = f"CASE WHEN starts_with(regexp_replace(trim(lower(regexp_replace({_ROUTE}, '\\$\\{{[^}}]+\\}}', '{{param}}', 'g'))), '/$', ''), '/') THEN '' ELSE '/' END || regexp_replace(trim(lower(regexp_replace({_ROUTE}, '\\$\\{{[^}}]+\\}}', '{{param}}', 'g'))), '/$', '')"


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), r"\d+", r"\${id}")
    return table(spark, sf_dir, "pages").select("page_id", S.normalize_route(S.resolve_params(route)).alias("key"))


@query("J1_J2_route_match", f"WITH r AS (SELECT page_id, {_KEY} AS key FROM pages), b AS (SELECT key, min(page_id) AS endpoint FROM r WHERE page_id % 3 = 0 GROUP BY 1) SELECT page_id, key, endpoint, endpoint IS NOT NULL AS matched FROM r LEFT JOIN b USING (key) WHERE page_id % 3 <> 0")
def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontend calls (pages not divisible by 3) with the first endpoint of their normalised route."""
    routes = _routes(spark, sf_dir)
    back = routes.filter("page_id % 3 = 0").select("key", F.col("page_id").alias("endpoint"), F.col("page_id").alias("ordinal"))
    found = J.first_match(routes.filter("page_id % 3 <> 0"), back, "key", "ordinal")
    return found.select("page_id", "key", "endpoint", F.col("endpoint").isNotNull().alias("matched"))


@query("J2_unmatched_backend", f"WITH r AS (SELECT page_id, {_KEY} AS key FROM pages), b AS (SELECT key, min(page_id) AS endpoint FROM r WHERE page_id % 3 = 0 GROUP BY 1) SELECT page_id FROM r WHERE page_id % 3 = 0 AND page_id NOT IN (SELECT endpoint FROM b WHERE key IN (SELECT key FROM r WHERE page_id % 3 <> 0))")
def unmatched_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that no call was matched to; of equal routes only the first is ever matched."""
    routes = _routes(spark, sf_dir)
    back = routes.filter("page_id % 3 = 0")
    firsts = back.groupBy("key").agg(F.min("page_id").alias("page_id"))
    used = firsts.join(routes.filter("page_id % 3 <> 0").select("key").distinct(), "key", "left_semi")
    return back.select("page_id").join(used.select("page_id"), "page_id", "left_anti")


@query("J3_defs_refs", "SELECT p_brand AS ident, count(*) AS pairs FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 10) JOIN (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size > 40) USING (p_brand) GROUP BY 1")
def defs_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    defs = part.filter("p_size < 10").select("p_brand", "p_type").distinct().groupBy("p_brand").agg(F.count(F.lit(1)).alias("d"))
    refs = part.filter("p_size > 40").select("p_brand", "p_size").distinct().groupBy("p_brand").agg(F.count(F.lit(1)).alias("r"))
    return defs.join(refs, "p_brand").select(F.col("p_brand").alias("ident"), (F.col("d") * F.col("r")).alias("pairs"))


@query(
    "J5_call_resolution",
    "WITH f AS (SELECT 'mod.' || p_brand || '.' || p_partkey AS qname, p_partkey AS ordinal FROM part), c AS (SELECT event_id AS call_id, 'mod' AS scope, CASE event_id % 5 WHEN 0 THEN 'mod.' || p_brand || '.' || p_partkey WHEN 1 THEN p_brand || '.' || p_partkey WHEN 2 THEN CAST(p_partkey AS VARCHAR) WHEN 3 THEN 'np.' || event_type ELSE 'print' END AS name FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)), "
    "w AS (SELECT call_id, 1 AS p, ordinal, qname AS target, 'exact' AS how FROM c JOIN f ON name = qname UNION ALL SELECT call_id, 2, ordinal, qname, 'scope' FROM c JOIN f ON scope || '.' || name = qname UNION ALL SELECT call_id, 3, ordinal, qname, 'suffix' FROM c JOIN f ON ends_with(qname, '.' || name) UNION ALL SELECT call_id, 4, 0, 'numpy' || substr(name, 3), 'import' FROM c WHERE starts_with(name, 'np.') UNION ALL SELECT call_id, 5, 0, name, 'builtin' FROM c WHERE name = 'print') "
    "SELECT call_id, target, how FROM c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY p, ordinal) AS r FROM w) USING (call_id) WHERE r = 1 OR r IS NULL",
)
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    functions = part.select(F.concat(F.lit("mod."), "p_brand", F.lit("."), "p_partkey").alias("qname"), F.col("p_partkey").alias("ordinal"))
    which = F.col("event_id") % 5
    name = F.when(which == 0, F.concat(F.lit("mod."), "p_brand", F.lit("."), "p_partkey")).when(which == 1, F.concat("p_brand", F.lit("."), "p_partkey")).when(which == 2, F.col("p_partkey").cast("string")).when(which == 3, F.concat(F.lit("np."), "event_type")).otherwise(F.lit("print"))
    events = table(spark, sf_dir, "events")
    calls = events.join(part, F.col("p_partkey") == F.col("event_id") % part.count()).select(F.col("event_id").alias("call_id"), F.lit("f").alias("file"), F.lit("mod").alias("scope"), name.alias("name"))
    imports = spark.createDataFrame([("f", "np", "numpy")], "file string, alias string, module string")
    return J.resolve_calls(calls, functions, imports, ["print", "len"])


@query(
    "J6_interval_containment",
    "WITH e AS (SELECT event_id, user_id, epoch(ts) AS t FROM events), s AS (SELECT event_id AS span_id, user_id, t - 3600 AS low, t + 7200 AS high FROM e WHERE event_id % 20 = 0) SELECT event_id, span_id FROM e JOIN s USING (user_id) WHERE t >= low AND t + 60 <= high",
)
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one minute inside a user's spans."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1e6).alias("t")).withColumn("end", F.col("t") + 60)
    spans = e.filter("event_id % 20 = 0").select(F.col("event_id").alias("span_id"), "user_id", (F.col("t") - 3600).alias("low"), (F.col("t") + 7200).alias("high"))
    return J.contained(e, spans, "user_id", "t", "end", "low", "high", 7200.0).select("event_id", "span_id")


@query("J7_J8_callers_of_name", "SELECT a.p_partkey AS callee, count(*) AS callers FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size GROUP BY 1")
def callers_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a name (brand and size) with all its overloads, counted before the join rather than paired."""
    return K.callers_of_name(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"]).withColumnRenamed("p_partkey", "callee")


@query("J10_fuzzy_file", "WITH w AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN url ELSE 'x/' || regexp_extract(url, '[^/]*$') END AS name FROM pages), f AS (SELECT url AS path, page_id AS ordinal FROM pages), m AS (SELECT name, 1 AS p, ordinal, path FROM w JOIN f ON name = path UNION ALL SELECT name, 2, ordinal, path FROM w JOIN f ON regexp_extract(name, '[^/]*$') = regexp_extract(path, '[^/]*$')) SELECT name, coalesce((SELECT path FROM m WHERE m.name = w.name ORDER BY p, ordinal LIMIT 1), '') AS path FROM w")
def fuzzy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    wanted = pages.select(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("x/"), F.substring_index("url", "/", -1))).alias("name")).distinct()
    return J.fuzzy_file(wanted, pages.select(F.col("url").alias("path"), F.col("page_id").alias("ordinal")))


@query("J11_attribute_bridge", "SELECT s_nationkey AS file, a.event_type AS kind, count(DISTINCT (a.event_id % 7, b.event_id % 5)) AS bridges FROM supplier JOIN events a ON a.user_id = s_suppkey AND a.event_type = 'view' JOIN events b ON b.user_id = s_suppkey AND b.event_type = 'click' GROUP BY ALL")
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute bridges: views store, clicks read the same user's attribute; a file is a nation."""
    e, s = table(spark, sf_dir, "events"), table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("file"))
    side = lambda kind, by, name: e.filter(F.col("event_type") == kind).join(s, F.col("user_id") == F.col("s_suppkey")).select("file", F.col("user_id").alias("attr"), (F.col("event_id") % by).alias(name)).distinct()
    found = J.attribute_bridges(side("view", 7, "storer"), side("click", 5, "reader").withColumn("kind", F.lit("view")))
    return found.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("bridges"))


@query("J12_agreement", "SELECT a.doc_id, bool_or(coalesce(l.quality = 1 AND a.n_chars % 2 = l.toxic, false)) AS agrees, count(l.doc_id) AS n_static FROM documents a LEFT JOIN labels l ON a.doc_id = l.doc_id GROUP BY 1")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings against static results of the same file; the same line is an agreement."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return K.agreement(docs, labels, "doc_id", (F.col("quality") == 1) & (F.col("n_chars") % 2 == F.col("toxic")))


@query(
    "J13_candidate_cards",
    "WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'dir' || s_suppkey % 50 || '/f' || s_suppkey % 7 || '.py' ELSE 'f' || s_suppkey % 7 || '.py' END AS file, ['fn' || s_suppkey % 40, 'fn' || s_nationkey] AS functions FROM supplier), "
    "p AS (SELECT p_partkey, 'src/dir' || p_partkey % 50 || '/f' || p_size % 7 || '.py' AS file, 'fn' || p_size AS fn FROM part) SELECT DISTINCT p_partkey, s_suppkey AS card FROM p JOIN c ON p.file = c.file OR ends_with(p.file, '/' || c.file) OR list_contains(functions, fn)",
)
def candidate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the cards whose file ends theirs or whose functions hold theirs."""
    name = F.concat(F.lit("f"), F.col("s_suppkey") % 7, F.lit(".py"))
    file = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("dir"), F.col("s_suppkey") % 50, F.lit("/"), name)).otherwise(name)
    cards = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("card"), file.alias("file"), F.array(F.concat(F.lit("fn"), F.col("s_suppkey") % 40), F.concat(F.lit("fn"), "s_nationkey")).alias("functions"))
    path = F.concat(F.lit("src/dir"), F.col("p_partkey") % 50, F.lit("/f"), F.col("p_size") % 7, F.lit(".py"))
    return K.candidate_cards(table(spark, sf_dir, "part").select("p_partkey", path.alias("file"), F.concat(F.lit("fn"), "p_size").alias("fn")), cards, "p_partkey", "file", "fn")


@query("J14_injection", "SELECT c_custkey, 'injected' AS origin FROM customer WHERE c_acctbal > 9000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return K.injected(table(spark, sf_dir, "customer").filter("c_acctbal > 9000"), big, "c_custkey")


@query("J15_V1_file_check", "WITH f AS (SELECT url FROM pages WHERE page_id % 2 = 0), b AS (SELECT regexp_extract(url, '[^/]*$') AS base, min(url) AS fixed FROM f GROUP BY 1) SELECT page_id, f.url IS NOT NULL AS found, CASE WHEN f.url IS NULL THEN fixed END AS corrected FROM pages p LEFT JOIN (SELECT DISTINCT url FROM f) f ON p.url = f.url LEFT JOIN b ON regexp_extract(p.url, '[^/]*$') = base")
def file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that isn't there is corrected to the first of the same base name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return K.file_check(pages, pages.filter("page_id % 2 = 0"), "url").select("page_id", "found", "corrected")


@query("S11_two_semi_joins", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def two_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which both ends are nodes."""
    nodes = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    others = table(spark, sf_dir, "part").filter("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(nodes, "l_suppkey", "left_semi").join(others, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("D8_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    n = lambda op, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n("union", a.union(b).distinct()).union(n("intersect", a.intersect(b))).union(n("except", b.subtract(a)))


@query("A4_A5_feedback", r"WITH f AS (SELECT event_id, user_id, event_type = 'purchase' AS triggerable, '[SAST:r' || event_id % 3 || '] seen [SAST:s' || user_id % 2 || ']' AS evidence FROM events), u AS (SELECT user_id, unnest(regexp_extract_all(evidence, '\[SAST:([^\]]+)\]', 1)) AS rule FROM f WHERE NOT triggerable) SELECT user_id, rule, n, max(n) OVER (PARTITION BY user_id) >= 2 AS suppressed FROM (SELECT user_id, rule, count(*) AS n FROM u GROUP BY ALL)")
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives by file (user) and rule; a file with a rule of two or more is suppressed."""
    text = F.concat(F.lit("[SAST:r"), F.col("event_id") % 3, F.lit("] seen [SAST:s"), F.col("user_id") % 2, F.lit("]"))
    found = table(spark, sf_dir, "events").select("user_id", text.alias("evidence"), (F.col("event_type") == "purchase").alias("triggerable"))
    return A.false_positives(found, "user_id", "evidence", "triggerable")


@query("A1_A6_report", "SELECT l_returnflag AS severity, l_linestatus AS status, count(*) AS findings, count(*) FILTER (l_discount > 0.05) AS high, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY ALL")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    counts = A.count_by(lines, {"severity": "l_returnflag", "status": "l_linestatus"}, "findings", high=F.col("l_discount") > 0.05)
    tax = lines.groupBy(F.col("l_returnflag").alias("severity"), F.col("l_linestatus").alias("status")).agg(F.round(F.sum("l_tax"), 4).alias("tax"))
    return counts.join(tax, ["severity", "status"])


@query("A7_buckets", "SELECT count(*) AS total, count(*) FILTER (quality = 0) AS vulnerable, count(*) FILTER (doc_id % 11 >= 4 AND doc_id % 11 < 7) AS interesting, count(*) FILTER (doc_id % 11 < 4) AS safe FROM labels")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.outcome_buckets(table(spark, sf_dir, "labels"), F.col("quality") == 0, F.col("doc_id") % 11)


@query("A9_route_kpis", "SELECT o_orderpriority AS project, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS authed, count(*) FILTER (o_orderkey % 4 = 0) AS public, count(*) - count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderkey % 4 = 0) AS no_auth FROM orders GROUP BY 1")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are both authed and public are taken off twice, as in what is matched."""
    return A.route_kpis(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", F.col("o_orderkey") % 4 == 0)


@query("A10_top_counts", "SELECT p_type AS ext, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, ext LIMIT 10")
def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_counts(table(spark, sf_dir, "part"), "p_type").withColumnRenamed("p_type", "ext")


@query("A11_symbol_table", "SELECT event_type AS symbol, arg_min(user_id || ':' || event_id, event_id) AS place FROM events GROUP BY 1")
def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_places(table(spark, sf_dir, "events"), "event_type", F.concat("user_id", F.lit(":"), "event_id"), "event_id").withColumnRenamed("event_type", "symbol")


@query("A2_card_signals", "SELECT user_id, event_type AS signal, count(DISTINCT event_id % 10) AS n FROM events GROUP BY ALL")
def card_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a file, one for each tag name; distinct pairs first, so a file with many tags is counted in parts."""
    tags = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("signal"), (F.col("event_id") % 10).alias("name"))
    return A.distinct_by(tags, ["user_id", "signal"], "name")


@query("A12_score_cascade", "SELECT l_orderkey, round(min(CASE WHEN l_discount < 0.09 THEN 1 ELSE 0 END) * 0.6 + 0.4 * count(*) FILTER (l_tax > 0.02) / count(*), 2) AS score FROM lineitem GROUP BY 1")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.score_cascade(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_discount") < 0.09, F.col("l_tax") > 0.02)


@query("A13_majority_vote", "WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS vuln, o_orderkey % 11 AS conf, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), a AS (SELECT o_custkey, arg_min(vuln, r) AS vuln, arg_min(conf, r) AS conf, count(*) FILTER (vuln) >= 2 AS major, CAST(floor(avg(conf)) AS BIGINT) AS mean FROM v WHERE r <= 3 GROUP BY 1) SELECT o_custkey, CASE WHEN conf BETWEEN 4 AND 7 THEN major ELSE vuln END AS vuln, CASE WHEN conf BETWEEN 4 AND 7 AND major AND NOT vuln THEN greatest(mean, 7) WHEN conf BETWEEN 4 AND 7 AND NOT major AND vuln THEN least(mean, 3) ELSE conf END AS conf FROM a")
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three votes; grey-zone results (4 to 7) are promoted or demoted by two of them."""
    votes = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("vuln"), (F.col("o_orderkey") % 11).alias("conf"))
    return A.majority_vote(votes, "o_custkey", "o_orderkey", "vuln", "conf")


@query("A14_dedup_ratio", "SELECT source, round(1 - count(DISTINCT text) / count(*), 6) AS ratio FROM documents GROUP BY 1")
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeat_ratio(table(spark, sf_dir, "documents"), "source", "text")


@query("A15_cache_stats", "SELECT count(*) AS entries, CAST(sum(n - 1) AS BIGINT) AS hits FROM (SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1)")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cache_counts(table(spark, sf_dir, "documents"), "text")


@query("S14_grep", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) SELECT doc_id, no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS r FROM l WHERE regexp_matches(line, '(?i)licen[cs]e|the and')) WHERE r <= 10")
def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten matching lines of each file."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    hits = F.slice(F.filter(lines, lambda x: x["line"].rlike("(?i)licen[cs]e|the and")), 1, 10)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("h")).select("doc_id", F.col("h.no").cast("long").alias("no"), "h.line")


@query("S15_read_file", "SELECT doc_id, array_to_string(string_split(text, chr(10))[3:152], chr(10)) AS part FROM documents")
def read_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 on, 150 at most."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 3, 150), "\n").alias("part"))
