"""Queries of graph operators on the trade graph, which grows with lineitem, and on the turns of conversations.

Trade: a customer's node leads to the parts that they order, a part's to its suppliers, a supplier's to the customer account
of the same number. Tags: suppliers define their names and their nations', customers theirs, parts their types; orders refer
to suppliers and to the customer's nation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators.storage import materialise
from quern.registry import query, table

ITERATIONS = 20
ENTRIES, SINKS = ["C1", "C4", "S2", "S7"], ["S2", "S9", "C8", "P15"]

TAGS_SQL = """
l AS (SELECT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
refs AS (SELECT 'C' || c AS file, s_name AS name FROM l JOIN supplier ON s = s_suppkey
         UNION ALL SELECT 'C' || o_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         UNION ALL SELECT 'S' || s_suppkey, c_name FROM supplier JOIN customer ON s_suppkey = c_custkey),
defs AS (SELECT 'S' || s_suppkey AS file, s_name AS name FROM supplier UNION SELECT 'S' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
         UNION SELECT 'C' || c_custkey, c_name FROM customer UNION SELECT 'P' || p_partkey, p_type FROM part),
counted AS (SELECT file, name, count(*) AS n FROM refs GROUP BY ALL),
definers AS (SELECT name, count(*) AS definers FROM defs GROUP BY 1),
multi AS (
  SELECT c.file AS src, d.file AS dst, c.name AS ident,
         CASE WHEN length(name) >= 8 AND (regexp_matches(name, '[A-Z]') AND regexp_matches(name, '[a-z]') OR regexp_matches(name, '[_-]') AND regexp_matches(name, '[a-zA-Z]')) THEN 10.0 ELSE 1.0 END
         * CASE WHEN definers > 5 THEN 0.1 ELSE 1.0 END * sqrt(n) AS weight
  FROM counted c JOIN definers USING (name) JOIN defs d USING (name)
  UNION ALL SELECT file, file, name, 0.1 FROM defs WHERE name NOT IN (SELECT name FROM refs))"""
EDGES_SQL = """
edges AS MATERIALIZED (
  SELECT 'C' || o_custkey AS src, 'P' || l_partkey AS dst, sqrt(count(*)) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
  UNION ALL SELECT 'P' || l_partkey, 'S' || l_suppkey, sqrt(count(*)) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'S' || s_suppkey, 'C' || c_custkey, 1.0 FROM supplier JOIN customer ON s_suppkey = c_custkey)"""
TURNS_SQL = """
turns AS (SELECT conv_id || ':' || lpad(CAST(turn AS VARCHAR), 3, '0') AS node, conv_id, turn, role FROM conversations),
edges AS MATERIALIZED (SELECT a.node AS src, b.node AS dst FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND (b.turn = a.turn + 1 OR b.turn > a.turn + 1 AND b.turn <= a.turn + 3 AND a.role = b.role)),
ends AS (SELECT arg_min(node, turn) AS entry, arg_max(node, turn) AS sink FROM turns GROUP BY conv_id)"""


def _key(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(definitions, references) of names by node."""
    t = lambda name: table(spark, sf_dir, name)
    supplier, customer, nation = t("supplier").select("s_suppkey", "s_name", "s_nationkey"), t("customer").select("c_custkey", "c_name", "c_nationkey"), t("nation").select("n_nationkey", "n_name")
    refs = [
        _lines(spark, sf_dir).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(_key("C", "o_custkey").alias("file"), F.col("s_name").alias("name")),
        t("orders").select("o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(_key("C", "o_custkey"), "n_name"),
        supplier.join(customer, F.col("s_suppkey") == F.col("c_custkey")).select(_key("S", "s_suppkey"), "c_name"),
    ]
    defs = [
        supplier.select(_key("S", "s_suppkey").alias("file"), F.col("s_name").alias("name")),
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(_key("S", "s_suppkey"), "n_name"),
        customer.select(_key("C", "c_custkey"), "c_name"),
        t("part").select(_key("P", "p_partkey"), "p_type"),
    ]
    return defs[0].union(defs[1]).union(defs[2]).union(defs[3]), refs[0].union(refs[1]).union(refs[2])


def trade_edges(spark: SparkSession, sf_dir: str, key: Callable[[str, str], Column] = _key) -> DataFrame:
    """(src, dst, weight) of customers, parts and suppliers; every line counts. ``key``: a node from its letter and its number's column."""
    n = F.sqrt(F.count(F.lit(1))).alias("weight")
    # Grouped by the numbers themselves: names are made once a group.
    ordered = _lines(spark, sf_dir).groupBy("o_custkey", "l_partkey").agg(n).select(key("C", "o_custkey").alias("src"), key("P", "l_partkey").alias("dst"), "weight")
    supplied = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(n).select(key("P", "l_partkey"), key("S", "l_suppkey"), "weight")
    same = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    return materialise(ordered.union(supplied).union(same.select(key("S", "s_suppkey"), key("C", "c_custkey"), F.lit(1.0))), "trade-edges")


#: A trade node as one number: three times its key and the place of its letter here. Keys beyond 3 * 10**18 overflow, which is an error.
LETTERS = "CPS"


def number_key(letter: str, column: str) -> Column:
    return F.col(column).cast("long") * 3 + LETTERS.index(letter)


def name_of(column: str) -> Column:
    """The name of a node that is given as a number."""
    letter = F.pmod(F.col(column), F.lit(3))
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in LETTERS]), (letter + 1).cast("int")), F.expr(f"({column} - pmod({column}, 3)) div 3"))


def turn_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(src, dst) from each turn of a conversation to the next and to those of the same role up to three on; (entry, sink): its first and last turn."""
    turns = table(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit(":"), F.lpad(F.col("turn").cast("string"), 3, "0")).alias("node"), "conv_id", "turn", "role")
    a, b = turns.alias("a"), turns.alias("b")
    later = F.col("b.turn") - F.col("a.turn")
    near = (later == 1) | (later.between(2, 3) & (F.col("a.role") == F.col("b.role")))
    # A turn meets the three after it at most: the join is on the turn's number, not on the conversation alone.
    steps = a.withColumn("at", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + 3))).alias("a")
    edges = steps.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.at") == F.col("b.turn"))).filter(near).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    ends = turns.groupBy("conv_id").agg(F.min_by("node", "turn").alias("entry"), F.max_by("node", "turn").alias("sink")).select("entry", "sink")
    return materialise(edges, "turn-edges"), ends


def nodes_of(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def numbers_of(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(int(n[1:]) * 3 + LETTERS.index(n[0]),) for n in names], "node long")


@query("G3_reference_graph", f"WITH {TAGS_SQL} SELECT src, dst, ident, round(weight, 6) AS weight FROM multi")
def reference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reference_graph(*tags(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def _rank_sql(edges: str, personal: str) -> str:
    """PageRank with a CTE for each iteration. ``personal``: an expression of node with sum N."""
    parts = [
        f"w AS (SELECT src, dst, sum(weight) AS weight FROM {edges} GROUP BY ALL)",
        "share AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM w)",
        "nodes AS (SELECT src AS node FROM w UNION SELECT dst FROM w)",
        f"pers AS (SELECT node, CAST({personal} AS DOUBLE) AS raw FROM nodes)",
        "tele AS MATERIALIZED (SELECT node, CASE WHEN sum(raw) OVER () > 0 THEN raw * count(*) OVER () / sum(raw) OVER () ELSE 1.0 / count(*) OVER () END * 0.15 / count(*) OVER () AS base, 1.0 / count(*) OVER () AS start FROM pers)",
        "r0 AS (SELECT node, start AS rank FROM tele)",
    ]
    for i in range(1, ITERATIONS + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT node, base + 0.85 * coalesce(s, 0) AS rank FROM tele LEFT JOIN (SELECT dst AS node, sum(rank * share) AS s FROM share JOIN r{i - 1} ON src = node GROUP BY 1) USING (node))")
    return ", ".join(parts)


@query("G6_pagerank", f"WITH {EDGES_SQL}, {_rank_sql('edges', '0')} SELECT node, round(rank, 9) AS rank FROM r{ITERATIONS}")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(trade_edges(spark, sf_dir), iterations=ITERATIONS, tolerance=0).select("node", F.round("rank", 9).alias("rank"))


_PERSONAL = f"CASE WHEN node IN ({', '.join(repr(e) for e in ENTRIES)}) THEN 40.0 ELSE 0 END"


@query("G5_G6_personalised_pagerank", f"WITH {EDGES_SQL}, {_rank_sql('edges', _PERSONAL)} SELECT node, round(rank, 9) AS rank FROM r{ITERATIONS}")
def personalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    personal = nodes_of(spark, ENTRIES).withColumn("weight", F.lit(40.0))
    return G.pagerank(trade_edges(spark, sf_dir), personal, ITERATIONS, 0).select("node", F.round("rank", 9).alias("rank"))


@query(
    "G7_distributed_rank",
    f"WITH {TAGS_SQL}, {_rank_sql('multi', '0')}, t AS (SELECT src, sum(weight) AS total FROM multi GROUP BY 1) "
    f"SELECT dst, ident, round(sum(rank * weight / total), 9) AS rank FROM multi JOIN t USING (src) JOIN r{ITERATIONS} ON node = src GROUP BY 1, 2",
)
def distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, spread = G.reference_pagerank(*G.reference_parts(*tags(spark, sf_dir)), iterations=ITERATIONS)
    return spread.select("dst", "ident", F.round("rank", 9).alias("rank"))


def _list(names: list[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


_REACH = (
    "known AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), "
    f"en AS (SELECT * FROM (VALUES {_list(ENTRIES)}) v(node) WHERE node IN (SELECT node FROM known)), si AS (SELECT * FROM (VALUES {_list(SINKS)}) v(node) WHERE node IN (SELECT node FROM known)), "
    "fwd AS (SELECT en.node AS entry, dst AS node FROM en JOIN edges ON src = en.node UNION SELECT entry, dst FROM fwd JOIN edges ON src = node), "
    "bwd AS (SELECT si.node AS sink, src AS node FROM si JOIN edges ON dst = si.node UNION SELECT sink, src FROM bwd JOIN edges ON dst = node), "
    "pr AS (SELECT en.node AS entry, si.node AS sink FROM en, si WHERE en.node = si.node OR EXISTS (SELECT 1 FROM fwd WHERE fwd.entry = en.node AND fwd.node = si.node)), "
    "hit AS (SELECT f.node FROM pr JOIN fwd f ON f.entry = pr.entry AND f.node <> pr.entry JOIN bwd b ON b.sink = pr.sink AND b.node = f.node AND b.node <> pr.sink)"
)


@query("G8a_attack_scores_files", f"WITH RECURSIVE {EDGES_SQL}, {_REACH} SELECT node, 500.0 * count(*) AS score FROM (SELECT * FROM hit UNION ALL SELECT entry FROM pr UNION ALL SELECT sink FROM pr) GROUP BY 1")
def attack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.attack_scores(trade_edges(spark, sf_dir), nodes_of(spark, ENTRIES), nodes_of(spark, SINKS), True)


@query("G8b_attack_scores_functions", f"WITH RECURSIVE {EDGES_SQL}, {_REACH} SELECT node, 500.0 * count(*) AS score FROM hit GROUP BY 1")
def attack_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.attack_scores(trade_edges(spark, sf_dir), nodes_of(spark, ENTRIES), nodes_of(spark, SINKS), False)


def _bfs_sql(depth: int) -> str:
    """Levels unrolled: a node's place in its level by its first parent's place, then by name."""
    parts = [f"b0 AS (SELECT node AS entry, node, 0 AS depth, 1 AS place FROM (VALUES {_list(ENTRIES)}) v(node))"]
    for i in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT entry, node FROM b{j}" for j in range(i))
        parts.append(
            f"b{i} AS MATERIALIZED (SELECT entry, node, {i} AS depth, row_number() OVER (PARTITION BY entry ORDER BY parent, node) AS place FROM (SELECT entry, dst AS node, min(place) AS parent FROM b{i - 1} JOIN edges ON src = node GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM ({before}) s WHERE s.entry = x.entry AND s.node = x.node))"
        )
    every = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(depth + 1))
    return f"{', '.join(parts)} SELECT entry, node, depth, position FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY depth, place) AS position FROM ({every})) WHERE position <= 30"


@query("G9_G10_bfs", f"WITH {EDGES_SQL}, {_bfs_sql(8)}")
def bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs(trade_edges(spark, sf_dir), nodes_of(spark, ENTRIES))


@query(
    "G11_simple_paths",
    f"WITH RECURSIVE {TURNS_SQL}, p AS (SELECT entry, sink, [entry] AS path FROM ends WHERE entry <> sink UNION ALL SELECT entry, sink, list_append(path, dst) FROM p JOIN edges ON src = path[-1] WHERE NOT list_contains(path, dst) AND path[-1] <> sink AND len(path) <= 12) "
    "SELECT entry, sink, array_to_string(path, '>') AS path FROM p WHERE path[-1] = sink",
)
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of at most 12 edges from each conversation's first turn to its last."""
    edges, ends = turn_edges(spark, sf_dir)
    return G.simple_paths(edges, ends).select("entry", "sink", F.array_join("path", ">").alias("path"))


@query(
    "G13_backtrack",
    f"WITH RECURSIVE {TURNS_SQL}, c AS (SELECT sink, [sink] AS path FROM ends UNION ALL SELECT sink, list_prepend(src, path) FROM c JOIN edges ON dst = path[1] WHERE NOT list_contains(path, src) AND len(path) <= 8) "
    "SELECT sink, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY len(path) DESC, path) AS r FROM c WHERE len(path) > 1) WHERE r = 1",
)
def backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, ends = turn_edges(spark, sf_dir)
    return G.backtrack(edges, ends.select(F.col("sink").alias("node"))).select("sink", F.array_join("path", ">").alias("path"))


@query(
    "G1_degrees",
    f"WITH {EDGES_SQL} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1",
)
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(trade_edges(spark, sf_dir))


@query(
    "G1_summary",
    f"WITH {EDGES_SQL}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM n WHERE node IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 25)) AS signalled FROM n",
)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = table(spark, sf_dir, "part").filter("p_size > 25").select(_key("P", "p_partkey").alias("node"))
    return G.summary(trade_edges(spark, sf_dir), signals)


@query(
    "G12_noise_filtered_graph",
    f"WITH {EDGES_SQL} SELECT dst AS src, src AS dst FROM edges WHERE NOT regexp_matches(src, '1[0-9]$') AND NOT regexp_matches(dst, '1[0-9]$')",
)
def noise_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.without(trade_edges(spark, sf_dir), "1[0-9]$").select(F.col("dst").alias("src"), F.col("src").alias("dst"))


_TOP = (
    f"WITH RECURSIVE {TAGS_SQL}, {_rank_sql('multi', _PERSONAL)}, edges AS (SELECT DISTINCT src, dst FROM multi), {_REACH}, "
    "ap AS (SELECT node, 500.0 * count(*) AS score FROM (SELECT * FROM hit UNION ALL SELECT entry FROM pr UNION ALL SELECT sink FROM pr) GROUP BY 1), "
    f"f AS (SELECT node, 0.3 * rank + 0.7 * coalesce(score, 0) AS final FROM r{ITERATIONS} LEFT JOIN ap USING (node)), "
    "n AS (SELECT *, row_number() OVER (ORDER BY final) - 1 AS i, count(*) OVER () AS n FROM f), "
    "q AS (SELECT max(CASE WHEN i = CAST(floor((n - 1) * 80 / 100) AS BIGINT) THEN final END) AS p80, max(CASE WHEN i = CAST(floor((n - 1) * 40 / 100) AS BIGINT) THEN final END) AS p40 FROM n) "
    "SELECT node, round(final, 6) AS final, CASE WHEN final >= p80 THEN 'hot' WHEN final >= p40 THEN 'warm' ELSE 'cold' END AS tier FROM f, q ORDER BY final DESC, node LIMIT 15"
)


@query("director_top_targets", _TOP)
def top_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference graph, personalised PageRank, attack paths, .3 / .7 score, percentile tiers, the top 15."""
    from quern.operators.ranking import tiers

    parts = [materialise(x, "reference-parts") for x in G.reference_parts(*tags(spark, sf_dir))]
    ranks, _ = G.reference_pagerank(*parts, nodes_of(spark, ENTRIES).withColumn("weight", F.lit(40.0)), ITERATIONS)
    paths = G.reference_attack_scores(*parts, nodes_of(spark, ENTRIES), nodes_of(spark, SINKS), True)
    final = materialise(ranks.join(paths, "node", "left").select("node", (0.3 * F.col("rank") + 0.7 * F.coalesce("score", F.lit(0.0))).alias("final")), "final-scores")
    return tiers(final, "final").orderBy(F.desc("final"), "node").limit(15).select("node", F.round("final", 6).alias("final"), "tier")
