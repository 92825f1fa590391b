"""Queries of scalar functions and classifiers, over names, snippets and paths dealt to all rows of `events`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import classify as C
from quern.functions import scalars as S
from quern.functions import tables as T
from quern.registry import query, table

NAMES = ["exec", "os.system", "my.os.system", "re.compile", "compile", "x.compile", "Execute_Command", "safe_eval", "read_file", "fetch", "native_query", "get", "handle_click", "on_load", "Page_handler", "user_route", "main", "Main", "run", "print", "Logger.Info", "log.trace", "console.log", "logs.info", "sys.argv[1]", "input(...)", "request.args.get", "conn.execute", "cursor.executemany", "sqlite3.execute", "db.eval", "pickle.loads", "yaml.load", "html.escape", "x.shlex.quote", "innerHTML", "Runtime.exec", "plain_name", "openfile", "pathlib.Path.open", "myshelve", "Subprocess.call", "a.b.c"]
SNIPPETS = [
    "p = os.path.join(a, b)",
    "with open(path) as f: f.read()",
    "zipfile.ZipFile(x).extractall(d)",
    "re.compile(p)",
    "compile(src, '<s>', 'exec')",
    "eval (x)",
    "subprocess.run(cmd, shell=True)",
    "cloudpickle.loads(b)",
    "cur.execute(q)",
    "requests.get(url)",
    "if depth > 10: return",
    "if depth >= MAX_DEPTH: raise",
    "while stack: stack.pop()",
    "except RecursionError: pass",
    "if x is None: return",
    "name = html.escape(user)",
    "@login_required",
    "if user.is_admin: pass",
    "for n in z.namelist(): self.root.open(n)",
    "q = request.query; Path(q).joinpath(n)",
    "p.resolve().parent.read_text ()",
    "objects.filter (id=1)",
    "yaml.load(x)",
    "shutil.copy(a, b)",
    "urlopen(u)",
    "[attr bridge: self.root stored by __init__ → read by open_entry]",
    "return a + b",
    "",
]
PATHS = ["src/auth/login_handler.py", "a/b/c/d.py", "README.md", "web/api/UserController.java", "static/x.min.js", "pkg/vendor/lib.js", "docs/notes.txt", "test_app.py", "app/tests/t.py", "conf/application-dev.yml", "pom.xml", "x.css", "a/gen/y.go", "node_modules/z/index.js", "deep/er/still/more/query.sql", "plain.c", "mocks/a.rb", "src\\win\\p.py"]
ROUTES = ["/api/Product/${id}/", "user/:id", "/a/{id}", " /X/Y ", "/", "list", "/p/${a}/q/:b"]
SIGNATURES = ["def f(self, a, b=1, *args, c: int = 2, **kw)", "def g()", "function h(x, y)", "def k(cls, only)"]


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], column: str = "event_id") -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(column), F.lit(len(values))).cast("int"))


def sql_pick(values: list[str]) -> str:
    return f"{sql_list(values)}[1 + event_id % {len(values)}]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_case(rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


def sql_named(value: str, column: str = "x") -> str:
    return f"({column} = {sql_text(value)} OR ends_with({column}, {sql_text('.' + value)}))"


def sql_match(pattern: str, column: str = "x") -> str:
    pattern = pattern.replace("(?!s)", "([^s]|$)")  # RE2 has no lookahead
    return f"regexp_matches({column}, {sql_text(pattern)})"


def sql_any(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def _map(name: str, values: list[str], columns: dict[str, tuple[Callable[[Column], Column], str]]) -> None:
    """Register a query of event_id, x (the value dealt to the event) and ``columns`` of x: (function of x, SQL of x).

    Columns are made when the query runs, so importing this module needs no session.
    """
    sql = f"SELECT event_id, x, {', '.join(f'{s} AS {c}' for c, (_, s) in columns.items())} FROM (SELECT event_id, {sql_pick(values)} AS x FROM events)"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dealt = table(spark, sf_dir, "events").select("event_id", pick(values).alias("x"))
        return dealt.select("event_id", "x", *[column(F.col("x")).alias(c) for c, (column, _) in columns.items()])


_map(
    "F1_classify_sink",
    NAMES,
    {"kind": (lambda x: C.classify_sink(x), sql_case([(sql_named(p), sql_text(k)) for p, k in T.EXACT_SINKS] + [(sql_match("(?i)" + p), sql_text(k)) for p, k in T.SINK_REGEX]))},
)
_map("F2_sensitive_body", SNIPPETS, {"kind": (lambda x: C.classify_body(x), sql_case([(sql_match(p), sql_text(k)) for p, k in T.SENSITIVE_CALLS]))})
_map("F3_entry_point", NAMES, {"is_entry": (lambda x: C.is_entry_point(x), sql_any([sql_match(p) for p in T.ENTRY_POINTS]))})
_map("F4_taint_source", NAMES, {"source": (lambda x: C.source_of(x), sql_case([(f"starts_with(x, {sql_text(s)})", sql_text(s)) for s in T.PYTHON_SOURCES]))})
_map(
    "F5_taint_sink",
    NAMES,
    {
        "sink": (lambda x: C.sink_of(x), sql_case([(f"x = {sql_text(s)}" if "." in s else sql_named(s), sql_text(s)) for s in T.PYTHON_SINKS])),
        "severity": (lambda x: C.first_of([(C.sink_of(x) == s, v) for s, v in T.PYTHON_SINKS.items()]), sql_case([(f"x = {sql_text(s)}" if "." in s else sql_named(s), sql_text(v)) for s, v in T.PYTHON_SINKS.items()])),
    },
)
_map("F6_sanitizer", NAMES, {"sanitizes": (lambda x: C.is_sanitizer(x), sql_any([sql_named(s) for s in T.PYTHON_SANITIZERS]))})
_map(
    "F8_noise_call",
    NAMES,
    {"noise": (lambda x: C.is_noise_call(x), f"(lower(trim(x)) IN ({', '.join(map(sql_text, T.NOISE_CALLS))}) OR regexp_matches(lower(trim(x)), '^(log|logger|logging)\\.({'|'.join(T.LOG_LEVELS)})$'))")},
)
_map(
    "F9_sanitizer_and_auth_terms",
    SNIPPETS,
    {
        "sanitized": (lambda x: C.has_term(x, T.SANITIZER_TERMS), sql_any([f"contains(lower(x), {sql_text(t)})" for t in T.SANITIZER_TERMS])),
        "gated": (lambda x: C.has_term(x, T.AUTH_TERMS), sql_any([f"contains(lower(x), {sql_text(t)})" for t in T.AUTH_TERMS])),
    },
)
_map("F10_excluded_dir", PATHS, {"excluded": (lambda x: x.rlike(T.EXCLUDED_DIR), sql_match(T.EXCLUDED_DIR))})
_map("F11_validation_name", NAMES + ["sanitize_input", "is_safe_path"], {"validates": (lambda x: x.rlike(T.VALIDATION), sql_match(T.VALIDATION))})
_map("F12_depth_guard", SNIPPETS, {"guarded": (lambda x: C.has_depth_guard(x), sql_any([sql_match(p) for p in T.DEPTH_GUARDS]))})
_map(
    "F13_recursive_call",
    ["def|f|return f (n - 1)", "def|g|return h(n)", "def|walk|self.walk(x)", "def|a.b|a.b(1)", "def|run|prerun(1)"],
    {"recursive": (lambda x: F.expr(r"regexp_like(split_part(x, '|', 3), concat('\\b', regexp_replace(split_part(x, '|', 2), '([.])', '\\\\$1'), '\\s*\\('))"), r"regexp_matches(split_part(x, '|', 3), '\b' || regexp_replace(split_part(x, '|', 2), '([.])', '\\\1', 'g') || '\s*\(')")},
)
_map(
    "F16_sink_type",
    NAMES,
    {"kind": (lambda x: C.sink_type(x), sql_case([(f"x = {sql_text(k)}", sql_text(v)) for k, v in T.SINK_TYPES.items()] + [(sql_any([f"contains(lower(x), {sql_text(p)})" for p in parts]), sql_text(k)) for parts, k in T.SINK_TYPE_PARTS], "'sink'"))},
)
_map("F17_rule_id", NAMES, {"rule_id": (lambda x: C.rule_id(x), sql_case([(f"x = {sql_text(k)}", sql_text(v)) for k, v in T.RULE_IDS.items()], "'taint-to-' || replace(x, '.', '-')"))})
_hits = "list_filter([" + ", ".join(f"CASE WHEN {sql_match(p)} THEN {sql_text(k)} END" for p, k in T.BRIDGE_SINKS) + "], lambda e: e IS NOT NULL)"
_map(
    "F19_bridge_evidence",
    SNIPPETS,
    {
        "external": (lambda x: C.bridge_evidence(x, x)["storer_external_source"], sql_any([sql_match(p) for p in T.STORER_SOURCES])),
        "dangerous": (lambda x: C.bridge_evidence(x, x)["reader_dangerous_sink"], f"len({_hits}) > 0"),
        "sink_type": (lambda x: C.bridge_evidence(x, x)["sink_type"], f"coalesce(({_hits})[-1], 'unknown')"),
    },
)
_map(
    "F20_path_bridge",
    SNIPPETS,
    {"kind": (lambda x: C.path_bridge(x), f"CASE WHEN {sql_any([sql_match(p) for p in T.PATH_BUILDERS])} THEN {sql_case([(sql_match(p), sql_text(k)) for p, k in T.PATH_CONSUMERS])} END")},
)
_map("F21_bridge_note", SNIPPETS, {c: (lambda x, i=i: F.regexp_extract(x, T.BRIDGE_NOTE, i), f"regexp_extract(x, {sql_text(T.BRIDGE_NOTE)}, {i})") for i, c in enumerate(("attr", "storer", "reader"), 1)})
_sql_high = "list_filter([" + ", ".join(f"CASE WHEN {sql_match(C.glob_regex(g))} THEN {sql_text('matches ' + g)} END" for g in T.HIGH_GLOBS) + "], lambda e: e IS NOT NULL)"
_map(
    "F25_file_score",
    PATHS,
    {
        "score": (
            lambda x: C.file_score(x, x)[0],
            f"least(CASE WHEN {sql_any([sql_match(C.glob_regex(g)) for g in T.LOW_GLOBS])} THEN greatest(least(20 * len({_sql_high}), 80) - 30, 0) ELSE least(20 * len({_sql_high}), 80) END"
            f" + CASE WHEN length(x) - length(replace(x, '/', '')) >= 3 THEN 5 ELSE 0 END + CASE WHEN {sql_any([f'ends_with(x, {sql_text(e)})' for e in T.CODE_EXTENSIONS])} THEN 10 ELSE 0 END, 100)",
        ),
        "reasons": (lambda x: C.file_score(x, x)[1], f"CASE WHEN len({_sql_high}) = 0 THEN 'heuristic match' ELSE array_to_string(({_sql_high})[1:3], '; ') END"),
    },
)
_map(
    "S3_noise_file",
    PATHS,
    {
        "noise": (
            lambda x: C.is_noise_file(x, F.length(x) * 20_000, F.repeat(x, 9)),
            f"({sql_any([f'ends_with(x, {sql_text(n)})' for n in T.NOISE_NAMES] + [f'''contains(replace(x, '{chr(92)}', '/'), {sql_text(d)})''' for d in T.NOISE_DIRS])} OR length(x) * 20000 > 524288 OR length(repeat(x, 9)) > 200)",
        )
    },
)
_map(
    "X1_X2_X3_routes",
    ROUTES,
    {
        "joined": (lambda x: S.join_paths(F.lit("/api/"), x), "CASE WHEN trim(x, '/') = '' THEN '/api' WHEN starts_with(trim(x, '/'), 'api') THEN '/' || trim(x, '/') ELSE '/api/' || trim(x, '/') END"),
        "normal": (lambda x: S.normalize_route(x), "CASE WHEN starts_with(regexp_replace(trim(lower(x)), '/$', ''), '/') THEN regexp_replace(trim(lower(x)), '/$', '') ELSE '/' || regexp_replace(trim(lower(x)), '/$', '') END"),
        "resolved": (lambda x: S.resolve_params(x), r"regexp_replace(regexp_replace(x, '\$\{[^}]+\}', '{param}', 'g'), ':\w+', '{param}', 'g')"),
    },
)
_map("X5_node_id", [f"{p}::{n}" for p, n in zip(PATHS, NAMES, strict=False)], {"file": (lambda x: S.node_parts(x)[0], "regexp_replace(x, '::[^:]*$', '')"), "function": (lambda x: S.node_parts(x)[1], "regexp_extract(x, '[^:]*$')")})
_map(
    "X6_parameter_names",
    SIGNATURES,
    {"names": (lambda x: F.array_join(S.parameter_names(x), ","), "array_to_string(list_filter(list_transform(string_split(regexp_extract(x, '\\(([^)]*)\\)', 1), ','), lambda p: trim(regexp_replace(trim(p), '[:=].*$', ''))), lambda n: n <> '' AND n NOT IN ('self', 'cls') AND NOT starts_with(n, '*')), ',')")},
)
_map("X13_top_module", PATHS, {"module": (lambda x: S.top_module(x), f"split_part(replace(x, '{chr(92)}', '/'), '/', 1)")})
_map("D2_vuln_type", ["SQLi", " xss ", "stored_xss", "Auth", "csrf", "other", "session_fixation"], {"kind": (lambda x: C.normalise_vuln_type(x), sql_case([(f"trim(lower(x)) = {sql_text(k)}", sql_text(v)) for k, v in T.VULN_ALIASES.items()], "trim(lower(x))"))})
_sql_sev = sql_case([(f"trim(lower(x)) = {sql_text(s)}", sql_text(s)) for s in T.SEVERITY_MULTIPLIERS] + [("trim(lower(x)) IN ('crit', 'c')", "'critical'"), ("trim(lower(x)) = 'h'", "'high'"), ("trim(lower(x)) IN ('med', 'm')", "'medium'"), ("trim(lower(x)) = 'l'", "'low'")], "'info'")
_map("X8_severity", ["Critical", "crit", "H", " medium", "m", "low", "none", "info"], {"severity": (S.severity_of, _sql_sev), "rank": (lambda x: C.first_of([(S.severity_of(x) == s, 5 - v) for s, v in T.SEVERITY_SCORE.items()]), sql_case([(f"({_sql_sev}) = {sql_text(s)}", str(5 - v)) for s, v in T.SEVERITY_SCORE.items()]))})


@query(
    "F15_body_scan",
    f"WITH b AS (SELECT event_id, {sql_pick(SNIPPETS)} || chr(10) || 'eval(' || event_type || ')' || chr(10) || {sql_pick(SNIPPETS[3:])} AS body FROM events), p AS (SELECT * FROM (VALUES {', '.join(f'({sql_text(a)}, {sql_text(b)}, {sql_text(c)})' for a, b, c in T.BODY_SINKS)}) v(pat, sink, kind)) "
    "SELECT event_id, sink, kind, CASE WHEN kind IN ('deserialization', 'rce', 'command_injection') THEN 'high' ELSE 'medium' END AS severity, 10 + len(string_split(split_part(body, pat, 1), chr(10))) - 1 AS line FROM b JOIN p ON contains(body, pat)",
)
def body_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sink pattern in a body, with the line of its first match; the patterns are constants in the plan."""
    body = F.concat(pick(SNIPPETS), F.lit("\neval("), F.col("event_type"), F.lit(")\n"), pick(SNIPPETS[3:]))
    hits = F.array(*[F.when(F.col("body").contains(p), F.struct(F.lit(s).alias("sink"), F.lit(k).alias("kind"), (F.size(F.split(F.substring_index("body", p, 1), "\n")) + 9).alias("line"))) for p, s, k in T.BODY_SINKS])
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("body")).select("event_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    high = F.col("h.kind").isin("deserialization", "rce", "command_injection")
    return rows.select("event_id", "h.sink", "h.kind", F.when(high, "high").otherwise("medium").alias("severity"), "h.line")


@query(
    "F18_evidence",
    f"WITH b AS (SELECT event_id, string_split({sql_pick(SNIPPETS)} || chr(10) || {sql_pick(SNIPPETS[5:])}, chr(10)) AS lines FROM events), l AS (SELECT event_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS line FROM b), "
    + "h AS ("
    + " UNION ALL ".join(f"SELECT event_id, line, x, {sql_text(k)} AS kind, {sql_text(p[:60])} AS pattern FROM l WHERE {sql_match(p)}" for k, ps in T.EVIDENCE.items() for p in ps)
    + ") SELECT event_id, line, kind, pattern, substr(trim(x), 1, 120) AS snippet FROM h",
)
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line and evidence pattern that matches it."""
    block = F.concat(pick(SNIPPETS), F.lit("\n"), pick(SNIPPETS[5:]))
    lines = table(spark, sf_dir, "events").select("event_id", F.posexplode(F.split(block, "\n")).alias("pos", "x"))
    hits = F.array(*[F.when(F.col("x").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(p[:60]).alias("pattern"))) for k, ps in T.EVIDENCE.items() for p in ps])
    rows = lines.select("event_id", (F.col("pos") + 1).alias("line"), "x", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return rows.select("event_id", "line", "h.kind", "h.pattern", F.substring(F.trim("x"), 1, 120).alias("snippet"))


@query(
    "X7_signal_confidence",
    "SELECT user_id, round(count(*) * 0 + CASE WHEN count(*) >= 5 THEN 80 * 1.0 WHEN count(*) >= 2 THEN 80 * 0.7 ELSE 80 * 0.3 END, 6) AS confidence FROM events WHERE event_type = 'error' GROUP BY 1",
)
def signal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.select("user_id", F.round(S.signal_confidence(F.col("n"), F.lit(80.0)), 6).alias("confidence"))


_rating = "CASE WHEN adjusted >= 0.9 THEN 'critical' WHEN adjusted >= 0.7 THEN 'high' WHEN adjusted >= 0.4 THEN 'medium' WHEN adjusted >= 0.1 THEN 'low' ELSE 'none' END"


@query(
    "X10_exploitability",
    f"WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS score, ['critical','high','medium','low','info'][1 + l_partkey % 5] AS severity, l_returnflag = 'R' AS blocked FROM lineitem), a AS (SELECT *, round_even(score * CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.4 ELSE 0.1 END, 2) AS adjusted FROM s) "
    f"SELECT l_orderkey, l_linenumber, severity, {_rating} AS rating, CASE WHEN NOT blocked THEN 'not controllable' WHEN adjusted >= 0.7 THEN 'high' WHEN adjusted >= 0.4 THEN 'medium' WHEN adjusted >= 0.1 THEN 'low' ELSE 'none' END AS advice FROM a",
)
def exploitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("score"), pick(list(T.SEVERITY_MULTIPLIERS), "l_partkey").alias("severity"), (F.col("l_returnflag") == "R").alias("blocked"))
    adjusted, rating = S.exploitability(F.col("score"), F.col("severity"))
    return rows.select("l_orderkey", "l_linenumber", "severity", rating.alias("rating"), S.recommendation(adjusted, F.col("blocked")).alias("advice"))


@query(
    "D3_body_hash",
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(substr(text, 1, 200), '(?m)#.*$', '', 'g'), '\s+', '', 'g')) AS key FROM documents",
)
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.body_hash(F.col("text")).alias("key"))
