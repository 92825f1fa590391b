"""Queries of source operators on code files that are dealt to the rows of `part`: file k has the text of number p_partkey % n."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import classify as C
from quern.functions import tables as T
from quern.operators import project as P
from quern.operators import taint
from quern.operators import validators as V
from quern.registry import query, table
from quern.sources import files as S
from quern.sources import braces, python_code, routes, syntax

from .classifiers import sql_case, sql_text

PYTHON = [
    "import pickle\n\ndef read(path):\n    data = pickle.loads(open(path).read())\n    return eval(data)\n",
    "import subprocess\nfrom flask import request\n\n@app.route('/run')\ndef run():\n    subprocess.run(request.args['c'], shell=True)\n\ndef again(n):\n    return again(n - 1)\n",
    "def broken(:\n",
    "import pytest\n\ndef test_add():\n    assert isinstance(1, int)\n",
    "class Job(Base):\n    def login(self, cursor):\n        cursor.execute('select 1')\n        yaml.load(self.text)\n\nserver.run()\n",
]
RULES = [
    {"id": "eval-exec", "name": "Dynamic code", "severity": "critical", "query": "(call function: (identifier) @match arguments: (argument_list) @args)", "capture_group": "match", "match_any": ["eval", "exec"]},
    {"id": "loads", "name": "Unsafe loading", "severity": "high", "query": "(call function: (attribute object: (identifier) @module attribute: (identifier) @match))", "capture_group": "match", "match_any": ["loads", "load"]},
    {"id": "shell", "name": "Shell", "severity": "high", "query": '(call function: (attribute attribute: (identifier) @func) arguments: (argument_list (keyword_argument name: (identifier) @kw (#eq? @kw "shell") value: (true))))', "capture_group": "func", "match_any": None},
    {"id": "broken", "name": "Not a query", "severity": "low", "query": "(call function: ", "capture_group": "match", "match_any": None},
]
JAVA = [
    '@RestController\n@RequestMapping("/api/")\npublic class UserController {\n\n    // no auth needed\n    @Deprecated\n    @GetMapping("/users/{id}")\n    public User get(long id) { return null; }\n\n    @PreAuthorize("admin")\n    @PostMapping("/users")\n    public void add(User u) {}\n\n    // @PutMapping("/off")\n}\n',
    "public class Plain { }\n",
    "@Controller\nclass Pages {\n  @RequestMapping('/home')\n  fun home(): String = x\n}\n",
]
SCRIPT = ["export function getUser(id) {\n  return request({ url: `/users/${row.id}`, method: 'get' })\n}\nconst save = async () => {\n  axios.post('/users')\n}\n", "let a = 1\n"]


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else sql_text(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


def _files(spark: SparkSession, sf_dir: str, texts: list[str], ending: str, folder: str = "src") -> DataFrame:
    source = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts)).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit(folder + "/f"), "p_partkey", F.lit(ending)).alias("path"), source.alias("source"), F.length(source).cast("long").alias("size"), "p_partkey")


_HITS = [(0, "eval-exec", 5, 11, "eval"), (0, "loads", 4, 18, "loads"), (1, "shell", 6, 15, "run"), (4, "loads", 4, 13, "load")]


@query("F30_rule_matches", f"SELECT 'src/f' || p_partkey || '.py' AS file, rule_id, line, col AS \"column\", matched FROM part JOIN {_values(_HITS, 'k, rule_id, line, col, matched')} ON p_partkey % {len(PYTHON)} = k")
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.match_rules(_files(spark, sf_dir, PYTHON, ".py"), RULES).select("file", "rule_id", "line", "column", "matched")


@query("V8_rule_hits", f"SELECT 'src/f' || p_partkey || '.py' AS path, count(rule_id) AS hits FROM part LEFT JOIN {_values(_HITS, 'k, rule_id, line, col, matched')} ON p_partkey % {len(PYTHON)} = k GROUP BY p_partkey")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule hits of each file, those without any included."""
    files = _files(spark, sf_dir, PYTHON, ".py")
    hits = syntax.match_rules(files, RULES).groupBy("file").agg(F.count(F.lit(1)).alias("hits"))
    return files.select("path").join(hits, F.col("path") == F.col("file"), "left").select("path", F.coalesce("hits", F.lit(0)).alias("hits"))


_TAGGED = [
    (0, "pickle", "ref", 0, ""), (0, "read", "def", 2, ""), (0, "loads", "ref", 3, ""), (0, "open", "ref", 3, ""), (0, "eval", "ref", 4, ""), (0, "pickle.loads(open(path).read())", "signal", 3, "serialization"),
    (0, "open(path)", "signal", 3, "file_io"), (0, "eval(data)", "signal", 4, "dynamic_exec"),
    (1, "subprocess", "ref", 0, ""), (1, "request", "ref", 1, ""), (1, "run", "def", 4, ""), (1, "run", "ref", 5, ""), (1, "again", "def", 7, ""), (1, "again", "ref", 8, ""), (1, "route", "ref", 3, ""),
    (1, "subprocess.run(request.args['c'], shell=True)", "signal", 5, "cmd_exec"), (1, "again", "signal", 0, "recursion"),
    (3, "pytest", "ref", 0, ""), (3, "test_add", "def", 2, ""), (3, "isinstance", "ref", 3, ""),
    (4, "Job", "def", 0, ""), (4, "login", "def", 1, ""), (4, "execute", "ref", 2, ""), (4, "load", "ref", 3, ""), (4, "run", "ref", 5, ""), (4, "cursor.execute('select 1')", "signal", 2, "sql_sink"), (4, "yaml.load(self.text)", "signal", 3, "serialization"),
    (4, "def login(self, cursor):\n        cursor.execute('select 1')\n        yaml.load(self.text)", "signal", 1, "auth_check"),
]


@query("F31_tags", f"SELECT 'src/f' || p_partkey || '.py' AS file, name, kind, line, signal FROM part JOIN {_values(_TAGGED, 'k, name, kind, line, signal')} ON p_partkey % {len(PYTHON)} = k")
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.extract_tags(_files(spark, sf_dir, PYTHON, ".py"))


_KINDS = [(0, False, False), (1, False, False), (2, False, False), (3, True, False), (4, False, True)]


@query(
    "F26_code_kinds",
    f"SELECT path, test OR p_partkey % 3 = 0 AS is_test, p_partkey % 3 = 1 AS is_compiler, start AS is_startup, NOT (test OR p_partkey % 3 = 0 OR p_partkey % 3 = 1) AS is_production FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'a/tests/f' WHEN 1 THEN 'a/migrations/f' ELSE 'a/b/f' END || p_partkey || '.py' AS path FROM part) JOIN {_values(_KINDS, 'k, test, start')} ON p_partkey % {len(PYTHON)} = k",
)
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("p_partkey") % 3 == 0, "a/tests/f").when(F.col("p_partkey") % 3 == 1, "a/migrations/f").otherwise("a/b/f")
    files = _files(spark, sf_dir, PYTHON, ".py").withColumn("path", F.concat(folder, "p_partkey", F.lit(".py")))
    return V.code_kinds(files)


#: For each file number, (validator, priority, passed) of the findings below.
_CHECKS = [
    (0, "execution_context", "P0", True), (0, "trust_boundary", "P0", True), (0, "external_reachability", "P0", False), (0, "validation_chain", "P1", False), (0, "thread_model", "P1", True), (0, "semantic_pattern", "P1", True),
    (1, "execution_context", "P0", True), (1, "trust_boundary", "P0", True), (1, "external_reachability", "P0", True), (1, "validation_chain", "P1", False), (1, "thread_model", "P1", False), (1, "semantic_pattern", "P1", False),
    (2, "execution_context", "P0", True), (2, "trust_boundary", "P0", False), (2, "external_reachability", "P0", False), (2, "validation_chain", "P1", True), (2, "thread_model", "P1", True), (2, "semantic_pattern", "P1", True),
    (3, "execution_context", "P0", False), (3, "trust_boundary", "P0", True), (3, "external_reachability", "P0", True), (3, "validation_chain", "P1", True), (3, "thread_model", "P1", True), (3, "semantic_pattern", "P1", True),
    (4, "execution_context", "P1", False), (4, "trust_boundary", "P0", False), (4, "external_reachability", "P0", True), (4, "validation_chain", "P1", False), (4, "thread_model", "P1", True), (4, "semantic_pattern", "P1", True),
]
#: rule_id, source_rule_name, source_info, detail, description, taint_source, taint_sink, chain, line of the finding in file k.
_FINDINGS = [
    ("taint-to-code-injection", "sys.argv", None, None, "eval of data", None, None, 0, 5),
    ("sql-injection", None, None, "an admin clicks", "nothing fits here", None, None, 0, 6),
    ("own-rule", "", "", "", "escape is called", "", "", 0, 1),
    ("python-xss", None, None, None, "Unauthenticated user writes HTML", "x", "y", None, 4),
    ("reflective-path-traversal", None, None, None, "a file is read", None, None, 2, 6),
]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each file."""
    fields = "rule_id, source_rule_name, source_info, detail, description, taint_source, taint_sink, chain, line_number".split(", ")
    kinds = ["string"] * 7 + ["int", "int"]
    chosen = lambda i: F.get(F.array(*[F.lit(f[i]).cast(kinds[i]) for f in _FINDINGS]), (F.col("p_partkey") % len(PYTHON)).cast("int"))
    return _files(spark, sf_dir, PYTHON, ".py").select(F.col("p_partkey").alias("id"), F.col("path").alias("file_path"), *[chosen(i).alias(n) for i, n in enumerate(fields)])


@query("V6_validators", f"SELECT p_partkey AS id, validator, priority, passed FROM part JOIN {_values(_CHECKS, 'k, validator, priority, passed')} ON p_partkey % {len(PYTHON)} = k")
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each finding and validator."""
    return V.verdicts(findings(spark, sf_dir), _files(spark, sf_dir, PYTHON, ".py")).select("id", "validator", "priority", "passed")


@query(
    "V6_exploitability",
    f"SELECT id, bool_and(priority = 'P1' OR passed) AS is_controlled, round(CASE WHEN bool_and(priority = 'P1' OR passed) THEN 0.6 ELSE 0 END + 0.4 * count(*) FILTER (priority = 'P1' AND passed) / greatest(count(*) FILTER (priority = 'P1'), 1), 2) AS score FROM (SELECT p_partkey AS id, validator, priority, passed FROM part JOIN {_values(_CHECKS, 'k, validator, priority, passed')} ON p_partkey % {len(PYTHON)} = k) GROUP BY id",
)
def exploitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.exploitability(V.verdicts(findings(spark, sf_dir), _files(spark, sf_dir, PYTHON, ".py")), ["id"])


_ENDPOINTS = [(0, 2, "GET", "/api", "UserController", "get", False, False, False), (0, 7, "GET", "/api/users/{id}", "UserController", "get", False, True, True), (0, 11, "POST", "/api/users", "UserController", "add", True, False, True), (2, 3, "GET", "/home", "Pages", "home", False, False, False)]


@query("X4_endpoints", f"SELECT 'src/f' || p_partkey || '.java' AS file, line, http_method, path, class, method, pre_authorize, deprecated, says_public FROM part JOIN {_values(_ENDPOINTS, 'k, line, http_method, path, class, method, pre_authorize, deprecated, says_public')} ON p_partkey % {len(JAVA)} = k")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.controllers(_files(spark, sf_dir, JAVA, ".java"))


@query("X4_frontend_calls", f"SELECT 'web/api/f' || p_partkey || '.js' AS file, line, function, url, resolved FROM part JOIN {_values([(0, 2, 'getUser', '/users/${row.id}', '/users/:id'), (0, 5, 'save', '/users', '/users')], 'k, line, function, url, resolved')} ON p_partkey % {len(SCRIPT)} = k")
def frontend_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.frontend_calls(_files(spark, sf_dir, SCRIPT, ".js", "web/api"))


@query("S2_index", f"SELECT 'src/f' || p_partkey || '.py' AS path, p_partkey % {len(PYTHON)} IN (0, 1) OR p_size > 25 AS \"full\" FROM part")
def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").filter("p_size > 25").select(F.concat(F.lit("./src/f"), "p_partkey", F.lit(".py")).alias("path"))
    return S.build_index(_files(spark, sf_dir, PYTHON, ".py"), wanted).select("path", "full")


@query(
    "G5_personalisation",
    "WITH f AS (SELECT *, 'src/f' || p_partkey || '.py' AS node, 100.0 / count(*) OVER () AS base FROM part), w AS (SELECT node, base * (CASE WHEN p_size > 40 THEN 10 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size < 5 THEN 100 ELSE 0 END + CASE WHEN p_partkey IN (7, 8) THEN 1 ELSE 0 END) AS weight FROM f) SELECT node, round(weight, 6) AS weight FROM w WHERE weight > 0",
)
def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir, PYTHON, ".py").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    found = syntax.personalisation(files, files.filter("p_size > 40"), files.filter("p_size < 5"), files.filter("p_size % 2 = 0"), ["f7", "f8.py"])
    return found.select("node", F.round("weight", 6).alias("weight"))


_CALLS = ["Runtime.getRuntime().exec", "exec", "x.Runtime.exec", "el.innerHTML", "document.write", "my.document.write", "Function", "log.info", "a.log.info", "Files.readAllBytes"]


def _matched(sinks: dict[str, str]) -> str:
    return sql_case([(f"x = {sql_text(s)}" + ("" if "." in s else f" OR ends_with(x, {sql_text('.' + s)})"), sql_text(s)) for s in sinks])


@query("F7_java_js_sinks", f"WITH c AS (SELECT event_id, {'[' + ', '.join(map(sql_text, _CALLS)) + ']'}[1 + event_id % {len(_CALLS)}] AS x FROM events) SELECT event_id, {_matched(T.JAVA_SINKS)} AS java, {_matched(T.JS_SINKS)} AS js FROM c")
def java_js_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.get(F.array(*[F.lit(c) for c in _CALLS]), (F.col("event_id") % len(_CALLS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", C.sink_of(call, T.JAVA_SINKS).alias("java"), C.sink_of(call, T.JS_SINKS).alias("js"))


_EXTENSIONS = ["py", "java", "ts", "go", "toml", "PY"]
_PROJECT_SQL = f"pf AS (SELECT p_partkey, p_brand AS project, p_brand || CASE p_partkey % 3 WHEN 0 THEN '/tests/' ELSE '/src/' END || CASE WHEN p_partkey % 97 = 5 THEN 'Main' || '.py' WHEN p_partkey % 89 = 7 THEN 'd' || p_partkey || '/pyproject.toml' ELSE 'f' || p_partkey || '.' || {'[' + ', '.join(map(sql_text, _EXTENSIONS)) + ']'}[1 + p_size % {len(_EXTENSIONS)}] END AS path FROM part)"


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, source, p_partkey): a project for each brand."""
    ending = F.get(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("p_size") % len(_EXTENSIONS)).cast("int"))
    name = F.when(F.col("p_partkey") % 97 == 5, F.lit("Main.py")).when(F.col("p_partkey") % 89 == 7, F.concat(F.lit("d"), "p_partkey", F.lit("/pyproject.toml"))).otherwise(F.concat(F.lit("f"), "p_partkey", F.lit("."), ending))
    source = F.get(F.array(*[F.lit(t) for t in PYTHON]), (F.col("p_partkey") % len(PYTHON)).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, "/tests/").otherwise("/src/"), name).alias("path"), source.alias("source"), "p_partkey")


_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1))"
_LANGUAGES = {e: language for language, endings in P.LANGUAGE_EXTENSIONS.items() for e in endings}
_LANGUAGE_SQL = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(map(sql_text, endings))}) THEN {sql_text(language)}" for language, endings in P.LANGUAGE_EXTENSIONS.items()) + " END"


@query(
    "S4_S5_context",
    f"WITH {_PROJECT_SQL}, l AS (SELECT *, {_LANGUAGE_SQL} AS language FROM pf) SELECT project, count(*) AS files, count(language) AS supported, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages, coalesce(array_to_string(list_sort(list_distinct(list(path) FILTER (ends_with(path, '/pyproject.toml')))), ','), '') AS manifests FROM l GROUP BY 1",
)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.context(project_files(spark, sf_dir), _LANGUAGES)
    return found.select("project", "files", "supported", F.array_join("languages", ",").alias("languages"), F.array_join("manifests", ",").alias("manifests"))


@query("F23_main_language", f"WITH {_PROJECT_SQL}, l AS (SELECT project, {_LANGUAGE_SQL} AS language, count(*) AS n, min(path) AS first FROM pf GROUP BY 1, 2) SELECT project, arg_min(language, row(-n, first)) AS language FROM l WHERE language IS NOT NULL GROUP BY 1")
def main_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.main_language(project_files(spark, sf_dir))


@query(
    "F22_project_type",
    f"WITH {_PROJECT_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) AS r FROM (SELECT DISTINCT project, path FROM pf WHERE ends_with(path, '.py') AND NOT contains(path, '/tests/'))) "
    f"SELECT project, CASE WHEN bool_or(web) THEN 'app' ELSE 'lib' END AS kind FROM (SELECT project, false AS web FROM pf UNION ALL SELECT pf.project, p_partkey % {len(PYTHON)} = 1 FROM pf JOIN f ON pf.project = f.project AND pf.path = f.path WHERE r <= 50) GROUP BY 1",
)
def project_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.project_type(project_files(spark, sf_dir), T.WEB_PATTERNS)


@query(
    "F24_entry_points",
    f"WITH {_PROJECT_SQL}, e AS (SELECT DISTINCT project, path FROM pf WHERE ends_with(path, '/Main.py') OR p_partkey % {len(PYTHON)} = 1 AND lower(regexp_extract(path, '[^.]*$')) = 'py') SELECT * FROM e UNION ALL SELECT project, min(path) FROM pf WHERE project NOT IN (SELECT project FROM e) GROUP BY 1",
)
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = project_files(spark, sf_dir)
    return P.entry_points(files, syntax.extract_tags(files.filter(P.extension(F.col("path")) == "py")))


@query("S15_listing", f"WITH {_PROJECT_SQL}, n AS (SELECT substr(path, length('Brand#11/src/') + 1) AS rest FROM pf WHERE starts_with(path, 'Brand#11/src/')) SELECT split_part(rest, '/', 1) AS name, bool_or(contains(rest, '/')) AS is_dir FROM n GROUP BY 1")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.listing(project_files(spark, sf_dir), "Brand#11/src")


_CALLED = [(0, "read", "loads"), (0, "read", "open"), (0, "read", "eval"), (0, "read", "read"), (1, "run", "run"), (1, "again", "again"), (3, "test_add", "isinstance"), (4, "Job.login", "execute"), (4, "Job.login", "load"), (1, "", "route"), (4, "", "run")]


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, caller_name, callee_name) of the parsed code files."""
    rows = python_code.parse(_files(spark, sf_dir, PYTHON, ".py")).filter("kind = 'call'")
    return rows.select("file", F.col("detail").alias("caller_name"), F.col("name").alias("callee_name"))


@query("G2_callers_by_name", f"SELECT DISTINCT callee, caller FROM {_values(_CALLED, 'k, caller, callee')}")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.call_projection(_calls(spark, sf_dir))


@query("F27_lookup", f"SELECT 'callers' AS what, caller AS name FROM (SELECT DISTINCT caller FROM {_values(_CALLED, 'k, caller, callee')} WHERE callee = 'run') UNION ALL SELECT 'callees', callee FROM (SELECT DISTINCT callee FROM {_values(_CALLED, 'k, caller, callee')} WHERE caller = 'read') UNION ALL SELECT 'part', file FROM (SELECT 'src/f' || p_partkey || '.py' AS file FROM part WHERE p_partkey % {len(PYTHON)} = 4 ORDER BY 1 LIMIT 20)")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    functions = python_code.parse(_files(spark, sf_dir, PYTHON, ".py")).filter("kind = 'function'").select("file", "name", "line")
    told = lambda what, df, c: df.select(F.lit(what).alias("what"), F.col(c).alias("name"))
    return told("callers", P.callers_of(calls, "run"), "caller").union(told("callees", P.callees_of(calls, "read"), "callee")).union(told("part", P.lookup(functions, "LOG", True), "file"))


@query("F28_taint_flows", "SELECT 'src/f' || p_partkey || '.py' AS file, 5 AS line, 'eval' AS sink, 'critical' AS severity FROM part WHERE p_partkey % 2 = 0 AND contains('src/f' || p_partkey || '.py', '1') ORDER BY file LIMIT 20")
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = ["import sys\n\ndef go():\n    x = sys.argv[1]\n    eval(x)\n    compile(x)\n", "def go():\n    pass\n"]
    found = taint.taint_paths(python_code.parse(_files(spark, sf_dir, code, ".py")), most=None)
    severity = C.first_of([(F.col("sink") == k, v) for k, v in T.PYTHON_SINKS.items()])
    return P.flows(found.withColumn("severity", severity), "critical", "1", "eval").select("file", "line", "sink", "severity")


BRACED = [
    "package a.b;\nimport java.util.List;\n\npublic class Runner extends Base {\n    @GetMapping(\"/run\")\n    public List<String> run(@RequestParam(\"c\") String cmd, int n) throws IOException {\n        String full = \"sh \" + cmd;\n        if (n > 0) { Runtime.getRuntime().exec(full); }\n        return helper(full);\n    }\n\n    private void helper(String x) {\n        new FileReader(x);\n    }\n\n    void go(String path) {\n        helper(path);\n    }\n}\n",
    "public class Plain { /* void no() {} */ Plain() {} }\n",
]
SCRIPTS = [
    "import { load as read } from './store';\nconst http = require('http');\nexport function show(id) {\n  const part = `x ${id}`;\n  el.innerHTML = part;\n  paint(part);\n}\nconst paint = (text) => {\n  document.write(text);\n}\nclass Page extends View {\n  draw(q) {\n    return q;\n  }\n}\n",
    "const a = location;\n",
]


_DECLARED = [
    (0, "import", "java.util.List", 2, ""), (0, "import", "java.util.List", 2, ""), (0, "class", "Runner", 4, "Base"), (0, "function", "Runner.run", 6, "cmd,n"), (0, "decorator", "Runner.run", 6, ""), (0, "function", "Runner.helper", 12, "x"), (0, "function", "Runner.go", 16, "path"),
    (1, "class", "Plain", 1, ""), (1, "function", "Plain.<init>", 1, ""),
]


@query("S7_java_declarations", f"SELECT 'src/f' || p_partkey || '.java' AS file, kind, fullname, line, params FROM part JOIN {_values(_DECLARED, 'k, kind, fullname, line, params')} ON p_partkey % 2 = k")
def java_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = braces.parse(_files(spark, sf_dir, BRACED, ".java")).filter("kind <> 'call'")
    return rows.select("file", "kind", "fullname", "line", F.array_join("params", ",").alias("params"))


_SCRIPTED = [(0, "import", "./store.load", 1, ""), (0, "import", "http", 2, ""), (0, "function", "show", 3, "id"), (0, "function", "paint", 8, "text"), (0, "class", "Page", 11, "View"), (0, "function", "Page.draw", 12, "q")]


@query("S8_script_declarations", f"SELECT 'src/f' || p_partkey || '.ts' AS file, kind, fullname, line, params FROM part JOIN {_values(_SCRIPTED, 'k, kind, fullname, line, params')} ON p_partkey % 2 = k")
def script_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = braces.parse(_files(spark, sf_dir, SCRIPTS, ".ts")).filter("kind <> 'call'")
    return rows.select("file", "kind", "fullname", "line", F.array_join("params", ",").alias("params"))


@query("T6_java_taint", "WITH f AS (SELECT 'src/f' || p_partkey || '.java' AS file FROM part WHERE p_partkey % 2 = 0) SELECT '@RequestParam' AS source, 'exec' AS sink, file, 8 AS line, 0 AS depth FROM f UNION ALL SELECT '@RequestParam', 'FileReader', min(file), 13, 1 FROM f")
def java_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapped handler's parameter through a text to a command, and on to the first helper of that name."""
    code = [BRACED[0].replace("return helper(full);", "helper(full);"), BRACED[1]]
    found = taint.taint_paths(braces.parse(_files(spark, sf_dir, code, ".java")), most=None, sources=T.JAVA_SOURCES, sinks=T.JAVA_SINKS)
    return found.select("source", "sink", "file", "line", "depth")


@query("T7_script_taint", "SELECT 'param' AS source, sink, 'src/f' || p_partkey || '.js' AS file, line, 0 AS depth FROM part, (VALUES ('innerHTML', 5), ('document.write', 9)) v(sink, line) WHERE p_partkey % 2 = 0")
def script_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function's parameters are sources, so the helper has a path of its own."""
    found = taint.taint_paths(braces.parse(_files(spark, sf_dir, SCRIPTS, ".js")), most=None, sources=T.JS_SOURCES, sinks=T.JS_SINKS)
    return found.select("source", "sink", "file", "line", "depth")
