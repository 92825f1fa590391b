"""Operators on hand-computed literals and on odd input."""

import pytest
from pyspark.sql import functions as F

from quern.functions import classify as C
from quern.functions import scalars as S
from quern.operators import checks, folds, graph, joins, project, ranking, taint, validators
from quern.sources import braces, files, python_code, syntax


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@pytest.mark.parametrize(("values", "p80", "p40"), [([1, 2, 3, 4, 5], 4, 2), ([1, 2, 3, 4], 3, 2), ([7], 7, 7), ([5, 5, 5, 1], 5, 5)])
def test_percentile(spark, values, p80, p40):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert rows(ranking.percentile_at(df, "v", [80, 40])) == [(p80, p40)]


def test_attack_scores_of_a_chain(spark, abc):
    entry, sink = nodes(spark, "a"), nodes(spark, "c")
    assert rows(graph.attack_scores(abc, entry, sink, True)) == [("a", 500.0), ("b", 500.0), ("c", 500.0)]
    assert rows(graph.attack_scores(abc, entry, sink, False)) == [("b", 500.0)]
    assert rows(graph.attack_scores(abc, sink, entry, True)) == []


def test_reachable_on_a_cycle(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "x")], "src string, dst string")
    assert rows(graph.reachable(ring, nodes(spark, "a"))) == [("a", "a"), ("a", "b"), ("a", "x")]


def test_bfs_depth_and_node_limits(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(10)], "src string, dst string")
    found = rows(graph.bfs(chain, nodes(spark, "n00"), 8, 30))
    assert [(n, d) for _, n, d, _ in found] == [(f"n{i:02d}", i) for i in range(9)]
    star = spark.createDataFrame([("r", f"c{i}") for i in range(9)], "src string, dst string")
    assert [r[1] for r in sorted(rows(graph.bfs(star, nodes(spark, "r"), 8, 4)), key=lambda r: r[3])] == ["r", "c0", "c1", "c2"]


def test_simple_paths_and_backtrack(spark):
    g = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("b", "c"), ("d", "a"), ("z", "z")], "src string, dst string")
    ends = spark.createDataFrame([("a", "d")], "entry string, sink string")
    assert rows(graph.simple_paths(g, ends).select(F.array_join("path", ""))) == [("abcd",), ("abd",), ("acd",)]
    assert rows(graph.simple_paths(g, ends, 2).select(F.array_join("path", ""))) == [("abd",), ("acd",)]
    assert rows(graph.backtrack(g, nodes(spark, "d")).select("sink", F.array_join("path", ""))) == [("d", "abcd")]
    assert rows(graph.backtrack(g, nodes(spark, "nowhere"))) == []


def test_pagerank_leaks_at_dangling_nodes(spark, abc):
    ranks = dict(rows(graph.pagerank(abc, iterations=50, tolerance=0)))
    base = 0.15 / 9
    assert ranks["a"] == pytest.approx(base) and ranks["b"] == pytest.approx(base * 1.85) and ranks["c"] == pytest.approx(base * (1 + 0.85 * 1.85))
    one = dict(rows(graph.pagerank(abc, nodes(spark, "a").withColumn("weight", F.lit(2.0)), 50, 0)))
    assert one["a"] == pytest.approx(0.15) and one["b"] == pytest.approx(0.15 * 0.85)


def test_reference_graph_weights(spark):
    defs = spark.createDataFrame([("x", "long_name_here"), ("x", "_p"), ("y", "alone")], "file string, name string")
    refs = spark.createDataFrame([("y", "long_name_here")] * 4 + [("y", "_p")], "file string, name string")
    found = {(r["src"], r["dst"], r["ident"]): r["weight"] for r in graph.reference_graph(defs, refs).collect()}
    assert found == {("y", "x", "long_name_here"): 20.0, ("y", "x", "_p"): pytest.approx(0.1), ("y", "y", "alone"): 0.1}


def test_climb_skips_cycles(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4)], "child long, parent long")
    kinds = spark.createDataFrame([(2, "BLOCK"), (3, "METHOD"), (4, "BLOCK"), (5, "BLOCK")], "node long, kind string")
    assert rows(graph.climb(tree, kinds, "METHOD", 8)) == [(1, 3), (2, 3)]


def test_path_score(spark):
    one = spark.createDataFrame([("exec", ["f"], ["a", "b"], False)], "s string, f array<string>, p array<string>, w boolean")
    assert rows(one.select(ranking.path_score(F.col("s"), F.col("f"), F.col("p"), F.col("w")))) == [(pytest.approx(0.6),)]


def test_guarded_top_k(spark):
    df = spark.createDataFrame([("a", "k1", False, 0.9, 1), ("a", "k2", True, 0.1, 2), ("b", "k3", False, 0.5, 3), ("a", "k2", False, 0.8, 4), ("a", "k4", False, 0.2, 5)], "kind string, key string, known boolean, score double, id int")
    got = ranking.guarded_top_k(df, "kind", "key", "known", "score", "id", 4).orderBy("place").collect()
    assert [r["id"] for r in got] == [2, 3, 1, 5]


def test_greedy_dedup(spark):
    df = spark.createDataFrame([(1, "f", 1), (2, "f", 4), (3, "f", 7), (4, "f", 7), (5, "f", None), (6, "f", 0), (7, "g", 1), (8, None, 3), (9, None, 4)], "id int, file string, line int")
    kept = {r["id"]: r["kept"] for r in folds.greedy_keep(df, ["file"], "line", "id").collect()}
    assert kept == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: True, 8: True, 9: False}


def test_greedy_dedup_equals_a_plain_loop(spark):
    import random

    r = random.Random(2)
    data = [(i, r.choice("xy"), r.randint(0, 60)) for i in range(200)]
    kept, held = {}, []
    for i, f, line in data:
        kept[i] = line <= 0 or not any(g == f and abs(line - k) <= 3 for g, k in held)
        if kept[i] and line > 0:
            held.append((f, line))
    df = spark.createDataFrame(data, "id int, file string, line int")
    assert {r["id"]: r["kept"] for r in folds.greedy_keep(df, ["file"], "line", "id").collect()} == kept


def test_ema(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert df.select(folds.ema(F.col("v"))).collect()[0][0] == pytest.approx(172.967)


def test_queue_order(spark):
    tasks = spark.createDataFrame([("t", 0.9, 1), ("t", 0.1, 2)], "kind string, p double, id int")
    limits = spark.createDataFrame([("t", 1)], "kind string, free int")
    assert rows(folds.poll(tasks, "kind", ["p", "id"], limits).select("id", "starts")) == [(1, False), (2, True)]


def test_scalars(spark):
    df = spark.createDataFrame([("/A/:id/",), ("x",)], "p string")
    assert rows(df.select(S.normalize_route(S.resolve_params(F.col("p"))))) == [("/a/{param}",), ("/x",)]
    assert rows(df.select(C.classify_sink(F.lit("x.compile")), C.classify_sink(F.lit("re.compile")), C.classify_sink(F.lit("nothing"))).limit(1)) == [("rce", "redos", None)]


def test_call_resolution_order(spark):
    calls = spark.createDataFrame([(1, "f", "", "m.g"), (2, "f", "m", "g"), (3, "f", "", "g"), (4, "f", "", "np.sum"), (5, "f", "", "len"), (6, "f", "", "zzz")], "call_id int, file string, scope string, name string")
    functions = spark.createDataFrame([("m.g", 2), ("a.g", 1)], "qname string, ordinal int")
    imports = spark.createDataFrame([("f", "np", "numpy")], "file string, alias string, module string")
    got = rows(joins.resolve_calls(calls, functions, imports, ["len"]))
    assert got == [(1, "m.g", "exact"), (2, "m.g", "scope"), (3, "a.g", "suffix"), (4, "numpy.sum", "import"), (5, "len", "builtin"), (6, None, None)]


def test_parse_and_noise(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("def hidden(): pass")
    (tmp_path / "a.py").write_text("def f(x):\n    return g(x)\n")
    (tmp_path / "b.min.js").write_text("var a")
    found = files.source_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[-1] for r in found.collect()] == ["a.py"]
    got = rows(python_code.parse(found).select("kind", "fullname"))
    assert got == [("call", "g"), ("function", "f")]


def test_graph_readers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a.py,f,1\na.py,g,5\nshort\n")
    (tmp_path / "e.csv").write_text("a.py,f,a.py,g\na.py,f,b.py,h\nbad\n")
    n, e = files.call_graph_csv(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert n.count() == 2 and rows(e) == [("a.py::g", "a.py::f")] or rows(e.select("src", "dst")) == [("a.py::f", "a.py::g")]
    (tmp_path / "g.json").write_text('{"vertices":[{"id":1,"label":"METHOD","name":"f"},{"id":2,"label":"CALLSITE","name":"g"},{"id":3,"label":"METHOD","name":"g"},{"id":4,"label":"METHOD","name":"ext","external":true}],"edges":[{"label":"CONTAINS","outV":1,"inV":2},{"label":"CALL","outV":2,"inV":3},{"label":"CALL","outV":2,"inV":4}]}')
    methods, calls = files.graphson(spark, str(tmp_path / "g.json"))
    assert rows(methods) == [(1, "f"), (3, "g")] and rows(calls) == [(1, 3)]
    (tmp_path / "s.csv").write_text("exec,a.py,3,x\nopen,b.py,4,y\n")
    (tmp_path / "f.csv").write_text("argv,a.py,1,exec,a.py,3\n")
    got = rows(files.findings_csv(spark, str(tmp_path / "s.csv"), str(tmp_path / "f.csv"), "rce").select("key", "confidence", "is_full"))
    assert got == [("rce:a.py:3", 0.8, True), ("rce:b.py:4", 0.6, False)]
    texts = spark.createDataFrame([("r.yaml", "- id: r1\n  query: q\n  match_any: [eval]\n- id: r2\n"), ("bad.yaml", "a: [")], "path string, text string")
    assert rows(files.rules_yaml(spark, texts).select("id", "severity")) == [("r1", "medium"), ("r2", "medium")]


def test_stores(spark, tmp_path):
    assert files.read_store(spark, str(tmp_path / "none"), "k string, n long").count() == 0
    findings = spark.createDataFrame([("high", "x"), ("low", "y"), ("high", "z")], "severity string, title string")
    files.write_report(findings, str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out" / "summary")).select("severity", "n")) == [("high", 2), ("low", 1)]


def test_attack_scores_on_cycles_and_equal_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    score = lambda entries, sinks, ends: {r["node"]: r["score"] for r in graph.attack_scores(edges, one(*entries), one(*sinks), ends).collect()}
    assert score(["a"], ["c"], True) == {"a": 500, "b": 500, "c": 500}
    assert score(["a"], ["c"], False) == {"b": 500}
    assert score(["a"], ["a"], True) == {"a": 1000, "b": 500}
    assert score(["c"], ["c"], True) == {"c": 1000} and score(["c"], ["a"], True) == {}
    assert score(["x"], ["x"], True) == {}


def test_percentile_of_many_values(spark):
    df = spark.range(0, 1001, 1, 7).selectExpr("cast(id * 37 % 1001 as double) AS v").repartition(5)
    assert rows(ranking.percentile_at(df, "v", [80, 40, 0, 100])) == [(800.0, 400.0, 0.0, 1000.0)]
    assert ranking.percentile_at(df.filter("v < 0"), "v", [80]).count() == 0


def test_explore_slots(spark):
    data = [(i, "k" if i < 5 else "l", f"key{i}", False, float(20 - i), 2 if i in (9, 11) else 0) for i in range(12)]
    df = spark.createDataFrame(data, "id int, kind string, key string, known boolean, score double, n int")
    got = ranking.guarded_top_k(df, "kind", "key", "known", "score", "id", 6, 3, "n").orderBy("slot", "place").collect()
    assert [r["id"] for r in got if r["slot"] == "exploit"] == [0, 5, 1, 2, 3, 4]
    assert [r["id"] for r in got if r["slot"] == "explore"] == [9, 11, 2]


def test_stratified_sample_has_its_size(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else f"s{min(i % 7, 2)}") for i in range(500)], "id long, s string")
    got = ranking.stratified(df, "s", "id", 60).collect()
    assert len(got) == 60 and {r["s"] for r in got} == {None, "s0", "s1", "s2"}
    assert len({r["id"] for r in got}) == 60
    assert ranking.stratified(df, "s", "id", 900).count() == 500
    many = spark.range(0, 300).selectExpr("id", "cast(id as string) AS s")
    assert ranking.stratified(many, "s", "id", 50).count() == 50


def test_calls_that_are_not_statements_give_no_path(spark):
    source = "def f(a):\n    x = input()\n    if eval(x):\n        pass\n    print(eval(x))\n    return eval(x)\n\ndef g(a):\n    x = input()\n    y = eval(x)\n    z = x + 'tail'\n    eval(z)\n    getattr(x, 'n')().eval(x)\n"
    files = spark.createDataFrame([("a.py", source)], "path string, source string")
    got = taint.taint_paths(python_code.parse(files)).collect()
    assert sorted(r["line"] for r in got) == [10, 12]


def test_structural_queries():
    tree = syntax.tree("class K:\n    @wrap\n    def f(self, a):\n        os.system(f'é{a}', shell=False)\n")
    found = lambda q: [{k: [n.text for n in v] for k, v in f.items()} for f in syntax.matches(syntax.compiled(q), tree)]
    assert found("(call function: (attribute object: (identifier) @o attribute: (identifier) @m)) @c") == [{"o": ["os"], "m": ["system"], "c": ["os.system(f'é{a}', shell=False)"]}]
    assert found("(keyword_argument name: (identifier) @k value: [(true) (false)] @v)") == [{"k": ["shell"], "v": ["False"]}]
    assert found('(function_definition name: (identifier) @n (#match? @n "^g"))') == []
    assert found("(decorated_definition (decorator (identifier) @d) . (function_definition name: (_) @n))") == [{"d": ["wrap"], "n": ["f"]}]
    for bad in ("(call", "call)", '(#eq? @a "b")'):
        with pytest.raises((ValueError, IndexError)):
            syntax.compiled(bad)


def test_index_takes_wanted_and_dangerous_files(spark):
    data = [("a.py", 5, "x = 1"), ("b.py", 5, "import pickle"), ("dist/c.py", 5, "x"), ("d.txt", 5, "x"), ("e.py", 5, None), ("f.js", 5, "let a"), (None, 5, "x")]
    df = spark.createDataFrame(data, "path string, size long, source string")
    wanted = spark.createDataFrame([("./f.js",), ("./f.js",)], "path string")
    assert rows(files.build_index(df, wanted).select("path", "full").orderBy("path")) == [("a.py", False), ("b.py", True), ("f.js", True)]
    assert rows(files.build_index(df).select("full").distinct()) == [(True,)]


def test_title_ratio_equals_the_matcher(spark):
    import difflib

    names = ["Red widget", "red Widget 2", "blue ring", "Blue rings", "", None, "zzz"]
    pairs = [(a, b) for a in names for b in names]
    got = folds.title_ratio(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    wanted = [(a, b) for a, b in pairs if a and b and difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.7]
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_brace_languages(spark):
    java = "import a.b.C;\nclass K extends L {\n  // void no() {}\n  @PostMapping(\"/x\")\n  public void go(@RequestBody List<String> in) { String s = in.get(0); run(\"{\", s); }\n  K() {}\n}\n"
    script = "const f = async ({a}, b = 1) => {\n  box.innerHTML = `<b>${b}</b>`\n}\n/* function no() {} */\nlet g = x => eval(x)\n"
    data = [("K.java", java), ("f.js", script), ("n.java", None), ("x.py", "def f(): pass")]
    got = braces.parse(spark.createDataFrame(data, "path string, source string")).collect()
    names = {(r["file"], r["kind"], r["fullname"], tuple(r["params"])) for r in got if r["kind"] in ("function", "class")}
    assert names == {("K.java", "class", "K", ("L",)), ("K.java", "function", "K.go", ("in",)), ("K.java", "function", "K.<init>", ()), ("f.js", "function", "f", ("a", "b")), ("f.js", "function", "g", ("x",))}
    found = taint.taint_paths(braces.parse(spark.createDataFrame(data, "path string, source string")), sources=["@RequestBody"], sinks={"run": "high", "innerHTML": "high", "eval": "high"}).collect()
    assert {(r["file"], r["sink"], r["line"]) for r in found} == {("K.java", "run", 5), ("f.js", "innerHTML", 2), ("f.js", "eval", 5)}


def test_project_facts(spark):
    data = [("p", "p/a/main.go", ""), ("p", "p/b.go", ""), ("p", "p/c.py", "from flask import x"), ("q", "q/tests/app.py", "urlpatterns = 1"), ("q", "q/.hid/z", None), ("q", "q/Z.txt", None), ("q", "q/a.txt", None), ("r", None, None)]
    df = spark.createDataFrame(data, "project string, path string, source string")
    assert rows(project.main_language(df)) == [("p", "go"), ("q", "python")]
    assert rows(project.project_type(df, [r"(?i)from flask import", r"(?i)urlpatterns\s*="])) == [("p", "app"), ("q", "lib"), ("r", "lib")]
    tags = spark.createDataFrame([("p/b.go", "main", "def", "")], "file string, name string, kind string, signal string")
    assert rows(project.entry_points(df.filter("path is not null"), tags)) == [("p", "p/a/main.go"), ("p", "p/b.go"), ("q", "q/tests/app.py")]
    assert [tuple(r) for r in project.listing(df, "q").collect()] == [("tests", True), ("a.txt", False), ("Z.txt", False)]


def test_checkpoints(spark, tmp_path):
    state = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    files.write_checkpoint(state, str(tmp_path / "c"))
    assert rows(files.read_checkpoint(spark, str(tmp_path / "c"), "k long, v string").filter("k = 1")) == [(1, "a")]
    assert files.read_checkpoint(spark, str(tmp_path / "none"), "k long, v string").count() == 0


def test_cards_by_suffix_and_function(spark):
    candidates = spark.createDataFrame([(1, "src/a/b.py", "f"), (2, "xa/b.py", "g"), (3, None, None)], "id int, file string, fn string")
    cards = spark.createDataFrame([(10, "a/b.py", ["z"]), (11, "b.py", ["g"]), (12, "none.py", ["f", "f"])], "card int, file string, functions array<string>")
    assert rows(checks.candidate_cards(candidates, cards, "id", "file", "fn")) == [(1, 10), (1, 11), (1, 12), (2, 11)]


def test_validators_of_java_and_odd_findings(spark):
    java = "@RestController\nclass A {\n  void f(@RequestParam String x) {\n    validate(x);\n    run(x);\n  }\n}\n"
    code = spark.createDataFrame([("src/A.java", java), ("src/ATest.java", "class ATest {}"), ("App.java", "public static void main(String[] a)"), ("m.py", None)], "path string, source string")
    names = "id int, file_path string, line_number int, rule_id string, source_rule_name string, source_info string, detail string, description string, taint_source string, taint_sink string, chain int"
    data = [(i, path, 5, None, None, None, None, None, None, None, None) for i, path in enumerate(["src/A.java", "src/ATest.java", "App.java", "m.py", "gone.py", None])]
    found = validators.verdicts(spark.createDataFrame(data, names), code)
    got = {(r["id"], r["validator"]): (r["priority"], r["passed"]) for r in found.collect()}
    assert len(got) == 36
    assert [got[i, "execution_context"] for i in range(6)] == [("P0", True), ("P0", False), ("P1", False), ("P0", True), ("P0", False), ("P0", False)]
    assert [got[i, "trust_boundary"][1] for i in range(6)] == [True, False, False, False, False, False]
    assert [got[i, "validation_chain"][1] for i in range(6)] == [True, False, False, False, False, False]
    scores = {r["id"]: (r["is_controlled"], r["score"]) for r in validators.exploitability(found, ["id"]).collect()}
    assert scores[0] == (True, 1.0) and scores[4] == (False, 0.27)
    assert validators.verdicts(spark.createDataFrame([], names), code).count() == 0


def test_similar_titles_compare_distinct_titles_once(spark):
    import difflib

    titles = ["Red bolt", "red  bolt", "bolt red", "zzz", "", None, "abcd", "bcda"]
    rows = [(i, titles[i % 8], "g" if i % 3 else "h") for i in range(80)] + [(80, "Red bolt", None), (81, "Red bolt", None)]
    df = spark.createDataFrame(rows, "k int, t string, g string")
    ratio = lambda x, y: difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0
    wanted = sorted((a, b) for a, x, g in rows for b, y, h in rows if a < b and g and g == h and ratio(x, y) >= 0.70)
    assert sorted(map(tuple, folds.similar_titles(df, "k", "t", ["g"]).collect())) == wanted
    assert folds.title_pairs(df, "t", ["g"])[1].count() <= 49 < len(wanted)


def test_candidate_cards_of_repeated_and_null_candidates(spark):
    cards = [(1, "a/f.py", ["x"]), (2, "f.py", ["y", "x"]), (3, None, ["z"]), (4, "q.py", None), (1, "f.py", ["z"])]
    # Keys 5 and null have several pairs; 6 is a row given twice.
    candidates = [(5, "s/a/f.py", "x"), (5, "q.py", "z"), (6, "f.py", "x"), (6, "f.py", "x"), (7, None, "z"), (8, "s/q.py", None), (None, "f.py", None), (None, None, "z"), (9, "af.py", "w")]
    df = spark.createDataFrame(candidates, "k int, f string, fn string")
    found = checks.candidate_cards(df, spark.createDataFrame(cards, "card int, file string, functions array<string>"), "k", "f", "fn")
    wanted = {(k, c) for k, f, fn in candidates for c, at, names in cards if f and at and ("/" + f).endswith("/" + at) or fn and names and fn in names}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    # Nothing that has as many rows as the result is shuffled: cards are arrays until the last step.
    many = spark.range(1000).selectExpr("cast(id as int) k", "'d/f.py' f", "'x' fn")
    plan = checks.candidate_cards(many, spark.createDataFrame(cards, "card int, file string, functions array<string>"), "k", "f", "fn")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(__cards" in plan


def test_reference_pagerank_in_parts_equals_that_of_the_product(spark):
    # a and b lead to each other, c and d are only sources, e is alone, f is fed and gives nothing; x has two definers.
    defs = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y_long_name"), ("c", "lonely"), ("e", "single"), ("e", "other"), ("f", "z"), ("a", "x")], "file string, name string")
    refs = spark.createDataFrame([("a", "y_long_name"), ("b", "x"), ("b", "x"), ("b", "z"), ("c", "x"), ("d", "y_long_name"), ("d", "z"), ("d", "nowhere")], "file string, name string")
    personal = spark.createDataFrame([("a", 40.0), ("c", 40.0), ("absent", 9.0)], "node string, weight double")
    edges = graph.reference_graph(defs, refs)
    parts = graph.reference_parts(defs, refs)
    for p in (None, personal):
        ranks, spread = graph.reference_pagerank(*parts, p, 7)
        plain = graph.pagerank(edges, p, 7, 0)
        assert {r["node"]: r["rank"] for r in ranks.collect()} == pytest.approx({r["node"]: r["rank"] for r in plain.collect()}, abs=1e-15)
        assert {(r["dst"], r["ident"]): r["rank"] for r in spread.collect()} == pytest.approx({(r["dst"], r["ident"]): r["rank"] for r in graph.distribute(edges, plain).collect()}, abs=1e-15)
    ends = [spark.createDataFrame([(n,) for n in names], "node string") for names in (["a", "d", "e", "absent"], ["b", "e", "f"])]
    for include in (False, True):
        got = graph.reference_attack_scores(*parts, *ends, include)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.attack_scores(edges, *ends, include).collect()))


def test_written_edges_are_read_in_place(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(name) or df)
    edges = spark.createDataFrame([(1, k) for k in (10, 9, 30)] + [(10, 100), (9, 1), (1, 9)], "src long, dst long")
    one, end = (spark.createDataFrame([(k,)], "node long") for k in (1, 100))
    got = graph.bfs(edges, one, max_nodes=4, name=F.col("node").cast("string"), written=True)
    # Callees by name: 10, 30, 9. The entry is full then, and its deeper levels aren't made.
    assert rows(got.select("position", "node", "depth")) == [(1, 1, 0), (2, 10, 1), (3, 30, 1), (4, 9, 1)]
    assert rows(graph.attack_scores(edges, one, end, False, written=True)) == [(9, 500.0), (10, 500.0)]
    assert "hops" not in written


@pytest.mark.parametrize("node", ["C1", "P0", "S2", "C14999"])
def test_trade_nodes_as_numbers_have_their_names(spark, node):
    from quern import registry  # noqa: F401  (before the plans, which it imports)
    from quern.plans import graphs

    assert graphs.numbers_of(spark, [node]).select(graphs.name_of("node")).collect()[0][0] == node
    key = spark.createDataFrame([(int(node[1:]),)], "k long")
    assert key.select(graphs.number_key(node[0], "k").alias("node")).select(graphs.name_of("node")).collect()[0][0] == node
