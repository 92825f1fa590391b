"""Structural queries on Python sources: S-expression patterns with captures and predicates, over a tree built from the parser's.

A pattern is ``(type field: (type) @capture (#eq? @capture "text"))``. Node types and fields are the usual ones of concrete
syntax trees: call, attribute, identifier, argument_list, keyword_argument, function_definition and so on. Children without
a field must follow each other in order, others may stand between. ``_`` is any node, ``[ ... ]`` a choice, ``.``
asks that the next child follows at once. Predicates: #eq?, #match?, #not-eq?, #not-match?.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types whose name isn't the parser's own in lower case.
NAMED = {
    "Expr": "expression_statement", "Return": "return_statement", "If": "if_statement", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "With": "with_statement", "AsyncWith": "with_statement",
    "Try": "try_statement", "Raise": "raise_statement", "Assert": "assert_statement", "Delete": "delete_statement", "Pass": "pass_statement", "BinOp": "binary_operator", "BoolOp": "boolean_operator", "UnaryOp": "unary_operator",
    "Compare": "comparison_operator", "IfExp": "conditional_expression", "Dict": "dictionary", "ListComp": "list_comprehension", "JoinedStr": "string", "Lambda": "lambda", "Await": "await",
}


@dataclass
class Node:
    type: str
    line: int
    column: int
    end: tuple[int, int]
    text: str
    children: list[tuple[str | None, Node]] = field(default_factory=list)


class _Builder:
    def __init__(self, source: str):
        self.lines = source.encode().split(b"\n")

    def text(self, start: tuple[int, int], end: tuple[int, int]) -> str:
        (a, i), (b, j) = start, end
        part = self.lines[a][i:j] if a == b else b"\n".join([self.lines[a][i:], *self.lines[a + 1 : b], self.lines[b][:j]])
        return part.decode(errors="replace")

    def make(self, kind: str, start: tuple[int, int], end: tuple[int, int], children: list[tuple[str | None, Node]] | None = None) -> Node:
        return Node(kind, *start, end, self.text(start, end), children or [])

    def name_after(self, start: tuple[int, int], name: str) -> Node:
        """The identifier ``name`` from ``start`` on in its line."""
        line, column = start
        at = self.lines[line].find(name.encode(), column)
        at = max(at, column)
        return Node("identifier", line, at, (line, at + len(name.encode())), name)

    def build(self, n: ast.AST) -> Node:
        start, end = (n.lineno - 1, n.col_offset), (n.end_lineno - 1, n.end_col_offset)
        special = getattr(self, "of_" + type(n).__name__, None)
        if special:
            return special(n, start, end)
        kind = NAMED.get(type(n).__name__, type(n).__name__.lower())
        return self.make(kind, start, end, [(None, self.build(c)) for c in _located(n)])

    def of_Name(self, n, start, end):
        return self.make("identifier", start, end)

    def of_Constant(self, n, start, end):
        kinds = {str: "string", bytes: "string", bool: str(n.value).lower(), type(None): "none", int: "integer", float: "float"}
        return self.make(kinds.get(type(n.value), "constant"), start, end)

    def of_Attribute(self, n, start, end):
        last = (end[0], end[1] - len(n.attr.encode()))
        return self.make("attribute", start, end, [("object", self.build(n.value)), ("attribute", self.make("identifier", last, end))])

    def of_Call(self, n, start, end):
        given = sorted([*n.args, *n.keywords], key=lambda x: (x.lineno, x.col_offset))
        callee = self.build(n.func)
        arguments = self.make("argument_list", callee.end, end, [(None, self.build(x)) for x in given])
        return self.make("call", start, end, [("function", callee), ("arguments", arguments)])

    def of_keyword(self, n, start, end):
        if n.arg is None:
            return self.make("dictionary_splat", start, end, [(None, self.build(n.value))])
        return self.make("keyword_argument", start, end, [("name", self.name_after(start, n.arg)), ("value", self.build(n.value))])

    def of_Assign(self, n, start, end):
        inner = [("left", self.build(t)) for t in n.targets] + [("right", self.build(n.value))]
        return self.make("expression_statement", start, end, [(None, self.make("assignment", start, end, inner))])

    def of_BinOp(self, n, start, end):
        return self.make("binary_operator", start, end, [("left", self.build(n.left)), ("right", self.build(n.right))])

    def of_Subscript(self, n, start, end):
        return self.make("subscript", start, end, [("value", self.build(n.value)), ("subscript", self.build(n.slice))])

    def _imported(self, n, start, end, kind, first):
        names, at = first, start
        for a in n.names:
            where = (a.lineno - 1, a.col_offset)
            whole = (a.end_lineno - 1, a.end_col_offset)
            stop = (where[0], where[1] + len(a.name.encode()))
            name = self.make("wildcard_import" if a.name == "*" else "dotted_name", where, stop)
            if a.asname:
                alias = self.name_after(stop, a.asname)
                name = self.make("aliased_import", where, whole, [("name", name), ("alias", alias)])
            names.append(("name", name))
        return self.make(kind, at, end, names)

    def of_Import(self, n, start, end):
        return self._imported(n, start, end, "import_statement", [])

    def of_ImportFrom(self, n, start, end):
        module = self.name_after((start[0], start[1] + 5), n.module) if n.module else None
        first = [("module_name", Node("dotted_name", module.line, module.column, module.end, module.text))] if module else []
        return self._imported(n, start, end, "import_from_statement", first)

    def _defined(self, n, start, end, kind, middle):
        name = self.name_after((start[0], start[1] + (6 if kind == "class_definition" else 4)), n.name)
        body = [self.build(x) for x in n.body]
        block = self.make("block", (body[0].line, body[0].column), end, [(None, x) for x in body])
        inner = self.make(kind, start, end, [("name", name), *middle, ("body", block)])
        if not n.decorator_list:
            return inner
        marks = []
        for d in n.decorator_list:
            x = self.build(d)
            marks.append((None, self.make("decorator", (x.line, max(x.column - 1, 0)), x.end, [(None, x)])))
        return self.make("decorated_definition", (marks[0][1].line, marks[0][1].column), end, [*marks, ("definition", inner)])

    def of_FunctionDef(self, n, start, end):
        given = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
        inner = [(None, self.name_after((a.lineno - 1, a.col_offset), a.arg)) for a in given]
        where = (inner[0][1].line, inner[0][1].column) if inner else start
        parameters = Node("parameters", *where, where, "", inner)
        return self._defined(n, start, end, "function_definition", [("parameters", parameters)])

    of_AsyncFunctionDef = of_FunctionDef

    def of_ClassDef(self, n, start, end):
        bases = [(None, self.build(x)) for x in n.bases]
        where = (bases[0][1].line, bases[0][1].column) if bases else start
        return self._defined(n, start, end, "class_definition", [("superclasses", Node("argument_list", *where, where, "", bases))] if bases else [])


def _located(n: ast.AST) -> list[ast.AST]:
    """Children that have a place; what lies below one without it comes in its stead."""
    out = []
    for c in ast.iter_child_nodes(n):
        out += [c] if hasattr(c, "end_lineno") else _located(c)
    return out


def tree(source: str) -> Node:
    """The tree of a module; SyntaxError and ValueError as the parser raises them."""
    built = _Builder(source)
    body = [(None, built.build(x)) for x in ast.parse(source).body]
    return Node("module", 0, 0, (len(built.lines) - 1, len(built.lines[-1])), source, body)


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for _, c in reversed(n.children))


@dataclass
class Pattern:
    types: set[str] | None = None  # None is any node
    choices: list[Pattern] = field(default_factory=list)
    children: list[tuple[str | None, Pattern, bool]] = field(default_factory=list)  # field, pattern, at once
    captures: list[str] = field(default_factory=list)
    tests: list[tuple[str, list[str]]] = field(default_factory=list)


_TOKEN = re.compile(r';[^\n]*|"(?:[^"\\]|\\.)*"|[()\[\].]|@[\w.-]+|#[\w?!-]+|[\w-]+:|[\w-]+|\S')


def compiled(query: str) -> list[Pattern]:
    """The patterns of a query; ValueError for what isn't understood."""
    tokens = [t for t in _TOKEN.findall(query) if not t.startswith(";")]
    at = 0

    def parse() -> Pattern:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("the query ends within a pattern")
        token, p = tokens[at], Pattern()
        at += 1
        if token == "[":
            while tokens[at] != "]":
                p.choices.append(parse())
            at += 1
        elif token == "(":
            if tokens[at] in ("(", "["):  # a group of one pattern and its tests
                p = parse()
            elif tokens[at] != "_":
                p.types = {tokens[at]}
                at += 1
            else:
                at += 1
            once = False
            while tokens[at] != ")":
                if tokens[at] == "(" and tokens[at + 1].startswith("#"):
                    end = tokens.index(")", at)
                    p.tests.append((tokens[at + 1], [t[1:-1].replace('\\"', '"').replace("\\\\", "\\") if t[0] == '"' else t for t in tokens[at + 2 : end]]))
                    at = end + 1
                elif tokens[at] == ".":
                    once, at = True, at + 1
                elif tokens[at].startswith("@"):
                    p.captures.append(tokens[at][1:])
                    at += 1
                else:
                    name = None
                    if tokens[at].endswith(":"):
                        name, at = tokens[at][:-1], at + 1
                    p.children.append((name, parse(), once))
                    once = False
            at += 1
        elif token != "_":
            raise ValueError(f"{token!r} is not a pattern")
        while at < len(tokens) and tokens[at].startswith("@"):
            p.captures.append(tokens[at][1:])
            at += 1
        return p

    out: list[Pattern] = []
    while at < len(tokens):
        if tokens[at] == "(" and at + 1 < len(tokens) and tokens[at + 1].startswith("#"):
            raise ValueError("a test stands outside a pattern")
        out.append(parse())
    return out


Found = dict[str, list[Node]]


def _joined(a: Found, b: Found) -> Found:
    return a | {k: a.get(k, []) + v for k, v in b.items()}


def _match(p: Pattern, n: Node) -> Iterator[Found]:
    if p.choices:
        inner: Iterator[Found] = (f for c in p.choices for f in _match(c, n))
    elif p.types is not None and n.type not in p.types:
        return
    else:
        inner = _children(p.children, n.children, 0)
    own = {c: [n] for c in p.captures}
    for f in inner:
        found = _joined(own, f)
        if all(_holds(test, given, found) for test, given in p.tests):
            yield found


def _children(wanted: list[tuple[str | None, Pattern, bool]], given: list[tuple[str | None, Node]], start: int) -> Iterator[Found]:
    if not wanted:
        yield {}
        return
    name, p, once = wanted[0]
    for i in range(start, len(given)):
        if once and i > start:
            return
        if name is None or given[i][0] == name:
            for f in _match(p, given[i][1]):
                for rest in _children(wanted[1:], given, i + 1):
                    yield _joined(f, rest)


def _holds(test: str, given: list[str], found: Found) -> bool:
    texts = [[n.text for n in found.get(g[1:], [])] if g.startswith("@") else [g] for g in given]
    left, right = texts[0], (texts[1] or [""])[0]
    if test in ("#eq?", "#not-eq?"):
        return all((x == right) == (test == "#eq?") for x in left)
    if test in ("#match?", "#not-match?"):
        return all(bool(re.search(right, x)) == (test == "#match?") for x in left)
    return True


def matches(patterns: list[Pattern], root: Node) -> Iterator[Found]:
    for n in walk(root):
        for p in patterns:
            yield from _match(p, n)


MATCHES = "file string, rule_id string, rule_name string, severity string, line int, column int, matched string"


def match_rules(files: DataFrame, rules: list[dict]) -> DataFrame:
    """(file, rule_id, rule_name, severity, line, column, matched) of Python files (path, source) under ``rules``.

    A rule has id, name, severity, query, capture_group and match_any (a list or None). Texts are cut to 200 characters. A
    rule whose query isn't understood and a file that doesn't parse match nothing; a null source is empty. Rules of other languages
    are left out. Rows repeated in ``files`` match each.
    """
    rules = [{k: r.get(k) for k in ("id", "name", "severity", "query", "capture_group", "match_any")} for r in rules if r.get("lang", r.get("language", "python")) == "python"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = []
        for r in rules:
            try:
                known.append((r, compiled(r["query"] or "")))
            except (ValueError, IndexError):
                continue
        for f in frames:
            rows = []
            for path, source in zip(f["path"], f["source"], strict=True):
                try:
                    root = tree(source or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for r, patterns in known:
                    for found in matches(patterns, root):
                        for n in found.get(r["capture_group"] or "match", []):
                            if r["match_any"] is None or n.text in r["match_any"]:
                                rows.append([path, r["id"], r["name"], r["severity"] or "medium", n.line + 1, n.column, n.text[:200]])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHES.split(", ")])

    return files.select("path", "source").mapInPandas(run, MATCHES)


#: Calls that are signals, as (signal, object, method) patterns; without an object the callee is a bare name.
SIGNALS = [
    ("sql_sink", ".*", "execute|query|raw_sql|executemany"),
    ("cmd_exec", "os", "system|popen"),
    ("cmd_exec", "subprocess", "Popen|call|run|check_call|check_output"),
    ("file_io", None, "open"),
    ("file_io", "os", "open"),
    ("regex_operation", "re", "match|search|sub|compile|findall|finditer|fullmatch|split"),
    ("network_operation", "requests|httpx", "get|post|put|delete|patch|request"),
    ("crypto_operation", "hashlib|hmac", ".*"),
    ("crypto_operation", "jwt", "encode|decode|verify"),
    ("serialization", "pickle", "load|loads|dump|dumps"),
    ("serialization", "yaml", "load|loads"),
    ("dynamic_exec", None, "eval|exec"),
]
#: Signals of calls on an attribute of a name.
CHAINED = [("sql_sink", "execute|query"), ("file_io", "read_bytes|read_text|write_bytes|write_text|open|iterdir|glob")]
AUTH = "authenticate|authorize|verify_token|check_role|has_permission|is_admin|login|logout"


def tag_query() -> str:
    """The query whose captures are tags of Python files, made from the tables above."""
    parts = [
        "(function_definition name: (identifier) @name.definition.function)",
        "(class_definition name: (identifier) @name.definition.class)",
        "(call function: (identifier) @name.reference.call)",
        "(call function: (attribute object: (identifier) attribute: (identifier) @name.reference.method))",
        "(decorated_definition (decorator (identifier) @name.reference.call) . (function_definition))",
        "(import_statement name: (dotted_name) @name.reference.import)",
        "(import_from_statement name: (dotted_name) @name.reference.import)",
        f'(function_definition name: (identifier) @_name (#match? @_name "(?i)^({AUTH})$")) @signal.auth_check',
    ]
    for signal, owner, method in SIGNALS:
        if owner is None:
            parts.append(f'(call function: (identifier) @_fn (#match? @_fn "^({method})$")) @signal.{signal}')
        else:
            parts.append(f'(call function: (attribute (identifier) @_obj (identifier) @_method) (#match? @_obj "^({owner})$") (#match? @_method "^({method})$")) @signal.{signal}')
    parts += [f'(call function: (attribute (attribute (identifier)) (identifier) @_method) (#match? @_method "^({method})$")) @signal.{signal}' for signal, method in CHAINED]
    return "\n".join(parts)


TAGS = "file string, name string, kind string, line int, signal string"


def extract_tags(files: DataFrame, query: str | None = None) -> DataFrame:
    """(file, name, kind, line, signal) of Python files (path, source): definitions (def), references (ref) and signals, lines from 0.

    Captures ``name.definition.*``, ``name.reference.*`` and ``signal.*`` of ``query`` are tags, each node once a capture.
    A function that holds a call of its own name gives a signal ``recursion`` at line 0. Files that don't parse and null sources have none.
    """
    text = query or tag_query()
    calls = "(call function: (identifier) @call)"
    functions = "(function_definition name: (identifier) @name body: (_) @body)"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tags, called, defined = compiled(text), compiled(calls), compiled(functions)
        for f in frames:
            rows = []
            for path, source in zip(f["path"], f["source"], strict=True):
                try:
                    root = tree(source or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                seen = set()
                for found in matches(tags, root):
                    for capture, nodes in found.items():
                        kind = {"name.definition": "def", "name.reference": "ref"}.get(capture.rpartition(".")[0], "signal" if capture.startswith("signal.") else None)
                        for n in nodes if kind else []:
                            if (capture, n.line, n.column, n.end) not in seen:
                                seen.add((capture, n.line, n.column, n.end))
                                rows.append([path, n.text, kind, n.line, capture.split(".", 1)[1] if kind == "signal" else ""])
                inside = [(c["call"][0].text, (c["call"][0].line, c["call"][0].column)) for c in matches(called, root)]
                own = {d["name"][0].text for d in matches(defined, root) for name, where in inside if name == d["name"][0].text and (d["body"][0].line, d["body"][0].column) <= where <= d["body"][0].end}
                rows += [[path, name, "signal", 0, "recursion"] for name in sorted(own)]
            yield pd.DataFrame(rows, columns=["file", "name", "kind", "line", "signal"])

    return files.select("path", "source").mapInPandas(run, TAGS)


def personalisation(files: DataFrame, entries: DataFrame, sinks: DataFrame, mentioned: DataFrame, idents: list[str]) -> DataFrame:
    """(node, weight) of files (path) with a weight above 0: base is 100 / files; entry files get ten, mentioned files one, sink files a
    hundred, and files with a path component, name or stem among ``idents`` one more. ``entries``, ``sinks`` and ``mentioned`` have a column path."""
    paths = files.select("path").distinct()
    base = 100.0 / max(paths.count(), 1)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    hit = F.arrays_overlap(F.concat(parts, F.array(stem)), F.array(*[F.lit(i) for i in idents])) if idents else F.lit(False)
    weight = F.when(hit, base).otherwise(0.0)
    for k, (chosen, times) in enumerate(((entries, 10), (mentioned, 1), (sinks, 100))):
        paths = paths.join(chosen.select("path", F.lit(True).alias(f"__{k}")).distinct(), "path", "left")
        weight = weight + F.when(F.col(f"__{k}"), times * base).otherwise(0.0)
    return paths.select(F.col("path").alias("node"), weight.alias("weight")).filter("weight > 0")
