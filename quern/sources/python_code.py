"""Python sources to tables of functions, classes, imports, calls and tags. Parsing needs a parser, so files go through it in Arrow batches."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file string, kind string, name string, fullname string, line int, end_line int, is_method boolean, params array<string>, detail string, ordinal long"


def dotted(node: ast.AST) -> str | None:
    """The name of a chain of attributes, calls and subscripts on a name: ``a.b(...)[?]``. Nothing for chains on other expressions."""
    ends: list[str] = []
    while not isinstance(node, ast.Name):
        if isinstance(node, ast.Attribute):
            ends.append("." + node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            ends.append("(...)")
            node = node.func
        elif isinstance(node, ast.Subscript):
            ends.append("[?]")
            node = node.value
        else:
            return None
    return node.id + "".join(reversed(ends))


def plain(node: ast.AST) -> str | None:
    """A plain or dotted name, else nothing."""
    name = dotted(node)
    return name if name and name.replace(".", "").isidentifier() else None


def _begins(node: ast.AST) -> str | None:
    """The chain that an expression begins with: that of the leftmost operand, if the others have a text as well."""
    while isinstance(node, ast.BinOp):
        if _begins(node.right) is None and not isinstance(node.right, ast.Constant | ast.List | ast.Dict | ast.Tuple):
            return None
        node = node.left
    return dotted(node)


def statements(body: list[ast.stmt]) -> list[dict]:
    """A function's statements in one ordered pass: assignments, and calls that are a statement or the whole value of a plain assignment.

    Branches and loops are walked once, one after the other. Returns, tests, iterables and calls inside other
    expressions are not looked at.
    """
    out: list[dict] = []

    def call(node: ast.AST) -> None:
        name = plain(node.func) if isinstance(node, ast.Call) else None
        if name:
            out.append({"do": "call", "line": node.lineno, "call": name, "args": [plain(a) for a in node.args], "kwargs": [plain(k.value) for k in node.keywords]})

    def assign(target: ast.AST, value: ast.AST) -> None:
        if name := plain(target):
            names = [n.id for n in ast.walk(value) if isinstance(n, ast.Name)]
            out.append({"do": "assign", "line": target.lineno, "target": name, "begins": _begins(value), "value": plain(value), "names": names})

    def walk(stmts: list[ast.stmt]) -> None:
        for s in stmts:
            if isinstance(s, ast.Assign):
                call(s.value)
                for target in s.targets:
                    assign(target, s.value)
            elif isinstance(s, ast.AnnAssign | ast.AugAssign):
                if s.value is not None:
                    assign(s.target, s.value)
            elif isinstance(s, ast.Expr):
                call(s.value)
            elif isinstance(s, ast.If | ast.For | ast.AsyncFor | ast.While | ast.With | ast.AsyncWith | ast.Try | ast.TryStar):
                walk(s.body)
                for h in getattr(s, "handlers", []):
                    walk(h.body)
                walk(getattr(s, "orelse", []))
                walk(getattr(s, "finalbody", []))

    walk(body)
    return out


class _Tables(ast.NodeVisitor):
    def __init__(self, file: str):
        self.file, self.scope, self.rows = file, [], []

    def _row(self, kind: str, name: str, full: str, node: ast.AST, method: bool, params: list[str], detail: str = "") -> None:
        self.rows.append([self.file, kind, name, full, getattr(node, "lineno", 0), getattr(node, "end_lineno", 0), method, params, detail, len(self.rows)])

    def _inside(self, node) -> None:
        """Decorators belong to the scope around."""
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(node.name)
        for name, value in ast.iter_fields(node):
            for x in value if isinstance(value, list) and name != "decorator_list" else [value]:
                if isinstance(x, ast.AST):
                    self.visit(x)
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        full = ".".join([*self.scope, node.name])
        self._row("function", node.name, full, node, bool(self.scope), [a.arg for a in node.args.args], json.dumps(statements(node.body)))
        self._inside(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._row("class", node.name, ".".join([*self.scope, node.name]), node, False, [b for x in node.bases if (b := dotted(x))])
        self._inside(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._row("import", a.asname or a.name, a.name, node, False, [])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names if node.module else []:
            self._row("import", a.asname or a.name, f"{node.module}.{a.name}", node, False, [], "from")

    def visit_Call(self, node: ast.Call) -> None:
        if name := dotted(node.func):
            self._row("call", name.rsplit(".", 1)[-1], name, node, False, [x or "" for x in map(plain, node.args)], ".".join(self.scope))
        self.generic_visit(node)


def parse(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for Python files (path, source); a file that doesn't parse has one row of kind parse_error.

    Qualified names are scopes within the file; parameters are the positional ones; relative imports without a module
    are left out; null sources count as empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, source in zip(f["path"], f["source"], strict=True):
                try:
                    tables = _Tables(path)
                    tables.visit(ast.parse(source or ""))
                    rows += tables.rows
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append([path, "parse_error", "", "", getattr(e, "lineno", 0) or 0, 0, False, [], str(e), 0])
            yield pd.DataFrame(rows, columns=["file", "kind", "name", "fullname", "line", "end_line", "is_method", "params", "detail", "ordinal"])

    return files.select("path", "source").mapInPandas(run, SCHEMA)
