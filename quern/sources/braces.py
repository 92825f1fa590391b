"""Java and JavaScript sources to the tables of ``python_code``: classes, functions, imports, calls and statements, by a scan of tokens.

No grammar is at hand, so this reads what braces, parentheses and keywords tell: declarations, the calls in bodies, and statements
cut at semicolons, braces and line ends. Comments and texts are skipped. What it can't tell apart (a generic method call of a name
that looks like a declaration, say) isn't reported.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .python_code import SCHEMA

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|===?|!==?|[<>]=|[+\-*/%&|^]=|\n|\S", re.S)
_NAME = re.compile(r"[A-Za-z_$][\w$]*$")
_NOT_FUNCTIONS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "throw", "else", "do", "try", "typeof", "await", "super", "synchronized", "assert"}
_CLASSES = {"java": {"class", "interface", "enum", "record"}, "javascript": {"class"}}
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default"}


class _Scan:
    def __init__(self, file: str, source: str, language: str):
        self.file, self.language, self.rows = file, language, []
        self.tokens: list[tuple[str, int]] = []
        line = 1
        for m in _TOKEN.finditer(source):
            text = m.group(0)
            if not text.startswith(("//", "/*")):
                self.tokens.append((text, line))
            elif "\n" in text:
                self.tokens.append(("\n", line))
            line += text.count("\n")
        self.code = [t for t in self.tokens if t[0] != "\n"]
        self.partner = self._partners(self.code)

    @staticmethod
    def _partners(tokens: list[tuple[str, int]]) -> dict[int, int]:
        """The place of the closing bracket of each opening one."""
        out, open_ = {}, []
        for i, (t, _) in enumerate(tokens):
            if t in "([{" and len(t) == 1:
                open_.append(i)
            elif t in ")]}" and len(t) == 1 and open_:
                out[open_.pop()] = i
        return out

    def row(self, kind: str, name: str, full: str, line: int, end: int, method: bool, params: list[str], detail: str = "") -> None:
        self.rows.append([self.file, kind, name, full, line, end, method, params, detail, len(self.rows)])

    def text(self, i: int) -> str:
        return self.code[i][0] if 0 <= i < len(self.code) else ""

    def chain_back(self, i: int) -> str:
        """The dotted name that ends with token ``i``."""
        parts = [self.text(i)]
        while self.text(i - 1) == "." and _NAME.match(self.text(i - 2)):
            parts = [self.text(i - 2), *parts]
            i -= 2
        return ".".join(parts)

    def params(self, a: int, b: int) -> list[tuple[str, str]]:
        """(name, its tokens) of the parameters between the places of two parentheses."""
        out, depth, held = [], 0, []
        for i in range(a + 1, b + 1):
            t = self.text(i)
            depth += (t in ("<", "(", "[", "{")) - (t in (">", ")", "]", "}") and i < b)
            if (t == "," and depth <= 0) or i == b:
                names = [x for x in held if _NAME.match(x)]
                if "=" in held:
                    names = [x for x in held[: held.index("=")] if _NAME.match(x)]
                if names:
                    out.append((names[-1], " ".join(held)))
                held = []
            else:
                held.append(t)
        return out

    def run(self) -> list[list]:
        scopes: list[tuple[int, str, bool]] = []  # where it ends, name, is a class
        marks: list[str] = []
        i = 0
        while i < len(self.code):
            t, line = self.code[i]
            scopes = [s for s in scopes if s[0] > i]
            owner = ".".join(s[1] for s in scopes if s[1])
            if t == "@" and self.language == "java" and _NAME.match(self.text(i + 1)) and self.text(i + 1) != "interface":
                end = self.partner.get(i + 2, i + 1) if self.text(i + 2) == "(" else i + 1
                marks.append("@" + "".join(x for x, _ in self.code[i + 1 : end + 1]))
                i = end + 1
                continue
            if t == "import" and self.text(i - 1) in ("", ";", "}") or t == "import" and not scopes:
                i = self.imported(i, line)
                continue
            if t in _CLASSES[self.language] and _NAME.match(self.text(i + 1)) and self.text(i - 1) != ".":
                body = next((k for k in range(i + 2, min(i + 200, len(self.code))) if self.text(k) in ("{", ";")), None)
                if body is not None and self.text(body) == "{":
                    name, heads = self.text(i + 1), [self.text(k) for k in range(i + 2, body)]
                    bases = [x for x in heads if _NAME.match(x) and x not in ("extends", "implements", "permits")] if {"extends", "implements"} & set(heads) else []
                    end = self.partner.get(body, len(self.code) - 1)
                    self.row("class", name, f"{owner}.{name}".lstrip("."), line, self.code[end][1], False, bases, " ".join(marks))
                    scopes.append((end, name, True))
                    marks, i = [], body + 1
                    continue
            found = self.function(i, scopes)
            if found:
                name, given, body, end, start_of_body = found
                inside = bool(scopes and scopes[-1][2])
                detail = statements(self, start_of_body, end, self.seeds(given, marks))
                self.row("function", name, f"{owner}.{name}".lstrip("."), line, self.code[min(end, len(self.code) - 1)][1], inside, [n for n, _ in given], json.dumps(detail))
                for mark in marks:
                    self.row("decorator", mark.split("(")[0], f"{owner}.{name}".lstrip("."), line, line, inside, [], mark)
                scopes.append((end, name, False))
                marks, i = [], body
                continue
            if t in (";", "}"):
                marks = []
            if _NAME.match(t) and self.text(i + 1) == "(" and t not in _NOT_FUNCTIONS:
                self.row("call", t, self.chain_back(i), line, line, False, [], owner)
            i += 1
        return self.rows

    def seeds(self, given: list[tuple[str, str]], marks: list[str]) -> list[tuple[str, str]]:
        """Parameters that are sources: all of JavaScript's; those of mapped handlers in Java."""
        if self.language == "javascript":
            return [(n, "param") for n, _ in given]
        if any(m.split("(")[0].endswith("Mapping") for m in marks):
            return [(n, next(("@" + m.group(1) for m in [re.search(r"@ (\w+)", text)] if m), "@RequestParam")) for n, text in given]
        return []

    def imported(self, i: int, line: int) -> int:
        end = next((k for k in range(i, len(self.code)) if self.text(k) == ";" or (k > i and self.code[k][1] != self.code[k - 1][1] and self.text(k - 1) not in (",", "{"))), len(self.code))
        part = [self.text(k) for k in range(i + 1, end)]
        if self.language == "java":
            full = "".join(x for x in part if x != "static")
            self.row("import", full, full, line, line, False, [])
            self.row("import", full.rsplit(".", 1)[-1], full, line, line, False, [], "from")
            return end + 1
        module = next((x[1:-1] for x in reversed(part) if x[:1] in "'\""), "")
        names = [x for x in part if _NAME.match(x) and x != "from"]
        k = 0
        while k < len(names):
            if k + 2 < len(names) + 0 and names[k + 1 : k + 2] == ["as"]:
                self.row("import", names[k + 2], f"{module}.{names[k]}", line, line, False, [], "from")
                k += 3
                continue
            if names[k] == "as" and k + 1 < len(names):  # * as name
                self.row("import", names[k + 1], module, line, line, False, [])
                k += 2
                continue
            braced = "{" in part and part.index(names[k]) > part.index("{")
            self.row("import", names[k], f"{module}.{names[k]}" if braced else module, line, line, False, [], "from" if braced else "")
            k += 1
        if not names and module:
            self.row("import", module, module, line, line, False, [])
        return end + (self.text(end) == ";")

    def function(self, i: int, scopes: list[tuple[int, str, bool]]) -> tuple | None:
        """(name, parameters, where to go on, where it ends, where its body begins) of a function that token ``i`` declares."""
        t, nxt = self.text(i), self.text(i + 1)
        in_class = bool(scopes and scopes[-1][2])
        if not _NAME.match(t) or t in _NOT_FUNCTIONS - {"function"}:
            return None
        if self.language == "java":
            if not in_class or nxt != "(" or self.text(i - 1) in (".", "new", "=", "(", ",", "return", "@"):
                return None
            made = t == scopes[-1][1] and (self.text(i - 1) in _MODIFIERS | {"{", "}", ";", ")", ">"} or i == 0)
            if not made and not (_NAME.match(self.text(i - 1)) or self.text(i - 1) in (">", "]")) or self.text(i - 1) in _MODIFIERS and not made:
                return None
            close = self.partner.get(i + 1)
            body = next((k for k in range((close or i) + 1, min((close or i) + 60, len(self.code))) if self.text(k) in ("{", ";", "=")), None)
            if close is None or body is None or self.text(body) == "=":
                return None
            end = self.partner.get(body, len(self.code) - 1) if self.text(body) == "{" else body
            return "<init>" if made else t, self.params(i + 1, close), body + 1, end, body + 1
        if t == "function" and _NAME.match(self.text(i + 1 + (nxt == "*"))):
            at = i + 1 + (nxt == "*")
            return self._body(self.text(at), at + 1)
        if in_class and nxt == "(" and self.text(i - 1) not in (".", "new", "="):
            return self._body(t, i + 1)
        if nxt == "=" and self.text(i - 1) != ".":
            at = i + 2 + (self.text(i + 2) == "async")
            if self.text(at) == "require" and self.text(at + 1) == "(" and self.text(at + 2)[:1] in "'\"":
                self.row("import", t, self.text(at + 2)[1:-1], self.code[i][1], self.code[i][1], False, [])
                return None
            if self.text(at) == "function":
                at += 1 + bool(_NAME.match(self.text(at + 1)))
                return self._body(t, at)
            if self.text(at) == "(" and self.text(self.partner.get(at, at) + 1) == "=>":
                return self._body(t, at, 1)
            if _NAME.match(self.text(at)) and self.text(at + 1) == "=>":
                body = at + 2
                end = self.partner.get(body, body) if self.text(body) == "{" else self._line_end(body)
                return t, [(self.text(at), self.text(at))], body + (self.text(body) == "{"), end, body + (self.text(body) == "{")
        return None

    def _body(self, name: str, paren: int, skip: int = 0) -> tuple | None:
        close = self.partner.get(paren)
        if self.text(paren) != "(" or close is None:
            return None
        body = close + 1 + skip
        if self.text(body) == "{":
            return name, self.params(paren, close), body + 1, self.partner.get(body, len(self.code) - 1), body + 1
        if not skip:
            return None
        return name, self.params(paren, close), body, self._line_end(body), body

    def _line_end(self, i: int) -> int:
        k = i
        while k < len(self.code) and self.text(k) != ";" and (k == i or self.code[k][1] == self.code[k - 1][1]):
            k = self.partner.get(k, k) + 1 if self.text(k) in ("(", "[", "{") else k + 1
        return k


def _chain(texts: list[str]) -> tuple[str, int]:
    """The dotted name, with its calls and subscripts, that a list of tokens begins with, and how many it takes."""
    k = 0
    while k < len(texts) and texts[k] in ("new", "await", "("):
        k += 1
    if k >= len(texts) or not _NAME.match(texts[k]):
        return "", 0
    out, k = texts[k], k + 1
    while k < len(texts):
        if texts[k] == "." and k + 1 < len(texts) and _NAME.match(texts[k + 1]):
            out, k = f"{out}.{texts[k + 1]}", k + 2
        elif texts[k] in ("(", "["):
            close, depth = k, 0
            while close < len(texts):
                depth += (texts[close] in ("(", "[", "{")) - (texts[close] in (")", "]", "}"))
                if depth == 0:
                    break
                close += 1
            out, k = out + ("(...)" if texts[k] == "(" else "[?]"), close + 1
        else:
            break
    return out, k


def _identifiers(texts: list[str]) -> list[str]:
    """Names and dotted names in tokens, those in template strings included."""
    out = []
    for i, t in enumerate(texts):
        if t.startswith("`"):
            out += re.findall(r"\$\{\s*([\w$.]+)", t)
        elif _NAME.match(t) and (i == 0 or texts[i - 1] != "."):
            name, k = t, i + 1
            out.append(name)
            while k + 1 < len(texts) and texts[k] == "." and _NAME.match(texts[k + 1]):
                name = f"{name}.{texts[k + 1]}"
                out.append(name)
                k += 2
    return out


def statements(scan: _Scan, a: int, b: int, seeds: list[tuple[str, str]]) -> list[dict]:
    """Assignments and calls of a body in order; an argument is the names in it. A value put into innerHTML or outerHTML is a call of that name."""
    line = scan.code[a][1] if a < len(scan.code) else 0
    out = [{"do": "seed", "line": line, "target": n, "source": s} for n, s in seeds]

    def call(texts: list[str], at: int) -> None:
        while texts and texts[0] in ("new", "await", "return"):
            texts = texts[1:]
        for k, t in enumerate(texts):
            if t == "(" and k and _NAME.match(texts[k - 1]):
                name = texts[k - 1]
                j = k - 1
                while j >= 2 and texts[j - 1] == "." and _NAME.match(texts[j - 2]):
                    name = f"{texts[j - 2]}.{name}"
                    j -= 2
                given, depth, held = [], 0, []
                for x in texts[k + 1 :]:
                    depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
                    if depth < 0:
                        break
                    if x == "," and depth == 0:
                        given.append(held)
                        held = []
                    else:
                        held.append(x)
                if held:
                    given.append(held)
                if name not in _NOT_FUNCTIONS:
                    out.append({"do": "call", "line": at, "call": name, "args": [_identifiers(g) for g in given], "kwargs": []})

    def tell(held: list[tuple[str, int]]) -> None:
        texts, at = [t for t, _ in held], held[0][1]
        if "=" in texts and texts[0] not in ("if", "while", "for"):
            k = texts.index("=")
            left, value = texts[:k], texts[k + 1 :]
            target, j = "", k
            while j and (_NAME.match(left[j - 1]) or left[j - 1] == "."):
                if target and not target.startswith(".") and left[j - 1] != ".":
                    break
                target, j = left[j - 1] + target, j - 1
            call(value, at)
            begins, used = _chain(value)
            if target:
                out.append({"do": "assign", "line": at, "target": target, "begins": begins, "value": begins if used == len(value) else None, "names": _identifiers(value)})
                if target.endswith((".innerHTML", ".outerHTML")):
                    out.append({"do": "call", "line": at, "call": target, "args": [_identifiers(value)], "kwargs": []})
        elif texts[0] not in ("if", "while", "for", "return", "switch", "else"):
            call(texts, at)

    held: list[tuple[str, int]] = []
    depth = 0
    for i in range(a, min(b, len(scan.code))):
        t, at = scan.code[i]
        ended = held and scan.language == "javascript" and at != held[-1][1] and depth == 0 and held[-1][0] not in (",", "=", "+", "(", "=>", ".") and t not in (".", ",", ")", "+")
        if ended or (t in (";", "{", "}") and depth == 0):
            if held:
                tell(held)
            held = []
            if t in (";", "{", "}"):
                continue
        depth += (t in ("(", "[")) - (t in (")", "]"))
        held.append((t, at))
    if held:
        tell(held)
    return out


def parse(files: DataFrame) -> DataFrame:
    """Rows of ``python_code``'s schema for Java and JavaScript files (path, source), with rows of kind decorator for annotations of Java methods.

    Null sources count as empty; files of other endings have no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, source in zip(f["path"], f["source"], strict=True):
                rows += _Scan(path, source or "", "java" if path.endswith(".java") else "javascript").run()
            yield pd.DataFrame(rows, columns=["file", "kind", "name", "fullname", "line", "end_line", "is_method", "params", "detail", "ordinal"])

    return files.select("path", "source").filter(F.col("path").rlike(r"\.(java|js|jsx|ts|tsx)$")).mapInPandas(run, SCHEMA)
