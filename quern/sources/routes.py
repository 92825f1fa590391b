"""Route parsers: handler methods of controllers and URL calls of front ends, line by line with a look at the lines before."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks controllers, mappings, permissions and calls.
CONTROLLER = re.compile(r"@(RequestMapping|RestController|Controller)\b")
MAPPING = re.compile(r'@(GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)\s*\(\s*(?:"([^"]*)"|\'([^\']*)\'|path\s*=\s*"?([^")\s]+))?')
CLASS_MAPPING = re.compile(r'@RequestMapping\s*\(\s*(?:"([^"]*)"|\'([^\']*)\'|value\s*=\s*"?([^")\s]+))?')
CLASS_NAME = re.compile(r"(?:public\s+)?(?:class|object)\s+(\w+)")
METHOD_NAME = re.compile(r"(?:public|private|protected|fun)\s+(?:\w+\s+)*(\w+)\s*\(")
PERMISSION, OUTDATED = "@PreAuthorize", re.compile("@Deprecated|@deprecated")
PUBLIC = re.compile("公开访问|公开|permitAll|no auth|不需要权限|不需要验证|匿名访问", re.IGNORECASE)
URL = [re.compile(r"url\s*:\s*['\"`]([^'\"`]+)['\"`]"), re.compile(r"(?:fetch|axios\.(?:get|post|put|delete))\s*\(\s*['\"`]([^'\"`]+)['\"`]")]
FUNCTION = [re.compile(r"export\s+(?:default\s+)?function\s+(\w+)"), re.compile(r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?")]
TEMPLATE = re.compile(r"\$\{[^}]+\}")
NEAR, FAR, AHEAD = 8, 15, 10

ENDPOINTS = "file string, line int, http_method string, path string, class string, method string, pre_authorize boolean, deprecated boolean, says_public boolean"
CALLS = "file string, line int, function string, url string, resolved string"


def joined(first: str, second: str) -> str:
    """A class's and a method's path as one; a method's path that begins with the class's stands alone."""
    a, b = first.strip("/"), second.strip("/")
    if not a or not b or b.startswith(a):
        return "/" + (b or a)
    return f"/{a}/{b}"


def var_name(template: str) -> str:
    """The variable of ``${x.y}``: its last part."""
    return template.strip("${} ").split(".")[-1]


def endpoints_of(source: str) -> list[tuple]:
    """(line, http method, path, class, method, has a permission, is deprecated, is said to be public) of a controller's handlers."""
    if not CONTROLLER.search(source):
        return []
    lines = source.split("\n")
    first = lambda found: next((g for g in found.groups()[-3:] if g), "") if found else ""
    prefix = first(next((m for x in lines if (m := CLASS_MAPPING.search(x))), None))
    owner = next((m.group(1) for x in lines if (m := CLASS_NAME.search(x))), "Unknown")
    out = []
    for i, line in enumerate(lines):
        found = MAPPING.search(line)
        if line.strip().startswith(("//", "*")) or not found:
            continue
        verb = found.group(1).upper().replace("MAPPING", "").replace("REQUEST", "") or "GET"
        before = []
        for x in reversed(lines[max(0, i - NEAR) : i]):
            before.append(x.strip())
            if before[-1] not in ("", "{") and not before[-1].startswith(("//", "*", "@")):
                break
        public = any(PUBLIC.search(x) for x in [*before, *lines[max(0, i - FAR) : i]])
        method = next((m.group(1) for x in lines[i : i + AHEAD] if (m := METHOD_NAME.search(x))), "unknown")
        out.append((i + 1, verb, joined(prefix, first(found)), owner, method, any(PERMISSION in x for x in before), any(OUTDATED.search(x) for x in before), public))
    return out


def url_calls_of(path: str, source: str) -> list[tuple]:
    """(line, function, url, resolved) of a front end's file: URL patterns under the last function named before them."""
    if "/api/" not in path.replace("\\", "/") and not re.search(r"url\s*:", source):
        return []
    out, function = [], ""
    for i, line in enumerate(source.split("\n")):
        if named := FUNCTION[0].search(line) or FUNCTION[1].search(line):
            function = named.group(1)
        if found := URL[0].search(line) or URL[1].search(line):
            out.append((i + 1, function, found.group(1), TEMPLATE.sub(lambda m: ":" + var_name(m.group(0)), found.group(1))))
    return out


def _each(files: DataFrame, names: Column, schema: str, parse) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(path, *row) for path, source in zip(f["path"], f["source"], strict=True) for row in parse(path, source or "")], columns=columns)

    return files.select("path", "source").filter(names).mapInPandas(run, schema)


def controllers(files: DataFrame) -> DataFrame:
    """Endpoints of the Java and Kotlin files (path, source); null paths and sources and files that are no controller have none."""
    return _each(files, F.col("path").rlike(r"\.(java|kt)$"), ENDPOINTS, lambda path, source: endpoints_of(source))


def frontend_calls(files: DataFrame) -> DataFrame:
    """URL calls of the JavaScript, TypeScript and Vue files (path, source)."""
    return _each(files, F.col("path").rlike(r"\.(js|ts|vue)$"), CALLS, url_calls_of)
