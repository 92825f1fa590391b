"""Attacker-control validators: six checks of findings against the files they are in, three blocking (P0) and three scoring (P1)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Path patterns and vocabularies of Python code.
TEST_PATTERNS = ["test_*.py", "*_test.py", "*_test_*.py", "conftest.py", "*/tests/*.py", "*/test_*.py", "*/test/*.py"]
COMPILER_PATTERNS = ["setup.py", "setup.cfg", "*/setup.py", "conftest.py", "*/migrations/*.py", "*/management/commands/*.py"]
STARTUP_PATTERNS = ["manage.py", "app.py", "wsgi.py", "asgi.py", "*/settings.py", "*/urls.py", "*/apps.py"]
INPUT_APIS = [
    "sys.argv", "input", "os.environ", "os.getenv", "flask.request", "request.GET", "request.POST", "request.data", "request.json", "request.args", "request.form", "request.headers", "request.cookies", "request.files",
    "fastapi.Request", "fastapi.Request.query_params", "fastapi.Request.body", "django.http.HttpRequest", "django.http.request.HttpRequest", "starlette.requests.Request", "argparse", "click.argument", "click.option", "typer.Argument", "typer.Option",
]
ENTRY_POINTS = [
    "@app.route", "@app.get", "@app.post", "@app.put", "@app.delete", "@app.patch", "@blueprint.route", "@blueprint.get", "@blueprint.post", "@router.get", "@router.post", "@router.put", "@router.delete", "@router.patch",
    "def main(", "asgi_app", "wsgi_app", "def handle(", "def handler(", "def on_message(", "def on_event(",
]
VALIDATION_FUNCTIONS = [
    "isinstance", "issubclass", "hasattr", "getattr", "validate", "validator", "validate_input", "validate_request", "sanitize", "sanitize_input", "clean", "clean_input", "escape", "shlex.quote", "shlex.escape", "html.escape", "re.escape",
    "django.utils.html.escape", "flask.escape", "markupsafe.escape", "bleach.clean", "bleach.linkify", "pydantic.BaseModel", "pydantic.validate_call", "marshmallow.Schema", "cerberus.Validator", "schema.Schema",
]
#: The same of Java code, with marks in the text.
JAVA_TEST_PATTERNS = ["*/src/test/java/**/*.java", "*/src/test/*.java", "*Test.java", "*Tests.java", "*TestCase.java", "*/test/**/*.java"]
JAVA_COMPILER_PATTERNS = ["pom.xml", "build.gradle", "build.gradle.kts", "*/pom.xml", "*/build.gradle", "settings.gradle", "settings.gradle.kts"]
JAVA_STARTUP_PATTERNS = ["*Application.java", "*Main.java", "*/src/main/java/**/ServletInitializer.java"]
JAVA_TEST_MARKS = ["@Test", "@org.junit.jupiter.api.Test", "import org.junit", "import org.testng", "import org.mockito", "@ParameterizedTest", "@ExtendWith", "@SpringBootTest", "@WebMvcTest", "@DataJpaTest", "extends TestCase"]
JAVA_COMPILER_MARKS = ["@Mojo", "@Parameter(defaultValue", "abstract class AbstractMojo", "implements Plugin", "extends DefaultMojo"]
JAVA_STARTUP_MARKS = [
    "SpringApplication.run", "SpringApplicationBuilder", "public static void main(String[]", "implements CommandLineRunner", "implements ApplicationRunner", "@PostConstruct", "InitializingBean", "ApplicationListener",
    "implements ServletContainerInitializer", "WebApplicationInitializer",
]
JAVA_INPUT_APIS = [
    "HttpServletRequest", "ServletRequest", "request.getParameter", "request.getQueryString", "request.getHeader", "request.getCookies", "request.getInputStream", "request.getReader", "request.getPart", "request.getParts", "getServletContext",
    "@RequestParam", "@PathVariable", "@RequestBody", "@RequestHeader", "@CookieValue", "@RequestAttribute", "@ModelAttribute", "@RequestPart", "@MatrixVariable", "ServerHttpRequest", "ServerWebExchange",
    "@QueryParam", "@PathParam", "@HeaderParam", "@CookieParam", "@FormParam", "@MatrixParam", "@Context",
    "System.getenv", "System.getProperty", "System.console", "Scanner(System.in", "BufferedReader(System.in", "Console.readLine", "java.util.Scanner", "MultipartFile", "Part",
]
JAVA_ENTRY_POINTS = [
    "@RequestMapping", "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@PatchMapping", "@RestController", "@Controller", "@GET", "@POST", "@PUT", "@DELETE", "@PATCH", "@Path", "@ApplicationPath", "@Provider",
    "@WebServlet", "@WebFilter", "@WebListener", "extends HttpServlet", "implements Filter", "implements Servlet", "@ServerEndpoint", "implements WebSocketHandler",
    "@JmsListener", "@RabbitListener", "@KafkaListener", "@StreamListener", "@EventListener", "implements MessageHandler", "implements ChannelInterceptor", "implements GatewayFilter", "implements GlobalFilter", "@Scheduled",
]
JAVA_VALIDATION_FUNCTIONS = [
    "@Valid", "@Validated", "javax.validation", "jakarta.validation", "@NotNull", "@NotEmpty", "@NotBlank", "@Size", "@Min", "@Max", "@Email", "@Pattern", "@AssertTrue",
    "org.springframework.validation", "Errors", "BindingResult", "Validator", "validate", "validateObject", "ValidationUtils", "org.springframework.validation.Validator",
    "org.owasp.esapi", "ESAPI.validator", "Validator.getValidInput", "Validator.isValidInput", "Validator.getValidSafeHTML", "Encoder.encodeForHTML", "Encoder.encodeForJavaScript", "Encoder.encodeForSQL", "Encoder.encodeForLDAP", "Encoder.encodeForOS", "Encoder.encodeForCSS", "Encoder.encodeForXML", "Encoder.encodeForXPath",
    "StringEscapeUtils", "org.apache.commons.lang3.StringEscapeUtils", "org.apache.commons.text.StringEscapeUtils", "org.apache.commons.validator", "GenericValidator", "UrlValidator", "EmailValidator",
    "com.google.common.html.HtmlEscapers", "com.google.common.net.UrlEscapers", "Preconditions.checkNotNull", "Preconditions.checkArgument", "org.hibernate.validator", "ConstraintValidator", "constraints",
    "@PreAuthorize", "@PostAuthorize", "@Secured", "SecurityContextHolder", "sanitize", "sanitizeInput", "cleanInput", "escapeHtml", "escapeSql", "filterInput", "stripXSS", "purify",
]
UNAUTHENTICATED = ["unauthenticated", "no auth", "public endpoint", "anonymous", "guest"]
PRECONDITIONS = ["authenticated", "authentication required", "logged in", "admin", "administrator", "authorization", "csrf token", "xsrf token", "rate limited", "rate_limit", "user interaction", "user clicks"]
RULE_CONTEXTS = {
    "sql-injection": ["select", "insert", "update", "delete", "from", "where", "execute"],
    "os-command-injection": ["exec", "system", "popen", "subprocess", "shell", "cmd"],
    "xss": ["html", "innerhtml", "outerhtml", "append", "write", "render", "template"],
    "path-traversal": ["open", "read", "write", "file", "path", "directory"],
    "ssrf": ["url", "fetch", "request", "http", "connection", "open"],
    "code-injection": ["eval", "exec", "compile", "function", "invoke"],
    "unsafe-deserialization": ["pickle", "unserialize", "deserialize", "yaml", "xml"],
    "jndi-injection": ["lookup", "jndi", "ldap", "rmi"],
    "xxe": ["xml", "documentbuilder", "saxparser", "saxbuilder"],
}
RUNNERS = ("run", "start", "main", "serve")


def path_matches(path: Column, patterns: list[str]) -> Column:
    """Whether the path's last components match one of the globs, or one of them stands in the path literally."""
    out = F.lit(False)
    for p in patterns:
        glob = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c for c in p)
        out = out | path.rlike(f"(^|/){glob}$") | path.contains(p)
    return out


def code_kinds(files: DataFrame) -> DataFrame:
    """(path, is_test, is_compiler, is_startup, is_production) of Python files (path, source).

    By path, and by the code: a file is a test if it imports pytest or unittest, build code if something is decorated with
    ``requires_debug``, startup code if it calls a runner (``x.run()``) at the top level. What doesn't parse goes by its path alone. Production
    code is what is neither test nor build code. Null sources are empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, source in zip(f["path"], f["source"], strict=True):
                try:
                    module = ast.parse(source or "")
                except (SyntaxError, ValueError, RecursionError):
                    rows.append([path, False, False, False])
                    continue
                test = build = False
                for n in ast.walk(module):
                    if isinstance(n, ast.Import):
                        test |= any(a.name in ("pytest", "unittest") for a in n.names)
                    elif isinstance(n, ast.ImportFrom):
                        test |= (n.module or "").split(".")[0] == "pytest"
                    elif isinstance(n, ast.FunctionDef | ast.ClassDef):
                        build |= any(isinstance(d, ast.Name) and d.id == "requires_debug" for d in n.decorator_list)
                calls = [n.value.func for n in module.body if isinstance(n, ast.Expr) and isinstance(n.value, ast.Call)]
                rows.append([path, test, build, any(isinstance(c, ast.Attribute) and c.attr in RUNNERS for c in calls)])
            yield pd.DataFrame(rows, columns=["path", "t", "b", "s"])

    facts = files.select("path", "source").mapInPandas(run, "path string, t boolean, b boolean, s boolean")
    path = F.col("path")
    test, build = path_matches(path, TEST_PATTERNS) | F.col("t"), path_matches(path, COMPILER_PATTERNS) | F.col("b")
    startup = path_matches(path, STARTUP_PATTERNS) | F.col("s")
    return facts.select("path", test.alias("is_test"), build.alias("is_compiler"), startup.alias("is_startup"), (~test & ~build).alias("is_production"))


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def java_code_kinds(files: DataFrame) -> DataFrame:
    """(path, is_test, is_compiler, is_startup, is_production) of Java files (path, source), by path and by marks in the text; native."""
    path, text = F.col("path"), F.coalesce("source", F.lit(""))
    test = path_matches(path, JAVA_TEST_PATTERNS) | _any(text, JAVA_TEST_MARKS)
    build = path_matches(path, JAVA_COMPILER_PATTERNS) | _any(text, JAVA_COMPILER_MARKS)
    startup = path_matches(path, JAVA_STARTUP_PATTERNS) | _any(text, JAVA_STARTUP_MARKS)
    return files.select("path", test.alias("is_test"), build.alias("is_compiler"), startup.alias("is_startup"), (~test & ~build).alias("is_production"))


def verdicts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each finding and validator: the columns of ``findings`` with validator, priority (P0 or P1) and passed.

    ``findings``: id, file_path, line_number, rule_id, source_rule_name, source_info, detail, description, taint_source, taint_sink,
    chain (number of calls); ``files``: path (one row each), source. Nulls count as empty. A file that isn't there fails the execution
    context as P0; startup code fails it as P1. Vocabularies are those of Java for files that end in .java, else of Python. Everything is native
    but the reading of Python code in ``code_kinds``.
    """
    is_java = F.coalesce(F.col("path").endswith(".java"), F.lit(False))
    kinds = code_kinds(files.filter(~is_java)).unionByName(java_code_kinds(files.filter(is_java))).join(files.select("path", "source"), "path")
    held = findings.join(kinds.withColumnRenamed("path", "file_path"), "file_path", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    source, there = text("source"), F.col("is_test").isNotNull()
    info, name, rule = text("source_info"), text("source_rule_name"), text("rule_id")
    detail = F.when(text("detail") != "", text("detail")).otherwise(text("description"))
    tainted, sunk = text("taint_source") != "", text("taint_sink") != ""
    spoken = F.concat_ws(" ", text("description"), text("detail"))
    low = F.lower(spoken)

    java = F.coalesce(F.col("file_path").endswith(".java"), F.lit(False))
    told = lambda text, python, other: F.when(java, _any(text, other)).otherwise(_any(text, python))
    inputs = lambda text: told(text, INPUT_APIS, JAVA_INPUT_APIS)
    entries = lambda text: told(text, ENTRY_POINTS, JAVA_ENTRY_POINTS)
    checks = lambda text: told(text, VALIDATION_FUNCTIONS, JAVA_VALIDATION_FUNCTIONS)

    context = there & ~F.col("is_test") & ~F.col("is_compiler")
    startup = context & F.col("is_startup")
    boundary = inputs(name) | inputs(info) | inputs(detail) | entries(info) | entries(detail) | entries(source) | tainted
    outside = (tainted & sunk) | entries(spoken) | entries(source) | (F.coalesce("chain", F.lit(0)) > 0)
    line = F.coalesce(F.col("line_number"), F.lit(0))
    lines = F.split(source, "\n")
    first = F.greatest(line - 20, F.lit(0))
    near = F.when((line > 0) & (F.size(lines) > first), F.array_join(F.slice(lines, (first + 1).cast("int"), (line + 5 - first).cast("int")), "\n")).otherwise("")
    checked = checks(near) | checks(F.concat(text("description"), text("detail")))
    open_ = _any(low, UNAUTHENTICATED) | ~_any(low, PRECONDITIONS)
    kind = F.lower(rule)
    for part in ("taint-to-", "python-", "reflective-"):
        kind = F.replace(kind, F.lit(part), F.lit(""))
    fits = F.lit(True)
    for r, words in RULE_CONTEXTS.items():
        fits = F.when(kind == r, _any(F.lower(text("description")), words)).otherwise(fits)
    tests = [
        ("execution_context", F.when(startup, "P1").otherwise("P0"), context & ~startup),
        ("trust_boundary", F.lit("P0"), boundary),
        ("external_reachability", F.lit("P0"), outside),
        ("validation_chain", F.lit("P1"), checked),
        ("thread_model", F.lit("P1"), open_),
        ("semantic_pattern", F.lit("P1"), fits),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("validator"), p.alias("priority"), F.coalesce(t, F.lit(False)).alias("passed")) for n, p, t in tests])
    return held.select(*findings.columns, F.inline(each))


def exploitability(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, is_controlled, score): 0.6 if no P0 check fails, and 0.4 times the share of P1 checks that pass, rounded to two places."""
    blocked = F.max((F.col("priority") == "P0").cast("int") * (~F.col("passed")).cast("int"))
    scored = F.sum((F.col("priority") == "P1").cast("int"))
    good = F.sum(((F.col("priority") == "P1") & F.col("passed")).cast("int"))
    score = F.round(0.6 * (1 - blocked) + 0.4 * good / F.greatest(scored, F.lit(1)), 2)
    return checks.groupBy(*keys).agg((blocked == 0).alias("is_controlled"), score.alias("score"))
