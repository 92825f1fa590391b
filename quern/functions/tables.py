"""Rule tables of the classifiers.

All values here are fixed values: they must equal those of the programs whose results the engine matches.
"""

# Sinks by exact name or dotted ending; the first that matches decides.
EXACT_SINKS = [
    *[(name, "rce") for name in ("exec", "eval", "__import__", "os.system", "os.popen", "subprocess.call", "subprocess.Popen", "subprocess.run", "subprocess.check_call", "subprocess.check_output", "subprocess.getoutput", "subprocess.getstatusoutput", "popen", "check_output")],
    *[(name, "rce") for name in ("pickle.loads", "pickle.load", "cloudpickle.loads", "cloudpickle.load", "yaml.load", "yaml.unsafe_load", "marshal.loads", "marshal.load")],
    *[(name, "lfi") for name in ("open", "pathlib.Path.open", "pathlib.Path.read_text", "pathlib.Path.read_bytes", "file")],
    *[(name, "ssrf") for name in ("urlopen", "urlretrieve", "urllib.request.urlopen", "urllib.request.urlretrieve", "httpx.Client", "httpx.AsyncClient", "aiohttp.ClientSession")],
    *[(name, "sqli") for name in ("execute", "executemany", "executescript")],
    *[(name, "xss") for name in ("render_template_string", "Markup")],
    *[(name, "afo") for name in ("pathlib.Path.write_text", "pathlib.Path.write_bytes", "shutil.copy", "shutil.move", "os.remove", "os.unlink")],
    *[(name, "redos") for name in ("glob", "fnmatch.translate", "fnmatch.filter", "re.match", "re.search", "re.findall", "re.fullmatch", "re.sub", "re.compile")],
    ("compile", "rce"),
]
# Sinks by pattern on the whole name, letter case ignored.
SINK_REGEX = [
    (r"^(?:safe_|unsafe_)?exec(?:ute(?:_command)?)?$", "rce"),
    (r"^(?:safe_|unsafe_)?eval$", "rce"),
    (r"^popen$", "rce"),
    (r"^system$", "rce"),
    (r"^(read|read_file|read_text|read_bytes|load_file|get_file)$", "lfi"),
    (r"^(fetch|http_request|make_request|do_request)$", "ssrf"),
    (r"^(query|raw_query|run_query|native_query|execute_query)$", "sqli"),
]
ENTRY_POINTS = [r"(?i)^(get|post|put|delete|patch|head|options)$", r"(?i)^handle_.*", r"(?i)^on_.*", r"(?i)^.*_handler$", r"(?i)^.*_route$", r"^main$", r"^run$", r"^serve$", r"^start$", r"^dispatch$"]
# Calls in a function's body; the first that matches decides.
SENSITIVE_CALLS = [
    *[(p, "suspicious") for p in (r"posixpath\.join", r"ntpath\.join", r"os\.path\.join", r"PurePosixPath", r"PureWindowsPath", r"pathlib\.PurePosixPath", r"zipfile\.Path")],
    *[(p, "afo") for p in (r"zipfile\.ZipFile", r"zipfile\.ZipFile\.extractall", r"zipfile\.ZipFile\.extract", r"tarfile\.open", r"tarfile\.extractall", r"pathlib\.Path\(.*\)\.write")],
    (r"io\.open", "lfi"),
    *[(p, "redos") for p in (r"re\.(match|search|findall|fullmatch|sub|compile|split)", r"fnmatch\.(translate|filter)")],
    *[(p, "rce") for p in (r"__import__", r"\bcompile\(", r"\beval\s*\(", r"\bexec\s*\(", r"os\.system\s*\(", r"os\.popen\s*\(", r"subprocess\.\w+\s*\(", r"pickle\.loads?\s*\(", r"cloudpickle\.loads?\s*\(")],
    (r"\bopen\s*\(", "lfi"),
    *[(p, "sqli") for p in (r"\bexecute\b", r"executemany\b")],
    *[(p, "ssrf") for p in (r"requests\.\w+\s*\(", r"urlopen\s*\(", r"httpx\.\w+\s*\(")],
]
PYTHON_SOURCES = ["request.GET", "request.POST", "request.data", "request.json", "request.args", "request.form", "request.headers", "request.cookies", "request.files", "flask.request", "fastapi.Request", "django.http.HttpRequest", "input", "sys.argv", "os.environ", "open"]
PYTHON_SINKS = {
    "eval": "critical",
    "exec": "critical",
    "compile": "high",
    "__import__": "medium",
    "pickle.loads": "critical",
    "pickle.load": "critical",
    "os.system": "critical",
    "os.popen": "critical",
    "subprocess.Popen": "high",
    "subprocess.run": "high",
    "subprocess.call": "high",
    "subprocess.check_output": "high",
    "subprocess.check_call": "high",
    "sqlite3.execute": "high",
    "sqlite3.executemany": "high",
    "sqlite3.executescript": "high",
    "open": "medium",
    "yaml.load": "high",
    "print": "low",
}
PYTHON_SANITIZERS = ["shlex.quote", "shlex.escape", "html.escape", "re.escape", "django.utils.html.escape", "flask.escape"]
NOISE_CALLS = [
    "print", "pprint", "printf", "echo", "write",
    "logging.info", "logging.debug", "logging.warning", "logging.error", "logging.critical", "logging.exception", "logging.log",
    "log.info", "log.debug", "log.warning", "log.error", "log.critical",
    "logger.info", "logger.debug", "logger.warning", "logger.error", "logger.critical",
    "system.out.println", "system.out.print", "system.out.printf", "system.err.println", "system.err.print", "system.err.printf",
    "console.log", "console.info", "console.debug", "console.warn", "console.error", "console.trace", "console.dir",
]
LOG_LEVELS = ["info", "debug", "warn", "warning", "error", "critical", "exception", "trace", "log"]
SANITIZER_TERMS = ["escape", "sanitize", "sanitise", "encode", "validate", "clean", "strip", "purify", "escape_string", "html.escape", "htmlentities", "strip_tags", "filter_var", "filter_input", "quote", "quote_plus", "urlencode"]
AUTH_TERMS = ["is_admin", "is_authenticated", "is_logged_in", "has_role", "has_permission", "has_access", "check_auth", "authorize", "login_required", "authenticate", "require_auth", "ensure_authenticated", "verify_user", "verify_session", "validate_session", "check_role", "check_permission", "verify_jwt", "verify_token", "validate_token", "require_login", "require_admin"]
EXCLUDED_DIR = r"(?i)(^|/)(test|tests|__pycache__|node_modules|\.git|gen(?:erated)?|vendor|third_party|migrations|mock)s?/"
VALIDATION = r"(?i)(sanitize|validate|escape|clean|purge|filter|check|verify|is_safe|is_valid)"
DEPTH_GUARDS = [
    r"\b(depth|level|n|nesting|count|limit)\s*(>=?|==)\s*\d",
    r"\b(depth|level|n|nesting|count|limit)\s*(>=?|==?)\s*[A-Z_]{2,}",
    r"\blen\s*\(\s*\w+\s*\)\s*[>:=]+\s*\d",
    r"\b(self\.|this\.)?\w*(depth|limit|level|bound)\s*(>=?|==)\s*\d",
    r"\b(max_depth|limit|max_nesting|max_level)\s*(<=|<|=)\s*\d",
    r"\b(getrecursionlimit|get_limit|max_depth)\s*\(",
    r"\bwhile\s+(stack|queue|q)\s*(:|\bnot\b)",
    r"\bRecursionError\b",
    r"\bif\s+(not\s+)?(\w+\s+is\s+None|\w+\s*(==|is)\s*None|len\(.*\)\s*==\s*0)\s*:",
]
BODY_SINKS = [
    ("shelve.open(", "shelve.open", "deserialization"),
    ("pickle.load(", "pickle.load", "deserialization"),
    ("pickle.loads(", "pickle.loads", "deserialization"),
    ("yaml.load(", "yaml.load", "deserialization"),
    ("subprocess.run(", "subprocess.run", "command_injection"),
    ("subprocess.Popen(", "subprocess.Popen", "command_injection"),
    ("os.system(", "os.system", "command_injection"),
    ("os.popen(", "os.popen", "command_injection"),
    ("eval(", "eval", "rce"),
    ("exec(", "exec", "rce"),
    ("zipfile.extractall(", "zipfile.extractall", "path_traversal"),
    ("tarfile.extractall(", "tarfile.extractall", "path_traversal"),
]
SINK_TYPES = {
    **dict.fromkeys(("shelve.open", "shelve.DbfilenameShelf", "pickle.load", "pickle.loads", "pickle.Unpickler", "yaml.load", "jsonpickle", "marshal.load", "marshal.loads"), "deserialization"),
    **dict.fromkeys(("eval", "exec", "compile"), "rce"),
    **dict.fromkeys(("os.system", "os.popen", "subprocess.Popen", "subprocess.run", "subprocess.call", "subprocess.check_output"), "command_injection"),
    **dict.fromkeys(("zipfile.extractall", "zipfile.extract", "tarfile.extractall", "tarfile.extract"), "path_traversal"),
}
SINK_TYPE_PARTS = [(("pickle", "shelve"), "deserialization"), (("eval", "exec"), "rce"), (("subprocess", "os.system", "os.popen"), "command_injection"), (("zipfile", "tarfile"), "path_traversal")]
RULE_IDS = {
    "eval": "python-code-injection",
    "exec": "code-injection",
    "compile": "python-code-injection",
    "__import__": "python-code-injection",
    **dict.fromkeys(("os.system", "os.popen", "subprocess.Popen", "subprocess.run", "subprocess.call", "subprocess.check_output", "subprocess.check_call"), "os-command-injection"),
    **dict.fromkeys(("sqlite3.execute", "sqlite3.executemany", "sqlite3.executescript"), "sql-injection"),
    **dict.fromkeys(("pickle.loads", "pickle.load", "yaml.load"), "unsafe-deserialization"),
    "open": "path-traversal",
    **dict.fromkeys(("innerHTML", "outerHTML", "insertAdjacentHTML", "document.write"), "xss"),
    "Function": "code-injection",
    **dict.fromkeys(("Runtime.exec", "ProcessBuilder", "ProcessBuilder.start"), "os-command-injection"),
    **dict.fromkeys(("Statement.executeQuery", "Statement.executeUpdate", "Statement.execute", "PreparedStatement.executeQuery", "PreparedStatement.executeUpdate", "PreparedStatement.execute"), "sql-injection"),
    **dict.fromkeys(("InitialContext.lookup", "Context.lookup"), "jndi-injection"),
    "Method.invoke": "reflective-injection",
    "ObjectInputStream.readObject": "unsafe-deserialization",
    **dict.fromkeys(("HttpURLConnection.connect", "URL.openConnection", "URL.openStream", "HttpClient.send", "RestTemplate.exchange"), "ssrf"),
    **dict.fromkeys(("DocumentBuilder.parse", "SAXParser.parse"), "xxe"),
}
EVIDENCE = {
    "lfi": [r"(?i)\bopen\s*\(", r"(?i)\.read\s*\(", r"pathlib\.Path", r"PurePosixPath|PureWindowsPath", r"os\.path\.join|posixpath\.join|ntpath\.join", r"read_text|read_bytes"],
    "rce": [r"(?i)\bexec\b", r"(?i)\beval\s*\(", r"(?i)subprocess\.", r"(?i)os\.system|os\.popen", r"(?i)pickle\.loads|pickle\.load|cloudpickle", r"(?i)yaml\.load(?!s)", r"__import__", r"(?i)\bcompile\s*\("],
    "redos": [r"(?i)re\.(match|search|sub|compile|findall|fullmatch|split)", r"(?i)fnmatch\.(translate|filter)", r"(?i)\bglob\b"],
    "afo": [r"(?i)\.write\s*\(", r"(?i)shutil\.\w+", r"(?i)os\.remove|os\.unlink|os\.rmdir", r"(?i)extractall|extract\s*\("],
    "ssrf": [r"(?i)urlopen|urlretrieve", r"(?i)httpx\.", r"(?i)aiohttp\.", r"(?i)requests\."],
    "sqli": [r"(?i)\bexecute\b", r"(?i)executemany|executescript"],
    "idor": [r"(?i)\.get\s*\(", r"(?i)\.filter\s*\(", r"(?i)objects\.|queryset", r"(?i)get_object_or_404"],
}
BRIDGE_SINKS = [
    (r"PurePosixPath|PureWindowsPath", "path_traversal"),
    (r"posixpath\.join|ntpath\.join|os\.path\.join", "path_traversal"),
    (r"\bopen\s*\(", "lfi"),
    (r"\.read\s*\(", "lfi"),
    (r"Path\(.*\)\.joinpath", "path_traversal"),
    (r"self\.root\.(open|extract)", "zip_entry_traversal"),
    (r"pathlib\.Path\b", "path_traversal"),
    (r"\.resolve\s*\(", "path_traversal"),
]
STORER_SOURCES = [r"(?i)namelist|iterdir|glob|rglob", r"(?i)user\s*input|request|query|param", r"(?i)\.get\s*\(|\.post\s*\(|\.put\s*\(|\.delete\s*\(", r"(?i)input\s*\(|sys\.argv|os\.environ", r"(?i)open\s*\(|read\s*\("]
PATH_BUILDERS = [r"PurePosixPath|PureWindowsPath", r"posixpath\.join|ntpath\.join|os\.path\.join", r"Path\(.*\)\.joinpath", r"pathlib\.Path\b", r"\.resolve\s*\(", r"\.parent\b"]
PATH_CONSUMERS = [
    *[(p, "lfi") for p in (r"\bopen\s*\(", r"\.read_text\s*\(", r"\.read_bytes\s*\(", r"\.write_text\s*\(", r"\.write_bytes\s*\(")],
    *[(p, "zip_entry_traversal") for p in (r"\.extractall?\s*\(", r"self\.root\.(open|extract)", r"zopen|ZipFile")],
    (r"re\.compile|re\.search|re\.match|re\.fullmatch|re\.sub|re\.findall", "redos"),
]
BRIDGE_NOTE = r"\[attr bridge:\s*self\.(\w+)\s+stored by\s+(\w+)\s*→\s*read by\s+(\w+)\]"
HIGH_GLOBS = ["*security*", "*auth*", "*login*", "*oauth*", "*jwt*", "*token*", "*permission*", "*rbac*", "*session*", "*certificate*", "*application*.yml", "*application*.yaml", "*application*.properties", "*.env*", "*credential*", "*secret*", "*key*", "*controller*", "*RestController*", "*endpoint*", "*route*", "*handler*", "*service*", "*api*", "*mapper*", "*repository*", "*dao*", "*sql*", "*query*", "*input*", "*upload*", "*import*", "*parse*", "*deserialize*", "*validator*", "*filter*", "*interceptor*", "pom.xml", "build.gradle", "package.json", "requirements.txt", "*eval*", "*exec*", "*command*", "*shell*", "*.xml", "*.sql"]
LOW_GLOBS = ["*.md", "*.txt", "*.png", "*.jpg", "*.svg", "*.ico", "*.css", "*.scss", "*.less", "node_modules/*", ".git/*", "__pycache__/*", ".venv/*", "*.test.*", "*.spec.*", "*_test.go", "*test_*", "LICENSE", "README*", "CHANGELOG*"]
CODE_EXTENSIONS = [".py", ".java", ".js", ".ts", ".go", ".rs", ".php", ".rb", ".kt"]
SINK_WEIGHTS = {
    "exec": 1.0, "eval": 1.0, "compile": 0.9, "subprocess.call": 1.0, "subprocess.Popen": 1.0, "subprocess.run": 0.9, "subprocess.check_output": 0.9, "subprocess.check_call": 0.9, "subprocess.getoutput": 0.8, "subprocess.getstatusoutput": 0.8,
    "os.system": 1.0, "os.popen": 1.0, "Runtime.exec": 1.0, "ProcessBuilder": 0.9, "pickle.loads": 0.9, "pickle.load": 0.9, "yaml.load": 0.9, "yaml.unsafe_load": 0.9, "jsonpickle.decode": 0.8,
    "open": 0.6, "file": 0.5, "pathlib.Path.read_text": 0.5, "pathlib.Path.read_bytes": 0.5, "pathlib.Path.open": 0.6, "requests.get": 0.5, "requests.post": 0.5, "requests.put": 0.5, "requests.request": 0.5,
    "urllib.request.urlopen": 0.6, "urllib.request.urlretrieve": 0.6, "httpx.get": 0.5, "httpx.post": 0.5, "aiohttp.ClientSession.get": 0.5, "execute": 0.8, "executemany": 0.8, "executescript": 0.8, "cursor.execute": 0.8, "connection.execute": 0.7,
    "render_template_string": 0.6, "format": 0.4, "Markup": 0.5, "pathlib.Path.write_text": 0.6, "pathlib.Path.write_bytes": 0.6, "get_object_or_404": 0.5, "queryset.filter": 0.4,
    "glob": 0.6, "re.compile": 0.7, "re.match": 0.6, "re.search": 0.6, "re.findall": 0.5, "re.fullmatch": 0.5, "re.sub": 0.5, "fnmatch.translate": 0.5, "fnmatch.filter": 0.5,
}
COMMON_NAMES = ["get", "set", "parse", "validate", "check", "format", "load", "save", "read", "write", "open", "close", "init", "run", "start", "stop", "handle", "process", "transform", "convert", "build", "create", "delete", "update", "insert", "query", "find", "search", "filter", "map", "reduce", "apply", "call"]
SIGNAL_WEIGHTS = {"entry_point": 100, "sql_sink": 80, "cmd_exec": 80, "dynamic_exec": 80, "critical_sink": 500, "file_io": 10, "serialization": 20, "network_operation": 5, "recursion": 30, "regex_operation": 15, "crypto_operation": 5, "auth_check": 20, "test_code": 0.0, "dead_code": 0.1, "pure_helper": 0.3}
VULN_ALIASES = {
    "sqli": "sql_injection",
    **dict.fromkeys(("xss", "stored_xss", "reflected_xss"), "cross_site_scripting"),
    **dict.fromkeys(("session_tampering", "session_fixation", "integrity_forgery", "insufficient_encryption"), "session_forgery"),
    **dict.fromkeys(("auth_bypass", "auth"), "authentication_bypass"),
    "csrf": "cross_site_request_forgery",
}
SEVERITY_MULTIPLIERS = {"critical": 1.0, "high": 0.9, "medium": 0.7, "low": 0.4, "info": 0.1}
RATINGS = [(0.9, "critical"), (0.7, "high"), (0.4, "medium"), (0.1, "low")]
SEVERITY_SCORE = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CONFIDENCE_SCORE = {"high": 3, "medium": 2, "low": 1}
TYPE_BONUS = {"deserialization": 8, "serialization": 8, "rce": 8, "command_injection": 7, "path_traversal": 6, "file_io": 6, "sql_injection": 6, "injection": 5, "path_manipulation": 5, "path_pattern": 4, "resource_exhaustion": 4, "authentication": 4, "authorization": 4, "idor": 5, "cross_function_trace": 3, "dangerous_function": 2}
NOISE_NAMES = [".min.js", ".min.css", "-bundle.js", ".bundle.js", "-min.js"]
NOISE_DIRS = ["/vendor/", "/vendors/", "/third_party/", "/third-party/"]
MAX_FILE_SIZE, MAX_MEAN_LINE = 512 * 1024, 200

#: Sinks of Java and JavaScript with their severity.
JAVA_SINKS = {
    "exec": "critical",
    "Runtime.exec": "critical",
    "ProcessBuilder": "critical",
    "ProcessBuilder.start": "critical",
    "Method.invoke": "high",
    "Class.forName": "medium",
    "Statement.executeQuery": "high",
    "Statement.executeUpdate": "high",
    "Statement.execute": "high",
    "PreparedStatement.executeQuery": "high",
    "PreparedStatement.executeUpdate": "high",
    "PreparedStatement.execute": "high",
    "InitialContext.lookup": "critical",
    "Context.lookup": "critical",
    "FileInputStream": "medium",
    "FileOutputStream": "medium",
    "FileReader": "medium",
    "FileWriter": "medium",
    "RandomAccessFile": "medium",
    "Files.readAllBytes": "medium",
    "Files.newInputStream": "medium",
    "ObjectInputStream.readObject": "high",
    "ObjectInputStream.readUnshared": "high",
    "HttpURLConnection.connect": "high",
    "URL.openConnection": "high",
    "URL.openStream": "high",
    "HttpClient.send": "high",
    "RestTemplate.exchange": "high",
    "RestTemplate.postForObject": "high",
    "WebClient.retrieve": "high",
    "log.info": "low",
    "Logger.info": "low",
    "DocumentBuilder.parse": "high",
    "SAXParser.parse": "high",
    "SAXBuilder.build": "high",
}
JAVA_SOURCES = ["getParameter", "getParameterValues", "getParameterMap", "getQueryString", "getHeader", "getCookies", "javax.servlet.http.HttpServletRequest", "jakarta.servlet.http.HttpServletRequest", "@RequestParam", "@PathVariable", "@RequestHeader", "@CookieValue", "@RequestBody", "@ModelAttribute"]
JS_SOURCES = ["req.query", "req.body", "req.params", "req.headers", "req.cookies", "window.location", "document.URL", "localStorage.getItem", "sessionStorage.getItem"]
JS_SINKS = {"eval": "critical", "innerHTML": "high", "outerHTML": "high", "insertAdjacentHTML": "high", "document.write": "high", "Function": "critical"}

#: Patterns of web applications in Python code.
WEB_PATTERNS = [
    r"(?i)@\w+\.(get|post|put|delete|patch)\s*\(",
    r"(?i)from flask import",
    r"(?i)@\w+\.(get|post|put|delete|patch|websocket)\s*\(",
    r"(?i)from fastapi import",
    r"(?i)from fastapi\.routing",
    r"(?i)APIRouter|FastAPI\(",
    r"(?i)urlpatterns\s*=",
    r"(?i)from django\.urls",
    r"(?i)from django\.conf\.urls",
    r"[^a-zA-Z.]path\s*\([\"']",
    r"(?i)re_path\s*\(",
    r"(?i)from aiohttp import web",
    r"(?i)aiohttp\.web",
    r"(?i)routes\s*=\s*web\.RouteTableDef",
    r"(?i)from starlette\.routing",
    r"(?i)@\w+\.route\s*\(",
    r"(?i)gr\.Interface\s*\(",
    r"(?i)gr\.(Chat|Blocks|TabbedInterface)\s*\(",
    r"(?i)async def \w+\(.*request.*\)",
    r"(?i)def \w+\(.*request.*\)",
    r"(?i)\.listen\s*\(\d+",
    r"(?i)uvicorn\.run",
]
