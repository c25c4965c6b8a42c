"""Fixed values that define results: patterns, names and thresholds, each in one place."""

from __future__ import annotations

# Extensions of source files and the language they count as.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript",
    "tsx": "typescript", "go": "go", "rb": "ruby", "java": "java", "php": "php", "rs": "rust", "c": "c", "cpp": "cpp", "cs": "csharp",
}
SKIP_DIRS = [
    ".git", "__pycache__", "node_modules", "dist", "build", "test", "tests", "spec", ".venv", "venv", "vendor", "migrations", "fuzz", "scripts", "docs", "examples", "benchmark",
    "benchmarks", "site-packages", "fixtures",
]

# Regular expressions that read alike in Java, Python and RE2: ASCII classes, no look-around.
SOURCE_PATTERNS = {
    "body": "req\\.body", "query": "\\.query\\(", "decode": "\\.decode\\(", "environment": "os\\.environ|process\\.env|os\\.getenv|os\\.Getenv",
    "params": "req\\.(params|headers)", "argv": "sys\\.argv", "read": "\\.read\\([0-9]+\\)",
}
DANGER_PATTERNS = {
    "sql": "\\.execute\\(|db\\.Query", "cmd": "os\\.system|subprocess|exec\\(", "eval": "eval\\(|Function\\(", "deserialize": "json\\.loads|pickle\\.loads|JSON\\.parse",
    "file": "open\\(|os\\.path\\.join", "response": "res\\.status|render\\(",
}
SECRET_LINE = "(secret|password|passwd|token|api_key|apikey|API_KEY) *[:=] *[\"'][^\"']{4,}[\"']"
INTENT_NAME = "(valid|check|verif|sanitis|escap|authoris|normalis|parse|filter|match)"
# Names and patterns that decide results, in the order in which they are tried.
GUARD_STEMS = (
    "(check|validate|verify|ensure|assert|sanitiz|escap|allow|authori[sz]|authenticat|permission|forbid|require|guard|is_valid|is_safe|is_allowed|can_|has_perm|clean|filter|"
    "_validate|reject|deny|restrict)"
)
GATE_NAMES = [
    "allowed", "check_permission", "check_permissions", "verify_permission", "has_permission", "require_permission", "authorize",
    "authenticate", "is_authenticated", "is_authorized", "login_required", "permission_required", "validate", "validate_input",
    "sanitize", "escape", "clean", "check_input", "verify", "has_perm", "get_current_user", "oauth2_scheme", "text",
]
# Names of calls and the kind of sink they are, strongest kind first.
SINK_CALLS = [
    ("sql", ["execute", "executemany", "raw", "query", "filter_by", "from_statement"]),
    ("cmd", ["system", "popen", "execv", "execve", "run", "call", "check_call", "check_output", "Popen"]),
    ("eval", ["eval", "exec", "compile", "__import__"]), ("deserialize", ["loads", "load"]), ("file_write", ["open"]),
    ("template", ["from_string", "render_string", "render"]), ("xml_out", ["_write", "write", "characters", "startElement", "endElement", "ParserCreate"]),
    ("xml_parse", ["feed", "parse", "fromstring", "fromstringlist"]),
]
PY_SINKS = {
    "RCE": ["eval", "exec", "compile", "__import__", "subprocess.run", "subprocess.call", "subprocess.Popen", "os.system", "os.popen", "os.execv",
            "pickle.loads", "pickle.load", "yaml.load", "yaml.unsafe_load", "marshal.loads"],
    "SQLI": ["execute", "executemany", "raw", "extra", "RawSQL", "cursor.execute"],
    "LFI": ["open", "read_text", "read_bytes", "os.path.join", "pathlib.Path", "send_file", "send_from_directory"],
    "SSRF": ["requests.get", "requests.post", "requests.put", "urllib.request.urlopen", "httpx.get", "httpx.post", "aiohttp.ClientSession"],
    "AFO": ["open", "write", "write_text", "write_bytes", "shutil.copy", "shutil.move"],
    "DESERIALIZE": ["pickle.loads", "pickle.load", "yaml.load", "yaml.unsafe_load", "json.loads", "marshal.loads", "shelve.open"],
    "PROTO_POLLUTION": ["Object.assign", "Object.defineProperty", "Object.setPrototypeOf", "merge", "deepMerge", "mergeDeep", "extend", "defaults",
                        "__proto__", "constructor.prototype"],
}
PY_INPUT = [
    "request\\.(args|form|json|data|files|values|cookies|headers|get_json)\\b", "flask\\.request", "fastapi\\.Request", "\\bquery\\b", "\\bpayload\\b",
    "\\buser_input\\b", "req\\.(body|query|params|headers)\\b", "process\\.argv", "JSON\\.parse\\b", "req\\.body\\b", "JSON\\.parse\\(req\\b",
]
REDOS = ["re\\.compile\\(['\"].*(\\+|\\*|\\{).*(\\+|\\*|\\{).*['\"]\\)", "\\(\\.\\*\\)\\+", "\\(\\.\\+\\)\\+", "\\([^)]*\\+[^)]*\\)\\*"]
JS_SINKS = {
    "RCE": ["\\beval\\s*\\(", "\\bnew\\s+Function\\s*\\(", "child_process|exec\\s*\\(|execSync\\s*\\(|spawn\\s*\\(|spawnSync\\s*\\(", "require\\s*\\(\\s*[`'\"]child_process"],
    "SQLI": ["\\.query\\s*\\(\\s*[`'\"]?\\s*\\$\\{", "\\.query\\s*\\(\\s*[`'\"][^)]*\\+\\s*\\w", "sequelize\\.query\\s*\\(", "knex\\.raw\\s*\\(", "\\.raw\\s*\\(\\s*[`'\"]?\\s*\\$\\{"],
    "LFI": ["fs\\.readFile\\s*\\(", "fs\\.readFileSync\\s*\\(", "path\\.join\\s*\\([^)]*req\\.", "res\\.sendFile\\s*\\(", "res\\.download\\s*\\("],
    "SSRF": ["\\bfetch\\s*\\(\\s*(?:req\\.|`|\\$\\{)", "axios\\.(?:get|post|put|delete)\\s*\\(\\s*(?:req\\.|`|\\$\\{)", "https?\\.request\\s*\\("],
    "AFO": ["fs\\.writeFile\\s*\\(", "fs\\.writeFileSync\\s*\\(", "fs\\.appendFile\\s*\\(", "multer\\s*\\("],
    "HARDCODED_SECRET": ["(?i)(?:secret|secretKey|privateKey|apiKey|password)\\s*=\\s*['\"][^'\"]{4,}['\"]", "jwt\\.sign\\s*\\([^,]+,\\s*['\"][^'\"]+['\"]"],
    "IDOR": ["where:\\s*\\{[^}]*id:\\s*req\\.(?:body|params|query)", "findOne\\s*\\(\\s*\\{[^}]*:\\s*req\\.", "findById\\s*\\(\\s*req\\."],
    "REDOS": ["new\\s+RegExp\\s*\\(\\s*(?:req\\.|`|\\$\\{)", "\\.match\\s*\\(\\s*new\\s+RegExp"],
}
JS_INPUT = [
    "req\\.(body|query|params|headers|cookies)\\b", "request\\.(body|query|params|headers)\\b", "ctx\\.(query|params|request\\.body)\\b",
    "event\\.(body|queryStringParameters)\\b", "process\\.argv\\b",
]
CHUNK_SOURCES = [
    "request\\.(args|form|json|data|files|values|cookies|headers)\\b", "json\\.loads?\\s*\\(", "yaml\\.(?:safe_)?load\\s*\\(", "os\\.environ(?:\\.get)?\\b", "sys\\.argv\\b",
    "\\bstdin\\b", "\\bdata\\b", "\\bbody\\b", "\\bcontent\\b", "\\bstream\\b",
]
CHUNK_DANGERS = [
    "\\beval\\s*\\(", "\\bexec\\s*\\(", "\\bcompile\\s*\\(", "pickle\\.loads?\\b", "yaml\\.load\\b", "marshal\\.loads\\b", "subprocess\\.", "os\\.system\\b", "os\\.popen\\b",
    "\\.execute\\s*\\(", "\\.executemany\\s*\\(", "\\bopen\\s*\\(", "os\\.path\\.join\\b", "requests?\\.(get|post)\\s*\\(", "httpx\\.(get|post)\\b", "re\\.compile\\b",
    "re\\.match\\b", "re\\.search\\b",
]
ENTRY_DECORATORS = [
    "route", "get", "post", "put", "delete", "patch", "head", "api_view", "action", "login_required", "permission_required", "command", "group", "endpoint", "handler",
]
ENTRY_PREFIXES = ["view_", "handle_", "endpoint_", "api_"]
ENTRY_PARAMETERS = [
    "data", "content", "text", "xml", "xml_input", "input", "src", "stream", "path", "filename", "file", "s", "string", "body", "payload", "value", "obj", "input_dict", "d",
]
JS_FUNCTION = (
    "(?:export\\s+)?(?:async\\s+)?function\\s+(\\w+)|(?:export\\s+)?const\\s+(\\w+)\\s*=\\s*(?:async\\s+)?\\([^)]*\\)\\s*(?::[^=]+)?=>|(\\w+)\\s*\\([^)]*\\)\\s*(?::[^{]+)?\\{"
)
JS_INTENT = (
    "(?i)(auth|verify|validate|login|logout|signup|signin|register|password|passwd|token|jwt|secret|session|permission|role|admin|sanitiz|escap|encrypt|decrypt|hash|sign|"
    "check|guard|middleware|query|find|create|update|delete|upload|download)"
)
JS_BODY_SINKS = {
    "jwt_verify": "\\bjwt\\.verify\\s*\\(", "eval_exec": "\\b(eval|exec|execSync|Function)\\s*\\(", "child_process": "child_process|\\.exec\\(|\\.spawn\\(",
    "sql_raw": "\\.(query|raw)\\s*\\(\\s*[`'\"].*\\$\\{", "where_password": "(?i)where\\s*:\\s*\\{[^}]*password", "token_log": "(?i)(log|logger)\\.\\w+\\([^)]*\\$\\{[^)]*token",
}
CALLER_PRIORITY = ["route", "view", "app", "handler", "controller", "endpoint"]
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "unknown": 1}
CHUNK_WINDOW, CHUNK_OVERLAP = 80, 10
CONFIDENCE_CUTOFF = 0.5
