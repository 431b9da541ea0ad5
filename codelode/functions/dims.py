"""Fixed values of the review analytics: languages, patterns, rules and word lists, as plain data."""

from __future__ import annotations

#: Languages in the order that breaks ties.
LANGUAGES = ["python", "java", "javascript", "php", "ruby", "go"]

#: File name endings, compared in lower case.
EXTENSIONS = {
    "python": [".py", ".pyw", ".pyi"],
    "java": [".java"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "php": [".php", ".php3", ".php4", ".php5", ".phtml"],
    "ruby": [".rb", ".rbw", ".rake", ".gemspec", ".ru"],
    "go": [".go"],
}

#: Interpreter words of a first line, first match wins.
SHEBANGS = [("python", "python"), ("node", "javascript"), ("ruby", "ruby"), ("php", "php"), ("bash", "shell"), ("sh", "shell")]

#: Content patterns: language, weight, expression (case free, ^ at each line).
LANGUAGE_PATTERNS = [
    ("python", 3, r'^\s*(import\s+|from\s+\S+\s+import)'),
    ("python", 2, r'^\s*def\s+\w+\s*\('),
    ("python", 2, r'^\s*class\s+\w+'),
    ("python", 1, r'^\s*@\w+'),
    ("python", 1, r'\bprint\('),
    ("python", 1, r'\blambda\b'),
    ("python", 1, r'\bself\b'),
    ("java", 3, r'^\s*(public|private|protected)\s+(class|interface|enum)'),
    ("java", 2, r'\bimport\s+[\w\.]+\s*;'),
    ("java", 3, r'\bvoid\s+main\s*\(String\[\]'),
    ("java", 1, r'\bSystem\.out\.'),
    ("java", 1, r'\bthrows\s+'),
    ("java", 1, r'@Override'),
    ("javascript", 2, r'^\s*(function\s+\w+|const\s+\w+|let\s+\w+|var\s+\w+)'),
    ("javascript", 2, r'^\s*export\s+(default\s+)?'),
    ("javascript", 1, r'\bconsole\.(log|warn|error)\b'),
    ("javascript", 1, r'\bdocument\.'),
    ("javascript", 1, r'\bwindow\.'),
    ("javascript", 1, r'\brequire\('),
    ("javascript", 2, r'`[^`]*\$\{[^}]*\}[^`]*`'),
    ("php", 4, r'^<\?php'),
    ("php", 2, r'\becho\s+'),
    ("php", 2, r'\$_[A-Z]+'),
    ("php", 1, r'\$\w+\s*=\s*'),
    ("php", 2, r'\bfunction\s+\w+\s*\('),
    ("php", 1, r'->'),
    ("ruby", 2, r'^\s*def\s+\w+'),
    ("ruby", 2, r'^\s*class\s+\w+'),
    ("ruby", 2, r'^\s*module\s+\w+'),
    ("ruby", 1, r'\bputs\b'),
    ("ruby", 1, r'\brequire\b'),
    ("ruby", 1, r'\battr_(accessor|reader|writer)\b'),
    ("ruby", 1, r':\w+'),
    ("go", 3, r'^package\s+\w+'),
    ("go", 2, r'^import\s+"'),
    ("go", 3, r'\bfunc\s+(main|init)\s*\('),
    ("go", 2, r':='),
    ("go", 1, r'\berror\b'),
    ("go", 1, r'\bgoroutine\b'),
]

#: Security rules: language, phase (common rules run first), severity, description, expression (case free, per line).
RULES = [
    ("python", "common", "HIGH", "Possible SQL injection (string concatenation in execute())", r'execute\(.*\+.*\)'),
    ("python", "common", "HIGH", "Possible SQL injection (string concatenation in executemany())", r'executemany\(.*\+.*\)'),
    ("python", "common", "CRITICAL", "Possible command injection in os.system()", r'os\.system\(.*\)'),
    ("python", "common", "CRITICAL", "Possible command injection with shell=True", r'subprocess\.call\(.*shell=True.*\)'),
    ("python", "common", "CRITICAL", "Possible command injection with shell=True", r'subprocess\.Popen\(.*shell=True.*\)'),
    ("python", "common", "CRITICAL", "Unsafe deserialization with pickle", r'pickle\.loads\('),
    ("python", "common", "HIGH", "Unsafe YAML deserialization (use yaml.safe_load)", r'yaml\.load\('),
    ("python", "common", "MEDIUM", "Insecure random number for cryptography", r'random\.randint\('),
    ("python", "common", "MEDIUM", "Insecure random for security contexts", r'random\.choice\('),
    ("python", "common", "HIGH", "Possible hardcoded password", r'''password\s*=\s*['\"].{4,}['\"]'''),
    ("python", "common", "HIGH", "Possible hardcoded secret", r'''secret\s*=\s*['\"].{4,}['\"]'''),
    ("python", "common", "HIGH", "Possible hardcoded API key", r'''api_key\s*=\s*['\"].{8,}['\"]'''),
    ("python", "common", "MEDIUM", "Weak MD5 hashing algorithm", r'hashlib\.md5\('),
    ("python", "common", "MEDIUM", "Weak SHA-1 hashing algorithm", r'hashlib\.sha1\('),
    ("python", "common", "HIGH", "SSL certificate verification disabled", r'verify\s*=\s*False'),
    ("javascript", "common", "HIGH", "Unsafe innerHTML assignment (potential XSS)", r'innerHTML\s*='),
    ("javascript", "common", "HIGH", "Unsafe outerHTML assignment (potential XSS)", r'outerHTML\s*='),
    ("javascript", "common", "HIGH", "Unsafe document.write() (potential XSS)", r'document\.write\('),
    ("javascript", "common", "CRITICAL", "Unsafe eval() usage", r'eval\('),
    ("javascript", "common", "CRITICAL", "Unsafe Function constructor", r'''Function\(['\"].*['\"]\)'''),
    ("javascript", "common", "MEDIUM", "Insecure random for security contexts", r'Math\.random\(\)'),
    ("javascript", "common", "HIGH", "Sensitive data in localStorage", r'localStorage\.setItem\(.*password.*\)'),
    ("javascript", "common", "HIGH", "Sensitive data in localStorage", r'localStorage\.setItem\(.*token.*\)'),
    ("javascript", "common", "HIGH", "JWT verification disabled", r'jwt\.decode\(.*\{.*verify:\s*false.*\}\)'),
    ("javascript", "common", "HIGH", "Prototype pollution risk", r'__proto__'),
    ("javascript", "common", "HIGH", "Prototype pollution risk", r'constructor\.prototype'),
    ("java", "common", "HIGH", "Possible SQL injection (string concatenation)", r'\.executeQuery\(.*\+.*\)'),
    ("java", "common", "HIGH", "Possible SQL injection (string concatenation)", r'\.executeUpdate\(.*\+.*\)'),
    ("java", "common", "CRITICAL", "Command execution without validation", r'Runtime\.getRuntime\(\)\.exec\('),
    ("java", "common", "CRITICAL", "Unsafe deserialization", r'ObjectInputStream'),
    ("java", "common", "CRITICAL", "Unsafe deserialization", r'readObject\('),
    ("java", "common", "MEDIUM", "Insecure random for cryptography", r'java\.util\.Random'),
    ("java", "common", "HIGH", "Possible hardcoded password", r'String\s+password\s*=\s*\".*\"'),
    ("java", "common", "HIGH", "Possible hardcoded secret", r'String\s+secret\s*=\s*\".*\"'),
    ("java", "common", "HIGH", "Possible hardcoded API key", r'String\s+apiKey\s*=\s*\".*\"'),
    ("java", "common", "MEDIUM", "Weak MD5 algorithm", r'MD5'),
    ("java", "common", "MEDIUM", "Weak SHA-1 algorithm", r'SHA1'),
    ("java", "common", "HIGH", "SSL verification disabled", r'setVerifyMode\(.*NO_VERIFY'),
    ("php", "common", "CRITICAL", "Possible SQL injection (string concatenation)", r'mysql_query\(\$.*\.\$.*\)'),
    ("php", "common", "CRITICAL", "Possible SQL injection (string concatenation)", r'mysqli_query\(\$.*\.\$.*\)'),
    ("php", "common", "CRITICAL", "Command injection risk", r'exec\(\$.*\)'),
    ("php", "common", "CRITICAL", "Command injection risk", r'shell_exec\(\$.*\)'),
    ("php", "common", "CRITICAL", "Command injection risk", r'system\(\$.*\)'),
    ("php", "common", "HIGH", "Dynamic file inclusion risk", r'include\(\$.*\)'),
    ("php", "common", "HIGH", "Dynamic file inclusion risk", r'require\(\$.*\)'),
    ("php", "common", "MEDIUM", "Direct variable output (potential XSS)", r'echo\s+\$.*;'),
    ("php", "common", "MEDIUM", "Direct variable output (potential XSS)", r'print\s+\$.*;'),
    ("php", "common", "HIGH", "Possible hardcoded password", r'''\$password\s*=\s*['\"].{4,}['\"]'''),
    ("php", "common", "HIGH", "Possible hardcoded secret", r'''\$secret\s*=\s*['\"].{4,}['\"]'''),
    ("php", "common", "MEDIUM", "Insecure random for cryptography", r'rand\('),
    ("php", "common", "MEDIUM", "Insecure random for security contexts", r'mt_rand\('),
    ("ruby", "common", "HIGH", "Possible SQL injection (string concatenation)", r'execute\(.*\+.*\)'),
    ("ruby", "common", "HIGH", "Possible SQL injection", r'ActiveRecord::Base\.connection\.execute\(.*\+.*\)'),
    ("ruby", "common", "CRITICAL", "Command injection in backticks", r'`.*#\{.*\}.*`'),
    ("ruby", "common", "CRITICAL", "Command injection in system()", r'system\(.*#\{.*\}.*\)'),
    ("ruby", "common", "CRITICAL", "Command injection in exec()", r'exec\(.*#\{.*\}.*\)'),
    ("ruby", "common", "CRITICAL", "Unsafe deserialization", r'Marshal\.load\('),
    ("ruby", "common", "HIGH", "Unsafe YAML deserialization", r'YAML\.load\('),
    ("ruby", "common", "CRITICAL", "Unsafe eval() usage", r'eval\('),
    ("ruby", "common", "HIGH", "Dynamic code evaluation", r'instance_eval\('),
    ("ruby", "common", "HIGH", "Possible hardcoded password", r'''password\s*=\s*['\"].{4,}['\"]'''),
    ("ruby", "common", "HIGH", "Possible hardcoded secret", r'''secret\s*=\s*['\"].{4,}['\"]'''),
    ("ruby", "common", "HIGH", "Possible hardcoded API key", r'''api_key\s*=\s*['\"].{8,}['\"]'''),
    ("ruby", "common", "MEDIUM", "Insecure random for cryptography", r'rand\('),
    ("go", "common", "CRITICAL", "Command execution (validate inputs)", r'exec\.CommandContext\('),
    ("go", "common", "CRITICAL", "Command execution (validate inputs)", r'exec\.Command\('),
    ("go", "common", "HIGH", "Possible SQL injection (string concatenation)", r'db\.Exec\(.*\+.*\)'),
    ("go", "common", "HIGH", "Possible SQL injection (string concatenation)", r'db\.Query\(.*\+.*\)'),
    ("go", "common", "MEDIUM", "Possible path traversal", r'filepath\.Join\(.*\.\.'),
    ("go", "common", "HIGH", "Possible hardcoded password", r'password\s*:=\s*\".*\"'),
    ("go", "common", "HIGH", "Possible hardcoded secret", r'secret\s*:=\s*\".*\"'),
    ("go", "common", "HIGH", "Possible hardcoded API key", r'apiKey\s*:=\s*\".*\"'),
    ("go", "common", "MEDIUM", "Insecure random for cryptography", r'math/rand'),
    ("go", "common", "HIGH", "Unsafe memory operations", r'unsafe\.Pointer'),
    ("java", "lang", "HIGH", "ProcessBuilder usage (validate inputs)", r'ProcessBuilder\('),
    ("java", "lang", "INFO", "SecurityManager usage (deprecated in newer Java)", r'SecurityManager'),
    ("java", "lang", "HIGH", "Privileged block (review permissions)", r'AccessController\.doPrivileged'),
    ("java", "lang", "LOW", "Security TODO comment", r'//\s*TODO.*security'),
    ("java", "lang", "LOW", "Security FIXME comment", r'//\s*FIXME.*security'),
    ("java", "lang", "MEDIUM", "Database connection - check for proper configuration", r'\.getConnection\(.*\)'),
    ("php", "lang", "CRITICAL", "Dangerous extract() on superglobal", r'extract\(\$_(GET|POST|REQUEST|COOKIE|SERVER)\)'),
    ("php", "lang", "MEDIUM", "phpinfo() exposure in production", r'phpinfo\('),
    ("php", "lang", "MEDIUM", "Error display enabled in production", r'display_errors\s*=\s*1'),
    ("php", "lang", "MEDIUM", "Full error reporting in production", r'error_reporting\s*\(\s*E_ALL\s*\)'),
    ("php", "lang", "HIGH", "Header injection vulnerability", r'\$_(GET|POST|REQUEST)\[.*\].*header\('),
    ("ruby", "lang", "CRITICAL", "Kernel.open() with user input (command injection risk)", r'Kernel\.open\('),
    ("ruby", "lang", "CRITICAL", "open() with pipe (command injection)", r'''open\s*\(\s*['\"]\|'''),
    ("ruby", "lang", "HIGH", "Dynamic method send() with user input", r'''send\s*\(\s*[:\"].*['\"]\s*,\s*.*\)'''),
    ("ruby", "lang", "HIGH", "constantize() with user input (class injection)", r'constantize\('),
    ("ruby", "lang", "CRITICAL", "eval() with dynamic input", r'eval\s*\(.*\)'),
    ("ruby", "lang", "HIGH", "instance_eval() with dynamic input", r'instance_eval\s*\(.*\)'),
    ("go", "lang", "MEDIUM", "ioutil.ReadFile() is deprecated (use os.ReadFile)", r'ioutil\.ReadFile\('),
    ("go", "lang", "MEDIUM", "ioutil.WriteFile() is deprecated (use os.WriteFile)", r'ioutil\.WriteFile\('),
    ("go", "lang", "LOW", "Security TODO comment", r'//\s*TODO.*security'),
    ("go", "lang", "LOW", "Security FIXME comment", r'//\s*FIXME.*security'),
    ("go", "lang", "MEDIUM", "MD5 usage (cryptographically weak)", r'crypto/md5'),
    ("go", "lang", "MEDIUM", "SHA-1 usage (cryptographically weak)", r'crypto/sha1'),
]

#: Confidence of a rule by language and phase; the rest is HIGH.
MEDIUM_CONFIDENCE = [("java", "lang"), ("go", "lang")]

#: Weights of a finding.
SEVERITY_WEIGHTS = {"CRITICAL": 20, "HIGH": 10, "MEDIUM": 5, "LOW": 2, "INFO": 1}
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]

#: Words in a description, in this order, and the category they mean.
CATEGORIES = [
    (["sql", "injection"], "SQL Injection"),
    (["command", "exec", "shell"], "Command Injection"),
    (["xss", "cross-site"], "Cross-Site Scripting (XSS)"),
    (["deserialization", "pickle", "yaml", "marshal"], "Insecure Deserialization"),
    (["eval", "function", "dynamic"], "Code Injection"),
    (["password", "secret", "key", "hardcoded"], "Hardcoded Credentials"),
    (["random", "crypto", "md5", "sha1", "hash"], "Cryptographic Issues"),
    (["ssl", "tls", "verify"], "SSL/TLS Issues"),
    (["path", "traversal", "include"], "Path Traversal"),
]
OTHER_CATEGORY = "Security Issue"

#: Words in a description, in this order, and the advice they call for.
REMEDIATIONS = [
    (["sql injection"], "Use parameterized queries or prepared statements instead of string concatenation."),
    (["command injection"], "Avoid shell=True, validate and sanitize all user inputs, use subprocess without shell."),
    (["xss"], "Use proper output encoding, escape special characters, or use templating engines with auto-escaping."),
    (["deserialization"], "Avoid untrusted deserialization, use safe alternatives (json.loads, yaml.safe_load)."),
    (["eval"], "Avoid eval() and Function() constructor. Use JSON.parse() for JSON or other safer alternatives."),
    (["hardcoded"], "Use environment variables or secure secret management systems (AWS Secrets Manager, HashiCorp Vault)."),
    (["md5", "sha1"], "Use stronger hashing algorithms (SHA-256, SHA-512, bcrypt, Argon2)."),
    (["random"], "For security contexts, use cryptographically secure random (secrets module in Python, crypto.randomBytes in JS)."),
    (["ssl"], "Always verify SSL certificates. Use proper certificate validation."),
    (["localstorage"], "Avoid storing sensitive data in localStorage. Use HTTP-only cookies or secure session storage."),
]
OTHER_REMEDIATION = "Review code for security implications and apply principle of least privilege."

#: Summary line by the highest severity present.
SUMMARY_ADVICE = {
    "CRITICAL": "CRITICAL issues found. Immediate attention required!",
    "HIGH": "HIGH severity issues found. Address before deployment.",
    "MEDIUM": "MEDIUM severity issues found. Review and fix.",
    "LOW": "Low severity issues found. Consider fixing.",
}
SUMMARY_OTHER, SUMMARY_NONE = "Minor informational findings.", "No security issues found."

#: Graph sinks: kind and expression, kinds in the order in which the later one wins.
SINK_PATTERNS = [
    ("sql_injection", r'''execute\s*\(\s*["\'][^"\']*["\']\s*[+\-*/%]\s*\w+'''),
    ("sql_injection", r'''query\s*\(\s*["\'][^"\']*["\']\s*[+\-*/%]\s*\w+'''),
    ("sql_injection", r'''["\']SELECT[^"\']*["\']\s*[+\-*/%]\s*\w+'''),
    ("sql_injection", r'''["\']INSERT[^"\']*["\']\s*[+\-*/%]\s*\w+'''),
    ("sql_injection", r'''["\']UPDATE[^"\']*["\']\s*[+\-*/%]\s*\w+'''),
    ("sql_injection", r'''["\']DELETE[^"\']*["\']\s*[+\-*/%]\s*\w+'''),
    ("sql_injection", r'''fmt\.Sprintf\s*\(\s*["\'][^"\']*(SELECT|INSERT|UPDATE|DELETE)'''),
    ("sql_injection", r'''String\.format\s*\(\s*["\'][^"\']*(SELECT|INSERT|UPDATE|DELETE)'''),
    ("sql_injection", r'''\$\w+\s*=\s*["\'][^"\']*["\']\s*\.\s*\$'''),
    ("xss", r'\.innerHTML\s*=\s*\w+'),
    ("xss", r'document\.write\s*\(\s*\w+'),
    ("xss", r'Response\.Write\s*\(\s*\w+'),
    ("xss", r'echo\s+\$\w+'),
    ("xss", r'print\s+\$\w+'),
    ("xss", r'<\w+>\s*\{\{.*\}\}\s*</\w+>'),
    ("command_injection", r'exec\s*\(\s*\w+'),
    ("command_injection", r'system\s*\(\s*\w+'),
    ("command_injection", r'subprocess\.(run|call|Popen)\s*\(\s*\w+'),
    ("command_injection", r'Runtime\.exec\s*\(\s*\w+'),
    ("command_injection", r'Process\.start\s*\(\s*\w+'),
    ("command_injection", r'`.*\$\{.*\}.*`'),
    ("command_injection", r'`.*\$\(.*\).*`'),
]

#: Taint sources of each language, used as expressions.
TAINT_SOURCES = {
    "python": ["input", "raw_input", "sys.argv", "os.environ", "request.GET", "request.POST"],
    "javascript": ["document.getElementById", "document.querySelector", "req.query", "req.body", "req.params", "localStorage.getItem", "sessionStorage.getItem", "window.location.search"],
    "java": ["HttpServletRequest.getParameter", "BufferedReader.readLine", "Scanner.nextLine", "System.console().readLine", "request.getParameter"],
    "php": ["$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SESSION", "file_get_contents", "fgets", "$HTTP_RAW_POST_DATA"],
    "ruby": ["params", "gets", "ARGF", "ENV", "request.params"],
    "go": ["http.Request.FormValue", "http.Request.PostFormValue", "bufio.Scanner.Text", "os.Getenv", "r.URL.Query().Get"],
}

#: Sanitizers of each language, used as plain text.
SANITIZERS = {
    "python": ["escape", "html.escape", "re.escape", "json.dumps", "str.encode", "mysql.connector.escape_string", "psycopg2.sql.Identifier", "htmlspecialchars", "cgi.escape"],
    "javascript": ["encodeURI", "encodeURIComponent", "escape", "JSON.stringify", "DOMPurify.sanitize", "textContent", "innerText", "mysql.escape", "pg.escape"],
    "java": ["ESAPI.encoder().encodeForHTML", "StringEscapeUtils.escapeHtml4", "PreparedStatement.setString", "URLEncoder.encode", "JsonSanitizer.sanitize"],
    "php": ["htmlspecialchars", "htmlentities", "addslashes", "mysql_real_escape_string", "mysqli_real_escape_string", "PDO::quote", "filter_var", "json_encode", "urlencode"],
    "ruby": ["ERB::Util.html_escape", "CGI.escapeHTML", "Rack::Utils.escape_html", "Shellwords.escape", "JSON.generate", "ActiveRecord::Sanitization"],
    "go": ["html.EscapeString", "url.QueryEscape", "json.Marshal", "strconv.Quote", "database/sql.DB.Exec"],
}

#: Words that are no variables: keywords (compared with the name in lower case) and builtins.
KEYWORDS = {
    "python": ["def", "class", "if", "else", "elif", "for", "while", "return", "import", "from", "as", "try", "except", "finally", "with", "and", "or", "not", "in", "is", "None", "True", "False"],
    "javascript": ["function", "var", "let", "const", "if", "else", "for", "while", "return", "import", "export", "try", "catch", "class", "new", "this", "null", "undefined", "true", "false"],
    "java": ["public", "private", "protected", "class", "if", "else", "for", "while", "return", "import", "try", "catch", "new", "this", "null", "true", "false", "int", "String", "void"],
    "php": ["function", "class", "if", "else", "for", "while", "return", "include", "require", "try", "catch", "echo", "print", "new", "null", "true", "false"],
    "ruby": ["def", "class", "if", "else", "elsif", "for", "while", "return", "require", "begin", "rescue", "end", "nil", "true", "false", "puts", "print"],
    "go": ["func", "package", "import", "if", "else", "for", "range", "return", "var", "const", "type", "struct", "interface", "nil", "true", "false", "int", "string", "error"],
}
BUILTINS = {
    "python": ["print", "len", "range", "str", "int", "float", "list", "dict"],
    "javascript": ["console", "alert", "parseInt", "parseFloat", "String", "Number"],
    "java": ["System", "Math", "String", "Integer", "Double", "Float"],
    "php": ["echo", "print", "isset", "empty", "strlen", "count"],
    "ruby": ["puts", "print", "p", "require", "include"],
    "go": ["fmt", "println", "print", "len", "cap", "make", "new"],
}

#: Syntax node types: the first whose words are part of the parser's type name.
NODE_TYPES = [
    (["if_statement"], "IF_STATEMENT"),
    (["for_statement", "for_loop"], "FOR_STATEMENT"),
    (["while_statement", "while_loop"], "WHILE_STATEMENT"),
    (["function", "method", "def"], "FUNCTION_DEF"),
    (["class"], "CLASS_DEF"),
    (["assignment"], "ASSIGNMENT"),
    (["declaration"], "VARIABLE"),
    (["parameter"], "PARAMETER"),
    (["return"], "RETURN"),
    (["break"], "BREAK"),
    (["continue"], "CONTINUE"),
    (["call"], "CALL"),
    (["import", "require", "include"], "IMPORT"),
    (["literal"], "LITERAL"),
    (["comment"], "COMMENT"),
    (["block"], "BLOCK"),
]
OTHER_NODE_TYPE = "EXPRESSION"

#: All node types, in the order of the one-hot features.
ALL_NODE_TYPES = [
    "MODULE", "FUNCTION_DEF", "METHOD_DEF", "CLASS_DEF", "VARIABLE", "ASSIGNMENT", "CALL", "IF_STATEMENT", "FOR_STATEMENT", "WHILE_STATEMENT", "CONDITION", "RETURN", "BREAK",
    "CONTINUE", "IMPORT", "EXPORT", "REQUIRE", "INCLUDE", "EXPRESSION", "LITERAL", "COMMENT", "BLOCK", "PARAMETER", "PHI_NODE",
]

#: Flow texts (source, sink, sanitization) that stand for the labels 1 and 0 in training.
FLOW_TEXTS = {
    1: [
        ("request.getParameter", "Statement.executeQuery", "none"),
        ("input()", "os.system", "none"),
        ("document.location.href", "element.innerHTML", "none"),
        ("$_GET", "mysql_query", "none"),
        ("scanf", "system", "none"),
        ("getenv", "popen", "none"),
    ],
    0: [
        ("request.getParameter", "PreparedStatement.execute", "parameterized"),
        ("sys.argv", "subprocess.run", "shlex.quote"),
        ("URLSearchParams", "element.textContent", "encodeURIComponent"),
        ("$_POST", "mysqli_prepare", "bind_param"),
        ("fgets", "execve", "input_validation"),
        ("readline", "secure_function", "sanitized"),
    ],
}

#: Words of a flow's parts, in order, and what they are normalised to; other parts stay.
FLOW_SOURCES = [
    (["request.getparameter", "getparameter", "httpparameters"], "request.getParameter"),
    (["input(", "raw_input", "sys.stdin"], "input()"),
    (["document.location", "window.location", "url"], "document.location.href"),
    (["$_get", "$_post", "$_request"], "$_GET"),
]
FLOW_SINKS = [
    (["statement.execute", "statement.exec", "executequery"], "Statement.executeQuery"),
    (["os.system", "subprocess.call", "popen"], "os.system"),
    (["innerhtml", "document.write", "eval("], "element.innerHTML"),
    (["mysql_query", "mysqli_query", "pg_query"], "mysql_query"),
]
FLOW_SANITIZERS = [
    (["none", "missing", "no_sanitization"], "none"),
    (["parameterized", "prepared", "bind"], "parameterized"),
    (["sanitized", "validated", "escaped"], "sanitized"),
]

#: The short way's languages by the end of a file's name.
SIMPLE_SUFFIXES = [(".java", "java"), (".py", "python"), (".js", "javascript"), (".cpp", "c"), (".c", "c")]
OTHER_SUFFIX = "unknown"
