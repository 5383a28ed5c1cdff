"""Attack patterns by type. The engine-neutral form: literal braces are escaped."""

SQL_INJECTION = [
    r"'\s*or\s+['\d]", r"union\s+select", r";\s*drop\s+", r"--\s*$", r"1\s*=\s*1",
    r"'\s*;\s*--", r"'\s*or\s+'", r"waitfor\s+delay", r"benchmark\s*\(", r"sleep\s*\(",
    r"pg_sleep", r"load_file\s*\(", r"into\s+outfile", r"into\s+dumpfile",
    r"information_schema", r"sysobjects", r"syscolumns", r"@@version", r"char\s*\(\d+\)",
    r"concat\s*\(", r"group_concat", r"having\s+\d+\s*=", r"order\s+by\s+\d+",
    r"extractvalue\s*\(", r"updatexml\s*\(",
]
COMMAND_INJECTION = [
    r";\s*\w+\s*", r"\|\s*\w+", r"`[^`]+`", r"\$\([^)]+\)", r"&&\s*\w+", r"\|\|\s*\w+",
    r"/bin/sh", r"/bin/bash", r"cmd\.exe", r"powershell", r"wget\s+", r"curl\s+", r"nc\s+-",
    r"netcat", r"rm\s+-rf", r"cat\s+/etc", r"chmod\s+", r"chown\s+", r"eval\s*\(",
    r"exec\s*\(", r"system\s*\(", r"passthru\s*\(", r"proc_open", r"popen\s*\(", r"shell_exec",
]
XSS = [
    r"<script[^>]*>", r"javascript:", r"on\w+\s*=", r"<img[^>]+onerror", r"<iframe",
    r"document\.", r"<svg[^>]+onload", r"<body[^>]+onload", r"<input[^>]+onfocus",
    r"expression\s*\(", r"vbscript:", r"data:text/html", r"alert\s*\(", r"prompt\s*\(",
    r"confirm\s*\(", r"fromcharcode", r"innerhtml\s*=", r"outerhtml\s*=",
    r"document\.cookie", r"document\.write", r"\.innerHTML", r"eval\s*\(",
    r"settimeout\s*\(", r"setinterval\s*\(",
]
PATH_TRAVERSAL = [
    r"\.\./", r"\.\.\\", r"%2e%2e", r"etc/passwd", r"etc/shadow", r"windows/system32",
    r"boot\.ini", r"%252e%252e", r"\.\.%00", r"\.\.%0d", r"\.\.%c0%af", r"/proc/self",
    r"/var/log", r"web\.config", r"\.htaccess", r"wp-config\.php", r"config\.php",
]
NOSQL_INJECTION = [
    r"\$gt\s*:", r"\$lt\s*:", r"\$ne\s*:", r"\$eq\s*:", r"\$regex\s*:", r"\$where\s*:",
    r"\$or\s*:\s*\[", r"\$and\s*:\s*\[", r"\$nin\s*:", r"\$in\s*:", r"\{\s*\$",
    r"\[\s*\$", r"db\.\w+\.find\s*\(", r"db\.\w+\.insert", r"db\.\w+\.update",
    r"db\.\w+\.delete", r"mapReduce", r"\.toArray\s*\(", r"\.forEach\s*\(",
]
LOG4SHELL = [
    r"\$\{jndi:", r"\$\{lower:", r"\$\{upper:", r"\$\{env:", r"\$\{sys:", r"\$\{java:",
    r"ldap://", r"rmi://", r"dns://", r"iiop://", r"\$\{\w+:\w+:", r"ldaps://", r"corba://",
]
SSTI = [
    r"\{\{.*\}\}", r"\{%.*%\}", r"\$\{.*\}", r"__class__", r"__mro__", r"__subclasses__",
    r"__globals__", r"__builtins__", r"__import__", r"config\.__class__",
    r"request\.__class__", r"lipsum\.__globals__", r"cycler\.__init__",
    r"joiner\.__init__", r"\|attr\s*\(",
]
XXE = [
    r"<!DOCTYPE[^>]+\[", r"<!ENTITY", r"SYSTEM\s+['\"]", r"file://", r"php://", r"expect://",
    r"data://", r"<!ELEMENT", r"%\w+;", r"&\w+;", r"<!NOTATION", r"PUBLIC\s+['\"]",
]
LDAP_INJECTION = [
    r"\)\s*\(\|", r"\(\|?\s*\(", r"\)\s*\(\&", r"\*\)\(", r"uid\s*=\s*\*", r"cn\s*=\s*\*",
    r"\)\s*\(uid=", r"\)\s*\(cn=", r"objectclass\s*=\s*\*",
]
HEADER_INJECTION = [
    r"%0d%0a", r"%0a%0d", r"\r\n", r"\\r\\n", r"set-cookie:", r"location:", r"x-forwarded",
]
OPEN_REDIRECT = [
    r"redirect=https?://", r"url=https?://", r"next=https?://", r"return=https?://",
    r"goto=https?://", r"target=https?://", r"redirect=/[^/]", r"//\w+\.\w+",
]
SSRF = [
    r"169\.254\.169\.254", r"metadata\.google", r"localhost:\d+", r"127\.0\.0\.1:\d+",
    r"0\.0\.0\.0:\d+", r"::1", r"\[::\]", r"file://localhost", r"gopher://", r"dict://",
]
DESERIALIZATION = [
    r"ysoserial", r"gadgetchain", r"rO0AB", r"O:\d+:", r"a:\d+:\{", r"java\.lang\.Runtime",
    r"java\.lang\.ProcessBuilder", r"javax\.script", r"org\.apache\.commons",
    r"com\.sun\.org\.apache",
]
AUTH_BYPASS = [
    r"admin'--", r"' or ''='", r"' or 1=1", r"password['\s]*=", r"pass['\s]*=",
    r"pwd['\s]*=", r"x-auth-token:", r"authorization:\s*bearer", r"jwt\.",
    r"eyj\w+\.\w+\.\w+",
]

INJECTION_RULES = {
    "sql_injection": SQL_INJECTION,
    "command_injection": COMMAND_INJECTION,
    "xss": XSS,
    "path_traversal": PATH_TRAVERSAL,
    "nosql_injection": NOSQL_INJECTION,
    "log4shell": LOG4SHELL,
    "ssti": SSTI,
    "xxe": XXE,
    "ldap_injection": LDAP_INJECTION,
    "header_injection": HEADER_INJECTION,
    "open_redirect": OPEN_REDIRECT,
    "ssrf": SSRF,
    "deserialization": DESERIALIZATION,
    "auth_bypass": AUTH_BYPASS,
}
