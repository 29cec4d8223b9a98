"""Rules of the ``basic`` profile (not language-aware), in emission order.

Patterns, titles and texts are fixed values: findings must equal them.  No rule has a
language gate and none skips pattern-defining lines.
"""

from __future__ import annotations

import re
from dataclasses import replace

from .model import Rule, number

# (label, pattern, flags, needs)
SECRETS = [
    ("API Key", r"""['"`](?:api[_-]?key|apikey)['"`]\s*[:=]\s*['"`]([^'"`]+)['"`]""", "i", ("api",)),
    ("Secret/Password", r"""['"`](?:secret|password|passwd|pwd)['"`]\s*[:=]\s*['"`]([^'"`]+)['"`]""", "i",
     ("secret|passw|pwd",)),
    ("AWS Credentials", r"""(?:aws_access_key_id|aws_secret_access_key)\s*[:=]\s*['"`]?([A-Z0-9]+)['"`]?""", "i",
     ("aws_access_key_id|aws_secret_access_key",)),
    ("AWS Access Key ID", r"(?:AKIA|ASIA)[A-Z0-9]{16}", "", ("AKIA|ASIA",)),
    ("GitHub Personal Access Token", r"ghp_[a-zA-Z0-9]{36}", "", ("ghp_",)),
    ("GitHub Fine-grained Token", r"github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59}", "", ("github_pat_",)),
    ("OpenAI API Key", r"sk-[a-zA-Z0-9]{48}", "", ("sk-",)),
    ("Slack Token", r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*", "", ("xox",)),
    ("Private Key", r"-----BEGIN (?:RSA|DSA|EC|OPENSSH|PGP) PRIVATE KEY-----", "", (" PRIVATE KEY-----",)),
    ("MongoDB Connection String", r"mongodb(?:\+srv)?://[^:]+:[^@]+@[^\s]+", "i", ("mongodb", "://", "@")),
    ("PostgreSQL Connection String", r"postgres(?:ql)?://[^:]+:[^@]+@[^\s]+", "i", ("postgres", "://", "@")),
    ("MySQL Connection String", r"mysql://[^:]+:[^@]+@[^\s]+", "i", ("mysql://", "@")),
]

SQL_INJECTION = [
    (r"""(?:query|execute)\s*\(\s*['"`].*\$\{.*\}.*['"`]""", ("query|execute", "${")),
    (r"""(?:query|execute)\s*\(\s*['"`].*\+\s*\w+\s*\+.*['"`]""", ("query|execute", "+")),
    (r"`SELECT.*\$\{.*\}.*`", ("`select", "${")),
    (r"`INSERT.*\$\{.*\}.*`", ("`insert", "${")),
    (r"`UPDATE.*\$\{.*\}.*`", ("`update", "${")),
    (r"`DELETE.*\$\{.*\}.*`", ("`delete", "${")),
]

WEAK_CRYPTO = [
    ("MD5", r"""crypto\.createHash\s*\(\s*['"`]md5['"`]""", ("createhash", "md5")),
    ("SHA1", r"""crypto\.createHash\s*\(\s*['"`]sha1['"`]""", ("createhash", "sha1")),
    ("MD5 (Python)", r"hashlib\.md5", ("hashlib.md5",)),
    ("SHA1 (Python)", r"hashlib\.sha1", ("hashlib.sha1",)),
]

# (label, severity, pattern, needs)
TODO = [
    ("TODO", "info", r"//\s*TODO[:\s](.+)", ("//", "todo")),
    ("FIXME", "warning", r"//\s*FIXME[:\s](.+)", ("//", "fixme")),
    ("HACK", "warning", r"//\s*HACK[:\s](.+)", ("//", "hack")),
    ("XXX", "info", r"//\s*XXX[:\s](.+)", ("//", "xxx")),
    ("TODO (Python)", "info", r"#\s*TODO[:\s](.+)", ("#", "todo")),
]

LOOP = r"(?:for|while)\s*\([^)]*\)\s*\{"
CONCAT = r"""(?:\+=\s*['"`]|['"`]\s*\+\s*['"`])"""
# Linear forms (see Rule.linear).  Headers in front of one closing parenthesis share what follows it, so if one fails all do.
HEADER = r"(?:for|while)\s*\("
# Of the headers behind the first one, in front of the next brace, the last one alone can end in a brace.
NESTED_LINEAR = HEADER + r"[^)]*+(?:\)\s*+(?:\{(?:(?>[^{}]*" + HEADER + r")[^)]*+(?:\)\s*+(\{))?+)?+)?+)?+"
# A body without concatenation is passed over up to its last parenthesis: a header after that is still open, and reaches beyond.
CONCAT_LINEAR = HEADER + r"""[^)]*+(?:\)\s*+(?:\{(?:[^}]*(?:\+=\s*|['"`]\s*\+\s*)(['"`])|(?>[^}]*\))?+))?+)?+"""
# The first keyword after the start, then the first end after it; without either no later start has one.
COMMENT_LINEAR = r"/\*(?:(?>[\s\S]*?(?:const|let|var|function|if|for|while|return)\s)(?:[\s\S]*?\*(/)|[\s\S]*+)|[\s\S]*+)"

COMMENTED = [
    (r"//\s*(?:const|let|var|function|if|for|while|return|import|export)\s+", None, ("//",)),
    (r"/\*[\s\S]*?(?:const|let|var|function|if|for|while|return)\s+[\s\S]*?\*/", COMMENT_LINEAR, ("/*", "*/")),
]


def env_name(label: str) -> str:
    """Environment variable suggested for a kind of secret."""
    return re.sub("[^A-Z]", "_", label.upper())


def _build() -> list[Rule]:
    r: list[Rule] = []
    for i, (label, pattern, flags, needs) in enumerate(SECRETS, 1):
        r.append(Rule(
            f"B-{i:02}", "security", "critical", f"Exposed {label}",
            f"A {label.lower()} appears to be hardcoded in the source code. This is a serious security risk as it "
            "can be exposed in version control.",
            "Move this to environment variables or a secure secrets manager.",
            f"// Use environment variable\nconst apiKey = process.env.{env_name(label)};",
            pattern=pattern, flags=flags, needs=needs, group="secrets_basic"))
    for i, (pattern, needs) in enumerate(SQL_INJECTION, 13):
        r.append(Rule(
            f"B-{i}", "security", "critical", "Potential SQL Injection",
            "String concatenation or template literals used in SQL query. This can lead to SQL injection attacks.",
            "Use parameterized queries or prepared statements.",
            "// Use parameterized query\nawait db.query('SELECT * FROM users WHERE id = ?', [userId]);",
            pattern=pattern, flags="i", needs=needs, group="sql_injection_basic"))
    r.append(Rule(
        "B-19", "security", "critical", "Use of eval()",
        "eval() executes arbitrary code and is a major security risk, especially with user input.",
        "Avoid eval(). Use JSON.parse() for JSON data or Function constructor as last resort.",
        "// Parse JSON\nconst data = JSON.parse(jsonString);",
        pattern=r"\beval\s*\(", needs=("eval",), group="eval_basic"))
    r.append(Rule(
        "B-20", "security", "warning", "Potential XSS via innerHTML",
        "Using innerHTML with dynamic content can lead to Cross-Site Scripting (XSS) attacks.",
        "Use textContent for plain text or sanitize HTML input.",
        "// Safe alternative\nelement.textContent = userInput;\n// Or sanitize HTML\n"
        "element.innerHTML = DOMPurify.sanitize(htmlContent);",
        pattern=r"""\.innerHTML\s*=\s*(?!['"`])""", needs=(".innerHTML",), group="inner_html_basic"))
    for i, (algo, pattern, needs) in enumerate(WEAK_CRYPTO, 21):
        r.append(Rule(
            f"B-{i}", "security", "warning", f"Weak Cryptographic Algorithm: {algo}",
            f"{algo} is considered cryptographically weak and should not be used for security-sensitive operations.",
            "Use SHA-256 or stronger algorithms.",
            "const hash = crypto.createHash('sha256').update(data).digest('hex');",
            pattern=pattern, flags="i", needs=needs, group="weak_crypto_basic"))
    r.append(Rule(
        "B-25", "security", "info", "Hardcoded IP Address",
        "IP addresses should be configured externally for flexibility and security.",
        "Move IP addresses to configuration or environment variables.",
        "const serverIP = process.env.SERVER_IP || config.serverIP;",
        pattern=r"""['"`](\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})['"`]""",
        drop=r"""['"`](?:127\.|0\.|255\.255\.255\.255['"`])""", group="hardcoded_ip_basic"))

    r.append(Rule(
        "B-26", "performance", "info", "Array length accessed in loop condition",
        "Accessing .length in each iteration can be slightly inefficient for large arrays.",
        "Cache the length before the loop.",
        "const len = array.length;\nfor (let i = 0; i < len; i++) { ... }",
        pattern=r"for\s*\([^)]*\.length[^)]*\)", needs=("for", ".length"), group="perf_basic"))
    r.append(Rule(
        "B-27", "performance", "info", "Multiple Array Iterations",
        "Chained filter/map operations iterate the array multiple times. Consider using reduce for a single pass.",
        "Combine operations with reduce for better performance on large arrays.",
        "const result = array.reduce((acc, item) => {\n  if (condition) acc.push(transform(item));\n  return acc;\n}, []);",
        pattern=r"\.(?:filter|map)\([^)]+\)\s*\.(?:filter|map)\([^)]+\)", needs=(".filter(|.map(",), around=2,
        group="perf_basic"))
    r.append(Rule(
        "B-28", "performance", "warning", "Synchronous File System Operation",
        "Synchronous file operations block the event loop and can cause performance issues in production.",
        "Use asynchronous versions with async/await.",
        'const data = await fs.promises.readFile(path, "utf-8");',
        pattern=r"(?:readFileSync|writeFileSync|appendFileSync|existsSync|statSync|readdirSync)", needs=("Sync",),
        group="perf_basic"))
    r.append(Rule(
        "B-29", "performance", "info", "Nested Loop Detected",
        "Nested loops can lead to O(n²) complexity. Consider if this can be optimized.",
        "Consider using hash maps, Sets, or different algorithms to reduce complexity.",
        "// Example: Use a Set for O(1) lookups\nconst itemSet = new Set(items);\narray.filter(x => itemSet.has(x));",
        pattern=LOOP + r"[^{}]*" + LOOP, linear=NESTED_LINEAR, needs=("{", "for|while"), around=4, group="perf_basic"))
    r.append(Rule(
        "B-30", "performance", "info", "Simplifiable Loop Operation",
        "This loop runs {a} times and increments a counter by 1 each time. This can be simplified.",
        "Replace the loop with a direct addition of {a}.",
        "{b} += {a}; // Instead of looping {a} times",
        around=3, detector="simplifiable_loop", group="redundant_loops"))
    r.append(Rule(
        "B-31", "performance", "info", "Repeated Identical Operation",
        "The same function call is repeated multiple times. Consider if this is intentional.",
        "If the operation is expensive and returns the same result, cache it.",
        "const result = expensiveOperation();\n// Use result multiple times",
        # possessive: the same matches without recursion per repeat
        pattern=r"(\w+\([^)]*\));\s*(?:\1;\s*){2,}+", needs=("(", ");"), around=2, group="redundant_loops"))
    r.append(Rule(
        "B-32", "performance", "warning", "String Concatenation in Loop",
        "String concatenation in loops creates many intermediate strings. Use array.join() for better performance.",
        "Collect strings in an array and join at the end.",
        'const parts = [];\nfor (...) { parts.push(str); }\nconst result = parts.join("");',
        pattern=LOOP + r"[^}]*" + CONCAT, linear=CONCAT_LINEAR, needs=("{", "for|while", "+"), around=3, group="perf_basic"))
    r.append(Rule(
        "B-33", "performance", "info", "Console Statement",
        "Console statements should be removed or disabled in production code.",
        "Use a proper logging library with log levels or remove console statements.",
        '// Use a logging library\nlogger.debug("message");',
        pattern=r"console\.(log|debug|info)\s*\(", needs=("console.",), group="perf_basic"))

    r.append(Rule(
        "B-34", "quality", "info", "Line Too Long",
        "Line exceeds 120 characters ({a} chars). Consider breaking it up for readability.",
        detector="long_lines_basic", group="long_lines_basic"))
    r.append(Rule(
        "B-35", "quality", "warning", "Long Function",
        'Function "{a}" is {b} lines long. Consider breaking it into smaller functions.',
        "Extract logical blocks into separate, well-named functions.",
        "// Break into smaller functions\nfunction processData() { ... }\nfunction validateInput() { ... }",
        detector="long_basic", group="long_functions_basic"))
    r.append(Rule(
        "B-36", "quality", "info", "Magic Number",
        "The number {a} appears without explanation. Consider using a named constant.",
        "Define a named constant for clarity.",
        "const MEANINGFUL_NAME = {a};\n// Use MEANINGFUL_NAME instead",
        detector="magic_basic", group="magic_numbers_basic"))
    for i, (label, severity, pattern, needs) in enumerate(TODO, 37):
        r.append(Rule(
            f"B-{i}", "quality", severity, f"{label} Comment Found", "{a}",
            pattern=pattern, flags="i", needs=needs, around=0, detector="captured_text",
            group="todo_comments_basic"))
    r.append(Rule(
        "B-42", "quality", "info", "Non-descriptive Variable Name",
        'Single-letter variable "{a}" is not descriptive. Use meaningful names for clarity.',
        "Use descriptive names that explain the variable's purpose.",
        "// Example: const userCount = 5; instead of const c = 5;",
        detector="short_names", group="naming_docs_basic"))
    for i, (pattern, linear, needs) in enumerate(COMMENTED, 43):
        r.append(Rule(
            f"B-{i}", "quality", "info", "Commented-out Code",
            "Commented-out code should be removed. Use version control to track old code.",
            pattern=pattern, linear=linear, needs=needs, group="commented_code_basic"))
    r.append(Rule(
        "B-45", "quality", "info", "Missing Documentation",
        'Exported function "{a}" lacks documentation. Add JSDoc for better maintainability.',
        "Add JSDoc documentation.",
        "/**\n * Description of {a}\n * @param {type} param - Description\n * @returns {type} Description\n */",
        detector="undocumented_exports", group="naming_docs_basic"))

    r.append(Rule(
        "B-46", "unused", "warning", "Potentially Unused Variable",
        '"{a}" appears to be defined but not used in this file.',
        "Remove unused variables or prefix with underscore if intentionally unused.",
        "// Remove or prefix with _\nconst _{a} = value;",
        detector="unused_vars_basic", group="unused_variables_basic"))
    r.append(Rule(
        "B-47", "unused", "warning", "Unused Import", '"{a}" is imported but never used.',
        "Remove the unused import.", "// Remove unused import",
        around=0, detector="imports_basic", group="unused_imports_basic"))
    r.append(Rule(
        "B-48", "quality", "warning", "Empty Catch Block",
        "Empty catch blocks silently swallow errors. At minimum, log the error.",
        "Handle or log the error.",
        'catch (error) {\n  console.error("Error:", error);\n  // Handle appropriately\n}',
        pattern=r"catch\s*\([^)]*\)\s*\{\s*\}", needs=("catch",), group="exception_handling_basic"))
    return number([replace(x, suppress=False) for x in r])


RULES = _build()
