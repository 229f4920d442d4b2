"""Patterns and rule tables.

Word boundaries are written as explicit character classes, since ``\\b`` differs between regex
engines on accented text. Repeated groups are possessive: Java would otherwise recurse once per
repetition and overflow its stack on long input.
"""

from __future__ import annotations

from dataclasses import dataclass

WORD_CHAR = r"[\p{L}\p{N}_]"
WORD = r"[\p{L}\p{N}_]+"
NAME = r"[\p{L}_][\p{L}\p{N}_]*"
IS_NAME = rf"^{NAME}$"

# Kind of symbol -> token prefix; a kind that is not listed gets "gx".
KIND_PREFIX = {
    "variable": "gv",
    "parameter": "gv",
    "field": "gv",
    "function": "gf",
    "method": "gf",
    "class": "gt",
    "struct": "gt",
    "enum": "gt",
    "enum_constant": "gv",
    "typedef": "gt",
    "type_alias": "gt",
    "constant": "gc",
    "string": "gs",
    "macro": "gm",
    "namespace": "gn",
}
OTHER_PREFIX = "gx"

# Display group per kind, groups in display order.
KIND_GROUP = {
    "variable": "Variables",
    "parameter": "Variables",
    "field": "Variables",
    "function": "Functions",
    "method": "Functions",
    "class": "Types",
    "struct": "Types",
    "enum": "Types",
    "typedef": "Types",
    "type_alias": "Types",
    "enum_constant": "Variables",
    "constant": "Constants",
    "string": "Strings",
    "macro": "Macros",
    "namespace": "Namespaces",
}
GROUP_ORDER = ["Variables", "Functions", "Types", "Constants", "Strings", "Macros", "Namespaces", "Other"]

# Label per token prefix.
PREFIX_LABEL = {
    "gv": "Variable",
    "gf": "Function",
    "gt": "Type",
    "gc": "Constant",
    "gs": "String",
    "gm": "Macro",
    "gn": "Namespace",
}

TOKEN = r"g[vftcsnmx]_[0-9]{3,}"
IS_TOKEN = rf"^{TOKEN}$"

# Comment placeholders have a prefix of their own, so that they never look like a constant.
PLACEHOLDER = r"\[gk_[0-9]{3,}\]"

DOUBLE_QUOTED = r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"'
_DOUBLE_LINE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
_SINGLE_LINE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_TRIPLE = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"
_STAR_COMMENT = r"/\*[\s\S]*?\*/"

STRINGS = {
    "python": f"{_TRIPLE}|{_DOUBLE_LINE}|{_SINGLE_LINE}",
    "cpp": f"{_DOUBLE_LINE}|{_SINGLE_LINE}",
    "html": r"(?!)",
}
COMMENTS = {
    "python": r"#[^\n]*",
    "cpp": rf"//[^\n]*|{_STAR_COMMENT}",
    "html": r"<!--[\s\S]*?-->",
}
DOCSTRING_LEAD = r"(?:\A\s*|:[ \t]*\n(?:[ \t]*\n)*+[ \t]*)"

# What a scan for names passes over as a whole, then the words themselves.
SCAN = {
    "prose": WORD,
    # Running text whose quoted passages are left to the literals.
    "quoted": f"{DOUBLE_QUOTED}|{WORD}",
    "python": "|".join(
        [STRINGS["python"], COMMENTS["python"], r"(?m:^[ \t]*(?:import|from) [^\n]*)", r"(?m:^[ \t]*@[^\n]*)", WORD]
    ),
    "cpp": "|".join(
        [STRINGS["cpp"], COMMENTS["cpp"], r"(?m:^[ \t]*#include[^\n]*)", rf"std::{WORD}", WORD]
    ),
}

# File extension -> language.
EXTENSION_LANGUAGE = {
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "c": "cpp",
    "h": "cpp",
    "hpp": "cpp",
    "hxx": "cpp",
    "py": "python",
}


@dataclass(frozen=True)
class Rule:
    """One row of a rule table: text that matches ``pattern`` is a symbol of this kind and scope.

    ``mark`` is a string that every match holds; texts without it are not searched for the rule.
    """

    scope: str
    kind: str
    pattern: str
    mark: str = ""


# Rules for structured personal data in running text; users add rows, not code. An address starts
# where its run of characters starts, or right after the piece before it: a long run without "@"
# is then read once and not once per character.
_MAIL = r"[A-Za-z0-9._%+-]"
PERSONAL_DATA = [
    Rule("email", "string", rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Rule("ipv4", "string", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    Rule("secret", "string", r"[0-9a-f]{40}"),
    Rule("phone", "string", r"\+[0-9][0-9 -]{7,14}[0-9]", "+"),
    Rule("number", "constant", r"[0-9]{12,}"),
]

# Numbers: hex, float, scientific, integer, with suffixes.
_SUFFIX = r"[fFlL]*"
NUMBER = (
    r"0[xX][0-9a-fA-F]+[uUlL]*"
    rf"|[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?{_SUFFIX}"
    rf"|[0-9]*\.[0-9]+(?:[eE][+-]?[0-9]+)?{_SUFFIX}"
    rf"|[0-9]+[eE][+-]?[0-9]+{_SUFFIX}"
    r"|[0-9]+[uUlL]*"
)
# A number starts and ends where a word starts or ends; ".5" only counts after a word character.
# What can't start a literal is told by one look at its character, before looking behind it.
LITERAL = (
    rf"(?=[\"0-9.])(?:{DOUBLE_QUOTED}"
    rf"|(?:(?=[0-9])(?<!{WORD_CHAR})|(?=\.)(?<=[\p{{L}}\p{{N}}]))(?:{NUMBER})"
    rf"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<=\.)(?={WORD_CHAR})))"
)
# Every literal holds one of these.
LITERAL_MARK = '["0-9]'

# Marks of business content inside a string.
DOMAIN_MARKS = (
    r"(?i)(/|\\\\|\.com|\.org|\.net|\.io|_id|_key|_token|_secret|_password|_auth|api/|http|ftp://"
    r"|\.json|\.xml|\.csv|\.dat|@|\.conf|\.cfg|\.env)"
)

# Names of print and log calls.
PRINT_CALLS = [
    "printf", "fprintf", "sprintf", "snprintf", "syslog", "LOG", "LOG_ERROR", "LOG_WARNING", "LOG_INFO", "LOG_DEBUG",
    "cout", "cerr", "clog", "print", "println", "logging", "logger", "log", "warn", "error", "info", "debug",
]

# Well-known constants and their names.
MATH_CONSTANTS = [
    (3.14159, "pi"),
    (3.141592653589793, "pi"),
    (2.71828, "e"),
    (2.718281828459045, "e"),
    (1.4142135623730951, "sqrt2"),
    (0.6931471805599453, "ln2"),
    (1.6180339887498949, "phi"),
    (6.283185307179586, "2pi"),
]
COMMON_FLOATS = [0.0, 1.0, -1.0, 0.5, 2.0]

FORMAT_SPEC = r"%[-+0 #]*[0-9]*\.?[0-9]*[diouxXeEfFgGaAcspn%]|\\[\s\S]"

# The head of a function up to the end of its line, and a call.
FUNCTION_HEAD = rf"def\s+{WORD}\s*\([^)]*\)[^\n]*\n"
CALL = rf"(?<!{WORD_CHAR}){WORD}\s*\("

# Structures that stay visible after masking; (description, pattern).
# Boundaries around the words are looked at, not consumed, and only where a word's first letter stands.
_B = rf"(?<!{WORD_CHAR})"
_E = rf"(?!{WORD_CHAR})"
STRUCTURES = [
    ("matrix/2D array indexing", r"\[[^\n]*?\]\s*\[[^\n]*?\]"),
    ("exponential function (exp)", rf"(?=e){_B}exp\s*\("),
    ("sorting operation", rf"(?=[sq]){_B}(?:sort|sorted|std::sort|qsort)\s*\("),
    # Found by the table of calls (risk.calls_itself); this says where to look.
    ("recursive function", r"def\s"),
    ("loop iteration", rf"(?=[fw]){_B}(?:(?:for|while)\s*[(:]|for\s+{WORD}\s+in{_E})"),
    ("file I/O operations", rf"(?=[fiorw]){_B}(?:fopen|fread|fwrite|open|read|write|ifstream|ofstream)\s*\("),
    (
        "network I/O",
        rf"(?=[achrsu]){_B}(?:socket|connect|send|recv|requests\.{WORD}|urllib|httpx|aiohttp)\s*[(.]",
    ),
    (
        "cryptographic operations",
        rf"(?i)(?=[adehmrs]){_B}(?:sha256|sha512|md5|hmac|encrypt|decrypt|AES|RSA|hashlib){_E}",
    ),
    (
        "ML training loop",
        rf"(?=[beglot]){_B}(?:backward|gradient|loss|optimizer|train|epoch|batch_size){_E}",
    ),
    (
        "database operations",
        rf"(?=[CDISUce]){_B}(?:SELECT|INSERT|UPDATE|DELETE|CREATE TABLE|cursor|execute|commit){_E}",
    ),
    ("threshold/boundary check", rf"if\s*\(?\s*{WORD}\s*[<>]=?\s*{WORD}"),
]

# Strings of which a text must hold one to show the structure; asked before its pattern.
STRUCTURE_MARKS = {
    "matrix/2D array indexing": ["["],
    "exponential function (exp)": ["exp"],
    "sorting operation": ["sort"],
    "recursive function": ["def"],
    "loop iteration": ["for", "while"],
    "file I/O operations": ["open", "read", "write", "ifstream", "ofstream"],
    "network I/O": ["socket", "connect", "send", "recv", "requests.", "urllib", "httpx", "aiohttp"],
    "ML training loop": ["backward", "gradient", "loss", "optimizer", "train", "epoch", "batch_size"],
    "database operations": ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE TABLE", "cursor", "execute", "commit"],
    "threshold/boundary check": ["if"],
}
