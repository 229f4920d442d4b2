"""The catalog's queries in DuckDB SQL, over the same tables.

The SQL is built from a few fragments: texts are cut into (piece, gap) rows with running sums of
their lengths, and put together again with ordered string aggregation.
"""

from __future__ import annotations

from cloakframe.functions.names import PROSE_KEYWORDS, python_names, registry_rows
from cloakframe.functions.patterns import (
    COMMON_FLOATS,
    EXTENSION_LANGUAGE,
    FORMAT_SPEC,
    KIND_GROUP,
    MATH_CONSTANTS,
    PERSONAL_DATA,
    PREFIX_LABEL,
    PRINT_CALLS,
    Rule,
)
from cloakframe.operators.compare import PENALTY
from cloakframe.operators.extract import NOT_CALLS

W = r"[\p{L}\p{N}_]+"
N = r"[\p{L}_][\p{L}\p{N}_]*"
TOKEN = r"g[vftcsnmx]_[0-9]{3,}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(q(v) for v in values)


def nl(column: str) -> str:
    return f"(length({column}) - length(replace({column}, chr(10), '')))"


def pieces(name: str, source: str, key: str, text: str, pattern: str) -> str:
    """CTEs ``{name}_t`` (key, t, ws, gs) and ``{name}`` (key, i, w, g, off, line, col)."""
    return rf"""
{name}_t AS (
  SELECT {key}, {text} AS t, regexp_extract_all({text}, {q(pattern)}) AS ws,
         regexp_split_to_array({text}, {q(pattern)}) AS gs
  FROM {source}),
{name}_u AS (
  SELECT {key}, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g, unnest(range(1, len(ws) + 1)) AS i FROM {name}_t),
{name}_o AS (
  SELECT {key}, i, w, g,
    (sum(length(g)) OVER o + coalesce(sum(length(w)) OVER b, 0))::BIGINT AS off,
    (sum({nl('g')}) OVER o + coalesce(sum({nl('w')}) OVER b, 0) + 1)::BIGINT AS line
  FROM {name}_u
  WINDOW o AS (PARTITION BY {key} ORDER BY i),
         b AS (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_s AS (
  SELECT *, CASE WHEN contains(g, chr(10)) THEN off - length(regexp_extract(g, '[^\n]*$')) END AS own,
            CASE WHEN contains(w, chr(10)) THEN off + length(w) - length(regexp_extract(w, '[^\n]*$')) END AS after
  FROM {name}_o),
{name} AS (
  SELECT {key}, i, w, g, off, line,
    (off - greatest(coalesce(max(own) OVER (PARTITION BY {key} ORDER BY i), 0),
       coalesce(max(after) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       + 1)::BIGINT AS col
  FROM {name}_s)"""


def woven(name: str, key: str, replaced: str, alias: str = "t") -> str:
    """SELECT of the text put together from ``replaced`` (key, i, r), over ``{name}_t``/``{name}_u``."""
    return f"""
SELECT p.{key}, coalesce(m.body, '') || p.gs[len(p.ws) + 1] AS {alias}
FROM {name}_t p LEFT JOIN (
  SELECT {key}, string_agg(g || r, '' ORDER BY i) AS body FROM ({replaced}) GROUP BY {key}) m USING ({key})"""


def is_name(w: str, protected=PROSE_KEYWORDS) -> str:
    return (
        f"(regexp_full_match({w}, {q(N)}) AND {w} NOT IN ({listed(protected)}) "
        f"AND NOT regexp_full_match({w}, '__.*__') AND {w} <> '_')"
    )


DOC_NAMES = f"""
doc_names AS (
  SELECT doc_id, w AS name, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(W)})) AS w FROM documents)
  WHERE {is_name('w')} GROUP BY 1, 2)"""


def numbered(name: str, source: str) -> str:
    """CTE of a dictionary over ``source`` (original, kind, scope, n_docs)."""
    prefix = (
        "CASE WHEN kind IN ('function', 'method') THEN 'gf' WHEN kind = 'string' THEN 'gs' "
        "WHEN kind = 'constant' THEN 'gc' ELSE 'gv' END"
    )
    return f"""
{name}_d AS (SELECT *, {prefix} AS prefix FROM ({source})),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY kind, scope, original) AS seq FROM {name}_d),
{name} AS (SELECT prefix || '_' || CASE WHEN seq < 1000 THEN lpad(seq::VARCHAR, 3, '0') ELSE seq::VARCHAR END AS token,
  prefix, seq, original, kind, scope, n_docs FROM {name}_n)"""


WORDS = (
    DOC_NAMES
    + ","
    + numbered(
        "words",
        "SELECT name AS original, 'variable' AS kind, '' AS scope, count(*) AS n_docs FROM doc_names GROUP BY name",
    )
)

RULES = [
    Rule("email", "string", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    *[r for r in PERSONAL_DATA if r.scope != "email"],
]
RULE_PATTERN = "|".join(f"(?:{r.pattern})" for r in RULES)


def rule_case(field: str, w: str) -> str:
    whens = " ".join(f"WHEN regexp_full_match({w}, {q(r.pattern)}) THEN {q(getattr(r, field))}" for r in RULES)
    return f"CASE {whens} END"


DOC_RULES = f"""
doc_rules AS (
  SELECT doc_id, w AS name, {rule_case('kind', 'w')} AS kind, {rule_case('scope', 'w')} AS scope, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(RULE_PATTERN)})) AS w FROM documents) GROUP BY ALL)"""
RULE_DICTIONARY = (
    DOC_RULES
    + ","
    + numbered(
        "personal",
        "SELECT name AS original, kind, scope, count(*) AS n_docs FROM doc_rules GROUP BY name, kind, scope",
    )
)

CODE = "replace(replace(replace(text, ', ', ', \"'), '. ', '. # '), '.' || chr(10), '.' || chr(10) || 'import ')"
CODE_DOCS = f"(SELECT doc_id, {CODE} AS text FROM documents)"
PY_STRINGS = (
    r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|' + r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
)
PY_SCAN = rf"{PY_STRINGS}|#[^\n]*|(?m:^[ \t]*(?:import|from) [^\n]*)|(?m:^[ \t]*@[^\n]*)|{W}"
PY_COMMENTS = r"\n[ \t]*(?:" + r'"""[\s\S]*?"""|' + rf"'''[\s\S]*?''')|{PY_STRINGS}|#[^\n]*"

EDITED = r"""CASE doc_id % 4 WHEN 0 THEN replace(text, ' the ', ' THE ')
  WHEN 1 THEN regexp_replace(text, '^[^\n]*\n', '')
  WHEN 2 THEN text || chr(10) || 'if gv_900 is None' || chr(10) || 'import extra_module' || chr(10) || 'Newpart by gf_901'
  ELSE replace(text, chr(10), chr(10) || chr(10)) END"""
EDITED_DOCS = f"(SELECT doc_id, {EDITED} AS text FROM documents)"

TURN_TABLE = "(SELECT conv_id * 4294967296 + turn AS turn_id, conv_id, turn, role, text FROM conversations)"
_TOK = "('gv_' || lpad((turn + 1)::VARCHAR, 3, '0'))"
REPLY = (
    f"'See `' || {_TOK} || '`, ' || {_TOK} || '''s value.' || chr(10) || '```python' || chr(10) || 'import os' || chr(10) || "
    f"{_TOK} || ' = gf_99999999(' || role || ')' || chr(10) || text || chr(10) || '```' || chr(10) || 'Then ' || {_TOK} || "
    "'.' || chr(10) || text"
)
REPLIES = f"(SELECT turn_id, turn, role, {REPLY} AS text FROM {TURN_TABLE})"

TURN_SYMBOLS = f"""
turn_symbols AS (
  SELECT DISTINCT conv_id, turn, w AS name, CASE WHEN (conv_id * 4294967296 + turn) % 2 = 0 THEN 'parameter' ELSE 'method' END AS kind,
    'turn' || turn AS scope
  FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, {q(W)})) AS w FROM conversations)
  WHERE {is_name('w')})"""


# --- literals -----------------------------------------------------------------------------

NUM = (
    r"0[xX][0-9a-fA-F]+[uUlL]*|[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?[fFlL]*|[0-9]*\.[0-9]+(?:[eE][+-]?[0-9]+)?[fFlL]*"
    r"|[0-9]+[eE][+-]?[0-9]+[fFlL]*|[0-9]+[uUlL]*"
)
LIT = rf'"[^"\\]*(?:\\[^\n][^"\\]*)*"|\b(?:{NUM})\b'
DOMAIN = (
    r"(?i)(/|\\\\|\.com|\.org|\.net|\.io|_id|_key|_token|_secret|_password|_auth|api/|http|ftp://"
    r"|\.json|\.xml|\.csv|\.dat|@|\.conf|\.cfg|\.env)"
)


def classified(source: str, key: str, names: str, known: str = "") -> str:
    """CTE ``lits`` with the decision for every literal of ``source`` (key, text).

    names: list or NULL; known: a CTE ``known`` (key, i, known) of names in strings.
    """
    given = f" LEFT JOIN known USING ({key}, i)" if known else ""
    constants = " ".join(f"WHEN abs(real - {v!r}) < 1e-6 THEN {q('known constant (' + n + ')')}" for v, n in MATH_CONSTANTS)
    known_constant = f"CASE {constants} END"
    common = ", ".join(f"{v!r}" for v in COMMON_FLOATS)
    return (
        pieces("lit", source, key, "text", LIT)
        + ("," + known if known else "")
        + rf""",
lit_a AS (
  SELECT l.*, s.names, {"known" if known else "NULL::VARCHAR"} AS given, substring(t.t, greatest(l.off - 79, 1), least(l.off, 80)) AS before,
    substring(t.t, l.off + 1, 20) AS after,
    string_split(t.t, chr(10))[l.line] AS full_line
  FROM lit l JOIN lit_t t USING ({key}) JOIN (SELECT {key}, {names} AS names FROM {source}) s USING ({key}){given}
  WHERE w NOT LIKE '.%' OR NOT regexp_matches(coalesce(substring(t.t, greatest(l.off, 1), least(l.off, 1)), ''), '_')),
lit_b AS (
  SELECT *, w LIKE '"%' AS quoted, trim(w, '"') AS v, regexp_replace(before, '\s+$', '') AS b,
    regexp_matches(full_line, '^\s*for') OR contains(left(full_line, col - 1), 'for (') AS looped,
    regexp_matches(full_line, '^\s*#include') AS included,
    regexp_replace(w, '[fFlLuU]+$', '') AS raw,
    coalesce(given, list_min(list_filter(names, lambda n: len(n) > 2 AND contains(trim(w, '"'), n)))) AS known
  FROM lit_a),
lit_c AS (
  SELECT *, CASE WHEN regexp_extract(b, '([\p{{L}}\p{{N}}_]+)\s*\([^)]*$', 1) IN ({listed(PRINT_CALLS)})
      OR contains(lower(regexp_extract(b, '([\p{{L}}\p{{N}}_]+)\s*\([^)]*$', 1)), 'log')
      OR contains(lower(regexp_extract(b, '([\p{{L}}\p{{N}}_]+)\s*\([^)]*$', 1)), 'print')
      OR contains(right(b, 30), '<<') THEN 'printf' ELSE 'other' END AS sctx,
    CASE WHEN looped THEN 'loop_bound' WHEN regexp_matches(right(before, 10) || after, '[<>]|==|!=') THEN 'comparison'
      WHEN regexp_matches(right(before, 10) || after, '[*/+%-]') THEN 'arithmetic' ELSE 'assignment' END AS nctx,
    regexp_matches(raw, '^0[xX]') AS hex,
    NOT regexp_matches(raw, '^0[xX]') AND regexp_matches(raw, '[.eE]') AS fl
  FROM lit_b),
lit_d AS (
  SELECT *, CASE WHEN NOT quoted AND fl THEN TRY_CAST(raw AS DOUBLE) END AS real,
    ltrim(regexp_replace(raw, '^0[xX]', ''), '0') AS digits
  FROM lit_c),
lits AS (
  SELECT {key}, i, w AS value, CASE WHEN quoted THEN 'string' ELSE 'number' END AS kind, off AS "offset",
    off + length(w) AS end_offset, line,
    CASE WHEN quoted THEN
      CASE WHEN length(v) <= 1 THEN 'keep' WHEN included THEN 'keep' WHEN regexp_matches(v, {q(DOMAIN)}) THEN 'scrub'
        WHEN known IS NOT NULL THEN 'scrub' WHEN sctx = 'printf' THEN 'scrub' WHEN length(v) > 20 THEN 'scrub'
        WHEN length(v) > 5 THEN 'flag' ELSE 'keep' END
    ELSE
      CASE WHEN hex AND length(raw) <= 2 THEN 'keep' WHEN NOT fl AND digits IN ('', '1', '2') THEN 'keep'
        WHEN {known_constant} IS NOT NULL THEN 'keep' WHEN real IN ({common}) THEN 'keep' WHEN hex THEN 'scrub'
        WHEN NOT fl AND (length(digits) > 3 OR TRY_CAST(digits AS INTEGER) > 100) THEN 'flag'
        WHEN NOT fl AND nctx = 'loop_bound' THEN 'flag' WHEN NOT fl THEN 'keep' ELSE 'flag' END
    END AS action,
    CASE WHEN quoted THEN
      CASE WHEN length(v) <= 1 THEN 'trivial string' WHEN included THEN 'include directive'
        WHEN regexp_matches(v, {q(DOMAIN)}) THEN 'domain indicator detected'
        WHEN known IS NOT NULL THEN 'contains symbol name ''' || known || ''''
        WHEN sctx = 'printf' THEN 'log/print string (business context)' WHEN length(v) > 20 THEN 'long descriptive string'
        WHEN length(v) > 5 THEN 'medium-length string (review recommended)' ELSE 'short string' END
    ELSE
      CASE WHEN hex AND length(raw) <= 2 THEN 'unparseable literal' WHEN NOT fl AND digits IN ('', '1', '2') THEN 'generic integer'
        WHEN {known_constant} IS NOT NULL THEN {known_constant} WHEN real IN ({common}) THEN 'common float default'
        WHEN hex THEN 'hex literal (potentially domain-specific)'
        WHEN NOT fl AND (length(digits) > 3 OR TRY_CAST(digits AS INTEGER) > 100) THEN 'large integer (review recommended)'
        WHEN NOT fl AND nctx = 'loop_bound' THEN 'loop bound dimension' WHEN NOT fl THEN 'small integer'
        ELSE 'non-trivial float (review recommended)' END
    END AS reason,
    CASE WHEN quoted THEN CASE WHEN length(v) <= 1 OR included THEN '' ELSE sctx END
    ELSE CASE WHEN (hex AND length(raw) <= 2) OR (NOT fl AND digits IN ('', '1', '2')) OR {known_constant} IS NOT NULL
      OR coalesce(real IN ({common}), false) THEN '' ELSE nctx END END AS context
  FROM lit_d)"""
    )


TITLE_WORDS = rf"regexp_extract_all(regexp_extract(text, '<title>([^<]*)</title>', 1), {q(W)})"
PAGES = "(SELECT page_id, html AS text FROM pages)"
PAGE_LITS = classified(PAGES, "page_id", TITLE_WORDS)


# --- sections and changes -----------------------------------------------------------------


def section_cte(name: str, source: str) -> str:
    """CTE ``{name}`` (doc_id, name, start_line, end_line, signature, body) by gaps and islands over lines."""
    return rf"""
{name}_l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM {source}),
{name}_h AS (
  SELECT *, regexp_extract(l, '^([\p{{Lu}}][\p{{L}}]*) ', 1) AS h,
    sum(CASE WHEN regexp_matches(l, '^[\p{{Lu}}][\p{{L}}]* ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS nth
  FROM {name}_l),
{name} AS (
  SELECT doc_id, nth, first(h ORDER BY i) AS name, min(i)::BIGINT AS start_line, (max(i) + 1)::BIGINT AS end_line,
    first(l ORDER BY i) AS signature, string_agg(l, chr(10) ORDER BY i) AS body
  FROM {name}_h WHERE nth > 0 GROUP BY doc_id, nth)"""


CHANGES = (
    section_cte("old_s", "documents")
    + ","
    + section_cte("new_s", EDITED_DOCS)
    + """,
old_k AS (SELECT doc_id, name, arg_max(signature, nth) AS signature, arg_max(body, nth) AS body FROM old_s GROUP BY 1, 2),
new_k AS (SELECT doc_id, name, arg_max(signature, nth) AS signature, arg_max(body, nth) AS body FROM new_s GROUP BY 1, 2),
section_diff AS (
  SELECT doc_id, CASE WHEN o.body IS NULL THEN 'new_function' WHEN n.body IS NULL THEN 'deleted_function'
    WHEN o.body = n.body THEN NULL WHEN o.signature IS DISTINCT FROM n.signature THEN 'signature_change'
    ELSE 'modified' END AS type, name
  FROM old_k o FULL JOIN new_k n USING (doc_id, name))"""
)


def token_pairs(source: str, key: str = "doc_id") -> str:
    return (
        f"SELECT {key}, w AS token, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(text, {q(W)})) AS w FROM {source}) "
        f"WHERE regexp_full_match(w, {q(TOKEN)}) GROUP BY 1, 2"
    )


def dependency_pairs(source: str) -> str:
    return rf"""SELECT DISTINCT doc_id, regexp_replace(l, '^\s+|\s+$', '', 'g') AS dependency
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM {source})
      WHERE regexp_matches(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^(?:#include|import |from )')"""


NEW_TOKENS = f"SELECT doc_id, token FROM ({token_pairs(EDITED_DOCS)}) EXCEPT SELECT doc_id, token FROM ({token_pairs('documents')})"


def new_dependencies(before: str, after: str) -> str:
    return f"{dependency_pairs(after)} EXCEPT {dependency_pairs(before)}"


def line_rows(side: str, source: str) -> str:
    body = r"regexp_replace(text, '\n$', '')"
    return f"""SELECT doc_id, '{side}' AS side, unnest(string_split({body}, chr(10))) AS line,
      unnest(range(0, len(string_split({body}, chr(10))))) AS pos FROM {source} WHERE text <> ''"""


BLOCKS = f"""
lines AS ({line_rows('old', 'documents')} UNION ALL {line_rows('new', EDITED_DOCS)}),
nths AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, side ORDER BY pos) AS nth FROM lines),
pairs AS (
  SELECT doc_id, line, nth, min(pos) FILTER (side = 'old') AS old_at, min(pos) FILTER (side = 'new') AS new_at
  FROM nths GROUP BY 1, 2, 3),
placed AS (
  SELECT *, coalesce(new_at,
      last_value(CASE WHEN old_at IS NOT NULL THEN new_at END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY old_at NULLS FIRST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS anchor,
    old_at IS NULL OR new_at IS NULL AS changed, CASE WHEN new_at IS NULL THEN 0 ELSE 1 END AS width
  FROM pairs),
reach AS (
  SELECT *, max(CASE WHEN changed THEN anchor + width END) OVER (PARTITION BY doc_id ORDER BY anchor, width, old_at NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM placed),
opened AS (
  SELECT *, sum(CASE WHEN changed AND anchor - coalesce(reach, -2) > 1 THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY anchor, width, old_at NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block
  FROM reach),
inside AS (
  SELECT *, first_value(CASE WHEN changed THEN block END IGNORE NULLS) OVER (PARTITION BY doc_id
      ORDER BY anchor, width, old_at NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_block
  FROM opened),
blocks_raw AS (
  SELECT doc_id, block::BIGINT AS block, min(anchor) FILTER (changed)::BIGINT AS start_line,
    max(anchor + width) FILTER (changed)::BIGINT AS end_line,
    count(*) FILTER (changed AND new_at IS NULL) AS deleted, count(*) FILTER (changed AND new_at IS NOT NULL) AS added,
    count(*) FILTER (NOT changed) AS between_lines,
    coalesce(list(line ORDER BY old_at) FILTER (old_at IS NOT NULL), []) AS olds,
    coalesce(list(line ORDER BY new_at) FILTER (new_at IS NOT NULL), []) AS news
  FROM inside WHERE block > 0 AND block = next_block GROUP BY doc_id, block),
blocks AS (
  SELECT doc_id, block, start_line, end_line,
    CASE WHEN deleted = 0 THEN 'added' WHEN added = 0 AND between_lines = 0 THEN 'deleted' ELSE 'modified' END AS block_type,
    CASE WHEN deleted = 0 THEN [] ELSE olds END AS olds, news
  FROM blocks_raw)"""

STRUCTURED = (
    "replace(replace(replace(replace(replace(text, ' the ', ' exp ('), ' de ', ' sort(a[1] [2]) < '), ' of ', ' read( SELECT '), "
    "' et ', ' if x > y socket( '), ' que ', ' md5 loss ')"
)
STRUCTURED_DOCS = f"(SELECT doc_id, {STRUCTURED} AS text, lang, source FROM documents)"
_L = r"(?:^|[^\p{L}\p{N}_])"
_R = r"(?:$|[^\p{L}\p{N}_])"
DETECTORS = [
    ("matrix/2D array indexing", r"\[[^\n]*?\]\s*\[[^\n]*?\]"),
    ("exponential function (exp)", rf"{_L}exp\s*\("),
    ("sorting operation", rf"{_L}(?:sort|sorted|std::sort|qsort)\s*\("),
    ("loop iteration", rf"{_L}(?:for|while)\s*[(:]|{_L}for\s+{W}\s+in{_R}"),
    ("file I/O operations", rf"{_L}(?:fopen|fread|fwrite|open|read|write|ifstream|ofstream)\s*\("),
    ("network I/O", rf"{_L}(?:socket|connect|send|recv|requests\.{W}|urllib|httpx|aiohttp)\s*[(.]"),
    ("cryptographic operations", rf"(?i){_L}(?:sha256|sha512|md5|hmac|encrypt|decrypt|AES|RSA|hashlib){_R}"),
    ("ML training loop", rf"{_L}(?:backward|gradient|loss|optimizer|train|epoch|batch_size){_R}"),
    ("database operations", rf"{_L}(?:SELECT|INSERT|UPDATE|DELETE|CREATE TABLE|cursor|execute|commit){_R}"),
    ("threshold/boundary check", rf"if\s*\(?\s*{W}\s*[<>]=?\s*{W}"),
]
SEEN = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN {q(n)} END" for n, p in DETECTORS) + "], lambda x: x IS NOT NULL)"

REPORT = (
    classified(f"(SELECT doc_id, {STRUCTURED} AS text FROM documents)", "doc_id", "NULL::VARCHAR[]")
    + f""",
flags AS (SELECT doc_id, count(*) FILTER (action = 'flag') AS flagged, count(*) FILTER (action = 'scrub') AS scrubbed,
    count(*) FILTER (action = 'keep') AS kept FROM lits GROUP BY 1),
rule_hits AS (
  SELECT doc_id, count(DISTINCT w) AS total, count(DISTINCT w) FILTER ({rule_case('kind', 'w')} = 'string') AS strings,
    count(DISTINCT w) FILTER ({rule_case('kind', 'w')} = 'constant') AS constants
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(RULE_PATTERN)})) AS w FROM {STRUCTURED_DOCS}) GROUP BY 1),
base AS (
  SELECT d.doc_id, lang, source, coalesce(total, 0) AS total_symbols, coalesce(strings, 0) AS strings,
    coalesce(constants, 0) AS constants, coalesce(flagged, 0) AS flagged, coalesce(scrubbed, 0) AS scrubbed,
    coalesce(kept, 0) AS kept, {SEEN} AS seen, len({SEEN}) AS n
  FROM {STRUCTURED_DOCS} d LEFT JOIN flags USING (doc_id) LEFT JOIN rule_hits USING (doc_id)),
report AS (
  SELECT *, (CASE WHEN flagged > 5 THEN 2 WHEN flagged > 0 THEN 1 ELSE 0 END + 1
      + CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END)::BIGINT AS exposure_score FROM base),
leveled AS (
  SELECT *, CASE WHEN exposure_score >= 4 THEN 'HIGH' WHEN exposure_score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS exposure_level
  FROM report)"""
)

REASONS = """list_filter([
  CASE WHEN flagged > 5 THEN 'literals to review, many: ' || flagged
       WHEN flagged > 0 THEN 'literals to review: ' || flagged END,
  'no section isolated',
  CASE WHEN n >= 4 THEN 'structures, many: ' || n
       WHEN n >= 2 THEN 'structures: ' || n END], lambda x: x IS NOT NULL)"""

LOG = """
log AS (
  SELECT event_id, ts AS "timestamp", CASE WHEN event_type IN ('view', 'click') THEN 'hide'
      WHEN event_type IN ('purchase', 'signup') THEN 'reveal' ELSE 'error' END AS action, 'u' || user_id AS "user",
    event_type IN ('view', 'click') AS hide, regexp_extract(props, '[0-9]+')::BIGINT AS n, * EXCLUDE (event_id)
  FROM events)"""

ADVICE = (
    r"""CASE WHEN turn % 2 = 1 THEN 'Please consider renaming `' || regexp_extract(text, '([\p{L}_]+)', 1) || '` to a clear word. '
  || regexp_extract(text, '([\p{L}_]+)[^\p{L}_]*$', 1) || ' should be renamed!' || chr(10) || 'It might be that the implementation of '
  || regexp_extract(text, '([\p{L}_]+)[^\p{L}_]*$', 1) || ' is wrong. ' || text ELSE text END"""
)
ADVICES = f"(SELECT turn_id, {ADVICE} AS text FROM {TURN_TABLE})"


def cut_sql(s: str) -> str:
    t = rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN length({t}) > 150 THEN left({t}, 150) || '...' ELSE {t} END"


MASKED = woven(
    "p",
    "doc_id",
    "SELECT p_u.doc_id, i, g, coalesce(token, w) AS r FROM p_u LEFT JOIN words ON words.original = p_u.w",
)
MASK_RENAME = f"""WITH {WORDS},{pieces('p', 'documents', 'doc_id', 'text', W)},
masked AS ({MASKED}), counts AS (SELECT doc_id, count(*) AS n FROM doc_names GROUP BY 1)
SELECT doc_id, sha256(t) AS masked_sha, coalesce(n, 0)::BIGINT AS n_tokens FROM masked LEFT JOIN counts USING (doc_id)"""


QUOTED = """(SELECT doc_id, replace(replace(text, ', ', ' "'), '. ', '" ') AS text FROM documents)"""
QUOTED_SCAN = r'"[^"\\]*(?:\\[^\n][^"\\]*)*"|' + W
KNOWN = f"""
known AS (
  SELECT doc_id, i, min(x) AS known FROM (
    SELECT doc_id, i, unnest(regexp_extract_all(w, {q(W)})) AS x FROM lit WHERE w LIKE '"%')
  JOIN words ON original = x WHERE length(x) > 2 GROUP BY 1, 2)"""
LEVEL_TWO = (
    f"""{pieces('p', QUOTED, 'doc_id', 'text', QUOTED_SCAN)},
doc_names AS (SELECT doc_id, w AS name, count(*) AS n FROM p WHERE {is_name('w')} GROUP BY 1, 2),
{numbered('words', "SELECT name AS original, 'variable' AS kind, '' AS scope, count(*) AS n_docs FROM doc_names GROUP BY name")},
renamed AS (SELECT m.doc_id, m.t AS text FROM ({MASKED}) m),
{classified('renamed', 'doc_id', 'NULL::VARCHAR[]', KNOWN)},
scrubs AS (
  SELECT doc_id, i, CASE WHEN kind = 'string' THEN substring(value, 2, length(value) - 2) ELSE value END AS original,
    CASE WHEN kind = 'string' THEN 'string' ELSE 'constant' END AS kind FROM lits WHERE action = 'scrub'),
{numbered('lit_d2', "SELECT original, kind, '' AS scope, count(DISTINCT doc_id) AS n_docs FROM scrubs GROUP BY 1, 2")},
lit_tokens AS (
  SELECT doc_id, i, CASE WHEN kind = 'string' THEN '"' || token || '"' ELSE token END AS tok FROM scrubs JOIN lit_d2 USING (original, kind))"""
)


def restored(source: str, entries: str) -> str:
    """CTE ``back`` (doc_id, t): ``source`` (doc_id, t) with the tokens of ``entries`` (token, original) replaced."""
    return f"""{pieces('r', f'(SELECT doc_id, t AS text FROM {source})', 'doc_id', 'text', W)}, entries AS ({entries}),
back AS ({woven('r', 'doc_id', 'SELECT r_u.doc_id, i, g, coalesce(original, w) AS r FROM r_u LEFT JOIN entries ON token = w')})"""


NAMES_AND_LITERALS = "SELECT token, original FROM words UNION ALL SELECT token, original FROM lit_d2"
LEVEL_TWO_TEXT = woven(
    "lit", "doc_id", "SELECT lit_u.doc_id, lit_u.i, g, coalesce(tok, w) AS r FROM lit_u LEFT JOIN lit_tokens USING (doc_id, i)"
)


def _describe() -> str:
    """The description rules, as far as they do not need a look-behind."""
    clean = r"list_filter(list_transform({0}, lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '')"
    some = lambda lst, pat: f"len(list_filter({lst}, lambda l: regexp_matches(l, {q(pat)}))) > 0"
    imports = r"^(?:import |from |#include)"
    added = rf"list_sort(list_distinct(list_filter(n, lambda l: regexp_matches(l, {q(imports)}) AND NOT list_contains(o, l))))"
    function = r"list_filter(list_transform(n, lambda l: regexp_extract(l, '^def\s+([\p{L}_][\p{L}\p{N}_]*)\s*\(', 1)), lambda f: f <> '')"
    return rf"""
described AS (
  SELECT doc_id, block, block_type, len(olds) AS n_old, len(news) AS n_new,
    {clean.format('olds')} AS o, {clean.format('news')} AS n FROM blocks),
zipped AS (
  SELECT *, list_filter(list_transform(range(1, length(o[1]) + 1), lambda k: o[1][k] || n[1][k]), lambda p: p[1] <> p[2]) AS d
  FROM described)
SELECT doc_id, block, block_type, CASE
  WHEN n_old = 0 THEN CASE
    WHEN len({function}) > 0 THEN 'new helper function ''' || {function}[1] || ''''
    WHEN len(list_filter(n, lambda l: NOT regexp_matches(l, {q(imports)}))) = 0 THEN 'added dependency: ' || array_to_string(n, ', ')
    WHEN {some('n', r'try:|try \{')} THEN 'error handling'
    WHEN {some('n', r'\.get\(|is None|is not None')} THEN 'null-safety check'
    WHEN {some('n', r'^if[ (]')} THEN 'added conditional check'
    ELSE 'added ' || n_new || ' lines' END
  WHEN n_new = 0 THEN 'removed ' || n_old || ' lines'
  WHEN {some('n', r'\.get\(')} AND NOT ({some('o', r'\.get\(')}) THEN 'null-safety check with .get()'
  WHEN {some('n', r'try:|try \{')} AND NOT ({some('o', r'try:|try \{')}) THEN 'error handling'
  WHEN {some('n', r'^if[ (]')} AND NOT ({some('o', r'^if[ (]')}) THEN 'wrapped in conditional check'
  WHEN len(o) = 1 AND len(n) = 1 AND length(o[1]) = length(n[1]) AND len(d) = 1
    AND regexp_matches(d[1], '[-+*/%<>=!&|^]') THEN 'changed ''' || d[1][1] || ''' to ''' || d[1][2] || ''''
  WHEN len({added}) > 0 THEN 'added dependency: ' || array_to_string({added}, ', ')
  ELSE 'modified ' || n_new || ' lines' END AS description
FROM zipped"""


_DESCRIBED, _SPOKEN = _describe().split("\nSELECT doc_id, block, block_type", 1)
_SPOKEN = "SELECT doc_id, block, block_type" + _SPOKEN


NAMING = [
    rf"(?i)(?:rename|renaming)\s+`?({N})`?",
    rf"(?i)`?({N})`?\s+(?:is a |has a )?(?:misleading|confusing|unclear|bad|poor)\s+(?:name|naming)",
    rf"(?i)(?:consider|try|suggest)\s+(?:calling|naming|renaming)\s+`?({N})`?",
    rf"(?i)(?:better|clearer|more descriptive)\s+name\s+(?:for|than)\s+`?({N})`?",
    rf"(?i)`?({N})`?\s+(?:should|could|might)\s+be\s+(?:renamed|called|named)",
    rf"(?i)(?:variable|function|class|method)\s+name\s+`?({N})`?",
]
GUESSES = [
    r"(?i)(?:might|may|could|probably|likely|possibly)\s+(?:be |cause |have |return |throw )",
    r"(?i)(?:I'm not sure|it's unclear|hard to tell|without seeing)",
    r"(?i)(?:assuming|if I had to guess|based on the name)",
    rf"(?i)(?:the implementation of|inside|within)\s+`?({N})`?",
    rf"(?i)(?:make sure|verify|check|ensure)\s+(?:that\s+)?`?({N})`?",
]


def phrase_hits(name: str, source: str, key: str, patterns: list[tuple[int, str, bool]]) -> str:
    """CTE ``{name}`` (key, template, name, off, sentence): every phrase with the sentence around it."""
    parts, unions = [], []
    for number, pattern, named in patterns:
        part = f"{name}{number}"
        parts.append(pieces(part, source, key, "text", pattern))
        found = f"regexp_extract(w, {q(pattern)}, 1)" if named else "''"
        unions.append(
            rf"""SELECT {part}.{key}, {number} AS template, {found} AS name, off,
              regexp_extract(substring(t, 1, off), '[^.!?\n]*$') || regexp_extract(substring(t, off + 1), '^[^.!?\n]*') AS sentence
              FROM {part} JOIN {part}_t USING ({key})"""
        )
    return ",".join(parts) + f",\n{name} AS ({' UNION ALL '.join(unions)})"


ORACLES: dict[str, str] = {
    "corpus_profile": """SELECT lang, source, count(*) AS n_docs, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines,
        sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1, 2""",
    "lang_route": f"""WITH routed AS (
        SELECT CASE {' '.join(f"WHEN ext = {q(e)} THEN {q(lang)}" for e, lang in EXTENSION_LANGUAGE.items())} END AS language, n_chars
        FROM (SELECT ['py', 'cpp', 'txt', 'h', 'hxx', 'md'][doc_id % 6 + 1] AS ext, n_chars FROM documents))
        SELECT language, count(*) AS n_files, sum(n_chars)::BIGINT AS n_chars FROM routed WHERE language IS NOT NULL GROUP BY 1""",
    "policy_banned": "SELECT page_id, url, "
    + " OR ".join(
        f"url GLOB {q(g)} OR split_part(url, '/', -1) GLOB {q(g)}"
        for g in ["*/fr/*", "*.net/en/*", "1*", "*#top", "*page=[2-4]*"]
    )
    + " AS banned FROM pages",
    "policy_layers": """WITH r AS (
          SELECT event_type, event_id % 97 = 0 AS repo, event_id AS n FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0)
        SELECT event_type, greatest(coalesce(max(n % 4 + 1) FILTER (repo), 1), 1)::INTEGER AS min_scrub_level,
          coalesce(max(n % 3 + 1) FILTER (NOT repo AND n % 3 > 0), 2)::INTEGER AS default_scrub_level,
          coalesce(bool_or(n % 5 = 0) FILTER (repo), false) AS block_level_1,
          coalesce(bool_or(false) FILTER (NOT repo AND n % 2 = 0), true) OR coalesce(bool_or(false) FILTER (repo AND n % 2 = 0), false) AS enforce_audit,
          coalesce(bool_or(n % 7 = 0) FILTER (NOT repo), false) OR coalesce(bool_or(n % 7 = 0) FILTER (repo), false) AS encrypt_maps,
          coalesce(string_agg(DISTINCT '*.' || (n % 6), ',' ORDER BY '*.' || (n % 6)) FILTER (repo), '') AS banned_patterns
        FROM r GROUP BY event_type""",
    "policy_gate": r"""WITH p AS (
          SELECT page_id, url, regexp_extract(url, '[^/]*$') AS base, coalesce(CASE WHEN page_id % 7 <> 0 THEN page_id % 4 + 1 END, 3) AS l FROM pages),
        hosts AS (SELECT DISTINCT regexp_extract(url, '//([^/?#]*)', 1) AS h FROM pages WHERE page_id % 25 = 0),
        fixed(pat, re) AS (VALUES ('*/fr/*', '/fr/'), ('*.net/en/*', '\.net/en/'), ('1*', '^1'), ('*#top', '#top$'), ('*page=[2-4]*', 'page=[2-4]'),
          ('*ref=[!a-w]', 'ref=[^a-w]$'), ('?', '^.$'), ('*[&?^]page=9*', '[&?\^]page=9'), ('*.org/[a-d]?/*', '\.org/[a-d]./')),
        hits AS (
          SELECT page_id, '*//' || h || '/*' AS pat FROM p JOIN hosts ON contains(url, '//' || h || '/')
          UNION ALL SELECT page_id, pat FROM p JOIN fixed ON regexp_matches(url, re) OR regexp_matches(base, re)),
        first AS (SELECT page_id, min(pat) AS pat FROM hits GROUP BY page_id)
        SELECT page_id, l::BIGINT AS effective_level, CASE WHEN l < 2 OR pat IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS status,
          CASE WHEN l = 1 THEN 'level 1 is blocked' WHEN pat IS NOT NULL THEN 'path matches banned pattern ' || pat ELSE '' END AS reason
        FROM p LEFT JOIN first USING (page_id)""",
    "policy_level_check": """WITH r AS (SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_id % 4 + 1 END, 3)::BIGINT AS l FROM events)
        SELECT event_id, l AS effective_level, CASE WHEN l < 2 THEN 'rejected' ELSE 'accepted' END AS status,
          CASE WHEN l = 1 THEN 'level 1 is blocked' ELSE '' END AS reason FROM r""",
    "occurrences": f"""WITH {pieces('p', 'documents', 'doc_id', 'text', W)}
        SELECT doc_id, w AS name, line, col, off AS "offset", off + length(w) AS end_offset FROM p WHERE {is_name('w')}""",
    "occurrences_code_only": f"""WITH {pieces('p', CODE_DOCS, 'doc_id', 'text', PY_SCAN)}
        SELECT doc_id, count(*) AS n, sum(off)::BIGINT AS offsets, sum(line)::BIGINT AS lines, sum(col)::BIGINT AS cols
        FROM p WHERE {is_name('w', python_names())} GROUP BY 1""",
    "protected_anti": f"""WITH {DOC_NAMES}
        SELECT lang, count(*) AS n_pairs, count(DISTINCT name) AS n_names FROM doc_names JOIN documents USING (doc_id)
        WHERE name NOT IN ({listed(python_names())}) GROUP BY 1""",
    "registry_semi": f"""WITH {DOC_NAMES}, reg(name, language, profile, category) AS (VALUES
        {', '.join('(' + listed(r) + ')' for r in registry_rows())})
        SELECT name, language, profile, category, count(*) AS n_docs FROM doc_names JOIN reg USING (name) GROUP BY ALL""",
    "symbols_by_rule": f"WITH {DOC_RULES} SELECT doc_id, name, kind, scope, n FROM doc_rules",
    "symbol_first": f"""WITH {TURN_SYMBOLS}
        SELECT conv_id, name, arg_min(kind, turn) AS kind, arg_min(scope, turn) AS scope FROM turn_symbols GROUP BY 1, 2""",
    "comment_spans": f"""WITH {pieces('p', PAGES, 'page_id', 'text', r'<!--[\s\S]*?-->')}
        SELECT page_id, off AS "offset", off + length(w) AS end_offset, line, w AS comment FROM p""",
    "import_names": rf"""WITH l AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {CODE_DOCS}),
        p AS (
          SELECT doc_id, line, unnest(string_split(regexp_replace(regexp_replace(line, '^\s*(?:from\s+\S+\s+)?import\s+', ''), '[()]|#.*$', '', 'g'), ',')) AS part
          FROM l WHERE regexp_matches(line, '^\s*(?:import|from)\s')),
        n AS (
          SELECT doc_id, trim(regexp_replace(part, '^.*\sas\s+', '')) AS name FROM p
          UNION SELECT doc_id, CASE WHEN regexp_matches(line, '^\s*import\s') THEN regexp_extract(part, '^\s*({N})', 1)
            ELSE regexp_extract(line, '^\s*from\s+({N})', 1) END FROM p)
        SELECT name, count(DISTINCT doc_id) AS n_docs FROM n WHERE regexp_full_match(name, '{N}(?:\.{N})*') GROUP BY 1""",
    "dict_build": f"""WITH {DOC_NAMES},{DOC_RULES},{numbered('d', '''
          SELECT name AS original, kind, scope, count(*) AS n_docs FROM (
            SELECT doc_id, name, 'variable' AS kind, '' AS scope FROM doc_names
            UNION ALL SELECT doc_id, name, kind, scope FROM doc_rules) GROUP BY 1, 2, 3''')}
        SELECT * FROM d""",
    "dict_multi_table": f"""WITH names AS (
          SELECT 'customer' AS source, c_custkey AS key, c_name AS original FROM customer
          UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
          UNION ALL SELECT 'part', p_partkey, p_name FROM part),
        {numbered('d', "SELECT original, 'string' AS kind, '' AS scope, count(*) AS n_docs FROM names GROUP BY 1")}
        SELECT source, key, token FROM names JOIN d USING (original)""",
    "dict_merge": f"""WITH {WORDS}, fresh_names AS (
          SELECT w AS original, count(DISTINCT item_id) AS n_docs
          FROM (SELECT item_id, unnest(regexp_extract_all(text, {q(W)})) AS w FROM benchmark) WHERE {is_name('w')} GROUP BY 1),
        fresh AS (
          SELECT original, n_docs, row_number() OVER (ORDER BY original) + (SELECT max(seq) FROM words) AS seq
          FROM fresh_names WHERE original NOT IN (SELECT original FROM words))
        SELECT token, prefix, seq, original, kind, scope, (words.n_docs + coalesce(f.n_docs, 0))::BIGINT AS n_docs
        FROM words LEFT JOIN fresh_names f USING (original)
        UNION ALL SELECT 'gv_' || CASE WHEN seq < 1000 THEN lpad(seq::VARCHAR, 3, '0') ELSE seq::VARCHAR END, 'gv', seq, original,
          'variable', '', n_docs FROM fresh""",
    "dict_lookup": f"""WITH {WORDS}
        SELECT DISTINCT item_id, w AS original, token
        FROM (SELECT item_id, unnest(regexp_extract_all(text, {q(W)})) AS w FROM benchmark) LEFT JOIN words ON original = w
        WHERE {is_name('w')}""",
    "dict_reverse": f"""WITH {TURN_SYMBOLS},{numbered('d', '''
          SELECT name AS original, kind, scope, count(DISTINCT conv_id) AS n_docs FROM turn_symbols GROUP BY 1, 2, 3''')}
        SELECT original, arg_max(token, (seq, token)) AS token FROM d GROUP BY 1""",
    "dict_summary": f"""WITH {WORDS},{RULE_DICTIONARY}
        SELECT kind, count(*) AS n_symbols, sum(n_docs)::BIGINT AS n_docs FROM (SELECT * FROM words UNION ALL SELECT * FROM personal) GROUP BY 1""",
    "dict_browse": f"""WITH {TURN_SYMBOLS},{numbered('d', '''
          SELECT name AS original, kind, scope, count(*) AS n_docs FROM turn_symbols GROUP BY 1, 2, 3''')},
        c AS (SELECT *, CASE {' '.join(f"WHEN kind = {q(k)} THEN {q(g)}" for k, g in KIND_GROUP.items())} ELSE 'Other' END AS category FROM d)
        SELECT CASE category WHEN 'Variables' THEN 1 ELSE 2 END::BIGINT AS category_rank, category,
          count(*) OVER (PARTITION BY category) AS category_size, token, original, scope FROM c""",
    "dict_files": f"""WITH {WORDS}
        SELECT token, count(DISTINCT source) AS n_files FROM doc_names JOIN documents USING (doc_id) JOIN words ON original = name GROUP BY 1""",
    "token_hover": f"""WITH {WORDS}, found AS ({token_pairs(REPLIES, 'turn_id')})
        SELECT turn_id, token, n, CASE WHEN original IS NULL THEN token || ' (' ||
            CASE left(token, 2) {' '.join(f"WHEN {q(p)} THEN {q(label)}" for p, label in PREFIX_LABEL.items())} ELSE 'Unknown' END || ')'
          ELSE token || ' → ' || original || ' · ' || kind || CASE WHEN scope <> '' THEN ' · ' || scope ELSE '' END END AS hover
        FROM found LEFT JOIN words USING (token)""",
    "token_collisions": f"""WITH {WORDS}, found AS ({token_pairs(REPLIES, 'turn_id')})
        SELECT turn_id, token, n FROM found WHERE token IN (SELECT token FROM words)""",
    "dict_stored": f"""WITH {RULE_DICTIONARY} SELECT token, prefix, n_docs, scope || '::' || original AS qualified FROM personal""",
    "dict_json_roundtrip": f"""WITH {WORDS}, f AS (
          SELECT name AS original, count(DISTINCT source) AS n_files FROM doc_names JOIN documents USING (doc_id) GROUP BY 1)
        SELECT token, original, kind, scope, n_docs, n_files FROM words LEFT JOIN f USING (original)""",
    "symbol_warnings": f"""WITH {DOC_NAMES} SELECT doc_id, 'unknown_kind' AS type, name AS symbol, 'kind ' || lang AS detail
        FROM doc_names JOIN documents USING (doc_id) WHERE lang <> 'en'""",
    "dict_encrypt_roundtrip": f"WITH {RULE_DICTIONARY} SELECT token, original, kind, scope FROM personal",
    "mask_rename": MASK_RENAME,
    "mask_level1": MASK_RENAME,
    "stream_mask": MASK_RENAME,
    "mask_level2": f"""WITH {LEVEL_TWO}, m AS ({LEVEL_TWO_TEXT}),
        {restored('m', NAMES_AND_LITERALS)}
        SELECT doc_id, sha256(m.t) AS masked_sha, back.t = s.text AS same_after_restore FROM m JOIN back USING (doc_id) JOIN {QUOTED} s USING (doc_id)""",
    "mask_level4": rf"""WITH {LEVEL_TWO}, two AS ({LEVEL_TWO_TEXT}),
        {pieces('b', '(SELECT doc_id, t AS text FROM two)', 'doc_id', 'text', r'[\p{L}\p{N}_.]+')},
        b_w AS (SELECT DISTINCT doc_id, w FROM b_u WHERE regexp_full_match(w, '[0-9]+') AND ltrim(w, '0') NOT IN ('', '1')),
        b_n AS (SELECT w, row_number() OVER (ORDER BY w) + (SELECT count(*) FROM lit_d2 WHERE prefix = 'gc') AS seq
          FROM (SELECT DISTINCT w FROM b_w)),
        m AS ({woven('b', 'doc_id', "SELECT b_u.doc_id, i, g, CASE WHEN seq IS NULL THEN b_u.w ELSE 'gc_' || CASE WHEN seq < 1000 THEN lpad(seq::VARCHAR, 3, '0') ELSE seq::VARCHAR END END AS r FROM b_u LEFT JOIN b_n USING (w)")}),
        {restored('m', NAMES_AND_LITERALS + " UNION ALL SELECT 'gc_' || CASE WHEN seq < 1000 THEN lpad(seq::VARCHAR, 3, '0') ELSE seq::VARCHAR END, w FROM b_n")}
        SELECT doc_id, sha256(m.t) AS masked_sha, back.t = s.text AS same_after_restore FROM m JOIN back USING (doc_id) JOIN {QUOTED} s USING (doc_id)""",
    "mask_corpus": f"""WITH files AS (
          SELECT doc_id, doc_id % 5 AS k, CASE WHEN doc_id // 5 % 5 = 0 THEN 2 ELSE doc_id // 5 % 5 END AS lvl, regexp_replace(text, '[0-9"]', '', 'g') AS text FROM documents),
        {pieces('p', "(SELECT doc_id, text FROM files WHERE k = 2)", 'doc_id', 'text', W)},
        scopes AS (SELECT doc_id, k, lvl, 'part_' || doc_id AS f, 'Holder_' || doc_id AS h,
          CASE WHEN k = 0 AND lvl < 3 THEN 'Holder_' || doc_id || '::' ELSE '' END || 'part_' || doc_id AS s FROM files WHERE k < 2),
        syms AS (
          SELECT DISTINCT doc_id, 'gv' AS prefix, 'variable' AS kind, '' AS scope, w AS original FROM p WHERE {is_name('w')}
          UNION ALL SELECT doc_id, 'gt', 'class', '', h FROM scopes WHERE k = 0
          UNION ALL SELECT doc_id, 'gf', CASE WHEN k = 0 AND lvl < 3 THEN 'method' ELSE 'function' END, CASE WHEN k = 0 AND lvl < 3 THEN h ELSE '' END, f FROM scopes
          UNION ALL SELECT doc_id, 'gv', 'parameter', s, 'first' FROM scopes
          UNION ALL SELECT doc_id, 'gv', 'variable', s, unnest(['label', 'step']) FROM scopes
          UNION ALL SELECT doc_id, 'gv', 'variable', s, 'kept' FROM scopes WHERE k = 0),
        entries AS (
          SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY kind, scope, original) AS n
          FROM (SELECT DISTINCT prefix, kind, scope, original FROM syms)),
        named AS (
          SELECT s.doc_id, s.kind, s.original, s.prefix || '_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS token
          FROM syms s JOIN entries USING (prefix, kind, scope, original)),
        code AS (
          SELECT doc_id, max(token) FILTER (WHERE kind = 'class') AS h, max(token) FILTER (WHERE kind IN ('function', 'method')) AS f,
            max(token) FILTER (WHERE original = 'first') AS p, max(token) FILTER (WHERE original = 'label') AS l,
            max(token) FILTER (WHERE original = 'step') AS st, max(token) FILTER (WHERE original = 'kept') AS kp
          FROM named JOIN scopes USING (doc_id) GROUP BY doc_id),
        strings AS (SELECT doc_id, row_number() OVER (ORDER BY 'customer record of number ' || doc_id) AS n FROM scopes WHERE lvl >= 2),
        filled AS (
          SELECT s.doc_id, s.k, s.lvl, true AS masked, c.h, c.f, c.p, c.l, c.st, c.kp, CASE WHEN n IS NULL THEN 'customer record of number ' || s.doc_id
              ELSE 'gs_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END END AS lab,
            CASE WHEN s.lvl >= 2 THEN 'gc_001' ELSE '0x2A' END AS x, CASE WHEN s.lvl >= 4 THEN 'gc_002' ELSE '25' END AS b
          FROM scopes s JOIN code c USING (doc_id) LEFT JOIN strings USING (doc_id)
          UNION ALL
          SELECT doc_id, k, lvl, false, h, f, 'first', 'label', 'step', 'kept', 'customer record of number ' || doc_id, '0x2A', '25' FROM scopes),
        texts AS (
          SELECT doc_id, masked, CASE
            WHEN k = 0 AND lvl < 3 THEN concat('import os', chr(10), chr(10), 'class ', h, ':', chr(10), '    def ', f, '(self, ', p, '):', chr(10), '        ', l, ' = "', lab, '"', chr(10),
              '        for ', st, ' in range(', b, '):', chr(10), '            ', kp, ' = ', p, ' + ', x, chr(10), '        return ', l, chr(10))
            WHEN k = 0 THEN concat('import os', chr(10), chr(10), 'class ', h, ':', chr(10), '    pass', chr(10), chr(10), 'def ', f, '(self, ', p, '):', chr(10), '    ', l, ' = "', lab, '"', chr(10),
              '    for ', st, ' in range(', b, '):', chr(10), '        ', kp, ' = ', p, ' + ', x, chr(10), '    return ', l)
            ELSE concat('#include <map>', chr(10), CASE WHEN lvl >= 3 THEN chr(10) ELSE '' END, 'int ', f, '(int ', p, ') {{', chr(10), '  auto ', l, ' = "', lab, '";', chr(10),
              '  for (int ', st, ' = 0; ', st, ' < ', b, '; ++', st, ') {{ kept(', p, ' + ', x, '); }}', chr(10), '  return ', p, ';', chr(10), '}}', CASE WHEN lvl < 3 THEN chr(10) ELSE '' END) END AS t
          FROM filled),
        prose AS ({woven('p', 'doc_id', 'SELECT p_u.doc_id, i, g, coalesce(token, w) AS r FROM p_u LEFT JOIN named ON named.doc_id = p_u.doc_id AND original = w')}),
        done AS (
          SELECT a.doc_id, sha256(a.t) AS masked_sha, sha256(b.t) AS restored_sha FROM texts a JOIN texts b ON a.doc_id = b.doc_id WHERE a.masked AND NOT b.masked
          UNION ALL SELECT doc_id, sha256(prose.t), sha256(text) FROM prose JOIN files USING (doc_id)),
        counts AS (SELECT doc_id, count(*) AS n FROM syms GROUP BY doc_id)
        SELECT doc_id, CASE k WHEN 1 THEN 'cpp' WHEN 2 THEN 'prose' WHEN 3 THEN NULL ELSE 'python' END AS language, lvl::BIGINT AS level,
          CASE WHEN k < 3 THEN 'accepted' ELSE 'rejected' END AS status,
          CASE k WHEN 3 THEN concat('unsupported file type ', chr(39), '.rs', chr(39)) WHEN 4 THEN 'path matches banned pattern secret/*' ELSE '' END AS reason,
          CASE WHEN k < 3 THEN coalesce(n, 0) END AS symbols_scrubbed, masked_sha, restored_sha
        FROM files LEFT JOIN done USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "roundtrip_lookalikes": r"""WITH a AS (SELECT doc_id, text, 'gv_' || lpad((doc_id % 500)::VARCHAR, 3, '0') || ' + gf_007 + gv_999999999999 + gv_1000000000000 + gv_1000000000002' AS alike FROM documents)
        SELECT doc_id, 'python' AS language, sha256('def work(first):' || chr(10) || '    kept = ' || alike || ' + first' || chr(10)) AS text_sha FROM a
        UNION ALL SELECT doc_id, 'prose', sha256(alike || ' ' || text || ' gs_002 gv_001') FROM a""",
    "masking_risk": f"""WITH {LEVEL_TWO}, m AS ({LEVEL_TWO_TEXT}),
        c AS (SELECT doc_id, count(*) FILTER (action = 'flag') AS flagged, count(*) FILTER (action = 'scrub') AS scrubbed FROM lits GROUP BY 1),
        k AS (SELECT doc_id, count(*) AS n FROM doc_names GROUP BY 1),
        j AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(flagged, 0) AS flagged, coalesce(scrubbed, 0) AS scrubbed,
            len({SEEN}) AS seen FROM (SELECT doc_id, t AS text FROM m) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)),
        e AS (SELECT *, CASE WHEN flagged > 5 THEN 2 WHEN flagged > 0 THEN 1 ELSE 0 END
            + CASE WHEN seen >= 4 THEN 2 WHEN seen >= 2 THEN 1 ELSE 0 END AS score FROM j)
        SELECT doc_id, n AS total_symbols, flagged, CASE WHEN score >= 4 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS exposure_level,
          n AS symbols_scrubbed, scrubbed AS literals_scrubbed FROM e""",
    "mask_personal_data": f"""WITH {RULE_DICTIONARY},{pieces('p', 'documents', 'doc_id', 'text', RULE_PATTERN)}, m AS ({woven('p', 'doc_id', '''
          SELECT p_u.doc_id, i, g, token AS r FROM p_u JOIN personal ON original = w''')})
        SELECT doc_id, sha256(t) AS masked_sha FROM m""",
    "mask_span": r"""SELECT doc_id, sha256(substring(text, 1, 10) || regexp_replace(substring(text, 11, 20), '[\p{L}\p{N}]', 'x', 'g')
        || substring(text, 31)) AS masked_sha FROM documents""",
    "strip_comments": rf"""WITH c AS (SELECT doc_id, regexp_replace({CODE},
          {q(f'({PY_STRINGS})' + r'|(?m:^)[ \t]*#[^\n]*(?:[ \t]*\n)?|[ \t]*#[^\n]*')}, '\1', 'g') AS t FROM documents)
        SELECT doc_id, sha256(t) AS bare_sha, length(t) AS n_chars FROM c""",
    "anonymize_comments": rf"""WITH {pieces('p', f"(SELECT doc_id, chr(10) || {CODE} AS text FROM documents)", 'doc_id', 'text', PY_COMMENTS)},
        k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id ORDER BY i DESC) AS n FROM p_u WHERE w LIKE '#%'),
        m AS ({woven('p', 'doc_id', "SELECT p_u.doc_id, p_u.i, g, CASE WHEN n IS NULL THEN w ELSE '# [gk_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || ']' END AS r FROM p_u LEFT JOIN k USING (doc_id, i)")})
        SELECT doc_id, sha256(substring(t, 2)) AS text_sha, (SELECT count(*) FROM k WHERE k.doc_id = m.doc_id) AS n_comments FROM m""",
    "restored_comments": f"SELECT doc_id, sha256({CODE}) AS text_sha FROM documents",
    "literals_extract": f'WITH {PAGE_LITS} SELECT page_id, value, kind, "offset", end_offset, line FROM lits',
    "literals_string_class": f"""WITH {PAGE_LITS}
        SELECT page_id, "offset", value, action, reason, context FROM lits WHERE kind = 'string'""",
    "literals_number_class": f"""WITH {classified('(SELECT doc_id, text FROM documents)', 'doc_id', 'NULL::VARCHAR[]')}
        SELECT doc_id, "offset", value, action, reason, context FROM lits WHERE kind = 'number'""",
    "literals_summary": f"""WITH {PAGE_LITS}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id, action ORDER BY i) AS nth FROM lits)
        SELECT page_id, count(*) FILTER (action = 'scrub') AS n_scrub, count(*) FILTER (action = 'keep') AS n_keep,
          count(*) FILTER (action = 'flag') AS n_flag,
          coalesce(string_agg(value, ', ' ORDER BY i) FILTER (action = 'keep' AND nth <= 10), '') AS kept_sample,
          coalesce(string_agg(line || ': ' || value || ' - ' || reason, chr(10) ORDER BY i) FILTER (action = 'flag'), '') AS flagged
        FROM pages LEFT JOIN k USING (page_id) GROUP BY 1""",
    "mask_literals": f"""WITH {PAGE_LITS}, s AS (
          SELECT page_id, i, CASE WHEN kind = 'string' THEN substring(value, 2, length(value) - 2) ELSE value END AS original,
            CASE WHEN kind = 'string' THEN 'string' ELSE 'constant' END AS kind FROM lits WHERE action = 'scrub'),
        {numbered('d', "SELECT original, kind, '' AS scope, count(DISTINCT page_id) AS n_docs FROM s GROUP BY 1, 2")},
        t AS (SELECT page_id, i, CASE WHEN kind = 'string' THEN '"' || token || '"' ELSE token END AS tok FROM s JOIN d USING (original, kind)),
        m AS ({woven('lit', 'page_id', 'SELECT lit_u.page_id, lit_u.i, g, coalesce(tok, w) AS r FROM lit_u LEFT JOIN t USING (page_id, i)')})
        SELECT page_id, sha256(t) AS masked_sha FROM m""",
    "format_spec_keep": rf"""WITH f AS (SELECT doc_id, '"' || replace(replace(text, ', ', ' %5.2f\n'), '. ', ' %s 100%% \t%-3d ') || '"' AS t FROM documents)
        SELECT doc_id, sha256('"' || array_to_string(regexp_extract_all(trim(t, '"'), {q(FORMAT_SPEC)}), ' ') || '"') AS format_sha FROM f""",
    "generalize_numbers": rf"""WITH {pieces('p', 'documents', 'doc_id', 'text', r'[\p{L}\p{N}_.]+')},
        b AS (SELECT DISTINCT doc_id, w FROM p_u WHERE regexp_full_match(w, '[0-9]+') AND ltrim(w, '0') NOT IN ('', '1')),
        {numbered('d', "SELECT w AS original, 'constant' AS kind, 'loop_bound' AS scope, count(*) AS n_docs FROM b GROUP BY 1")},
        m AS ({woven('p', 'doc_id', 'SELECT p_u.doc_id, i, g, coalesce(token, w) AS r FROM p_u LEFT JOIN d ON original = w')})
        SELECT doc_id, sha256(t) AS masked_sha FROM m""",
    "isolate_section": r"""WITH k AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
        SELECT conv_id, turn, role, CASE WHEN last THEN 'target' ELSE 'stub' END AS part,
          CASE WHEN last THEN text ELSE role || ': ' || regexp_extract(text, '^[^.!?\n]*') END AS text FROM k""",
    "sections": f"""WITH {section_cte('s', 'documents')}
        SELECT doc_id, name, start_line, end_line, sha256(body) AS body_sha FROM s""",
    "code_symbols_python": """WITH w AS (
          SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS name FROM documents),
        s AS (
          SELECT doc_id, 'v_' || name AS name, 'variable' AS kind, 'Holder::run' AS scope FROM w
          UNION ALL SELECT doc_id, 'Holder', 'class', '' FROM documents
          UNION ALL SELECT doc_id, 'run', 'method', 'Holder' FROM documents
          UNION ALL SELECT doc_id, 'first', 'parameter', 'Holder::run' FROM documents
          UNION ALL SELECT doc_id, 'kept', 'field', 'Holder::run' FROM documents)
        SELECT doc_id, kind, scope, count(*) AS n, sha256(string_agg(name, ',' ORDER BY name)) AS names_sha FROM s GROUP BY 1, 2, 3""",
    "code_symbols_cpp": """WITH w AS (
          SELECT doc_id, unnest(list_prepend('first', list_distinct(regexp_extract_all(text, '[A-Za-z]{3,}')))) AS name FROM documents),
        s AS (
          SELECT DISTINCT doc_id, 'e_' || name AS name, 'enum_constant' AS kind, 'corpus::Mode' AS scope FROM w
          UNION SELECT doc_id, 'f_' || name, 'field', 'corpus::Holder' FROM w
          UNION SELECT doc_id, 'p_' || name, 'parameter', 'corpus::Holder::run' FROM w
          UNION SELECT doc_id, 'v_' || name, 'variable', 'corpus::Holder::run' FROM w
          UNION SELECT doc_id, v.name, v.kind, v.scope FROM documents, (VALUES
            ('LIMIT', 'macro', ''), ('corpus', 'namespace', ''), ('Mode', 'enum', 'corpus'), ('Holder', 'class', 'corpus'),
            ('run', 'method', 'corpus::Holder'), ('p_none', 'parameter', 'corpus::Holder::run'), ('i', 'variable', 'corpus::Holder::run'),
            ('inner', 'variable', 'corpus::Holder::run'), ('Part', 'struct', 'corpus::Holder'), ('depth', 'field', 'corpus::Holder::Part'),
            ('later', 'method', 'corpus::Holder')) v(name, kind, scope))
        SELECT doc_id, kind, scope, count(*) AS n, sha256(string_agg(name, ',' ORDER BY name)) AS names_sha FROM s GROUP BY 1, 2, 3""",
    "sections_python": r"""WITH l AS (
          SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
        SELECT doc_id, 'part_' || i AS name, 7 * i + 1 AS start_line, 7 * i + 6 AS end_line,
          'def part_' || i || '(self, a,' || chr(10) || '            b=0)' AS signature,
          sha256('def part_' || i || '(self, a,' || chr(10) || '            b=0) -> int:' || chr(10) || '        kept = "'
            || regexp_replace(line, '[^A-Za-z ]', '', 'g') || '"' || chr(10) || chr(10) || '        return part_' || (i + 1) || '(a)') AS body_sha FROM l""",
    "sections_cpp": r"""WITH l AS (
          SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
        SELECT doc_id, 'part_' || i AS name, 6 * i AS start_line, 6 * i + 5 AS end_line, 'int Holder::part_' || i || '(int a)' AS signature,
          sha256('int Holder::part_' || i || '(int a)' || chr(10) || '{' || chr(10) || '  if (a) { kept("'
            || regexp_replace(line, '[^A-Za-z ]', '', 'g') || '"); }' || chr(10) || '  return part_' || (i + 1) || '(a);' || chr(10) || '}') AS body_sha FROM l""",
    "strings_by_substring": f"""WITH {pieces('lit', QUOTED, 'doc_id', 'text', LIT)}, names AS (
          SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_extract_all(text, {q(W)})) AS w FROM benchmark) WHERE {is_name('w')} AND length(w) > 2),
        kept AS (
          SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS "at" FROM lit JOIN lit_t t USING (doc_id)
          WHERE w NOT LIKE '.%' OR NOT regexp_matches(coalesce(substring(t.t, greatest(off, 1), least(off, 1)), ''), '_')),
        strings AS (SELECT DISTINCT trim(w, '"') AS v FROM kept WHERE w LIKE '"%'),
        held AS (SELECT v, min(name) AS name FROM strings JOIN names ON contains(v, name) GROUP BY v)
        SELECT doc_id, "at", name FROM kept JOIN held ON v = trim(w, '"') WHERE w LIKE '"%'""",
    "isolate_code": r"""WITH d AS (
          SELECT doc_id AS i, doc_id + 1 AS n, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS kept,
            'import os' || chr(10) || 'from lib import tool_' || doc_id || chr(10) AS head, chr(10) || '    pass  # stub' || chr(10) AS stub,
            (SELECT list(o.doc_id) FROM documents o WHERE o.doc_id IN (p.doc_id + 1, p.doc_id + 2)) AS others
          FROM documents p),
        t AS (
          SELECT *, chr(10) || '        kept = "' || kept || '"' || chr(10) || '        return shared(a) + part_' || n || '(a) + unknown_' || i || '(a)' AS body,
            'def shared(x):' || chr(10) || '    return tail_' || i || '(x)' AS shared, 'def tail_' || i || '(x):' AS tail FROM d)
        SELECT i AS doc_id, i % 3 <> 1 AS isolated, CASE WHEN i % 3 = 1 THEN 'isolation_missed: missing' END AS warning,
          sha256(CASE i % 3
            WHEN 1 THEN head || chr(10) || 'class Holder_' || i || ':' || chr(10) || '    def part_' || i || '(self, a):' || body || chr(10) || chr(10)
              || shared || chr(10) || chr(10) || tail || chr(10) || '    return x' || chr(10)
            WHEN 2 THEN head || chr(10) || '# Dependency stubs' || chr(10) || tail || stub || chr(10) || '# Target function' || chr(10) || shared
            ELSE head || chr(10) || '# Class context (stub)' || chr(10) || 'class Holder_' || i || ':  # stub' || chr(10) || '    pass' || chr(10) || chr(10)
              || '# Dependency stubs' || chr(10) || 'def shared(x):' || stub || tail || stub
              || CASE WHEN list_contains(others, n) THEN 'def part_' || n || '(self, a):' || stub
                   || CASE WHEN list_contains(others, n + 1) THEN 'def part_' || (n + 1) || '(self, a):' || stub ELSE '' END ELSE '' END
              || chr(10) || '# Target function' || chr(10) || 'def part_' || i || '(self, a):' || replace(body, chr(10) || '    ', chr(10)) END) AS text_sha
        FROM t""",
    "called_names": rf"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, ', ', ' (, '), '({W})\s*\(', 1)) AS w FROM documents)
        SELECT w AS callee, count(DISTINCT doc_id) AS n_docs FROM c
        WHERE regexp_full_match(w, '[A-Za-z_][\p{{L}}\p{{N}}_]*') AND w NOT IN ({listed(NOT_CALLS)}) GROUP BY 1""",
    "unmask": f"""WITH {DOC_NAMES}, counts AS (SELECT doc_id, count(*) AS n FROM doc_names GROUP BY 1)
        SELECT doc_id, sha256(text) AS text_sha, coalesce(n, 0) AS n_restored FROM documents LEFT JOIN counts USING (doc_id)""",
    "unknown_tokens": f"""WITH {WORDS}, found AS ({token_pairs(REPLIES, 'turn_id')})
        SELECT token, turn_id, n FROM found WHERE token NOT IN (SELECT token FROM words)""",
    "unmask_many": f"""WITH {WORDS},{pieces('p', 'documents', 'doc_id', 'text', W)},
        l AS (SELECT doc_id, lang AS map FROM documents),
        back AS (
          SELECT doc_id, i, g, coalesce(CASE WHEN token IS NULL THEN w WHEN map = 'en' THEN w WHEN map = 'fr' THEN 'le_' || w
            WHEN map = 'de' AND token < 'gv_5' THEN w ELSE 'NEW_' || token END, w) AS r,
            CASE WHEN map IN ('en', 'fr') OR map = 'de' AND token < 'gv_5' THEN token END AS known,
            CASE WHEN map IN ('en', 'fr') OR map = 'de' AND token < 'gv_5' THEN NULL ELSE token END AS lost
          FROM p_u JOIN l USING (doc_id) LEFT JOIN words ON words.original = p_u.w),
        t AS ({woven('p', 'doc_id', 'SELECT doc_id, i, g, r FROM back')}),
        n AS (SELECT doc_id, count(DISTINCT known) AS n_restored, count(DISTINCT lost) AS n_unknown FROM back GROUP BY doc_id)
        SELECT doc_id, map, coalesce(n_restored, 0) AS n_restored, coalesce(n_unknown, 0) AS n_unknown, sha256(t) AS text_sha
        FROM t JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "masked_written": f"""SELECT doc_id AS source_doc_id, 'documents' AS source, n_tokens, masked_sha FROM ({MASK_RENAME})""",
    "roundtrip": "SELECT count(*) AS n_docs, 0::BIGINT AS n_different FROM documents",
    "zones": r"""WITH r AS (SELECT turn_id, text FROM """
    + REPLIES
    + r"""), f AS (
          SELECT turn_id, unnest(string_split(text, '```')) AS part, unnest(range(0, len(string_split(text, '```')))) AS k FROM r),
        z AS (
          SELECT turn_id, k, 0 AS j, 'code_block' AS zone_type, regexp_extract(part, '^(\w*)\n', 1) AS language,
            regexp_replace(part, '^\w*\n', '') AS content FROM f WHERE k % 2 = 1
          UNION ALL
          SELECT turn_id, k, j, CASE WHEN j % 2 = 1 THEN 'inline_code' ELSE 'prose' END, '', content FROM (
            SELECT turn_id, k, unnest(string_split(part, '`')) AS content, unnest(range(0, len(string_split(part, '`')))) AS j
            FROM f WHERE k % 2 = 0) WHERE content <> '')
        SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY k, j) - 1 AS zone, zone_type, language,
          sha256(content) AS content_sha FROM z""",
    "unmask_zones": f"""WITH {WORDS}, t AS (SELECT *, {_TOK} AS tok FROM {TURN_TABLE}),
        o AS (SELECT t.*, coalesce(original, tok) AS v, coalesce(original, 'NEW_' || tok) AS c, original IS NOT NULL AS known FROM t LEFT JOIN words ON token = tok)
        SELECT turn_id, sha256('See `' || v || '`, ' || v || '''s value.' || chr(10) || '```python' || chr(10) || 'import os' || chr(10) || c
            || ' = NEW_gf_99999999(' || role || ')' || chr(10) || text || chr(10) || chr(10) || '```' || chr(10) || 'Then ' || v || '.' || chr(10) || text) AS explanation_sha,
          sha256('import os' || chr(10) || c || ' = NEW_gf_99999999(' || role || ')' || chr(10) || text || chr(10)) AS code_sha,
          known::INT::BIGINT AS n_restored, CASE WHEN known THEN 'gf_99999999' ELSE 'gf_99999999,' || tok END AS new_symbols,
          'import os' AS new_dependencies FROM o""",
    "dependencies": dependency_pairs(CODE_DOCS),
    "section_changes": f"WITH {CHANGES} SELECT doc_id, type, name FROM section_diff WHERE type IS NOT NULL",
    "token_except": NEW_TOKENS,
    "dependency_except": new_dependencies(CODE_DOCS, f"(SELECT doc_id, {EDITED} AS text FROM {CODE_DOCS})"),
    "confidence": f"""WITH {CHANGES}, c AS (
          SELECT doc_id, type FROM section_diff WHERE type IS NOT NULL
          UNION ALL SELECT doc_id, 'new_variable' FROM ({NEW_TOKENS})
          UNION ALL SELECT doc_id, 'new_dependency' FROM ({new_dependencies('documents', EDITED_DOCS)})),
        k AS (SELECT doc_id, count(*) AS n, sum(CASE type {' '.join(f"WHEN {q(t)} THEN {p}" for t, p in PENALTY.items())} END) AS cost FROM c GROUP BY 1),
        s AS (SELECT doc_id, coalesce(n, 0) AS n_changes, greatest(0, 100 - coalesce(cost, 0))::BIGINT AS score FROM documents LEFT JOIN k USING (doc_id))
        SELECT *, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s""",
    "change_blocks": f"""WITH {BLOCKS}
        SELECT doc_id, block, start_line, end_line, block_type, len(olds) AS n_original, len(news) AS n_new,
          sha256(array_to_string(news, chr(10))) AS new_sha FROM blocks""",
    "change_describe": f"WITH {BLOCKS},{_describe()}",
    "change_annotations": rf"""WITH {BLOCKS},{_DESCRIBED}, spoken AS ({_SPOKEN}),
        received AS (SELECT doc_id, text FROM {EDITED_DOCS}),
        own AS (SELECT doc_id, pos, 1 AS rank, line FROM lines WHERE side = 'new'),
        notes AS (
          SELECT b.doc_id, b.start_line AS pos, 0 AS rank, CASE WHEN regexp_matches(o.line, '\S') THEN repeat(' ', length(regexp_extract(o.line, '^(\s*)', 1))) ELSE '' END
            || '# --- ' || CASE b.block_type WHEN 'added' THEN 'AI ADDED' WHEN 'deleted' THEN 'AI REMOVED' ELSE 'AI MODIFIED' END || ': ' || s.description || ' ---' AS line
          FROM blocks b JOIN spoken s USING (doc_id, block) LEFT JOIN own o ON o.doc_id = b.doc_id AND o.pos = b.start_line),
        texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos, rank, line) AS t FROM (SELECT * FROM own UNION ALL SELECT * FROM notes) GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_notes, sha256(CASE WHEN n > 0 THEN t ELSE text END) AS text_sha
        FROM received LEFT JOIN texts USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM blocks GROUP BY 1) USING (doc_id)""",
    "risk_patterns": f"SELECT doc_id, array_to_string({SEEN}, '; ') AS patterns FROM {STRUCTURED_DOCS}",
    "risk_symbol_pivot": f"""WITH {TURN_SYMBOLS}
        SELECT conv_id, count(*) AS total_symbols, count(*) FILTER (kind = 'parameter') AS variables,
          count(*) FILTER (kind = 'method') AS functions, 0::BIGINT AS types, 0::BIGINT AS constants, 0::BIGINT AS strings, 0::BIGINT AS macros
        FROM turn_symbols GROUP BY 1""",
    "risk_score": f"""WITH {REPORT}
        SELECT doc_id, total_symbols, strings, constants, flagged, exposure_score, exposure_level,
          array_to_string({REASONS}, '; ') AS reasons FROM leveled""",
    "risk_json": f"""WITH {REPORT}
        SELECT doc_id, to_json({{'privacy_level': 3, 'total_symbols': total_symbols,
          'symbols_by_kind': {{'variables': 0, 'functions': 0, 'types': 0, 'constants': constants, 'strings': strings, 'macros': 0}},
          'literals': {{'scrubbed': scrubbed, 'flagged': flagged, 'kept': kept}}, 'comments': {{'count': 0, 'mode': 'stripped'}},
          'function_isolated': false, 'isolated_function': '', 'patterns_detected': seen, 'exposure_score': exposure_score,
          'exposure_level': exposure_level, 'exposure_reasons': {REASONS}, 'warnings_count': 0}})::VARCHAR AS report FROM leveled""",
    "risk_rollup": f"""WITH {REPORT}
        SELECT lang, source, count(*) AS n_docs, count(*) FILTER (exposure_level = 'HIGH') AS n_high,
          count(*) FILTER (exposure_level = 'MEDIUM') AS n_medium, sum(exposure_score)::BIGINT AS score
        FROM leveled GROUP BY ROLLUP (lang, source)""",
    "audit_hide": f"""WITH {WORDS},{pieces('p', 'documents', 'doc_id', 'text', W)}, masked AS ({MASKED}),
        counts AS (SELECT doc_id, count(*) AS n FROM doc_names GROUP BY 1)
        SELECT 'hide' AS action, doc_id::VARCHAR AS source_files, 1::BIGINT AS scrub_level, coalesce(n, 0) AS symbols_scrubbed,
          0::BIGINT AS warning_count, sha256(t) AS ghost_output_hash, 'unavailable' AS map_hash
        FROM masked LEFT JOIN counts USING (doc_id)""",
    "audit_reveal": f"""WITH {DOC_NAMES}, counts AS (SELECT doc_id, count(*) AS n FROM doc_names GROUP BY 1)
        SELECT 'reveal' AS action, doc_id::VARCHAR AS input_file, 'words' AS map_used, 'code' AS mode, coalesce(n, 0) AS symbols_restored,
          0::BIGINT AS new_symbols_detected, 'HIGH' AS confidence, sha256(text) AS output_hash
        FROM documents LEFT JOIN counts USING (doc_id)""",
    "content_hash": """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'unavailable' ELSE sha256(text) END AS digest,
        left(CASE WHEN turn % 3 = 2 THEN 'unavailable' ELSE sha256(text) END, 8) AS short FROM conversations""",
    "audit_recent": f"""WITH {LOG} SELECT event_id, "timestamp", action, "user" FROM log ORDER BY "timestamp" DESC, event_id DESC LIMIT 50""",
    "audit_totals": f"""WITH {LOG} SELECT count(*) FILTER (action = 'hide') AS hides, count(*) FILTER (action = 'reveal') AS reveals,
        sum(CASE WHEN hide THEN CASE WHEN event_id % 3 = 0 THEN 0 ELSE n END ELSE n END)::BIGINT AS symbols FROM log""",
    "audit_detail": f"""WITH {LOG}, s AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE n END AS syms FROM log WHERE action <> 'error')
        SELECT "timestamp", action, CASE WHEN hide THEN 'f' || user_id || '.py, g' || event_id || '.py' ELSE 'reply' || event_id || '.md' END AS files,
          CASE WHEN hide THEN concat_ws(' · ', CASE WHEN event_id % 5 > 0 THEN 'Level ' || event_id % 5 END,
              CASE WHEN syms > 0 THEN syms || ' symbols' END, CASE WHEN event_id % 4 > 0 THEN event_id % 4 || ' literals scrubbed' END,
              CASE WHEN event_id % 2 > 0 THEN event_id % 2 || ' flagged' END, CASE WHEN event_id % 11 = 0 THEN 'fn: main_part' END)
            ELSE concat_ws(' · ', CASE WHEN n > 0 THEN n || ' restored' END, CASE WHEN event_id % 2 > 0 THEN event_id % 2 || ' new symbols' END,
              CASE WHEN value > 10 THEN 'HIGH' ELSE 'LOW' END || ' confidence') END AS details,
          CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '1 warning' ELSE '2 warnings' END AS warnings,
          left(CASE WHEN hide THEN sha256(props) ELSE sha256(props || event_type) END, 8) AS hash FROM s""",
    "naming_advice": f"""WITH {WORDS},{phrase_hits('h', ADVICES, 'turn_id', [(i, p, True) for i, p in enumerate(NAMING, 1)])},
        f AS (SELECT turn_id, lower(name) AS k, template, arg_min(sentence, off) AS sentence FROM h GROUP BY 1, 2, 3)
        SELECT turn_id, original, template::BIGINT AS template, {cut_sql('sentence')} AS sentence FROM f JOIN words ON lower(original) = k""",
    "stub_speculation": f"""WITH {WORDS},
        {phrase_hits('h', ADVICES, 'turn_id', [(i, p, i > 3) for i, p in enumerate(GUESSES, 1)])},
        named AS (
          SELECT DISTINCT turn_id, w AS original FROM (SELECT turn_id, unnest(regexp_extract_all(text, {q(W)})) AS w FROM {ADVICES})
          WHERE w IN (SELECT original FROM words)),
        f AS (SELECT turn_id, lower(name) AS k, template, arg_min(sentence, off) AS sentence FROM h GROUP BY 1, 2, 3),
        phrased AS (SELECT turn_id, original, template, {cut_sql('sentence')} AS sentence FROM named JOIN f USING (turn_id)
          WHERE template <= 3 OR k = lower(original)),
        long_ones AS (
          SELECT turn_id, j, s FROM (
            SELECT turn_id, unnest(string_split(text, '.')) AS raw, unnest(range(0, len(string_split(text, '.')))) AS j FROM {ADVICES}),
            LATERAL (SELECT regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s)
          WHERE length(s) > 30 AND len(regexp_split_to_array(s, '\\s+')) > 10),
        discussed AS (
          SELECT turn_id, original, arg_min(s, j) AS sentence FROM (
            SELECT DISTINCT turn_id, j, s, unnest(regexp_extract_all(s, {q(W)})) AS original FROM long_ones)
          SEMI JOIN named USING (turn_id, original) ANTI JOIN phrased USING (turn_id, original) GROUP BY 1, 2)
        SELECT turn_id, original, template::BIGINT AS template, sentence FROM phrased
        UNION ALL SELECT turn_id, original, 0, sentence FROM discussed""",
    "sentences": rf"""WITH s AS (
          SELECT turn_id, unnest(l) AS s, unnest(range(0, len(l))) AS k FROM (
            SELECT turn_id, regexp_extract_all(text, '[^.!?\n]+') AS l FROM {TURN_TABLE})),
        c AS (SELECT turn_id, k, {cut_sql('s')} AS sentence FROM s)
        SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY k) - 1 AS nth, sentence FROM c WHERE sentence <> ''""",
    "annotated_replies": f"""WITH {WORDS},{phrase_hits('h', ADVICES, 'turn_id', [(i, p, True) for i, p in enumerate(NAMING, 1)])},
        f AS (SELECT turn_id, lower(name) AS k, template, arg_min(sentence, off) AS sentence FROM h GROUP BY 1, 2, 3),
        o AS (SELECT turn_id, original, template, token, {cut_sql('sentence')} AS s FROM f JOIN words ON lower(original) = k),
        r AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY original, template) AS i FROM o),
        n AS (SELECT turn_id, count(*) AS n, string_agg('[~~ ' || i || '] naming hint for token ' || token || ', which stands for ' || original
            || chr(10) || '   Context: "' || left(s, 80) || '..."' || chr(10) || chr(10), '' ORDER BY i) AS notes FROM r GROUP BY 1)
        SELECT turn_id, coalesce(n, 0) AS annotations, sha256(text || CASE WHEN n IS NULL THEN '' ELSE
            chr(10) || chr(10) || '---' || chr(10) || '**Annotations:**' || chr(10) || chr(10) || notes END) AS text_sha
        FROM {ADVICES} LEFT JOIN n USING (turn_id)""",
    "stream_audit": f"""WITH {LOG} SELECT ("timestamp"::DATE)::VARCHAR AS log_date, action, count(*) AS n,
        sum(CASE WHEN hide THEN CASE WHEN event_id % 3 = 0 THEN 0 ELSE n END END)::BIGINT AS symbols FROM log GROUP BY 1, 2""",
    "stream_totals": "SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2",
}
