"""DuckDB SQL with the results of the registered queries."""

from textloom.functions import words as W

SP = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def norm(x: str) -> str:
    return trim(rf"regexp_replace(coalesce({x}, ''), '[{SP}]+', ' ', 'g')")


TOKEN = rf"[A-Za-z][A-Za-z0-9_''-]*|[0-9]+(?:\.[0-9]+)?|[^{SP}]"


def tokens(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '{TOKEN}')"


def estimate(x: str) -> str:
    t = trim(f"coalesce({x}, '')")
    return rf"CASE WHEN {t} = '' THEN 0 ELSE greatest(1, CAST(ceil((len(regexp_extract_all({t}, '[A-Za-z0-9_]+|[^{SP}A-Za-z0-9_]')) + ceil(length({t}) / 4.0)) / 2.0) AS BIGINT)) END::BIGINT"


def clamp(x: str, n: int) -> str:
    t = trim(f"coalesce({x}, '')")
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE {trim(f'left({t}, {n - 3})')} || '...' END"


def protected(t: str) -> str:
    return (
        rf"(lower({t}) IN ({q(W.PROTECTED)}) OR regexp_matches({t}, '^!?=|[<>]=?$') OR regexp_matches({t}, '^[0-9]{{1,4}}([/-][0-9]{{1,2}}){{1,2}}$') OR regexp_matches({t}, '^[0-9]+(\.[0-9]+)?%?$')"
        rf" OR regexp_matches({t}, '^\$?[0-9]+(,[0-9]{{3}})*(\.[0-9]+)?$') OR regexp_matches({t}, '^v?[0-9]+\.[0-9]+(\.[0-9]+)?$'))"
    )


NUMBER = r"(\$?[0-9]+(,[0-9]{3})*(\.[0-9]+)?%?)|([0-9]{1,4}[/-][0-9]{1,2}([/-][0-9]{1,4})?)|([vV]?[0-9]+\.[0-9]+(\.[0-9]+)?)"
ENTITY = r"\b[A-Z][A-Za-z0-9_''-]{2,}\b|`[^`]+`|\b[A-Za-z]+[A-Z][A-Za-z0-9]*\b"
CODE = rf"```|=>|function[{SP}]+[A-Za-z0-9_]+|class[{SP}]+[A-Za-z0-9_]+|(import|export|throw|return)[{SP}]+|[{{}}();]"
DECISION = r"\b(decided|decision|must|should|todo|pending|decidimos|debe|pendiente|restriccion|restric)\b"

DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
SENTENCES = rf"""{DOCS}, s0 AS (SELECT doc_id, regexp_extract_all(replace(text, chr(13) || chr(10), chr(10)), '[^.!?\n]+[.!?\n]+|[^.!?\n]+$') AS l, replace(text, chr(13) || chr(10), chr(10)) AS whole FROM d),
s1 AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [whole] END AS l FROM s0)"""
FLAGGED = f"""{SENTENCES}, s2 AS (SELECT doc_id, generate_subscripts(l, 1) AS i, {trim('unnest(l)')} AS s FROM s1), s3 AS (SELECT * FROM s2 WHERE s <> ''),
s4 AS (SELECT *, len(list_filter({tokens('s')}, lambda t: {protected('t')})) > 0 AS f1, regexp_matches(s, '{NUMBER}') AS f2, regexp_matches(s, '{ENTITY}') AS f3, regexp_matches(s, '{CODE}') AS f4, regexp_matches(s, '(?i){DECISION}') AS f5 FROM s3),
s5 AS (SELECT *, list_filter([CASE WHEN f1 THEN 'protected-term' END, CASE WHEN f2 THEN 'number' END, CASE WHEN f3 THEN 'entity' END, CASE WHEN f4 THEN 'code-signal' END, CASE WHEN f5 THEN 'decision' END], lambda r: r IS NOT NULL) AS reasons FROM s4)"""
EXTRACTS = f"""{FLAGGED}, e1 AS (SELECT doc_id, i, s, {clamp('s', 260)} AS text, reasons FROM s5 WHERE len(reasons) > 0),
e2 AS (SELECT doc_id, 1 AS i, {trim('text')} AS s, {clamp('text', 220)} AS text, ['orientation'] AS reasons FROM d WHERE {trim('text')} <> '' AND doc_id NOT IN (SELECT doc_id FROM e1)),
e3 AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2), e4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY i) AS n FROM e3),
e5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e4 WHERE n = 1), e AS (SELECT * FROM e5 WHERE k <= 10)"""
RISK = f"""{EXTRACTS}, ec AS (SELECT doc_id, count(*) AS n_extracts FROM e GROUP BY doc_id),
r1 AS (SELECT d.doc_id, coalesce(n_extracts, 0) AS n_extracts, len(list_filter({tokens('text')}, lambda t: {protected('t')})) > 0 AS p, regexp_matches(text, '{NUMBER}') AS num, len(list_filter({tokens('text')}, lambda t: lower(t) IN ({q(W.ACTIONS)}))) > 0 AS act,
regexp_matches(text, '{CODE}') AS code, {estimate('text')} > 400 AS big FROM d LEFT JOIN ec USING (doc_id)),
r2 AS (SELECT *, least(98, 8 + CASE WHEN p THEN 22 ELSE 0 END + CASE WHEN num THEN 16 ELSE 0 END + CASE WHEN act AND p THEN 18 ELSE 0 END + CASE WHEN code THEN 18 ELSE 0 END + CASE WHEN n_extracts >= 4 THEN 12 ELSE 0 END + CASE WHEN big THEN 8 ELSE 0 END) AS h FROM r1),
risk AS (SELECT doc_id, n_extracts::BIGINT AS n_extracts, h / 100.0::DOUBLE AS score, CASE WHEN h >= 70 THEN 'high' WHEN h >= 40 THEN 'medium' ELSE 'low' END AS level, h >= 72 AS must_expand,
array_to_string(list_filter([CASE WHEN p THEN 'protected-terms' END, CASE WHEN num THEN 'numbers' END, CASE WHEN act AND p THEN 'negation-or-control-action' END, CASE WHEN code THEN 'code' END, CASE WHEN n_extracts >= 4 THEN 'many-critical-extracts' END, CASE WHEN big THEN 'long-context' END], lambda r: r IS NOT NULL), ',') AS reasons FROM r2)"""

_OPS = "|".join("".join("\\" + c for c in o) for o in W.LONG_OPERATORS) + "|[" + "".join("\\" + c for c in W.OPERATOR_CHARACTERS) + "]"
STRICT = rf"[\p{{L}}\p{{M}}\p{{N}}_$]+|{_OPS}|[^{SP}]"
KIND = rf"CASE WHEN regexp_matches(v, '^[\p{{L}}\p{{M}}\p{{N}}_$]') THEN CASE WHEN regexp_matches(v, '^\p{{N}}') THEN 'number' ELSE 'word' END WHEN regexp_full_match(v, '{_OPS}') THEN 'operator' ELSE 'punctuation' END"
_M = "18446744073709551616::UHUGEINT"


def fnv(x: str) -> str:
    """FNV-1a of a string's UTF-8 bytes, as UHUGEINT."""
    return (
        f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(strlen({x})), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i::INT + 1, 2) AS UHUGEINT))), "
        f"lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_M})"
    )


def grams(units: str, size: int, window: int) -> str:
    """CTEs from `units` (k, pos from 0, v): fp (k, position, hash as UHUGEINT) by winnowing."""
    base = W.GRAM_BASE
    power = [pow(base, size - 1 - i, 1 << 64) for i in range(size)]
    total = " + ".join(f"(lead(u, {i}) OVER w * {p}::UHUGEINT) % {_M}" for i, p in enumerate(power))
    return f"""h AS (SELECT v, {fnv('v')} AS u FROM (SELECT DISTINCT v FROM {units})), x AS (SELECT k, pos, u FROM {units} JOIN h USING (v)),
g0 AS (SELECT k, pos, ({total}) % {_M} AS hash, lead(u, {size - 1}) OVER w IS NOT NULL AS full_gram FROM x WINDOW w AS (PARTITION BY k ORDER BY pos)), g AS (SELECT k, pos, hash FROM g0 WHERE full_gram),
m AS (SELECT k, pos, min(hash * 1000000::UHUGEINT + (999999 - pos)::UHUGEINT) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS least, count(*) OVER (PARTITION BY k) AS n FROM g),
fp AS (SELECT DISTINCT k, (999999 - (least % 1000000::UHUGEINT)::BIGINT)::BIGINT AS position, least // 1000000::UHUGEINT AS hash FROM m WHERE pos >= least({window}, n) - 1)"""


def token_units(table: str, key: str) -> str:
    return f"t0 AS (SELECT {key} AS k, regexp_extract_all(coalesce(text, ''), '{STRICT}') AS l FROM {table}), t AS (SELECT k, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS v FROM t0)"


HEX = "lpad(lower(to_hex(hash)), 16, '0')"
FP = f"{token_units('documents', 'doc_id')}, {grams('t', W.TOKEN_GRAM, W.TOKEN_WINDOW)}"
CLASSES = f"""{FP}, sig AS (SELECT k, list((position, hash) ORDER BY position) AS s, count(*) AS n FROM fp GROUP BY k), cls AS (SELECT k, n, min(k) OVER (PARTITION BY s) AS rep FROM sig)"""
SHARED = f"""{CLASSES}, f AS (SELECT * FROM fp WHERE k IN (SELECT rep FROM cls)), c AS (SELECT hash, count(*) AS n, min(k) AS least FROM f GROUP BY hash), p AS (SELECT f.*, c.n, c.least FROM f JOIN c USING (hash)),
o AS (SELECT x.k AS a, y.k AS b, y.position - x.position AS off, count(*) AS n FROM p x JOIN p y ON x.hash = y.hash AND x.k < y.k WHERE x.n <= {W.STOP_COUNT} OR x.k = x.least GROUP BY ALL),
v AS (SELECT a, b, sum(n)::BIGINT AS votes, max(n)::BIGINT AS top FROM o GROUP BY a, b)"""

CONVERSATION = {
    "decisions": r"\b(decid|decision|decidimos|queda|acordamos|we will|we decided)\b",
    "constraints": r"\b(must|must not|should|should not|no |not |never|sin |debe|restric|constraint|avoid|evita)\b",
    "preferences": r"\b(prefiero|prefer|me gusta|i prefer|quiero que|tone|estilo)\b",
    "todos": r"\b(todo|pending|pendiente|siguiente|next|hacer|implementar|fix|arreglar)\b",
    "changes_of_mind": r"\b(cambio de opinion|mejor no|actually|instead|en vez|ya no|change)\b",
}
_CT = trim("coalesce(text, '')")
_FLAG = {k: f"regexp_matches({_CT}, '(?i){p}')" for k, p in CONVERSATION.items()} | {"negations": f"len(list_filter({tokens('text')}, lambda t: lower(t) IN ({q(W.PLAIN_NEGATIONS)}))) > 0", "open_questions": f"contains({_CT}, '?')"}
_NAMES = ("decisions", "constraints", "preferences", "todos", "negations", "changes_of_mind", "open_questions")

_IMPORT = rf"^(import|export[{SP}]+.*from|const[{SP}]+[A-Za-z0-9_]+[{SP}]*=[{SP}]*require\(|using[{SP}]+|from[{SP}]+[^{SP}]+[{SP}]+import[{SP}]+)"
_NAME = "[A-Za-z_$][A-Za-z0-9_$]*"
_FUNCTION = rf"^(?:export[{SP}]+)?(?:async[{SP}]+)?function[{SP}]+{_NAME}[{SP}]*\([^)]*\)|^(?:const|let|var)[{SP}]+{_NAME}[{SP}]*=[{SP}]*(?:async[{SP}]*)?\([^)]*\)[{SP}]*=>|^{_NAME}[{SP}]*\([^)]*\)[{SP}]*\{{"
_CLASS = rf"^(?:export[{SP}]+)?class[{SP}]+{_NAME}"
_ERROR = r"(?i)\b(error|exception|failed|failure|traceback|stack)\b"

SALIENCE = rf"""CASE WHEN NOT regexp_matches(t, '[A-Za-z0-9]') THEN 0.0::DOUBLE ELSE least(10, length(t)) - CASE WHEN lower(t) IN ({q(W.STOPWORDS)}) THEN 6 ELSE 0 END + CASE WHEN {protected('t')} THEN 8 ELSE 0 END
+ CASE WHEN regexp_matches(t, '[A-Z][a-z]+[A-Z]|_') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '^[A-Z][A-Za-z0-9_''-]+$') THEN 2 ELSE 0 END + greatest(0.0::DOUBLE, 3.0::DOUBLE - i * 0.05::DOUBLE) END"""

_RUNS = """{name}_c AS (SELECT word, i, {cls} AS c FROM (SELECT word, unnest(range(1, length({of}) + 1)) AS i, {of} AS of FROM w)), {name}_r AS (SELECT *, i - row_number() OVER (PARTITION BY word, c ORDER BY i) AS island FROM {name}_c),
{name} AS (SELECT word, string_agg(c || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY start_at) AS {name} FROM (SELECT word, c, island, min(i) AS start_at, count(*) AS n FROM {name}_r GROUP BY ALL) GROUP BY word)"""
_MASK = _RUNS.format(name="mask", of="word", cls=rf"CASE WHEN regexp_matches(substr(of, i, 1), '[A-Z]') THEN 'U' WHEN regexp_matches(substr(of, i, 1), '[a-z]') THEN 'L' WHEN regexp_matches(substr(of, i, 1), '[0-9]') THEN 'D' WHEN substr(of, i, 1) = '_' THEN '_' ELSE 'P' END")
_VC = _RUNS.format(name="vc", of="lower(word)", cls="CASE WHEN NOT regexp_matches(substr(of, i, 1), '[a-z]') THEN 'O' WHEN regexp_matches(substr(of, i, 1), '[aeiouy]') THEN 'V' ELSE 'C' END")
_NOW = "TIMESTAMP '2024-02-13 12:00:00'"
_SESSIONS = "s AS (SELECT user_id AS session_id, max(ts) AS last_accessed_at, count(*) AS n_events FROM events GROUP BY user_id)"

SQL = {
    "exact_source_dedup": "SELECT sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS byte_length, count(*) AS n_origins, min(doc_id) AS first_key FROM documents GROUP BY ALL",
    "source_origins": "SELECT sha256(coalesce(text, '')) AS sha256, doc_id AS key, count(*) OVER (PARTITION BY coalesce(text, '')) AS n FROM documents",
    "token_estimate": f"SELECT doc_id, {estimate('text')} AS tokens FROM documents",
    "message_token_estimate": f"SELECT conv_id, turn, {estimate('text')} AS tokens, length(coalesce(text, '')) >= 240 OR {estimate('text')} >= 60 AS long_message FROM conversations",
    "engine_token_counts": f"SELECT doc_id, len({tokens('text')})::BIGINT AS n_tokens, len(list_distinct({tokens('text')}))::BIGINT AS n_distinct FROM documents",
    "strict_token_counts": f"WITH {token_units('documents', 'doc_id')} SELECT k AS doc_id, {KIND} AS kind, count(*) AS n FROM t GROUP BY ALL",
    "keyword_only_documents": f"WITH {FP}, a AS (SELECT k, sum(n) AS total, count(*) AS different, max(n) AS most FROM (SELECT k, v, count(*) AS n FROM t GROUP BY ALL) GROUP BY k) SELECT doc_id FROM documents LEFT JOIN a ON a.k = doc_id WHERE doc_id NOT IN (SELECT k FROM fp) OR total < 5 OR different < 3 OR most / total > 0.8 OR total IS NULL",
    "protected_terms": f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_filter({tokens('text')}, lambda t: {protected('t')})) AS term FROM documents) GROUP BY ALL",
    "sentence_reasons": f"WITH {FLAGGED} SELECT doc_id, reason, count(*) AS n FROM (SELECT doc_id, unnest(reasons) AS reason FROM s5) GROUP BY ALL",
    "sentence_counts": f"WITH {SENTENCES} SELECT doc_id, len(l)::BIGINT AS n_sentences, list_max(list_transform(l, lambda x: length(x)))::BIGINT AS longest FROM s1",
    "risk_scores": f"WITH {RISK} SELECT * FROM risk",
    "critical_extracts": f"WITH {EXTRACTS} SELECT doc_id, (k - 1)::BIGINT AS i, text, text = s AS exact, array_to_string(reasons, ',') AS reasons, {estimate('s')} AS token_estimate FROM e",
    "char_shapes": f"WITH w AS (SELECT DISTINCT unnest({tokens('text')}) AS word FROM documents), {_MASK}, {_VC} SELECT word, length(lower(word))::BIGINT AS length, left(lower(word), 3) AS prefix, right(lower(word), 3) AS suffix, mask, vc FROM w JOIN mask USING (word) JOIN vc USING (word)",
    "anchor_terms": f"WITH a AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS t FROM (SELECT doc_id, {tokens('text')} AS l FROM documents)), b AS (SELECT doc_id, i, t, {SALIENCE} AS score FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS n FROM b WHERE score > 0) SELECT doc_id, i::BIGINT AS index, t AS token FROM c WHERE n <= 12",
    "conversation_memory": "SELECT conv_id, count(*) AS n_messages, " + ", ".join(f"count_if({_FLAG[n]})::BIGINT AS n_{n}" for n in _NAMES) + " FROM conversations GROUP BY conv_id",
    "conversation_open_questions": f"SELECT conv_id, (n - 1)::BIGINT AS idx, role, {clamp('text', 220)} AS preview FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE contains({_CT}, '?')",
    "joined_conversations": "SELECT conv_id, sha256(string_agg('[' || role || '#' || n || '] ' || text, chr(10) || chr(10) ORDER BY n)) AS sha256, count(*) AS n_messages FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations) GROUP BY conv_id",
    "code_signals": rf"""WITH l AS (SELECT page_id, {trim('unnest(string_split(coalesce(html, chr(0)), chr(10)))')} AS t FROM pages) SELECT page_id, count(*) AS n_lines, count_if(regexp_matches(t, '{_IMPORT}'))::BIGINT AS n_imports, count_if(regexp_matches(t, '{_FUNCTION}'))::BIGINT AS n_functions,
count_if(regexp_matches(t, '{_CLASS}'))::BIGINT AS n_classes, sum(len(list_filter(regexp_extract_all(t, '\b({_NAME})[{SP}]*\(', 1), lambda n: n NOT IN ({q(W.CALL_KEYWORDS)}))))::BIGINT AS n_calls, count_if(regexp_matches(t, '{_ERROR}'))::BIGINT AS n_errors FROM l GROUP BY page_id""",
    "file_modes": rf"SELECT page_id, CASE WHEN regexp_extract(lower(url), '[^/\\](\.[^./\\]+)$', 1) IN ({q(W.CODE_EXTENSIONS)}) THEN 'code' ELSE 'doc' END AS mode FROM pages",
    "token_hashes": f"WITH {token_units('benchmark', 'item_id')}, h AS (SELECT v, {fnv('v')} AS hash FROM (SELECT DISTINCT v FROM t)) SELECT v AS token, {HEX} AS hash FROM h",
    "token_fingerprints": f"WITH {FP} SELECT k AS doc_id, position, {HEX} AS hash FROM fp",
    "character_fingerprints": f"WITH t0 AS (SELECT item_id AS k, lower({norm('text')}) AS s FROM benchmark), t AS (SELECT k, unnest(range(length(s))) AS pos, substr(s, unnest(range(length(s)))::INT + 1, 1) AS v FROM t0), {grams('t', W.CHARACTER_GRAM, W.CHARACTER_WINDOW)} SELECT k AS item_id, position, {HEX} AS hash FROM fp",
    "frequent_hashes": f"WITH {FP} SELECT {HEX} AS hash, count(*) AS n FROM fp GROUP BY hash HAVING count(*) > 8",
    "near_duplicate_pairs": f"WITH {SHARED} SELECT a, b, votes, top, (SELECT count(*) FROM o WHERE o.a = v.a AND o.b = v.b AND o.n >= greatest(2, ceil(v.votes / 5.0)))::BIGINT AS peaks, floor(top / votes * 1e6 + 0.5) / 1e6 AS dominance FROM v WHERE votes >= 3 UNION ALL SELECT rep, k, n, n, 1, 1.0::DOUBLE FROM cls WHERE k <> rep AND n >= 3",
    "near_duplicate_classes": f"WITH {CLASSES} SELECT k AS doc_id, rep AS representative FROM cls",
    "benchmark_contamination": f"""WITH docs AS ({f"WITH {FP} SELECT DISTINCT k, hash FROM fp"}), items AS (WITH {token_units('benchmark', 'item_id')}, {grams('t', W.TOKEN_GRAM, W.TOKEN_WINDOW)} SELECT DISTINCT k, hash FROM fp), n AS (SELECT k, count(*) AS n FROM items GROUP BY k)
SELECT docs.k AS doc_id, items.k AS item_id, count(*) AS shared, floor(count(*) / any_value(n.n) * 1e6 + 0.5) / 1e6 AS containment FROM docs JOIN items USING (hash) JOIN n ON n.k = items.k GROUP BY docs.k, items.k HAVING count(*) / any_value(n.n) >= 0.6""",
    "keyword_search": f"""WITH a AS (SELECT item_id, unnest({tokens('text')}) AS w FROM benchmark), t AS (SELECT item_id, lower(w) AS w, count(*) AS times FROM a GROUP BY ALL), words AS (SELECT DISTINCT w FROM t),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), h AS (SELECT doc_id, w FROM d, words WHERE contains(low, w)), s AS (SELECT item_id, doc_id, sum(times)::BIGINT AS score FROM h JOIN t USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 8""",
    "usage_summary": f"WITH e AS (SELECT role, {estimate('text')} AS r, {estimate('c')} AS c FROM (SELECT role, text, {clamp('text', 120)} AS c FROM conversations)) SELECT role, count(*) AS operations, sum(r)::BIGINT AS raw_tokens, sum(c)::BIGINT AS compressed_tokens, sum(r - c)::BIGINT AS token_delta, CASE WHEN sum(r) = 0 THEN 0.0::DOUBLE ELSE floor((1 - sum(c)::DOUBLE / sum(r)::DOUBLE) * 10000 + 0.5) / 10000 END AS savings_ratio, count_if(c <= floor(r * 0.85::DOUBLE))::BIGINT AS compressed_operations, count_if(c > floor(r * 0.85::DOUBLE))::BIGINT AS skipped_operations FROM e GROUP BY role",
    "session_stats": "SELECT conv_id AS session_id, count(*) AS active_documents, count(*) AS active_handles, (SELECT sum(b)::BIGINT FROM (SELECT DISTINCT text, strlen(text) AS b FROM conversations i WHERE i.conv_id = o.conv_id)) AS approx_memory_bytes, sum(strlen(text))::BIGINT AS referenced_source_bytes FROM conversations o GROUP BY conv_id",
    "session_overview": f"WITH {_SESSIONS} SELECT session_id, n_events, greatest(0, floor((epoch({_NOW}) - floor(epoch(last_accessed_at))) / 86400.0))::BIGINT AS days_idle, (epoch({_NOW}) - floor(epoch(last_accessed_at))) / 86400.0 >= 14 AS is_stale, row_number() OVER (ORDER BY last_accessed_at DESC, session_id) AS place FROM s",
    "prune_plan": f"WITH {_SESSIONS}, m AS (SELECT *, last_accessed_at < {_NOW} - INTERVAL 14 DAY AS old FROM s), k AS (SELECT session_id, row_number() OVER (ORDER BY last_accessed_at DESC, session_id DESC) AS n FROM m WHERE NOT old) SELECT session_id, 'age' AS reason FROM m WHERE old UNION ALL SELECT session_id, 'count' FROM k WHERE n > 20",
    "last_usage_events": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5",
    "ledger_summary": "WITH l AS (SELECT * FROM (VALUES ('q1', 1000, 380, 2, 2), ('regression', 100, 130, 1, 0), ('q3', 400, 130, 0, 0)) v(id, raw, total, required, recovered)) SELECT count(*) AS cases, floor((sum(raw) - sum(total)) / sum(raw) * 1e6 + 0.5) / 1e6 AS aggregate_reduction, floor(quantile_disc((raw - total) / raw, 0.5) * 1e6 + 0.5) / 1e6 AS median_reduction, floor(sum(recovered) / sum(required) * 1e6 + 0.5) / 1e6 AS fact_fidelity, string_agg(CASE WHEN total > raw THEN id END, ',' ORDER BY id) AS regressions, sum(raw)::BIGINT AS raw_tokens, sum(total)::BIGINT AS compact_tokens FROM l",
    "label_quality_by_risk": f"WITH {RISK} SELECT level, quality, count(*) AS n, sum(toxic)::BIGINT AS toxic FROM risk JOIN labels USING (doc_id) GROUP BY ALL",
    "streamed_first_seen": "SELECT DISTINCT sha256(coalesce(text, '')) AS sha256 FROM documents",
}
