"""SQL of the same analyzers and rules for another engine, to check queries against."""

from __future__ import annotations

from lectern.functions.text import STOP_WORDS, SUFFIX_RULES

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: White space as the clean-up knows it, in an RE2 class.
SPACE = r"\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trim_all(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def _stem(t: str) -> str:
    single = f"regexp_replace(regexp_replace({t}, '(ss|i)es$', '\\1'), '([^aeious])s$', '\\1')"
    rules = "".join(f" WHEN regexp_replace(s, '{p}', '{by.replace('$1', chr(92) + '1')}') <> s AND length(regexp_replace(s, '{p}', '{by.replace('$1', chr(92) + '1')}')) >= 3 THEN regexp_replace(s, '{p}', '{by.replace('$1', chr(92) + '1')}')" for p, by in SUFFIX_RULES)
    return f"CASE WHEN length({t}) <= 3 THEN {t} ELSE list_transform([{single}], lambda s: CASE{rules} ELSE s END)[1] END"


def tokens(text: str) -> str:
    raw = f"list_transform(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9''$,.]*'), lambda x: regexp_replace(x, '['',.]+$', ''))"
    kept = f"list_filter({raw}, lambda x: length(x) > 1 AND x NOT IN ({STOP}))"
    return f"list_transform({kept}, lambda t: CASE WHEN regexp_matches(t, '[0-9$]') THEN t ELSE {_stem('t')} END)"


def shingles(text: str, n: int = 5) -> str:
    words = f"regexp_extract_all(lower({text}), '[a-z0-9'']+')"
    return f"list_transform([{words}], lambda t: list_distinct(list_transform(range(1, greatest(len(t) - {n - 1}, 0) + 1), lambda i: array_to_string(t[i:i + {n - 1}], ' '))))[1]"


INDEX = f"""tok AS (SELECT doc_id AS chunk_id, {tokens('text')} AS t FROM documents),
terms AS (SELECT chunk_id, word, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS word FROM tok) GROUP BY ALL),
lens AS (SELECT chunk_id, len(t) AS token_count FROM tok),
lexemes AS (SELECT word, count(*) AS ndoc FROM terms GROUP BY word),
stats AS (SELECT count(*)::double AS n, greatest(avg(token_count), 1) AS avg_len FROM lens)"""

BM25 = f"""{INDEX},
q AS (SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS word FROM benchmark),
scored AS (SELECT query_id, t.chunk_id, sum(ln(1 + (n - ndoc + 0.5) / (ndoc + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * token_count / avg_len))) AS raw
  FROM q JOIN terms t USING (word) JOIN lexemes USING (word) JOIN lens USING (chunk_id) CROSS JOIN stats GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, chunk_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) - 1 AS pos FROM scored) WHERE pos < 40)"""


def cosine(questions: str) -> str:
    """Top 40 of every vector that meets the condition."""
    return f"""qv AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE {questions}),
cs AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(qe::double[], embedding::double[]) AS raw FROM qv CROSS JOIN embeddings),
sem AS (SELECT * FROM (SELECT query_id, chunk_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) - 1 AS pos FROM cs) WHERE pos < 40)"""


#: All terms of the benchmark's questions and cover density over ``tok(chunk_id, t)``. The questions hold no quotes and no minus; ``or`` parts alternatives.
#: From a place x the span that ends there starts at the least of the terms' last places; each start counts with its first end.
STRICT = f"""alt AS (SELECT item_id AS query_id, list_distinct({tokens('part')}) AS w, n FROM (SELECT item_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM (SELECT item_id, regexp_split_to_array(text, '(?i)(?:^|[[:space:]]+)or(?:[[:space:]]+|$)') AS parts FROM benchmark))),
held AS (SELECT query_id, n, chunk_id, w, t FROM alt JOIN tok ON len(w) > 0 AND list_has_all(t, w)),
places AS (SELECT * FROM (SELECT query_id, n, chunk_id, w, unnest(t) AS word, generate_subscripts(t, 1) AS x FROM held) WHERE list_contains(w, word)),
lasts AS (SELECT a.query_id, a.n, a.chunk_id, a.x, len(a.w) AS need, b.word, max(b.x) AS latest FROM places a JOIN places b ON a.query_id = b.query_id AND a.n = b.n AND a.chunk_id = b.chunk_id AND b.x <= a.x GROUP BY ALL),
spans AS (SELECT query_id, n, chunk_id, x, min(latest) AS first_x FROM lasts GROUP BY query_id, n, chunk_id, x, need HAVING count(*) = need),
ended AS (SELECT query_id, n, chunk_id, first_x, min(x) AS x FROM spans GROUP BY ALL),
cover AS (SELECT query_id, chunk_id, max(raw) AS raw FROM (SELECT query_id, n, chunk_id, sum(1 / (x - first_x + 1)) AS raw FROM ended GROUP BY ALL) GROUP BY ALL),
strict_arm AS (SELECT * FROM (SELECT query_id, chunk_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) - 1 AS pos FROM cover) WHERE pos < 40)"""


def collapsed(text: str) -> str:
    """Letter spacing collapsed: a blank goes if runs of lone letters or digits on both its sides are four long together."""
    ends, starts, one = (f"regexp_matches(p[{{i}}], '{x}')" for x in ("(^|[^A-Za-z0-9])[A-Za-z0-9]$", "^[A-Za-z0-9]($|[^A-Za-z0-9])", "^[A-Za-z0-9]$"))

    def run(side: str, i: str, step: str, more: int) -> str:
        here = side.format(i=i)
        onward = f" + CASE WHEN coalesce({one.format(i=i)}, false) THEN {run(side, f'{i} {step}', step, more - 1)} ELSE 0 END" if more else ""
        return f"CASE WHEN coalesce({here}, false) THEN 1{onward} ELSE 0 END"

    gone = f"({run(ends, 'i', '- 1', 2)}) > 0 AND ({run(starts, 'i + 1', '+ 1', 2)}) > 0 AND ({run(ends, 'i', '- 1', 2)}) + ({run(starts, 'i + 1', '+ 1', 2)}) >= 4"
    return f"list_transform([string_split({text}, ' ')], lambda p: array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i = len(p) OR ({gone}) THEN '' ELSE ' ' END), ''))[1]"


def normalized(text: str) -> str:
    """Line ends, spaces and blank lines evened out."""
    for pattern, by in (("\\r\\n?", "chr(10)"), ("\\x{00A0}", "' '"), ("[ \\t]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return trim_all(text)


def purpose(text: str) -> str:
    """The first line that describes a worksheet."""
    lines = f"list_transform(string_split({text}, chr(10)), lambda x: {trim_all('x')})"
    prose = r"length(x) BETWEEN 25 AND 240 AND NOT regexp_matches(x, '(_{3,}|\.{5,}|\[[\s]*\]|^\s*[-–—]\s*$)') AND x <> upper(x) AND NOT regexp_matches(x, '(?i)^(your|list|write|enter|describe|fill)\b')".replace("\\\\", "\\")
    cut = f"list_transform(list_filter({lines}, lambda x: {prose}), lambda x: coalesce(nullif(regexp_extract(x, '^[^.!?]+[.!?]'), ''), x))"
    return trim_all(f"list_filter({cut}, lambda x: length(x) >= 25)[1]")
