"""SQL twins of the registered queries, for a single-node check of their results."""

from __future__ import annotations

import re

from tidemark import fixed
from tidemark.plans import inputs as I

ORACLE: dict[str, str] = {}

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    def one(v):
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else text(v)

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


def edged(pattern: str) -> str:
    """A fixed pattern between word edges, for an engine without look-around."""
    inner = re.fullmatch(r"\\b\((.*)\)\\b", pattern).group(1)
    parts = []
    for alt in inner.split("|"):
        start = rf"(^|{NON_WORD})" if re.match(r"\w", alt) else WORD
        end = rf"({NON_WORD}|$)" if re.search(r"[\w\]?]$", alt) else WORD
        parts.append(start + "(" + alt + ")" + end)
    return "(?i)(" + "|".join(parts) + ")"


def contains_any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(w)})" for w in words) + ")"


def lookup(expr: str, table: dict[str, str], default: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items()) + f" ELSE {default} END"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


# --- scripts and rules --------------------------------------------------------------------

SCRIPTS = I.sql(I.SCRIPTS, "documents")

LINES = rf"""
raw_lines AS (
  SELECT doc_id, i, {strip('line')} AS line
  FROM (SELECT doc_id, unnest(string_split(final_script, chr(10))) AS line,
               generate_subscripts(string_split(final_script, chr(10)), 1) AS i FROM scripts)
),
kept_lines AS (
  SELECT * FROM raw_lines
  WHERE line <> '' AND NOT regexp_matches(line, '^[|\- ]*$') AND NOT starts_with(line, '### ')
    AND NOT (starts_with(line, '**') AND ends_with(line, '**'))
),
cells AS (
  SELECT doc_id, i, j, {strip('cell')} AS line
  FROM (SELECT doc_id, i, unnest(string_split(line, '|')) AS cell,
               generate_subscripts(string_split(line, '|'), 1) AS j FROM kept_lines)
),
lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS line_no, line
  FROM cells WHERE line <> ''
)"""

ORACLE["checkable_lines"] = f"WITH scripts AS ({SCRIPTS}), {LINES} SELECT doc_id, line_no, line FROM lines"


def _rule_rows() -> list[tuple]:
    rows = []
    for pattern, kind in fixed.ABSOLUTE_PATTERNS:
        un = kind == "unsupported_claim"
        rows.append((pattern, "unsupported_claim" if un else "local_law", "high" if un else "medium", False))
    rows += [(p, "unsupported_claim", "high", True) for p in fixed.SENSITIVE_PATTERNS]
    return rows


def issues_sql() -> str:
    """CTEs from ``scripts`` to ``issues`` (doc_id, issue_no, rule_no, excerpt, ...)."""
    modes = ", ".join(text(m) for m in fixed.DISCLOSURE_MODES)
    products = ", ".join(text(p) for p in fixed.SENSITIVE_PRODUCTS)
    fix = lookup("s.target_platform", fixed.DISCLOSURE_FIXES, text(fixed.DISCLOSURE_FIX_DEFAULT))
    parts = [
        f"""SELECT s.doc_id, 0 AS rule_no,
          coalesce((SELECT min_by(line, line_no) FROM lines l WHERE l.doc_id = s.doc_id), {text(fixed.DISCLOSURE_NO_LINE)}) AS excerpt,
          CASE WHEN s.distribution_mode = 'paid_ads' THEN 'high' ELSE 'medium' END AS risk_level,
          'disclosure' AS issue_type, {text(fixed.DISCLOSURE_REASON)} AS reason, {fix} AS suggested_fix
        FROM scripts s WHERE s.distribution_mode IN ({modes})
          AND NOT {contains_any('lower(s.final_script)', fixed.DISCLOSURE_KEYWORDS)}"""
    ]
    for n, (pattern, kind, risk, gated) in enumerate(_rule_rows(), 1):
        reason = fixed.SENSITIVE_REASON if gated else fixed.ABSOLUTE_REASON
        fix = fixed.SENSITIVE_FIX if gated else fixed.ABSOLUTE_FIX
        gate = f"AND s.product_category IN ({products})" if gated else ""
        parts.append(
            f"""SELECT l.doc_id, {n}, min_by(l.line, l.line_no), {text(risk)}, {text(kind)}, {text(reason)}, {text(fix)}
            FROM lines l JOIN scripts s USING (doc_id)
            WHERE regexp_matches(l.line, {text(edged(pattern))}) {gate} GROUP BY l.doc_id"""
        )
    union = " UNION ALL ".join(parts)
    return f"""{LINES},
    hits AS ({union}),
    firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, issue_type, excerpt ORDER BY rule_no) = 1),
    issues AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule_no) - 1 AS issue_no FROM firsts)"""


ORACLE["rule_issues"] = f"WITH scripts AS ({SCRIPTS}), {issues_sql()} SELECT * FROM issues"
ORACLE["script_risk"] = f"""WITH scripts AS ({SCRIPTS}), {issues_sql()}
SELECT s.doc_id, count(i.doc_id) AS issue_count,
  CASE WHEN bool_or(i.risk_level = 'high') THEN 'high' WHEN bool_or(i.risk_level = 'medium') THEN 'medium' ELSE 'low' END AS risk
FROM scripts s LEFT JOIN issues i USING (doc_id) GROUP BY s.doc_id"""
ORACLE["disclosure_gaps"] = f"""WITH scripts AS ({SCRIPTS})
SELECT source, distribution_mode, count(*) AS scripts,
  count(*) FILTER (WHERE NOT {contains_any('lower(final_script)', fixed.DISCLOSURE_KEYWORDS)}) AS undisclosed
FROM scripts WHERE distribution_mode IN ('branded_content', 'paid_ads') GROUP BY ALL"""


def _sensitive_sql() -> str:
    parts = [
        f"""SELECT l.doc_id, {n} AS rule_no, min_by(l.line, l.line_no) AS excerpt, s.product_category
        FROM lines l JOIN scripts s USING (doc_id)
        WHERE regexp_matches(l.line, {text(edged(p))})
          AND s.product_category IN ({', '.join(text(x) for x in fixed.SENSITIVE_PRODUCTS)})
        GROUP BY l.doc_id, s.product_category"""
        for n, p in enumerate(fixed.SENSITIVE_PATTERNS, len(fixed.ABSOLUTE_PATTERNS) + 1)
    ]
    return f"""WITH scripts AS ({SCRIPTS}), {LINES}, hits AS ({' UNION ALL '.join(parts)}),
    firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, excerpt ORDER BY rule_no) = 1)
    SELECT product_category, rule_no, count(*) AS scripts FROM firsts GROUP BY ALL"""


ORACLE["sensitive_claims"] = _sensitive_sql()

# --- scope --------------------------------------------------------------------------------

REGION = {m[0]: m[2] for m in fixed.MARKETS}
MARKET_LANGUAGE = {m[0]: m[3] for m in fixed.MARKETS}
MARKET_LABEL = {m[0]: m[1] for m in fixed.MARKETS}


def platform_sql(x: str) -> str:
    low = f"lower({strip(x)})"
    cases = " ".join(f"WHEN contains({low}, {text(a)}) THEN {text(n)}" for a, n in fixed.PLATFORM_ALIASES)
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'tiktok' {cases} ELSE replace({low}, ' ', '_') END"


def language_sql(x: str) -> str:
    low = f"lower({strip(x)})"
    return lookup(low, fixed.LANGUAGE_ALIASES, low)


ORACLE["scope_resolve"] = f"""WITH raw AS ({I.sql(I.RAW_SCOPES, 'customer')}),
named AS (SELECT *, {language_sql('language_one')} AS l1, {language_sql('language_two')} AS l2,
  {lookup('upper(target_country)', MARKET_LANGUAGE, 'NULL')} AS l3 FROM raw)
SELECT c_custkey, upper(target_country) AS target_country, {lookup('upper(target_country)', REGION, text('GLOBAL'))} AS target_region_pack,
  {platform_sql('target_platform')} AS target_platform, lower(distribution_mode) AS distribution_mode,
  lower(product_category) AS product_category, 'default' AS brand_id,
  l1 || CASE WHEN l2 <> l1 THEN ',' || l2 ELSE '' END
     || CASE WHEN l3 IS NOT NULL AND l3 <> l1 AND l3 <> l2 THEN ',' || l3 ELSE '' END AS knowledge_languages
FROM named"""

REQUESTS = f"""requests AS (
  SELECT *, {lookup('target_country', REGION, text('GLOBAL'))} AS target_region_pack, {language_sql('language_name')} AS lang_one,
    {lookup('target_country', MARKET_LANGUAGE, text(''))} AS lang_two
  FROM ({I.sql(I.REQUESTS, 'benchmark')}))"""

SCOPE = {
    "searched": """(d.platform IN (r.target_platform, 'all', 'global') AND d.distribution_mode IN (r.distribution_mode, 'all', 'global')
      AND d.brand_id IN (r.brand_id, 'all', 'global'))""",
    "in_scope": """(d.platform IN (r.target_platform, 'all', 'global') AND d.distribution_mode IN (r.distribution_mode, 'all', 'global')
      AND d.brand_id IN (r.brand_id, 'all', 'global')
      AND CASE WHEN d.country_code <> '' THEN d.country_code IN (r.target_country, 'GLOBAL', 'ALL')
          ELSE d.region_pack IN ('', r.target_region_pack, 'GLOBAL', 'ALL') END)""",
    "bonus": """(CASE WHEN d.country_code = r.target_country THEN 18 WHEN d.region_pack = r.target_region_pack THEN 10
        WHEN d.is_global_fallback THEN 2 ELSE 0 END
      + CASE WHEN d.platform = r.target_platform THEN 8 ELSE 0 END
      + CASE WHEN d.distribution_mode = r.distribution_mode THEN 6 ELSE 0 END
      + CASE d.priority WHEN 'P0' THEN 12 WHEN 'P1' THEN 8 WHEN 'P2' THEN 4 WHEN 'P3' THEN 1 ELSE 0 END
      + CASE WHEN d.language IN (lower(r.lang_one), lower(r.lang_two)) THEN 5 ELSE 0 END)""",
    "group": "CASE d.source_category WHEN 'market_law' THEN 'law' WHEN 'platform_policy' THEN 'platform' ELSE 'brand' END",
}
KNOWLEDGE = f"docs AS ({I.sql(I.KNOWLEDGE, 'documents')})"

ORACLE["scope_candidates"] = f"""WITH {KNOWLEDGE}, {REQUESTS}
SELECT r.request_id, d.source_category, count(*) FILTER (WHERE {SCOPE['searched']}) AS searched,
  count(*) FILTER (WHERE {SCOPE['in_scope']}) AS in_scope,
  CAST(sum(CASE WHEN {SCOPE['in_scope']} THEN {SCOPE['bonus']} ELSE 0 END) AS BIGINT) AS points
FROM docs d, requests r GROUP BY ALL
HAVING count(*) FILTER (WHERE {SCOPE['searched']}) > 0"""

# --- corpus -------------------------------------------------------------------------------

NOISY = f"docs AS ({I.sql(I.NOISY, 'documents')})"


def clean_line(x: str) -> str:
    return squeeze(f"translate({x}, chr(160) || chr(8211) || chr(8212) || chr(61623), ' --' || chr(8226))")


def line_key(x: str) -> str:
    return rf"{strip(rf'''regexp_replace(lower(regexp_replace({squeeze(x)}, '^[ |:\-]+|[ |:\-]+$', '', 'g')), '\s+\p{{Nd}}+$', '')''')}"


def dropped(x: str) -> str:
    s = clean_line(x)
    pats = [
        fixed.PAGE_NUMBER_PATTERN, fixed.EMPTY_TABLE_ROW_PATTERN, fixed.CONTENTS_LINK_PATTERN, fixed.FOOTER_SLOGAN_PATTERN
    ]
    tests = [f"regexp_matches({s}, {text(p)})" for p in pats]
    tests += [f"starts_with({s}, {text(p)})" for p in fixed.DROPPED_PREFIXES]
    marks = ", ".join(text(m) for m in ["table of contents", *fixed.WATERMARKS])
    return f"({s} <> '' AND (lower({s}) IN ({marks}) OR {' OR '.join(tests)}))"


def noise(x: str) -> str:
    s = f"lower({squeeze(x)})"
    marks = ", ".join(text(m) for m in fixed.NOISE_LINES)
    return f"({s} = '' OR regexp_matches({s}, '^{fixed.PAGE_LINE_PATTERN}$') OR {s} IN ({marks}))"


SPLIT = """numbered AS (SELECT doc_id, source, unnest(string_split(body, chr(10))) AS line,
  generate_subscripts(string_split(body, chr(10)), 1) AS i FROM docs)"""

ORACLE["repeated_lines"] = f"""WITH {NOISY}, {SPLIT}, keyed AS (SELECT doc_id, {line_key('line')} AS line_key FROM numbered)
SELECT doc_id, line_key, count(*) AS times FROM keyed WHERE line_key <> '' GROUP BY ALL HAVING count(*) >= 3"""
ORACLE["noise_lines"] = f"""WITH {NOISY}, {SPLIT}
SELECT source, count(*) AS lines, count(*) FILTER (WHERE {noise('line')}) AS block_noise,
  count(*) FILTER (WHERE {dropped('line')}) AS markdown_noise FROM numbered GROUP BY source"""
ORACLE["clean_lines"] = rf"""WITH {NOISY}, {SPLIT},
keyed AS (SELECT *, {line_key('line')} AS k FROM numbered),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed),
kept AS (SELECT * FROM counted WHERE NOT (k <> '' AND n >= 3 AND length(k) < 80) AND NOT {dropped('line')}),
blanked AS (SELECT doc_id, i, CASE WHEN {clean_line('line')} = '' THEN '' ELSE regexp_replace(replace(regexp_replace(line, '\s+$', ''), chr(9), ' '), '\s+$', '') END AS line FROM kept),
lagged AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM blanked),
single AS (SELECT doc_id, i, line, {line_key('line')} AS k FROM lagged WHERE NOT (line = '' AND coalesce(before, 'x') = '')),
repeats AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY i) AS kb FROM single),
lines AS (SELECT doc_id, i, line FROM repeats WHERE kb IS NULL OR line = '' OR k <> kb),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM lines GROUP BY doc_id),
tidy AS (SELECT doc_id, {strip(r"regexp_replace(regexp_replace(body, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g')")} AS body FROM joined)
SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM tidy"""

# --- chunks -------------------------------------------------------------------------------

BLOCKS = rf"""{KNOWLEDGE},
pieces AS (SELECT doc_id, unnest(string_split(body, chr(10) || chr(10))) AS raw,
  generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS i FROM docs),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_no,
  CASE WHEN i = 1 THEN 'heading' ELSE 'paragraph' END AS kind, {squeeze('raw')} AS text FROM pieces WHERE {squeeze('raw')} <> '')"""
ORACLE["block_rows"] = f"WITH {BLOCKS} SELECT doc_id, block_no, kind, md5(text) AS digest FROM blocks"

N = fixed.CHUNK_CHARS
CHUNKS = rf"""{BLOCKS},
sentences AS (
  SELECT doc_id, block_no, unnest(parts) AS s, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, block_no, string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts
        FROM blocks WHERE kind = 'paragraph')),
measured AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id, block_no ORDER BY i) AS c FROM sentences WHERE s <> ''),
next_part AS (
  SELECT a.doc_id, a.block_no, a.i, min(b.i) AS n
  FROM measured a LEFT JOIN measured b ON a.doc_id = b.doc_id AND a.block_no = b.block_no AND b.i > a.i
    AND b.c - (a.c - length(a.s) - 1) - 1 > {N} GROUP BY ALL),
part_starts AS (
  WITH RECURSIVE walk AS (
    SELECT doc_id, block_no, i, n FROM next_part WHERE i = 1
    UNION ALL SELECT p.doc_id, p.block_no, p.i, p.n FROM walk w JOIN next_part p ON p.doc_id = w.doc_id AND p.block_no = w.block_no AND p.i = w.n)
  SELECT * FROM walk),
parts AS (
  SELECT m.doc_id, m.block_no, p.i AS part_start, string_agg(m.s, ' ' ORDER BY m.i) AS part
  FROM part_starts p JOIN measured m ON m.doc_id = p.doc_id AND m.block_no = p.block_no AND m.i >= p.i AND (p.n IS NULL OR m.i < p.n)
  GROUP BY ALL),
candidates AS (
  SELECT doc_id, part, row_number() OVER w AS i, sum(length(part) + 2) OVER w AS c FROM parts
  WINDOW w AS (PARTITION BY doc_id ORDER BY block_no, part_start)),
heads AS (SELECT doc_id, source_title || ' > ' || language AS heading_path, length('Section: ' || source_title || ' > ' || language) AS p FROM docs),
next_chunk AS (
  SELECT a.doc_id, a.i, min(b.i) AS n
  FROM candidates a JOIN heads h USING (doc_id) LEFT JOIN candidates b ON a.doc_id = b.doc_id AND b.i > a.i
    AND h.p + b.c - (a.c - length(a.part) - 2) > {N} GROUP BY ALL),
starts AS (
  WITH RECURSIVE walk AS (
    SELECT c.doc_id, c.i, c.n, CASE WHEN h.p + k.c > {N} THEN 1 ELSE 0 END AS chunk_index
    FROM next_chunk c JOIN heads h USING (doc_id) JOIN candidates k ON k.doc_id = c.doc_id AND k.i = 1 WHERE c.i = 1
    UNION ALL SELECT c.doc_id, c.i, c.n, w.chunk_index + 1 FROM walk w JOIN next_chunk c ON c.doc_id = w.doc_id AND c.i = w.n)
  SELECT * FROM walk),
bodies AS (
  SELECT s.doc_id, s.chunk_index, string_agg(c.part, chr(10) || chr(10) ORDER BY c.i) AS body
  FROM starts s JOIN candidates c ON c.doc_id = s.doc_id AND c.i >= s.i AND (s.n IS NULL OR c.i < s.n) GROUP BY ALL
  UNION ALL SELECT doc_id, 0, NULL FROM starts GROUP BY doc_id HAVING min(chunk_index) = 1),
chunks AS (
  SELECT d.*, b.chunk_index, h.heading_path,
    'Section: ' || h.heading_path || coalesce(chr(10) || chr(10) || b.body, '') AS text,
    d.doc_id || '::' || lpad(CAST(b.chunk_index AS VARCHAR), 3, '0') || '::doc_' || d.doc_id || '_' || d.language AS chunk_id
  FROM bodies b JOIN docs d USING (doc_id) JOIN heads h USING (doc_id))"""
ORACLE["chunk_rows"] = f"""WITH {CHUNKS}
SELECT chunk_id, ('0x' || substr(md5(chunk_id), 1, 15))::BIGINT AS point_id, doc_id, chunk_index, heading_path,
  length(text) AS chars, md5(text) AS digest FROM chunks"""
ORACLE["chunk_stats"] = f"""WITH {CHUNKS}
SELECT source_category, count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars
FROM chunks GROUP BY source_category"""

# --- retrieval ----------------------------------------------------------------------------


def embedding_sql(source: str, key: str, column: str, name: str) -> str:
    """CTE ``name`` (key, idx, val): hashed unit vectors of a text column."""
    return f"""{name}_raw AS (SELECT {key}, md5(unnest({TOKENS.format(column)})) AS h FROM {source}),
    {name}_sum AS (SELECT {key}, CAST(('0x' || substr(h, 1, 8))::UBIGINT % {fixed.EMBEDDING_DIM} AS INT) AS idx,
      sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM {name}_raw GROUP BY ALL),
    {name} AS (SELECT {key}, idx, CAST(v AS DOUBLE) / sqrt(CAST(sum(v * v) OVER (PARTITION BY {key}) AS DOUBLE)) AS val
      FROM {name}_sum WHERE v <> 0)"""


ORACLE["hash_embedding"] = f"""WITH {embedding_sql('documents', 'doc_id', 'text', 'vec')}
SELECT doc_id, idx, round(val, 6) AS val FROM vec"""
ORACLE["vector_topk"] = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE label % 5 WHEN 0 THEN 'law' WHEN 1 THEN 'platform' ELSE 'brand' END AS category_group FROM embeddings),
scored AS (SELECT a.vec_id, b.category_group, b.vec_id AS near_id, round(list_dot_product(a.e, b.e), 6) AS cosine FROM v a, v b WHERE a.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id, category_group ORDER BY cosine DESC, CAST(near_id AS VARCHAR)) AS found_rank FROM scored)
SELECT vec_id, category_group, near_id, round(cosine, 3) AS cosine, found_rank FROM ranked WHERE found_rank <= 24"""

TOKEN_SETS = f"""chunk_tokens AS (SELECT *, list_distinct({TOKENS.format('text')}) AS tokens FROM chunks),
request_tokens AS (SELECT *, list_distinct({TOKENS.format('query_text')}) AS tokens FROM requests)"""

EVIDENCE = f"""{CHUNKS}, {REQUESTS}, {TOKEN_SETS},
{embedding_sql('chunks', 'chunk_id', 'text', 'cvec')}, {embedding_sql('requests', 'request_id', 'query_text', 'rvec')},
dots AS (SELECT r.request_id, c.chunk_id, sum(r.val * c.val) AS cosine FROM rvec r JOIN cvec c USING (idx) GROUP BY ALL),
searched AS (
  SELECT r.request_id, d.chunk_id, round(coalesce(t.cosine, 0), 6) AS cosine, {SCOPE['in_scope']} AS in_scope, {SCOPE['bonus']} AS bonus,
    {SCOPE['group']} AS grp FROM chunk_tokens d JOIN request_tokens r ON {SCOPE['searched']}
  LEFT JOIN dots t ON t.request_id = r.request_id AND t.chunk_id = d.chunk_id),
pool AS (SELECT * FROM searched QUALIFY row_number() OVER (PARTITION BY request_id, grp ORDER BY cosine DESC, chunk_id) <= 24),
reranked AS (
  SELECT p.request_id, p.chunk_id, d.source_category,
    p.cosine * 100 + 3 * len(list_intersect(d.tokens, r.tokens)) + p.bonus AS score
  FROM pool p JOIN chunk_tokens d USING (chunk_id) JOIN request_tokens r USING (request_id) WHERE p.in_scope),
lexical AS (
  SELECT r.request_id, d.chunk_id, d.source_category, CAST(6 * len(list_intersect(d.tokens, r.tokens)) + {SCOPE['bonus']} AS DOUBLE) AS score
  FROM chunk_tokens d JOIN request_tokens r ON {SCOPE['in_scope']} WHERE d.source_category IN ('market_law', 'platform_policy')),
lexical_top AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, source_category ORDER BY score DESC, chunk_id) AS rank FROM lexical QUALIFY rank <= 8),
found AS (
  SELECT * FROM reranked
  UNION ALL SELECT request_id, chunk_id, source_category, score FROM lexical_top l
  WHERE NOT EXISTS (SELECT 1 FROM reranked k WHERE k.request_id = l.request_id AND k.source_category = l.source_category)),
placed AS (
  SELECT f.*, round(score, 6) AS s, q.place, q.quota,
    row_number() OVER (PARTITION BY request_id, source_category ORDER BY round(score, 6) DESC, chunk_id) <= q.quota AS first
  FROM found f JOIN {values(fixed.CATEGORY_QUOTAS, 'source_category, place, quota')} q USING (source_category)),
picked AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY request_id
    ORDER BY CASE WHEN first THEN 0 ELSE 1 END, CASE WHEN first THEN place ELSE 0 END, s DESC, chunk_id) <= 8),
evidence AS (
  SELECT p.request_id, row_number() OVER (PARTITION BY p.request_id ORDER BY s DESC, p.chunk_id) AS evidence_rank, c.* EXCLUDE (chunk_id),
    p.chunk_id AS block_id, round(p.score, 3) AS score, CAST(round(p.score * 10000) AS BIGINT) AS score_e4, left(c.text, 1400) AS excerpt
  FROM picked p JOIN chunks c USING (chunk_id))"""

ORACLE["hybrid_evidence"] = f"""WITH {EVIDENCE}
SELECT request_id, evidence_rank, doc_id, source_category, block_id, country_code, score_e4, md5(excerpt) AS digest FROM evidence"""
ORACLE["fallback_ranking"] = f"""WITH {EVIDENCE}
SELECT request_id, source_category, rank, chunk_id, CAST(score AS INT) AS score FROM lexical_top"""
ORACLE["lexical_search"] = f"""WITH {KNOWLEDGE}, {REQUESTS},
dt AS (SELECT *, list_distinct({TOKENS.format('body')}) AS tokens FROM docs),
rt AS (SELECT *, list_distinct({TOKENS.format('query_text')}) AS tokens FROM requests),
scored AS (
  SELECT r.request_id, d.doc_id, 4 * len(list_intersect(d.tokens, r.tokens))
    + CASE WHEN d.country_code = r.target_country THEN 12 WHEN d.region_pack = r.target_region_pack THEN 6 ELSE 0 END
    + CASE WHEN d.platform = r.target_platform THEN 8 ELSE 0 END + CASE WHEN d.distribution_mode = r.distribution_mode THEN 5 ELSE 0 END
    + CASE WHEN d.source_type = 'law' THEN 4 ELSE 0 END - CASE WHEN d.is_global_fallback THEN 2 ELSE 0 END AS score
  FROM dt d JOIN rt r ON d.platform IN ('', r.target_platform, 'all', 'global') AND d.distribution_mode IN ('', r.distribution_mode, 'all', 'global')
    AND d.brand_id IN ('', r.brand_id, 'all', 'global')
    AND CASE WHEN d.source_type = 'law' THEN CASE WHEN d.country_code <> '' THEN d.country_code = r.target_country
        ELSE d.region_pack <> '' AND d.region_pack = r.target_region_pack END
      WHEN d.country_code <> '' THEN d.country_code IN (r.target_country, 'GLOBAL', 'ALL')
      ELSE d.region_pack IN ('', r.target_region_pack, 'GLOBAL', 'ALL') END)
SELECT request_id, doc_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) AS found_rank
FROM scored QUALIFY found_rank <= 6"""

CITED_ISSUES = issues_sql().replace("doc_id", "request_id")


def citations_sql() -> str:
    points = []
    for family, (categories, terms) in fixed.CITATION_PREFERENCES.items():
        cats = ", ".join(text(c) for c in categories)
        plus = " + ".join(
            f"CASE WHEN contains(lower(e.excerpt), {text(t)}) OR contains(lower(e.source_title), {text(t)}) THEN 8 ELSE 0 END"
            for t in terms
        )
        points.append(
            f"SELECT e.*, {text(family)} AS family, CAST(trunc(e.score) AS INT) + CASE WHEN e.source_category IN ({cats}) THEN 15 ELSE 0 END + {plus} AS points FROM evidence e"
        )
    n = len(fixed.ABSOLUTE_PATTERNS)
    return f"""WITH {EVIDENCE},
    scripts AS (SELECT request_id, target_platform, distribution_mode, product_category,
      query_text || chr(10) || {I.pick('CAST(request_id AS BIGINT)', I.PHRASES)} AS final_script FROM requests),
    {CITED_ISSUES},
    rated AS ({' UNION ALL '.join(points)}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, family ORDER BY points DESC, evidence_rank) - 1 AS citation_no FROM rated)
    SELECT i.request_id, i.rule_no, r.citation_no, r.source_title, r.block_id, r.country_code
    FROM issues i JOIN ranked r ON r.request_id = i.request_id AND r.citation_no < 2
      AND r.family = CASE WHEN i.rule_no = 0 THEN 'disclosure' WHEN i.rule_no <= {n} THEN 'absolute' ELSE 'sensitive' END"""


ORACLE["citations"] = citations_sql()
ORACLE["evidence_digest"] = f"""WITH {EVIDENCE},
texts AS (SELECT request_id, count(*) AS evidence_count, string_agg('[' || evidence_rank || '] ' || source_title || ' | category=' || source_category
    || ' | type=' || source_type || ' | country=' || country_code || ' | platform=' || platform || ' | mode=' || distribution_mode
    || ' | heading=' || heading_path || ' | block=' || block_id || ' | url=' || CASE source_url WHEN '' THEN 'local-file' ELSE source_url END
    || chr(10) || 'Excerpt: ' || excerpt, chr(10) || chr(10) ORDER BY evidence_rank) AS t FROM evidence GROUP BY request_id)
SELECT request_id, evidence_count, length(t) AS chars, md5(t) AS digest FROM texts"""

# --- pages --------------------------------------------------------------------------------


def host(x: str) -> str:
    return rf"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"


def unescape(x: str) -> str:
    for name, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{char}')"
    return x


def platform_of(h: str, strict: bool) -> str:
    cases = []
    for name, parts in fixed.PLATFORM_HOSTS:
        tests = [f"({h} = '{p}' OR ends_with({h}, '.{p}'))" if strict else f"contains({h}, '{p}')" for p in parts]
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '' END"


SIGNALS = " ".join(f"WHEN contains(lower(html), {text(s)}) THEN {text(s)}" for s in fixed.BLOCK_SIGNALS)
TITLE = unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")
ORACLE["page_heads"] = rf"""SELECT page_id, {squeeze(TITLE)} AS html_title,
  regexp_extract(html, '(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1) AS meta_description,
  regexp_extract(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS canonical_url,
  sha256(html) AS sha256, strlen(html) AS file_size, {host('url')} AS domain, CASE {SIGNALS} ELSE '' END AS blocked FROM pages"""

HITS = f"hits AS ({I.sql(I.HITS, 'events')})"
ORACLE["url_platforms"] = f"""WITH {HITS}, urls AS (SELECT url FROM pages UNION ALL SELECT url FROM hits),
hosts AS (SELECT {host('url')} AS h FROM urls)
SELECT {platform_of('lower(h)', False)} AS platform, {platform_of('lower(h)', True)} AS strict_platform,
  CASE replace(h, 'www.', '') WHEN '' THEN 'unknown' ELSE replace(h, 'www.', '') END AS domain, count(*) AS urls FROM hosts GROUP BY ALL"""

# --- trends -------------------------------------------------------------------------------


def group(x: str, pattern: str, n: int) -> str:
    return f"nullif(regexp_extract({x}, {text(pattern)}, {n}), '')"


READ = rf"""blobs AS (SELECT *, concat_ws(' ', nullif(title, ''), nullif(content, ''), nullif(raw_content, '')) AS b FROM hits),
read AS (SELECT *,
  CASE lower({group('b', fixed.RELATIVE_AGE_PATTERN, 2)}) WHEN 'h' THEN 0 WHEN 'd' THEN CAST({group('b', fixed.RELATIVE_AGE_PATTERN, 1)} AS INT)
    WHEN 'w' THEN 7 * CAST({group('b', fixed.RELATIVE_AGE_PATTERN, 1)} AS INT) END AS rel,
  try_strptime({group('b', fixed.ISO_DATE_PATTERN, 0)}, '%Y-%m-%d') AS iso,
  try_strptime({group('b', fixed.LONG_DATE_PATTERNS[0], 1)}, '%B %d, %Y') AS long,
  try_strptime('2024-' || {group('b', fixed.SHORT_DATE_PATTERN, 1)} || '-' || {group('b', fixed.SHORT_DATE_PATTERN, 2)}, '%Y-%m-%d') AS short,
  CAST(trunc(CAST({group('b', fixed.UNIT_VIEWS_PATTERN, 1)} AS DOUBLE) * CASE lower({group('b', fixed.UNIT_VIEWS_PATTERN, 2)}) WHEN 'm' THEN 1000000 ELSE 1000 END) AS BIGINT) AS unit_views,
  CAST(trunc(CAST({group('b', fixed.MILLION_VIEWS_PATTERN, 1)} AS DOUBLE) * 1000000) AS BIGINT) AS million_views,
  CAST(replace({group('b', fixed.COMMA_VIEWS_PATTERN, 1)}, ',', '') AS BIGINT) AS comma_views,
  CASE WHEN contains(lower(b), 'million views') OR contains(lower(b), 'million plays') THEN 1000000 END AS bare_views,
  {platform_of(f"lower({host('url')})", False)} AS url_platform FROM blobs),
signals AS (SELECT *, coalesce(rel, abs(date_diff('day', CAST(iso AS DATE), DATE '{I.AS_OF}')), abs(date_diff('day', CAST(long AS DATE), DATE '{I.AS_OF}')),
    abs(date_diff('day', CAST(short AS DATE), DATE '{I.AS_OF}'))) AS age_days,
  coalesce(unit_views, million_views, comma_views, bare_views) AS view_count,
  CASE url_platform WHEN '' THEN platform ELSE url_platform END AS platform_key FROM read)"""


def view_label(n: str) -> str:
    return f"""CASE WHEN {n} >= 1000000 THEN printf('%.1fM', CAST({n} AS DOUBLE) / 1000000) WHEN {n} >= 1000 THEN printf('%.1fK', CAST({n} AS DOUBLE) / 1000)
      ELSE CAST({n} AS VARCHAR) END"""


ORACLE["hit_signals"] = f"""WITH {HITS}, {READ}
SELECT event_id, age_days, view_count, platform_key, {view_label('view_count')} AS view_label FROM signals"""
TURN = "CASE platform WHEN 'tiktok' THEN 0 WHEN 'instagram' THEN 1 ELSE 2 END"


def compact(x: str, n: int) -> str:
    return f"CASE WHEN length({squeeze(x)}) <= {n} THEN {squeeze(x)} ELSE rtrim(left({squeeze(x)}, {n - 3})) || '...' END"


ORACLE["viral_benchmarks"] = f"""WITH {HITS}, {READ},
good AS (SELECT *, wanted NOT IN ('tiktok', 'instagram', 'x') OR platform = wanted AS own FROM signals
  WHERE url <> '' AND (age_days IS NULL OR age_days <= 3) AND CASE WHEN view_count IS NULL THEN score >= 0.85 ELSE view_count >= 100000 END),
kept AS (SELECT * FROM (SELECT *, bool_or(own) OVER (PARTITION BY request_id) AS served FROM good) WHERE own OR NOT served),
firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY request_id, url ORDER BY {TURN}, query_no, hit_no) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(view_count, 0) DESC, score DESC, {TURN}, query_no, hit_no, url) AS rank FROM firsts QUALIFY rank <= 4)
SELECT request_id, rank, {compact("CASE title WHEN '' THEN CASE platform_key WHEN 'tiktok' THEN 'TikTok' WHEN 'instagram' THEN 'Instagram Reels' WHEN 'x' THEN 'X' ELSE 'Viral video' END ELSE title END", 88)} AS title,
  url, platform_key, coalesce(view_count, 0) AS view_count,
  CASE WHEN view_count > 0 THEN {view_label('view_count')} ELSE {text(fixed.VIEW_LABEL_LIVE)} END AS view_count_label, score,
  CASE WHEN event_id % 29 <> 0 AND hit_no <= event_id % 400 THEN 'https://img.example.com/' || hit_no ELSE '' END AS image_url FROM ranked"""

TREND_REQUESTS = f"asked AS (SELECT DISTINCT * FROM ({I.sql(I.TREND_REQUESTS, 'events')}))"


def fill(template: str, **parts: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    return " || ".join(parts[p] if i % 2 else text(p) for i, p in enumerate(pieces) if p)


MARKET = lookup("target_country", MARKET_LABEL, "target_country")
PRODUCT = lookup("product_category", fixed.PRODUCT_HINTS, "replace(product_category, '_', ' ')")
MODE_HINT = lookup("distribution_mode", fixed.DISTRIBUTION_HINTS, "''")
NAMED = f"""named AS (SELECT *, {platform_sql('target_platform')} AS plat, {MARKET} AS label, {language_sql('language_name')} AS lang,
  concat_ws(' ', nullif({squeeze('topic')}, ''), nullif({PRODUCT}, ''), nullif({MODE_HINT}, '')) AS focus,
  CASE WHEN trim(topic) = '' THEN 'creator economy' ELSE {squeeze('topic')} END AS hint FROM asked),
queried AS (SELECT *, {fill(fixed.TREND_QUERY_TEMPLATE, topic='trim(topic)', country='label', platform='plat', product="replace(product_category, '_', ' ')",
    platform_hint=lookup('plat', fixed.TREND_PLATFORM_HINTS, text(fixed.TREND_PLATFORM_HINT_DEFAULT)),
    mode_hint=lookup('distribution_mode', fixed.TREND_MODE_HINTS, text(fixed.TREND_MODE_HINT_DEFAULT)), language='lang')} AS trend_query FROM named)"""


def viral_sql() -> str:
    def joined(templates):
        return " || chr(10) || ".join("(" + fill(t, country="label", focus="focus", days="'3'") + ")" for t in templates)

    cases = " ".join(f"WHEN {text(k)} THEN {joined(v)}" for k, v in fixed.VIRAL_QUERY_HINTS.items())
    return f"CASE plat {cases} ELSE {joined(fixed.VIRAL_QUERY_DEFAULT)} END"


INDUSTRY = " || chr(10) || ".join(
    "(" + fill(t, country="label", platform="target_platform", topic="hint") + ")" for _, _, t in fixed.INDUSTRY_CATEGORIES
)
ORACLE["trend_queries"] = f"""WITH {TREND_REQUESTS}, {NAMED}
SELECT request_id, trend_query, {viral_sql()} AS viral_queries, {INDUSTRY} AS industry_queries,
  '{{"distribution_mode": "' || distribution_mode || '", "module": "videos", "product_category": "' || product_category || '", "target_country": "' || target_country
    || '", "target_languages": ["' || language_name || '"], "target_platform": "' || target_platform || '", "topic": "' || topic || '"}}' AS scope_key FROM queried"""

MODULE_KEY = """{"distribution_mode": "' || distribution_mode || '", 'MODULE'"product_category": "' || product_category || '", "target_country": "' || target_country
    || '", "target_languages": ["' || language_name || '"], "target_platform": "' || target_platform || '", "topic": "' || topic || '"}"""
ORACLE["module_requests"] = f"""WITH {TREND_REQUESTS}, {NAMED}
SELECT request_id, '{MODULE_KEY.replace("'MODULE'", '')}' AS filters, module_name,
  '{MODULE_KEY.replace("'MODULE'", '"module": "' + "' || module_name || '" + '", ')}' AS scope_key, CASE module_name WHEN 'videos' THEN reason IS NULL ELSE topic = '' END AS refresh
FROM queried CROSS JOIN (SELECT unnest([{', '.join(text(m) for m in I.MODULES)}]) AS module_name)"""

ORACLE["trend_briefs"] = f"""WITH {HITS}, {TREND_REQUESTS}, {NAMED},
firsts AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY event_id) AS n FROM hits QUALIFY n <= 5),
lines AS (SELECT request_id, count(*) AS sources, string_agg('  ' || n || '. ' || CASE title WHEN '' THEN 'Signal ' || n ELSE title END
  || ' (score: ' || printf('%.2f', score) || ') — ' || content || CASE url WHEN '' THEN '' ELSE ' [' || url || ']' END, chr(10) ORDER BY n) FILTER (WHERE n <= 4) AS signals
  FROM firsts GROUP BY request_id),
joined AS (SELECT q.*, coalesce(l.sources, 0) AS sources, l.signals, {squeeze('answer')} AS short, trim(topic) = '' AS blank FROM queried q LEFT JOIN lines l USING (request_id)),
texts AS (SELECT *, CASE WHEN blank THEN {text(fixed.EMPTY_TOPIC_BRIEF)}
  WHEN reason IS NOT NULL THEN {text(fixed.FALLBACK_TREND_MARK)} || chr(10) || '- Topic: ' || trim(topic) || chr(10) || '- Platform: ' || plat || chr(10) || '- Distribution Mode: ' || distribution_mode
    || chr(10) || '- Search Query Attempted: ' || trend_query || chr(10) || '- Live Search Status: ' || reason || chr(10) || {text(fixed.FALLBACK_ASSUMPTION)}
  ELSE {text(fixed.LIVE_TREND_MARK)} || chr(10) || '- Market: ' || target_country || chr(10) || '- Platform: ' || plat || chr(10) || '- Search Query: ' || trend_query || chr(10)
    || CASE short WHEN '' THEN '' ELSE '- Summary: ' || short || chr(10) END || CASE WHEN signals IS NULL THEN {text(fixed.NO_SIGNALS_LINE)} ELSE '- Recent Signals:' || chr(10) || signals END
  END AS t FROM joined)
SELECT request_id, md5(t) AS digest,
  CASE WHEN blank THEN t WHEN reason IS NOT NULL THEN '[' WHEN short <> '' THEN short
    ELSE 'Recent Signals: ' || trim(split_part(t, chr(10), 6)) END AS summary,
  CASE WHEN blank OR reason IS NOT NULL THEN 0 ELSE sources END AS sources, NOT blank AND reason IS NULL AS live FROM texts"""
ORACLE["trend_briefs"] = ORACLE["trend_briefs"].replace(
    "WHEN reason IS NOT NULL THEN '[' WHEN",
    "WHEN reason IS NOT NULL THEN 'Topic: ' || trim(topic) || ' Distribution Mode: ' || distribution_mode WHEN",
)

LABELS = {k: v for k, v, _ in fixed.INDUSTRY_CATEGORIES}
ORACLE["industry_digest"] = f"""WITH {HITS},
keyed AS (SELECT *, {I.pick('event_id', [k for k, _, _ in fixed.INDUSTRY_CATEGORIES])} AS category_key FROM hits),
firsts AS (SELECT *, row_number() OVER (PARTITION BY request_id, category_key ORDER BY event_id) AS n FROM keyed QUALIFY n <= 4)
SELECT request_id, category_key, count(*) AS articles, string_agg(content, ' ' ORDER BY n) FILTER (WHERE n <= 2) AS summary,
  string_agg(CASE title WHEN '' THEN {lookup('category_key', LABELS, 'category_key')} ELSE title END || '~'
    || CASE {host('url')} WHEN '' THEN 'web' ELSE {host('url')} END || '~' || url, chr(10) ORDER BY n) AS listing
FROM firsts GROUP BY ALL"""

SNAPSHOTS = f"""snaps AS (SELECT * FROM ({I.sql(I.SNAPSHOTS, 'events')}) QUALIFY row_number() OVER (PARTITION BY module_name, scope_key ORDER BY updated_at DESC, event_id DESC) = 1)"""


def member(json: str, key: str) -> str:
    return f"""CAST(json_extract({json}, '$."' || {key} || '"') AS VARCHAR)"""


SERVED = f"""{SNAPSHOTS},
loads AS (SELECT * FROM ({I.sql(I.LOADS, 'events')}) QUALIFY row_number() OVER (PARTITION BY module_name, scope_key ORDER BY event_id DESC) = 1),
joined AS (SELECT r.*, s.payload AS old, s.updated_at AS old_at, l.payload AS new, l.loaded_at AS new_at, l.error AS load_error, l.event_id IS NOT NULL AS loaded
  FROM ({I.sql(I.SERVED, 'events')}) r LEFT JOIN snaps s USING (module_name, scope_key) LEFT JOIN loads l USING (module_name, scope_key)),
judged AS (SELECT *, old_at IS NOT NULL AND NOT refresh AS hit FROM joined),
fresh AS (SELECT *, NOT hit AND loaded AND load_error IS NULL AS store FROM judged),
facts AS (SELECT * EXCLUDE (hit, store, old, new), hit OR (NOT store AND old_at IS NOT NULL) AS from_cache, NOT hit AND NOT store AND old_at IS NOT NULL AS stale, store,
  {lookup('module_name', fixed.EMPTY_PAYLOADS, 'NULL')} AS low, CASE WHEN store THEN new ELSE old END AS found, CASE WHEN store THEN new END AS load_payload,
  CASE WHEN NOT hit AND NOT store THEN CAST(to_json({{'error': coalesce(load_error, 'load failed')}}) AS VARCHAR) ELSE '{{}}' END AS top,
  epoch_us(CASE WHEN store THEN new_at ELSE old_at END) AS at_us FROM fresh),
layers AS (SELECT * REPLACE (CASE WHEN json_valid(found) AND json_type(CASE WHEN json_valid(found) THEN found END) = 'OBJECT' THEN found ELSE '{{}}' END AS found) FROM facts),
served AS (SELECT *, '{{' || array_to_string(list_transform(list_sort(list_distinct(json_keys(low) || json_keys(found) || json_keys(top))),
    lambda k: '"' || k || '":' || coalesce({member('top', "k")}, {member('found', "k")}, {member('low', "k")})), ',') || '}}' AS payload,
  coalesce(CASE WHEN list_contains(json_keys(top), 'error') THEN top ->> '$.error' WHEN list_contains(json_keys(found), 'error') THEN found ->> '$.error' END, '') AS error
  FROM layers)"""
ORACLE["snapshot_latest"] = f"WITH {SNAPSHOTS} SELECT module_name, scope_key, payload, epoch_us(updated_at) AS at_us FROM snaps"
ORACLE["snapshot_serve"] = f"WITH {SERVED} SELECT request_id, module_name, payload, error, from_cache, stale, store, load_payload, at_us FROM served"
ORACLE["module_meta"] = f"""WITH {SERVED}
SELECT scope_key, coalesce(min_by(error, CAST(request_id AS BIGINT)) FILTER (WHERE error <> ''), '') AS error, bool_and(from_cache) AS from_cache,
  bool_or(stale) AS stale, max(at_us) AS cached_at FROM served GROUP BY scope_key"""

VISITS = SERVED.replace(I.sql(I.SERVED, "events"), I.sql(I.TREND_VISITS, "events"))
ORACLE["trend_results"] = f"""WITH {VISITS},
newest AS (SELECT *, row_number() OVER (PARTITION BY request_id, module_name ORDER BY at_us DESC NULLS LAST, payload DESC) AS n FROM served),
parts AS (SELECT request_id, max(filters) AS filters, max(payload) FILTER (WHERE module_name = 'videos' AND n = 1) AS videos, max(error) FILTER (WHERE module_name = 'videos' AND n = 1) AS videos_error,
  max(payload) FILTER (WHERE module_name = 'industry_categories' AND n = 1) AS industry, max(payload) FILTER (WHERE module_name = 'topic_brief' AND n = 1) AS brief,
  CASE WHEN bool_or(module_name <> 'videos') THEN coalesce(min_by(error, module_name) FILTER (WHERE module_name <> 'videos' AND error <> ''), '') END AS industry_error,
  bool_and(from_cache) FILTER (WHERE module_name <> 'videos') AS industry_cached, bool_or(stale) FILTER (WHERE module_name <> 'videos') AS industry_stale
  FROM newest GROUP BY request_id)
SELECT request_id, filters, coalesce({member('brief', "'topic_brief'")}, {text(fixed.EMPTY_BRIEF)}) AS trend_hunter, coalesce({member('videos', "'items'")}, '[]') AS benchmarks,
  coalesce(videos_error, '') AS benchmarks_error, videos, industry_error, industry_cached, industry_stale,
  coalesce({member('industry', "'categories'")}, '[]') AS categories, coalesce({member('brief', "'topic_brief'")}, {text(fixed.EMPTY_BRIEF)}) AS topic_brief
FROM parts"""

# --- scripts as markdown ------------------------------------------------------------------

SCRIPT_TEXTS = f"raw AS ({I.sql(I.SCRIPT_TEXTS, 'conversations')})"
ORACLE["script_cleanup"] = f"""WITH {SCRIPT_TEXTS}, texts AS (SELECT conv_id, turn, role, text, script FROM raw JOIN conversations USING (conv_id, turn))
SELECT conv_id, turn, CASE turn % 6
  WHEN 0 THEN {strip("'### Scene' || chr(10) || text")}
  WHEN 1 THEN '### S' || chr(10) || '| Time | Visual | Audio | Notes |' || chr(10) || '|---|---|---|---|' || chr(10)
    || '| [00:00-00:03] | Scene ' || turn || ' / INT. room / wide | hello | more | end |' || chr(10)
    || {strip("'| [00:03-00:05] | a / b | c | ' || role || ' |' || chr(10) || '|  |' || chr(10) || '| x | y |' || chr(10) || text")}
  WHEN 2 THEN {strip("'**Title** ' || role || chr(10) || '| [00:01-00:02] | v | a | b | n |' || chr(10) || text")}
  WHEN 3 THEN {strip('text')}
  ELSE {strip('script')} END AS script FROM texts"""
ORACLE["response_checks"] = f"""WITH {SCRIPT_TEXTS},
found AS (SELECT *, CASE WHEN regexp_matches(script, '(?s)```json\\s*(\\{{.*\\}})\\s*```') THEN regexp_extract(script, '(?s)```json\\s*(\\{{.*\\}})\\s*```', 1)
  ELSE nullif(regexp_extract(script, '(?s)(\\{{.*\\}})', 1), '') END AS body FROM raw)
SELECT turn % 6 AS kind, count(*) FILTER (WHERE trim(script) <> '') AS filled,
  count(*) FILTER (WHERE regexp_matches(script, {text(fixed.TIMECODE_PATTERN)}) AND length(script) - length(replace(script, '|', '')) >= 8 AND contains(script, '|---')) AS tables,
  count(*) FILTER (WHERE body IS NOT NULL AND json_valid(body)) AS json FROM found GROUP BY ALL"""

ORACLE["report_reconcile"] = f"""WITH scripts AS ({I.sql(I.REVIEWED, 'documents')}), {issues_sql()},
outside AS (SELECT doc_id, -2 AS pos, 'local_law' AS issue_type, 'medium' AS risk_level, 'Perfect' AS excerpt FROM scripts WHERE doc_id % 6 = 4
  UNION ALL SELECT doc_id, -1, 'local_law', 'high', 'No excerpt available' FROM scripts WHERE doc_id % 6 = 4),
judged AS (SELECT *, trim(final_script) = '' AS no_script, CASE WHEN trim(final_script) = '' OR NOT has_evidence OR doc_id % 6 IN (1, 5) THEN true ELSE false END AS fallback FROM scripts),
united AS (SELECT o.* FROM outside o JOIN judged j USING (doc_id) WHERE NOT j.fallback
  UNION ALL SELECT doc_id, rule_no, issue_type, risk_level, excerpt FROM issues),
uniq AS (SELECT * FROM united QUALIFY row_number() OVER (PARTITION BY doc_id, issue_type, excerpt ORDER BY pos) = 1),
gaps AS (SELECT j.doc_id, 99 AS pos, 'missing_local_evidence' AS issue_type, 'medium' AS risk_level, CASE j.topic WHEN '' THEN 'No excerpt available' ELSE j.topic END AS excerpt
  FROM judged j WHERE j.fallback AND NOT EXISTS (SELECT 1 FROM issues i WHERE i.doc_id = j.doc_id)),
every AS (SELECT * FROM uniq UNION ALL SELECT * FROM gaps),
rolled AS (SELECT doc_id, count(*) AS n, CASE WHEN bool_or(risk_level = 'high') THEN 'high' WHEN bool_or(risk_level = 'medium') THEN 'medium' ELSE 'low' END AS worst,
  string_agg(issue_type || '~' || risk_level || '~' || excerpt, chr(10) ORDER BY pos) AS listed FROM every GROUP BY doc_id),
reports AS (SELECT j.*, coalesce(r.n, 0) AS n, coalesce(r.worst, 'low') AS worst, coalesce(r.listed, '') AS listed,
  CASE WHEN j.fallback THEN 'insufficient_evidence' WHEN j.doc_id % 6 = 4 THEN 'insufficient_evidence' WHEN coalesce(r.n, 0) > 0 THEN 'needs_revision' ELSE 'approved' END AS overall_status
  FROM judged j LEFT JOIN rolled r USING (doc_id))
SELECT doc_id, overall_status, CASE WHEN NOT fallback AND doc_id % 6 = 3 THEN 'low' ELSE worst END AS overall_risk,
  CASE WHEN fallback THEN {text(fixed.FALLBACK_HEADLINE)} WHEN doc_id % 6 = 3 THEN 'H' ELSE {text(fixed.REPORT_DEFAULTS['headline'])} END AS headline,
  CASE WHEN no_script THEN 'empty' WHEN overall_status IN ('approved', 'insufficient_evidence') OR n = 0 THEN 'pass_through' ELSE 'rewrite' END AS route,
  md5(listed) AS issues FROM reports"""

# --- creators -----------------------------------------------------------------------------

TALENTS = f"talents AS ({I.sql(I.TALENTS, 'customer')})"
USERS = f"users AS ({I.sql(I.USERS, 'customer')})"


def stage_sql(x: str) -> str:
    cases = " ".join(f"WHEN {contains_any(x, words)} THEN {text(key)}" for key, _, words in fixed.TALENT_STAGES)
    return f"CASE {cases} ELSE 'pending' END"


STAGED = f"{TALENTS}, staged AS (SELECT *, {stage_sql('collaboration_progress')} AS stage FROM talents)"
STAGE_ROWS = values([(i, k, t) for i, (k, t, _) in enumerate(fixed.TALENT_STAGES, 1)], "stage_order, stage, title")
ORACLE["talent_board"] = f"""WITH {STAGED}
SELECT s.stage_order, s.stage, s.title, count(t.id) AS talents FROM {STAGE_ROWS} s LEFT JOIN staged t USING (stage) GROUP BY ALL"""
ORACLE["talent_totals"] = f"""WITH {STAGED}
SELECT count(*) AS talents, count(*) FILTER (WHERE stage NOT IN ('pending', 'done')) AS active, count(DISTINCT nullif(platform, '')) AS platforms FROM staged"""
ORACLE["talent_tones"] = f"""WITH {TALENTS}
SELECT collaboration_progress, CASE WHEN {contains_any('collaboration_progress', fixed.TONE_LOW_WORDS)} THEN '{fixed.TONE_LOW}'
  WHEN {contains_any('collaboration_progress', fixed.TONE_MEDIUM_WORDS)} THEN '{fixed.TONE_MEDIUM}' ELSE '{fixed.TONE_MUTED}' END AS tone, count(*) AS talents
FROM talents GROUP BY ALL"""


def todo_sql(part: int) -> str:
    cases = []
    for key, field, p1, t1, p2, t2 in fixed.TALENT_TODOS:
        blank, full = ((text(p1), text(p2)), (fill(t1, name="name"), fill(t2, name="name")))[part]
        value = full if field is None else f"CASE WHEN trim({field}) = '' THEN {blank} ELSE {full} END"
        cases.append(f"WHEN {text(key)} THEN {value}")
    return f"CASE stage {' '.join(cases)} END"


TODOS = f"""{STAGED}, todos AS (SELECT id AS talent_id, name AS talent_name, {todo_sql(0)} AS priority, {todo_sql(1)} AS text, nation FROM staged),
ordered AS (SELECT *, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS priority_order FROM todos)"""
ORACLE["talent_todos"] = f"WITH {TODOS} SELECT talent_id, talent_name, priority, text, priority_order FROM ordered"
ORACLE["talent_top_todos"] = f"""WITH {TODOS}
SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY priority_order, talent_name, talent_id) AS rank, talent_id, priority, text FROM ordered QUALIFY rank <= 10"""

STYLE = fill(fixed.STYLE_PROMPT_TEMPLATE, name="name")
LINKED = f"""{TALENTS}, {USERS},
linked AS (SELECT * EXCLUDE (user_id), coalesce(user_id, (SELECT max(id) FROM users) + row_number() OVER (PARTITION BY user_id IS NULL ORDER BY id)) AS user_id, user_id IS NULL AS made FROM talents)"""
ORACLE["talent_links"] = f"WITH {LINKED} SELECT id, user_id FROM linked"
ORACLE["linked_users"] = f"""WITH {LINKED} SELECT id, name, style_prompt, few_shot FROM users
UNION ALL SELECT user_id, name, CASE trim(notes) WHEN '' THEN {STYLE} ELSE trim(notes) END, '' FROM linked WHERE made"""
ORACLE["talent_updates"] = f"""WITH {TALENTS}, {USERS},
changes AS (SELECT id * 2 AS id, 'New ' || name AS name, CASE WHEN id % 3 = 0 THEN '' ELSE notes END AS notes FROM talents),
hit AS (SELECT t.id, t.user_id, c.name, c.notes, u.id AS known, u.few_shot FROM talents t JOIN changes c USING (id) LEFT JOIN users u ON u.id = t.user_id),
placed AS (SELECT *, CASE WHEN known IS NOT NULL THEN user_id ELSE (SELECT max(id) FROM users) + row_number() OVER (PARTITION BY known IS NULL ORDER BY id) END AS uid FROM hit),
touched AS (SELECT uid AS id, name, CASE trim(notes) WHEN '' THEN {STYLE} ELSE trim(notes) END AS style_prompt, coalesce(few_shot, '') AS few_shot FROM placed)
SELECT * FROM touched UNION ALL SELECT id, name, style_prompt, few_shot FROM users WHERE id NOT IN (SELECT id FROM touched)"""
ORACLE["talent_deletes"] = f"""WITH {TALENTS}, scripts AS ({I.sql(I.SCRIPT_ROWS, 'orders')}),
gone AS (SELECT DISTINCT user_id FROM talents WHERE platform = 'TikTok' AND user_id IS NOT NULL)
SELECT id, CASE WHEN user_id IN (SELECT user_id FROM gone) THEN NULL ELSE user_id END AS user_id, topic FROM scripts"""
ORACLE["talent_creates"] = f"""WITH {TALENTS}, {USERS},
made AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier)
SELECT id, user_id, name, platform, collaboration_progress FROM talents
UNION ALL SELECT n + (SELECT max(id) FROM talents), n + (SELECT max(id) FROM users), s_name, {text(fixed.PLATFORM_UNSET)}, {text(fixed.PROGRESS_UNSET)} FROM made"""
ORACLE["profile_backfill"] = f"""WITH {USERS}
SELECT id, id AS user_id, name, {text(fixed.PLATFORM_UNSET)} AS platform, '' AS email, '' AS recent_video_link,
  CASE trim(style_prompt) WHEN '' THEN {text(fixed.BACKFILL_NOTES)} ELSE trim(style_prompt) END AS notes, {text(fixed.PROGRESS_UNSET)} AS collaboration_progress FROM users"""
ORACLE["style_profiles"] = f"""WITH {USERS}
SELECT o.o_orderkey AS request_id, o.o_custkey * 2 + 100000 AS user_id, coalesce(u.style_prompt, CASE WHEN u.id IS NULL THEN {text(fixed.DEFAULT_STYLE)} ELSE '' END) AS style_prompt,
  coalesce(u.few_shot, '') AS few_shot FROM orders o LEFT JOIN users u ON u.id = o.o_custkey * 2 + 100000"""
ORACLE["script_history"] = """SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY conv_id * 1000 + turn) AS id, CAST(NULL AS BIGINT) AS user_id,
  role AS topic, 'x' AS platform, CAST(0.8 AS DOUBLE) AS creativity FROM conversations"""
ORACLE["table_import"] = f"""SELECT s_suppkey AS id, s_name AS name, {text(fixed.PLATFORM_UNSET)} AS platform FROM supplier
UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"""

# --- library ------------------------------------------------------------------------------

CATALOG = f"catalog AS ({I.sql(I.CATALOG, 'documents')})"
DOC_TYPE = lookup("category", fixed.DOCUMENT_TYPES, "category")
PLACE = "CASE WHEN market IN ('GLOBAL', 'EU', 'INTERNAL') THEN '' WHEN market = 'UK' THEN 'GB' ELSE market END"
ORACLE["catalog_metadata"] = f"""WITH {CATALOG}
SELECT id AS source_id, lower(platform) AS platform, {lookup('lower(platform)', fixed.PLATFORM_DISPLAY, "'Kwai'")} AS platform_display, {DOC_TYPE} AS document_type,
  CASE WHEN {DOC_TYPE} = 'market_law' THEN 'law' ELSE 'policy' END AS source_type, {PLACE} AS country_code, market IN ('GLOBAL', 'EU') AS is_global_fallback,
  'raw/' || id || '.html' AS raw_file FROM catalog"""
ORACLE["library_listing"] = f"""WITH {CATALOG}, stored AS (SELECT *, CASE processed_at WHEN 'bad' THEN NULL WHEN '2024-01-10T00:00:00Z' THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-03-10 08:00:00' END AS at_time
  FROM ({I.sql(I.STORED, 'documents')})),
raw AS (SELECT 'doc_' || (doc_id * 2) AS source_id, 'raw/doc_' || (doc_id * 2) || '.pdf' AS raw_path FROM labels),
manifest AS (SELECT 'doc_' || doc_id AS source_id FROM labels),
joined AS (SELECT coalesce(s.source_id, r.source_id) AS sid, s.source_id IS NOT NULL AS p, s.*, r.raw_path AS rp FROM stored s FULL OUTER JOIN raw r USING (source_id))
SELECT j.sid AS source_id, CASE WHEN p THEN coalesce(j.title, j.sid) ELSE coalesce(c.title, j.sid) END AS title,
  CASE WHEN p THEN coalesce(nullif(j.source_category, ''), nullif(j.document_type, ''), 'platform_policy') ELSE coalesce(c.category, 'platform_policy') END AS category,
  CASE WHEN p THEN j.platform ELSE coalesce(c.platform, 'all') END AS platform, CASE WHEN p THEN j.region ELSE coalesce(c.market, 'GLOBAL') END AS market,
  CASE WHEN p THEN j.region_pack ELSE coalesce(c.region, 'GLOBAL') END AS region, CASE WHEN p THEN j.language ELSE coalesce(c.language, 'en') END AS language,
  CASE WHEN p THEN j.source_url ELSE coalesce(c.url, '') END AS source_url, CASE WHEN p THEN j.notes ELSE coalesce(c.notes, '') END AS notes,
  CASE WHEN p THEN j.priority ELSE coalesce(c.priority, 'P2') END AS priority,
  CASE WHEN p AND (at_time IS NULL OR at_time <= TIMESTAMP '2024-02-15') THEN 'indexed' ELSE 'pending_rebuild' END AS status,
  strftime(CASE WHEN p THEN coalesce(at_time, TIMESTAMP '2024-02-02') ELSE TIMESTAMP '2024-02-01' END, '%Y-%m-%d %H:%M:%S') AS updated_at,
  coalesce(rp, '') AS raw_path, CASE WHEN NOT p THEN '' WHEN markdown_exists THEN 'processed/' || j.sid || '.md' WHEN m.source_id IS NOT NULL THEN 'm.md' ELSE '' END AS markdown_path,
  CASE WHEN m.source_id IS NOT NULL THEN '.txt' WHEN j.raw_file <> '' THEN '.html' WHEN rp IS NOT NULL THEN '.pdf' ELSE '' END AS raw_suffix, CASE WHEN p THEN 'processed' ELSE 'raw' END AS file_origin
FROM joined j LEFT JOIN catalog c ON c.id = j.sid LEFT JOIN manifest m ON m.source_id = j.sid"""
BLOCK = " ".join(f"WHEN contains(lower(content), {text(s)}) THEN {text(s)}" for s in fixed.BLOCK_SIGNALS)
CRAWL = f"""entries AS ({I.sql([*I.CATALOG, 'doc_id'], 'documents')}), fetched AS ({I.sql(I.FETCHES, 'documents')}),
signalled AS (SELECT *, CASE WHEN contains(content_type, 'html') THEN CASE {BLOCK} ELSE '' END ELSE '' END AS signal FROM entries JOIN fetched USING (doc_id)),
crawl AS (SELECT *, CASE WHEN crawl_mode <> 'auto' THEN 'manual_required' WHEN http_status >= 400 OR error IS NOT NULL THEN 'failed' WHEN signal <> '' THEN 'blocked' ELSE 'downloaded' END AS status,
  CASE WHEN crawl_mode <> 'auto' THEN 'manual_source' WHEN http_status >= 400 THEN 'http_' || http_status WHEN error IS NOT NULL THEN error
    WHEN signal <> '' THEN 'anti_bot_or_js:' || signal ELSE '' END AS reason FROM signalled)"""
ORACLE["crawl_counts"] = f"WITH {CRAWL} SELECT status, count(*) AS sources FROM crawl GROUP BY status"
ORACLE["crawl_table"] = f"""WITH {CRAWL}, rows AS (SELECT *, replace(coalesce(nullif(reason, ''), notes), '|', '/') AS note,
  CASE WHEN status <> 'downloaded' THEN '' ELSE id || CASE WHEN contains(content_type, 'pdf') OR ends_with(lower(fetch_url), '.pdf') THEN '.pdf'
    WHEN contains(content_type, 'html') OR contains(content_type, 'text/') THEN '.html' WHEN content_type = 'application/json' THEN '.json' ELSE '.bin' END END AS file_path FROM crawl)
SELECT id, status, note, file_path, '| ' || id || ' | ' || category || ' | ' || market || ' | ' || platform || ' | ' || status || ' | ' || note || ' | ' || file_path || ' |' AS line FROM rows"""
ORACLE["index_fingerprint"] = """WITH d AS (SELECT md5(doc_id || '|kb/' || doc_id || '|' || n_chars || '|' || doc_id % 100) AS h FROM documents),
s AS (SELECT count(*) AS documents, sum(('0x' || substr(h, 1, 8))::BIGINT) AS a, sum(('0x' || substr(h, 9, 8))::BIGINT) AS b,
  sum(('0x' || substr(h, 17, 8))::BIGINT) AS c, sum(('0x' || substr(h, 25, 8))::BIGINT) AS e FROM d)
SELECT documents, sha256('hash-md5-384|' || documents || '|' || a || '|' || b || '|' || c || '|' || e) AS fingerprint FROM s"""
ORACLE["index_status"] = """SELECT count(DISTINCT doc_id) AS documents, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS chunks, '2024-01-01' AS built_at, 'ready' AS status FROM documents"""
ORACLE["changed_documents"] = "SELECT doc_id, n_chars AS size FROM documents WHERE doc_id % 100 > 50"

# --- workflow progress --------------------------------------------------------------------

STEP_ROWS = values([(s, i) for i, s in enumerate(fixed.GENERATE_STEPS)], "step, step_index")
EVENTS = f"events_in AS ({I.sql(I.EVENTS, 'events')})"
STATES = f"""{EVENTS}, seen AS (SELECT e.*, s.step_index FROM events_in e JOIN {STEP_ROWS} s USING (step)),
last_rows AS (SELECT run_id, step, step_index, arg_max(status, event_no) AS status, max(event_no) AS at_no, arg_max(duration_ms, event_no) FILTER (WHERE duration_ms IS NOT NULL) AS duration_ms,
  arg_max(message, event_no) FILTER (WHERE message <> '') AS server_message, arg_max(message, event_no) AS message, max(event_no) FILTER (WHERE status = 'active') AS started FROM seen GROUP BY ALL),
states AS (SELECT run_id, step, step_index, CASE WHEN status = 'active' AND EXISTS (SELECT 1 FROM last_rows l WHERE l.run_id = r.run_id AND l.step_index > r.step_index AND l.started > r.at_no)
    THEN 'completed' ELSE status END AS status, duration_ms, server_message, CASE WHEN status = 'error' THEN message END AS error_message FROM last_rows r)"""
ORACLE["workflow_steps"] = f"WITH {STATES} SELECT * FROM states"
ORACLE["completed_steps"] = f"WITH {STATES} SELECT run_id, count(*) FILTER (WHERE status = 'completed') AS completed FROM states GROUP BY run_id"
ENDS = "ends AS (SELECT * FROM events_in WHERE event IN ('complete', 'error') QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_no) = 1)"
ORACLE["terminal_events"] = f"WITH {EVENTS}, {ENDS} SELECT run_id, event, error_type, message FROM ends"
ORACLE["failed_runs"] = f"""WITH {STATES}, {ENDS},
targets AS (SELECT s.run_id, e.message AS err, coalesce(min(s.step_index) FILTER (WHERE s.status = 'active'), max(s.step_index) FILTER (WHERE s.status = 'completed') + 1, 0) AS target
  FROM states s JOIN ends e ON e.run_id = s.run_id AND e.event = 'error' GROUP BY ALL)
SELECT s.run_id, s.step, CASE WHEN s.step_index = t.target THEN 'error' ELSE s.status END AS status, CASE WHEN s.step_index = t.target THEN t.err ELSE s.error_message END AS error_message
FROM states s LEFT JOIN targets t USING (run_id)
UNION ALL SELECT t.run_id, n.step, 'error', t.err FROM targets t JOIN {STEP_ROWS} n ON n.step_index = t.target
WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.run_id = t.run_id AND s.step_index = t.target)"""
GAPS = f"{EVENTS}, gaps AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_no))) / 1000000 AS gap FROM events_in)"
ORACLE["idle_gaps"] = f"""WITH {GAPS} SELECT run_id, event_no, CAST(floor(gap) AS BIGINT) AS gap_seconds, CAST(floor(gap / 43200) AS BIGINT) AS heartbeats FROM gaps WHERE gap >= 43200"""
ORACLE["timed_out_runs"] = f"WITH {GAPS} SELECT run_id, CAST(floor(max(gap)) AS BIGINT) AS longest FROM gaps GROUP BY run_id HAVING max(gap) > 172800"
ORACLE["idle_sessions"] = f"""WITH {GAPS}, numbered AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_no) AS n FROM gaps)
SELECT run_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS events FROM numbered GROUP BY run_id, n"""
ORACLE["step_durations"] = f"""WITH {EVENTS}, lagged AS (SELECT *, lag(status) OVER w AS before, lag(ts) OVER w AS since FROM events_in WINDOW w AS (PARTITION BY run_id, step ORDER BY ts, event_no)),
done AS (SELECT *, CAST(floor((epoch_us(ts) - epoch_us(since)) / 1000) AS BIGINT) AS lapse FROM lagged WHERE status = 'completed' AND before = 'active')
SELECT run_id, step, event_no, lapse AS duration_ms, CASE WHEN lapse = 0 THEN '' WHEN lapse < 1000 THEN lapse || 'ms' ELSE printf('%.1f', CAST(lapse AS DOUBLE) / 1000) || 's' END AS label FROM done"""
ERRORS = {k: v.format(assistant="Assistant") for k, v in fixed.STEP_ERRORS.items()}
ORACLE["step_errors"] = f"""WITH {EVENTS}, failed AS (SELECT *, lower(message || {I.pick('event_no', [' API timeout', ' boom', ' 429'])}) AS t FROM events_in WHERE status = 'error'),
kinds AS (SELECT step, CASE WHEN step = 'trend_hunter' THEN 'search_timeout' WHEN step IN ('script_writer', 'rewriter', 'compliance_fix') AND {contains_any('t', fixed.LLM_BUSY_WORDS)} THEN 'llm_busy'
  WHEN step IN ('compliance', 'compliance_scan') THEN 'compliance_blocked' ELSE 'workflow_error' END AS error_type FROM failed)
SELECT step, error_type, {lookup('error_type', ERRORS, "''")} AS message, count(*) AS events FROM kinds GROUP BY ALL"""
ORACLE["event_texts"] = f"WITH {EVENTS} SELECT event, step, status, count(*) AS events FROM events_in GROUP BY ALL"

# --- page layout --------------------------------------------------------------------------

LAYOUT = f"elements AS ({I.sql(I.LAYOUT, 'lineitem')})"
CLEAR = f"""{LAYOUT}, clear AS (SELECT * FROM elements e WHERE kind = 'table' OR NOT EXISTS (SELECT 1 FROM elements t WHERE t.kind = 'table' AND t.doc = e.doc AND t.page = e.page
  AND least(e.x1, t.x1) - greatest(e.x0, t.x0) > 10 AND least(e.y1, t.y1) - greatest(e.y0, t.y0) > 10))"""


def order_sql(source: str) -> str:
    return f"""jumps AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc, page ORDER BY x0, element_no) > 72 THEN 1 ELSE 0 END AS jump FROM {source}),
clusters AS (SELECT *, sum(jump) OVER (PARTITION BY doc, page ORDER BY x0, element_no) AS cluster FROM jumps),
centres AS (SELECT doc, page, cluster AS c, avg(x0) AS centre, count(*) OVER (PARTITION BY doc, page) AS n FROM clusters GROUP BY doc, page, cluster),
near AS (SELECT e.doc, e.page, e.element_no, CASE WHEN max(c.n) <= 1 THEN 0 ELSE arg_min(c.c, abs(e.x0 - c.centre) * 1000 + c.c * 0.000001) END AS column_no, max(c.n) AS n
  FROM clusters e JOIN centres c USING (doc, page) GROUP BY ALL),
placed AS (SELECT e.*, k.column_no, row_number() OVER (PARTITION BY e.doc, e.page ORDER BY k.column_no, e.y0, CASE WHEN k.n <= 1 THEN e.x0 ELSE 0 END,
  CASE e.kind WHEN 'table' THEN 1 ELSE 0 END, e.element_no) AS reading_no FROM {source} e JOIN near k USING (doc, page, element_no))"""


ORACLE["outside_tables"] = f"WITH {CLEAR} SELECT doc, page, element_no, kind FROM clear"
ORACLE["reading_order"] = f"WITH {LAYOUT}, {order_sql('elements')} SELECT doc, page, element_no, column_no, reading_no FROM placed"


def fonts_sql(source: str) -> str:
    return f"""sizes AS (SELECT doc, round(font_size) AS size, count(*) AS n, min(page * 1000000000000 + element_no) AS first FROM {source} WHERE kind = 'text' AND round(font_size) >= 6 GROUP BY ALL),
best AS (SELECT doc, size AS body_font FROM sizes QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) = 1)"""


ORACLE["body_fonts"] = f"""WITH {LAYOUT}, {fonts_sql('elements')}
SELECT e.doc, CAST(coalesce(max(b.body_font), 11) AS DOUBLE) AS body_font, count(DISTINCT page) AS pages, count(DISTINCT CASE WHEN kind = 'table' THEN page END) AS table_pages
FROM elements e LEFT JOIN best b USING (doc) GROUP BY e.doc"""
ORACLE["heading_levels"] = f"""WITH {CLEAR}, {order_sql('clear')}, {fonts_sql('clear')},
sized AS (SELECT p.*, coalesce(b.body_font, 11) AS body, len(string_split(text, ' ')) AS words FROM placed p LEFT JOIN best b USING (doc)),
levelled AS (SELECT *, CASE WHEN words > 20 THEN NULL WHEN font_size >= body + 11 OR (length(text) <= 36 AND font_size >= body + 6) THEN 1 WHEN font_size >= body + 5 THEN 2
  WHEN font_size >= body + 3 AND words <= 12 THEN 3 WHEN ends_with(text, '?') AND words <= 12 THEN 2 END AS level FROM sized WHERE NOT (kind = 'text' AND text = '12'))
SELECT doc, page, reading_no, level, CASE WHEN kind = 'text' AND level IS NOT NULL THEN repeat('#', level) || ' ' || text ELSE text END AS line FROM levelled"""

CELLS = f"""wide AS ({I.sql(I.CELLS, 'lineitem')}),
cells AS (SELECT table_id, row_no - 1 AS row_no, 0 AS col_no, l_returnflag AS text FROM wide UNION ALL SELECT table_id, row_no - 1, 1, l_linestatus FROM wide
  UNION ALL SELECT table_id, row_no - 1, 2, part_text FROM wide UNION ALL SELECT table_id, row_no - 1, 3, supplier_text FROM wide)"""
ORACLE["real_tables"] = f"""WITH {CELLS}, clean AS (SELECT *, trim(text) AS t FROM cells),
lines AS (SELECT table_id, row_no, count(*) AS width, count(*) FILTER (WHERE t <> '') AS filled, max(length(t)) FILTER (WHERE t <> '') AS longest FROM clean GROUP BY ALL),
tables AS (SELECT table_id, count(*) AS rows, max(width) AS width, sum(filled) AS filled, max(longest) AS longest, max(filled) FILTER (WHERE row_no <= 1) AS header FROM lines GROUP BY table_id),
uniq AS (SELECT table_id, count(DISTINCT lower(t)) AS u FROM clean WHERE t <> '' GROUP BY table_id)
SELECT table_id, rows, width FROM tables JOIN uniq USING (table_id) WHERE rows >= 2 AND width >= 2 AND filled >= 4 AND u >= 4 AND longest <= 500 AND header >= 2
  AND filled / rows >= 1.8 AND (width < 6 OR filled / (rows * width) >= 0.5)"""
ORACLE["table_markdown"] = f"""WITH {CELLS},
lines AS (SELECT table_id, row_no, count(*) AS n, string_agg(trim(text), ' | ' ORDER BY col_no, trim(text)) AS line FROM cells GROUP BY ALL),
tables AS (SELECT table_id, max(n) AS width FROM lines GROUP BY table_id),
padded AS (SELECT l.table_id, l.row_no, '| ' || l.line || repeat(' | ', CAST(t.width - l.n AS INT)) || ' |' AS line, t.width,
  row_number() OVER (PARTITION BY l.table_id ORDER BY row_no) AS k FROM lines l JOIN tables t USING (table_id))
SELECT table_id, max(line) FILTER (WHERE k = 1) || chr(10) || '| ---' || repeat(' | ---', CAST(max(width) AS INT) - 1) || ' |'
  || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY k) FILTER (WHERE k > 1), '') AS markdown FROM padded GROUP BY table_id"""

# the same results by other ways
ORACLE["vector_blocks"] = ORACLE["vector_topk"]
ORACLE["lexical_postings"] = ORACLE["lexical_search"]
