"""DuckDB SQL of the registered queries, over the driver's tables. Phrases and patterns in it are fixed values, as in functions/patterns.py."""

from __future__ import annotations

from . import derived as D

DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
AB, AA, BB = (DOT.format(a=a, b=b) for a, b in (("e.embedding", "q.embedding"), ("e.embedding", "e.embedding"), ("q.embedding", "q.embedding")))
COSINE = f"CASE WHEN {AA} * {BB} = 0 THEN 0.0 ELSE {AB} / (sqrt({AA}) * sqrt({BB})) END"
QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
SECTION = r"(?i)Section\s+([A-Za-z]?\d+(?:\.\d+)*[A-Za-z]?)"


def nz(x: str) -> str:
    return f"nullif({x}, '')"


def norm_id(x: str) -> str:
    bare = rf"regexp_replace(trim({x}), '[)\].,:;]+$', '')"
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN NULL WHEN regexp_matches({bare}, '^[0-9]') THEN 'R' || {bare} WHEN regexp_matches({bare}, '^[a-z]') THEN upper({bare}[1:1]) || {bare}[2:] ELSE {bare} END"


def has(text: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def op_of(x: str) -> str:
    t = f"lower({x})"
    return f"CASE WHEN contains({t}, 'definition for') AND contains({t}, 'modified by adding the words') AND contains({t}, 'after the word') THEN 'modify_definition_insert_after' WHEN {has(t, 'deleted and replaced', 'amended to read as follows')} THEN 'replace_section' WHEN {has(t, 'sentence is added at the end')} THEN 'append_sentence' WHEN {has(t, 'new exception is added')} THEN 'add_exception' WHEN {has(t, 'definition is added')} THEN 'add_definition' ELSE 'unknownop' END"


def action_by_text(x: str) -> str:
    t = f"lower({x})"
    return f"CASE WHEN {has(t, 'deleted and replaced', 'amended to read as follows')} THEN 'replace' WHEN {has(t, 'is deleted')} THEN 'delete' WHEN {has(t, 'is added', 'new exception is added')} THEN 'add' WHEN {has(t, 'is modified', 'modified by adding')} THEN 'modify' ELSE 'unknown' END"


def action_by_name(x: str) -> str:
    t = f"lower({x})"
    return "CASE " + " ".join(f"WHEN contains({t}, '{w}') THEN '{w}'" for w in ("replace", "delete", "add", "modify")) + " ELSE 'unknown' END"


VECTOR = "[" + ", ".join(f"CAST(length({{t}}) - length(replace({{t}}, '{c}', '')) AS DOUBLE)" for c in D.LETTERS) + "]"

CHUNKS = r"""
l AS (SELECT {k}, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS x FROM {t}),
h AS (SELECT {k}, CASE WHEN starts_with(x[1], 'SECTION:') THEN 1 ELSE 0 END AS head, x FROM l),
r AS (SELECT {k}, head, list_slice(x, head + 1, len(x)) AS x FROM h),
f AS (SELECT {k}, head, x, list_reduce(list_transform(x, lambda s: {{'c': length(s) + length(regexp_replace(s, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) + 1, 'n': 1, 'cuts': []::INT[]}}), lambda s, v: CASE WHEN s.c > 0 AND s.c + v.c > 2000 THEN {{'c': v.c, 'n': s.n + 1, 'cuts': list_append(s.cuts, s.n)}} ELSE {{'c': s.c + v.c, 'n': s.n + 1, 'cuts': s.cuts}} END, {{'c': 0::BIGINT, 'n': 0, 'cuts': []::INT[]}}) AS s FROM r),
g AS (SELECT {k}, head, x, list_concat([0], s.cuts) AS a, list_concat(s.cuts, [len(x)::INT]) AS b FROM f),
c AS (SELECT {k}, head, x, unnest(range(len(a))) AS chunk_no, unnest(a) AS a, unnest(b) AS b FROM g),
z AS (SELECT {k}, CAST(chunk_no AS INT) AS chunk_no, CAST(a + head + 1 AS INT) AS start_line, CAST(b + head AS INT) AS end_line, array_to_string(list_slice(x, a + 1, b), chr(10)) AS content FROM c)"""

HEADER = r"""
p AS (SELECT doc_id, header, CASE WHEN starts_with(header, 'SECTION:') THEN list_filter(list_transform(string_split(header[9:], '|'), lambda x: trim(x)), lambda x: x <> '') END AS p FROM (""" + D.HEADERS + r""")),
r AS (SELECT doc_id, header, p, CASE WHEN len(p) >= 3 THEN list_slice(p, 2, len(p)) END AS r FROM p),
m AS (SELECT doc_id, header, CASE WHEN len(p) >= 3 THEN p[1] END AS code_system,
 list_filter(r, lambda x: regexp_matches(x, '(?i)^Title\b'))[-1] AS title, list_filter(r, lambda x: regexp_matches(x, '(?i)^Chapter\b'))[-1] AS chapter,
 trim(regexp_replace(list_filter(r, lambda x: regexp_matches(x, '(?i)^Section\b'))[-1], '(?i)^Section\s+', '')) AS section_id,
 trim(regexp_replace(list_filter(r, lambda x: regexp_matches(x, '(?i)^Target\b'))[-1], '(?i)^Target\s+', '')) AS target_section_id,
 trim(regexp_replace(list_filter(r, lambda x: regexp_matches(x, '(?i)^Op\b'))[-1], '(?i)^Op\s+', '')) AS amendment_action,
 list_filter(r, lambda x: NOT regexp_matches(x, '(?i)^(?:Title|Chapter|Section|Target|Op)\b'))[1] AS section_title FROM r)"""

NAMES = r"""
f AS (SELECT doc_id, file_name, string_split(regexp_replace(file_name, '(?i)\.txt$', ''), '_') AS p FROM (""" + D.FILE_NAMES + r""")),
g AS (SELECT doc_id, file_name, p, list_filter(p, lambda x: starts_with(x, 'Title-'))[1][7:] AS t, list_filter(p, lambda x: starts_with(x, 'Chapter-'))[1][9:] AS c, list_filter(p, lambda x: starts_with(x, 'Section-'))[1][9:] AS s FROM f),
n AS (SELECT doc_id, file_name, p, CASE WHEN t IS NOT NULL AND c IS NOT NULL AND s IS NOT NULL THEN t END AS title, CASE WHEN t IS NOT NULL AND c IS NOT NULL AND s IS NOT NULL THEN t || '-' || regexp_replace(c, '^[^-]*-', '') END AS chapter, CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN s END AS section,
 list_filter(list_transform(p, lambda x: regexp_replace(x, '(?i)\.txt$', '')), lambda x: regexp_matches(x, '^[A-Za-z]?\d+(?:\.\d+)*[A-Za-z]?$'))[1] AS raw_path FROM g)"""

URL = "CASE WHEN section IS NOT NULL AND len(string_split(section, '-')) >= 3 THEN 'https://le.utah.gov/xcode/Title' || string_split(section, '-')[1] || '/Chapter' || string_split(section, '-')[2] || '/' || string_split(section, '-')[1] || '-' || string_split(section, '-')[2] || '-S' || array_to_string(string_split(section, '-')[3:], '-') || '.html' END"

ITEM = rf"""
i AS (SELECT doc_id, item_text, CAST(coalesce(TRY_CAST({nz(r"regexp_extract(item_text, '(?i)^\s*\(?(\d+)\)?[.)]?\s*In\s+IRC,\s+Section', 1)")} AS BIGINT), doc_id + 1) AS BIGINT) AS item_number,
 {norm_id(nz(f"regexp_extract(item_text, '{SECTION}', 1)"))} AS section_id, {op_of("item_text")} AS operation, regexp_replace(item_text, '\s+$', '') AS clean FROM ({D.ITEMS})),
v AS (SELECT *, list_filter([CASE WHEN length(clean) <= 120 THEN 'text_too_short' END, CASE WHEN NOT regexp_matches(clean, '(?i)In\s+IRC,\s+Section') THEN 'missing_in_irc_section_phrase' END, CASE WHEN section_id IS NULL THEN 'missing_section_id' END,
 CASE WHEN operation = 'replace_section' AND section_id IS NOT NULL AND len(regexp_extract_all(clean, '"([^"]+)"', 1)) > 0 AND len(list_filter(regexp_extract_all(clean, '"([^"]+)"', 1), lambda q: contains(upper(q), upper(section_id)))) = 0 THEN 'section_id_not_in_quoted_block' END], lambda x: x IS NOT NULL) AS reasons,
 (CASE WHEN length(CAST(item_number AS VARCHAR)) < 4 THEN lpad(CAST(item_number AS VARCHAR), 4, '0') ELSE CAST(item_number AS VARCHAR) END) || '_' || regexp_replace(coalesce(section_id, 'UNKNOWN'), '[^A-Za-z0-9.]+', '-', 'g') || '_' || operation || '.txt' AS file_name FROM i)"""

INFO = f"WITH {HEADER[1:]}, {NAMES[1:]}, w AS (SELECT doc_id, item_text FROM ({D.ITEMS})), a AS (SELECT doc_id, coalesce({nz(norm_id(nz('coalesce(m.target_section_id, m.section_id)')))}, {nz(norm_id('n.raw_path'))}, {nz(norm_id(nz(f'regexp_extract(w.item_text, {chr(39)}{SECTION}{chr(39)}, 1)')))}) AS target_section_id, {action_by_name('m.amendment_action')} AS named, {action_by_text('w.item_text')} AS told FROM w JOIN m USING (doc_id) JOIN n USING (doc_id)), info AS (SELECT doc_id, CASE WHEN named IS NULL OR named = 'unknown' THEN told ELSE named END AS action, target_section_id FROM a)"
BASE = f"{INFO}, base AS (SELECT doc_id, section_id, {norm_id('section_id')} AS norm FROM m)"
GONE = "SELECT target_section_id FROM info WHERE target_section_id IS NOT NULL AND action IN ('delete', 'replace')"

PARTS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(answer), '([.!?])\s+', '\1' || chr(1), 'g'), '[\n\x01]+'), lambda x: trim(x)), lambda x: x <> '')"
QC = r"(regexp_matches({x}, '" + '"[^"]{{3,}}"' + r"') AND regexp_matches({x}, '(?i)\[source\s+\d+,\s+lines\s+\d+[-–]\d+\]'))"
ANSWERS = """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'I cannot answer that from the provided code sections.' WHEN 1 THEN concat('The rule says "', lang, ' text" [source 1, lines 2-', cast(doc_id AS string), '].')
  WHEN 2 THEN concat('One "abc" [Source 2, lines 1–3]. Two is bare ', source, '.') WHEN 3 THEN concat('A "quoted text" [source 3, lines 4-5]', chr(10), chr(10), 'B "more text here" [source 1, lines 1-2]') WHEN 4 THEN concat('"ab" [source 1, lines 1-2] ', lang) ELSE concat('She said "stop. now" [source 1, lines 1-2] ', source) END AS answer FROM documents"""
QUESTIONS = "SELECT item_id, CASE item_id % 4 WHEN 0 THEN concat('what about R302.2 ', text) WHEN 1 THEN concat('see 57-12-6 ', text) WHEN 2 THEN concat('Title 10 and Chapter 3-', cast(item_id AS string), ' of section 3-1-1.', cast(item_id AS string)) ELSE text END AS query FROM benchmark"
CODE = r"(regexp_matches({x}, '(?i)\b([a-z]\d{{3,}}(\.\d+)*)\b') OR regexp_matches({x}, '\b\d{{1,3}}-\d{{1,3}}-\d+(\.\d+)?\b'))"
HISTORY = "SELECT *, count(*) OVER w AS n_history, last_value(CASE WHEN role = 'user' AND trim(text) <> '' THEN trim(text) END IGNORE NULLS) OVER w AS last_query FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"

# a frame and two inner lines around the tokens of each page, snapped and merged
RULED = f"""
t AS (SELECT * FROM ({D.TOKENS})), g AS (SELECT page, max(x1) AS w, max(bottom) AS h FROM t GROUP BY page),
e AS (SELECT page, unnest([{{'x0': 0.0, 'x1': 200.0, 'a': y, 'b': y}} FOR y IN [0.0, 140.2, h]] || [{{'x0': 199.0, 'x1': w, 'a': y, 'b': y}} FOR y IN [0.0, 140.2, h]] || [{{'x0': x, 'x1': x, 'a': 0.0, 'b': h}} FOR x IN [0.0, 299.9, w]]) AS s FROM g),
k AS (SELECT page, CASE WHEN abs(s.b - s.a) <= 1 THEN 'h' WHEN abs(s.x1 - s.x0) <= 1 THEN 'v' END AS orientation, s FROM e),
n AS (SELECT page, orientation, round_even(CASE WHEN orientation = 'h' THEN s.a ELSE s.x0 END / 0.5, 0) * 0.5 AS "at", round_even(CASE WHEN orientation = 'h' THEN s.x0 ELSE s.a END / 0.5, 0) * 0.5 AS start, round_even(CASE WHEN orientation = 'h' THEN s.x1 ELSE s.b END / 0.5, 0) * 0.5 AS stop FROM k),
i AS (SELECT *, coalesce(CAST(start - max(stop) OVER (PARTITION BY page, orientation, "at" ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2.0 AS INT), 1) AS opens FROM n WHERE stop - start >= 6.0),
j AS (SELECT *, sum(opens) OVER (PARTITION BY page, orientation, "at" ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM i),
ruled AS (SELECT page, orientation, "at", min(start) AS start, max(stop) AS stop FROM j GROUP BY page, orientation, "at", k)"""

SQL = {
    "rulings": f"WITH {RULED[1:]} SELECT page, orientation, \"at\" AS place, start, stop FROM ruled",
    "table_grid": f"WITH {RULED[1:]}, b AS (SELECT page, orientation, \"at\" AS lo, lead(\"at\") OVER (PARTITION BY page, orientation ORDER BY \"at\") AS hi FROM ruled), c AS (SELECT y.page, x.lo AS x0, x.hi AS x1, y.lo AS a, y.hi AS b FROM b y JOIN b x ON x.page = y.page AND x.orientation = 'v' AND y.orientation = 'h' WHERE x.hi IS NOT NULL AND y.hi IS NOT NULL), f AS (SELECT c.page, c.x0, c.a, count(t.token_id) AS n FROM c LEFT JOIN t ON t.page = c.page AND (t.x0 + t.x1) / 2 BETWEEN c.x0 AND c.x1 AND (t.top + t.bottom) / 2 BETWEEN c.a AND c.b GROUP BY ALL) SELECT page, CAST(1 AS INT) AS table_no, CAST(count(DISTINCT a) AS INT) AS n_rows, CAST(count(DISTINCT x0) AS INT) AS n_cols, round(avg(CAST(n = 0 AS DOUBLE)), 6) AS empty_ratio, count(DISTINCT a) >= 2 AND count(DISTINCT x0) >= 2 AND avg(CAST(n = 0 AS DOUBLE)) <= 0.8 AS ok FROM f GROUP BY page",
    "label_bind": f"WITH {RULED[1:]}, b AS (SELECT page, min(start) FILTER (WHERE orientation = 'h') AS x0, max(stop) FILTER (WHERE orientation = 'h') AS x1, min(\"at\") FILTER (WHERE orientation = 'h') + 100 AS a, max(\"at\") FILTER (WHERE orientation = 'h') AS b FROM ruled GROUP BY page), l AS (SELECT *, 'TABLE R30' || CAST(token_id % 7 AS VARCHAR) || ' Sizes' AS label FROM t WHERE token_id % 40 = 1), m AS (SELECT b.page, coalesce((max({{'b': l.bottom, 't': l.top, 'x': l.x0, 's': l.label}}) FILTER (WHERE l.bottom <= b.a AND b.a - l.bottom <= 60)).s, (min({{'t': l.top, 'x': l.x0, 's': l.label}}) FILTER (WHERE l.top BETWEEN b.a AND b.a + (b.b - b.a) * 0.15)).s) AS label FROM b LEFT JOIN l ON l.page = b.page AND l.x0 <= b.x1 AND l.x1 >= b.x0 GROUP BY b.page) SELECT page, CAST(1 AS INT) AS table_no, label, nullif(regexp_extract(label, '^TABLE\\s+([A-Z]{{1,3}}\\d{{3,4}})', 1), '') AS table_id FROM m",
    "page_predicates": rf"""WITH l AS (SELECT doc_id, line, coalesce(line, '') AS x, regexp_matches(coalesce(line, ''), '(?:\.\s*){{3,}}') AS d, regexp_matches(coalesce(line, ''), '(?:\b[A-Z]{{1,3}}-\d+\b\s*|\b\d+\b\s*)$') AS n, regexp_matches(coalesce(line, ''), '(?i)^\s*APPENDIX\s+[A-Z]{{1,3}}\b') AS a FROM ({D.PAGE_LINES})),
h AS (SELECT *, regexp_extract(x, '(?i)^\s*([A-Z]{{1,3}}\d{{3,4}}(?:\.\d+){{0,6}})\b(.*)$', 2) AS r, nullif(regexp_extract(x, '(?i)^\s*([A-Z]{{1,3}}\d{{3,4}}(?:\.\d+){{0,6}})\b(.*)$', 1), '') AS i FROM l),
g AS (SELECT *, CASE WHEN i IS NOT NULL AND NOT starts_with(r, '(') AND regexp_matches(ltrim(r), '^\p{{Lu}}') THEN i END AS heading, NOT d AND regexp_matches(x, '[.!?;:]') AS prose FROM h)
SELECT doc_id, d AS dotted, prose, n AS numbered, d AND n AS toc, regexp_matches(x, '(?i)^\s*(?:(?:SECTION\s+)?[A-Z]{{1,3}}\d{{3,4}}(?:\.\d+)*\b|APPENDIX\s+[A-Z]{{1,3}}\b)') AS toc_on, contains(upper(regexp_replace(x, '\s+', '', 'g')), 'TABLEOFCONTENTS') AS toc_head, a AS appendix, a AND (d OR regexp_matches(trim(x), '(?:\b[A-Z]{{1,3}}-\d+\b\s*|\b\d+\b\s*)$') OR (trim(x) = upper(trim(x)) AND NOT prose)) AS appendix_toc,
regexp_matches(x, '(?i)^\s*(?:SECTION\s+SECTION|APPENDIX\s+APPENDIX|TABLE\s+TABLE|FIGURE\s+FIGURE|CHAPTER\s+CHAPTER|PART\s+PART)\s*$') AS repeated, regexp_matches(x, '(?i)\b(?:UTAH|STATE|AMENDED|MODIFIED|AMENDMENTS)\b') AS amends, contains(upper(x), 'TABLE') AND contains(upper(x), 'R301.2(1)') AND contains(upper(x), 'CONTINUED') AS goes_on,
heading, nullif(regexp_extract(x, '(?i)^\s*SECTION\s+([A-Z]{{1,3}}\d{{3,4}}(?:\.\d+){{0,6}})\b', 1), '') AS marker, nullif(regexp_extract(x, '(?i)^CHAPTER\s+([A-Z0-9]+)\b', 1), '') AS chapter, CAST(len(regexp_extract_all(heading, '\d+')) AS INT) AS depth, nullif(regexp_extract(x, '(?i)^TABLE\s+([A-Z]{{1,3}}\d{{3,4}}(?:\.\d+)*(?:\([0-9A-Z]+\))?)\b\.?\s*(.*)?$', 1), '') AS table_id, x AS cell FROM g""",
    "vector_topk": f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, {QUERY} ORDER BY {COSINE} DESC, e.vec_id LIMIT 6",
    "vector_topk_per_corpus": f"SELECT label, CAST(rank AS INT) AS rank, vec_id, round(score, 6) AS score FROM (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT e.label, e.vec_id, {COSINE} AS score FROM embeddings e, {QUERY})) WHERE rank <= 6",
    "search_preview": f"SELECT doc_id, codebook_id, source_path, array_to_string(list_transform(list_filter(range(1, least(length(text), 500) + 1), lambda i: i + length(regexp_replace(substring(text, 1, i), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) <= 500), lambda i: substring(text, i, 1)), '') AS preview FROM ({D.TEXTS}) WHERE doc_id IN (SELECT vec_id FROM (SELECT e.vec_id FROM embeddings e, {QUERY} ORDER BY {COSINE} DESC, e.vec_id LIMIT 5))",
    "registry_labels": f"WITH r AS ({D.REGISTRY}), a AS (SELECT base_id, max_by(id, ord) AS amendment_id FROM r WHERE is_amendment GROUP BY base_id) SELECT codebook_id, coalesce(r.label, codebook_id) AS label, NOT coalesce(r.is_amendment, false) AS is_base, a.amendment_id, docs FROM (SELECT codebook_id, count(*) AS docs FROM ({D.CORPUS}) GROUP BY codebook_id) c LEFT JOIN r ON c.codebook_id = r.id LEFT JOIN a ON c.codebook_id = a.base_id",
    "doc_lines": "SELECT doc_id, CAST(unnest(range(1, len(x) + 1)) AS INT) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)",
    "greedy_chunks": "WITH " + CHUNKS[1:].format(k="doc_id", t=f"({D.TEXTS})") + " SELECT * FROM z",
    "chunk_ids": "WITH " + CHUNKS[1:].format(k="codebook_id, source_path", t=f"({D.CORPUS})") + " SELECT codebook_id || '-' || CAST(row_number() OVER (PARTITION BY codebook_id ORDER BY source_path, chunk_no) - 1 AS VARCHAR) AS chunk_id, source_path, start_line, end_line, CAST(length(content) AS INT) AS chars FROM z",
    "header_parse": f"WITH {HEADER[1:]} SELECT doc_id, CAST(starts_with(header, 'SECTION:') AS INT) AS header_lines, code_system, title, chapter, section_id, target_section_id, amendment_action, section_title, CASE WHEN {nz('section_id')} IS NOT NULL THEN concat_ws(' – ', 'Section ' || section_id, section_title) END AS section_label FROM m",
    "filename_meta": f"WITH {NAMES[1:]} SELECT doc_id, title, chapter, section, 'Section ' || section AS section_label, {URL} AS public_url, {norm_id('raw_path')} AS path_section FROM n",
    "section_split": rf"""WITH l AS (SELECT CAST(floor(line_no / 1000.0) AS BIGINT) AS doc, line_no, line, trim(line) AS bare, {nz(r"regexp_extract(trim(line), '(?i)^CHAPTER\s+(\d+)\b', 1)")} AS ch FROM ({D.LINES})),
s AS (SELECT *, CASE WHEN ch IS NULL THEN {nz(r"regexp_extract(bare, '^(R\d{3}(?:\.\d+)*)(?:\s+(.+))?$', 1)")} END AS id, {nz(r"trim(regexp_replace(regexp_extract(bare, '^(R\d{3}(?:\.\d+)*)(?:\s+(.+))?$', 2), '\s*\.$', ''))")} AS t FROM l),
r AS (SELECT *, sum(CASE WHEN id IS NOT NULL THEN 1 ELSE 0 END) OVER w AS section_no, last_value(ch IGNORE NULLS) OVER w AS now FROM s WINDOW w AS (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc, CAST(section_no AS BIGINT) AS section_no, min_by(id, line_no) AS section_id, max(CASE WHEN id IS NOT NULL THEN t END) AS section_title, arg_max_null(now, line_no) AS chapter, min(line_no) AS start_line, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE ch IS NULL AND id IS NULL), '') AS body FROM r WHERE section_no > 0 GROUP BY doc, section_no""",
    "item_split": rf"""WITH l AS (SELECT CAST(floor(doc_id / 500.0) AS BIGINT) AS doc, doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN item_text ELSE 'more ' || CAST(doc_id AS VARCHAR) END, '\s+$', '') AS line FROM ({D.ITEMS})),
r AS (SELECT *, sum(CASE WHEN regexp_matches(line, '(?i)^\s*(?:\(\d+\)|\d+\)|\d+\.)?\s*In\s+IRC,\s+Section') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS position FROM l)
SELECT doc, CAST(position AS BIGINT) AS position, min(doc_id) AS start_line, min_by(line, doc_id) AS start_text, regexp_replace(string_agg(line, chr(10) ORDER BY doc_id), '\n+$', '') AS text FROM r WHERE position > 0 GROUP BY doc, position""",
    "op_classify": f"WITH {ITEM[1:]} SELECT doc_id, item_number, section_id, operation, {action_by_name('operation')} AS action_by_name, {action_by_text('item_text')} AS action_by_text FROM i",
    "item_validate": f"WITH {ITEM[1:]} SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS suspicious, file_name FROM v",
    "extract_report": f"WITH {ITEM[1:]} SELECT count(*) AS detected, count(*) AS written, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (WHERE len(reasons) > 0) AS suspicious_count, string_agg(file_name, ',' ORDER BY file_name) FILTER (WHERE len(reasons) > 0) AS suspicious_files FROM v",
    "amendment_info": f"{INFO} SELECT doc_id, action, target_section_id FROM info",
    "amendment_override_normal": f"{BASE} SELECT doc_id, section_id FROM base WHERE norm NOT IN ({GONE})",
    "amendment_override_empty": f"{BASE} SELECT doc_id, section_id FROM base WHERE norm NOT IN (SELECT target_section_id FROM info WHERE false)",
    "amendment_override_null": f"{BASE} SELECT doc_id, section_id FROM base WHERE norm NOT IN (SELECT CASE WHEN doc_id % 20 <> 1 THEN target_section_id END FROM info WHERE action IN ('delete', 'replace'))",
    "context_build": f"SELECT q, string_agg(t, chr(10) ORDER BY sid) AS context, count(*) AS n_sources FROM (SELECT CAST(floor(doc_id / 10.0) AS BIGINT) AS q, doc_id % 10 + 1 AS sid, '[source ' || CAST(doc_id % 10 + 1 AS VARCHAR) || ', lines 1-' || CAST(len(string_split(coalesce(text, ''), chr(10))) AS VARCHAR) || '] ' || coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source_path, ''), 'Source ' || CAST(doc_id % 10 + 1 AS VARCHAR)) || chr(10) || coalesce(text, '') || chr(10) AS t FROM ({D.CORPUS})) GROUP BY q",
    "quotes_raw": f"SELECT q, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY sid) AS quotes, count(*) AS n_sources FROM (SELECT CAST(floor(doc_id / 10.0) AS BIGINT) AS q, doc_id % 10 + 1 AS sid, '[source ' || CAST(doc_id % 10 + 1 AS VARCHAR) || ', lines 1-9] ' || CASE WHEN doc_id % 4 = 0 THEN source_path ELSE 'of ' || lang END || chr(10) || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM ({D.CORPUS})) GROUP BY q",
    "amendment_refs": f"WITH d AS (SELECT CAST(floor(doc_id / 40.0) AS BIGINT) AS q, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'c-' || CAST(doc_id % 7 AS VARCHAR) END AS id, 'p' || CAST(doc_id % 3 AS VARCHAR) AS source_path, codebook_id, row_number() OVER (PARTITION BY floor(doc_id / 40.0) ORDER BY codebook_id = 'base', doc_id) AS n FROM ({D.CORPUS})), k AS (SELECT *, row_number() OVER (PARTITION BY q, CASE WHEN trim(id) = '' THEN source_path || ':1-2' ELSE id END ORDER BY n) AS j FROM d) SELECT q, id, source_path, codebook_id, CAST(row_number() OVER (PARTITION BY q ORDER BY n) AS INT) AS source_id FROM k WHERE j = 1",
    "answer_check": f"SELECT id, trim(answer) = 'I cannot answer that from the provided code sections.' OR (len({PARTS}) > 0 AND len(list_filter({PARTS}, lambda x: NOT {QC.format(x='x')})) = 0) AS valid, {QC.format(x='answer')} AS whole FROM ({ANSWERS})",
    "quote_check": "WITH e AS (SELECT doc_id, doc_id % 6 AS m, regexp_replace(replace(right(coalesce(text, ''), 30), ' ', '  '), '^\\s+|\\s+$', '', 'g') AS x FROM documents) SELECT doc_id AS id, CASE WHEN m = 3 THEN 'not_json' WHEN m = 4 THEN 'cannot_answer' WHEN m = 5 THEN 'no_title' WHEN m = 1 THEN 'excerpt_not_verbatim' WHEN x = '' THEN 'empty_excerpt' WHEN m = 2 THEN 'source_out_of_range' END AS reason, CASE WHEN m = 0 AND x <> '' THEN 'T' || chr(10) || chr(10) || '[source 1, lines 1-7]' || chr(10) || x || chr(10) END AS answer FROM e",
    "search_flow": f"WITH c AS (SELECT codebook_id || '-' || CAST(doc_id AS VARCHAR) AS id, codebook_id, doc_id, {VECTOR.format(t="coalesce(text, '')")} AS v FROM ({D.CORPUS})), q AS (SELECT item_id, coalesce(text, '') AS text, CASE WHEN item_id % 2 = 0 THEN 'base' ELSE 'base-amend' END AS corpus, CASE WHEN item_id % 3 = 0 THEN 5 ELSE 3 END AS k, {VECTOR.format(t="regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')")} AS v FROM benchmark), s AS (SELECT item_id, k, id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN list_dot_product(c.v, c.v) * list_dot_product(q.v, q.v) = 0 THEN 0.0 ELSE list_dot_product(c.v, q.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(q.v, q.v))) END DESC, doc_id) AS r FROM q JOIN c ON c.codebook_id = q.corpus WHERE text <> '') SELECT q.item_id AS request_id, CASE WHEN q.text = '' THEN 400 ELSE 200 END AS status, string_agg(s.id, ',' ORDER BY r) AS ids FROM q LEFT JOIN s ON s.item_id = q.item_id AND s.r <= s.k GROUP BY q.item_id, q.text",
    "code_like": f"SELECT item_id, {CODE.format(x='query')} AS code_like, regexp_matches(query, '(?i)\\b(?:when|okay|ok)\\b') AND regexp_matches(query, '\\b(?:24|16)\\b') AS comparison FROM ({QUESTIONS})",
    "session_window": f"SELECT conv_id, turn, n_history, last_query FROM ({HISTORY})",
    "effective_query": f"SELECT conv_id, turn, CASE WHEN NOT {CODE.format(x='text')} AND n_history > 0 AND last_query IS NOT NULL THEN last_query || chr(10) || chr(10) || 'Follow-up question:' || chr(10) || text ELSE text END AS effective_query FROM ({HISTORY}) WHERE role = 'user'",
    "structure_extract": rf"SELECT item_id, {nz(r"regexp_extract(lower(query), '\btitle\s+([0-9a-z\-\.]+)', 1)")} AS title, {nz(r"regexp_extract(lower(query), '\bchapter\s+([0-9]+(?:-[0-9a-z]+)+)', 1)")} AS chapter, {nz(r"regexp_extract(lower(query), '\b(?:section|sec\.?)\s+([0-9]+(?:-[0-9a-z]+)*(?:\.[0-9a-z]+)*)', 1)")} AS section FROM ({QUESTIONS})",
    "structure_match": rf"WITH {NAMES[1:]} SELECT doc_id, file_name FROM n WHERE (contains(lower(title), '54') OR contains({nz(r"regexp_extract(lower(file_name), 'title[-_\s]*([0-9a-z.\-]+)', 1)")}, '54')) AND (contains(lower(chapter), '54b-') OR contains({nz(r"regexp_extract(lower(file_name), 'chapter[-_\s]*([0-9]+(?:-[0-9a-z]+)+)', 1)")}, '54b-'))",
    "page_median": f"SELECT page, round(median((x1 - x0) / length(text)), 6) AS char_width, round(median((x1 - x0) / length(text)) * 0.5, 6) AS gap, round(median(size), 6) AS size_median FROM ({D.TOKENS}) GROUP BY page",
    "page_percentile": f"SELECT page, round(quantile_cont(x0, 0.05), 6) AS p5, round(quantile_cont(x0, 0.5), 6) AS p50, round(quantile_cont(x0, 0.95), 6) AS p95 FROM ({D.TOKENS}) GROUP BY page",
    "section_stack": """WITH l AS (SELECT CAST(CAST(floor(doc_id / 1000.0) AS BIGINT) AS VARCHAR) AS doc, doc_id % 1000 AS n, lang FROM documents),
t AS (SELECT doc, n, CAST(n // 40 AS INT) AS page, CASE WHEN n % 50 = 0 THEN 'CHAPTER ' || CAST(n // 50 AS VARCHAR) WHEN n % 10 = 1 THEN 'R' || CAST(100 + n // 10 AS VARCHAR) || ' General' WHEN n % 10 = 4 THEN 'R' || CAST(100 + n // 10 AS VARCHAR) || '.1 Scope' ELSE 'body ' || coalesce(lang, '') END AS text, 'R' || CAST(100 + n // 10 - CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR) || CASE WHEN n % 10 IN (4, 5, 6) THEN '.1' ELSE '' END AS section_id FROM l WHERE n > 0 AND n % 10 <> 7)
SELECT doc, section_id, CAST(CASE WHEN contains(section_id, '.') THEN 2 ELSE 1 END AS INT) AS depth, min(page) AS start_page, max(page) AS end_page, CAST((40 * min(page) + 39) // 50 AS VARCHAR) AS chapter, string_agg(text, chr(10) ORDER BY n) AS body, CAST(NULL AS VARCHAR) AS error FROM t GROUP BY doc, section_id""",
    "table_continuation": """WITH t AS (SELECT CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR) AS doc, floor(doc_id / 100.0) % 5 AS kind, CAST(doc_id % 100 AS INT) AS n FROM documents),
i AS (SELECT doc, kind, n, CASE WHEN kind = 4 AND n = 1 THEN 'T0c' WHEN n % 3 = 2 THEN 'T' || CAST(n // 3 AS VARCHAR) || 'b' ELSE 'T' || CAST(n // 3 AS VARCHAR) END AS table_id FROM t)
SELECT doc, table_id, min(n) AS start_page, max(n) AS end_page, CAST(count(*) AS INT) AS n_rows, CAST(NULL AS VARCHAR) AS error FROM i WHERE kind IN (0, 4) GROUP BY doc, table_id
UNION ALL SELECT DISTINCT doc, NULL, CASE WHEN kind = 2 THEN 99 ELSE 1 END, CASE WHEN kind = 2 THEN 99 ELSE 1 END, -1, 'RULE=TABLE_CONTINUATION PDF_PAGE=' || CASE kind WHEN 1 THEN '1 detail=rotation differs' WHEN 2 THEN '99 detail=still open at the end' ELSE '1 detail=the open table''s id comes again without proof' END FROM i WHERE kind IN (1, 2, 3)""",
}
