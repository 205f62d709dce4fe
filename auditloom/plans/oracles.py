"""SQL that must give what the queries give; for DuckDB, over the same tables.

Where RE2 lacks what a pattern needs (lookaround, references back), a query has no SQL here
and is tested against brute force instead.
"""

from __future__ import annotations

import re

from auditloom.functions import patterns as P


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


PAPERS = "papers AS (SELECT paper_id AS doc_id, max(analysis_text) AS text FROM prepared_papers GROUP BY 1)"
RAW = "papers AS (SELECT paper_id AS doc_id, max(raw_text) AS text FROM prepared_papers GROUP BY 1)"
_SPLIT = "string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))"
LINES = f"""split AS (SELECT doc_id, {_SPLIT} AS l FROM papers WHERE text IS NOT NULL),
bare AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM split),
marks AS (SELECT *, regexp_matches(text, '^ {{0,3}}(```|~~~)') AS mark FROM bare),
lines AS (SELECT doc_id, CAST(line AS INTEGER) AS line, text, mark OR coalesce(sum(mark::INT) OVER w, 0) % 2 = 1 AS fenced,
  coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS "offset" FROM marks
  WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
HEADS = r"""seen AS (SELECT *, lead(text) OVER w AS nxt, coalesce(lead(fenced) OVER w, true) AS nf FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
flags AS (SELECT *, NOT fenced AND regexp_matches(text, '^( {0,3})(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$') AS atx FROM seen),
unders AS (SELECT *, NOT fenced AND NOT atx AND NOT nf AND regexp_matches(text, '\S') AND coalesce(regexp_matches(nxt, '^ {0,3}(=+|-+)[ \t]*$'), false) AS und FROM flags),
heads AS (SELECT doc_id, line, CAST(CASE WHEN atx THEN length(regexp_extract(text, '^( {0,3})(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$', 2)) WHEN regexp_matches(nxt, '^ {0,3}=') THEN 1 ELSE 2 END AS INTEGER) AS level,
  trim(CASE WHEN atx THEN regexp_extract(text, '^( {0,3})(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$', 3) ELSE text END) AS title, CAST(line + CASE WHEN atx THEN 1 ELSE 2 END AS INTEGER) AS content_line
  FROM (SELECT *, coalesce(lag(und) OVER (PARTITION BY doc_id ORDER BY line), false) AS taken FROM unders) WHERE atx OR (und AND NOT taken))"""
SECTIONS = """firsts AS (SELECT doc_id, min(line) AS first FROM heads GROUP BY 1),
opening AS (SELECT l.doc_id, 0 AS section, NULL::INTEGER AS parent, 0 AS level, CASE WHEN max(f.first) IS NULL THEN 'Document' ELSE 'Preamble' END AS title, NULL::INTEGER AS heading_line, 1 AS line_start, max(l.line) AS line_end
  FROM lines l LEFT JOIN firsts f USING (doc_id) WHERE f.first IS NULL OR l.line < f.first GROUP BY 1 HAVING bool_or(regexp_matches(l.text, '\\S')) OR max(f.first) IS NULL),
numbered AS (SELECT h.*, CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY line) - 1 + CASE WHEN o.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS section FROM heads h LEFT JOIN opening o ON o.doc_id = h.doc_id),
lasts AS (SELECT doc_id, max(line) AS last FROM lines GROUP BY 1),
sections AS (SELECT * FROM opening UNION ALL SELECT n.doc_id, n.section, (SELECT max(a.section) FROM numbered a WHERE a.doc_id = n.doc_id AND a.line < n.line AND a.level < n.level
    AND a.line = (SELECT max(b.line) FROM numbered b WHERE b.doc_id = n.doc_id AND b.line < n.line AND b.level < n.level)) AS parent, n.level, n.title, n.line AS heading_line, n.content_line AS line_start,
  CAST(coalesce(lead(n.line) OVER (PARTITION BY n.doc_id ORDER BY n.line), x.last + 1) - 1 AS INTEGER) AS line_end FROM numbered n JOIN lasts x USING (doc_id)),
placed AS (SELECT l.doc_id, l.line, l.text, l.fenced, s.section, s.title, s.heading_line FROM lines l ASOF LEFT JOIN (SELECT doc_id, coalesce(heading_line, 1) AS at, section, title, heading_line FROM sections) s ON l.doc_id = s.doc_id AND l.line >= s.at)"""
BASE = f"WITH {PAPERS}, {LINES}"
PLACED = f"WITH {PAPERS}, {LINES}, {HEADS}, {SECTIONS}"
TABLES = r"""cut AS (SELECT doc_id, line, text, fenced, CASE WHEN contains(text, '|') THEN list_transform(string_split(regexp_replace(regexp_replace(trim(text), '^\|', ''), '\|$', ''), '|'), lambda c: trim(c)) END AS cells FROM lines),
delim AS (SELECT *, NOT fenced AND coalesce(len(list_filter(cells, lambda c: NOT regexp_matches(c, '^:?-{3,}:?$'))) = 0, regexp_matches(text, '^\s*:?-{3,}:?\s*$')) AS d FROM cut),
nexts AS (SELECT *, lead(d) OVER w AS nd, lead(cells) OVER w AS nc FROM delim WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
tops AS (SELECT *, coalesce(nd AND NOT fenced AND cells IS NOT NULL AND len(cells) = len(nc), false) AS head FROM nexts),
since AS (SELECT *, max(CASE WHEN head THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS hl FROM tops),
sized AS (SELECT s.*, len(t.cells) AS hn, t.cells AS header FROM since s JOIN tops t ON t.doc_id = s.doc_id AND t.line = s.hl),
fit AS (SELECT *, min(CASE WHEN line <= hl + 1 OR (cells IS NOT NULL AND NOT fenced AND len(cells) = hn) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, hl ORDER BY line) AS ok FROM sized),
tables AS (SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY hl) - 1 AS INTEGER) AS table_no, line, hl, cells, header FROM fit WHERE ok = 1)"""
LEDGER = """ledger AS (SELECT paper_id AS doc_id, ledger_path AS path, line_no AS line, min_by(raw_line, line_id) AS raw FROM ledger_lines WHERE ledger_path LIKE '%.jsonl' AND paper_id IS NOT NULL GROUP BY 1, 2, 3),
filled AS (SELECT *, json_valid(raw) AND NOT regexp_matches(raw, ',\\s*[}\\]]') AS ok FROM ledger WHERE raw IS NOT NULL AND trim(raw) != ''),
good AS (SELECT doc_id, path, line, raw::JSON AS j FROM filled WHERE ok AND json_type(CASE WHEN ok THEN raw ELSE 'null' END) = 'OBJECT')"""
_LABEL = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
LEAVES = """flat AS (SELECT g.doc_id, g.path, g.line, t.fullkey AS field, CASE WHEN regexp_matches(t.fullkey, '\\]$') THEN regexp_extract(t.fullkey, '\\.([^.\\[]+)(\\[\\d+\\])+$', 1) ELSE t.key END AS name, t.path AS parent, t.type, t.atom FROM good g, json_tree(g.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')),
leaves AS (SELECT doc_id, path, line, name, CASE WHEN regexp_matches(parent, '\\.[^.]+$') THEN regexp_extract(parent, '\\.([^.\\[]+)[^.]*$', 1) ELSE '' END AS parent, type,
  CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN atom::DOUBLE END AS number, CASE WHEN type = 'VARCHAR' THEN json_extract_string(atom, '$') WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN atom::VARCHAR END AS value FROM flat)"""
_FAILED = "'" + "', '".join(P.FAILED_STATUSES) + "'"
_STR = "CASE WHEN json_type(j, '$.{0}') = 'VARCHAR' THEN json_extract_string(j, '$.{0}') END"
RECORDS = f"""records AS (SELECT doc_id, path, line, trial, status, CASE WHEN regexp_matches(replace(trial, '_', '-'), '(?i)\\bbaseline\\b') THEN 'baseline'
  WHEN regexp_matches(trial, '{_re(P.CONFIRMATION)}') AND NOT (status IN ({_FAILED}) OR regexp_matches(status, '^(?:{"|".join(P.FAILED_STATUSES)})ed')) THEN 'confirmation'
  WHEN status NOT IN ({_FAILED}) THEN 'candidate' ELSE 'failed' END AS role
  FROM (SELECT doc_id, path, line, coalesce({_STR.format("trial")}, {_STR.format("run_type")}, {_STR.format("role")}, '') AS trial, lower(trim(coalesce({_STR.format("status")}, ''))) AS status FROM good))"""
_TOLD5 = "papers AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'The gain generalizes across 3 benchmarks and holds on all seeds.' || chr(10) ELSE text END AS text FROM base_papers)"
PANEL = """one AS (SELECT l_orderkey AS doc_id, l_linenumber::VARCHAR AS role, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
every AS (SELECT doc_id, role, 'Soundness' AS dimension, (p % 6)::INTEGER AS value, 4 AS most FROM one UNION ALL SELECT doc_id, role, 'Presentation', (s % 5)::INTEGER, 4 FROM one
  UNION ALL SELECT doc_id, role, 'Overall recommendation', (q::BIGINT % 7)::INTEGER, 6 FROM one),
scores AS (SELECT doc_id, role, dimension, value FROM every WHERE value BETWEEN 1 AND most)"""


def _letters(pattern: str) -> str:
    """Word boundaries that know all letters, as Java's do."""
    return _re(re.sub(r"\\b(?=[a-z])", r"(?:^|[^\\pL\\pN_])", pattern).replace(r"\b", r"(?:$|[^\pL\pN_])"))


def _loose(source: str) -> str:
    return f"SELECT doc_id, line, trim(unnest(regexp_extract_all(text, '{P.LOOSE_SENTENCE}')), chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS sentence FROM {source} WHERE regexp_matches(text, '\\S') AND NOT contains(text, '|')"


def _claim_type(text: str, title: str, numbered: str) -> str:
    low, head = f"lower({text})", f"lower(coalesce({title}, ''))"
    return f"""CASE WHEN regexp_matches({head}, 'self[- ]review') THEN 'self_review' WHEN contains({low}, 'falsifiable hypothesis') OR contains({head}, 'hypothesis') THEN 'hypothesis'
  WHEN regexp_matches({text}, '{_re(P.ARITHMETIC)}') THEN 'arithmetic' WHEN contains({head}, 'limitation') OR contains({low}, 'limitation') THEN 'limitation'
  WHEN contains({head}, 'result') OR regexp_matches({text}, '{_re(P.RESULT)}') OR ({numbered} AND regexp_matches({text}, '{_re(P.STATE_OF_THE_ART)}')) THEN 'result'
  WHEN contains({low}, 'baseline') OR contains({head}, 'method') OR contains({head}, 'experiment') THEN 'method' ELSE 'general' END"""


_CITES = f"""found AS (SELECT doc_id, line, 'arxiv' AS provider, regexp_replace(unnest(regexp_extract_all(text, '{_re(P.ARXIV)}', 1)), '(?i)v\\d+$', '') AS identifier FROM lines
  UNION ALL SELECT doc_id, line, 'arxiv', regexp_replace(unnest(regexp_extract_all(text, '{_re(P.BRACKET_ARXIV)}', 1)), '(?i)v\\d+$', '') FROM lines
  UNION ALL SELECT doc_id, line, 's2', unnest(regexp_extract_all(text, '{_re(P.S2_URL)}', 1)) FROM lines
  UNION ALL SELECT doc_id, line, 's2', 'CorpusId:' || unnest(regexp_extract_all(text, '{_re(P.CORPUS_ID)}', 1)) FROM lines
  UNION ALL SELECT doc_id, line, 's2', 'DOI:' || regexp_replace(unnest(regexp_extract_all(text, '{_re(P.DOI)}', 1)), '[.,;)]+$', '') FROM lines
  UNION ALL SELECT doc_id, line, 'registry', unnest(regexp_extract_all(text, '{_re(P.REGISTRY_MARK)}', 1)) FROM lines),
cited AS (SELECT doc_id, provider, lower(identifier) AS low, min_by(identifier, line) AS identifier, min(line) AS line FROM found GROUP BY 1, 2, 3)"""
_STOP = "'" + "', '".join(P.TOPIC_STOPWORDS) + "'"

ORACLES: dict[str, str] = {
    "paper_deliveries": "WITH r AS (SELECT DISTINCT paper_id, received_at, prepared_at FROM prepared_papers) SELECT paper_id, arg_max(received_at, (received_at, prepared_at)) AS received_at, count(*) AS deliveries FROM r GROUP BY 1",
    "doc_hash": "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars FROM documents WHERE text IS NOT NULL",
    "tampered_papers": "SELECT DISTINCT paper_id FROM prepared_papers WHERE sha256(raw_text) != sha256_hex",
    "lines_offsets": f'{BASE} SELECT doc_id, line, length(rtrim(text, chr(13)))::INTEGER AS chars, "offset", fenced FROM lines',
    "line_stats": f"{BASE} SELECT doc_id, count(*) AS lines, count_if(fenced) AS fenced, max(length(text))::INTEGER AS longest, count_if(NOT regexp_matches(text, '\\S')) AS blank FROM lines GROUP BY 1",
    "headings": f"WITH {PAPERS}, {LINES}, {HEADS} SELECT doc_id, line, level, title FROM heads",
    "section_tree": f"{PLACED} SELECT doc_id, section, parent, level, title, heading_line, line_start, line_end FROM sections",
    "section_asof": f"{PLACED} SELECT doc_id, line, section FROM placed",
    "table_cells": f"""{BASE}, {TABLES}, dl AS (SELECT doc_id, table_no, cells AS dc FROM tables WHERE line = hl + 1)
SELECT t.doc_id, t.table_no, t.line, CAST(i - 1 AS INTEGER) AS column_no, t.header[i] AS header, CASE WHEN dc[i] LIKE ':%:' THEN 'center' WHEN dc[i] LIKE ':%' THEN 'left' WHEN dc[i] LIKE '%:' THEN 'right' ELSE 'default' END AS alignment, t.cells[i] AS cell
FROM tables t JOIN dl USING (doc_id, table_no), unnest(range(1, len(t.cells) + 1)) u(i) WHERE t.line > t.hl + 1""",
    "sentences_loose": f"{BASE}, s AS ({_loose('lines')}) SELECT doc_id, line, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars FROM s WHERE sentence != '' GROUP BY 1, 2",
    "invisible_counts": f"WITH {RAW} SELECT doc_id, len(regexp_extract_all(text, '\\p{{Cf}}'))::INTEGER AS n FROM papers WHERE regexp_matches(text, '\\p{{Cf}}')",
    "comments_blanked": f"""WITH {RAW}, parts AS (SELECT doc_id, regexp_extract_all(text, '(?s)<!--.*?-->|[^<]+|<') AS p FROM papers)
SELECT doc_id, sha256(array_to_string(list_transform(p, lambda x: CASE WHEN starts_with(x, '<!--') THEN regexp_replace(x, '[^\\r\\n]', ' ', 'g') ELSE x END), '')) AS sha256 FROM parts""",
    "claim_types": f"SELECT DISTINCT claim_id, {_claim_type('claim_text', 'section_title', 'coalesce(len(numbers), 0) > 0')} AS type FROM claims",
    "claim_junk": "SELECT DISTINCT claim_id, length(regexp_replace(claim_text, '[^|]', '', 'g')) >= 2 OR len(regexp_extract_all(claim_text, '[A-Za-z]{2,}')) < 3 AS junk FROM claims",
    "claim_refs": "WITH r AS (SELECT cite_key, max(cite_status) AS status FROM citation_registry GROUP BY 1), c AS (SELECT DISTINCT claim_id, unnest(refs) AS cite_key FROM claims) SELECT coalesce(status, 'unavailable') AS status, count(*) AS refs, count(DISTINCT claim_id) AS claims FROM c LEFT JOIN r USING (cite_key) GROUP BY 1",
    "ledger_malformed": f"WITH {LEDGER} SELECT doc_id, CASE WHEN ok THEN 'not an object' ELSE 'invalid JSON' END AS problem, count(*) AS n FROM filled WHERE NOT ok OR json_type(CASE WHEN ok THEN raw ELSE 'null' END) != 'OBJECT' GROUP BY 1, 2",
    "ledger_leaves": f"WITH {LEDGER}, {LEAVES} SELECT doc_id, name, count(*) AS n, sum(round(number * 1000)::BIGINT)::BIGINT AS thousandths, max(number) AS highest FROM leaves WHERE number IS NOT NULL GROUP BY 1, 2",
    "ledger_roles": f"WITH {LEDGER}, {RECORDS} SELECT doc_id, role, count(*) AS n FROM records GROUP BY 1, 2",
    "metric_ranges": f"""WITH {LEDGER}, {RECORDS}, {LEAVES} SELECT doc_id, {_LABEL.format('name')} AS metric, role, count(*) AS n, min(number) AS low, max(number) AS high FROM leaves JOIN records USING (doc_id, path, line)
WHERE number IS NOT NULL AND {_LABEL.format('name')} NOT IN ('{"', '".join(P.NON_METRIC_FIELDS)}') GROUP BY 1, 2, 3""",
    "rounding_agreement": """WITH s AS (SELECT l_linenumber, l_extendedprice AS x, floor(round(x * 100) / 10) / 10 AS shown FROM lineitem)
SELECT l_linenumber, count(*) AS n, count_if(abs(shown - x) <= 0.05 * (1 + 1e-9)) AS agree, count_if(abs(shown - (x + 1)) <= 0.05 * (1 + 1e-9)) AS agree_moved FROM s GROUP BY 1""",
    "improvement_claims": f"""{BASE}, s AS ({_loose('lines')}) SELECT doc_id, line, count(*) AS n FROM s WHERE sentence != '' AND regexp_matches(sentence, '{_re(P.IMPROVEMENT)}') AND NOT regexp_matches(sentence, '{_re(P.NON_CLAIM)}')
AND NOT regexp_matches(sentence, '{_re(P.NEGATED_IMPROVEMENT)}') AND NOT regexp_matches(sentence, '{_re(P.BOUNDED_IMPROVEMENT)}') GROUP BY 1, 2""",
    "scope_requirements": f"""WITH base_papers AS (SELECT paper_id AS doc_id, max(analysis_text) AS text FROM prepared_papers GROUP BY 1), {_TOLD5}, {LINES}, s AS ({_loose('lines')}),
g AS (SELECT DISTINCT doc_id, line, sentence FROM s WHERE regexp_matches(sentence, '{_re(P.GENERALIZED)}') AND NOT regexp_matches(sentence, '{_re(P.NON_ASSERTION)}') AND NOT regexp_matches(sentence, '{_re(P.NEGATED_SCOPE)}')),
r AS (SELECT doc_id, line, sentence, unnest(regexp_extract_all(sentence, '{_re(P.COUNTED_SCOPE)}', 2)) AS d, unnest(regexp_extract_all(sentence, '{_re(P.COUNTED_SCOPE)}', 1))::DOUBLE AS need FROM g
  UNION ALL SELECT doc_id, line, sentence, unnest(regexp_extract_all(sentence, '{_re(P.QUALIFIED_SCOPE)}', 2)), CASE WHEN lower(unnest(regexp_extract_all(sentence, '{_re(P.QUALIFIED_SCOPE)}', 1))) IN ('all', 'every') THEN 1e300 ELSE 2.0 END FROM g
  UNION ALL SELECT doc_id, line, sentence, unnest(regexp_extract_all(sentence, '{_re(P.BARE_SCOPE)}', 1)), 2.0 FROM g),
k AS (SELECT doc_id, line, sentence, CASE WHEN regexp_matches(lower(d), '^(benchmark|dataset|task|domain)') THEN 'benchmark_count' WHEN lower(d) LIKE 'metric%' THEN 'metric_count' WHEN lower(d) LIKE 'seed%' THEN 'seed_count'
  WHEN regexp_matches(lower(d), '^(run|trial)') THEN 'trial_count' ELSE 'gpu_type_count' END AS dimension, need FROM r),
f AS (SELECT doc_id, line, sentence, CASE WHEN regexp_matches(sentence, '(?i)\\b(?:generaliz(?:e[sd]?|able|ation)|broadly\\s+(?:applicable|effective)|universal(?:ly)?)\\b') THEN 'benchmark_count' WHEN regexp_matches(sentence, '(?i)\\bconsistently\\s+(?:outperform|improv|perform)') THEN 'seed_count' END AS dimension, 2.0 AS need
  FROM g WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = g.doc_id AND k.line = g.line AND k.sentence = g.sentence))
SELECT DISTINCT doc_id, dimension, CASE WHEN max(need) > 1e9 THEN -1.0 ELSE max(need) END AS required FROM (SELECT * FROM k UNION ALL SELECT * FROM f WHERE dimension IS NOT NULL) GROUP BY doc_id, line, sentence, dimension""",
    "citations_distinct": f"{BASE}, {_CITES} SELECT doc_id, provider, count(*) AS n, min(line) AS first_line FROM cited GROUP BY 1, 2",
    "citation_status": f"""{BASE}, {_CITES}, known AS (SELECT cite_key, arg_max(cite_status, (cite_status, coalesce(cite_title, ''))) AS status FROM citation_registry GROUP BY 1)
SELECT doc_id, coalesce(status, 'unavailable') AS status, count(*) AS n FROM cited LEFT JOIN known ON identifier = cite_key GROUP BY 1, 2""",
    "section_groups": f"{PLACED}, g AS (SELECT unnest([{', '.join(repr(n) for n in P.CORE_SECTIONS)}]) AS section_group, unnest([{', '.join(chr(39) + _letters(p) + chr(39) for p in P.CORE_SECTIONS.values())}]) AS pattern) SELECT doc_id, section_group, bool_or(regexp_matches(title, pattern)) AS present FROM sections, g GROUP BY 1, 2",
    "page_counts": f"{BASE}, t AS (SELECT doc_id, line, regexp_extract(text, '{_re(P.PAGE_COUNT)}', 1) AS n FROM lines) SELECT doc_id, arg_min(n::INTEGER, line) AS page_count, count(*) AS declarations, count(DISTINCT n) > 1 AS conflicting FROM t WHERE n != '' GROUP BY 1",
    "checkboxes": f"""{PLACED} SELECT doc_id, regexp_extract(text, '{_re(P.ANY_CHECKBOX)}', 1) AS marker, regexp_extract(text, '{_re(P.ANY_CHECKBOX)}', 1) IN (' ', 'x', 'X') AS valid, coalesce(regexp_matches(title, '{P.SELF_REVIEW_TITLE}'), false) AS in_self_review, count(*) AS n
FROM placed WHERE regexp_matches(text, '{_re(P.ANY_CHECKBOX)}') GROUP BY 1, 2, 3, 4""",
    "self_review_items": f"""{PLACED} SELECT doc_id, lower(CASE WHEN regexp_matches(text, '{_re(P.LEADING_CHECKBOX)}') THEN regexp_extract(text, '{_re(P.LEADING_CHECKBOX)}', 1) ELSE regexp_extract(text, '{_re(P.TRAILING_CHECKBOX)}', 2) END) = 'x' AS checked, count(*) AS n, min(line) AS first_line
FROM placed WHERE regexp_matches(title, '{P.SELF_REVIEW_TITLE}') AND (regexp_matches(text, '{_re(P.LEADING_CHECKBOX)}') OR regexp_matches(text, '{_re(P.TRAILING_CHECKBOX)}')) GROUP BY 1, 2""",
    "broken_references": f"""WITH base_papers AS (SELECT paper_id AS doc_id, max(analysis_text) AS text FROM prepared_papers GROUP BY 1),
papers AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'See Figure ?? and [?].' || chr(10) || 'See \\ref{{tab:main}}.' || chr(10) ELSE text END AS text FROM base_papers), {LINES},
k AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(text, '{_re(p)}') THEN '{k}'" for k, p in P.BROKEN_REFERENCES)} END AS kind FROM lines) SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""",
    "artifacts": f"""{BASE}, a AS (SELECT doc_id, line, regexp_extract(text, '\\bAUTHORERR\\b|\\\\author\\s*\\{{\\s*\\}}|(?:^|[^\\w-])((?:TODO|FIXME|TBD|PLACEHOLDER))(?:$|[^\\w-])|(?i:\\[citation needed\\])|(?i:\\blorem ipsum\\b)', 0) AS s FROM lines)
SELECT doc_id, line, coalesce(nullif(regexp_extract(s, '(TODO|FIXME|TBD|PLACEHOLDER)', 1), ''), regexp_replace(s, '\\s+', ' ', 'g')) AS snippet FROM a WHERE s != ''""",
    "unanswered_checklist": f"WITH {PAPERS}, c AS (SELECT unnest([{', '.join(repr(n) for n in P.RIGOR_CHECKLIST)}]) AS item, unnest([{', '.join(chr(39) + _re(p) + chr(39) for p in P.RIGOR_CHECKLIST.values())}]) AS pattern) SELECT doc_id, item FROM papers, c WHERE text IS NOT NULL AND NOT regexp_matches(text, pattern)",
    "topic_terms": f"""{PLACED}, titles AS (SELECT doc_id, arg_min(title, (level, heading_line)) AS title FROM sections WHERE heading_line IS NOT NULL GROUP BY 1),
tt AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(title), '{P.TOPIC_WORD}'), lambda w: w NOT IN ({_STOP}))) AS term, unnest(range(0, len(list_filter(regexp_extract_all(lower(title), '{P.TOPIC_WORD}'), lambda w: w NOT IN ({_STOP}))))) AS n FROM titles),
ab AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{P.TOPIC_WORD}'), lambda w: w NOT IN ({_STOP}))) AS term FROM placed WHERE contains(lower(title), 'abstract')),
u AS (SELECT doc_id, term, 0 AS part, min(n)::BIGINT AS n FROM tt GROUP BY 1, 2 UNION ALL SELECT doc_id, term, 1, -count(*) FROM ab GROUP BY 1, 2),
b AS (SELECT doc_id, term, min((part, n)) AS k FROM u GROUP BY 1, 2), r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, term) AS INTEGER) AS rank, term FROM b) SELECT * FROM r WHERE rank <= 8""",
    "similar_titles": f"""WITH t AS (SELECT cite_key AS id, max(cite_title) AS t FROM citation_registry WHERE cite_title IS NOT NULL GROUP BY 1), w AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(t), '{P.TOPIC_WORD}'), lambda x: x NOT IN ({_STOP}))) AS ws FROM t),
e AS (SELECT id, len(ws) AS n, unnest(ws) AS x FROM w), p AS (SELECT a.id AS l, b.id AS r, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b USING (x) GROUP BY ALL),
s AS (SELECT l, r, round(c / (na + nb - c), 4) AS sim FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY sim DESC, r) AS rank FROM s WHERE sim >= 0.1) SELECT l AS left_id, r AS right_id, sim AS similarity FROM k WHERE rank <= 4 AND l != r""",
    "leading_boilerplate": f"""WITH base_papers AS (SELECT paper_id AS doc_id, max(analysis_text) AS text FROM prepared_papers GROUP BY 1),
papers AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Copyright 2024 The Authors' || chr(10) || '(c) 2024' || chr(10) || chr(10) || text ELSE text || chr(10) || 'Copyright 2024' || chr(10) END AS text FROM base_papers), {LINES},
f AS (SELECT doc_id, line, regexp_matches(text, '{_re(P.BOILERPLATE)}') AS plate, (regexp_matches(text, '^\\s*#') OR length(trim(text)) > 40) AS begun FROM lines),
b AS (SELECT *, coalesce(bool_or(begun AND NOT plate) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM f) SELECT doc_id, line FROM b WHERE plate AND NOT before""",
    "concealed_spans": """WITH s AS (SELECT (l_partkey * 7919) % 16777216 AS color, (l_suppkey * 37) % 256 AS alpha, l_quantity / 10 AS size, l_orderkey % 32 AS flags, l_partkey % 256 AS bg FROM lineitem),
c AS (SELECT *, (color >> 16) & 255 AS r, (color >> 8) & 255 AS g, color & 255 AS b FROM s),
l AS (SELECT *, 0.2126 * (CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END) + 0.7152 * (CASE WHEN g / 255.0 <= 0.04045 THEN g / 255.0 / 12.92 ELSE pow((g / 255.0 + 0.055) / 1.055, 2.4) END)
  + 0.0722 * (CASE WHEN b / 255.0 <= 0.04045 THEN b / 255.0 / 12.92 ELSE pow((b / 255.0 + 0.055) / 1.055, 2.4) END) AS fl, 0.9278 + 0.0722 * (CASE WHEN bg / 255.0 <= 0.04045 THEN bg / 255.0 / 12.92 ELSE pow((bg / 255.0 + 0.055) / 1.055, 2.4) END) AS bl FROM c),
x AS (SELECT *, (greatest(fl, bl) + 0.05) / (least(fl, bl) + 0.05) AS ratio FROM l)
SELECT array_to_string(list_filter([CASE WHEN alpha <= 32 THEN 'transparent' END, CASE WHEN ratio < 1.4 THEN 'low-contrast' END, CASE WHEN size < 0.75 THEN 'sub-pixel' END, CASE WHEN flags & 24 = 0 THEN 'non-rendering' END], lambda z: z IS NOT NULL), ',') AS reasons, count(*) AS n, round(avg(ratio), 4) AS contrast FROM x GROUP BY 1""",
    "page_backgrounds": "SELECT l_orderkey % 50 AS page, floor(median(l_partkey % 256))::INTEGER AS bg_r, floor(median(l_suppkey % 256))::INTEGER AS bg_g, floor(median(l_quantity::INTEGER))::INTEGER AS bg_b FROM lineitem GROUP BY 1",
    "panel_scores": f"WITH {PANEL} SELECT dimension, value, count(*) AS n FROM scores GROUP BY 1, 2",
    "panel_medians": f"WITH {PANEL} SELECT doc_id, dimension, quantile_disc(value, 0.5)::INTEGER AS value FROM scores GROUP BY 1, 2",
    "panel_choice": f"""WITH {PANEL}, o AS (SELECT * FROM scores WHERE dimension = 'Overall recommendation'), m AS (SELECT doc_id, quantile_disc(value, 0.5) AS middle FROM o GROUP BY 1)
SELECT doc_id, arg_min(role, (abs(value - middle), role)) AS role FROM o JOIN m USING (doc_id) GROUP BY 1""",
    "capped_scores": f"WITH {PANEL} SELECT dimension, sum(CASE WHEN doc_id % 3 > 0 AND dimension IN ('Soundness', 'Overall recommendation') THEN least(value, 2) ELSE value END)::BIGINT AS total FROM scores GROUP BY 1",
    "detection_scores": """WITH gold AS (SELECT o_orderkey AS paper, o_custkey % 7 + 1 AS line FROM orders),
f AS (SELECT DISTINCT l_orderkey AS paper, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER) AS finding, l_returnflag AS chk, l_linenumber AS line FROM lineitem),
m AS (SELECT g.paper, g.line AS gl, f.finding, f.line FROM gold g JOIN f USING (paper) WHERE chk IN ('R', 'A'))
SELECT (SELECT count(*) FROM gold) AS expected, (SELECT count(DISTINCT paper) FROM m) AS identified, (SELECT count(DISTINCT paper) FROM m WHERE line = gl) AS localized, (SELECT count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.paper = f.paper AND m.finding = f.finding AND m.line = m.gl)) AS false_positives""",
    "manifest_errors": """WITH r AS (SELECT *, count(*) OVER (PARTITION BY cite_key) AS times FROM citation_registry),
e AS (SELECT unnest(list_filter([CASE WHEN trim(coalesce(cite_key, '')) = '' THEN 'arxiv_id is missing' END, CASE WHEN trim(coalesce(cite_title, '')) = '' THEN 'title is missing' END, CASE WHEN trim(coalesce(provider, '')) = '' THEN 'category is missing' END,
  CASE WHEN trim(coalesce(cite_url, '')) = '' THEN 'pdf_url is missing' END, CASE WHEN times > 1 THEN 'arxiv_id is repeated' END], lambda z: z IS NOT NULL)) AS error FROM r) SELECT error, count(*) AS n FROM e GROUP BY 1""",
    "twin_scores": f"""WITH {PANEL}, m AS (SELECT doc_id, dimension, quantile_disc(value, 0.5) AS value FROM scores GROUP BY 1, 2), d AS (SELECT doc_id, string_agg(dimension || value::VARCHAR, ',' ORDER BY dimension) AS d FROM m GROUP BY 1),
t AS (SELECT o_orderkey AS attack, o_orderkey - 1 AS clean FROM orders) SELECT (a.d IS NOT DISTINCT FROM b.d) AS equal, count(*) AS n FROM t LEFT JOIN d a ON a.doc_id = attack LEFT JOIN d b ON b.doc_id = clean GROUP BY 1""",
    "stream_deliveries": "SELECT ledger_path, count(*) AS lines FROM (SELECT DISTINCT ledger_path, line_no, raw_line FROM ledger_lines) GROUP BY 1",
}

# problem 2: the grammar of RFC 4180 as one pattern for each separator, JSON by the types of its members
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _cells(sep: str) -> str:
    """Fields of a line, unquoted, without spaces around."""
    field = _FIELD.replace(",", sep)
    bare = "CASE WHEN starts_with(c, '\"') THEN replace(substr(c, 2, length(c) - 2), '\"\"', '\"') ELSE c END"
    return f"list_transform(regexp_extract_all(raw || '{sep}', '(?s)({field}){sep}', 1), lambda c: trim({bare}))"


def _line(sep: str) -> str:
    field = _FIELD.replace(",", sep)
    return f"regexp_full_match(raw, '(?s){field}(?:{sep}{field})*')"


_TAB = "\t"
_KIND = "json_type(j, '$.{0}')"
P2 = f"""l AS (SELECT line_id, ledger_path, line_no, raw_line AS raw, CASE WHEN lower(ledger_path) LIKE '%.csv' THEN 'c' WHEN lower(ledger_path) LIKE '%.tsv' THEN 't' ELSE 'j' END AS k FROM ledger_lines),
d AS (SELECT *, coalesce(CASE k WHEN 'c' THEN {_line(",")} ELSE {_line(_TAB)} END, false) AS ok FROM l WHERE k != 'j'),
f AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN k = 'c' THEN {_cells(",")} ELSE {_cells(_TAB)} END AS cells FROM d),
h AS (SELECT ledger_path, arg_min(struct_pack(c := cells), line_id).c AS names FROM f WHERE line_no = 1 GROUP BY 1),
b AS (SELECT f.line_id, f.ok, f.cells, h.names FROM f LEFT JOIN h USING (ledger_path) WHERE f.line_no IS DISTINCT FROM 1),
c AS (SELECT line_id, CASE WHEN NOT ok THEN 'syntax' WHEN names IS NULL OR len(cells) != len(names) OR NOT list_has_all(names, ['trial', 'status', 'accuracy']) THEN 'columns' END AS gate,
  cells[list_position(names, 'trial')] AS trial, cells[list_position(names, 'status')] AS status, cells[list_position(names, 'accuracy')] AS accuracy, true AS tt, true AS st, CASE WHEN cells[list_position(names, 'accuracy')] = '' THEN 'NULL' ELSE 'TEXT' END AS vt FROM b),
g AS (SELECT line_id, raw, raw IS NOT NULL AND json_valid(raw) AND NOT regexp_matches(raw, ',\\s*[}}\\]]') AS ok FROM l WHERE k = 'j'),
v AS (SELECT line_id, ok, CASE WHEN ok THEN raw ELSE 'null' END::JSON AS j FROM g),
w AS (SELECT line_id, CASE WHEN NOT ok THEN 'syntax' WHEN json_type(j) != 'OBJECT' OR {_KIND.format("trial")} IS NULL OR {_KIND.format("status")} IS NULL OR coalesce({_KIND.format("accuracy")}, {_KIND.format("metrics.accuracy")}) IS NULL THEN 'columns' END AS gate,
  json_extract_string(j, '$.trial') AS trial, json_extract_string(j, '$.status') AS status, CASE WHEN {_KIND.format("accuracy")} IS NOT NULL THEN json_extract_string(j, '$.accuracy') ELSE json_extract_string(j, '$.metrics.accuracy') END AS accuracy,
  {_KIND.format("trial")} = 'VARCHAR' AS tt, {_KIND.format("status")} = 'VARCHAR' AS st, coalesce({_KIND.format("accuracy")}, {_KIND.format("metrics.accuracy")}) AS vt FROM v),
a AS (SELECT *, CASE WHEN vt = 'NULL' THEN true WHEN vt IN ('TEXT', 'UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN regexp_full_match(accuracy, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND TRY_CAST(accuracy AS DOUBLE) BETWEEN 0 AND 100 ELSE false END AS fit FROM (SELECT * FROM c UNION ALL SELECT * FROM w)),
r AS (SELECT *, coalesce(gate, CASE WHEN NOT coalesce(tt AND trim(trial) != '' AND st AND lower(status) IN ('keep', 'discard', 'crash') AND fit, false) THEN 'value' END) AS reason FROM a)"""
ORACLES |= {
    "p2_found": f"WITH {P2} SELECT DISTINCT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p2_experiments": f"WITH {P2} SELECT DISTINCT line_id, trim(trial) AS trial, lower(status) AS status, TRY_CAST(accuracy AS DOUBLE) AS accuracy FROM r WHERE reason IS NULL",
    "variance_unaddressed": f"{BASE}, {TABLES} SELECT DISTINCT doc_id FROM tables WHERE doc_id NOT IN (SELECT doc_id FROM papers WHERE regexp_matches(text, '{_re(P.VARIANCE)}'))",
    "diverse_sample": "WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents WHERE lang IS NOT NULL), k AS (SELECT lang FROM d ORDER BY turn, lang LIMIT 110) SELECT lang AS category, count(*) AS n FROM k GROUP BY 1",
    "title_agreement": """WITH t AS (SELECT DISTINCT cite_key, lower(cite_title) AS t FROM citation_registry WHERE cite_title IS NOT NULL), s AS (SELECT cite_key, t, string_split(t, ' ') AS ws FROM t),
w AS (SELECT cite_key, list_distinct(list_filter(regexp_split_to_array(t, '[^\\pL\\pN_]+'), lambda x: x != '')) AS a, list_distinct(list_filter(regexp_split_to_array(array_to_string(ws[1:greatest(len(ws) - 1, 1)], ' '), '[^\\pL\\pN_]+'), lambda x: x != '')) AS b FROM s)
SELECT len(a) > 0 AS "whole", len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / greatest(len(a), len(b)) >= 0.9 AS short, count(*) AS n FROM w GROUP BY 1, 2""",
    "broken_promises": f"""{BASE}, e AS (SELECT *, coalesce(max(regexp_matches(text, '{_re(P.REFERENCES_HEADING)}')::INT) OVER (PARTITION BY doc_id ORDER BY line), 0) AS ended FROM lines), b AS (SELECT doc_id, line, text FROM e WHERE ended = 0),
q AS (SELECT doc_id, line, regexp_extract(text, '{_re(P.PROMISE)}', 0) AS marker, list_filter(regexp_extract_all(lower(text), '[a-z][a-z-]{{4,}}'), lambda w: w NOT IN ({"'" + "', '".join(P.PROMISE_STOPWORDS) + "'"})) AS ws FROM b WHERE regexp_matches(text, '{_re(P.PROMISE)}')),
p AS (SELECT doc_id, line, marker, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS tokens FROM q), o AS (SELECT * FROM p WHERE len(tokens) >= 2
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = p.doc_id AND b.line > p.line AND len(list_filter(p.tokens, lambda w: contains(lower(b.text), w))) > 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM o) SELECT doc_id, line, marker, array_to_string(tokens[1:8], ' ') AS tokens FROM n WHERE n <= 3""",
    "table_emphasis": f"""{BASE}, m AS (SELECT doc_id, line, text, replace(replace(text, '| ', '| **'), '**', '') AS t FROM lines WHERE starts_with(text, '|')),
e AS (SELECT doc_id, line, text, {"regexp_replace(" * 6}t{", '_([^_" + chr(92) + "n]+?)_', '" + chr(92) + "1', 'g')" }"""
    + ", '_([^_\\n]+?)_', '\\1', 'g')" * 5
    + """ AS t FROM m) SELECT doc_id, line, sha256(CASE WHEN regexp_matches(text, '^\\s*\\|.*\\|\\s*$') THEN t ELSE replace(text, '| ', '| **') END) AS sha256 FROM e""",
    "extraction_cleanup": f"""WITH r AS (SELECT conversion_id, '<!-- Start of picture text --> 12 3 4 <!-- End of picture text -->' || chr(10) || 'Copy 28 _._ 4 and 1 **/** 4' || chr(10) || max(markdown) AS m FROM pdf_conversions GROUP BY 1),
b AS (SELECT conversion_id, m, regexp_replace(m, '{_re(P.PICTURE_TEXT)}', '', 'g') AS bare FROM r),
t AS (SELECT conversion_id, CASE WHEN length(regexp_replace(bare, '^\\s+|\\s+$', '', 'g')) < 200 THEN m ELSE trim(regexp_replace(regexp_replace(bare, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) || chr(10) END AS t FROM b),
x AS (SELECT conversion_id, regexp_replace(t, '(\\d)\\s*[_*]+\\s*([.,/·])\\s*[_*]+\\s*(\\d)', '\\1\\2\\3', 'g') AS f FROM t) SELECT conversion_id, length(f)::INTEGER AS chars, contains(f, '28.4') AS decimal, contains(f, 'picture text') AS picture FROM x""",
}

_CITED = " + ".join(f"len(regexp_extract_all(text, '{_re(p)}'))" for p in (P.NUMERIC_CITE, P.AUTHOR_YEAR, P.ARXIV, P.BRACKET_ARXIV, P.DOI, P.S2_URL, P.CORPUS_ID, P.REGISTRY_MARK))
POSITIONING = f"""cc AS (SELECT doc_id, sum({_CITED})::BIGINT AS citation_count FROM placed GROUP BY 1),
rw AS (SELECT DISTINCT p.doc_id FROM placed p JOIN sections s ON p.doc_id = s.doc_id AND p.section = s.section WHERE regexp_matches(s.title, '{_re(P.RELATED_WORK_TITLE)}') AND (s.heading_line IS NULL OR p.line > s.heading_line) AND regexp_matches(p.text, '[^\\s#>*_\\-\\[\\]()]')),
se AS (SELECT doc_id, unnest(regexp_extract_all(text, '{P.LOOSE_SENTENCE}')) AS s FROM placed WHERE NOT regexp_matches(text, '^\\s*[|#]') AND regexp_matches(text, '\\S')),
li AS (SELECT doc_id, regexp_matches(s, '{_re(P.NOVELTY)}') OR regexp_matches(s, '{_re(P.SUPERIORITY)}') AS firm, regexp_matches(s, '{_re(P.LOOSE_SUPERIORITY)}') AND NOT regexp_matches(s, '{_re(P.COMPARATOR)}') AS loose FROM se
  WHERE NOT regexp_matches(s, '{_re(P.NEGATED_CLAIM)}') AND NOT regexp_matches(s, '{_re(P.HYPOTHETICAL_CLAIM)}')),
cl AS (SELECT doc_id, count_if(firm) AS claims, count_if(NOT firm AND loose) AS loose FROM li GROUP BY 1),
po AS (SELECT doc_id, rw.doc_id IS NOT NULL AS has_related_work, citation_count, rw.doc_id IS NOT NULL OR citation_count > 0 AS positioned, coalesce(claims, 0) AS claims, coalesce(loose, 0) AS loose FROM cc LEFT JOIN rw USING (doc_id) LEFT JOIN cl USING (doc_id))"""
_TOLD4 = """base_papers AS (SELECT paper_id AS doc_id, max(analysis_text) AS text FROM prepared_papers GROUP BY 1),
papers AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(text, '\\[[^\\]\n]*\\]|(?i:related work)', '', 'g') || chr(10) || 'We are the first to try this.' || chr(10) ELSE text END AS text FROM base_papers)"""
_SPOKEN = "'_' || regexp_replace(regexp_replace(lower({0}), '[^\\pL\\pN]+', '_', 'g'), '^_+|_+$', '', 'g') || '_'"
ORACLES |= {
    "positioning": f"{PLACED}, {POSITIONING} SELECT * FROM po",
    "unpositioned": f"WITH {_TOLD4}, {LINES}, {HEADS}, {SECTIONS}, {POSITIONING} SELECT doc_id FROM po WHERE claims > 0 AND NOT positioned",
    "omitted_failures": f"""WITH {PAPERS}, {LINES}, {LEDGER}, s AS (SELECT doc_id, path, line, lower(trim({_STR.format("status")})) AS status,
  coalesce({", ".join("nullif(trim(" + _STR.format(f) + "), '')" for f in P.IDENTITY_FIELDS)}) AS identity FROM good),
f AS (SELECT *, {_SPOKEN.format("identity")} AS name FROM s WHERE status IN ({"'" + "', '".join(P.NEGATIVE_STATUSES) + "'"}) AND identity IS NOT NULL),
t AS (SELECT doc_id, {_SPOKEN.format("text")} AS told, regexp_matches(text, '{_re(P.NEGATIVE_LANGUAGE)}') AS bad FROM lines WHERE regexp_matches(text, '\\S')),
m AS (SELECT f.doc_id, f.path, f.line, f.status, count(t.told) AS mentions, coalesce(bool_or(t.bad), false) AS disclosed FROM f LEFT JOIN t ON f.doc_id = t.doc_id AND contains(t.told, f.name) WHERE f.name != '__' GROUP BY ALL)
SELECT doc_id, status, count(*) AS n, count_if(mentions > 0) AS mentioned, count_if(disclosed) AS disclosed FROM m GROUP BY 1, 2""",
}
