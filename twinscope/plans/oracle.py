"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from twinscope.functions.sketches import BANDS, HASHES, coefficients
from twinscope.operators.evaluate import DEFAULT_THRESHOLDS, ESCALATED
from twinscope.operators.report import INTRO, SHOWN

#: doc_id, shingle: distinct runs of three words.
SHINGLES = r"""
words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n\t\r]+'), lambda x: x <> '') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS shingle FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words WHERE len(ws) >= 3))
""".strip()
#: Classes of equal sets and the pairs of their representatives.
SETS = (
    SHINGLES
    + """,
sets AS (SELECT d.doc_id, coalesce(md5(string_agg(shingle, chr(10) ORDER BY shingle)), '') AS set_key, count(shingle) AS n FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
reps AS (SELECT set_key, min(doc_id) AS rep, count(*) AS members, any_value(n) AS n FROM sets GROUP BY set_key),
items AS (SELECT rep, n, members, shingle FROM reps JOIN shingles ON doc_id = rep),
shared AS (SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, count(*) AS shared, any_value(x.members) AS members_a, any_value(y.members) AS members_b
  FROM items x JOIN items y ON x.shingle = y.shingle AND x.rep < y.rep GROUP BY 1, 2),
pairs AS (SELECT *, shared / (n_a + n_b - shared) AS jaccard, shared / sqrt(n_a * n_b) AS cosine, shared / least(n_a, n_b) AS overlap, 2 * shared / (n_a + n_b) AS dice FROM shared
  WHERE shared / (n_a + n_b - shared) >= {threshold})
"""
).strip()
PAIRS = SETS.replace("{threshold}", "0.4")
#: The same without a threshold: all pairs that share a shingle.
ALL_PAIRS = SETS.replace("{threshold}", "0")


def components(edges: str, prefix: str = "") -> str:
    """{prefix}labels: node, family of the edges (a, b) of a relation."""
    return f"""
{prefix}ends AS (SELECT a AS u, b AS v FROM {edges} UNION SELECT b, a FROM {edges}),
{prefix}walk AS (SELECT u AS node, u AS family FROM {prefix}ends UNION SELECT w.node, e.v FROM {prefix}walk w JOIN {prefix}ends e ON w.family = e.u),
{prefix}labels AS (SELECT node, min(family) AS family FROM {prefix}walk GROUP BY node)"""


def families_of(sets: str, edges: str, prefix: str = "") -> str:
    """{prefix}named: rep, family of all sets with a twin or a copy, by the edges (a, b) of a relation."""
    return f"""{sets}, {components(edges, prefix)},
{prefix}named AS (SELECT rep, coalesce(family, rep) AS family FROM reps LEFT JOIN {prefix}labels ON node = rep WHERE members > 1 OR family IS NOT NULL)"""


FAMILIES = families_of(PAIRS, "pairs") + ", families AS (SELECT doc_id, family FROM sets JOIN reps USING (set_key) JOIN named USING (rep))"

COEFFICIENTS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(coefficients()))
SIGNATURES = (
    SHINGLES
    + f""",
coefficients(slot, a, b) AS (VALUES {COEFFICIENTS}),
hashed AS (SELECT doc_id, ('0x' || substr(md5(shingle), 1, 8))::BIGINT AS h FROM shingles),
slots AS (SELECT doc_id, slot, min((a::UBIGINT * h::UBIGINT + b::UBIGINT) % 4294967296::UBIGINT)::BIGINT AS m FROM hashed, coefficients GROUP BY doc_id, slot),
signatures AS (SELECT doc_id, list(m ORDER BY slot) AS signature FROM slots GROUP BY doc_id
  UNION ALL SELECT doc_id, list_transform(range({HASHES}), lambda x: 4294967295) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM shingles))"""
)
ROWS = HASHES // BANDS
LSH = (
    PAIRS
    + SIGNATURES.removeprefix(SHINGLES)
    + f""",
signed AS (SELECT rep, signature FROM reps JOIN signatures ON doc_id = rep),
banded AS (SELECT rep, k || '-' || array_to_string(signature[k * {ROWS} + 1 : k * {ROWS} + {ROWS}], '-') AS band FROM (SELECT rep, signature, unnest(range(0, {BANDS})) AS k FROM signed)),
candidates AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM banded x JOIN banded y ON x.band = y.band AND x.rep < y.rep)"""
)


def both_signatures() -> str:
    return PAIRS + SIGNATURES.removeprefix(SHINGLES)


NATIONS = """
sold AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
best AS (SELECT src, arg_max(dst, quantity * 1000 + dst) AS dst FROM sold GROUP BY src)
""".strip()
TAGS = "tags AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS family, url, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) AS tags FROM pages)"
_HIGH, _LOW = "('0x' || substr(md5(shingle), 1, 8))::BIGINT", "('0x' || substr(md5(shingle), 9, 8))::BIGINT"
#: 64-bit fingerprints in two halves.
PRINTS = f""",
halves AS (SELECT doc_id, {_LOW} AS low, {_HIGH} AS high FROM shingles),
votes AS (SELECT doc_id, k, sum(CASE WHEN ((CASE WHEN k < 32 THEN low ELSE high END) >> (k % 32)) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS bit FROM halves, range(0, 64) r(k) GROUP BY doc_id, k),
prints AS (SELECT doc_id, sum(CASE WHEN bit AND k < 32 THEN 1::BIGINT << k ELSE 0 END)::BIGINT AS lo, sum(CASE WHEN bit AND k >= 32 THEN 1::BIGINT << (k - 32) ELSE 0 END)::BIGINT AS hi FROM votes GROUP BY doc_id)"""
#: All pairs of different sets that aren't empty, by every metric, whether they share a shingle or not.
EVERY_PAIR = (
    ALL_PAIRS
    + PRINTS
    + """,
printed AS (SELECT rep, members, lo, hi FROM reps JOIN prints ON doc_id = rep),
apart AS (SELECT x.rep AS a, y.rep AS b, x.members AS members_a, y.members AS members_b, (bit_count(xor(x.lo, y.lo)) + bit_count(xor(x.hi, y.hi)))::BIGINT AS hamming FROM printed x JOIN printed y ON x.rep < y.rep),
every_pair AS (SELECT a.*, coalesce(jaccard, 0) AS jaccard, coalesce(cosine, 0) AS cosine, coalesce(overlap, 0) AS overlap, coalesce(dice, 0) AS dice, 1 - hamming / 64 AS simhash
  FROM apart a LEFT JOIN pairs p ON p.a = a.a AND p.b = a.b)"""
)
#: The least similar pair of distinct sets of each family; a family that is one set's copies has that set alone.
FLOORS = (
    families_of(EVERY_PAIR, "(SELECT * FROM pairs WHERE jaccard >= 0.4)")
    + ", limits(metric, threshold) AS (VALUES "
    + ", ".join(f"('{m}', {t}::DOUBLE)" for m, t in DEFAULT_THRESHOLDS.items())
    + """),
within AS (SELECT x.family, x.rep AS a, y.rep AS b FROM named x JOIN named y ON x.family = y.family AND x.rep < y.rep),
measured AS (SELECT w.family, jaccard, cosine, overlap, dice, simhash FROM within w JOIN every_pair p ON p.a = w.a AND p.b = w.b
  UNION ALL SELECT family, 1, 1, 1, 1, 1 FROM named GROUP BY family HAVING count(*) = 1),
valued AS (SELECT family, metric, threshold, CASE metric WHEN 'jaccard' THEN jaccard WHEN 'cosine' THEN cosine WHEN 'overlap' THEN overlap WHEN 'dice' THEN dice ELSE simhash END AS value FROM measured, limits),
floors AS (SELECT family, metric, min(value) AS floor, min(value) - any_value(threshold) AS margin FROM valued GROUP BY family, metric)"""
)
#: found, n_true and matched of each case. A finding is one line and truth entries don't touch, so a truth entry that has findings is matched once.
CASES = """
found AS (SELECT doc_id AS case_id, k AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k FROM documents) WHERE ls[k] LIKE '%!!%' OR ls[k] LIKE '%|%'),
true_at AS (SELECT doc_id AS case_id, unnest([1, 4]) AS first_line FROM labels JOIN documents USING (doc_id) WHERE quality = 0),
hit AS (SELECT case_id, count(DISTINCT first_line) AS matched FROM found JOIN true_at USING (case_id) WHERE line BETWEEN first_line AND first_line + 2 GROUP BY case_id),
counted AS (SELECT case_id, coalesce(f.n, 0) AS found, coalesce(t.n, 0) AS n_true, coalesce(matched, 0) AS matched
  FROM (SELECT case_id, count(*) AS n FROM found GROUP BY case_id) f FULL JOIN (SELECT case_id, count(*) AS n FROM true_at GROUP BY case_id) t USING (case_id) LEFT JOIN hit USING (case_id))
""".strip()
#: Of each metric and pair of classes its value, the pairs of documents it stands for and those of one language; copies have no a and b.
VALUES = (
    EVERY_PAIR
    + """,
tongues AS (SELECT rep, lang, count(*) AS m FROM sets JOIN reps USING (set_key) JOIN documents USING (doc_id) GROUP BY rep, lang),
one_language AS (SELECT x.rep AS a, y.rep AS b, sum(x.m * y.m) AS positives FROM tongues x JOIN tongues y ON x.rep < y.rep AND x.lang IS NOT DISTINCT FROM y.lang GROUP BY 1, 2),
counted AS (SELECT e.*, members_a * members_b AS pairs, coalesce(positives, 0) AS positives FROM every_pair e LEFT JOIN one_language o ON o.a = e.a AND o.b = e.b WHERE {reached}
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 1, 1, 1, 1, 1, sum(m) * (sum(m) - 1) // 2, sum(m * (m - 1) // 2) FROM tongues GROUP BY rep HAVING sum(m) > 1),
limits(metric, threshold, escalated) AS (VALUES """
    + ", ".join(f"('{m}', {t}::DOUBLE, {ESCALATED[m]}::DOUBLE)" for m, t in DEFAULT_THRESHOLDS.items())
    + """),
rated AS (SELECT metric, threshold, escalated, a, b, round(CASE metric WHEN 'jaccard' THEN jaccard WHEN 'cosine' THEN cosine WHEN 'overlap' THEN overlap WHEN 'dice' THEN dice ELSE simhash END, 6) AS value,
  pairs::BIGINT AS pairs, positives::BIGINT AS positives FROM counted, limits)"""
)
VERDICTS = (
    VALUES.replace("{reached}", " OR ".join(f"{m} >= {t}" for m, t in ESCALATED.items()))
    + """,
verdicts AS (SELECT *, a || '-' || b AS case_id, CASE WHEN value >= threshold THEN 'flag' WHEN value >= escalated THEN 'escalate' ELSE 'ignore' END AS verdict FROM rated)"""
)
SIMHASHES = (
    PRINTS
    + """,
hamming AS (SELECT a, b, (bit_count(xor(x.lo, y.lo)) + bit_count(xor(x.hi, y.hi)))::BIGINT AS hamming FROM pairs JOIN prints x ON x.doc_id = a JOIN prints y ON y.doc_id = b)"""
)
_SORTING = "length(text) % 2 = 0"

ORACLE_SQL: dict[str, str] = {
    "shingle_counts": f"WITH {SHINGLES} SELECT d.doc_id, count(s.shingle) AS n_shingles FROM documents d LEFT JOIN shingles s ON d.doc_id = s.doc_id GROUP BY d.doc_id",
    "jaccard_pairs": f"WITH {PAIRS} SELECT a, b, n_a, n_b, shared, round(jaccard, 6) AS similarity, members_a, members_b FROM pairs",
    "shingle_classes": f"WITH {PAIRS} SELECT doc_id, rep, members FROM sets JOIN reps USING (set_key)",
    "pair_metrics": f"WITH {PAIRS}{SIMHASHES} SELECT a, b, round(jaccard, 6) AS jaccard, round(cosine, 6) AS cosine, round(overlap, 6) AS overlap, round(dice, 6) AS dice, round(1 - hamming / 64, 6) AS simhash FROM pairs JOIN hamming USING (a, b)",
    "pair_residual": f"WITH {PAIRS} SELECT a, b, n_a - shared AS only_a, n_b - shared AS only_b, shared FROM pairs",
    "minhash_signature": f"WITH {SIGNATURES} SELECT doc_id, array_to_string(signature, ',') AS signature FROM signatures",
    "minhash_estimate": f"WITH {both_signatures()} SELECT a, b, round(len(list_filter(list_zip(x.signature, y.signature), lambda z: z[1] = z[2])) / {HASHES}, 6) AS estimate FROM pairs JOIN signatures x ON x.doc_id = a JOIN signatures y ON y.doc_id = b",
    "lsh_candidates": f"WITH {LSH} SELECT a, b FROM candidates",
    "twin_pairs": f"""WITH {LSH}, sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
verified AS (SELECT c.a, c.b, any_value(p.n) AS n_a, any_value(q.n) AS n_b, count(*) AS shared FROM candidates c JOIN sized p ON p.doc_id = c.a JOIN sized q ON q.doc_id = c.b
  JOIN shingles x ON x.doc_id = c.a JOIN shingles y ON y.doc_id = c.b AND y.shingle = x.shingle GROUP BY 1, 2)
SELECT a, b, round(shared / (n_a + n_b - shared), 6) AS similarity FROM verified WHERE shared / (n_a + n_b - shared) >= 0.5""",
    "simhash_hamming": f"WITH {PAIRS}{SIMHASHES} SELECT a, b, hamming, round(1 - hamming / 64, 6) AS similarity FROM hamming",
    "twin_families": f"WITH RECURSIVE {FAMILIES} SELECT doc_id, family FROM families",
    "largest_family": f"WITH RECURSIVE {FAMILIES}, sizes AS (SELECT family, count(*) AS size FROM families GROUP BY family ORDER BY size DESC, family LIMIT 1) SELECT doc_id, family, size FROM families JOIN sizes USING (family)",
    "metric_families": "WITH RECURSIVE "
    + EVERY_PAIR
    + "".join(families_of("", f"(SELECT a, b FROM every_pair WHERE {m} >= {t})", f"{m}_") for m, t in DEFAULT_THRESHOLDS.items())
    + " "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, doc_id AS node, family FROM sets JOIN reps USING (set_key) JOIN {m}_named USING (rep)" for m in DEFAULT_THRESHOLDS),
    "family_consensus": f"""WITH {TAGS}, members AS (SELECT family, page_id AS unit_id, array_to_string(tags, '>') AS root_key, len(tags) AS n_nodes, url FROM tags),
groups AS (SELECT family, root_key, count(*) AS size, min(n_nodes) AS n_nodes, arg_min(unit_id, (url, unit_id)) AS first_unit, min((url, unit_id)) AS place FROM members GROUP BY family, root_key),
ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY size DESC, n_nodes, place) AS r FROM groups)
SELECT family, sum(size)::BIGINT AS n_units, count(*) AS n_groups, max(CASE WHEN r = 1 THEN first_unit END) AS consensus, max(CASE WHEN r = 2 THEN first_unit END) AS divergent FROM ranked GROUP BY family""",
    "label_divergence": """WITH lines AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
positions AS (SELECT source || '/' || len(ls) AS family, doc_id, k - 1 AS pre, ls[k] AS label FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM lines)),
counted AS (SELECT family, pre, label, count(*) AS n, min(doc_id) AS first_unit FROM positions GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY family, pre ORDER BY n DESC, first_unit) AS r, sum(n) OVER (PARTITION BY family, pre) AS members, count(*) OVER (PARTITION BY family, pre) AS n_labels FROM counted),
best AS (SELECT * FROM placed WHERE r = 1 AND n_labels > 1 AND n >= ceil(members / 2))
SELECT b.family, b.pre::INTEGER AS pre, b.label AS majority, b.n AS n_majority, arg_min(o.label, o.first_unit) AS outlier, min(o.first_unit) AS outlier_unit
FROM best b JOIN placed o ON o.family = b.family AND o.pre = b.pre AND o.label <> b.label GROUP BY 1, 2, 3, 4""",
    "tree_trigrams": f"WITH {TAGS} SELECT page_id, count(DISTINCT gram) AS n_trigrams FROM (SELECT page_id, tags[i] || '>' || tags[i + 1] || '>' || tags[i + 2] AS gram FROM (SELECT page_id, tags, unnest(range(1, len(tags) - 1)) AS i FROM tags WHERE len(tags) >= 3)) GROUP BY page_id",
    "tree_kinds": r"""WITH tags AS (SELECT page_id, html, unnest(['NAV', 'UL', 'LI', 'ARTICLE', 'H1', 'P', 'LINK', 'BR', 'FOOTER']) AS kind FROM pages),
told AS (SELECT page_id, kind, len(regexp_extract_all(html, CASE kind WHEN 'LINK' THEN ' href="' ELSE '<' || lower(kind) || '[ >]' END)) AS n FROM tags)
SELECT page_id, kind, n FROM told WHERE n > 0""",
    "nested_tags": r"""WITH parts AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS article FROM pages),
told AS (SELECT page_id, 'NAV' AS outer_kind, 'LINK' AS inner_kind, regexp_extract_all(nav, 'href="([^"]*)"', 1) AS found, true AS labelled FROM parts UNION ALL SELECT page_id, 'NAV', 'LI', regexp_extract_all(nav, '<li>'), false FROM parts
  UNION ALL SELECT page_id, 'ARTICLE', 'P', regexp_extract_all(article, '<p>'), false FROM parts UNION ALL SELECT page_id, 'ARTICLE', 'H1', regexp_extract_all(article, '<h1>'), false FROM parts
  UNION ALL SELECT page_id, 'LI', 'A', regexp_extract_all(nav, '<li><a '), false FROM parts)
SELECT page_id, outer_kind, inner_kind, len(found) AS n, CASE WHEN labelled THEN list_min(found) END AS first_label FROM told WHERE len(found) > 0""",
    "import_path_scan": r"""WITH lines AS (SELECT page_id, 2 AS start_line, url AS import_path FROM pages UNION ALL SELECT page_id, 3, regexp_replace(url, '[^A-Za-z0-9.]', '.', 'g') FROM pages),
marked AS (SELECT *, lower(regexp_extract(import_path, '(?i)(?:^|[/\\.])(blog|en|fr|example|v[0-9]+)(?:[/\\.]|$)', 1)) AS marker FROM lines)
SELECT page_id, min(start_line)::BIGINT AS start_line, import_path, marker FROM marked WHERE marker <> '' GROUP BY page_id, import_path, marker""",
    "sort_asymmetry": f"""WITH {SHINGLES}, sized AS (SELECT d.doc_id, lang, {_SORTING} AS sorts, count(s.shingle) AS n FROM documents d JOIN shingles s ON d.doc_id = s.doc_id GROUP BY ALL),
both_n AS (SELECT t.doc_id, o.doc_id AS other, any_value(o.sorts) AS other_sorts, any_value(t.n) AS n_a, any_value(o.n) AS n_b, count(*) AS shared FROM sized t JOIN shingles x ON x.doc_id = t.doc_id
  JOIN shingles y ON y.shingle = x.shingle JOIN sized o ON o.doc_id = y.doc_id WHERE t.sorts AND o.lang = t.lang AND o.doc_id <> t.doc_id GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_similar FROM both_n WHERE shared / (n_a + n_b - shared) >= 0.4 GROUP BY doc_id HAVING NOT bool_or(other_sorts)""",
    "sibling_pool": """WITH files AS (SELECT '/corpus/' || source || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS file, source, lang FROM documents),
near AS (SELECT t.file AS target, o.file, row_number() OVER (PARTITION BY t.file ORDER BY o.file) AS r FROM files t JOIN files o ON t.source = o.source AND t.lang = o.lang AND t.file <> o.file)
SELECT target, file FROM near WHERE r <= 20""",
    "basename_pool": """WITH files AS (SELECT '/corpus/' || source || CASE WHEN doc_id % 3 > 0 THEN '/deep' ELSE '' END || CASE WHEN doc_id % 3 > 1 THEN '/deeper' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN '/vendor' ELSE '' END
  || '/' || doc_id || '/' || (doc_id % 7) || '.txt' AS file, doc_id % 3 + (doc_id % 11 = 0)::INTEGER AS depth, doc_id % 11 = 0 AS skipped, source, doc_id % 7 AS name FROM documents),
near AS (SELECT t.file AS target, o.file, row_number() OVER (PARTITION BY t.file ORDER BY o.depth, o.file) AS r FROM files t JOIN files o ON t.source = o.source AND t.name = o.name AND t.file <> o.file AND NOT o.skipped)
SELECT target, file FROM near WHERE r <= 30""",
    "findings_topk": f"""WITH lines AS (SELECT source, doc_id, '- ' || source || ':' || doc_id || '-' || doc_id || ' [' || CASE WHEN text LIKE '%|%' THEN 'table, conf=0.50' WHEN text LIKE '%!!%' THEN 'compat-shim:shouting' ELSE lang END || ']: ' || n_chars || ' characters' AS line FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM lines)
SELECT '/corpus/' || source AS file, any_value(n) AS n_findings, chr(10) || '<twinscope>' || chr(10) || '{INTRO}' || chr(10) || string_agg(line, chr(10) ORDER BY r) || CASE WHEN any_value(n) > {SHOWN} THEN chr(10) || '  (... ' || (any_value(n) - {SHOWN}) || ' more findings)' ELSE '' END || chr(10) || '</twinscope>' AS warning
FROM ranked WHERE r <= {SHOWN} GROUP BY source""",
    "call_edges": f"WITH {NATIONS} SELECT src, dst FROM sold",
    "external_targets": f"WITH {NATIONS} SELECT src AS unit_id, n_name AS label FROM sold JOIN nation ON n_nationkey = dst WHERE n_regionkey = 0",
    "reachable": f"WITH RECURSIVE {NATIONS}, walk AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS hops FROM nation UNION SELECT w.start, b.dst, w.hops + 1 FROM walk w JOIN best b ON b.src = w.node WHERE w.hops < 26) "
    "SELECT start, node, min(hops)::BIGINT AS hops FROM walk WHERE node <> start GROUP BY start, node",
    "neighbour_names": f"WITH {NATIONS} SELECT n_nationkey AS unit_id, coalesce((SELECT string_agg(m.n_name, ',' ORDER BY m.n_name) FROM best JOIN nation m ON m.n_nationkey = src WHERE dst = n.n_nationkey), '') AS callers, "
    "coalesce((SELECT string_agg(m.n_name, ',' ORDER BY m.n_name) FROM best JOIN nation m ON m.n_nationkey = dst WHERE src = n.n_nationkey), '') AS callees FROM nation n",
    "matched_cases": f"WITH {CASES} SELECT case_id, found, matched, n_true - matched AS missed, found - matched AS false_positives FROM counted",
    "eval_recall_fp": f"""WITH {CASES}, r AS (SELECT quality = 1 AS control, coalesce(matched, 0) AS matched, coalesce(found - matched, 0) AS fp FROM labels JOIN documents USING (doc_id) LEFT JOIN counted ON case_id = doc_id),
s AS (SELECT sum((NOT control)::INTEGER)::BIGINT AS traps, sum((NOT control AND matched > 0)::INTEGER)::BIGINT AS true_positives, sum(control::INTEGER)::BIGINT AS controls, sum(CASE WHEN control THEN fp ELSE 0 END)::BIGINT AS control_fp FROM r)
SELECT 'surface' AS layer, *, round(100.0::DOUBLE * true_positives / traps, 6) AS recall_pct, round(control_fp / controls, 6) AS fp_per_control, 100.0 * true_positives / traps >= 40 AND control_fp / controls <= 0.15 AS passed FROM s""",
    "best_threshold": f"WITH swept AS ({{threshold_sweep}}) SELECT threshold, kept, positives, negatives, known FROM swept WHERE negatives = known ORDER BY positives DESC, threshold LIMIT 1",
    "best_setting": f"""WITH {VALUES.replace("{reached}", "overlap >= 0.2 OR simhash >= 0.78")},
grid AS (SELECT metric, g::INTEGER AS threshold, CASE metric WHEN 'simhash' THEN 78 ELSE 20 END AS low FROM limits, (SELECT unnest(range(20, 99, 2)) AS g) WHERE metric <> 'simhash' OR g >= 78),
placed AS (SELECT metric, floor(round(value * 100, 6)) AS spot, positives, CASE WHEN a IS NULL THEN 0 ELSE pairs - positives END AS negatives FROM rated),
counts AS (SELECT g.metric, g.threshold, sum(CASE WHEN spot >= g.threshold THEN positives ELSE 0 END)::BIGINT AS flags, sum(CASE WHEN spot < g.threshold THEN positives ELSE 0 END)::BIGINT AS escalations, sum(CASE WHEN spot >= g.threshold THEN negatives ELSE 0 END)::BIGINT AS unknown_fp
  FROM grid g JOIN placed p ON p.metric = g.metric AND p.spot >= g.threshold - 10 AND p.spot >= g.low GROUP BY g.metric, g.threshold),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY flags DESC, escalations DESC, threshold) AS r FROM counts WHERE unknown_fp = 0)
SELECT metric, threshold, flags, escalations, unknown_fp FROM ranked WHERE r = 1""",
    "verdict_tally": f"""WITH {VERDICTS}, told AS (SELECT metric, verdict, false AS is_control, positives AS n FROM verdicts UNION ALL SELECT metric, verdict, true, pairs - positives FROM verdicts)
SELECT metric, is_control, coalesce(sum(n) FILTER (verdict = 'flag'), 0)::BIGINT AS flag, coalesce(sum(n) FILTER (verdict = 'escalate'), 0)::BIGINT AS escalate, coalesce(sum(n) FILTER (verdict = 'ignore'), 0)::BIGINT AS ignore FROM told WHERE n > 0 GROUP BY metric, is_control""",
    "verdict_changes": f"WITH {VERDICTS} SELECT v.metric, v.case_id, b.verdict AS was, v.verdict AS now FROM verdicts v JOIN verdicts b ON b.case_id = v.case_id AND b.metric = 'jaccard' WHERE v.metric <> 'jaccard' AND v.verdict <> b.verdict",
    "threshold_sweep": f"""WITH {ALL_PAIRS}, classed AS (SELECT doc_id, rep, lang FROM sets JOIN reps USING (set_key) JOIN documents USING (doc_id)),
scored AS (SELECT jaccard, (x.lang IS NOT DISTINCT FROM y.lang)::INTEGER AS same, 0 AS copy FROM pairs JOIN classed x ON x.rep = a JOIN classed y ON y.rep = b WHERE jaccard >= 0.2
  UNION ALL SELECT 1.0, (x.lang IS NOT DISTINCT FROM y.lang)::INTEGER, 1 FROM classed x JOIN classed y ON x.rep = y.rep AND x.doc_id < y.doc_id),
grid AS (SELECT unnest(range(20, 99, 2)) AS threshold)
SELECT threshold, count(jaccard) AS kept, coalesce(sum(same), 0)::BIGINT AS positives, (count(jaccard) - coalesce(sum(same), 0))::BIGINT AS negatives, coalesce(sum(copy * (1 - same)), 0)::BIGINT AS known FROM grid LEFT JOIN scored ON floor(round(jaccard * 100, 6)) >= threshold GROUP BY threshold""",
    "metric_floor": f"WITH RECURSIVE {FLOORS} SELECT family, metric, round(floor, 6) AS floor, round(margin, 6) AS margin FROM floors",
    "metric_rescue": f"WITH RECURSIVE {FLOORS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY margin DESC, metric DESC) AS r FROM floors) SELECT family, metric, round(margin, 6) AS margin FROM ranked WHERE r = 1 AND margin >= 0",
}
ORACLE_SQL["best_threshold"] = ORACLE_SQL["best_threshold"].replace("{threshold_sweep}", ORACLE_SQL["threshold_sweep"])

ORACLE_SQL["growing_index"] = ORACLE_SQL["lsh_candidates"]
ORACLE_SQL["growing_families"] = ORACLE_SQL["twin_families"]
