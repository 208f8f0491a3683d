"""DuckDB SQL for the pN queries that SQL can express on whole tables."""

from __future__ import annotations

NAME = r"nullif(lower(regexp_replace(regexp_replace(trim({0}), '^.*[/\\]', ''), '\.[^.]*$', '')), '')"
NUMBER = r"nullif(regexp_replace(regexp_extract({0}, '([0-9]+)', 1), '^0+([0-9])', '\1'), '')"
FORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
SQUEEZED = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
FILE = r"regexp_replace(trim({0}), '^.*[/\\]', '')"


def _key() -> str:
    name, number = NAME.format("image_id"), NUMBER.format("question_id")
    return f"CASE WHEN {name} IS NOT NULL AND {number} IS NOT NULL THEN {name} || chr(31) || {number} ELSE '#' || rec_id END"


def _terms() -> str:
    return f"""
WITH vals AS (
  SELECT 'ground_truth' AS field, {_key()} AS rec, {FORM.format("ground_truth")} AS term FROM vqa_records
  UNION ALL
  SELECT 'obj_cls', {NAME.format("image")}, {FORM.format("o.obj_cls")} FROM (SELECT image, unnest(objects) AS o FROM annotations) WHERE {NAME.format("image")} IS NOT NULL
), kept AS (SELECT * FROM vals WHERE term <> ''),
totals AS (SELECT field, count(DISTINCT rec) AS total FROM kept GROUP BY field)
SELECT k.field, k.term, count(*) AS occurrences, count(DISTINCT k.rec) AS records,
       CASE WHEN count(DISTINCT k.rec) < 3 THEN 'rare' WHEN count(DISTINCT k.rec) > 0.05 * any_value(t.total) THEN 'common' END AS mark
FROM kept k JOIN totals t USING (field) GROUP BY k.field, k.term"""


def _groups() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT {NAME.format("image_id")} AS image, {NUMBER.format("question_id")} AS link FROM vqa_records),
n AS (SELECT DISTINCT image, split_part(image, '_', 1) AS node, link FROM v WHERE image IS NOT NULL),
e AS (SELECT DISTINCT a.node AS x, b.node AS y FROM n a JOIN n b USING (link) WHERE a.node <> b.node),
r(node, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
g AS (SELECT node, min(root) AS root FROM r GROUP BY node),
i AS (SELECT DISTINCT n.image, g.root FROM n JOIN g USING (node))
SELECT i.image, min(i.image) OVER (PARTITION BY i.root) AS group_image FROM i"""


def _sized() -> str:
    return f"""
WITH v AS (
  SELECT *, {_key()} AS k FROM vqa_records
), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY rec_id) = 1),
s AS (
  SELECT f.rec_id, coalesce(a.name, b.name) AS source, length(coalesce(question, '')) + length(coalesce(ground_truth, '')) AS size
  FROM f LEFT JOIN dataset_registry a ON {SQUEEZED.format("f.dataset")} = {SQUEEZED.format("a.name")}
  LEFT JOIN dataset_registry b ON f.dataset IS NULL AND {FILE.format("f.file_name")} = {FILE.format("b.file_name")}
), z AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(s.size), 0) AS size FROM mix_targets m LEFT JOIN s USING (source) GROUP BY ALL)"""


def _short() -> str:
    kind = f"coalesce(nullif({FORM.format('type')}, ''), nullif({FORM.format('question_type')}, ''), 'generic')"
    name = NAME.format("image")
    return f"""
WITH v AS (SELECT *, {_key()} AS k FROM vqa_records),
r AS (SELECT 'type' AS field, {kind} AS category FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY rec_id) = 1),
o AS (SELECT ann_id, {name} AS image, unnest(objects) AS o FROM annotations),
q AS (SELECT 'obj_cls' AS field, nullif({FORM.format("o.obj_cls")}, '') AS category FROM o
      QUALIFY row_number() OVER (PARTITION BY coalesce(image || chr(31) || o.obj_id, '#' || ann_id || '.' || coalesce(o.obj_id::VARCHAR, '')) ORDER BY ann_id * 100 + o.obj_id) = 1),
a AS (SELECT * FROM r UNION ALL SELECT * FROM q),
n AS (SELECT field, count(*) AS n FROM a GROUP BY field),
c AS (SELECT field, category, count(*) AS n FROM a GROUP BY ALL)
SELECT t.field, t.category FROM sample_targets t JOIN n USING (field) LEFT JOIN c ON c.field = t.field AND c.category = t.category
WHERE coalesce(c.n, 0) < greatest(t.min_count, t.target_share * n.n * 0.25)"""


def _pairs() -> str:
    return f"""
WITH t AS (
  SELECT 'question' AS kind, {NAME.format("image_id")} AS place, rec_id AS key, split, question AS text FROM vqa_records
  UNION ALL
  SELECT 'referring', {NAME.format("image")}, ann_id * 100 + o.obj_id, split, o.referring_sentence FROM (SELECT ann_id, image, split, unnest(objects) AS o FROM annotations)
), w AS (SELECT kind, place, key, split = 'train' AS train, list_distinct(string_split({FORM.format("text")}, ' ')) AS w FROM t WHERE place IS NOT NULL AND {FORM.format("text")} <> ''),
p AS (SELECT a.kind, a.key AS ka, b.key AS kb, len(list_intersect(a.w, b.w)) AS s, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON a.kind = b.kind AND a.place = b.place AND a.train AND NOT b.train)
SELECT kind, least(ka, kb) AS key_a, greatest(ka, kb) AS key_b FROM p WHERE s * 5 >= (n - s) * 4"""


def _ngrams() -> str:
    return f"""
WITH vals AS (
  SELECT 'ground_truth' AS field, {_key()} AS rec, {FORM.format("ground_truth")} AS term FROM vqa_records
  UNION ALL
  SELECT 'obj_cls', {NAME.format("image")}, {FORM.format("o.obj_cls")} FROM (SELECT image, unnest(objects) AS o FROM annotations) WHERE {NAME.format("image")} IS NOT NULL
), w AS (SELECT field, rec, string_split(term, ' ') AS w FROM vals WHERE term <> ''),
p AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT field, rec, n, array_to_string(w[i:i + n - 1], ' ') AS ngram FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS n FROM p))
SELECT field, ngram, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT rec) AS records FROM g GROUP BY ALL"""


def _runs() -> str:
    return f"""
WITH vals AS (
  SELECT 'ground_truth' AS field, {_key()} AS rec, {FORM.format("ground_truth")} AS term FROM vqa_records
  UNION ALL
  SELECT 'obj_cls', {NAME.format("image")}, {FORM.format("o.obj_cls")} FROM (SELECT image, unnest(objects) AS o FROM annotations) WHERE {NAME.format("image")} IS NOT NULL
), w AS (SELECT field, rec, md5(term) AS value, md5('0' || chr(31) || field || chr(31) || term) AS place, string_split(term, ' ') AS w FROM vals WHERE term <> ''),
p AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT field, rec, n, {{'place': place, 'i': i, 'value': value}} AS f, array_to_string(w[i:i + n - 1], ' ') AS ngram FROM (SELECT *, unnest(range(1, len(w) - i + 2)) AS n FROM p)),
c AS (SELECT field, ngram, n, min(f) AS f, count(*) AS occurrences, count(DISTINCT rec) AS records FROM g GROUP BY ALL)
SELECT field, f.value AS value, CAST(f.i AS INTEGER) AS start, CAST(min(n) AS INTEGER) AS shortest, CAST(max(n) AS INTEGER) AS longest, occurrences, records FROM c GROUP BY field, f, occurrences, records"""


WORDS = r"list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _leaks() -> str:
    runs = "SELECT {0} AS id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS r FROM (SELECT {0}, {1} AS w FROM {2}) WHERE len(w) >= 12"
    return f"""SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({runs.format("doc_id", WORDS.format("text"), "documents")}) d JOIN ({runs.format("item_id", WORDS.format("passage"), "eval_items")}) i USING (r)"""


def _contained() -> str:
    runs = "SELECT DISTINCT {0} AS id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS r FROM (SELECT {0}, {1} AS w FROM {2}) WHERE len(w) >= 5"
    return f"""WITH d AS ({runs.format("doc_id", WORDS.format("text"), "documents")}), i AS ({runs.format("item_id", WORDS.format("passage"), "eval_items")}), q AS (SELECT id, count(*) AS q FROM i GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) / any_value(q.q) AS containment FROM d JOIN i USING (r) JOIN q ON q.id = i.id GROUP BY ALL HAVING count(*) >= 0.8 * any_value(q.q) - 1e-9"""


def _ranked(key: str, seed: int, rows: str, group: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}' || chr(31) || {key}), {key}) AS rank FROM {rows}"


def _sources() -> str:
    """All records of val and test rows, and all objects of such annotations, with their source."""
    return f"""
e AS (SELECT 'question' AS kind, f.rec_id AS eval_key, lower(trim(split)) AS split, coalesce(a.name, b.name) AS source FROM vqa_records f
  LEFT JOIN dataset_registry a ON {SQUEEZED.format("f.dataset")} = {SQUEEZED.format("a.name")}
  LEFT JOIN dataset_registry b ON f.dataset IS NULL AND {FILE.format("f.file_name")} = {FILE.format("b.file_name")} WHERE lower(trim(split)) IN ('val', 'test')
  UNION ALL SELECT 'referring', ann_id * 100 + o.obj_id, lower(trim(split)), 'VRSBench' FROM (SELECT ann_id, split, unnest(objects) AS o FROM annotations) WHERE lower(trim(split)) IN ('val', 'test')),
c AS (SELECT e.*, coalesce(x.pairs, 0) AS pairs, x.coverage FROM e LEFT JOIN (SELECT kind, eval_key, count(*) AS pairs, max(s / (n - s)) AS coverage FROM near GROUP BY ALL) x USING (kind, eval_key))"""


def _near() -> str:
    return f"{_pairs().rpartition('SELECT kind, least')[0].rstrip()}, near AS (SELECT kind, kb AS eval_key, s, n FROM p WHERE s * 5 >= (n - s) * 4),{_sources()}"


def _items() -> str:
    kind = f"coalesce(nullif({FORM.format('type')}, ''), nullif({FORM.format('question_type')}, ''), 'generic')"
    name = NAME.format("image")
    return f"""
WITH v AS (SELECT *, {_key()} AS k FROM vqa_records),
r AS (SELECT 'type' AS field, rec_id AS key, {kind} AS category FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY rec_id) = 1),
o AS (SELECT ann_id, {name} AS image, unnest(objects) AS o FROM annotations),
q AS (SELECT 'obj_cls' AS field, ann_id * 100 + o.obj_id AS key, nullif({FORM.format("o.obj_cls")}, '') AS category FROM o
      QUALIFY row_number() OVER (PARTITION BY coalesce(image || chr(31) || o.obj_id, '#' || ann_id || '.' || coalesce(o.obj_id::VARCHAR, '')) ORDER BY ann_id * 100 + o.obj_id) = 1),
a AS (SELECT * FROM r UNION ALL SELECT * FROM q),
n AS (SELECT field, floor(count(*) * 0.25) AS size, count(*) * 0.25 AS exact FROM a GROUP BY field),
t AS (SELECT t.*, n.size, greatest(t.min_count, t.target_share * n.exact) AS wanted, coalesce(c.n, 0) AS available FROM sample_targets t JOIN n USING (field)
      LEFT JOIN (SELECT field, category, count(*) AS n FROM a GROUP BY ALL) c ON c.field = t.field AND c.category = t.category),
k AS ({_ranked("key", 17, "a", "field, category")}),
m AS (SELECT k.*, t.target_share, t.size, t.min_count FROM k JOIN t ON k.field = t.field AND k.category = t.category),
s AS (SELECT *, CASE WHEN rank <= min_count THEN 0.0 ELSE (rank - 0.5) / target_share END AS priority FROM m),
d AS (SELECT * FROM s WHERE target_share > 0 OR rank <= min_count QUALIFY row_number() OVER (PARTITION BY field ORDER BY priority, category, rank) <= size)"""


def _mixture() -> str:
    """The plan of a mixture: limits, the level at which the free sources fill what the limited ones leave, budgets and uses."""
    return f"""{_sized()}, a AS (SELECT *, greatest(max_repeats, 0) AS m, (SELECT sum(size) FROM z) AS total FROM z),
l AS (SELECT *, size * m AS cap, size * m < target_share * total AS limited, target_share * total AS want FROM a),
g AS (SELECT least(any_value(total), sum(cap) FILTER (limited OR target_share > 0)) - coalesce(sum(cap) FILTER (limited), 0) AS goal FROM l),
k AS (SELECT cap / want AS level FROM l WHERE NOT limited AND want > 0 UNION ALL SELECT 0.0),
y AS (SELECT level, (SELECT coalesce(sum(least(cap, want * k.level)), 0) FROM l WHERE NOT limited) AS filled, (SELECT coalesce(sum(want), 0) FROM l WHERE NOT limited AND want > 0 AND cap / want > k.level) AS slope FROM k),
e AS (SELECT level + CASE WHEN slope > 0 THEN ((SELECT goal FROM g) - filled) / slope ELSE 0 END AS scale FROM y WHERE filled <= (SELECT goal FROM g) ORDER BY level DESC LIMIT 1),
p AS (SELECT *, CASE WHEN limited THEN cap ELSE round(least(cap, want * (SELECT scale FROM e)), 6) END AS budget FROM l),
o AS (SELECT s.*, p.budget, p.size AS whole, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('13' || chr(31) || s.rec_id), s.rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s JOIN p USING (source)),
u AS (SELECT *, floor(budget / nullif(whole, 0)) AS blocks FROM o),
x AS (SELECT rec_id, source, size, CAST(coalesce(blocks, 0) AS INTEGER) + CASE WHEN budget - coalesce(blocks, 0) * whole > 0 AND before + size <= budget - coalesce(blocks, 0) * whole THEN 1 ELSE 0 END AS copies FROM u)"""


def _splits() -> str:
    name, number = NAME.format("image_id"), NUMBER.format("question_id")
    return f"""
WITH RECURSIVE v AS (SELECT *, {_key()} AS k FROM vqa_records),
f AS (SELECT rec_id, coalesce('s' || split_part({name}, '_', 1), 'q' || {number}, '#' || rec_id) AS node, {number} AS link FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY rec_id) = 1),
d AS (SELECT DISTINCT node, link FROM f WHERE link IS NOT NULL),
e AS (SELECT DISTINCT a.node AS x, b.node AS y FROM d a JOIN d b USING (link) WHERE a.node <> b.node),
r(node, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
g AS (SELECT node, min(root) AS root FROM r GROUP BY node),
t AS (SELECT f.rec_id, coalesce(g.root, f.node) AS root FROM f LEFT JOIN g USING (node)),
n AS (SELECT root, count(*) AS size, length(bin(count(*))) - 1 AS band FROM t GROUP BY root),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY band ORDER BY md5('11' || chr(31) || root), root ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
b AS (SELECT band, sum(size) AS total, count(*) AS groups, sum(size) / greatest(1, count(*) // 1024) AS cycle FROM n GROUP BY band),
w AS (SELECT arg_max(band, groups * 1000 - band) AS last FROM b),
s AS (SELECT split, target_share / (SELECT sum(target_share) FROM split_targets WHERE target_share > 0) AS share FROM split_targets WHERE target_share > 0),
c AS (SELECT split, share, coalesce(sum(share) OVER (ORDER BY share DESC, split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS low FROM s),
q AS (SELECT p.*, ((p.before + p.size / 2) % b.cycle) / b.cycle AS at FROM p JOIN b USING (band)),
a AS (SELECT q.root, q.size, q.band, c.split FROM q JOIN c ON c.low <= q.at WHERE q.band <> (SELECT last FROM w) QUALIFY row_number() OVER (PARTITION BY q.root ORDER BY c.low DESC) = 1),
h AS (SELECT s.split, s.share, greatest(0.0, s.share * (SELECT sum(size) FROM n) - coalesce((SELECT sum(size) FROM a WHERE a.split = s.split), 0)) AS want FROM s),
m AS (SELECT split, CASE WHEN (SELECT sum(want) FROM h) > 0 THEN want / (SELECT sum(want) FROM h) ELSE share END AS part, share FROM h),
k AS (SELECT split, coalesce(sum(part) OVER (ORDER BY share DESC, split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS low FROM m),
z AS (SELECT root, split FROM a UNION ALL SELECT root, split FROM (SELECT q.root, k.split, k.low FROM q JOIN k ON k.low <= q.at WHERE q.band = (SELECT last FROM w) QUALIFY row_number() OVER (PARTITION BY q.root ORDER BY k.low DESC, k.split DESC) = 1))"""


def _copies() -> str:
    """Lines that are valid JSON objects, with a text that two of them share if and only if they hold the same record."""
    plain = SQUEEZED.format("value ->> '$'")
    return f"""
WITH v AS (SELECT raw_id, payload FROM raw_records WHERE json_valid(payload)),
e AS (SELECT v.raw_id, j.key, j.type, CASE WHEN j.type = 'VARCHAR' THEN 's' || {plain} WHEN j.type IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN 'n' || CAST(j.value AS DOUBLE)
  WHEN j.type = 'ARRAY' THEN 'l' || CAST(CAST(j.value AS DOUBLE[]) AS VARCHAR) ELSE j.type || coalesce(j.value ->> '$', '') END AS form FROM v, json_each(v.payload) j),
f AS (SELECT raw_id, string_agg(key || chr(30) || form, chr(31) ORDER BY key) AS form FROM e GROUP BY raw_id),
c AS (SELECT raw_id, min(raw_id) OVER (PARTITION BY form) AS first_id, count(*) OVER (PARTITION BY form) AS n_copies FROM f)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": _terms(),
        "p1_ngrams": _ngrams(),
        "p1_runs": _runs(),
        "p1_found": f"SELECT field, term, mark FROM ({_terms()}) WHERE mark IS NOT NULL",
        "p2_found": _groups(),
        "p2_split": f'{_splits()} SELECT t.rec_id, t.root AS "group", z.split FROM t JOIN z USING (root)',
        "p2_report": f"""{_splits()} SELECT x.split, x.target_share, coalesce(y.records, 0) AS records, coalesce(y.groups, 0) AS groups, y.records / (SELECT count(*) FROM t) AS share
FROM split_targets x LEFT JOIN (SELECT z.split, count(*) AS records, count(DISTINCT t.root) AS groups FROM t JOIN z USING (root) GROUP BY z.split) y USING (split)""",
        "p3_found": _pairs(),
        "p4_found": f"{_sized()} SELECT source FROM z WHERE size * max_repeats < target_share * (SELECT sum(size) FROM z)",
        "p3_coverage": f"{_near()} SELECT kind, eval_key, split, source, pairs, coverage FROM c",
        "p3_report": f"""{_near()} SELECT kind, split, source, count(*) AS rows, count(coverage) AS overlapping, sum(pairs) AS pairs, count(*) FILTER (coverage = 1) AS whole, round(avg(coverage), 6) AS mean_coverage FROM c GROUP BY ALL""",
        "p4_mix": f"{_mixture()} SELECT rec_id, source, size, copies FROM x WHERE copies > 0",
        "p4_report": f"""{_mixture()}, n AS (SELECT source, count(*) AS used_records, CAST(sum(copies) AS BIGINT) AS uses, max(copies) AS most_uses, CAST(sum(copies * size) AS BIGINT) AS used_size FROM x WHERE copies > 0 GROUP BY source)
SELECT p.source, (SELECT count(*) FROM s WHERE s.source = p.source) AS records, CAST(p.size AS BIGINT) AS size, p.limited, coalesce(used_records, 0) AS used_records, coalesce(uses, 0) AS uses, coalesce(most_uses, 0) AS most_uses, coalesce(used_size, 0) AS used_size,
 coalesce(used_size, 0) / sum(used_size) OVER () AS share_reached, round(p.budget / sum(p.budget) OVER (), 9) AS reachable_share FROM p LEFT JOIN n USING (source)""",
        "p4_plan": f"""{_mixture()} SELECT source, size / total AS share, target_share, max_repeats, budget, limited,
 CASE WHEN size = 0 OR m = 0 THEN 0.0 WHEN limited THEN round(ln(m) / ln(target_share / (size / total)), 9) ELSE 1.0 END AS exponent FROM p""",
        "p5_found": f"{_copies()} SELECT first_id, raw_id AS copy_id FROM c WHERE raw_id <> first_id",
        "p5_collapsed": f"{_copies()} SELECT r.*, c.n_copies FROM c JOIN raw_records r USING (raw_id) WHERE c.raw_id = c.first_id",
        "p6_found": _short(),
        "p6_sample": f"{_items()} SELECT field, category, key, rank, priority FROM d",
        "p6_report": f"""{_items()} SELECT t.field, t.category, t.target_share, t.min_count, t.available, CAST(t.wanted AS DOUBLE) AS wanted, coalesce(x.n, 0) AS seats, CAST(t.size AS BIGINT) AS sample_size, coalesce(x.n, 0) AS drawn, t.available < t.wanted AS short
FROM t LEFT JOIN (SELECT field, category, count(*) AS n FROM d GROUP BY ALL) x ON x.field = t.field AND x.category = t.category""",
        "p9_found": _leaks(),
        "p9_items": f"SELECT i.item_id, i.dataset, i.split, count(*) AS documents FROM ({_leaks()}) JOIN eval_items i USING (item_id) GROUP BY ALL",
        "p9_contained": _contained(),
    }
