"""SQL of the study's queries, for DuckDB over the same tables."""

from __future__ import annotations

from harbormill.functions.ids import INVALID_USERS
from harbormill.functions.names import FILLERS

_BAD = ", ".join(f"'{x}'" for x in INVALID_USERS)
_FILL = ", ".join(f"'{x}'" for x in FILLERS)


def _clean(c: str) -> str:
    return f"regexp_replace(nullif(trim(CAST({c} AS VARCHAR)), ''), '^([0-9]+)\\.0+$', '\\1')"


def _h(*parts: str) -> str:
    """The 32-bit number that the first 8 hex digits of md5 stand for."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _core(c: str) -> str:
    t = f"replace(replace(replace(lower(coalesce({c}, '')), '&', ' and '), 'st.', 'saint'), '/', ' ')"
    return (
        f"array_to_string(list_filter(regexp_split_to_array(regexp_replace({t}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), "
        f"lambda w: w <> '' AND w NOT IN ({_FILL}) AND (length(w) > 1 OR regexp_full_match(w, '[0-9]'))), ' ')"
    )


BASE = f"""
inter AS (
  SELECT * FROM (SELECT trim(user_id) AS u, {_clean('img_hotel_id')} AS i, CASE WHEN NOT isnan(rating) THEN CAST(rating AS DOUBLE) END AS rating FROM multimodal_interactions_v3)
  WHERE NOT coalesce(lower(trim(u)) IN ({_BAD}), true) AND i IS NOT NULL),
pos AS (SELECT * FROM inter WHERE rating >= 4),
media AS (SELECT DISTINCT {_clean('img_hotel_id')} AS i FROM item_images_v3 WHERE len(available_images) > 0),
pairs AS (SELECT u, i, max(rating) AS max_rating, count(*) AS n_rows FROM pos WHERE i IN (SELECT i FROM media WHERE i IS NOT NULL) GROUP BY u, i),
core AS (SELECT * FROM pairs WHERE i IN (SELECT i FROM pairs GROUP BY i HAVING count(*) >= 5)),
numbered AS (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY md5('42|' || u || '|' || i), i) AS rn, count(*) OVER (PARTITION BY u) AS n FROM core),
split AS (
  SELECT u, i, CASE WHEN n < 2 THEN 'train' WHEN n = 2 THEN CASE WHEN rn = 1 THEN 'val' ELSE 'train' END
    WHEN rn <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS INT)) THEN 'test' WHEN rn <= 2 * greatest(1, CAST(floor(n * 0.1::DOUBLE) AS INT)) THEN 'val' ELSE 'train' END AS split FROM numbered),
train AS (SELECT u, i FROM split WHERE split = 'train'),
val AS (SELECT u, i FROM split WHERE split = 'val'),
pop AS (SELECT i, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, i) AS rank FROM train GROUP BY i),
catalog AS (SELECT i AS id, row_number() OVER (ORDER BY i) - 1 AS idx FROM (SELECT DISTINCT i FROM core))
"""

IMAGES = f"""
usable AS (
  SELECT {_clean('img_hotel_id')} AS item, slot, vec FROM clip_per_image_v4
  WHERE len(vec) = 64 AND slot < 32 AND img_hotel_id IS NOT NULL AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
cells AS (SELECT item, slot, d - 1 AS d, CAST(vec[d] AS DOUBLE) AS x FROM usable, range(1, 65) t(d)),
norms AS (SELECT item, slot, greatest(sqrt(sum(x * x)), 1e-12) AS l FROM cells GROUP BY item, slot),
units AS (SELECT c.item, c.slot, c.d, c.x / l AS x FROM cells c JOIN norms n ON c.item = n.item AND c.slot = n.slot),
coh AS (
  SELECT item, any_value(n) AS n, CASE WHEN any_value(n) < 2 THEN 0 ELSE (sum(s * s) - sum(q)) / (any_value(n) * (any_value(n) - 1)) END AS raw
  FROM (SELECT item, d, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM units GROUP BY item, d) GROUP BY item),
avail AS (SELECT item, count(*) AS n_images, count(*) / 32 AS availability FROM usable GROUP BY item),
means AS (SELECT item, d, avg(x) AS m FROM cells GROUP BY item, d),
pooled AS (SELECT item, d, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY item)), 1e-12) AS x FROM means)
"""


def _minmax(c: str, over: str = "") -> str:
    return f"CASE WHEN max({c}) OVER () - min({c}) OVER () > 1e-12 THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END"


EVID = f"""
evu AS (SELECT u, n, {_minmax('l')} AS evidence FROM (SELECT u, count(*) AS n, ln(1 + count(*)) AS l FROM train GROUP BY u)),
evi AS (SELECT i, n, {_minmax('l')} AS evidence FROM (SELECT i, count(*) AS n, ln(1 + count(*)) AS l FROM train GROUP BY i))
"""
COH = f"cohs AS (SELECT item, n, raw, least(greatest({_minmax('raw')}, 0), 1) AS coherence FROM coh)"


def _w(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n"


def _weight(salt: str, node: str, d: str) -> str:
    return f"({_h(repr(salt), node, f'CAST({d} AS VARCHAR)')} % 20001 - 10000) / 100000.0::DOUBLE"


def _light(salt: str, dims: int) -> str:
    return f"""
nodes AS (SELECT DISTINCT 'u|' || u AS node FROM train UNION SELECT DISTINCT 'i|' || i FROM train),
s0 AS (SELECT node, d, {_weight(salt, 'node', 'd')} AS x FROM nodes, range(0, {dims}) t(d)),
du AS (SELECT u, count(*) AS c FROM train GROUP BY u), di AS (SELECT i, count(*) AS c FROM train GROUP BY i),
bip AS (SELECT t.u, t.i, 1 / sqrt(du.c * di.c) AS w FROM train t JOIN du ON t.u = du.u JOIN di ON t.i = di.i),
edges AS (SELECT 'u|' || u AS src, 'i|' || i AS dst, w FROM bip UNION ALL SELECT 'i|' || i, 'u|' || u, w FROM bip),
s1 AS (SELECT dst AS node, d, sum(w * x) AS x FROM edges JOIN s0 ON src = node GROUP BY dst, d),
s2 AS (SELECT dst AS node, d, sum(w * x) AS x FROM edges JOIN s1 ON src = node GROUP BY dst, d),
light AS (SELECT node, d, sum(x) / 3 AS x FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY node, d)
"""


_LIGHT_TOP = """
asked AS (SELECT DISTINCT u FROM val WHERE u IN (SELECT u FROM train)),
scored AS (
  SELECT a.u, substr(b.node, 3) AS i, round(sum(x.x * b.x), 6) AS score FROM asked a JOIN light x ON x.node = 'u|' || a.u JOIN light b ON b.d = x.d AND b.node LIKE 'i|%' GROUP BY 1, 2),
top AS (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM scored s WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.u = s.u AND t.i = s.i) QUALIFY rank <= 20)
"""
_POP_TOP = """
top AS (
  SELECT v.u, p.i, row_number() OVER (PARTITION BY v.u ORDER BY p.rank) AS rank FROM (SELECT DISTINCT u FROM val) v, pop p
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.u = v.u AND t.i = p.i) QUALIFY row_number() OVER (PARTITION BY v.u ORDER BY p.rank) <= 20)
"""
_METRICS = """
sizes AS (SELECT u, count(*) AS n_relevant FROM val GROUP BY u),
hits AS (SELECT t.u, t.rank FROM top t JOIN val v ON t.u = v.u AND t.i = v.i),
per AS (
  SELECT s.u, n_relevant, (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) r(k) WHERE k <= n_relevant) AS i10, (SELECT sum(1 / log2(k + 1)) FROM range(1, 21) r(k) WHERE k <= n_relevant) AS i20,
    min(rank) AS first, coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END), 0) AS d10, coalesce(sum(1 / log2(rank + 1)), 0) AS d20
  FROM sizes s LEFT JOIN hits h ON s.u = h.u GROUP BY s.u, n_relevant),
metrics AS (
  SELECT u, n_relevant, CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS hr10, CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS hr20, d10 / i10 AS ndcg10, d20 / i20 AS ndcg20, coalesce(1 / first, 0) AS mrr20 FROM per)
"""
_PER_USER = "SELECT u, n_relevant, round(hr10, 6) AS hr10, round(hr20, 6) AS hr20, round(ndcg10, 6) AS ndcg10, round(ndcg20, 6) AS ndcg20, round(mrr20, 6) AS mrr20 FROM metrics"
_MACRO = "SELECT count(*) AS n_users, round(avg(hr10), 6) AS hr10, round(avg(hr20), 6) AS hr20, round(avg(ndcg10), 6) AS ndcg10, round(avg(ndcg20), 6) AS ndcg20, round(avg(mrr20), 6) AS mrr20 FROM metrics"


def _knn(name: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM (
    SELECT a.item AS src, b.item AS dst, round(sum(a.x * b.x), 9) AS sim FROM pooled a JOIN pooled b ON a.d = b.d GROUP BY 1, 2) QUALIFY rank <= {k}),
{name}_d AS (SELECT src, greatest(sum(sim), 1e-12) AS d FROM {name} GROUP BY src),
{name}_n AS (SELECT g.src, g.dst, g.sim / sqrt(a.d) / sqrt(b.d) AS w FROM {name} g JOIN {name}_d a ON g.src = a.src JOIN {name}_d b ON g.dst = b.src)
"""


def _unit(*parts: str) -> str:
    return f"({_h(*parts)} % 1000000 / 1000000.0::DOUBLE)"


_RUNS = f"""
runs AS (
  SELECT source_name AS model, model_seed, corruption_seed, level,
    0.02::DOUBLE + 0.01::DOUBLE * {_unit('source_name', 'CAST(model_seed AS VARCHAR)', "CASE WHEN level = 0 THEN '0' ELSE CAST(corruption_seed AS VARCHAR) END", 'CAST(CAST(level * 100 AS INT) AS VARCHAR)')} - 0.004::DOUBLE * level AS value
  FROM source_clock, (VALUES (1), (7), (42)) a(model_seed), range(2026, 2031) b(corruption_seed), (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) c(level))
"""
_STRATA = f"""
e AS (SELECT i, n, round(evidence, 9) AS evidence FROM evi),
ranked AS (SELECT *, (rank() OVER (ORDER BY evidence) + (count(*) OVER (PARTITION BY evidence) - 1) / 2.0::DOUBLE) / count(*) OVER () AS p, {_unit("'gate'", 'i')} AS gate FROM e),
strata AS (SELECT *, CASE WHEN p <= 0.25 THEN 'Q1-low' WHEN p <= 0.5 THEN 'Q2' WHEN p <= 0.75 THEN 'Q3' ELSE 'Q4-high' END AS quartile FROM ranked)
"""
_DIFFS = f"""
vu AS (SELECT DISTINCT u FROM val),
diffs AS (
  SELECT u, round(avg(floor({_unit("'a'", 'u', 'CAST(seed AS VARCHAR)')} * 4) / 4) - avg(floor({_unit("'b'", 'u', 'CAST(seed AS VARCHAR)')} * 4) / 4), 9) AS diff
  FROM vu, (VALUES (1), (7), (42)) s(seed) GROUP BY u)
"""


def _negatives(salt: str, per: int, positives: str, seen: str, ids: str) -> str:
    return f"""
ids AS ({ids}), size AS (SELECT count(*) AS s FROM ids),
draws AS (SELECT p.u, p.i, k, a, {_h(repr(salt), 'p.u', 'p.i', 'CAST(k AS VARCHAR)', 'CAST(a AS VARCHAR)')} % (SELECT s FROM size) AS idx FROM {positives} p, range(1, {per + 1}) x(k), range(1, 9) y(a)),
neg AS (
  SELECT d.u, d.i, k, arg_min(c.id, a) AS negative FROM draws d JOIN ids c ON d.idx = c.idx
  WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.u = d.u AND s.i = c.id) GROUP BY d.u, d.i, k)
"""


_IDS = "SELECT i AS id, row_number() OVER (ORDER BY i) - 1 AS idx FROM (SELECT DISTINCT i FROM {0})"
_MASKS = """
img AS (SELECT item, slot, count(*) OVER (PARTITION BY item) AS n FROM usable),
mr AS (SELECT seed, item, slot, n, row_number() OVER (PARTITION BY seed, item ORDER BY md5(concat_ws('|', CAST(seed AS VARCHAR), item, CAST(slot AS VARCHAR))), slot) AS rn FROM img, (VALUES (2026), (2027), (2028), (2029), (2030)) s(seed)),
masks AS (SELECT seed, level, item, slot FROM mr, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) l(level) WHERE rn <= greatest(1, least(n, CAST(round_even(n * (1 - level), 0) AS INT))))
"""
_SLUG = "CASE WHEN contains(url, '-Reviews-') THEN regexp_replace(substr(url, strpos(url, '-Reviews-') + 9), '\\.html?$', '') END"
_TEXT = "SELECT u, i FROM split WHERE split = 'train'"

ORACLE = {
    "interactions_standardize": """
SELECT trim(user_id) AS user_id, trim(hotel_id) AS hotel_id, CASE WHEN NOT isnan(rating) THEN CAST(rating AS DOUBLE) END AS rating, trim(coalesce(review_text, '')) AS review_text, "timestamp"
FROM merged_hotelrec WHERE user_id IS NOT NULL AND hotel_id IS NOT NULL""",
    "implicit_filter": _w(BASE) + "SELECT u, i, count(*) AS n, count(*) AS labels FROM pos GROUP BY u, i",
    "pair_aggregate": """
SELECT trim(user_id) AS u, trim(hotel_id) AS i, count(*) AS n_rows, max(CASE WHEN NOT isnan(rating) THEN CAST(rating AS DOUBLE) END) AS max_rating, min(row_id) AS first_row,
  coalesce(string_agg(CASE WHEN trim(review_text) <> '' AND lower(trim(review_text)) <> 'nan' THEN trim(review_text) END, ' ' ORDER BY row_id), '') AS text
FROM merged_hotelrec WHERE user_id IS NOT NULL AND hotel_id IS NOT NULL GROUP BY 1, 2""",
    "item_kcore": _w(BASE) + "SELECT u, i, max_rating, n_rows FROM core",
    "name_normalize": f"SELECT DISTINCT hotel_name, {_core('hotel_name')} AS core FROM hotel_info",
    "slug_parse": f"""
WITH t AS (SELECT DISTINCT trim(hotel_id) AS url FROM merged_hotelrec), p AS (SELECT url, string_split({_SLUG}, '-') AS parts FROM t)
SELECT url, coalesce(replace(parts[1], '_', ' '), '') AS name, CASE WHEN len(parts) > 1 THEN replace(parts[-1], '_', ' ') ELSE '' END AS loc FROM p""",
    "entity_resolution_1to1": f"""
WITH s AS (SELECT ta_hotel_id, coalesce(replace(string_split(regexp_replace(substr(ta_hotel_id, strpos(ta_hotel_id, '-Reviews-') + 9), '\\.html?$', ''), '-')[1], '_', ' '), '') AS name FROM item_images_v3),
a AS (SELECT {_core('name')} AS core, min(ta_hotel_id) AS ta_hotel_id FROM s GROUP BY 1 HAVING count(DISTINCT ta_hotel_id) = 1),
b AS (SELECT {_core('hotel_name')} AS core, min(id) AS id FROM hotel_info GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT core, ta_hotel_id, id FROM a JOIN b USING (core) WHERE core <> ''""",
    "registry_collect_list": f"""
WITH r AS (SELECT DISTINCT {_clean('hotel_id')} AS hotel, trim(image_url) AS url FROM train_set WHERE hotel_id IS NOT NULL AND image_url IS NOT NULL),
p AS (SELECT hotel, CAST(ceil(count(*) / 200) AS BIGINT) AS parts FROM r WHERE hotel IS NOT NULL GROUP BY hotel)
SELECT hotel, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % parts AS part, count(*) AS n, string_agg(url, ' ' ORDER BY url) AS urls FROM r JOIN p USING (hotel) GROUP BY 1, 2""",
    "registry_lookup": f"""
WITH r AS (SELECT {_clean('hotel_id')} AS i, count(DISTINCT trim(image_url)) AS n FROM train_set WHERE hotel_id IS NOT NULL AND image_url IS NOT NULL GROUP BY 1)
SELECT {_clean('img_hotel_id')} AS img_hotel_id, core_name, coalesce(image_count, 0) AS image_count, coalesce(n, 0) AS n_listed FROM item_images_v3 LEFT JOIN r ON {_clean('img_hotel_id')} = r.i""",
    "invalid_user_removal": f"SELECT source_dump, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(lower(trim(user_id)) IN ({_BAD}), true)) AS n_removed FROM merged_hotelrec GROUP BY 1",
    "id_suffix_strip": "SELECT row_id, split_part(trim(hotel_id), '.', 1) AS hotel FROM train_set",
    "resume_antijoin": "SELECT DISTINCT trim(image_url) AS url FROM train_set WHERE image_url IS NOT NULL AND substr(md5(trim(image_url)), 1, 1) >= '8'",
    "config_signature": "SELECT source_name, substr(sha256(concat_ws('|', source_name, tz_name, CASE WHEN day_first THEN 'true' ELSE 'false' END)), 1, 16) AS signature FROM source_clock",
    "failure_histogram": """
SELECT CASE WHEN vec IS NULL THEN 'missing' WHEN len(vec) = 0 THEN 'empty' WHEN len(vec) <> 64 THEN 'wrong_length' WHEN len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'nan'
  WHEN len(list_filter(vec, lambda x: x <> 0)) = 0 THEN 'all_zero' ELSE 'ok' END AS reason, count(*) AS n FROM clip_per_image_v4 GROUP BY 1 ORDER BY n DESC, reason LIMIT 10""",
    "text_coverage": """
WITH r AS (SELECT trim(user_id) AS u, trim(hotel_id) AS h, trim(coalesce(review_text, '')) AS t, row_id FROM merged_hotelrec),
f AS (SELECT u, h, arg_min(t, row_id) AS t FROM r WHERE u IS NOT NULL AND h IS NOT NULL AND t <> '' GROUP BY u, h)
SELECT h, count(*) AS n_reviews, sum(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')))::BIGINT AS n_words FROM f GROUP BY h""",
    "format_metrics": "SELECT ta_city, printf('%.1f', round(avg(image_count), 1)) AS shown, translate(lower(ta_city), ' -', '__') AS slug FROM item_images_v3 WHERE image_count IS NOT NULL GROUP BY ta_city",
    "split_v6": _w(BASE) + "SELECT u, i, split FROM split",
    "split_v3_rows": _w(BASE)
    + """, raw AS (SELECT u, i || '#' || CAST(row_number() OVER (PARTITION BY u, i) AS VARCHAR) AS i FROM pos),
m AS (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY md5('7|' || u || '|' || i), i) AS rn, count(*) OVER (PARTITION BY u) AS n FROM raw)
SELECT u, i, CASE WHEN n < 3 THEN 'train' WHEN rn <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS INT)) THEN 'test' WHEN rn <= 2 * greatest(1, CAST(floor(n * 0.1::DOUBLE) AS INT)) THEN 'val' ELSE 'train' END AS split FROM m""",
    "split_summary": _w(BASE) + "SELECT split, count(*) AS n_rows, count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items FROM split GROUP BY split",
    "audit_overlap": _w(BASE) + "SELECT u, i, count(DISTINCT split) AS n_splits FROM split GROUP BY u, i HAVING count(DISTINCT split) > 1",
    "audit_duplicates": _w(BASE) + "SELECT split, u, i, count(*) AS n FROM split GROUP BY ALL HAVING count(*) > 1",
    "audit_cold_users": _w(BASE) + "SELECT DISTINCT split, u AS id FROM split WHERE split <> 'train' AND u NOT IN (SELECT u FROM train)",
    "audit_cold_items": _w(BASE) + "SELECT DISTINCT split, i AS id FROM split WHERE split <> 'train' AND i NOT IN (SELECT i FROM train)",
    "audit_held_out": _w(BASE) + "SELECT s.u, s.i, s.split FROM split s JOIN train t ON s.u = t.u AND s.i = t.i WHERE s.split <> 'train'",
    "audit_functional": f"SELECT trim(hotel_id) AS h, count(DISTINCT {_clean('img_hotel_id')}) AS n_values FROM multimodal_interactions_v3 WHERE hotel_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_clean('img_hotel_id')}) > 1",
    "audit_vectors": "SELECT vec_id, coalesce(len(vec), -1) AS n FROM clip_per_image_v4 WHERE vec IS NULL OR len(vec) <> 64 OR len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) > 0 OR len(list_filter(vec, lambda x: x <> 0)) = 0",
    "dense_index_map": _w(BASE) + "SELECT id, idx FROM catalog",
    "user_index_map": _w(BASE) + "SELECT u AS id, row_number() OVER (ORDER BY u) - 1 AS idx FROM (SELECT DISTINCT u FROM core)",
    "train_history": _w(BASE) + "SELECT u, string_agg(i, ',' ORDER BY i) AS items, count(*) AS n FROM train GROUP BY u",
    "seen_union": _w(BASE) + "SELECT u, count(DISTINCT i) AS n_seen FROM split GROUP BY u",
    "negatives_offline": _w(BASE, _negatives("neg", 4, "train", "split", _IDS.format("split"))) + "SELECT * FROM neg",
    "negatives_online": _w(BASE, _negatives("online", 1, "train", "train", _IDS.format("train"))) + "SELECT * FROM neg",
    "negative_audit": _w(BASE, _negatives("neg", 4, "train", "split", _IDS.format("split"))) + "SELECT n.u, n.negative AS i FROM neg n JOIN split s ON n.u = s.u AND n.negative = s.i",
    "user_subset": _w(BASE) + "SELECT u FROM (SELECT DISTINCT u FROM val) ORDER BY md5('subset|' || u), u LIMIT 50",
    "popularity_rank": _w(BASE) + "SELECT i, n, rank FROM pop",
    "popularity_topk": _w(BASE, _POP_TOP) + "SELECT u, i, rank FROM top",
    "eval_user_metrics": _w(BASE, _POP_TOP, _METRICS) + _PER_USER,
    "eval_macro": _w(BASE, _POP_TOP, _METRICS) + _MACRO,
    "user_history_evidence": _w(BASE, EVID) + "SELECT u, n, round(evidence, 6) AS evidence FROM evu",
    "item_popularity_evidence": _w(BASE, EVID) + "SELECT i, n, round(evidence, 6) AS evidence FROM evi",
    "image_availability": _w(IMAGES) + "SELECT item, n_images, round(availability, 6) AS availability FROM avail",
    "visual_coherence": _w(IMAGES)
    + f""", sims AS (
  SELECT a.item, a.slot AS s1, b.slot AS s2, sum(a.x * b.x) AS c FROM units a JOIN units b ON a.item = b.item AND a.d = b.d AND a.slot < b.slot GROUP BY 1, 2, 3),
pairwise AS (SELECT v.item, v.n_images AS n, coalesce(avg(c), 0) AS raw FROM avail v LEFT JOIN sims s ON v.item = s.item GROUP BY 1, 2)
SELECT item, n, round(raw, 6) AS raw, round(least(greatest({_minmax('raw')}, 0), 1), 6) AS coherence FROM pairwise""",
    "evidence_join": _w(BASE, EVID, IMAGES, COH)
    + "SELECT i AS item, round(evidence, 6) AS popularity, round(coalesce(availability, 0), 6) AS availability, round(coalesce(coherence, 0), 6) AS coherence FROM evi LEFT JOIN avail a ON i = a.item LEFT JOIN cohs c ON i = c.item",
    "mean_pool_vectors": _w(IMAGES) + "SELECT item, d, round(x, 6) AS x FROM pooled",
    "user_visual_profile": _w(BASE, IMAGES)
    + """, um AS (SELECT t.u, p.d, avg(p.x) AS m FROM (SELECT DISTINCT u, i FROM train) t JOIN pooled p ON t.i = p.item GROUP BY 1, 2),
un AS (SELECT u, d, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY u)), 1e-12) AS x FROM um)
SELECT u, round(max(x) FILTER (WHERE d = 0), 6) AS x0, round(max(x) FILTER (WHERE d = 63), 6) AS x63, round(sqrt(sum(x * x)), 6) AS norm FROM un GROUP BY u""",
    "knn_graph": _w(IMAGES, _knn("g", 10)) + "SELECT src, dst, round(sim, 5) AS sim, rank FROM g",
    "knn_normalized": _w(IMAGES, _knn("g", 10)) + "SELECT src, dst, round(w, 5) AS w FROM g_n",
    "graph_max_fusion": _w(IMAGES, _knn("a", 5), _knn("b", 10)) + "SELECT src, dst, round(max(w), 5) AS w FROM (SELECT * FROM a_n UNION ALL SELECT * FROM b_n) GROUP BY 1, 2",
    "embedding_neighbours": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)), 9) AS sim FROM e a, e b)
SELECT src, dst, round(sim, 5) AS sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM s QUALIFY rank <= 5""",
    "bipartite_adjacency": _w(BASE, _light("light", 1)) + "SELECT u, i, round(w, 6) AS w FROM bip",
    "mean_aggregation": _w(BASE, _light("mean", 4)) + "SELECT dst, d, round(avg(x) + 1e-10, 6) AS x FROM edges JOIN s0 ON src = node WHERE src LIKE 'u|%' GROUP BY dst, d",
    "lightgcn_propagate": _w(BASE, _light("light", 4)) + "SELECT node, d, round(x, 7) AS x FROM light",
    "lightgcn_score_topk": _w(BASE, _light("light", 4), _LIGHT_TOP) + "SELECT u, i, score, rank FROM top",
    "lightgcn_metrics": _w(BASE, _light("light", 4), _LIGHT_TOP, _METRICS) + _MACRO,
    "nested_mask": _w(IMAGES, _MASKS) + "SELECT seed, level, item, slot FROM masks",
    "nested_mask_audit": _w(IMAGES, _MASKS) + "SELECT s.level, s.seed, s.level - 0.25 AS weaker, s.item, s.slot FROM masks s WHERE s.level > 0 AND NOT EXISTS (SELECT 1 FROM masks w WHERE w.seed = s.seed AND w.level = s.level - 0.25 AND w.item = s.item AND w.slot = s.slot)",
    "corrupted_state": _w(IMAGES, _MASKS)
    + """, kept AS (SELECT m.seed, m.level, u.* FROM masks m JOIN units u ON m.item = u.item AND m.slot = u.slot),
kc AS (
  SELECT seed, level, item, any_value(n) AS n_images, CASE WHEN any_value(n) < 2 THEN 0 ELSE (sum(s * s) - sum(q)) / (any_value(n) * (any_value(n) - 1)) END AS raw
  FROM (SELECT seed, level, item, d, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM kept GROUP BY ALL) GROUP BY seed, level, item),
b AS (SELECT min(raw) AS lo, max(raw) AS hi FROM coh)
SELECT seed, level, item, n_images, round(n_images / 32, 6) AS availability, round(least(greatest(CASE WHEN hi - lo > 1e-12 THEN (raw - lo) / (hi - lo) ELSE 0 END, 0), 1), 6) AS coherence FROM kc, b""",
    "evidence_ablation": _w(BASE, EVID) + "SELECT i, round((SELECT avg(evidence) FROM evi), 6) AS evidence FROM evi",
    "evidence_shuffle": _w(BASE, EVID)
    + """, g AS (SELECT round(evidence, 6) AS evidence, row_number() OVER (ORDER BY md5('910042|' || i), i) AS r FROM evi), t AS (SELECT i, row_number() OVER (ORDER BY i) AS r FROM evi)
SELECT i, evidence FROM t JOIN g USING (r)""",
    "seed_summary": _w(_RUNS) + "SELECT model, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS sd, count(*) AS n_seeds FROM runs WHERE level = 0 AND corruption_seed = 2026 GROUP BY model",
    "two_level_aggregate": _w(_RUNS)
    + """, inn AS (SELECT model, level, model_seed, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM runs WHERE level > 0 GROUP BY ALL)
SELECT model, level, round(avg(m), 8) AS mean, round(coalesce(stddev_samp(m), 0), 8) AS sd_between, round(avg(s), 8) AS sd_within, count(*) AS n_outer FROM inn GROUP BY ALL""",
    "relative_drop": _w(_RUNS)
    + """, m AS (SELECT model, level, avg(value) AS value FROM runs GROUP BY ALL)
SELECT a.model, a.level, round(100 * (c.value - a.value) / c.value, 6) AS drop_pct FROM m a JOIN m c ON a.model = c.model AND c.level = 0""",
    "pivot_delta": _w(_RUNS)
    + """, p AS (SELECT model_seed, max(value) FILTER (WHERE model = 'dump_alpha') AS a, max(value) FILTER (WHERE model = 'dump_bravo') AS b FROM runs WHERE level = 0 AND corruption_seed = 2026 GROUP BY 1)
SELECT model_seed, round(a, 6) AS dump_alpha, round(b, 6) AS dump_bravo, round(a - b, 6) AS delta FROM p""",
    "run_completeness": _w(_RUNS) + "SELECT model, model_seed, corruption_seed, level FROM runs WHERE model = 'dump_alpha' AND model_seed = 7 AND level = 0.5",
    "quartile_strata": _w(BASE, EVID, _STRATA)
    + "SELECT quartile, count(*) AS n_items, round(avg(n), 6) AS mean_n, round(min(evidence), 6) AS lowest, round(max(evidence), 6) AS highest, round(avg(gate), 6) AS mean_gate, round(coalesce(stddev_samp(gate), 0), 6) AS sd_gate FROM strata GROUP BY quartile",
    "qcut_bins": """
WITH x AS (SELECT CAST(image_count AS DOUBLE) AS x FROM item_images_v3 WHERE image_count IS NOT NULL),
e AS (SELECT DISTINCT unnest(quantile_cont(x, [0, 0.25, 0.5, 0.75, 1])) AS e FROM x),
b AS (SELECT lag(e) OVER (ORDER BY e) AS lo, e AS hi FROM e QUALIFY lo IS NOT NULL)
SELECT lo, hi, count(*) AS n FROM b JOIN x ON x <= hi AND (x > lo OR (x = lo AND lo = (SELECT min(e) FROM e))) GROUP BY lo, hi""",
    "spearman": _w(BASE, EVID, _STRATA)
    + """, r AS (SELECT rank() OVER (ORDER BY evidence) + (count(*) OVER (PARTITION BY evidence) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY gate) + (count(*) OVER (PARTITION BY gate) - 1) / 2.0::DOUBLE AS ry FROM strata)
SELECT 'all' AS g, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r""",
    "paired_difference": _w(BASE, _DIFFS)
    + "SELECT count(*) AS n, round(avg(diff), 6) + 0.0::DOUBLE AS mean, round(quantile_cont(diff, 0.5), 6) + 0.0::DOUBLE AS median, round(avg(CASE WHEN diff > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(avg(CASE WHEN diff = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS tie_rate FROM diffs",
    "wilcoxon_statistic": _w(BASE, _DIFFS)
    + """, r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY abs(diff)) AS c FROM diffs),
t AS (SELECT count(*) AS n, sum(CASE WHEN diff > 0 THEN rk WHEN diff = 0 THEN rk / 2 ELSE 0 END) AS w_plus, sum(CASE WHEN diff < 0 THEN rk WHEN diff = 0 THEN rk / 2 ELSE 0 END) AS w_minus,
  count(*) FILTER (WHERE diff = 0) AS zeros, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM r)
SELECT n, w_plus, w_minus, zeros, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM t""",
    "holm_adjust": f"""
WITH t AS (SELECT source_name AS test, {_unit("'p'", 'source_name')} / 10 AS p FROM source_clock),
s AS (SELECT test, p, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p) AS step FROM t)
SELECT test, round(p, 6) AS p, round(max(step) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM s""",
    "trial_best": _w(_RUNS) + "SELECT model, min(model_seed) AS model_seed, round(max(value), 8) AS value FROM (SELECT *, max(value) OVER (PARTITION BY model) AS top FROM runs WHERE level = 0) WHERE value = top GROUP BY model",
    "best_so_far": _w(_RUNS) + "SELECT model, corruption_seed, round(max(value) OVER (PARTITION BY model ORDER BY corruption_seed), 8) AS best FROM runs WHERE model_seed = 42 AND level = 0.25",
}
_near = "SELECT {q}::DOUBLE AS quantile, i, gate, round(abs(gate - (SELECT quantile_cont(gate, {q}) FROM strata)), 9) AS distance FROM strata {without} ORDER BY distance, i LIMIT 1"
ORACLE["case_selection"] = _w(
    BASE,
    EVID,
    _STRATA,
    "a AS (" + _near.format(q=0.1, without="") + ")",
    "b AS (" + _near.format(q=0.5, without="WHERE i NOT IN (SELECT i FROM a)") + ")",
    "c AS (" + _near.format(q=0.9, without="WHERE i NOT IN (SELECT i FROM a) AND i NOT IN (SELECT i FROM b)") + ")",
) + "SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"
ORACLE["vbpr_score"] = _w(
    BASE,
    IMAGES,
    f"""
nodes AS (SELECT DISTINCT 'u|' || u AS node FROM train UNION SELECT DISTINCT 'i|' || i FROM train),
st AS (SELECT node, d, {_weight('visual', 'node', 'd')} AS x FROM nodes, range(0, 8) t(d)),
em AS (SELECT e, s, {_weight('visual-e', 'CAST(e AS VARCHAR)', 's')} AS w FROM range(0, 4) a(e), range(0, 64) b(s)),
ev AS (SELECT item AS i, e, sum(w * x) AS x FROM pooled JOIN em ON s = d GROUP BY 1, 2),
bv AS (SELECT item AS i, sum({_weight('visual-b', "'0'", 'd')} * x) AS b FROM pooled GROUP BY 1),
iv AS (
  SELECT substr(node, 3) AS i, d, x FROM st WHERE node LIKE 'i|%' AND d < 4
  UNION ALL SELECT i, e + 4, x FROM ev WHERE i IN (SELECT i FROM train)),
bias AS (SELECT t.i, ({_h("'visual-bias'", 't.i')} % 20001 - 10000) / 100000.0::DOUBLE + coalesce(b, 0) AS b FROM (SELECT DISTINCT i FROM train) t LEFT JOIN bv ON t.i = bv.i),
asked AS (SELECT DISTINCT u FROM val WHERE u IN (SELECT u FROM train)),
scored AS (
  SELECT a.u, v.i, round(sum(x.x * v.x) + any_value(bias.b), 6) AS score FROM asked a JOIN st x ON x.node = 'u|' || a.u JOIN iv v ON v.d = x.d JOIN bias ON bias.i = v.i GROUP BY 1, 2),
top AS (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM scored s WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.u = s.u AND t.i = s.i) QUALIFY rank <= 20)""",
) + "SELECT u, i, score, rank FROM top"
ORACLE["audit_one_to_one"] = f"""
WITH er AS ({ORACLE['entity_resolution_1to1']})
SELECT 'ta_hotel_id' AS side, ta_hotel_id AS id, count(DISTINCT id) AS n FROM er GROUP BY 2 HAVING count(DISTINCT er.id) > 1"""
ORACLE |= {
    "checked_join": _w(BASE, EVID) + f"SELECT m.i, image_count, n FROM (SELECT {_clean('img_hotel_id')} AS i, image_count FROM item_images_v3) m LEFT JOIN evi e ON m.i = e.i",
    "indexed_pairs": _w(BASE) + "SELECT u, i, idx FROM core JOIN catalog ON i = id",
    "latest_review": """
WITH r AS (SELECT trim(user_id) AS u, trim(hotel_id) AS h, row_id, "timestamp" FROM merged_hotelrec WHERE user_id IS NOT NULL AND hotel_id IS NOT NULL)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY u, h ORDER BY row_id DESC) = 1""",
    "display_order": """
SELECT CASE source_name WHEN 'dump_alpha' THEN 'full' WHEN 'dump_bravo' THEN 'backbone' ELSE source_name END AS model,
  CASE source_name WHEN 'dump_bravo' THEN 0 WHEN 'dump_alpha' THEN 1 ELSE 2 END::BIGINT AS position FROM source_clock""",
    "missing_vectors": _w(IMAGES) + f"SELECT DISTINCT {_clean('img_hotel_id')} AS item FROM item_images_v3 WHERE img_hotel_id IS NOT NULL AND {_clean('img_hotel_id')} NOT IN (SELECT item FROM usable WHERE item IS NOT NULL)",
    "shared_names": f"SELECT {_core('ta_name')} AS core FROM item_images_v3 INTERSECT SELECT {_core('hotel_name')} FROM hotel_info",
    "all_users": _w(BASE) + "SELECT DISTINCT u FROM split WHERE split <> 'train'",
    "evidence_summary": _w(BASE, EVID)
    + "SELECT min(n) AS lowest, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median, round(avg(n), 6) AS mean, max(n) AS highest, count(*) FILTER (WHERE n = 1) AS n_single FROM evi",
    "boolean_checks": _w(BASE) + "SELECT split, bool_and(u IS NOT NULL) AS all_known, bool_or(i < '2') AS any_low FROM split GROUP BY split",
    "ablation_table": _w(_RUNS)
    + """, m AS (SELECT model, avg(value) AS v FROM runs WHERE level = 0 AND corruption_seed = 2026 GROUP BY model), f AS (SELECT v AS full_v FROM m WHERE model = 'dump_alpha')
SELECT model, round(100 * (v - full_v) / full_v, 6) AS change_pct FROM m, f""",
    "early_stopping": _w(_RUNS)
    + """, r AS (SELECT model, corruption_seed - 2025 AS epoch, value FROM runs WHERE model_seed = 42 AND level = 0.25),
g AS (SELECT *, coalesce(value > max(value) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-8, true) AS gain FROM r),
l AS (SELECT *, max(CASE WHEN gain THEN epoch END) OVER (PARTITION BY model ORDER BY epoch) AS last_gain FROM g),
s AS (SELECT model, coalesce(min(CASE WHEN epoch - last_gain >= 2 THEN epoch END), max(epoch)) AS stopped_at FROM l GROUP BY model)
SELECT l.model, max(CASE WHEN gain THEN epoch END) AS best_epoch, stopped_at, round(max(value), 8) AS best FROM l JOIN s ON l.model = s.model AND epoch <= stopped_at GROUP BY l.model, stopped_at""",
    "trial_dedupe": _w(_RUNS) + "SELECT model, corruption_seed, round(value, 8) AS value FROM runs WHERE level = 0.5 AND model_seed = 7 AND corruption_seed = 2030",
    "score_parity": "SELECT trim(user_id) AS u, trim(img_hotel_id) AS i FROM multimodal_interactions_v3 WHERE false",
    "stress_summary": "SELECT seed, level, sum(n_images)::BIGINT AS n_images, round(avg(availability), 5) AS availability, round(avg(coherence), 5) AS coherence FROM (" + ORACLE["corrupted_state"] + ") GROUP BY seed, level",
}
_STD = "SELECT trim(user_id) AS user_id, trim(hotel_id) AS hotel_id, CASE WHEN NOT isnan(rating) THEN CAST(rating AS DOUBLE) END AS rating, trim(coalesce(review_text, '')) AS review_text FROM merged_hotelrec"
ORACLE |= {
    # an empty field of a CSV file is null
    "csv_source": f"SELECT hotel_id, count(*) AS n, round(sum(rating), 4) AS total FROM ({_STD} WHERE user_id <> '' AND hotel_id <> '') GROUP BY 1",
    "json_source": f"SELECT user_id, count(*) AS n, sum(length(review_text))::BIGINT AS n_chars FROM ({_STD} WHERE user_id IS NOT NULL AND hotel_id IS NOT NULL) GROUP BY 1",
    "headless_csv_source": "SELECT nullif(image_source, '') AS image_source, count(*) AS n, count(DISTINCT image_url) AS n_urls FROM train_set WHERE image_url IS NOT NULL GROUP BY 1",
    "id_map_source": ORACLE["dense_index_map"],
    "append_source": "SELECT source_name, 2::BIGINT AS n FROM source_clock",
    "file_discovery": "SELECT unnest(['documents', 'nation']) AS name",
    "audit_index": "SELECT source_name AS fault, 0::BIGINT AS n FROM source_clock WHERE false",
    "audit_unmapped": _w(BASE) + "SELECT DISTINCT i AS id FROM split WHERE i NOT IN (SELECT id FROM catalog)",
    "audit_evidence_range": "SELECT item FROM (" + ORACLE["evidence_join"] + ") WHERE popularity NOT BETWEEN 0 AND 1 OR availability NOT BETWEEN 0 AND 1 OR coherence NOT BETWEEN 0 AND 1",
    "audit_metrics_range": "SELECT u FROM (" + ORACLE["eval_user_metrics"] + ") WHERE hr10 NOT BETWEEN 0 AND 1 OR hr20 NOT BETWEEN 0 AND 1 OR ndcg10 NOT BETWEEN 0 AND 1 OR ndcg20 NOT BETWEEN 0 AND 1 OR mrr20 NOT BETWEEN 0 AND 1",
    "audit_run_keys": "SELECT 'dump_alpha' AS model, 7::INT AS model_seed, 2026::BIGINT AS corruption_seed, 0.25::DOUBLE AS level, 2::BIGINT AS n",
    "audit_alignment": "SELECT source_name AS id FROM source_clock WHERE false",
    "benchmark_sizes": _w(BASE)
    + """SELECT count(*) AS n_rows, count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items, (SELECT count(*) FROM (SELECT u FROM val GROUP BY u HAVING count(*) > 1)) AS n_many_targets FROM split""",
}
_BOTH = f"""
WITH p AS ({ORACLE['eval_user_metrics']}), l AS ({_w(BASE, _light('light', 4), _LIGHT_TOP, _METRICS) + _PER_USER}),
long AS (
  {' UNION ALL '.join(f"SELECT '{m}' AS metric, round(l.{m} - p.{m}, 6) AS diff FROM l JOIN p USING (u)" for m in ('hr10', 'hr20', 'ndcg10', 'ndcg20', 'mrr20'))})
"""
ORACLE |= {
    "results_paired": _BOTH
    + """, r AS (SELECT metric, diff, rank() OVER (PARTITION BY metric ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY metric, abs(diff)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY metric, abs(diff)) AS c FROM long),
t AS (SELECT metric, count(*) AS n, avg(diff) AS mean, quantile_cont(diff, 0.5) AS median, avg(CASE WHEN diff > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(CASE WHEN diff = 0 THEN 1.0::DOUBLE ELSE 0 END) AS tie_rate,
  sum(CASE WHEN diff > 0 THEN rk WHEN diff = 0 THEN rk / 2 ELSE 0 END) AS w_plus, sum(CASE WHEN diff < 0 THEN rk WHEN diff = 0 THEN rk / 2 ELSE 0 END) AS w_minus, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM r GROUP BY metric)
SELECT metric, n, round(mean, 6) + 0.0::DOUBLE AS mean, round(median, 6) + 0.0::DOUBLE AS median, round(win_rate, 6) AS win_rate, round(tie_rate, 6) AS tie_rate, w_plus, w_minus,
  round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(nullif(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48, 0)), 6) AS z FROM t""",
    "degradation_advantage": _w(_RUNS)
    + """, c AS (SELECT model, model_seed, avg(value) AS clean FROM runs WHERE level = 0 GROUP BY 1, 2),
l AS (SELECT r.*, 100 * (clean - value) / nullif(clean, 0) AS lost FROM runs r JOIN c USING (model, model_seed) WHERE level > 0),
g AS (SELECT model_seed, corruption_seed, level, max(lost) FILTER (WHERE model = 'dump_alpha') AS a, max(lost) FILTER (WHERE model = 'dump_bravo') AS b FROM l GROUP BY 1, 2, 3)
SELECT model_seed, corruption_seed, level, round(a, 6) AS drop_a, round(b, 6) AS drop_b, round(b - a, 6) AS advantage FROM g""",
    "train_text": _w(BASE)
    + f""", reg AS (SELECT trim(ta_hotel_id) AS h, {_clean('img_hotel_id')} AS i FROM item_images_v3),
rv AS (SELECT trim(user_id) AS u, trim(hotel_id) AS h, trim(coalesce(review_text, '')) AS t, row_id FROM merged_hotelrec),
kept AS (SELECT r.u, g.i, r.t, r.row_id FROM rv r JOIN reg g ON r.h = g.h WHERE g.i IS NOT NULL AND r.t <> '' AND (r.u, g.i) IN (SELECT (u, i) FROM train)),
f AS (SELECT u, i, arg_min(t, row_id) AS t FROM kept GROUP BY u, i)
SELECT i, count(*) AS n_reviews, sum(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')))::BIGINT AS n_words FROM f GROUP BY i""",
    "audits_planted": _w(BASE)
    + """, m AS (SELECT u, i, split, substr(md5(u || '|' || i), 1, 1) AS mark FROM split),
broken AS (
  SELECT u, i, split FROM m UNION ALL SELECT u, i, 'test' FROM m WHERE mark = '0' AND split = 'train' UNION ALL SELECT u, i, split FROM m WHERE mark = '1'
  UNION ALL SELECT 'nobody', i, split FROM m WHERE mark = '2' AND split = 'val' UNION ALL SELECT u, 'nothing', split FROM m WHERE mark = '3' AND split = 'val'),
known AS (SELECT DISTINCT u, i FROM broken WHERE split = 'train')
SELECT 'overlap' AS audit, u, i FROM broken GROUP BY u, i HAVING count(DISTINCT split) > 1
UNION SELECT 'duplicate', u, i FROM broken GROUP BY split, u, i HAVING count(*) > 1
UNION SELECT 'cold_user', u, NULL FROM broken WHERE split <> 'train' AND u NOT IN (SELECT u FROM known)
UNION SELECT 'cold_item', NULL, i FROM broken WHERE split <> 'train' AND i NOT IN (SELECT i FROM known)
UNION SELECT 'held_out_seen', u, i FROM broken WHERE split <> 'train' AND (u, i) IN (SELECT (u, i) FROM known)
UNION SELECT 'unmapped', NULL, i FROM broken WHERE i NOT IN (SELECT id FROM catalog)
UNION SELECT 'not_one_to_one', u, NULL FROM broken GROUP BY u HAVING count(DISTINCT split) > 1""",
}
ORACLE |= {
    "negatives_ranked": _w(BASE)
    + f""", size AS (SELECT count(*) AS size FROM catalog),
draws AS (SELECT t.u, t.i, k, {_h("'one'", 't.u', 't.i', 'CAST(k AS VARCHAR)', "'1'")} % size AS idx, {_h("'one'", 't.u', 't.i', 'CAST(k AS VARCHAR)', "'rank'")} AS h, size FROM train t, range(1, 3) r(k), size),
named AS (SELECT d.*, c.id AS candidate, (d.u, c.id) IN (SELECT (u, i) FROM split) AS seen FROM draws d JOIN catalog c USING (idx)),
askers AS (SELECT DISTINCT u FROM named WHERE seen),
unseen AS (
  SELECT a.u, c.id, row_number() OVER (PARTITION BY a.u ORDER BY c.idx) - 1 AS r, count(*) OVER (PARTITION BY a.u) AS n
  FROM askers a CROSS JOIN catalog c WHERE (a.u, c.id) NOT IN (SELECT (u, i) FROM split))
SELECT u, i, k, candidate AS negative FROM named WHERE NOT seen
UNION ALL SELECT n.u, n.i, n.k, x.id FROM named n JOIN unseen x ON n.u = x.u AND x.r = n.h % x.n WHERE n.seen""",
}
