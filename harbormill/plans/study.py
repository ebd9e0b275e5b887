"""Queries of the recommendation study over the project's hotel tables, each with its SQL.

The base is one chain: valid interactions, positives with images, unique pairs, item core, per-user split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.functions import names, vectors
from harbormill.functions.ids import clean_id, is_invalid_user, strip_float_suffix
from harbormill.operators import audit, evidence, graph, interactions, joins, models, rank, sampling, split, stats, tuning
from harbormill.plans.study_sql import ORACLE  # noqa: F401
from harbormill.session import scratch, table, written
from harbormill.sources import readers

DIMS = 4


def _interactions(s: SparkSession, d: str) -> DataFrame:
    return interactions.user_items(table(s, d, "multimodal_interactions_v3"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    rows = interactions.with_media(interactions.positives(_interactions(s, d)), table(s, d, "item_images_v3"))
    return interactions.unique_pairs(rows)


def _core(s: SparkSession, d: str) -> DataFrame:
    return interactions.item_core(_pairs(s, d), 5)


def _split(s: SparkSession, d: str) -> DataFrame:
    return split.user_split(_core(s, d).select("u", "i"))


def _train(s: SparkSession, d: str) -> DataFrame:
    return _split(s, d).filter("split = 'train'").select("u", "i")


def _images(s: SparkSession, d: str) -> DataFrame:
    return evidence.item_images(table(s, d, "clip_per_image_v4"), clean_id(F.col("img_hotel_id")))


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _r(*cols: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in cols]


# --- sources, scalar functions, filters -------------------------------------------------------------------------------


def interactions_standardize(s, d):
    return readers.standardize(table(s, d, "merged_hotelrec"))


def implicit_filter(s, d):
    return interactions.positives(_interactions(s, d)).groupBy("u", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("labels"))


def pair_aggregate(s, d):
    return interactions.aggregate_pairs(table(s, d, "merged_hotelrec"), F.trim("user_id"), F.trim("hotel_id"), F.col("review_text"), "row_id")


def item_kcore(s, d):
    return _core(s, d).select("u", "i", "max_rating", "n_rows")


def name_normalize(s, d):
    return table(s, d, "hotel_info").select("hotel_name", names.core_name(F.col("hotel_name")).alias("core")).distinct()


def slug_parse(s, d):
    p = table(s, d, "merged_hotelrec").select(F.trim("hotel_id").alias("url")).distinct().withColumn("p", names.parse_slug(F.col("url")))
    return p.select("url", F.col("p.name").alias("name"), F.col("p.loc").alias("loc"))


def entity_resolution_1to1(s, d):
    a, b = table(s, d, "item_images_v3"), table(s, d, "hotel_info")
    return interactions.resolve_one_to_one(a, "ta_hotel_id", names.parse_slug(F.col("ta_hotel_id"))["name"], b, "id", F.col("hotel_name"))


def registry_collect_list(s, d):
    lists = interactions.image_lists(table(s, d, "train_set"), clean_id(F.col("hotel_id")), F.trim("image_url"), 200)
    return lists.withColumn("urls", F.array_join("urls", " "))


def registry_lookup(s, d):
    """Left lookup of image lists for registry rows, missing ones as empty; the list column is dropped for the audit view."""
    lists = interactions.image_lists(table(s, d, "train_set"), clean_id(F.col("hotel_id")), F.trim("image_url"), 200).groupBy(F.col("hotel").alias("img_hotel_id")).agg(F.sum("n").alias("n"))
    reg = table(s, d, "item_images_v3").select(clean_id(F.col("img_hotel_id")).alias("img_hotel_id"), "core_name", "available_images", "image_count").drop("available_images")
    return reg.join(lists, "img_hotel_id", "left").select("img_hotel_id", "core_name", F.coalesce("image_count", F.lit(0)).alias("image_count"), F.coalesce("n", F.lit(0)).alias("n_listed"))


def invalid_user_removal(s, d):
    bad = is_invalid_user(F.col("user_id"))
    return table(s, d, "merged_hotelrec").groupBy("source_dump").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_removed"))


def id_suffix_strip(s, d):
    return table(s, d, "train_set").select("row_id", strip_float_suffix(F.col("hotel_id")).alias("hotel"))


def resume_antijoin(s, d):
    todo = table(s, d, "train_set").select(F.trim("image_url").alias("url")).distinct()
    done = todo.filter(F.substring(F.md5("url"), 1, 1) < "8")
    return readers.remaining(todo, done, "url")


def config_signature(s, d):
    return table(s, d, "source_clock").select("source_name", readers.signature(F.col("source_name"), F.col("tz_name"), F.col("day_first").cast("string")).alias("signature"))


def failure_histogram(s, d):
    v = table(s, d, "clip_per_image_v4")
    size = F.size("vec")
    reason = (
        F.when(F.col("vec").isNull(), "missing").when(size == 0, "empty").when(size != 64, "wrong_length").when(F.exists("vec", lambda x: x.isNull() | F.isnan(x)), "nan").when(~F.exists("vec", lambda x: x != 0), "all_zero").otherwise("ok")
    )
    return v.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(10)


def text_coverage(s, d):
    """Words and reviews per hotel: the first non-empty review of each pair among the training pairs' hotels."""
    rows = table(s, d, "merged_hotelrec").select(F.trim("user_id").alias("u"), F.trim("hotel_id").alias("h"), names.clean_text(F.col("review_text")).alias("t"), "row_id").filter("u is not null and h is not null and t != ''")
    first = rows.groupBy("u", "h").agg(F.min_by("t", "row_id").alias("t"))
    return first.groupBy("h").agg(F.count(F.lit(1)).alias("n_reviews"), F.sum(names.word_count(F.col("t"))).alias("n_words"))


def format_metrics(s, d):
    m = table(s, d, "item_images_v3").filter("image_count is not null").groupBy("ta_city").agg(F.avg("image_count").alias("m"))
    return m.select("ta_city", F.format_string("%.1f", F.round("m", 1)).alias("shown"), names.slug(F.col("ta_city")).alias("slug"))


# --- split, index, histories, negatives ------------------------------------------------------------------------------


def split_v6(s, d):
    return _split(s, d)


def split_v3_rows(s, d):
    rows = interactions.positives(_interactions(s, d)).withColumn("rating", F.col("rating"))
    numbered = rows.groupBy("u", "i").agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
    raw = numbered.select("u", F.concat_ws("#", "i", F.col("k").cast("string")).alias("i"))
    return split.user_split(raw, seed=7, dense=3)


def split_summary(s, d):
    return split.summary(_split(s, d))


def audit_overlap(s, d):
    return audit.overlaps(_split(s, d))


def audit_duplicates(s, d):
    return audit.duplicates(_split(s, d))


def audit_cold_users(s, d):
    return audit.cold(_split(s, d), "u")


def audit_cold_items(s, d):
    return audit.cold(_split(s, d), "i")


def audit_held_out(s, d):
    return audit.held_out_seen(_split(s, d))


def audit_functional(s, d):
    rows = table(s, d, "multimodal_interactions_v3").select(F.trim("hotel_id").alias("h"), clean_id(F.col("img_hotel_id")).alias("i")).filter("h is not null")
    return interactions.not_functional(rows, "h", "i")


def audit_one_to_one(s, d):
    er = entity_resolution_1to1(s, d).select("ta_hotel_id", "id")
    return audit.not_one_to_one(er, "ta_hotel_id", "id")


def audit_vectors(s, d):
    v = table(s, d, "clip_per_image_v4")
    return v.filter(~vectors.usable(F.col("vec"), 64)).select("vec_id", F.coalesce(F.size("vec"), F.lit(-1)).cast("long").alias("n"))


def dense_index_map(s, d):
    return split.dense_index(_core(s, d), "i")


def user_index_map(s, d):
    return split.dense_index(_core(s, d), "u")


def train_history(s, d):
    return split.histories(_train(s, d)).select("u", F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n"))


def seen_union(s, d):
    return _split(s, d).groupBy("u").agg(F.count_distinct("i").alias("n_seen"))


def negatives_offline(s, d):
    sp = written(_split(s, d), "split")
    return _long(sampling.negatives(sp.filter("split = 'train'"), sp, split.dense_index(sp, "i"), 4, "neg"), "k")


def negatives_online(s, d):
    tr = written(_train(s, d), "train")
    return _long(sampling.negatives(tr, tr, split.dense_index(tr, "i"), 1, "online"), "k")


def negatives_ranked(s, d):
    """Negatives from one candidate a draw, so that many draws take the second way, a rank among the user's unseen items."""
    sp = written(_split(s, d), "split")
    return _long(sampling.negatives(sp.filter("split = 'train'"), sp, split.dense_index(sp, "i"), 2, "one", attempts=1), "k")


def negative_audit(s, d):
    """Negatives that the user has seen: none."""
    sp = written(_split(s, d), "split")
    n = sampling.negatives(sp.filter("split = 'train'"), sp, split.dense_index(sp, "i"), 4, "neg")
    return n.select("u", F.col("negative").alias("i")).join(sp, ["u", "i"], "left_semi")


def user_subset(s, d):
    return sampling.subset(_split(s, d).filter("split = 'val'"), "u", 50, "subset")


# --- ranking and metrics ---------------------------------------------------------------------------------------------


def popularity_rank(s, d):
    return _long(rank.popularity(_train(s, d)), "rank")


def _popular(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sp = written(_split(s, d), "split")
    val = sp.filter("split = 'val'").select("u", "i")
    return rank.popular_unseen(sp.filter("split = 'train'").select("u", "i"), val), val


def popularity_topk(s, d):
    return _long(_popular(s, d)[0], "rank")


def eval_user_metrics(s, d):
    ranked, val = _popular(s, d)
    return rank.user_metrics(ranked, val).select("u", "n_relevant", *_r(*rank.METRICS))


def eval_macro(s, d):
    ranked, val = _popular(s, d)
    return rank.macro(rank.user_metrics(ranked, val)).select("n_users", *_r(*rank.METRICS))


# --- evidence, vectors, graphs ---------------------------------------------------------------------------------------


def user_history_evidence(s, d):
    return evidence.log_evidence(_train(s, d), "u").select("u", "n", *_r("evidence"))


def item_popularity_evidence(s, d):
    return evidence.log_evidence(_train(s, d), "i").select("i", "n", *_r("evidence"))


def image_availability(s, d):
    return evidence.availability(_images(s, d)).select("item", "n_images", *_r("availability"))


def visual_coherence(s, d):
    return evidence.coherence(_images(s, d)).select("item", "n", *_r("raw", "coherence"))


def evidence_join(s, d):
    im = written(_images(s, d), "images")
    pop = evidence.log_evidence(_train(s, d), "i").select(F.col("i").alias("item"), F.col("evidence").alias("popularity"))
    av, co = evidence.availability(im).select("item", "availability"), evidence.coherence(im).select("item", "coherence")
    # one row per item on every side
    return pop.join(av, "item", "left").join(co, "item", "left").select("item", F.round("popularity", 6).alias("popularity"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("availability", "coherence")])


def mean_pool_vectors(s, d):
    p = evidence.pooled(_images(s, d), "item")
    return p.select("item", F.posexplode("vec").alias("d", "x")).select("item", F.col("d").cast("long").alias("d"), *_r("x"))


def user_visual_profile(s, d):
    p = evidence.user_profiles(_train(s, d), evidence.pooled(_images(s, d), "item"))
    return p.select("u", F.round(F.col("vec")[0], 6).alias("x0"), F.round(F.col("vec")[63], 6).alias("x63"), F.round(vectors.norm(F.col("vec")), 6).alias("norm"))


def _knn(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    return graph.nearest_items(evidence.pooled(_images(s, d), "item"), "item", "vec", k)


def knn_graph(s, d):
    return _long(_knn(s, d).select("src", "dst", F.round("sim", 5).alias("sim"), "rank"), "rank")


def knn_normalized(s, d):
    return graph.normalized(_knn(s, d)).select("src", "dst", F.round("w", 5).alias("w"))


def graph_max_fusion(s, d):
    a, b = graph.normalized(_knn(s, d, 5)), graph.normalized(_knn(s, d, 10))
    return graph.max_fusion(a, b).select("src", "dst", F.round("w", 5).alias("w"))


def embedding_neighbours(s, d):
    e = table(s, d, "embeddings")
    return _long(graph.nearest_items(e, "vec_id", "embedding", 5).select("src", "dst", F.round("sim", 5).alias("sim"), "rank"), "rank")


def bipartite_adjacency(s, d):
    return graph.bipartite(_train(s, d)).select("u", "i", *_r("w"))


def mean_aggregation(s, d):
    tr = written(_train(s, d), "train")
    edges = tr.select(F.concat(F.lit("u|"), "u").alias("src"), F.concat(F.lit("i|"), "i").alias("dst"))
    m = graph.mean_neighbours(edges, models.hash_states(tr, DIMS, "mean"))
    # weights have five digits, so means often lie midway between two roundings
    return m.select("dst", F.col("d").cast("long").alias("d"), F.round(F.col("x") + 1e-10, 6).alias("x"))


def lightgcn_propagate(s, d):
    tr = written(_train(s, d), "train")
    p = graph.propagate(tr, models.hash_states(tr, DIMS, "light"), 2)
    return p.select("node", F.col("d").cast("long").alias("d"), F.round("x", 7).alias("x"))


def lightgcn_score_topk(s, d):
    sp = written(_split(s, d), "split")
    tr = sp.filter("split = 'train'").select("u", "i")
    u, i = models.light_vectors(tr, DIMS)
    val = sp.filter("split = 'val'").select("u").distinct()
    return _long(graph.score_blocks(u.join(val, "u", "left_semi"), i, 20, tr), "rank")


def lightgcn_metrics(s, d):
    sp = written(_split(s, d), "split")
    tr, val = (sp.filter(F.col("split") == x).select("u", "i") for x in ("train", "val"))
    u, i = models.light_vectors(tr, DIMS)
    top = graph.score_blocks(u.join(val.select("u").distinct(), "u", "left_semi"), i, 20, tr)
    return rank.macro(rank.user_metrics(top, val)).select("n_users", *_r(*rank.METRICS))


def _item_table(s: SparkSession, d: str) -> DataFrame:
    return evidence.pooled(_images(s, d), "item").withColumnRenamed("item", "i")


def vbpr_score(s, d):
    sp = written(_split(s, d), "split")
    tr = sp.filter("split = 'train'").select("u", "i")
    u, i = models.visual_model(tr, _item_table(s, d), 64, DIMS)
    return _long(graph.score_blocks(u.join(sp.filter("split = 'val'").select("u").distinct(), "u", "left_semi"), i, 20, tr), "rank")


def _hashed_text(s: SparkSession, d: str) -> DataFrame:
    """Text vectors of the items: TF-IDF of their documents' words, reduced."""
    docs = table(s, d, "documents").filter("hotel_id is not null and text is not null")
    reg = table(s, d, "item_images_v3").select(F.col("ta_hotel_id").alias("h"), clean_id(F.col("img_hotel_id")).alias("i"))
    joined = docs.join(reg, docs["hotel_id"] == reg["h"]).select("i", "text").filter("i is not null")
    return models.tfidf_vectors(joined, "i", "text")


def tfidf_svd(s, d):
    return _hashed_text(s, d).select("i", F.size("vec").alias("dims"), F.round(vectors.norm(F.col("vec")), 4).alias("norm"))


def _model_query(build):
    def run(s, d):
        sp = written(_split(s, d), "split")
        tr, val = (sp.filter(F.col("split") == x).select("u", "i") for x in ("train", "val"))
        u, i = build(s, d, tr)
        top = graph.score_blocks(u.join(val.select("u").distinct(), "u", "left_semi"), i, 20, tr)
        return rank.macro(rank.user_metrics(top, val)).select("n_users", *_r(*rank.METRICS))

    return run


text_only_metrics = _model_query(lambda s, d, tr: models.text_model(tr, written(_hashed_text(s, d), "text"), 32))
two_branch_metrics = _model_query(lambda s, d, tr: models.two_branch_model(tr, {"text": (written(_hashed_text(s, d), "text"), 32), "visual": (_item_table(s, d), 64)}))
summed_metrics = _model_query(lambda s, d, tr: models.summed_model(tr, {"text": (written(_hashed_text(s, d), "text"), 32), "visual": (_item_table(s, d), 64)}))
pairwise_trained_metrics = _model_query(lambda s, d, tr: models.train_pairwise(tr))


def _spectral(s, d, tr):
    text = models.projected(written(_hashed_text(s, d), "text"), "i", 16, "spectral-t", 32)
    visual = models.projected(_item_table(s, d), "i", 16, "spectral-v", 64)
    items = models.spectral_items(text, visual)
    u, i = models.light_vectors(tr, 16, salt="spectral")
    return u, models.add_vectors(i, items, "i")


spectral_metrics = _model_query(_spectral)


def gated_pair_scores(s, d):
    """Pair scores and evidence gates of the gated model for all validation pairs."""
    sp = written(_split(s, d), "split")
    tr, val = (sp.filter(F.col("split") == x).select("u", "i") for x in ("train", "val"))
    im = written(_images(s, d), "images")
    dims = 16
    tu, ti = models.light_vectors(tr, dims, salt="gate-t")
    vu, vi = models.light_vectors(tr, dims, salt="gate-v")
    tokens = models.projected(im.select(F.concat_ws("#", "item", F.col("slot").cast("string")).alias("k"), F.col("vec")), "k", dims, "gate-img", 64)
    tokens = tokens.select(F.substring_index("k", "#", 1).alias("i"), F.substring_index("k", "#", -1).cast("int").alias("slot"), "vec")
    tokens = tokens.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "vec"))), lambda t: t["vec"]).alias("images"))
    hist = evidence.log_evidence(tr, "u").select("u", F.col("evidence").alias("h"))
    pop = evidence.log_evidence(tr, "i").select("i", F.col("evidence").alias("p"))
    av = evidence.availability(im).select(F.col("item").alias("i"), "availability")
    co = evidence.coherence(im).select(F.col("item").alias("i"), "coherence")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    j = (
        val.join(hist, "u", "left").join(pop, "i", "left").join(av, "i", "left").join(co, "i", "left").join(tokens, "i", "left")
        .join(tu.withColumnRenamed("vec", "tu"), "u").join(vu.withColumnRenamed("vec", "vu"), "u").join(ti.withColumnRenamed("vec", "ti"), "i").join(vi.withColumnRenamed("vec", "vi"), "i")
    )
    full = j.withColumn("ev", F.array(z(F.col("h")), z(F.col("p")), z(F.col("availability")), z(F.col("coherence"))))
    scores = models.gated_scores(full, models.GatedScorer(dims))
    return scores.select("u", "i", *_r("score", "gate"))


# --- corruption, ablation --------------------------------------------------------------------------------------------

SEEDS, LEVELS = [2026, 2027, 2028, 2029, 2030], [0.0, 0.25, 0.5, 0.75]


def nested_mask(s, d):
    return sampling.nested_masks(_images(s, d).select("item", "slot"), SEEDS, LEVELS)


def nested_mask_audit(s, d):
    return audit.not_nested(written(nested_mask(s, d), "masks"))


def corrupted_state(s, d):
    """Availability and coherence of every item under every mask, scaled with the clean bounds."""
    im = written(_images(s, d), "images")
    clean = evidence.coherence_raw(im).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    masks = sampling.nested_masks(im.select("item", "slot"), SEEDS, LEVELS)
    keys = ["seed", "level", "item"]
    kept = masks.join(im, ["item", "slot"])
    state = evidence.coherence_raw(kept, keys=keys).withColumn("availability", F.col("n") / evidence.SLOTS)
    state = evidence.scaled_by(state, "raw", clean, "coherence")
    return state.select(*keys, F.col("n").alias("n_images"), *_r("availability", "coherence"))


def evidence_ablation(s, d):
    e = evidence.log_evidence(_train(s, d), "i")
    return e.crossJoin(F.broadcast(e.agg(F.avg("evidence").alias("mean")))).select("i", F.round("mean", 6).alias("evidence"))


def evidence_shuffle(s, d):
    e = evidence.log_evidence(_train(s, d), "i").select("i", *_r("evidence"))
    return sampling.permuted(e, "i", "evidence", "910042")


# --- statistics over run tables that md5 defines ---------------------------------------------------------------------


def _unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from md5."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(1000000)) / 1000000.0


def _runs(s: SparkSession, d: str) -> DataFrame:
    """(model, model_seed, corruption_seed, level, value): one value per source and seed, made from the clock table."""
    base = table(s, d, "source_clock").select(F.col("source_name").alias("model"))
    grid = base.withColumn("model_seed", F.explode(F.array(F.lit(1), F.lit(7), F.lit(42)))).withColumn("corruption_seed", F.explode(F.sequence(F.lit(2026), F.lit(2030)))).withColumn("level", F.explode(F.array(*[F.lit(x) for x in LEVELS])))
    h = _unit_hash(F.col("model"), F.col("model_seed").cast("string"), F.when(F.col("level") == 0, "0").otherwise(F.col("corruption_seed").cast("string")), (F.col("level") * 100).cast("int").cast("string"))
    return grid.withColumn("value", 0.02 + 0.01 * h - 0.004 * F.col("level"))


def seed_summary(s, d):
    r = _runs(s, d).filter("level = 0 and corruption_seed = 2026")
    return stats.seed_summary(r, "model", "value").select("model", *[F.round(c, 8).alias(c) for c in ("mean", "sd")], "n_seeds").orderBy(F.desc("mean"), "model")


def two_level_aggregate(s, d):
    r = stats.two_level(_runs(s, d).filter("level > 0"), ["model", "level"], "model_seed", "value")
    return r.select("model", "level", *[F.round(c, 8).alias(c) for c in ("mean", "sd_between", "sd_within")], "n_outer")


def relative_drop(s, d):
    m = _runs(s, d).groupBy("model", "level").agg(F.avg("value").alias("value"))
    return stats.relative_drop(m, "model", "level", "value").select("model", "level", *_r("drop_pct"))


def pivot_delta(s, d):
    r = _runs(s, d).filter("level = 0 and corruption_seed = 2026 and model in ('dump_alpha', 'dump_bravo')")
    p = r.groupBy("model_seed").pivot("model", ["dump_alpha", "dump_bravo"]).agg(F.first("value"))
    return p.select("model_seed", *_r("dump_alpha", "dump_bravo"), F.round(F.col("dump_alpha") - F.col("dump_bravo"), 6).alias("delta"))


def run_completeness(s, d):
    return audit.missing_runs(_runs(s, d).filter("not (model = 'dump_alpha' and model_seed = 7 and level = 0.5)"), ["model", "model_seed", "corruption_seed", "level"]).withColumn("corruption_seed", F.col("corruption_seed").cast("long"))


def _strata(s: SparkSession, d: str) -> DataFrame:
    e = evidence.log_evidence(_train(s, d), "i").select("i", "n", F.round("evidence", 9).alias("evidence"))
    return stats.quartiles(e, "evidence").withColumn("gate", _unit_hash("gate", F.col("i")))


def quartile_strata(s, d):
    return _strata(s, d).groupBy("quartile").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.min("evidence"), 6).alias("lowest"), F.round(F.max("evidence"), 6).alias("highest"), F.round(F.avg("gate"), 6).alias("mean_gate"), F.round(stats.sd("gate"), 6).alias("sd_gate"))


def qcut_bins(s, d):
    im = table(s, d, "item_images_v3").filter("image_count is not null").select(F.col("image_count").cast("double").alias("x"))
    return stats.quantile_bins(im, "x")


def spearman(s, d):
    r = _strata(s, d).withColumn("g", F.lit("all"))
    return stats.spearman(r, "evidence", "gate", ["g"]).select("g", *_r("rho"), "n")


def _diffs(s: SparkSession, d: str) -> DataFrame:
    users = _split(s, d).filter("split = 'val'").select("u").distinct()
    runs = users.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(7), F.lit(42))))
    value = lambda m: F.floor(_unit_hash(m, F.col("u"), F.col("seed").cast("string")) * 4) / 4
    a, b = runs.withColumn("v", value("a")), runs.withColumn("v", value("b"))
    return stats.paired(a, b, "v").withColumn("diff", F.round("diff", 9))


def paired_difference(s, d):
    return stats.difference_summary(_diffs(s, d)).select("n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "median", "win_rate", "tie_rate")])


def wilcoxon_statistic(s, d):
    return stats.wilcoxon(_diffs(s, d)).select("n", "w_plus", "w_minus", "zeros", *_r("z"))


def holm_adjust(s, d):
    t = table(s, d, "source_clock").select(F.col("source_name").alias("test"), (_unit_hash("p", F.col("source_name")) / 10).alias("p"))
    return stats.holm(t).select("test", *_r("p", "adjusted"))


def bootstrap_ci(s, d):
    return stats.bootstrap_mean(_diffs(s, d)).select("n", *_r("mean", "lo", "hi"))


def hierarchical_bootstrap(s, d):
    return stats.hierarchical_bootstrap(_runs(s, d).filter("level = 0.75 and model = 'dump_alpha'"), "value").select(*_r("mean", "lo", "hi"))


def case_selection(s, d):
    g = _strata(s, d).select("i", "gate")
    return stats.pick_cases(g, "gate", ["i"])


def trial_best(s, d):
    r = _runs(s, d).filter("level = 0").groupBy("model").agg(F.max(F.struct("value", -F.col("model_seed"))).alias("b"))
    return r.select("model", (-F.col("b.col2")).alias("model_seed"), F.round("b.value", 8).alias("value"))


def best_so_far(s, d):
    r = _runs(s, d).filter("model_seed = 42 and level = 0.25")
    return r.select("model", F.col("corruption_seed").cast("long").alias("corruption_seed"), F.round(F.max("value").over(W.partitionBy("model").orderBy("corruption_seed")), 8).alias("best"))


def _rankings(s: SparkSession, d: str, salts: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """Per-user metrics (u, seed, metrics...) on the validation pairs: of the propagated model for each seed, and of the most popular items."""
    sp = written(_split(s, d), "split")
    tr, val = (sp.filter(F.col("split") == x).select("u", "i") for x in ("train", "val"))
    asked, a = val.select("u").distinct(), None
    for seed, salt in salts.items():
        u, i = models.light_vectors(tr, DIMS, salt=salt)
        m = rank.user_metrics(graph.score_blocks(u.join(asked, "u", "left_semi"), i, 20, tr), val).select("u", F.lit(seed).alias("seed"), *_r(*rank.METRICS))
        a = m if a is None else a.unionByName(m)
    b = rank.user_metrics(rank.popular_unseen(tr, val), val).select("u", F.lit(-1).alias("seed"), *_r(*rank.METRICS))
    return written(a, "metrics"), written(b, "metrics")


def results_paired(s, d):
    """Every metric of the propagated model against the most popular items, user by user: differences, wins, ties and signed ranks."""
    a, b = _rankings(s, d, {42: "light"})
    out = None
    for m in rank.METRICS:
        diffs = written(stats.paired(a, b, m).withColumn("diff", F.round("diff", 6)), "diffs")
        w = stats.wilcoxon(diffs).select("w_plus", "w_minus", *_r("z"))
        part = stats.difference_summary(diffs).crossJoin(F.broadcast(w)).select(F.lit(m).alias("metric"), "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "median", "win_rate", "tie_rate")], "w_plus", "w_minus", "z")
        out = part if out is None else out.unionByName(part)
    return out


def results_significance(s, d):
    """The same over three seeds of the model, with p values, their step-down adjustment over the metrics, and bootstrap intervals."""
    a, b = _rankings(s, d, {1: "light-1", 7: "light-7", 42: "light"})
    rows = []
    for m in rank.METRICS:
        diffs = written(stats.paired(a, b, m, seeds=3), "diffs")
        # one row each
        z, ci = stats.wilcoxon(diffs).first(), stats.bootstrap_mean(diffs).first()
        rows.append((m, int(z["n"]), float(ci["mean"] or 0.0), float(ci["lo"] or 0.0), float(ci["hi"] or 0.0), stats.two_sided_p(z["z"])))
    family = s.createDataFrame(rows, "test string, n long, mean double, lo double, hi double, p double")
    return stats.holm(family).select(F.col("test").alias("metric"), "n", *_r("mean", "lo", "hi"), "p", F.col("adjusted").alias("p_adjusted"))


def degradation_advantage(s, d):
    """What the second model loses more than the first, for each model seed, corruption seed and level, against each one's clean run."""
    r = _runs(s, d).filter(F.col("model").isin("dump_alpha", "dump_bravo"))
    clean = r.filter("level = 0").groupBy("model", "model_seed").agg(F.avg("value").alias("clean"))
    lost = r.filter("level > 0").join(F.broadcast(clean), ["model", "model_seed"]).withColumn("drop", F.when(F.col("clean") != 0, 100 * (F.col("clean") - F.col("value")) / F.col("clean")))
    by = lost.groupBy("model_seed", "corruption_seed", "level").agg(F.max(F.when(F.col("model") == "dump_alpha", F.col("drop"))).alias("a"), F.max(F.when(F.col("model") == "dump_bravo", F.col("drop"))).alias("b"))
    return _long(by.select("model_seed", "corruption_seed", "level", F.round("a", 6).alias("drop_a"), F.round("b", 6).alias("drop_b"), F.round(F.col("b") - F.col("a"), 6).alias("advantage")), "corruption_seed")


def train_text(s, d):
    """Words and reviews per item from the texts of training pairs only: held-out pairs' reviews never reach a feature."""
    reg = table(s, d, "item_images_v3").select(F.trim("ta_hotel_id").alias("h"), clean_id(F.col("img_hotel_id")).alias("i")).filter("i is not null")
    rows = table(s, d, "merged_hotelrec").select(F.trim("user_id").alias("u"), F.trim("hotel_id").alias("h"), names.clean_text(F.col("review_text")).alias("t"), "row_id").filter("u is not null and h is not null and t != ''")
    kept = rows.join(reg, "h").join(_train(s, d), ["u", "i"], "left_semi")
    first = kept.groupBy("u", "i").agg(F.min_by("t", "row_id").alias("t"))
    return first.groupBy("i").agg(F.count(F.lit(1)).alias("n_reviews"), F.sum(names.word_count(F.col("t"))).alias("n_words"))


def audits_planted(s, d):
    """(audit, u, i): what the checks of a split say of one with planted faults: pairs copied into test, doubled pairs, an unknown user and item."""
    sp = written(_split(s, d), "split").select("u", "i", "split")
    mark = F.substring(F.md5(F.concat_ws("|", "u", "i")), 1, 1)
    bad = sp.filter((mark == "0") & (F.col("split") == "train")).withColumn("split", F.lit("test"))
    bad = bad.unionByName(sp.filter(mark == "1"))
    bad = bad.unionByName(sp.filter((mark == "2") & (F.col("split") == "val")).select(F.lit("nobody").alias("u"), "i", "split"))
    bad = bad.unionByName(sp.filter((mark == "3") & (F.col("split") == "val")).select("u", F.lit("nothing").alias("i"), "split"))
    broken = written(sp.unionByName(bad), "broken")
    index = split.dense_index(sp, "i")
    none = F.lit(None).cast("string")
    found = [
        audit.overlaps(broken).select(F.lit("overlap").alias("audit"), "u", "i"),
        audit.duplicates(broken).select(F.lit("duplicate").alias("audit"), "u", "i"),
        audit.cold(broken, "u").select(F.lit("cold_user").alias("audit"), F.col("id").alias("u"), none.alias("i")),
        audit.cold(broken, "i").select(F.lit("cold_item").alias("audit"), none.alias("u"), F.col("id").alias("i")),
        audit.held_out_seen(broken).select(F.lit("held_out_seen").alias("audit"), "u", "i"),
        audit.unmapped(broken, "i", index).select(F.lit("unmapped").alias("audit"), none.alias("u"), F.col("id").alias("i")),
        audit.not_one_to_one(broken.select("u", "split").distinct(), "u", "split").filter("side = 'u'").select(F.lit("not_one_to_one").alias("audit"), F.col("id").alias("u"), none.alias("i")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


# --- joins, sets, summaries, tuning ----------------------------------------------------------------------------------


def checked_join(s, d):
    im = table(s, d, "item_images_v3").select(clean_id(F.col("img_hotel_id")).alias("i"), "image_count")
    return joins.checked_left_join(im, evidence.log_evidence(_train(s, d), "i").select("i", "n"), ["i"], "one_to_one").select("i", "image_count", "n")


def indexed_pairs(s, d):
    core = written(_core(s, d).select("u", "i"), "core")
    return joins.gather(core, split.dense_index(core, "i"), "i").select("u", "i", "idx")


def latest_review(s, d):
    r = table(s, d, "merged_hotelrec").select(F.trim("user_id").alias("u"), F.trim("hotel_id").alias("h"), "row_id", "timestamp").filter("u is not null and h is not null")
    return joins.keep_last(r, ["u", "h"], "row_id").select("u", "h", "row_id", "timestamp")


def display_order(s, d):
    c = joins.replaced(table(s, d, "source_clock").select(F.col("source_name").alias("model")), "model", {"dump_alpha": "full", "dump_bravo": "backbone"})
    return joins.in_order(c, "model", ["backbone", "full"]).select("model", F.col("position").cast("long").alias("position"))


def missing_vectors(s, d):
    have = _images(s, d).select("item").distinct()
    ids = table(s, d, "item_images_v3").select(clean_id(F.col("img_hotel_id")).alias("item")).filter("item is not null").distinct()
    return ids.join(have, "item", "left_anti")


def shared_names(s, d):
    a = table(s, d, "item_images_v3").select(names.core_name(F.col("ta_name")).alias("core"))
    return a.intersect(table(s, d, "hotel_info").select(names.core_name(F.col("hotel_name")).alias("core")))


def all_users(s, d):
    sp = _split(s, d)
    return sp.filter("split = 'val'").select("u").union(sp.filter("split = 'test'").select("u")).distinct()


def evidence_summary(s, d):
    e = evidence.log_evidence(_train(s, d), "i")
    return e.agg(F.min("n").alias("lowest"), F.percentile("n", F.lit(0.5)).alias("median"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("highest"), F.count_if(F.col("n") == 1).alias("n_single"))


def boolean_checks(s, d):
    sp = _split(s, d)
    return sp.groupBy("split").agg(F.bool_and(F.col("u").isNotNull()).alias("all_known"), F.bool_or(F.col("i") < "2").alias("any_low"))


def ablation_table(s, d):
    r = stats.seed_summary(_runs(s, d).filter("level = 0 and corruption_seed = 2026"), "model", "value")
    full = r.filter("model = 'dump_alpha'").select(F.col("mean").alias("full"))
    return r.crossJoin(F.broadcast(full)).select("model", F.round(100 * (F.col("mean") - F.col("full")) / F.col("full"), 6).alias("change_pct"))


def early_stopping(s, d):
    r = _runs(s, d).filter("model_seed = 42 and level = 0.25").withColumn("epoch", F.col("corruption_seed") - 2025)
    return tuning.stopping_points(r, ["model"], "epoch", "value", 2).select("model", F.col("best_epoch").cast("long").alias("best_epoch"), F.col("stopped_at").cast("long").alias("stopped_at"), F.round("best", 8).alias("best"))


def trial_dedupe(s, d):
    r = _runs(s, d).filter("level = 0.5 and model_seed = 7")
    return tuning.distinct_trials(r.select("model", "corruption_seed", "value"), ["model"], "corruption_seed").select("model", F.col("corruption_seed").cast("long").alias("corruption_seed"), F.round("value", 8).alias("value"))


def score_parity(s, d):
    """Pairs whose own score differs from that of the full ranking: none."""
    tr = written(_train(s, d), "train")
    u, i = models.light_vectors(tr, DIMS)
    u, i = written(u, "u"), written(i, "i")
    top = graph.score_blocks(u, i, 20).select("u", "i", F.col("score").alias("ranked"))
    return models.pair_scores(top.select("u", "i"), u, i).join(top, ["u", "i"]).filter(F.abs(F.col("score") - F.col("ranked")) > 2e-6).select("u", "i")


def stress_summary(s, d):
    c = corrupted_state(s, d)
    return c.groupBy("seed", "level").agg(F.sum("n_images").alias("n_images"), F.round(F.avg("availability"), 5).alias("availability"), F.round(F.avg("coherence"), 5).alias("coherence"))


# --- sources and sinks: written by one function, read by its counterpart ---------------------------------------------


def csv_source(s, d):
    """Review rows through headed CSV files and the alias mapping."""
    path, rows = scratch(s, "csv"), table(s, d, "merged_hotelrec")
    rows.select(F.col("user_id").alias("userId"), F.col("hotel_id").alias("hotel"), F.col("rating").cast("string").alias("overall")).write.option("header", True).option("emptyValue", "").csv(path)
    good, _ = readers.read_csv_dumps(s, [path], ["userId", "hotel", "overall"])
    return readers.standardize(good).groupBy("hotel_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rating"), 4).alias("total"))


def json_source(s, d):
    """Review rows through JSON lines and the alias mapping."""
    path, rows = scratch(s, "json"), table(s, d, "merged_hotelrec")
    rows.select(F.col("user_id").alias("reviewerID"), F.col("hotel_id").alias("itemID"), F.col("rating").cast("string").alias("stars"), F.col("review_text").alias("content")).write.json(path)
    good, _ = readers.read_json_dumps(s, [path], ["reviewerID", "itemID", "stars", "content"])
    return readers.standardize(good).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("review_text")).alias("n_chars"))


def headless_csv_source(s, d):
    """Image rows through a headerless list and a headed one."""
    a, b = scratch(s, "train"), scratch(s, "test")
    rows = table(s, d, "train_set").select(F.col("image_id").cast("string").alias("image_id"), "hotel_id", "image_url", "image_source", "upload_timestamp")
    odd = F.substring(F.md5("image_url"), 1, 1) < "8"
    rows.filter(odd).write.csv(a)
    rows.filter(~odd).write.option("header", True).csv(b)
    return readers.read_image_lists(s, a, b).groupBy("image_source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_url").alias("n_urls"))


def id_map_source(s, d):
    path = scratch(s, "map")
    readers.write_id_map(split.dense_index(_core(s, d), "i"), path)
    return readers.read_id_map(s, path)


def append_source(s, d):
    """A table appended to twice."""
    path, rows = scratch(s, "append"), table(s, d, "source_clock").select("source_name")
    for _ in range(2):
        readers.append_manifest(rows, path)
    return s.read.parquet(path).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


def file_discovery(s, d):
    """Names found below the table folder, without the excluded ones."""
    return readers.discover(s, d, "*.parquet").select(F.regexp_extract("path", r"/(\w+)\.parquet", 1).alias("name")).distinct().filter("name in ('documents', 'hotel_info', 'nation')")


# --- further audits --------------------------------------------------------------------------------------------------


def audit_index(s, d):
    return audit.index_faults(split.dense_index(_core(s, d), "i"))


def audit_unmapped(s, d):
    sp = written(_split(s, d), "split")
    return audit.unmapped(sp, "i", split.dense_index(sp, "i"))


def audit_evidence_range(s, d):
    return audit.out_of_range(evidence_join(s, d), ["popularity", "availability", "coherence"]).select("item")


def audit_metrics_range(s, d):
    ranked, val = _popular(s, d)
    return audit.out_of_range(rank.user_metrics(ranked, val), list(rank.METRICS)).select("u")


def audit_run_keys(s, d):
    """Runs that stand twice in a table with one run too many."""
    r = _runs(s, d).select("model", "model_seed", "corruption_seed", "level")
    twice = r.unionByName(r.filter("model = 'dump_alpha' and model_seed = 7 and corruption_seed = 2026 and level = 0.25"))
    out = audit.double_runs(twice, ["model", "model_seed", "corruption_seed", "level"])
    return _long(out, "corruption_seed")


def audit_alignment(s, d):
    """Catalogue positions whose indexed vector differs from the item's own: none."""
    own = written(evidence.pooled(_images(s, d), "item").withColumnRenamed("item", "id"), "pooled")
    index = split.dense_index(own, "id")
    again = joins.gather(own, index, "id").select("idx", F.col("vec").alias("at")).join(index, "idx").join(own, "id")
    return again.filter(F.abs(vectors.dot(F.col("at"), F.col("vec")) - 1) > 1e-6).select("id")


def benchmark_sizes(s, d):
    sp = _split(s, d)
    targets = sp.filter("split = 'val'").groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    sizes = sp.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("u").alias("n_users"), F.count_distinct("i").alias("n_items"))
    return sizes.crossJoin(targets.agg(F.count_if(F.col("n") > 1).alias("n_many_targets")))


mean_branch_metrics = _model_query(lambda s, d, tr: models.mean_branch_model(tr, {"text": (written(_hashed_text(s, d), "text"), 32), "visual": (_item_table(s, d), 64)}))
predicted_metrics = _model_query(lambda s, d, tr: models.predicted_model(tr))

QUERIES = {
    f.__name__: f
    for f in (
        interactions_standardize, implicit_filter, pair_aggregate, item_kcore, name_normalize, slug_parse, entity_resolution_1to1, registry_collect_list, registry_lookup,
        invalid_user_removal, id_suffix_strip, resume_antijoin, config_signature, failure_histogram, text_coverage, format_metrics, split_v6, split_v3_rows, split_summary,
        audit_overlap, audit_duplicates, audit_cold_users, audit_cold_items, audit_held_out, audit_functional, audit_one_to_one, audit_vectors, dense_index_map, user_index_map,
        train_history, seen_union, negatives_offline, negatives_online, negatives_ranked, negative_audit, user_subset, popularity_rank, popularity_topk, eval_user_metrics, eval_macro,
        user_history_evidence, item_popularity_evidence, image_availability, visual_coherence, evidence_join, mean_pool_vectors, user_visual_profile, knn_graph, knn_normalized,
        graph_max_fusion, embedding_neighbours, bipartite_adjacency, mean_aggregation, lightgcn_propagate, lightgcn_score_topk, lightgcn_metrics, vbpr_score, tfidf_svd, gated_pair_scores,
        nested_mask, nested_mask_audit, corrupted_state, evidence_ablation, evidence_shuffle, seed_summary, two_level_aggregate, relative_drop, pivot_delta, run_completeness,
        quartile_strata, qcut_bins, spearman, paired_difference, wilcoxon_statistic, holm_adjust, bootstrap_ci, hierarchical_bootstrap, case_selection, trial_best, best_so_far, checked_join, indexed_pairs, latest_review, display_order, missing_vectors, shared_names, all_users,
        evidence_summary, boolean_checks, ablation_table, early_stopping, trial_dedupe, score_parity, stress_summary, csv_source, json_source, headless_csv_source, id_map_source,
        append_source, file_discovery, audit_index, audit_unmapped, audit_evidence_range, audit_metrics_range, audit_run_keys, audit_alignment, benchmark_sizes, results_paired, results_significance, degradation_advantage, train_text, audits_planted,
    )
}
QUERIES |= {"text_only_metrics": text_only_metrics, "two_branch_metrics": two_branch_metrics, "summed_metrics": summed_metrics, "pairwise_trained_metrics": pairwise_trained_metrics, "spectral_metrics": spectral_metrics, "mean_branch_metrics": mean_branch_metrics, "predicted_metrics": predicted_metrics}
