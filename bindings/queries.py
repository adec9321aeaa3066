"""One query per operator over the test tables.

The tables hold no peptides, so roles are played: ``documents`` are the records
(text = sequence, lang = category, ``en`` = no category, ``es`` not allowed), ``labels.quality``
is the label, ``embeddings`` the features, ``events`` the metric history.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions import losses, vectors
from strandline.functions.hashing import digest, seeded_parameters, unit
from strandline.functions.text import length_bin, residue_counts, spaced, stratum_key, tidy_category
from strandline.operators import (
    balance, clean, consistency, encode, heads, history, metrics, pooling, sampling, score, split,
    union, vocab)
from strandline.plans import scoring, training
from strandline.plans.running import dense_position
from strandline.plans.sizing import left_lookup, lookup_side, settle
from strandline.sources.models import MODEL_SCHEMA, model_rows

FOLDS = 5
SHRINKAGE = (0.0, 0.25, 0.5)
NULL_INDEX = 3
FOLD_IDS = [0, 2, 5, 6, 9]
WIDTH = 64
TOKEN_WIDTH = 8
ALLOWED = ["EN", "DE", "FR"]
NO_CATEGORY = "EN"
ATTENTION = seeded_parameters("attention", WIDTH, scale=4.0)
TOKEN_POOL = {"pool.weight": seeded_parameters("pool", 1, TOKEN_WIDTH, scale=8.0),
              "pool.bias": np.array([0.1])}


def head_parameters(fold: int, width: int = TOKEN_WIDTH, categories: int = 4) -> dict:
    """Untrained parameters of the prompted head."""
    shapes = {
        "category": (categories, 4),
        "prefix.weight": (width, 4), "prefix.bias": (width,),
        "prefix.norm.gain": (width,), "prefix.norm.shift": (width,),
        "down.weight": (4, width), "down.bias": (4,),
        "up.weight": (width, 4), "up.bias": (width,),
        "adapter.norm.gain": (width,), "adapter.norm.shift": (width,),
        "pool.weight": (1, width), "pool.bias": (1,),
        "hidden.weight": (6, width), "hidden.bias": (6,),
        "hidden.norm.gain": (6,), "hidden.norm.shift": (6,),
        "out.weight": (2, 6), "out.bias": (2,),
    }
    return {name: seeded_parameters(f"{fold}.{name}", *shape, scale=2.0)
            + (1.0 if name.endswith("gain") else 0.0) for name, shape in shapes.items()}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark, sf_dir):
    """Documents that have a label, without their text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("Label"))
    return docs.join(labels, "doc_id")


def _features(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").withColumn(
        "y", (F.col("label") < 5).cast("int"))


def _long(df, key, array, name):
    return df.select(key, F.posexplode(array).alias("pos", "__x")).select(
        key, "pos", F.round("__x", 6).alias(name))


# ---- scoring

def ensemble_score(spark, sf_dir):
    return _ensemble(spark, sf_dir, scoring.score_records).drop("embedding")


def score_rejects(spark, sf_dir):
    return _ensemble(spark, sf_dir, scoring.score_rejects).select("doc_id", "lang", "reason")


def score_outcomes(spark, sf_dir):
    """Predictions and rejects of one scoring pass, side by side."""
    good, bad = _ensemble(spark, sf_dir, scoring.score_both)
    return good.select("doc_id", "Probability", "Prediction").unionByName(
        bad.select("doc_id", "reason"), allowMissingColumns=True)


def _ensemble(spark, sf_dir, part):
    labelled = _features(spark, sf_dir).join(
        _table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    folded = labelled.withColumn(
        "fold", F.floor(unit(digest(F.lit("fold"), F.col("doc_id"))) * FOLDS).cast("int"))
    models = settle(scoring.centroid_heads(folded, "fold", "quality", "embedding"))
    records = _table(spark, sf_dir, "documents").join(_features(spark, sf_dir), "doc_id", "left")
    return part(
        records, [F.col("embedding")], models, sequence="text", category="lang",
        allowed=ALLOWED, no_category=NO_CATEGORY)


def _linear_models(spark):
    return spark.createDataFrame([row for f in FOLD_IDS for row in model_rows(f, {
        "head.weight": seeded_parameters(f"{f}.head.weight", 2, WIDTH, scale=4.0),
        "head.bias": seeded_parameters(f"{f}.head.bias", 2)})], MODEL_SCHEMA)


def fold_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return score.fold_scores(rows, [F.col("embedding")], _linear_models(spark)).select(
        "vec_id", "fold_number", F.round("probability", 6).alias("probability"))


def ensemble_score_blocked(spark, sf_dir):
    """The heads of ``fold_scores``, their weights joined in blocks to blocks of the vectors."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scored = score.ensemble_score(rows, [F.col("embedding")], _linear_models(spark), key="vec_id", max_numbers=WIDTH)
    return scored.select("vec_id", "Probability", "Prediction")


def predict_rules(spark, sf_dir):
    x = F.col("embedding")
    rows = score.predict_rules(_table(spark, sf_dir, "embeddings"),
                               x[0].cast("double"), x[1].cast("double"))
    return rows.select("vec_id", F.round("probability", 6).alias("probability"),
                       "by_threshold", "by_argmax")


def dense_head(spark, sf_dir):
    models = spark.createDataFrame(
        [row for f in range(FOLDS) for row in model_rows(f, head_parameters(f))], MODEL_SCHEMA)
    rows = _prompted(spark, sf_dir)
    return score.ensemble_score(
        rows, [F.col("tokens"), F.col("mask"), F.col("chain_index")], models, heads.prompted_head,
    ).select("doc_id", "lang", "Probability", "Prediction")


def _prompted(spark, sf_dir):
    """Token vectors, mask and category index of the documents that have features."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(_features(spark, sf_dir), "doc_id").withColumns({
        "tokens": vectors.in_tokens(F.col("embedding"), TOKEN_WIDTH),
        "mask": F.transform(F.sequence(F.lit(0), F.lit(WIDTH // TOKEN_WIDTH - 1)), lambda t: (
            t <= F.col("n_chars") % (WIDTH // TOKEN_WIDTH)).cast("int")),
        "category": _routed(),
    })
    return vocab.category_index(rows, "category", vocab.static_vocab(spark, ["DE", "FR"]))


def _routed():
    category = tidy_category(F.col("lang"))
    return F.when(category == NO_CATEGORY, vocab.NULL_CATEGORY).otherwise(category)


# ---- cleaning, dictionaries, encoding

def clean_route(spark, sf_dir):
    return clean.clean_route(_table(spark, sf_dir, "documents"), sequence="text",
                             category="lang", allowed=ALLOWED, no_category=NO_CATEGORY)


def clean_rejects(spark, sf_dir):
    return clean.clean_rejects(_table(spark, sf_dir, "documents"), sequence="text",
                               category="lang", allowed=ALLOWED, no_category=NO_CATEGORY)


def build_vocab(spark, sf_dir):
    return vocab.build_vocab(_table(spark, sf_dir, "part"), "p_brand")


def category_index(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return vocab.category_index(part, "p_brand", settle(vocab.build_vocab(part, "p_brand")))


def category_index_static(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", _routed().alias("category"))
    return vocab.category_index(docs, "category", vocab.static_vocab(spark, ["DE", "FR"]))


def spaced_sequence(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", spaced(F.col("text")).alias("spaced"))


def encode_tokens(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    letters = docs.select(F.explode(F.array_distinct(F.split("text", ""))).alias("letter")).where(
        ~F.col("letter").rlike(f"^[{encode.NOT_A_TOKEN}]*$"))
    tokens = settle(vocab.build_vocab(letters, "letter").where(
        ~F.col("value").isin(vocab.RESERVED)).select(
        F.col("value").alias("token"), (F.col("idx") + encode.FIRST_RESIDUE).alias("id")))
    coded = encode.encode_tokens(docs, "text", tokens)
    return coded.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                        F.array_join("attention_mask", " ").alias("attention_mask"))


def mixed_union(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", "category", "Label", "is_lipo", "chain_index")


def _mixed(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    plainly = F.col("lang").eqNullSafe("en")
    categorised = rows.where(~plainly).withColumn("category", tidy_category(F.col("lang")))
    plain = rows.where(plainly)
    words = settle(vocab.build_vocab(categorised, "category"))
    return union.mixed_union(categorised, plain, words, category="category")


# ---- splits, weights, sampling

def length_bin_query(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return rows.select("doc_id", "Label", F.col("n_chars").alias("Length"),
                       length_bin(F.col("n_chars")).alias("Length_Bin"))


def stratified_kfold(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    key = stratum_key(F.col("lang"), F.col("Label"))
    return split.stratified_kfold(rows, key, "doc_id", FOLDS).select(
        "doc_id", key.alias("stratum"), "fold")


def fold_parts(spark, sf_dir):
    rows = split.stratified_kfold(
        _labelled(spark, sf_dir), stratum_key(F.col("lang"), F.col("Label")), "doc_id", FOLDS)
    return split.fold_parts(rows, FOLDS).select("doc_id", "fold_number", "part")


def _order_stratum():
    return F.concat_ws("_", "o_orderstatus", "o_orderpriority")


def stratified_kfold_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return split.stratified_kfold(orders, _order_stratum(), "o_orderkey", FOLDS).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "fold")


def _bin_stratum():
    bin_text = F.coalesce(length_bin(F.col("n_chars")).cast("string"), F.lit("nan"))
    return F.concat_ws(" ", F.col("Label"), bin_text)


def stratified_split(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return split.stratified_split(rows, _bin_stratum(), "doc_id").select(
        "doc_id", "Label", "n_chars", "split")


def stratified_split_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return split.stratified_split(orders, _order_stratum(), "o_orderkey").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "split")


def split_quotas(spark, sf_dir):
    counts = split.prefix_counts(_labelled(spark, sf_dir), _bin_stratum(), "doc_id")
    return split.split_quotas(split.stratum_sizes(counts))


def balance_weights(spark, sf_dir):
    rows = _mixed(spark, sf_dir)
    grouped = rows.withColumn("sample_group", union.sample_group(
        F.col("category"), F.col("Label"), F.col("is_lipo")))
    return balance.balance_weights(grouped, "sample_group").select(
        "doc_id", "sample_group", F.round("weight", 10).alias("weight"))


def balance_weights_lineitem(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("g"))
    return balance.balance_weights(items, "g").select(
        "l_orderkey", "l_linenumber", "g", F.round("weight", 10).alias("weight"))


def weighted_sample(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return balance.balanced_sample(docs, "lang", "doc_id")


def weighted_sample_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return balance.balanced_sample(orders, "o_orderpriority", "o_orderkey")


def weighted_sample_general(spark, sf_dir):
    """Orders drawn by price times a small factor: some weights are zero, some null."""
    orders = _table(spark, sf_dir, "orders")
    return sampling.weighted_sample(orders, _order_weight(), "o_orderkey").select("o_orderkey", "draw")


def _order_weight():
    return F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("double") * (F.col("o_orderkey") % 7))


def weight_shares(spark, sf_dir):
    """The whole units that ``weighted_sample_general`` draws from, and each order's share of them."""
    return sampling.weight_shares(_table(spark, sf_dir, "orders"), _order_weight(), "o_orderkey").withColumn(
        "share", F.round("share", 12))


def shuffle_position(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    return balance.shuffle_position(orders, "o_orderkey")


# ---- metrics and losses

def _bundle(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


def metric_bundle(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn(
        "z", F.round(F.col("embedding")[0].cast("double"), 2))
    zero = F.lit(0.0)
    return _bundle(metrics.metric_bundle(
        rows, F.col("y"), losses.softmax_positive(zero, F.col("z")),
        losses.argmax_rule(zero, F.col("z"))))


def metric_bundle_by_lang(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn(
        "score", losses.softmax_positive(F.lit(1000.0), F.col("n_chars").cast("double")))
    return _bundle(metrics.metric_bundle(
        rows, F.col("Label"), F.col("n_chars"), losses.threshold_rule(F.col("score")),
        ["lang"]), "lang")


def metrics_by_group(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return _bundle(metrics.metrics_by_group(
        rows, F.col("Label"), (F.col("n_chars") > 1000).cast("int"), ["lang"]), "lang")


def metrics_flagged(spark, sf_dir):
    rows = _mixed(spark, sf_dir).where("is_lipo = 1")
    return _bundle(metrics.metrics_by_group(
        rows, F.col("Label"), (F.col("n_chars") > 1000).cast("int")))


def auc_ap(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return _bundle(metrics.auc_ap(items, F.col("y"), F.col("l_extendedprice"),
                                  ["l_linestatus"]), "l_linestatus")


def _logits():
    return [F.col("embedding")[i].cast("double") for i in (0, 1)]


def loss_focal(spark, sf_dir):
    loss = losses.focal_loss(_logits()[1], F.col("y"), alpha=0.7)
    return _vectors(spark, sf_dir).groupBy("label").agg(F.round(F.avg(loss), 8).alias("loss"))


def loss_cross_entropy(spark, sf_dir):
    loss = losses.cross_entropy(*_logits(), F.col("y"))
    return _vectors(spark, sf_dir).groupBy("label").agg(F.round(F.avg(loss), 8).alias("loss"))


def epoch_loss(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    batched = metrics.number_batches(events, "event_type", ["ts"], key="event_id")
    out = metrics.epoch_loss(batched, "event_type", "batch", F.col("value"))
    return _bundle(out, "event_type", "batches")


# ---- metric history

def _epochs(spark, sf_dir, by):
    events = _table(spark, sf_dir, "events").select(
        "user_id", "event_type", "ts", "event_id", "value")
    return dense_position(events, by, [F.col("ts"), F.col("event_id")], "epoch")


def best_checkpoint(spark, sf_dir):
    return history.best_checkpoint(_epochs(spark, sf_dir, ["user_id"]), ["user_id"])


def history_report(spark, sf_dir):
    rows = history.history_report(_epochs(spark, sf_dir, ["user_id"]))
    return rows.select("user_id", "epoch", "event_id", "value")


def cv_summary(spark, sf_dir):
    run = ["user_id", "event_type"]
    best = history.best_checkpoint(_epochs(spark, sf_dir, run), run, patience=5)
    return _bundle(history.cv_summary(best, ["user_id"]), "user_id", "folds")


# ---- vectors

def attention_pool(spark, sf_dir):
    pooled = pooling.attention_pool(
        _table(spark, sf_dir, "embeddings"), ["label"], "embedding", ATTENTION)
    return pooled.select("label", "pos", F.round("pooled", 6).alias("pooled"))


def prefix_pool(spark, sf_dir):
    rows = _prompted(spark, sf_dir)
    means = pooling.vector_means(rows, ["category"], "embedding")
    per_token = means.groupBy("category", (F.col("pos") % TOKEN_WIDTH).alias("pos")).agg(
        F.avg("mean").alias("mean"))
    prefixes = lookup_side(pooling.gather_vectors(per_token, ["category"], "mean", "prefix"))
    joined = left_lookup(rows, prefixes, ["category"])
    pooled = joined.withColumn("pooled", heads.row_head(TOKEN_POOL, heads.pool_tokens, [
        vectors.with_prefix(F.col("prefix"), F.col("tokens").cast("array<array<double>>")),
        vectors.prefix_mask(F.col("mask"))]))
    return _long(pooled, "doc_id", "pooled", "pooled")


def layer_norm(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").withColumn(
        "normal", vectors.layer_norm(F.col("embedding")))
    return _long(rows, "vec_id", "normal", "normal")


def noise_augment(spark, sf_dir):
    rows = pooling.noise_augment(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return _long(rows, "vec_id", "embedding", "noisy")


def paired_consistency(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    centres = lookup_side(pooling.gather_vectors(
        pooling.vector_means(rows, ["label"], "embedding"), ["label"], "mean", "centre"))
    paired = left_lookup(rows, centres, ["label"])
    out = consistency.paired_consistency(
        paired, F.col("embedding"), F.col("centre"), F.col("label") > 0,
        losses.focal_loss(_logits()[1], F.col("y"), alpha=0.7), ["label"])
    return out.select("label", *[F.round(c, 8).alias(c)
                                 for c in ("classification", "consistency", "total")])


def prompt_consistency(spark, sf_dir):
    """Loss of one prompted head and the distance of its pooled vectors with the real and the null prompt."""
    rows = _prompted(spark, sf_dir).join(
        _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    rows = rows.withColumn("null_index", F.lit(NULL_INDEX))
    p = head_parameters(0)
    streams = {name: heads.row_head(p, heads.prompted_pool, [F.col("tokens"), F.col("mask"), F.col(index)])
               for name, index in (("real", "chain_index"), ("null", "null_index"))}
    rows = rows.withColumns(streams | {"logits": heads.row_head(
        p, heads.prompted_head, [F.col("tokens"), F.col("mask"), F.col("chain_index")])})
    out = consistency.paired_consistency(
        rows, F.col("real"), F.col("null"), F.col("chain_index") != NULL_INDEX,
        losses.cross_entropy(F.col("logits")[0], F.col("logits")[1], F.col("y")), ["lang"])
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("classification", "consistency", "total")])


# ---- training

def _trainable(spark, sf_dir):
    rows = _labelled(spark, sf_dir).join(_features(spark, sf_dir), "doc_id").withColumn(
        "category", tidy_category(F.col("lang")))
    return vocab.category_index(rows, "category", vocab.static_vocab(spark, ["DE", "ES", "FR"]))


def train_kfold(spark, sf_dir):
    return _kfold_run(spark, sf_dir).report


def train_kfold_centroid(spark, sf_dir):
    run = _kfold_run(spark, sf_dir, grid=SHRINKAGE, learner=training.centroids())
    mean = run.summary.first().mean_best
    return _bundle(run.report.withColumn("cv_mcc", F.lit(mean)), "fold", "candidate", "train_rows", "val_rows")


def _kfold_run(spark, sf_dir, **options):
    rows = _trainable(spark, sf_dir)
    return training.train_kfold(
        rows.where(~F.col("lang").eqNullSafe("en")), "doc_id", F.col("embedding"), "category", "chain_index", 5,
        "Label", plain=rows.where(F.col("lang").eqNullSafe("en")).drop("category"), k=FOLDS, **options)


def train_holdout(spark, sf_dir):
    return _holdout_run(spark, sf_dir).report


def train_holdout_centroid(spark, sf_dir):
    return _bundle(_holdout_run(spark, sf_dir, grid=SHRINKAGE, learner=training.centroids()).report)


def _holdout_run(spark, sf_dir, **options):
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("Label"))
    rows = _table(spark, sf_dir, "documents").join(labels, "doc_id").withColumn(
        "counts", residue_counts(F.lower("text"), "abcdefghijklmnopqrstuvwxyz"))
    return training.train_holdout(
        rows, "doc_id", F.col("counts"), "Label", _bin_stratum(), **options)


QUERIES = {
    "ensemble_score": ensemble_score,
    "score_rejects": score_rejects,
    "score_outcomes": score_outcomes,
    "fold_scores": fold_scores,
    "ensemble_score_blocked": ensemble_score_blocked,
    "predict_rules": predict_rules,
    "dense_head": dense_head,
    "clean_route": clean_route,
    "clean_rejects": clean_rejects,
    "build_vocab": build_vocab,
    "category_index": category_index,
    "category_index_static": category_index_static,
    "spaced_sequence": spaced_sequence,
    "encode_tokens": encode_tokens,
    "mixed_union": mixed_union,
    "length_bin": length_bin_query,
    "stratified_kfold": stratified_kfold,
    "fold_parts": fold_parts,
    "stratified_kfold_orders": stratified_kfold_orders,
    "stratified_split": stratified_split,
    "stratified_split_orders": stratified_split_orders,
    "split_quotas": split_quotas,
    "balance_weights": balance_weights,
    "balance_weights_lineitem": balance_weights_lineitem,
    "weighted_sample": weighted_sample,
    "weighted_sample_orders": weighted_sample_orders,
    "weighted_sample_general": weighted_sample_general,
    "weight_shares": weight_shares,
    "shuffle_position": shuffle_position,
    "metric_bundle": metric_bundle,
    "metric_bundle_by_lang": metric_bundle_by_lang,
    "metrics_by_group": metrics_by_group,
    "metrics_flagged": metrics_flagged,
    "auc_ap": auc_ap,
    "loss_focal": loss_focal,
    "loss_cross_entropy": loss_cross_entropy,
    "epoch_loss": epoch_loss,
    "best_checkpoint": best_checkpoint,
    "history_report": history_report,
    "cv_summary": cv_summary,
    "attention_pool": attention_pool,
    "prefix_pool": prefix_pool,
    "layer_norm": layer_norm,
    "noise_augment": noise_augment,
    "paired_consistency": paired_consistency,
    "prompt_consistency": prompt_consistency,
    "train_kfold": train_kfold,
    "train_holdout": train_holdout,
    "train_kfold_centroid": train_kfold_centroid,
    "train_holdout_centroid": train_holdout_centroid,
}
