"""Vector math, heads, ensemble scoring."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import vectors
from strandline.operators import heads, pooling, score
from strandline.operators.clean import CHAINS
from strandline.plans.scoring import centroid_heads, score_records
from strandline.sources.models import MODEL_SCHEMA, fold_groups, model_rows

RNG = np.random.default_rng(4)


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id int, x {kind}")


def test_gelu():
    x = np.concatenate([np.linspace(-12, 12, 9001), [-1e6, 1e6]])
    exact = np.array([v * 0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(heads.gelu(x) - exact).max() < 1e-10
    assert heads.gelu(np.array([0.0, 1.0])) == pytest.approx([0.0, 0.8413447460685429])


def test_null_and_ragged_vectors(spark):
    rows = frame(spark, [[1.0, 2.0], None, [3.0, 4.0]])
    got = [r[0] for r in rows.select(vectors.dot(F.col("x"), np.array([2.0, 1.0]), 1.0)).collect()]
    assert got == [5.0, None, 11.0]
    lists = [r[0] for r in rows.select(vectors.layer_norm(F.col("x"))).collect()]
    assert lists[1] is None and lists[0] == pytest.approx([-0.99998, 0.99998], abs=1e-5)
    with pytest.raises(Exception, match="different length"):
        frame(spark, [[1.0], [1.0, 2.0, 3.0]]).coalesce(1).select(
            vectors.dot(F.col("x"), np.array([2.0]))).collect()


def test_mse_and_prefix(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<double>, b array<double>")
    got = rows.select(
        vectors.mean_squared_difference(F.col("a"), F.col("b")).alias("mse"),
        vectors.with_prefix(F.col("a"), F.array("b")).alias("t"),
        vectors.prefix_mask(F.array(F.lit(1), F.lit(0))).alias("m"),
        vectors.in_tokens(F.concat("a", "b"), 2).alias("w")).first()
    assert (got.mse, got.t, got.m) == (6.5, [[1.0, 2.0], [3.0, 5.0]], [1, 1, 0])
    assert got.w == [[1.0, 2.0], [3.0, 5.0]]


def softmax_pool(tokens, weights, bias, mask):
    s = np.where(mask > 0, np.tanh(tokens @ weights + bias), -1e9)
    e = np.exp(s - s.max())
    return (e / e.sum()) @ tokens


def test_attention_pool_long_and_row_form(spark):
    groups = {g: RNG.normal(size=(5 + g, 4)) for g in range(3)}
    masks = {g: np.array([1] * (3 + g) + [0, 0]) for g in groups}
    w = RNG.normal(size=4)
    long = spark.createDataFrame(
        [(g, t, x.tolist(), int(masks[g][t])) for g, v in groups.items() for t, x in enumerate(v)],
        "g int, t int, x array<double>, m int").repartition(4)
    got = {(r.g, r.pos): r.pooled for r in
           pooling.attention_pool(long, ["g"], "x", w, 0.3, "m").collect()}
    rows = spark.createDataFrame(
        [(g, v.tolist(), masks[g].tolist()) for g, v in groups.items()],
        "g int, x array<array<double>>, m array<int>")
    p = {"pool.weight": w[None, :], "pool.bias": np.array([0.3])}
    by_row = {r.g: r.z for r in rows.select("g", heads.row_head(
        p, heads.pool_tokens, [F.col("x"), F.col("m")]).alias("z")).collect()}
    for g, v in groups.items():
        expected = softmax_pool(v, w, 0.3, masks[g])
        assert [got[g, j] for j in range(4)] == pytest.approx(expected)
        assert by_row[g] == pytest.approx(expected)


def test_pooling_of_fully_masked_rows_ignores_batch_padding(spark):
    rows = spark.createDataFrame(
        [(0, [[1.0, 2.0], [3.0, 4.0]], [0, 0]), (1, [[1.0, 1.0]] * 7, [1] * 7)],
        "id int, x array<array<double>>, m array<int>").coalesce(1)
    p = {"pool.weight": np.ones((1, 2)), "pool.bias": np.zeros(1)}
    got = {r.id: r.z for r in rows.select("id", heads.row_head(
        p, heads.pool_tokens, [F.col("x"), F.col("m")]).alias("z")).collect()}
    assert got[0] == pytest.approx([2.0, 3.0]) and got[1] == pytest.approx([1.0, 1.0])


def test_vector_means_and_gather(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])],
                                 "g string, x array<double>")
    got = pooling.gather_vectors(pooling.vector_means(rows, ["g"], "x"), ["g"], "mean", "c")
    assert {r.g: r.c for r in got.collect()} == {"a": [2.0, 3.0], "b": [5.0, 6.0]}


def test_noise(spark):
    rows = spark.range(400).select("id", F.array_repeat(F.lit(0.0), 25).alias("x"))
    noisy = pooling.noise_augment(rows, "id", "x", 0.1)
    again = pooling.noise_augment(rows.repartition(7), "id", "x", 0.1)
    values = {r.id: r.x for r in noisy.collect()}
    assert values == {r.id: r.x for r in again.collect()}
    flat = np.array(list(values.values())).ravel()
    assert len(flat) == 10_000 and abs(flat.mean()) < 0.005 and abs(flat.std() - 0.1) < 0.005
    assert abs(np.corrcoef(flat[:-1], flat[1:])[0, 1]) < 0.05


def prompted_parameters(width=6, categories=9, seed=0):
    rng = np.random.default_rng(seed)
    shapes = {"category": (categories, 3), "prefix.weight": (width, 3), "prefix.bias": (width,),
              "down.weight": (4, width), "down.bias": (4,), "up.weight": (width, 4),
              "up.bias": (width,), "pool.weight": (1, width), "pool.bias": (1,),
              "hidden.weight": (5, width), "hidden.bias": (5,), "out.weight": (2, 5), "out.bias": (2,)}
    for name, size in (("prefix.norm", width), ("adapter.norm", width), ("hidden.norm", 5)):
        shapes |= {f"{name}.gain": (size,), f"{name}.shift": (size,)}
    return {name: rng.normal(size=shape) for name, shape in shapes.items()}


def one_row(p, tokens, mask, index):
    """The prompted head for one row, written with plain loops over tokens."""
    def gelu(v):
        return np.array([x * 0.5 * (1 + math.erf(x / math.sqrt(2))) for x in v])

    def norm(name, v):
        return (v - v.mean()) / math.sqrt(v.var() + 1e-5) * p[f"{name}.gain"] + p[f"{name}.shift"]

    def dense(name, v):
        return p[f"{name}.weight"] @ v + p[f"{name}.bias"]

    prefix = gelu(norm("prefix.norm", dense("prefix", p["category"][index])))
    kept = [prefix] + [t for t, m in zip(tokens, mask) if m]
    adapted = [norm("adapter.norm", dense("up", gelu(dense("down", t))) + t) for t in kept]
    e = [math.exp(math.tanh(dense("pool", a)[0])) for a in adapted]
    pooled = sum(w * a for w, a in zip(e, adapted)) / sum(e)
    return dense("out", gelu(norm("hidden.norm", dense("hidden", pooled))))


def test_prompted_head_against_loops(spark):
    rows = [(i, RNG.normal(size=(1 + i % 4, 6)).tolist(), [1] * (1 + i % 4), i % 9) for i in range(600)]
    rows = [(i, t, [1] + m[1:-1] + [0] * (len(m) > 1), c) for i, t, m, c in rows]
    df = spark.createDataFrame(rows + [(-1, None, None, 0)],
                               "id int, t array<array<double>>, m array<int>, c int").coalesce(1)
    folds = [prompted_parameters(seed=s) for s in range(2)]
    models = spark.createDataFrame(
        [r for f, p in enumerate(folds) for r in model_rows(f, p)], MODEL_SCHEMA)
    inputs = [F.col("t"), F.col("m"), F.col("c")]
    got = {r.id: r for r in score.ensemble_score(df, inputs, models, heads.prompted_head).collect()}
    per_fold = score.fold_scores(df, inputs, models, heads.prompted_head).where("id = 7").collect()
    for i, t, m, c in rows:
        z = [one_row(p, np.array(t), m, c) for p in folds]
        prob = [1 / (1 + math.exp(a - b)) for a, b in z]
        assert got[i].Probability == pytest.approx(np.mean(prob), abs=6e-5)
        assert got[i].Prediction == int(np.mean(prob) >= 0.5)
        if i == 7:
            assert [r.probability for r in per_fold] == pytest.approx(prob)
    assert got[-1].Probability is None and got[-1].asDict().keys() == {
        "id", "t", "m", "c", "Probability", "Prediction"}


def linear_models(spark, logits):
    return spark.createDataFrame([r for f, b in enumerate(logits) for r in model_rows(f, {
        "head.weight": np.zeros((2, 2)), "head.bias": np.array([0.0, b])})], MODEL_SCHEMA)


def logit(p):
    return math.log(p / (1 - p))


def test_unrounded_mean_decides(spark):
    rows = frame(spark, [[0.0, 0.0]])
    got = score.ensemble_score(rows, [F.col("x")], linear_models(spark, [logit(.49996)])).first()
    assert (got.Probability, got.Prediction) == (0.5, 0)
    got = score.ensemble_score(rows, [F.col("x")], linear_models(spark, [0.0, 0.0])).first()
    assert (got.Probability, got.Prediction) == (0.5, 1)
    got = score.ensemble_score(
        rows, [F.col("x")], linear_models(spark, [logit(.1), logit(.8)])).first()
    assert (got.Probability, got.Prediction) == (0.45, 0)


def test_rounding(spark):
    row = spark.range(1).select(F.round(F.lit(0.12345), 4), F.round(F.lit(0.00005), 4)).first()
    assert tuple(row) == (0.1235, 0.0001)


def test_large_ensembles_are_sent_in_groups(spark):
    models = linear_models(spark, [0.1] * 5)
    assert fold_groups(models) == [[0, 1, 2, 3, 4]]
    assert fold_groups(models, 12) == [[0, 1], [2, 3], [4]]
    assert fold_groups(models, 1) == [[0], [1], [2], [3], [4]]
    with pytest.raises(ValueError, match="no fold model"):
        fold_groups(models.where("fold > 9"))


def test_score_records(spark):
    rows = spark.createDataFrame([
        (7, "KLA", " c6", "keep", [1.0, 0.0]), (8, "KLA", "C7", "drop", [1.0, 0.0])],
        "n int, Sequence string, Fatty_acid_chain string, note string, x array<double>")
    models = linear_models(spark, [2.0])
    got = score_records(rows, [F.col("x")], models).collect()
    assert [r.asDict() for r in got] == [{
        "n": 7, "Sequence": "KLA", "Fatty_acid_chain": " c6", "note": "keep", "x": [1.0, 0.0],
        "Probability": 0.8808, "Prediction": 1}]
    empty = score_records(rows.where("n > 100"), [F.col("x")], models)
    assert empty.columns == [*rows.columns, "Probability", "Prediction"] and empty.count() == 0
    with pytest.raises(ValueError, match="Fatty_acid_chain"):
        score_records(rows.drop("Fatty_acid_chain"), [F.col("x")], models)


def test_scoring_plan_has_no_shuffle(spark):
    rows = spark.range(10).select(
        F.lit("K").alias("Sequence"), F.lit(CHAINS[1]).alias("Fatty_acid_chain"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    plan = score_records(rows, [F.col("x")], linear_models(spark, [1.0]))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_centroid_heads(spark):
    x = RNG.normal(size=(60, 3)) + np.repeat([[0.0], [1.0]], 30, axis=0)
    y, fold = np.repeat([0, 1], 30), np.arange(60) % 3
    df = spark.createDataFrame(
        [(int(f), int(l), v.tolist()) for f, l, v in zip(fold, y, x)],
        "fold int, y int, x array<double>").repartition(4)
    rows = {(r.fold, r.name): np.array(r["values"]).reshape(r.shape)
            for r in centroid_heads(df, "fold", "y", "x").collect()}
    for f in range(3):
        m = [x[(fold != f) & (y == v)].mean(axis=0) for v in (0, 1)]
        assert rows[f, "head.weight"][1] == pytest.approx(m[1] - m[0])
        assert rows[f, "head.bias"][1] == pytest.approx((m[0] @ m[0] - m[1] @ m[1]) / 2)
