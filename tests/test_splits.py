"""Running aggregates, folds, splits, weights, sampling."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.functions.text import stratum_key
from strandline.operators import balance, split
from strandline.plans import sizing
from strandline.plans.running import dense_position, running

# Rows per chain and label in a table of 416 records.
STRATA = {"C6": (1, 19), "C8": (21, 51), "C10": (12, 40), "C12": (30, 70), "C14": (12, 40),
          "C16": (44, 54), "C18": (12, 10)}


@pytest.fixture(scope="module")
def peptides(spark):
    rows, i = [], 0
    for chain, sizes in STRATA.items():
        for label, n in enumerate(sizes):
            for _ in range(n):
                rows.append((f"Peptide_{i}", chain, label))
                i += 1
    return spark.createDataFrame(rows, "id string, chain string, Label int").repartition(5)


def chain_label():
    return stratum_key(F.col("chain"), F.col("Label"))


def skewed(spark, n=5000):
    """Half of the rows in one group, a third of that group with one order value."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("g"),
        F.when(F.col("id") % 6 == 0, 7).otherwise(F.hash("id") % 50).alias("o"),
        (F.hash("id", F.lit(1)) % 1000).cast("double").alias("v")).repartition(7)


@pytest.mark.parametrize("hot_rows", [40, 300])
def test_running_splits_hot_groups_exactly(spark, hot_rows):
    rows = skewed(spark)
    order = [F.col("o").desc(), F.col("id")]
    measures = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}
    for inclusive in (True, False):
        plain = running(rows, ["g"], order, measures, inclusive)
        cut = running(rows, ["g"], order, measures, inclusive, hot_rows)
        assert cut.columns == plain.columns
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)


def test_running_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, i) for i in range(30)] + [("a", 1)], "g string, o int")
    got = dense_position(rows, ["g"], [F.col("o")], "p", hot_rows=5).collect()
    assert sorted(r.p for r in got if r.g is None) == list(range(30))
    assert all(r.p == r.o for r in got if r.g is None)


def test_lookup_above_the_limit_is_not_broadcast(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(100).select((F.col("id") % 10).alias("k"))
    for limit, hinted in ((1, False), (10_000, True)):
        side = sizing.lookup_side(small, limit)
        plan = sizing.left_lookup(big, side, ["k"])._jdf.queryExecution().analyzed().toString()
        assert ("broadcast" in plan) == hinted


def test_fold_sizes(spark, peptides):
    folds = split.stratified_kfold(peptides, chain_label(), "id", 5).collect()
    assert len(folds) == 416 and folds[0].asDict().keys() == {"id", "chain", "Label", "fold"}
    assert sorted(Counter(r.fold for r in folds).values(), reverse=True) == [84, 83, 83, 83, 83]
    per_stratum = Counter((r.chain, r.Label, r.fold) for r in folds)
    for chain, sizes in STRATA.items():
        for label, n in enumerate(sizes):
            got = [per_stratum[chain, label, f] for f in range(5)]
            assert sum(got) == n and max(got) - min(got) <= 1


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_parts_do_not_depend_on_layout(spark, peptides, digits):
    base = {r.id: r.fold for r in split.stratified_kfold(peptides, chain_label(), "id").collect()}
    for rows in (peptides.repartition(1), peptides.repartition(9)):
        got = split.stratified_kfold(rows, chain_label(), "id", digits=digits).collect()
        assert {r.id: r.fold for r in got} == base


def test_seed_changes_rows_not_sizes(spark, peptides):
    one, two = (split.stratified_kfold(peptides, chain_label(), "id", seed=s).collect() for s in (1, 2))
    assert Counter(r.fold for r in one) == Counter(r.fold for r in two)
    assert {r.id: r.fold for r in one} != {r.id: r.fold for r in two}


def test_folds_need_one_stratum_large_enough(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "s string, id int")
    with pytest.raises(ValueError, match="5 folds"):
        split.stratified_kfold(rows, F.col("s"), "id")


def test_null_stratum_is_a_stratum(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") < 20, "a").alias("s"))
    got = Counter((r.s, r.fold) for r in split.stratified_kfold(rows, F.col("s"), "id").collect())
    assert set(got.values()) == {4} and len(got) == 10


def largest_remainder(sizes, draws):
    total = sum(sizes.values())
    exact = {s: divmod(n * draws, total) for s, n in sizes.items()}
    left = draws - sum(whole for whole, _ in exact.values())
    ranked = sorted(sizes, key=lambda s: (-exact[s][1], s))
    return {s: exact[s][0] + (ranked.index(s) < left) for s in sizes}


def test_split_quotas(spark, peptides):
    got = {}
    for r in split.stratified_split(peptides, chain_label(), "id").collect():
        got.setdefault(f"{r.chain}_{r.Label}", Counter())[r.split] += 1
    sizes = {f"{c}_{y}": n for c, pair in STRATA.items() for y, n in enumerate(pair)}
    train = 416 - math.ceil(0.3 * 416)
    several = {s: n for s, n in sizes.items() if n > 1}
    quota = largest_remainder(several, train - 1) | {"C6_0": 1}
    held = {s: n - quota[s] for s, n in sizes.items()}
    val = largest_remainder(held, sum(held.values()) - math.ceil(0.5 * sum(held.values())))
    for s in sizes:
        assert (got[s]["train"], got[s]["val"]) == (quota[s], val[s])
    assert sum((c for c in got.values()), Counter()) == {"train": 291, "val": 62, "test": 63}


def test_small_strata_are_flagged(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 3), ("c", 100)], "stratum string, n long")
    rows = {r.stratum: r for r in split.split_quotas(sizes).collect()}
    assert rows["a"].train == 1 and rows["a"].undersized
    assert not rows["c"].undersized
    assert all(r.train + r.val + r.test == r.n for r in rows.values())


def test_empty_input_keeps_its_schema(spark):
    rows = spark.createDataFrame([], "id string, chain string, Label int")
    assert split.stratified_kfold(rows, chain_label(), "id").columns == [*rows.columns, "fold"]
    assert split.stratified_kfold(rows, chain_label(), "id").count() == 0
    assert split.stratified_split(rows, chain_label(), "id").count() == 0


def test_weights(spark):
    rows = spark.createDataFrame([("a",)] * 4 + [("b",)], "g string")
    got = balance.balance_weights(rows, "g").collect()
    assert Counter((r.g, r.weight) for r in got) == {("a", 0.25): 4, ("b", 1.0): 1}


@pytest.mark.parametrize("hot_rows, copy_draws", [(2_000_000, 65_536), (50, 20)])
def test_balanced_sample(spark, hot_rows, copy_draws):
    rows = spark.createDataFrame(
        [(i, f"g{i % 15}") for i in range(1500)] + [(9999, "single")], "id int, g string")
    draws = 8000
    got = balance.balanced_sample(rows, "g", "id", draws, 7, hot_rows, copy_draws).collect()
    assert sorted(r.draw for r in got) == list(range(draws))
    per_group = Counter(r.g for r in got)
    assert len(per_group) == 16
    assert all(abs(n - draws / 16) < 6 * math.sqrt(draws / 16) for n in per_group.values())
    assert all(r.id == 9999 for r in got if r.g == "single")
    base = balance.balanced_sample(rows.repartition(3), "g", "id", draws, 7).collect()
    assert {r.draw: r.id for r in base} == {r.draw: r.id for r in got}


def test_shuffle_is_reproducible(spark):
    rows = spark.range(200)
    first = [r.id for r in balance.shuffled(rows, "id").collect()]
    again = [r.id for r in balance.shuffled(rows.repartition(7), "id").collect()]
    assert first == again != sorted(first) and sorted(first) == list(range(200))
    for hot_rows in (30, 1000):
        placed = balance.shuffle_position(rows, "id", hot_rows=hot_rows).orderBy("position").collect()
        assert [r.id for r in placed] == first
        assert [r.position for r in placed] == list(range(200))


def test_results_beyond_the_broadcast_limit(spark, peptides, monkeypatch):
    def results():
        folds = split.stratified_kfold(peptides, chain_label(), "id")
        parts = split.stratified_split(peptides, chain_label(), "id")
        grouped = peptides.withColumn("g", chain_label())
        weights = balance.balance_weights(grouped, "g")
        drawn = balance.balanced_sample(grouped, "g", "id", 1000, copy_draws=30)
        return [(df, sorted(map(tuple, df.collect()))) for df in (folds, parts, weights, drawn)]

    small = results()
    monkeypatch.setattr(sizing, "fits_broadcast", lambda *a: False)
    monkeypatch.setattr(split, "fits_broadcast", lambda *a: False)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = results()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    for (_, expected), (df, got) in zip(small, large):
        assert got == expected
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, context, **conf):
        self.sparkContext, self.conf = context, conf


@pytest.mark.parametrize("context, conf, expected", [
    (FakeContext("yarn", "/shared/a"), {"spark.checkpoint.dir": "/shared/b"}, "/shared/a"),
    (FakeContext("yarn"), {"spark.checkpoint.dir": "/shared/b"}, "/shared/b"),
    (FakeContext("local[4]"), {}, None),
])
def test_checkpoint_folder(context, conf, expected):
    sizing.ensure_checkpoint_dir(FakeSession(context, **conf))
    assert context.folder == expected or (expected is None and "checkpoints-" in context.folder)


def test_a_cluster_needs_a_named_checkpoint_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sizing.ensure_checkpoint_dir(FakeSession(FakeContext("spark://host:7077")))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotas_of_random_strata(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i:02d}": draw.choice([1, 2, 3, 7, draw.randint(1, 90), draw.randint(1, 10**11)])
             for i in range(draw.randint(2, 25))}
    table = spark.createDataFrame(list(sizes.items()), "stratum string, n long").repartition(3)
    total = sum(sizes.values())
    single = {s for s, n in sizes.items() if n == 1}
    train = max(total - math.ceil(0.3 * total) - len(single), 0)
    several = {s: n for s, n in sizes.items() if n > 1}
    quota = largest_remainder(several, train) | dict.fromkeys(single, 1)
    held = {s: n - quota[s] for s, n in sizes.items()}
    val = largest_remainder(held, sum(held.values()) - math.ceil(0.5 * sum(held.values())))
    got = {r.stratum: r for r in split.split_quotas(table).collect()}
    for s in sizes:
        assert (got[s].train, got[s].val, got[s].test) == (quota[s], val[s], held[s] - val[s])

    small = {s: min(n, 500) for s, n in sizes.items()}
    layout = [s for s in sorted(small) for _ in range(small[s])]
    expected = {s: Counter() for s in small}
    for j, s in enumerate(layout):
        expected[s][j % 5] += 1
    ends = split.fold_quotas(spark.createDataFrame(list(small.items()), "stratum string, n long"), 5)
    for r in ends.collect():
        bounds = [0, *r.ends, r.n]
        assert [b - a for a, b in zip(bounds, bounds[1:])] == [expected[r.stratum][f] for f in range(5)]


def test_large_buckets_and_long_keys(spark, monkeypatch):
    rows = spark.range(3000).select(F.concat(F.lit("k" * 5000), F.col("id").cast("string")).alias("id"),
                                    (F.col("id") % 3 == 0).cast("string").alias("s")).repartition(5)
    plain = {r.id: r.split for r in split.stratified_split(rows, F.col("s"), "id").collect()}
    ranged = {r.id: r.split for r in split.stratified_split(rows, F.col("s"), "id", digits=1, hot_rows=20).collect()}
    assert plain == ranged
    monkeypatch.setattr("strandline.plans.sizing.hinted.__defaults__", (1000,))
    wide = split.stratified_split(rows, F.col("s"), "id")
    assert "rightHint=(strategy=broadcast)" not in wide._jdf.queryExecution().analyzed().toString()


def test_repeated_keys(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert [tuple(r) for r in split.repeated_keys(rows, "id").collect()] == [(1, 2)]
