"""Weighted draws against a search in the exact running sums, and hot rows."""

import bisect
import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strandline.operators import balance, sampling


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def expected(rows, draws, seed):
    """Keys by draw, from exact fractions."""
    some = sorted((md5(k), str(k), k, w) for k, w in rows if w is not None and w > 0 and not math.isnan(w))
    top = max(w for *_, w in some)
    first = 31 - math.frexp(top)[1]
    coarse = sum(math.floor(Fraction(w) * Fraction(2) ** first) + 1 for *_, w in some)
    exponent = first + 61 - coarse.bit_length()
    ends, total = [], 0
    for *_, w in some:
        total += math.floor(Fraction(w) * Fraction(2) ** exponent)
        ends.append(total)
    assert total < 2 ** 61
    return {i: some[bisect.bisect_right(ends, int(md5(seed, i)[:13], 16) * total >> 52)][2] for i in range(draws)}


def frame(spark, rows):
    return spark.createDataFrame([(k, w, f"payload {k}") for k, w in rows], "k long, w double, text string").repartition(5)


@pytest.mark.parametrize("bucket_rows, task_draws, copy_draws", [(65_536, 262_144, 65_536), (7, 50, 20), (100, 10, 10 ** 9)])
def test_any_weights(spark, bucket_rows, task_draws, copy_draws):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.0, None, -1.0, math.nan, rng.random(), 10 ** rng.uniform(-12, 6), 3.0, 5e-324])) for i in range(300)]
    got = sampling.weighted_sample(frame(spark, rows), F.col("w"), "k", 3000, 7, bucket_rows, task_draws, copy_draws)
    assert got.columns == ["k", "w", "text", "draw"]
    found = got.collect()
    assert {r.draw: r.k for r in found} == expected(rows, 3000, 7) and len(found) == 3000
    assert all(r.text == f"payload {r.k}" and r.w > 0 for r in found)


@pytest.mark.parametrize("scale", [1e-300, 1e300, 2.0 ** -1040])
def test_weights_at_the_ends_of_doubles(spark, scale):
    rows = [(i, (i + 1) * scale / 64) for i in range(20)]
    got = sampling.weighted_sample(frame(spark, rows), F.col("w"), "k", 500, 1)
    assert {r.draw: r.k for r in got.collect()} == expected(rows, 500, 1)


def test_shares(spark):
    rows = [(0, 1.0), (1, 3.0), (2, None), (3, 0.0), (4, 4.0)]
    n = 40_000
    counts = Counter(r.k for r in sampling.weighted_sample(frame(spark, rows), F.col("w"), "k", n).select("k").collect())
    shares = {r.k: r.share for r in sampling.weight_shares(frame(spark, rows), F.col("w"), "k").collect()}
    assert shares == {0: 1 / 8, 1: 3 / 8, 2: 0.0, 3: 0.0, 4: 1 / 2}
    assert all(abs(counts[k] - n * s) <= 6 * math.sqrt(n * s * (1 - s)) for k, s in shares.items())


def test_hot_row(spark):
    rows = [(i, 1e-7) for i in range(1000)] + [(5000, 1.0)]
    draws = 1_000_000
    got = sampling.weighted_sample(frame(spark, rows), F.col("w"), "k", draws, task_draws=50_000)
    counts = {r.k: r.n for r in got.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(counts.values()) == draws and counts[5000] > 999_000
    most = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert most < draws / 2


def test_nothing_to_draw(spark):
    for rows in ([], [(1, 0.0), (2, None)]):
        assert sampling.weighted_sample(frame(spark, rows), F.col("w"), "k", 10).collect() == []
    assert sampling.weighted_sample(frame(spark, [(1, 1.0)]), F.col("w"), "k", 0).collect() == []
    assert len(sampling.weighted_sample(frame(spark, [(1, 1.0), (2, None)]), F.col("w"), "k").collect()) == 2
    with pytest.raises(ValueError, match="infinite"):
        sampling.weighted_sample(frame(spark, [(1, math.inf)]), F.col("w"), "k", 1)


def test_balanced_sample_copies_no_wide_rows(spark):
    rows = spark.createDataFrame([(i, "a", "x" * 100) for i in range(50)] + [(99, "b", "y" * 100)], "id int, g string, text string")
    got = balance.balanced_sample(rows, "g", "id", 4000, copy_draws=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert 1800 < got.where("id = 99").count() < 2200 and got.count() == 4000
