from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vecweave.functions import vectors as V


def one(spark, a, b, fn):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    return df.select(fn(F.col("a"), F.col("b")).alias("x")).first()["x"]


def unit(spark, v, **options):
    df = spark.createDataFrame([(v,)], "v array<double>")
    return df.select(V.normalize(F.col("v"), **options).alias("x")).first()["x"]


def test_normalize(spark):
    assert unit(spark, [3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert unit(spark, [1.0, 0.0, 0.0]) == [1.0, 0.0, 0.0]
    assert unit(spark, [-1.0, 1.0]) == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2)])
    assert unit(spark, None) is None


@pytest.mark.parametrize("v", [[], [0.0, 0.0, 0.0]])
def test_normalize_without_direction(spark, v):
    with pytest.raises(Exception, match="cannot normalize"):
        unit(spark, v)
    assert unit(spark, v, strict=False) is None


@pytest.mark.parametrize(
    "a, b, want",
    [
        ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 1.0),
        ([1.0, 0.0], [0.0, 1.0], 0.0),
        ([1.0, 0.0], [-1.0, 0.0], -1.0),
        ([0.0, 0.0], [1.0, 1.0], 0.0),
    ],
)
def test_cosine(spark, a, b, want):
    assert one(spark, a, b, V.cosine_similarity) == pytest.approx(want)


@pytest.mark.parametrize(
    "a, b, want",
    [([1.0, 2.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [3.0, 4.0], 5.0), ([-1.0, -1.0], [1.0, 1.0], math.sqrt(8))],
)
def test_euclidean(spark, a, b, want):
    assert one(spark, a, b, V.euclidean_distance) == pytest.approx(want)


def test_dot(spark):
    assert one(spark, [1.0, 2.0], [3.0, 4.0], V.dot_product) == 11.0
    assert one(spark, None, [3.0], V.dot_product) is None


@pytest.mark.parametrize("fn", [V.cosine_similarity, V.euclidean_distance, V.dot_product])
def test_mismatch_and_empty_are_errors(spark, fn):
    with pytest.raises(Exception, match="vector lengths differ: 1 and 2"):
        one(spark, [1.0], [1.0, 2.0], fn)
    with pytest.raises(Exception, match="empty vector"):
        one(spark, [], [1.0], fn)


def test_has_embedding(spark):
    df = spark.createDataFrame([([1.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(V.has_embedding(F.col("v"))).collect()] == [True, False, False]
