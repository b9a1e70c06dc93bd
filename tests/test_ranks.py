"""Dense ids and groups of models that do not differ."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ranktests as K
from pulsegrid.operators import split as S


def test_ids_are_dense_and_repeatable(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"), "id")
    ids = S.surrogate_id(df, ["k", "id"], alias="row_id")
    stats = ids.agg(F.count("*"), F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).first()
    assert tuple(stats) == (5000, 1, 5000, 5000)
    again = S.surrogate_id(df.repartition(13), ["k", "id"], alias="row_id")
    assert ids.exceptAll(again).isEmpty()
    same = S.surrogate_id(spark.range(7).select(F.lit("x").alias("k")), ["k"], alias="row_id")  # equal keys
    assert sorted(r.row_id for r in same.collect()) == list(range(1, 8))


def cliques(names, apart):
    def ok(s):
        return all((a, b) not in apart for a, b in itertools.combinations(s, 2))

    sets = [set(s) for n in range(1, len(names) + 1) for s in itertools.combinations(names, n) if ok(s)]
    return {tuple(sorted(s)) for s in sets if not any(s < o for o in sets)}


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_groups_against_every_subset(spark, share):
    rng = random.Random(int(share * 10))
    names = [f"m{i}" for i in range(8)]
    pairs = [(a, b, rng.random() < share) for a, b in itertools.combinations(names, 2)]
    got = K.inseparable_groups(spark.createDataFrame(pairs, "model_a string, model_b string, significant boolean")).collect()
    assert {tuple(r.members) for r in got} == cliques(names, {(a, b) for a, b, s in pairs if s})
    assert sorted(r.group for r in got) == list(range(len(got)))


def test_many_models_that_all_tie_are_one_group(spark):
    names = [f"m{i:02}" for i in range(24)]
    pairs = [(a, b, False) for a, b in itertools.combinations(names, 2)]
    got = K.inseparable_groups(spark.createDataFrame(pairs, "model_a string, model_b string, significant boolean")).collect()
    assert [r.members for r in got] == [names]
    split = [(a, b, (a < "m12") != (b < "m12")) for a, b, _ in pairs]
    got = K.inseparable_groups(spark.createDataFrame(split, "model_a string, model_b string, significant boolean")).collect()
    assert sorted(r.members for r in got) == [names[:12], names[12:]]
    assert K.inseparable_groups(spark.createDataFrame([], "model_a string, model_b string, significant boolean")).collect() == []
