"""Keyed bijections, uniform pair samples and random pairing."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.permute import permute
from pulsegrid.operators import joins as J


def chi_square(counts, cells):
    expected = sum(counts.values()) / cells
    return sum((n - expected) ** 2 / expected for n in counts.values()) + (cells - len(counts)) * expected


def test_permute_is_a_bijection_of_every_small_range(spark):
    df = spark.range(1, 100).select(F.col("id").alias("n")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    out = df.withColumn("y", permute(F.concat(F.lit("a:"), F.col("n").cast("string")), F.col("n"), F.col("x")))
    groups = out.groupBy("n").agg(F.sort_array(F.collect_list("y")).alias("ys")).collect()
    assert all(r.ys == list(range(r.n)) for r in groups) and len(groups) == 99


def test_permute_of_a_large_range(spark):
    n = 100_003
    out = spark.range(n).select(F.col("id"), permute(F.lit("t"), F.lit(n), F.col("id")).alias("y"))
    stats = out.agg(F.count_distinct("y"), F.min("y"), F.max("y"), F.corr("id", "y"), F.sum((F.col("id") == F.col("y")).cast("int"))).first()
    assert stats[:3] == (n, 0, n - 1) and abs(stats[3]) < 0.02 and stats[4] < 15


@pytest.mark.parametrize("per_key", [1, 3, 20, 36])
def test_every_ordered_pair_is_equally_likely(spark, per_key):
    people = 1500
    windows = spark.range(people * 6).select((F.col("id") % people).cast("string").alias("participant_id"), F.concat((F.col("id") % people).cast("string"), F.lit(":"), F.floor(F.col("id") / people).cast("string")).alias("id"))
    pairs = J.sample_pairs(windows, per_key).collect()
    assert len(pairs) == people * per_key == len({(r.id_l, r.id_r) for r in pairs})
    assert {r.pairs_left_out for r in pairs} == {36 - per_key}
    assert all(r.id_l.split(":")[0] == r.id_r.split(":")[0] for r in pairs)
    cells = Counter((r.id_l.split(":")[1], r.id_r.split(":")[1]) for r in pairs)
    assert chi_square(cells, 36) < 75  # 35 degrees of freedom: beyond it once in ten thousand times


def test_two_pairs_of_a_participant_are_independent(spark):
    """Which second pair comes with a first one shows no pattern, as it would with pairs from one shift."""
    people = 4000
    windows = spark.range(people * 3).select((F.col("id") % people).cast("string").alias("participant_id"), F.concat((F.col("id") % people).cast("string"), F.lit(":"), F.floor(F.col("id") / people).cast("string")).alias("id"))
    of = {}
    for r in J.sample_pairs(windows, 2).collect():
        of.setdefault(r.id_l.split(":")[0], []).append(r.id_l[-1] + r.id_r[-1])
    assert chi_square(Counter(tuple(sorted(p)) for p in of.values()), 36) < 80


def test_small_participants_give_all_their_pairs(rows):
    windows = rows([("a", f"a{i}") for i in range(5)] + [("b", "b0")], "participant_id string, id string")
    out = J.sample_pairs(windows, 100)
    assert {(r.id_l, r.id_r) for r in out.collect()} == {(f"a{i}", f"a{j}") for i in range(5) for j in range(5)} | {("b0", "b0")}
    assert out.count() == 26 and {r.pairs_left_out for r in out.collect()} == {0}
    assert {r.id_l[0]: r.pairs_left_out for r in J.sample_pairs(windows, 10).collect()} == {"a": 15, "b": 0}
    assert J.sample_pairs(windows.limit(0), 3).collect() == []


def test_random_pairs_are_permutations_of_any_number(spark):
    for n in (*range(1, 21), 500):
        windows = spark.range(n).select(F.col("id").cast("string").alias("id")).coalesce(1)
        pairs = J.random_pair_rounds(windows, rounds=3).collect()
        for side in ("id_l", "id_r"):
            assert Counter(r[side] for r in pairs) == Counter({str(i): 3 for i in range(n)})


def test_rounds_are_independent(spark):
    windows = spark.range(5).select(F.col("id").cast("string").alias("id"))
    ranked = J.random_pair_rounds(windows, rounds=6000).collect()
    assert chi_square(Counter((r.id_l, r.id_r) for r in ranked), 25) < 55  # shifts of one order would give fixed pairs
    n = F.lit(5)
    orders = spark.range(12000).select(F.array(*[permute(F.concat(F.lit("o:"), F.col("id").cast("string")), n, F.lit(i)) for i in range(5)]).alias("o"))
    seen = Counter(tuple(r.o) for r in orders.collect())
    assert len(seen) == 120 and chi_square(seen, 120) < 190
    following = Counter((tuple(a.o)[0], tuple(b.o)[0]) for a, b in zip(orders.collect(), orders.collect()[1:]))
    assert chi_square(following, 25) < 55
