"""What tasks read and what joins carry must not grow with a key's rows."""

import random

from pyspark.sql import functions as F

from pulsegrid.operators import evaluate as E
from pulsegrid.operators import mljobs as M
from pulsegrid.operators import ordered as O


def _midranks(values):
    return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]


def _corr(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    return cov / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5


def test_regression_metrics_count_equal_pairs_before_any_join(rows, capsys):
    rng = random.Random(5)
    data = [(float(rng.randrange(9)), float(rng.randrange(4))) for _ in range(300)]
    df = rows([*data, (None, 1.0), (2.0, None)], "label double, pred double")
    table = E.regression_metrics(df)
    y, p = zip(*data)
    got = table.first()
    assert abs(got.pearson - _corr(y, p)) < 1e-9
    assert abs(got.spearman - _corr(_midranks(y), _midranks(p))) < 1e-9
    assert abs(got.mae - sum(abs(a - b) for a, b in data) / len(data)) < 1e-9
    table.explain()
    assert "LeftOuter" not in capsys.readouterr().out  # rows used to be joined with their ranks
    few = [E.regression_metrics(df.limit(n)).first().spearman for n in (0, 1)]
    assert few == [None, None]


def test_regression_metrics_read_the_rows_three_times(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    data = spark.range(0, 900, 1, 2).selectExpr("cast(id * 7 % 450 AS double) AS label", "cast(id % 211 AS double) AS pred")
    monkeypatch.setattr(O.prefix_sums, "__defaults__", ((), 50))  # both columns are cut into buckets
    got = E.regression_metrics(data.mapInArrow(counted, data.schema)).first()
    assert read.value == 3 * 900  # means, predictions, pairs; buckets and samples used to read them again
    y, p = zip(*data.collect())
    assert abs(got.spearman - _corr(_midranks(y), _midranks(p))) < 1e-9


def test_rows_of_prefix_sums_meet_the_cuts_and_never_the_sample(spark, capsys):
    values = spark.range(3000).selectExpr("CASE id % 3 WHEN 0 THEN -id WHEN 1 THEN id / 7 ELSE pow(2, id / 10) END AS v", "id % 5 AS n")
    for cast, size in (("double", 1), ("double", 200), ("string", 40)):
        df = values.selectExpr(f"cast(v AS {cast}) AS v", "n").where("v <> 'NaN'").groupBy("v").agg(F.sum("n").alias("n"))
        running = 0
        table = O.prefix_sums(df, "v", ["n"], rows_per_bucket=size)
        for row in table.orderBy("v").collect():
            assert row.n_before == running
            running += row.n
        assert running == row.n_total == df.agg(F.sum("n")).first()[0]
    capsys.readouterr()
    table.explain("formatted")
    plan, _, subqueries = capsys.readouterr().out.partition("Subqueries")
    assert "sort_array" in subqueries
    assert "sequence(" not in plan  # every row used to carry the sample and make the cuts from it


def test_trees_are_fitted_on_partitions_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_TASK", 50)
    df = spark.range(2000).select(
        F.lit("p").alias("participant_id"), F.expr("date_add(DATE'2024-01-01', cast(id AS int))").alias("date"),
        (F.col("id") % 2).cast("int").alias("label"), F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double")).alias("features"),
    ).coalesce(1)
    sizes = [len(x) for x in M.spread(df).rdd.glom().collect()]
    assert len(sizes) == 40 and max(sizes) < 200  # one participant's rows, in one partition before
    assert M.spread(df, rows=4000).rdd.getNumPartitions() == 80
    asked = []
    monkeypatch.setattr(M, "spread", lambda df, *a, to=M.spread: asked.append(1) or to(df, *a))
    model = M.fit_boosted_trees(df, rounds=2)
    assert asked == [1]
    scored = M.predictions_table(model, df)
    assert scored.where((F.col("pred") > 0.5).cast("int") != F.col("label")).isEmpty()
