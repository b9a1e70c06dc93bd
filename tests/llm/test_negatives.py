"""Hard negatives against a loop over all rows, and against SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, positives=5, negatives=3):
    """rows: (id, vector, label); the contract of the query, row by row."""
    taking = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        taking.append((vec_id, [math.floor(256 * x) for x in vector], label))
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (anchor, u, label) in enumerate(taking):
        if anchor is None or anchor % 50:
            continue
        scores = [(sum(x * y for x, y in zip(u, v)), i, lab == label) for b, (i, v, lab) in enumerate(taking) if b != a]
        same = sorted([(s, i) for s, i, own in scores if own], key=key)[:positives]
        for p, positive in same:
            fits = sorted([(s, i) for s, i, own in scores if not own and 50 * p <= 100 * s <= 95 * p], key=key)[:negatives]
            out += [(anchor, positive, rank, i, p, s) for rank, (s, i) in enumerate(fits, 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    return result(negatives.op11_hard_negatives(spark, str(tmp_path)))


def unit(rng, width, count, spread=1.0):
    out = rng.normal(size=(count, width)) * spread ** np.arange(width)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


@pytest.mark.parametrize("width,labels,spread", [(16, 10, 1.0), (33, 3, 0.8), (5, 40, 1.0)])
def test_against_a_loop(spark, tmp_path, width, labels, spread, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK_BYTES", width * 8 * 14)  # several chunks of anchors
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(width)
    vectors = unit(rng, width, 1200, spread)
    rows = [(int(i), v.tolist(), int(rng.integers(labels))) for i, v in enumerate(vectors)]
    expected = by_hand(rows)
    assert run(spark, tmp_path, rows) == expected and expected


def test_ties_copies_and_rows_that_take_no_part(spark, tmp_path):
    rng = random.Random(3)
    base = [[rng.choice([-1.0, 0.5, 1.0]) for _ in range(6)] for _ in range(30)]
    rows = [(i, rng.choice(base), rng.choice([0, 1, 2])) for i in range(0, 500, 2)]
    rows += rows[:40] + [(50, base[0], 9), (100, [], 1), (150, base[1][:3], 0), (200, [2.0**14] * 6, 1), (None, base[0], 1), (None, base[0], 1), (7, base[2], -1)]
    rows += [(250, None, 1), (300, [1.0, None], 1), (350, [math.nan], 1), (400, [math.inf, 1.0], 1), (450, base[3], None), (451, [1e300], 0)]
    expected = by_hand([r for r in rows if r[0] != 451])  # its squared norm does not fit
    assert run(spark, tmp_path, rows) == expected and expected


def test_large_components_stay_exact(spark, tmp_path):
    rng = np.random.default_rng(1)
    for scale, folder in ((2.0**9, "a"), (2.0**19, "b"), (2.0**21, "c")):
        rows = [(int(i), (v * scale).tolist(), int(rng.integers(4))) for i, v in enumerate(unit(rng, 8, 300))]
        expected = by_hand(rows)
        assert run(spark, tmp_path / folder, rows) == expected and expected


def test_no_rows_and_no_anchors(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    assert run(spark, tmp_path / "b", [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert run(spark, tmp_path / "c", [(50, [1.0], 0)]) == []


def test_clashing_columns_and_own_limits(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), v.tolist(), int(i) % 3, "x", 5) for i, v in enumerate(unit(rng, 8, 200))]
    df = spark.createDataFrame(rows, "key long, v array<float>, kind int, window string, rank int")
    got = result(negatives.mine(df, "key", "v", "kind", F.col("id") < 9, positives=2, negatives=1, least_percent=20, most_percent=80))
    taking = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), k) for i, v, k, *_ in rows]
    expected = []
    for a, u, k in taking[:9]:
        scores = [(int(u @ v), i, k == kk) for i, v, kk in taking if i != a]
        for p, i in sorted([(s, i) for s, i, own in scores if own], key=lambda x: (-x[0], x[1]))[:2]:
            fits = sorted([(s, j) for s, j, own in scores if not own and 20 * p <= 100 * s <= 80 * p], key=lambda x: (-x[0], x[1]))[:1]
            expected += [(a, i, 1, j, p, s) for s, j in fits]
    assert got == sorted(expected, key=str) and expected


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    relation = con.sql(negatives.OP11_SQL)
    assert relation.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = sorted(relation.fetchall(), key=str)
    assert result(negatives.op11_hard_negatives(spark, folder)) == expected and expected


@pytest.mark.parametrize("kind", [2**3, 2**12, 2**26])
def test_lists_find_every_pair(kind):
    rng = np.random.default_rng(kind)
    rows, anchors = (rng.integers(-kind, kind, (n, 24)) * (rng.random((n, 24)) < 0.5) for n in (300, 40))
    largest = float(np.sqrt((anchors.astype(float) ** 2).sum(axis=1)).max())
    scores = anchors @ rows.T
    for low in (np.full(40, -(2**62)), np.quantile(scores, 0.99, axis=1).astype(np.int64), np.quantile(scores, rng.random(40)).astype(np.int64), scores.max(axis=1)):
        i, j, score = negatives.Lists(rows, largest).pairs(anchors, low, slice(20, 290))
        expected = {(a, b, scores[a, b + 20]) for a in range(40) for b in range(270) if scores[a, b + 20] >= low[a]}
        assert set(zip(i.tolist(), j.tolist(), score.tolist())) == {tuple(map(int, x)) for x in expected} and len(i) == len(expected)
