"""Nearest neighbours and hard negatives against comparing everything."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.llm import hard_negatives, kmeans_tree, queries

SF = "/root/testdata/sf0.1"
ROWS = "vec_id bigint, embedding array<float>, label int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, ROWS).repartition(parts)


def fits(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def neighbours(rows, every, k=20):
    """Per query id its (vec_id, score), nearest first; ids are distinct."""
    rows = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and fits(v) and any(v)]
    d = max((len(v) for _, v in rows), default=0)
    ids = np.array([i for i, _ in rows])
    vectors = np.array([np.pad(v, (0, d - len(v))) for _, v in rows])
    out = {}
    for q, v in zip(ids, vectors):
        if q % every == 0:
            scores = (vectors * v).sum(1)
            order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
            out[int(q)] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in found] == list(range(1, len(found) + 1)) for found in out.values())
    return {q: [x[1:] for x in found] for q, found in out.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not there")
def test_recall_on_driver_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got, expected = found(queries.op12_nearest_neighbours(spark, SF)), neighbours(rows, 20)
    assert got.keys() == expected.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in expected.items()]
    assert np.mean(hits) / 20 >= 0.9
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows}
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs((vectors[q] * vectors[i]).sum() - s) < 1e-12 for i, s in near)


def test_clusters_need_few_visits(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16)) * 4
    rows = [(i, (centres[i % 60] + rng.normal(size=16) * 0.2).tolist(), 0) for i in range(6_000)]
    vectors = np.array([v for _, v, _ in rows])
    tree = kmeans_tree.Tree(vectors, len(vectors))
    assert tree.leaves > 8
    assert np.mean([len(set(order)) == len(order) for order in tree.visits(vectors[:50], tree.leaves)]) == 1
    got, expected = found(kmeans_tree.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0)), neighbours(rows, 100)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in near}) / 20 for q, near in expected.items()]) >= 0.9


def test_a_vector_that_most_rows_have_and_rows_that_take_no_part(spark):
    """Few distinct vectors are one leaf, so the result is exact."""
    rng = random.Random(2)
    rows = [(i, [1.0, 0.5, 0.0], 0) for i in range(300)] + [(i, [rng.gauss(0, 1) for _ in range(3)], 0) for i in range(300, 330)]
    rows += [(400, None, 0), (420, [0.0, 0.0, 0.0], 0), (440, [1.0, None, 0.0], 0), (460, [1.0, float("inf"), 0.0], 0)]
    rows += [(480, [float("nan")], 0), (None, [1.0, 1.0, 1.0], 0), (500, [2.0], 0), (520, [], 0), (-40, [0.5, 0.5, 0.5], 0)]
    rng.shuffle(rows)
    got, expected = found(kmeans_tree.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0)), neighbours(rows, 20)
    assert got.keys() == expected.keys() and {-40, 0, 500} <= got.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], rtol=0, atol=1e-12)


def test_few_and_no_rows_and_repeated_ids(spark):
    two = [(20, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (3, [0.5, 0.5], 0)]
    got = kmeans_tree.nearest(frame(spark, two), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 20, 1.0), (20, 1, 20, 1.0), (20, 2, 3, 0.5), (20, 2, 3, 0.5)]
    assert kmeans_tree.nearest(frame(spark, two[:1]), F.col("vec_id") % 20 == 0).count() == 0
    assert kmeans_tree.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_large_leaves_and_small_ones_are_laid_out_in_blocks():
    plan = kmeans_tree.layout({0: 5, 1: 3 * kmeans_tree.BLOCK + 1, 2: 7, 3: kmeans_tree.BLOCK, 4: 1}, 6)
    assert plan == [(0, 0, 1), (1, 1, 4), (2, 5, 1), (3, 6, 1), (4, 7, 1), (5, 7, 1)]


def negatives(rows):
    whole = [(i, (la + 1) % 10 if i % 7 == 0 else la, [int(np.floor(256 * float(np.float32(x)))) for x in v])
             for i, v, la in rows if i is not None and la is not None and fits(v)]
    out = []
    for a, anchor in enumerate(whole):
        if anchor[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(anchor[2], r[2])), r[0], r[1]) for b, r in enumerate(whole) if b != a)
        positives = [r for r in scored if r[2] == anchor[1]][:5]
        for s, positive, _ in positives:
            near = [r for r in scored if r[2] != anchor[1] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(anchor[0], positive, rank + 1, r[1], -s, -r[0]) for rank, r in enumerate(near)]
    return sorted(out)


def test_hard_negatives_of_a_hot_label_and_vector(spark, monkeypatch):
    """Small blocks, pages and slices, so that all that is dealt is dealt."""
    for name, value in {"BLOCK": 64, "ZONE": 8, "PAGE": 5, "PAGE_ANCHORS": 3, "SLICE": 2}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.choice([1] * 5 + list(range(10)))) for i in range(900)]
    rows += [(i, [0.5] * 6, i % 2) for i in range(900, 1300)]
    rows += [(1400, None, 1), (1500, [1.0, None], 1), (1600, [float("nan")] * 6, 1), (1700, [1.0] * 6, None), (None, [1.0] * 6, 2), (1800, [3.0, 1.0], 2)]
    rng.shuffle(rows)
    got = hard_negatives.mine(frame(spark, rows, 4))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == negatives(rows)


def test_hard_negatives_of_few_rows_and_nothing(spark):
    rows = [(0, [1.0, 0.0], 3), (100, [0.85, 0.0], 3), (5, [0.9, 0.1], 4), (7, [0.9, 0.0], 3)]
    assert sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows)).collect()) == negatives(rows) != []
    assert hard_negatives.mine(frame(spark, rows[:1])).count() == 0
    assert hard_negatives.mine(frame(spark, [])).count() == 0
    clash = frame(spark, rows).withColumns({c: F.lit("x") for c in ("block", "at", "v", "anchor", "page", "asks", "leaf")})
    assert sorted(tuple(r) for r in hard_negatives.mine(clash).collect()) == negatives(rows)
    assert kmeans_tree.nearest(clash, F.col("vec_id") % 20 == 0).count() == 2 * 3


def test_scores_beyond_doubles_are_longs():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-(2**29), 2**29, size=(4, 6)), rng.integers(-(2**29), 2**29, size=(5, 6))
    assert hard_negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert hard_negatives.bounds(a, b, b) is None


def test_curve_visits_every_cell_by_single_steps():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    walk = cells[np.argsort(hard_negatives.hilbert(cells, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(6)
    anchors, rows = rng.integers(-300, 300, size=(9, 5)), rng.integers(-300, 300, size=(40, 5))
    low, high = hard_negatives.bounds(anchors, rows.min(0)[None], rows.max(0)[None])
    scores = hard_negatives.products(anchors, rows)
    assert (low[:, 0] <= scores.min(1)).all() and (scores.max(1) <= high[:, 0]).all()
