"""Assignments of many images side by side."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from geoquarry.operators import kernels


def reads_and_cogroups(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("FlatMapCoGroups")


def stack(sizes, seed, whole):
    """Costs of groups of ``sizes``, padded by costs that would be taken first."""
    rng = np.random.default_rng(seed)
    high, wide = (max((s[k] for s in sizes), default=0) for k in (0, 1))
    cost = rng.integers(0, 5, (len(sizes), high, wide)).astype(float) if whole else rng.random((len(sizes), high, wide))
    for g, (n, m) in enumerate(sizes):
        cost[g, n:], cost[g, :, m:] = -9, -9
    return cost, *(np.array([s[k] for s in sizes], int) for k in (0, 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=8), st.integers(0, 10_000), st.booleans(), st.sampled_from([-1.0, 0.0, 0.3, 2.0, 9.0]))
def test_a_stack_within_a_limit_is_assigned_as_each_group(sizes, seed, whole, most):
    cost, n, m = stack(sizes, seed, whole)
    want = [[g, i, j] for g, (a, b) in enumerate(sizes) for i, j in kernels.assign_within(cost[g, :a, :b], most)[0]]
    assert kernels.assign_many_within(cost, n, m, most).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4)), min_size=1, max_size=8), st.integers(0, 10_000), st.booleans())
def test_a_stack_is_assigned_as_each_group(sizes, seed, whole):
    sizes = [(n, n + more) for n, more in sizes]
    cost, n, m = stack(sizes, seed, whole)
    row = kernels.assign_many(cost, n, np.arange(cost.shape[2]) < m[:, None])
    for g, (a, b) in enumerate(sizes):
        assert sorted((int(i), j) for j, i in enumerate(row[g]) if i >= 0) == kernels.assign(cost[g, :a, :b])


def test_groups_of_like_size_fill_a_stack(monkeypatch):
    monkeypatch.setattr(kernels, "CELLS", 40)
    n, m = np.array([2, 9, 2, 3, 2]), np.array([5, 9, 4, 4, 3])
    parts = [p.tolist() for p in kernels.by_size(n, m)]
    assert sorted(sum(parts, [])) == list(range(5)) and [1] in parts
    assert all(len(p) == 1 or len(p) * n[p].max() * m[p].max() <= 40 for p in parts)


def test_assignment_matches_images_together(spark, data):
    """One reading of the boxes and no call for each image; the pairs are those of each image by itself."""
    df = entry.queries()["assignment"](spark, data)
    assert reads_and_cogroups(df) == (1, 0)
    from geoquarry.plans.views import detections, truths

    got = {tuple(r) for r in df.collect()}
    dets, gts = (f(spark, data).toPandas() for f in (detections, truths))
    want, corner = set(), list(kernels.CORNERS)
    for image, t in gts.sort_values("gt_id").groupby("image_id"):
        d = dets[dets.image_id == image].sort_values("det_id")
        cost = 1 - kernels.box_iou(d[corner].to_numpy(), t[corner].to_numpy())
        want |= {(image, d.det_id.iloc[i], t.gt_id.iloc[j], cost[i, j]) for i, j in kernels.assign_within(cost, 0.8)[0]}
    assert got == want and got
    assert {tuple(r) for r in kernels.optimal_match(detections(spark, data), truths(spark, data)).collect()} == want


def test_set_matching_matches_images_together(spark, data):
    assert reads_and_cogroups(entry.queries()["set_matching"](spark, data)) == (1, 0)


def test_set_match_pairs_unknown_costs_last(spark):
    """A box or class that is null leaves its costs unknown; a null class raised before, and other unknown costs could keep the search from ending."""
    preds = spark.createDataFrame([(1, 1, 0.2, 0.2, 0.1, 0.1, [0.9, 0.1]), (1, 2, None, 0.2, 0.1, 0.1, [0.9, 0.1]), (1, 3, 0.7, 0.7, 0.1, 0.1, [0.1, 0.9]), (2, 1, None, 0.5, 0.1, 0.1, [0.5, 0.5]), (3, 1, 0.5, 0.5, 0.1, 0.1, [0.5, 0.5])], "image_id long, det_id long, cx double, cy double, w double, h double, scores array<double>")
    truths = spark.createDataFrame([(1, 1, 0.7, 0.7, 0.1, 0.1, 1), (1, 2, 0.2, 0.2, 0.1, 0.1, 0), (2, 1, 0.5, 0.5, 0.1, 0.1, 0), (2, 2, 0.4, 0.5, 0.1, 0.1, None), (4, 1, 0.5, 0.5, 0.1, 0.1, 0)], "image_id long, gt_id long, cx double, cy double, w double, h double, cls int")
    rows = {(r.image_id, r.det_id, r.gt_id): r.cost for r in kernels.set_match(preds, truths).collect()}
    assert set(rows) == {(1, 1, 2), (1, 3, 1), (2, 1, 1)} and rows[2, 1, 1] == pytest.approx(1e6)


@pytest.mark.parametrize("n, m", [(3, 7), (7, 3), (4, 4)])
def test_set_match_is_least_in_either_direction(spark, n, m):
    rng = np.random.default_rng(n)
    p, t, scores, cls = rng.random((n, 4)), rng.random((m, 4)), rng.random((n, 3)), rng.integers(0, 3, m)
    preds = spark.createDataFrame([(5, i, *map(float, p[i]), scores[i].tolist()) for i in range(n)], "image_id long, det_id long, cx double, cy double, w double, h double, scores array<double>")
    truths = spark.createDataFrame([(5, i, *map(float, t[i]), int(cls[i])) for i in range(m)], "image_id long, gt_id long, cx double, cy double, w double, h double, cls int")
    got = {(r.det_id, r.gt_id): r.cost for r in kernels.set_match(preds, truths).collect()}
    cost = kernels.set_match_cost(p, scores, t, cls)
    assert got == {(i, j): cost[i, j] for i, j in kernels.assign(cost)}


def test_unknown_boxes_of_a_stack_are_left_open():
    rng = np.random.default_rng(3)
    cost = rng.random((20, 6, 7))
    n, m = rng.integers(1, 7, 20), rng.integers(1, 8, 20)
    # What is padded is read from the last group's last column.
    n[-1], m[-1], cost[-1], cost[:-1, :, 2] = 1, 3, 0.1, np.nan
    want = [[g, i, j] for g in range(20) for i, j in kernels.assign_within(cost[g, : n[g], : m[g]], 0.7)[0]]
    assert kernels.assign_many_within(cost, n, m, 0.7).tolist() == want and want
