"""Linear ops as maps: products, one pass, and the same numbers as op by op."""

import numpy as np
import pytest

from sampleloom.functions import kernels as K
from sampleloom.functions import linear as L
from sampleloom.plans import transforms as T


def rows(spark, x, kind="double"):
    return spark.createDataFrame([(k, None if v is None else [float(e) for e in np.ravel(v)]) for k, v in enumerate(x)], f"row_idx long, data array<{kind}>")


def values(df, shape):
    return np.array([r.data for r in df.orderBy("row_idx").collect()]).reshape(-1, *shape)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def matrix(m, n):
    """A map written out, its added part apart."""
    full = np.zeros((len(m.count), n))
    for o, (i, w, c) in enumerate(zip(m.index, m.weight, m.count, strict=True)):
        np.add.at(full[o], i[:c], w[:c])
    return full


@pytest.mark.parametrize("first", [L.blur(0, 9, 1.0, 4), L.resize(0, 9, 5), L.taken(0, np.array([-1, 8, 7, 0, -1, -1]), 2.5), L.cosine(0, 9)])
@pytest.mark.parametrize("second", [lambda n: L.blur(0, n, 0.7, 6), lambda n: L.resize(0, n, 4), lambda n: L.resize(0, n, 1), lambda n: L.taken(0, np.arange(n)[::-1], 0.0), lambda n: L.taken(0, np.r_[-1, 0, -1], -3.0)])
def test_a_product_is_the_product_of_the_matrices(first, second):
    x = np.random.default_rng(1).normal(0, 1, (3, 9, 2))
    then = second(len(first.count))
    both = first.then(then)
    assert np.allclose(matrix(both, 9), matrix(then, len(first.count)) @ matrix(first, 9))
    assert np.allclose(both.apply(x), then.apply(first.apply(x)))
    assert all((both.weight[o, :c] != 0).all() and len(set(both.index[o, :c])) == c for o, c in enumerate(both.count))


def test_maps_pass_others_only_where_they_commute():
    blurs = [L.blur(0, 8, 1.0, 2), L.blur(1, 6, 1.0, 2), L.resize(0, 8, 4), L.resize(1, 6, 3)]
    assert [m.dims for m in L.product(blurs)] == [(0,), (1,)]
    filled = L.taken(1, np.r_[-1, np.arange(6), -1], 2.0)
    cosines = [L.cosine(0, 8), filled, L.cosine(0, 8)]
    assert [m.dims for m in L.product(cosines)] == [(0,), (1,), (0,)]
    assert [m.dims for m in L.product([L.resize(0, 8, 8), L.turn((0, 1), 8, 6, 30, 0.0), L.resize(0, 8, 4)])] == [(0,), (0, 1), (0,)]
    x = np.random.default_rng(2).normal(0, 1, (2, 8, 6))
    for maps in (blurs, cosines):
        one, few = x, x
        for m in maps:
            one = m.apply(one)
        for m in L.product(maps):
            few = m.apply(few)
        assert np.allclose(one, few)


RUNS = [
    ([T.Flip(0), T.GaussianBlur(0, 1.0, 2), T.ResizeRoundTrip(0, 0.5)], (20,), 1),
    ([T.GaussianBlur((0, 1), 1.0, 2), T.CenterCrop((0, 1), (4, 3)), T.Flip(-1)], (6, 8), 2),
    ([T.Pad((9, 11), (0, 1), "constant", 2.0), T.RotateAnyDegree((0, 1), 30.0, 1.5), T.Flip(1)], (6, 8), None),
    ([T.RandomCrop((0, 1), (5, 5), train=False), T.Pad(9, 1, "reflect"), T.GaussianBlur(1, 0.8, 3), T.DCT((1,), log=False)], (6, 8), None),
    ([T.RotateAnyDegree((1, 0), 77.0), T.RotateAnyDegree((0, 1), 200.0, 3.0)], (2, 5, 5), 1),
]


@pytest.mark.parametrize("ops, shape, maps", RUNS)
def test_a_run_is_one_op_and_equals_the_ops_in_turn(spark, ops, shape, maps):
    x = np.random.default_rng(3).normal(0, 1, (5, *shape))
    c = T.Compose(ops)
    [(place, run)] = T.fused(ops, shape, "float64")
    assert place == 0 and (maps is None or len(run.maps) == maps)
    want = np.array([c.kernel(v) for v in x])
    assert c.shape(shape) == want.shape[1:] == run.shape(shape) and np.allclose(run.batch(x), want)
    df, out = c.apply(rows(spark, x), shape)
    assert out == want.shape[1:] and np.allclose(values(df, out), want)
    assert plan(df).count("ArrowEvalPython") == 1


def test_maps_before_moves_draws_and_kernels(spark):
    x = np.random.default_rng(6).normal(0, 1, (4, 4, 6))
    for ops in ([T.GaussianBlur(1, 1.0, 2), T.Permute((1, 0)), T.Apply(np.abs)], [T.Normalize(0.5, 2.0), T.Permute((1, 0)), T.Normalize(1.0, 3.0), T.Rotate90((0, 1)), T.Apply(np.abs)], [T.ResizeRoundTrip(0, 0.5), T.RandomCrop((0, 1), (2, 3)), T.RandomFlip(0), T.RandomErasing(0)]):
        df, shape = T.Compose(ops).apply(rows(spark, x), (4, 6), seed=7)
        assert np.allclose(values(df, shape), [T.Compose(ops).kernel(v, 7, k) for k, v in enumerate(x)])


def test_long_runs_go_on_in_one_pass_with_the_ops_behind(spark):
    x = np.random.default_rng(5).normal(0, 1, (3, 70, 70))
    ops = [T.Flip(0), T.GaussianBlur((0, 1), 1.0), T.ResizeRoundTrip((0, 1), 0.5), T.RandomNoise(0), T.GaussianBlur(0), T.Normalize(0.5, 2.0)]
    df, shape = T.Compose(ops).apply(rows(spark, x), (70, 70), seed=3)
    want = np.array([T.Compose(ops).kernel(v, 3, k) for k, v in enumerate(x)])
    assert np.allclose(values(df, shape), want) and plan(df).count("ArrowEvalPython") == 1
    steps = T.fused(ops, (70, 70), "float64")
    assert [k for k, _ in steps] == [0, 3, 4, 5] and len(steps[0][1].maps) == 2  # the places, which random numbers come from, stay


def test_moves_alone_whole_numbers_and_log_cosines_stay_as_they_are():
    assert [type(op) for _, op in T.fused([T.Flip(0), T.Pad(9, 0)], (8,), "float64")] == [T.Flip, T.Pad]
    assert [type(op) for _, op in T.fused([T.Flip(0), T.GaussianBlur(0)], (8,), "uint8")] == [T.Flip, T.GaussianBlur]
    assert [type(op) for _, op in T.fused([T.DCT((0,))], (8,), "float64")] == [T.DCT]
    assert [type(op) for _, op in T.fused([T.GaussianBlur(0, (0.5, 2.0))], (8,), "float64")] == [T.GaussianBlur]


def test_nulls_and_values_that_are_not_finite(spark):
    x = np.zeros(8)
    x[2], x[6] = np.nan, np.inf
    df, _ = T.Compose([T.ResizeRoundTrip(0, 1.0), T.Flip(0)]).apply(rows(spark, [x, None]), (8,))
    got = [r.data for r in df.orderBy("row_idx").collect()]
    assert got[1] is None
    assert np.array_equal(np.array(got[0], float), x[::-1], equal_nan=True)  # NaN leaves a kernel as null; weights of 0 spread nothing
    assert np.array_equal(K.resize_round_trip(x, (0,), 1.0), x, equal_nan=True)
