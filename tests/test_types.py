"""Types through transforms and datasets, columns that helpers must not take, statistics in pieces, decoding in the executors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import sampleloom.operators.stats as W
from sampleloom.functions.names import free_name, shared_folder
from sampleloom.operators import selection as S
from sampleloom.operators.dataset import Dataset, DatasetMetadata, create_dataset_from_arrays, create_dataset_from_paths, read_types
from sampleloom.operators.training import EarlyStopping, early_stopping
from sampleloom.plans import transforms as T


def rows(spark, n, kind, count=1):
    return spark.range(count).select(F.col("id").alias("row_idx"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda v: v.cast(kind)).alias("data"))


@pytest.mark.parametrize("kind", ["smallint", "int", "float", "double"])
def test_size_decides_no_type(spark, kind):
    for n in (T.LITERAL_INDEX, T.LITERAL_INDEX + 1):
        df = rows(spark, n, kind)
        for ops, want in (([T.Flip(0)], kind), ([T.Pad(n + 2, 0)], kind), ([T.GaussianBlur(0), T.ToFloat32()], "float"), ([T.RandomFlip(0)], kind), ([T.Normalize(1.0, 2.0)], "double")):
            out, _ = T.Compose(ops).apply(df, (n,))
            assert out.schema["data"].dataType.elementType.simpleString() == want
        assert T.Compose([T.Flip(0)]).apply(df, (n,))[0].first().data[:2] == [n, n - 1] and T.Compose([T.Pad(n + 2, 0)]).apply(df, (n,))[0].first().data[:2] == [0, 1]


def test_unsigned_samples(spark):
    x = T.Compose([T.Apply(np.copy), T.InvertPhase()])
    assert x.result("uint8") == "int16" and x.apply(rows(spark, 3, "smallint"), (3,), dtype="uint8")[0].first().data == [-1, -2, -3]
    noisy = T.Compose([T.RandomNoise(0, 500.0)]).apply(rows(spark, 50, "smallint"), (50,), dtype="uint8")[0].first().data
    assert min(noisy) == 0 and max(noisy) == 255
    with pytest.raises(TypeError):
        T.stored("complex64")


def test_normalize_with_arrays(spark):
    got = T.Compose([T.Normalize(np.arange(3.0), np.arange(1.0, 4.0))]).apply(rows(spark, 6, "float"), (2, 3))[0].first().data
    assert np.allclose(got, [1, 0.5, 1 / 3, 4, 2, 4 / 3])


def test_random_moves_native_and_in_kernels(spark, monkeypatch):
    """The same kinds of results by expressions and by kernels; rows draw apart, reruns and partitions don't matter."""
    df = rows(spark, 16, "double", 64)
    ops = {"crop": T.RandomCrop((0, 1), (2, 2)), "slice": T.RandomSlice(2), "flip": T.RandomFlip((0, 1)), "turn": T.RandomRotate90((0, 1)), "weak": T.RandomAttenuation((0.5, 1.0))}
    for name, op in ops.items():
        apply = lambda d, op=op: {r.row_idx: tuple(r.data) for r in T.Compose([op]).apply(d, (4, 4), seed=3)[0].collect()}
        native = apply(df)
        assert native == apply(df.repartition(7)) and len(set(native.values())) > 2
        assert "Python" not in T.Compose([op]).apply(df, (4, 4))[0]._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(type(op), "drawn", lambda *_: None)
        kernel = apply(df)
        assert len(set(kernel.values())) > 2 and (name == "weak" or set(native.values()) & set(kernel.values()))
        monkeypatch.undo()


def test_statistics_in_pieces(spark, monkeypatch):
    df = rows(spark, 10, "float", 5).withColumn("a.b", F.lit(1)).withColumn("statistics", F.lit("s")).withColumn("data", F.transform("data", lambda v: v * (F.col("row_idx") + 1)))
    stats = W.finalize(W.welford(df, (10,)))
    whole = W.normalize_by(df, stats).orderBy("row_idx").collect()
    monkeypatch.setattr(W, "BROADCAST_STATS", 4)
    assert W.normalize_by(df, stats).orderBy("row_idx").collect() == whole and whole[0].statistics == "s"


def test_helpers_take_no_columns(spark):
    names = ["part", "start", "shuffled", "run", "b_", "o_", "h_", "reset_", "run_"]
    df = spark.range(9).select("id", (F.lit(10.0) - F.col("id")).alias("loss"), *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for out in (S.dense_index(df, ["id"]), S.splits(df, ["id"], (3, 3, 3), seed=1), early_stopping(df, ["b_"], ["id"], "loss")):
        assert [out.first()[c] for c in names] == list(range(len(names)))
    assert free_name(df, "PART", "part_") == "PART__"


def test_one_early_stopping_rule(spark):
    losses = [3.0, 2.5, 2.5, 2.6, 2.49, 1.0, 1.0, 1.0, 1.0, 0.5]
    loop = EarlyStopping(3, 0.01)
    want = [(loop(v), loop.counter) for v in losses]
    got = early_stopping(spark.createDataFrame([(0, k, v) for k, v in enumerate(losses)], "s int, k int, loss double"), ["s"], ["k"], "loss", patience=3).orderBy("k").collect()
    assert [(r.stop, r.counter) for r in got] == want


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float16", "float32", "float64"])
def test_datasets_keep_types(spark, tmp_path, dtype):
    data = (np.arange(24).reshape(4, 2, 3) * 10).astype(dtype)
    path = f"file://{tmp_path}/{dtype}"
    create_dataset_from_arrays(spark, path, data=data, labels=np.arange(4, dtype=np.int32))
    found = Dataset(spark, path, transform=T.Compose([T.Permute((1, 0))]))
    x, label, _ = found[2]
    assert x.dtype == dtype and (x == data[2].T).all() and label.tolist() == [2] and read_types(spark, path) == {"data": dtype, "label": "int32"}
    assert spark.read.parquet(path).schema["data"].dataType.elementType.simpleString() == T.stored(dtype)


def test_paths_keep_order_and_types(spark, tmp_path):
    path = f"file://{tmp_path}/paths"

    def load(p):
        if int(p) % 3 == 0:
            raise OSError(p)
        return np.full((2,), int(p), np.uint8)

    failed = create_dataset_from_paths(spark, path, sample_paths=[str(k) for k in range(20)], loader=load, sample_shape=(2,), sample_dtype="uint8", labels=list(range(20)), header=DatasetMetadata("p"))
    assert [e.path for e in failed] == [str(k) for k in range(0, 20, 3)]
    found = Dataset(spark, path, ignore_header=False)
    got = found.df.orderBy("row_idx").collect()
    assert [(r.row_idx, r.data[0], r.label[0]) for r in got] == [(n, k, k) for n, k in enumerate(k for k in range(20) if k % 3)] and found.dtype == "uint8"


def test_metadata_is_decoded_in_the_executors(spark, tmp_path):
    path = f"file://{tmp_path}/meta"
    create_dataset_from_arrays(spark, path, data=np.zeros((3, 1)), sample_ids=["a", "b", "c"], sample_meta=[{"k": 1}, {"k": 2, "name": "own"}, {"k": 3}], header=DatasetMetadata("set", "test", 3))
    store = Dataset(spark, path, meta_decoder=lambda raw, i: f"{i}{json.loads(raw)['k']}", ignore_header=False).meta
    assert [r.meta for r in store.decoded_by("string").orderBy("view_idx").collect()] == ["a1", "b2", "c3"]
    got = store.decoded("k int, name string, sample_id string, split string").orderBy("view_idx").collect()
    assert [tuple(r.meta) for r in got] == [(1, "set", "a", "test"), (2, "own", "b", "test"), (3, "set", "c", "test")]


def test_no_folder_of_the_drivers_own_on_a_cluster():
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError):
        shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert shared_folder(Session()).startswith("file:///")


def test_metadata_by_paths(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    metas = [{"a": {"b": [1, 2]}}, {"a": "text"}, {"a": {"b": ["x"]}}, None]
    create_dataset_from_arrays(spark, path, data=np.zeros((4, 1)), sample_ids=list("wxyz"), sample_meta=metas, encoder=lambda m: b"{broken" if m is None else json.dumps(m).encode())
    found = Dataset(spark, path, meta_decoder=lambda raw, _: raw).meta.values(b=("$.a.b[0]", "int"), a=("$.a", "string")).orderBy("view_idx")
    assert [tuple(r) for r in found.collect()] == [(0, "w", 1, '{"b":[1,2]}'), (1, "x", None, "text"), (2, "y", None, '{"b":["x"]}'), (3, "z", None, None)]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
