"""Statistics of large means, losses that are NaN, images of bytes, positions in many ranges, blocks of slices, manifests, scratch folders."""

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom import errors as E
from sampleloom import queries as Q
from sampleloom.functions import kernels as K
from sampleloom.operators import selection as S
from sampleloom.operators import stats as W
from sampleloom.operators.dataset import Dataset, DatasetMetadata, create_dataset, create_dataset_from_arrays, files_of, read_manifest
from sampleloom.operators.training import EarlyStopping, early_stopping
from sampleloom.plans import transforms as T
from sampleloom.streaming.incremental import ordered_stop_signals, stop_signals

REPO = Path(__file__).resolve().parents[1]
NAN = float("nan")


def rows(spark, x, **more):
    return spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)], "row_idx long, data array<double>")


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_merge_of_shards_at_an_offset(spark, offset):
    x = offset + np.arange(7.0).reshape(7, 1)
    shards = W.welford(rows(spark, x).withColumn("s", F.col("row_idx") % 5), (1,), keys=["s"])
    got = W.finalize(W.merge(shards)).first()
    assert abs(got["std"] - 2.0) < 1e-6 and got["mean"] == offset + 3 and got["count"] == 7


def test_merge_by_null_keys_and_of_empty_parts(spark):
    parts = spark.createDataFrame([(None, 0, 2.0, 1.0, 2.0), (None, 0, 2.0, 3.0, 2.0), ("a", 0, 0.0, 9.0, 0.0), ("b", 0, 1.0, 5.0, 0.0)], "k string, pos long, count double, mean double, m2 double")
    got = {r.k: (r["count"], r["mean"], r["m2"]) for r in W.merge(parts, ["k"]).collect()}
    assert got == {None: (4.0, 2.0, 8.0), "b": (1.0, 5.0, 0.0)}


@pytest.mark.parametrize("dim", [(0,), (0, 1), (0, 2), (0, 1, 2), None])
@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_vector_states(spark, monkeypatch, dim, offset):
    monkeypatch.setattr(W, "ROW_ELEMENTS", 0)
    monkeypatch.setattr(W, "BLOCK", 5)
    x = offset + np.random.default_rng(1).normal(5, 2, (40, 3, 4))
    df = rows(spark, x).repartition(7)
    got = W.finalize(W.welford(df, (3, 4), dim)).orderBy("pos").collect()
    mean, std = (np.ravel(f(x, axis=dim)) for f in (np.mean, np.std))
    assert np.allclose([r["mean"] for r in got], mean, rtol=1e-12) and np.allclose([r["std"] for r in got], std, rtol=1e-6)
    plan = W.welford(df, (3, 4), dim)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("MapInArrow")[1]  # no row for each element before the states


def test_vector_states_skip_nulls_and_keep_keys(spark, monkeypatch):
    df = spark.createDataFrame([("a", [1.0, None, 3.0]), ("a", [3.0, None, None]), (None, None), (None, [5.0, 6.0, 7.0]), ("b", None)], "k string, data array<double>").repartition(3)
    want = sorted(map(str, W.welford(df, (3,), keys=["k"]).where("count > 0").collect()))
    monkeypatch.setattr(W, "ROW_ELEMENTS", 0)
    assert sorted(map(str, W.welford(df, (3,), keys=["k"]).collect())) == want
    assert W.welford(df.limit(0), (3,), keys=["k"]).count() == 0
    with pytest.raises(Exception, match="elements"):
        W.welford(df, (4,), keys=["k"]).collect()
    monkeypatch.setattr(W, "HELD", 1)  # states leave the task early
    assert sorted(map(str, W.welford(df, (3,), keys=["k"]).collect())) == want


def test_normalize_reads_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(x):
        seen.add(1)
        return x

    df = rows(spark, np.arange(12.0).reshape(4, 3))
    stats = W.finalize(W.welford(df.withColumn("data", counted.asNondeterministic()("data")), (3,)))
    first = W.normalize_by(df, stats, size=3).orderBy("row_idx").collect()
    assert seen.value == 4
    assert W.normalize_by(df, stats).orderBy("row_idx").collect() == first and seen.value == 8


LOSSES = [[1.0, NAN, NAN, NAN], [NAN, 3.0, 1.0, NAN, 0.5], [2.0, 1.0, NAN, 1.0, 0.5, 0.499, NAN, 0.2], [5.0], [NAN]]


def stepwise(losses, patience):
    rule, out = EarlyStopping(patience), []
    for x in losses:
        rule(x)
        out.append((rule.counter, bool(rule)))
    return out


def test_early_stopping_sees_nan(spark):
    assert stepwise(LOSSES[0], 2) == [(0, False), (1, False), (2, True), (3, True)]
    data = [(s, k, v) for s, losses in enumerate(LOSSES) for k, v in enumerate(losses)] + [(0, 9, None)]
    df = spark.createDataFrame(data, "series long, step long, loss double")
    got = early_stopping(df, ["series"], ["step"], "loss", patience=2).orderBy("series", "step").collect()
    assert [(r.counter, r.stop) for r in got] == [x for losses in LOSSES for x in stepwise(losses, 2)]


def test_streamed_early_stopping_sees_nan(spark, tmp_path):
    data = [(str(s), k, v) for s, losses in enumerate(LOSSES) for k, v in enumerate(losses)] + [("0", 9, None)]
    for part, keep in (("a", lambda k: k < 2), ("b", lambda k: k >= 2)):
        spark.createDataFrame([r for r in data if keep(r[1])], "series string, step long, loss double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{part}")
    out = {}
    for n, part in enumerate("ab"):
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        for f in Path(f"{tmp_path}/{part}").glob("*.parquet"):
            f.rename(f"{tmp_path}/in/{n}-{f.name}")
        stream = spark.readStream.schema("series string, step long, loss double").parquet(f"{tmp_path}/in")
        query = stop_signals(stream, "series", "step", "loss", patience=2).writeStream.foreachBatch(lambda b, _: out.update({(r.series, r.step): (r.counter, r.stop) for r in b.collect()}))
        query.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert [out[str(s), k] for s, losses in enumerate(LOSSES) for k in range(len(losses))] == [x for losses in LOSSES for x in stepwise(losses, 2)] and len(out) == sum(map(len, LOSSES))


@pytest.mark.parametrize("factor", [0, 1, 2, 3])
def test_color_jitter_keeps_bytes(factor):
    x = np.random.default_rng(3).integers(0, 256, (3, 8, 8)).astype(np.uint8)
    values = [1.0, 1.0, 1.0, None]
    values[factor] = 0.2 if factor == 3 else 1.3
    y = T.ColorJitter(*values).draw(x, np.random.default_rng(1))
    want = [K.adjust_brightness, K.adjust_contrast, K.adjust_saturation, K.adjust_hue][factor](x, values[factor])
    assert y.dtype == np.uint8 and (y == want).all() and len(np.unique(y)) > 20
    assert (T.ColorJitter().draw(x, np.random.default_rng(1)) == x).all()


def test_jpeg_refuses_what_it_cant_store():
    x = np.random.default_rng(3).uniform(0, 1, (3, 8, 8))
    for bad in (x, x - 5, np.full((3, 8, 8), 256.0)):
        with pytest.raises(ValueError):
            T.JPEGCompression(75).kernel(bad, None)
    whole = np.floor(x * 255)
    assert (T.JPEGCompression(75).kernel(whole, None) == T.JPEGCompression(75).kernel(whole.astype(np.uint8), None)).all()


#: A vector whose image of bytes moves by 40.3 on average at the quality that row 28211 draws.
FAR = [143, 37, 147, 67, 195, 39, 127, 217, 177, 33, 197, 220, 164, 53, 121, 102, 255, 190, 132, 136, 148, 50, 76, 91, 198, 117, 134, 187, 23, 174, 22, 198, 113, 98, 19, 197, 241, 44, 167, 3, 113, 133, 194, 61, 93, 199, 132, 202, 238, 141, 235, 10, 175, 122, 251, 93, 99, 131, 0, 133, 150, 75, 170, 102]


def test_jpeg_query_holds_for_images_that_move_far(spark, tmp_path):
    r = np.random.default_rng(5)
    vectors = [(28211, [float(v) + (0 < v < 255) / 2 for v in FAR])] + [(k, r.normal(size=64).tolist()) for k in range(200)]
    spark.createDataFrame([(k, v, 0) for k, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.QUERIES["jpeg_compression"](spark, str(tmp_path)).collect()
    assert sorted(x.vec_id for x in got) == [*range(200), 28211] and all(x.holds and x.n == 66 for x in got)


def test_jpeg_query_tells_other_bytes(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(3, np.random.default_rng(6).normal(size=64).tolist(), 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    real = T.JPEGCompression
    monkeypatch.setattr(Q.T, "JPEGCompression", lambda quality: real((95, 96)))
    assert not Q.QUERIES["jpeg_compression"](spark, str(tmp_path)).first().holds


def test_dense_index_splits_ties(spark):
    df = spark.range(1000).select(F.lit("same").alias("v"), "id")
    got = S.dense_index(df, ["v"], ranges=10)
    assert sorted(r.row_idx for r in got.collect()) == list(range(1000))
    parts = [r["count"] for r in spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).groupBy(F.input_file_name()).count().collect()]
    assert len(parts) >= 5 and max(parts) < 400
    both = S.dense_index(df.withColumn("v", F.lit(1)), ["v", "id"], ranges=10).collect()
    assert all(r.row_idx == r.id for r in both)


@pytest.mark.parametrize("dim,block", [(0, 7), (1, 5), (1, 1000), (2, 1)])
def test_slice_blocks(spark, dim, block):
    x = np.arange(2 * 3 * 4 * 6.0).reshape(6, 2, 3, 4)
    got = S.slice_blocks(rows(spark, x).repartition(4), (2, 3, 4), dim, block=block).orderBy("row", "block").collect()
    want = np.moveaxis(x, dim + 1, 0).reshape(x.shape[dim + 1], -1)
    assert max(len(r.data) for r in got) <= block
    for k, line in enumerate(want):
        assert [v for r in got if r.row == k for v in r.data] == line.tolist()
    with pytest.raises(ValueError):
        S.take_along(rows(spark, x), (2, 3, 4), dim, size=1 << 24)


def reads(spark, df):
    """Rows that the scans of a plan hand on."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    text, found = [plan], 0
    while text:
        node = text.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            text.append(node.executedPlan())
        elif node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        else:
            text += [node.children().apply(k) for k in range(node.children().size())]
            text += [node.plan()] if "QueryStage" in node.nodeName() else []
    return found


def test_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    df = spark.range(20_000).select("id", F.array(F.col("id").cast("double")).alias("data"), F.col("id").cast("string").alias("sample_id"), F.lit(b"{}").alias("sample_meta"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert create_dataset(df, path, order=["id"], shape=(1,), header=DatasetMetadata("d")) == 20_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = read_manifest(spark, path)
    assert manifest["rows"] == manifest["data"] == manifest["sample_id"] == 20_000 and manifest["label"] == 0 and len(manifest["ranges"]) > 1
    assert 1 <= len(files_of(manifest, [5, 6])) < len(manifest["ranges"]) and files_of(manifest, []) == []
    view = Dataset(spark, path, ignore_header=False, select_indices=[7, 5, -1])
    assert [r.data[0] for r in view.df.orderBy("view_idx").collect()] == [7.0, 5.0, 19_999.0]
    assert [r.data[0] for r in Dataset(spark, path, select_sample_ids=["9", "3"]).df.orderBy("view_idx").collect()] == [9.0, 3.0]
    with pytest.raises(E.UnknownSampleIdsError):
        Dataset(spark, path, select_sample_ids=["9", "none"])
    spark.read.parquet(path).limit(1).withColumn("row_idx", F.lit(20_000).cast("long")).write.mode("append").parquet(path)
    assert read_manifest(spark, path) is None  # files were added: everything is counted anew
    with pytest.raises(E.NumSamplesMismatchError):
        Dataset(spark, path, ignore_header=False)


def test_opening_reads_no_columns(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    create_dataset_from_arrays(spark, path, data=np.arange(40.0).reshape(10, 4), labels=np.arange(10.0), header=DatasetMetadata("d", num_samples=10))
    tracker, before = spark.sparkContext.statusTracker(), 0
    spark.sparkContext.setJobGroup("opening", "opening")
    Dataset(spark, path, ignore_header=False)
    assert len(tracker.getJobIdsForGroup("opening")) <= 2  # the schema of a footer and one row's shape
    spark.sparkContext._jsc.clearJobGroup()
    raw = json.loads(Path(f"{tmp_path}/d/_manifest.json").read_text())
    Path(f"{tmp_path}/d/_manifest.json").write_text(json.dumps(raw | {"label": 3}))
    for crc in Path(f"{tmp_path}/d").glob("._manifest*"):
        crc.unlink()
    with pytest.raises(E.ShapeMismatchError):
        Dataset(spark, path)


def test_without_a_checkpoint_folder(tmp_path):
    """Queries that write intermediate tables run in a session that names no shared folder."""
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
names = [n for n in ("dataset_round_trip", "split_sorted", "snapshot_merge", "op6_mix_sources") if n in e.queries()]
for n in names:
    assert e.queries()[n](spark, "/root/testdata/sf0.001").count() > 0
assert spark.conf.get("spark.checkpoint.dir", None) is None
spark.stop()
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(REPO), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


RANDOM = [
    (T.RandomCrop((0, 1), (3, 2)), (4, 4)), (T.RandomSlice(3), (1, 16)), (T.RandomSlice(3, 0), (4, 4)), (T.RandomFlip((0, 1), (0.3, 0.8)), (4, 4)), (T.RandomRotate90((0, 1)), (4, 4)),
    (T.MixSample(tuple(float(k) for k in range(30)), (0.1, 0.9)), (1, 16)), (T.RandomAttenuation((0.3, 0.9)), (4, 4)), (T.RandomAttenuation(0.5), (4, 4)),
]


@pytest.mark.parametrize("op,shape", RANDOM)
@pytest.mark.parametrize("seed,epoch", [(0, 0), (-3, 2), (2**40, 2**35)])
def test_native_and_kernel_draws_agree(spark, monkeypatch, op, shape, seed, epoch):
    df = rows(spark, np.random.default_rng(1).normal(0, 1, (30, *shape))).withColumn("row_idx", F.col("row_idx") * 10**12 - 5)
    run = lambda: {r.row_idx: tuple(r.data) for r in T.Compose([T.NoTransform(), op]).apply(df, shape, seed=seed, epoch=epoch)[0].collect()}
    native = run()
    monkeypatch.setattr(T, "LITERAL_INDEX", 0)
    monkeypatch.setattr(type(op), "drawn", lambda *_: None)
    assert run() == native and len(set(native.values())) > (2 if "0.5" not in str(op) else 0)


def test_numbers_are_spread():
    from sampleloom.functions.draws import Numbers

    many = np.concatenate([Numbers(1, 2, k).many(200) for k in range(200)])
    assert abs(many.mean() - 0.5) < 0.01 and len(np.unique(many)) == len(many) and many.min() >= 0 and many.max() < 1
    normal = np.concatenate([Numbers(1, 3, k).normal(2, 3, (5, 7)).ravel() for k in range(500)])
    assert abs(normal.mean() - 2) < 0.1 and abs(normal.std() - 3) < 0.1 and len(np.unique(normal)) == len(normal)
    orders = {tuple(Numbers(1, 4, k).permutation(3)) for k in range(100)}
    assert len(orders) == 6
    picks = [Numbers(1, 5, k).choice(3, 2, False, np.array([1.0, 0.0, 3.0])) for k in range(100)]
    assert {tuple(sorted(p)) for p in picks} == {(0, 2)} and 50 < sum(p[0] == 2 for p in picks) < 95
    assert {Numbers(1, 6, k).integers(3, 6) for k in range(60)} == {3, 4, 5}


def test_shuffled_steps_give_the_batch_result(spark, tmp_path):
    data = [(str(s), k, v) for s, losses in enumerate(LOSSES) for k, v in enumerate(losses)] + [("0", 1, NAN), ("0", 99, None), ("0", -1, 0.0)]
    np.random.default_rng(8).shuffle(order := list(range(len(data))))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    for n in range(3):
        spark.createDataFrame([data[k] for k in order[n::3]], "series string, step long, loss double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("series string, step long, loss double").parquet(f"{tmp_path}/in")
        query = ordered_stop_signals(stream, "series", "step", "loss", patience=2).writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend((r.series, r.step, r.counter, r.stop) for r in b.collect()))
        query.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(out) == sorted((str(s), k, *x) for s, losses in enumerate(LOSSES) for k, x in enumerate(stepwise(losses, 2)))
