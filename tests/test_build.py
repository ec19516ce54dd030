"""Datasets from DataFrames and folders, metadata views, row axes, frequency pipelines, colour columns, support helpers."""

import json
import wave
from pathlib import Path
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom import errors as E
from sampleloom.build import build_splits
from sampleloom.functions import colour as C
from sampleloom.functions import kernels as K
from sampleloom.functions import support as U
from sampleloom.operators import selection as S
from sampleloom.operators.dataset import Dataset, DatasetMetadata, create_dataset, create_dataset_from_arrays
from sampleloom.plans import transforms as T
from sampleloom.sources.audio import write_wav
from sampleloom.sources.media import fit_image


def rows(spark, x):
    return spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)], "row_idx long, data array<double>")


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_dense_index_in_many_ranges(spark, kind):
    values = [None, None] + [(k * 7919) % 3001 for k in range(3001)] + [5] * 40
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, tie long").repartition(5).select(F.col("v").cast(kind), "tie")
    if kind == "double":
        df = df.unionByName(spark.createDataFrame([(float("nan"), 9999)], "v double, tie long"))
    got = S.dense_index(df, ["v", "tie"], ranges=10).collect()
    want = df.orderBy("v", "tie").collect()
    assert [(r.tie, r.row_idx) for r in sorted(got, key=lambda r: r.row_idx)] == [(r.tie, k) for k, r in enumerate(want)]
    assert S.dense_index(df.limit(0), ["v"]).count() == 0


def test_create_dataset(spark, tmp_path):
    df = spark.createDataFrame([(30 - k, [float(k), 1.0], float(k), f"s{k}", b"{}") for k in range(9)], "k long, data array<double>, label double, sample_id string, sample_meta binary")
    path = f"file://{tmp_path}/d"
    assert create_dataset(df, path, order=["k"], shape=(1, 2), header=DatasetMetadata("x")) == 9
    d = Dataset(spark, path, ignore_header=False)
    assert d.metadata.num_samples == 9 and d[0][0].tolist() == [[8.0, 1.0]] and d[0][1] == [8.0]
    with pytest.raises(Exception, match="exists"):
        create_dataset(df, path, order=["k"], shape=(1, 2))
    with pytest.raises(E.SampleMetaPairingError):
        create_dataset(df.drop("sample_meta"), path + "2", order=["k"], shape=(1, 2))
    assert create_dataset(df.limit(0), path + "3", order=["k"], shape=(1, 2)) == 0 and len(Dataset(spark, path + "3")) == 0


@dataclass
class Meta:
    value: int

    def resolve(self, sample_id, header):
        return f"{header.name}:{sample_id}:{self.value}"


@pytest.mark.parametrize("store", ["auto", "eager", "lazy"])
def test_meta_store(spark, tmp_path, store):
    path = f"file://{tmp_path}/m"
    create_dataset_from_arrays(spark, path, data=np.zeros((4, 1)), sample_ids=list("abca"), sample_meta=[1, 2, 3, 4], header=DatasetMetadata("H", None, 4))
    d = Dataset(spark, path, select_indices=[3, 1, 0], meta_decoder=lambda raw, sample_id: Meta(json.loads(raw)), meta_store=store, ignore_header=False)
    assert d.meta.get_all() == [("a", "H:a:4"), ("b", "H:b:2"), ("a", "H:a:1")] and len(d.meta) == 3 and d[1][2] == "H:b:2"
    assert d.meta.get_by_index(1) == "H:b:2" and d.meta.get_by_id("a") == "H:a:1" and d.meta.get_all_ids() == ["a", "b", "a"]
    with pytest.raises(KeyError):
        d.meta.get_by_id("c")
    with pytest.raises(IndexError):
        d.meta.get_by_index(3)
    last = Dataset(spark, path, select_sample_ids=["a", "c"], meta_decoder=lambda raw, sample_id: json.loads(raw), meta_store=store)
    assert last.sample_ids_with_meta() == [("a", 4), ("c", 3)]
    with pytest.raises(ValueError):
        Dataset(spark, path, meta_store="none")


def test_row_axes(spark, tmp_path):
    x, y = np.arange(24.0).reshape(2, 3, 4), np.arange(8.0).reshape(2, 4)
    path = f"file://{tmp_path}/a"
    create_dataset_from_arrays(spark, path, data=x, labels=y)
    d = Dataset(spark, path, data_row_dim=2, label_row_dim=1)
    assert len(d) == 4 and all(np.array_equal(d[k][0], x[:, :, k]) and np.array_equal(d[k][1], y[:, k]) for k in range(4))
    with pytest.raises(E.ShapeMismatchError):
        Dataset(spark, path, data_row_dim=1)


def test_frequency_pipeline(spark):
    x = np.random.default_rng(1).normal(0, 1, (3, 6, 5))
    for shift in (False, True):
        back, shape = T.Compose([T.FFT((0, 1), shift), T.InverseFFT((0, 1), shift)]).apply(rows(spark, x), (6, 5))
        got = np.array([r.data for r in back.orderBy("row_idx").collect()]).reshape(-1, *shape)
        assert shape == (6, 5) and np.allclose(got, x)
        low, high = (T.Compose([T.FFT((0, 1), shift), T.FrequencyMask((0, 1), 0.3, high=h, shift=shift), T.InverseFFT((0, 1), shift)]).kernel(x[0]) for h in (False, True))
        mask = K.pass_mask(K.radial_frequencies((6, 5), (0, 1), False), 0.3)
        assert np.allclose(low, np.fft.ifft2(np.fft.fft2(x[0]) * mask).real) and not np.allclose(low, high)
    assert T.Compose([T.ToFloat32()]).apply(rows(spark, x), (6, 5))[0].schema["data"].dataType.elementType.typeName() == "float"
    assert np.allclose(T.FFT((0,), log=True).kernel(x[0], None), T.FFTLogMagnitude((0,)).kernel(x[0], None))


@pytest.mark.parametrize("op", [T.FFT((0, 1), True), T.FFT((-1,), log=True), T.FFTLogMagnitude((1,), True), T.DCT((0,)), T.DCT((-1,), False), T.ToFloat32(), T.Flip(0), T.Normalize(1.0, 2.0), T.RotateAnyDegree((0, 1), 30.0)])
def test_stacked_samples_equal_single_ones(op):
    x = np.random.default_rng(3).normal(0, 1, (4, 6, 5))
    assert not op.draws and np.allclose(op.batch(x), [op.kernel(v, None) for v in x])


@pytest.mark.parametrize("op", [T.InverseFFT((0, 1), True), T.InverseFFT((-1,)), T.FrequencyMask((0, 1), 0.2, shift=True), T.FrequencyMask((1,), 0.2, high=True)])
def test_stacked_spectra_equal_single_ones(op):
    x = np.random.default_rng(3).normal(0, 1, (4, 6, 5, 2))
    assert not op.draws and np.allclose(op.batch(x), [op.kernel(v, None) for v in x])


def test_colour_columns_equal_the_kernels(spark):
    x = np.random.default_rng(2).random((4, 3, 2, 5)).astype(np.float32)
    df = rows(spark, x)
    for column, kernel in ((C.brightness, K.adjust_brightness), (C.contrast, K.adjust_contrast), (C.saturation, K.adjust_saturation)):
        got = [r.v for r in df.orderBy("row_idx").select(column(F.col("data"), 10, 1.3).alias("v")).collect()]
        assert np.allclose(got, [kernel(v, 1.3).ravel() for v in x], *U.tolerances("float32"))


def test_support(spark):
    assert U.tolerances(np.float16) == (1e-3, 1e-5) and U.tolerances("int32") == (0.0, 0.0)
    assert U.seed_everything(3).random() == np.random.default_rng(3).random()

    class Holder:
        transform = T.Compose([T.RandomCrop(0, 2)])

    h = Holder()
    with pytest.raises(KeyError), U.evaluation(h):
        assert h.transform[0].train is False
        raise KeyError
    assert h.transform is Holder.transform
    p = spark.createDataFrame([([3, 4], True), ([5], False), ([], True)], "shape array<int>, trainable boolean")
    assert U.parameter_count(p).first().n == 18 and U.parameter_count(p, trainable_only=True).first().n == 13 and U.parameter_count(p.limit(0)).first().n == 0
    assert U.plan_workers(1000, 4) == U.Workers(count=4, bytes_each=200) and U.plan_workers(1000, 4, most_bytes=300, most_workers=2) == U.Workers(count=2, bytes_each=150)


def test_random_crops_of_images_repeat(tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (40, 30, 3), dtype=np.uint8)
    crop = lambda s: fit_image(x, 8, randomized_crop=True, random=np.random.default_rng(s))
    assert np.array_equal(crop(1), crop(1)) and any(not np.array_equal(crop(1), crop(s)) for s in range(2, 9))


def test_build_splits(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for k in range(7):
        with wave.open(str(folder / ("deep" if k == 6 else ".") / f"{k}.{'WAV' if k % 2 else 'wav'}"), "wb") as f:
            f.setparams((1, 2, 22050, 0, "NONE", None))
            f.writeframes(np.arange(50 * k, 50 * k + 50, dtype="<i2").tobytes())
    (folder / "2.wav").write_bytes(b"broken")
    (folder / "other.txt").write_text("x")
    options = {"extensions": ["wav"], "target": [20], "sizes": [4, 2]}
    got = build_splits(spark, "audio", f"file://{folder}", f"file://{tmp_path}/out", **options)
    assert got == {"train": 3, "valid": 2}
    d = Dataset(spark, f"file://{tmp_path}/out/dataset_train", ignore_header=False)
    first = [int(d[k][0][0, 0]) // 50 for k in range(3)]
    assert first == [0, 1, 3] and d[0][0].shape == (1, 20) and d.metadata.split == "train"
    again = build_splits(spark, "audio", f"file://{folder}", f"file://{tmp_path}/again", random_order=True, subfolders=True, **options | {"sizes": [7]})
    assert again == {"train": 6}
    with pytest.raises(ValueError):
        build_splits(spark, "audio", f"file://{folder}", f"file://{tmp_path}/more", **options | {"sizes": [7]})


class Counted:
    """A resampler that counts what it decodes, and fails on one length as long as a file isn't there."""

    def __init__(self, seen, key):
        self.seen, self.key = seen, key

    def __call__(self, x, rate, to):
        if len(x) == 52 and not Path(self.key).exists():
            raise RuntimeError("the driver is lost here")
        self.seen.add(1)
        return x

    def __str__(self):
        return "counted"


def test_build_decodes_once_and_goes_on(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(8):
        (folder / f"{k}.wav").write_bytes(write_wav(np.arange(50 * k, 50 * k + 50 + k, dtype=np.int16)[:, None], 8000))
    seen, key = spark.sparkContext.accumulator(0), tmp_path / "key"
    options = {"extensions": ["wav"], "target": [20], "sizes": [2, 2, 2], "batch": 2, "resample": Counted(seen, str(key)), "random_slice": False}
    with pytest.raises(Exception, match="lost here"):
        build_splits(spark, "audio", f"file://{folder}", f"file://{tmp_path}/out", **options)
    assert not list(tmp_path.glob("out/dataset_*"))
    once = seen.value
    key.write_text("")
    assert build_splits(spark, "audio", f"file://{folder}", f"file://{tmp_path}/out", **options) == {"train": 2, "valid": 2, "test": 2}
    assert once in (4, 5) and seen.value - once == 2  # finished batches are not decoded again
    for n, name in enumerate(("train", "valid", "test")):
        d = Dataset(spark, f"file://{tmp_path}/out/dataset_{name}", ignore_header=False)
        assert [int(d[k][0][0, 0]) for k in (0, 1)] == [100 * n, 100 * n + 50] and len(d) == 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["dataset_test", "dataset_train", "dataset_valid"]
    with pytest.raises(FileExistsError):
        build_splits(spark, "audio", f"file://{folder}", f"file://{tmp_path}/out", **options)
    before = seen.value
    build_splits(spark, "audio", f"file://{folder}", f"file://{tmp_path}/again", **options)
    assert seen.value - before == 6  # each chosen file once, the two others never
