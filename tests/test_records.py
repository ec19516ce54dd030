"""Record files in several tasks, by position, and as a stream."""

import io
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sampleloom import errors as E
from sampleloom.sources import records as R

VALUES = ["", "δelta", "x" * 3000, *[f"record {k} " * (k % 40) for k in range(500)]]


@pytest.fixture
def source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "INDEX_BYTES", 2000)
    spark.dataSource.register(R.RecordSource)
    with R.BinaryStringFile(f"{tmp_path}/r.bin", "w") as f:
        f.write_many(VALUES)
    return f"{tmp_path}/r.bin"


def load(spark, path, **options):
    return spark.read.format("records").options(splitBytes=5000, **options).load(path)


def test_a_file_in_several_tasks(spark, source):
    assert load(spark, source).rdd.getNumPartitions() == 1  # no index yet
    assert R.index_records(source) == len(VALUES)
    df = load(spark, source)
    assert df.rdd.getNumPartitions() > 10
    assert [(r.pos, r.value) for r in df.orderBy("pos").collect()] == list(enumerate(VALUES))
    with R.BinaryStringFile(source, "a") as f:  # the index is not of this file any more
        f.write_one("more")
    assert load(spark, source).rdd.getNumPartitions() == 1 and load(spark, source).count() == len(VALUES) + 1


def test_filters_choose_files_and_stretches(spark, source, tmp_path):
    R.index_records(source)
    (tmp_path / "s.bin").write_bytes(Path(source).read_bytes())
    reader = R._FilteredReader(str(tmp_path), 5000)
    every = len(reader.partitions())
    kept = [R.EqualTo(("path",), source), R.GreaterThan(("pos",), 100), R.LessThanOrEqual(("pos",), 120)]
    assert list(reader.pushFilters(kept)) == kept and 1 <= len(reader.partitions()) <= 3 < every
    rows = [(p, v) for part in reader.partitions() for b in reader.read(part) for p, v in zip(b["pos"].to_pylist(), b["value"].to_pylist())]
    assert {p for p, _ in rows} >= set(range(101, 121)) and all(VALUES[p] == v for p, v in rows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = load(spark, str(tmp_path), pushFilters=True).where((F.col("path") == source) & (F.col("pos") == 77))
    assert [r.value for r in df.collect()] == [VALUES[77]] and df.rdd.getNumPartitions() == 1
    assert load(spark, str(tmp_path), pushFilters=True).where(F.col("path") == "none").count() == 0
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_frames_at_any_chunk_size(monkeypatch):
    raw = b"".join(map(R.frame, VALUES))
    for size in (1, 3, 7, 1000, 1 << 20):
        monkeypatch.setattr(R, "CHUNK_BYTES", size)
        values = VALUES if size > 3 else VALUES[:30]
        part = b"".join(map(R.frame, values))
        assert [x.decode() for x in R.frames(io.BytesIO(part), 0, len(part))] == values
    for cut in random.Random(1).sample(range(1, len(raw)), 20):
        ends, at = set(), 0
        for v in VALUES:
            at += len(R.frame(v))
            ends.add(at)
        if cut not in ends:
            with pytest.raises(E.CorruptedFileError):
                list(R.frames(io.BytesIO(raw[:cut]), 0, cut))


def test_a_damaged_file_has_no_index(tmp_path):
    (tmp_path / "d.bin").write_bytes(R.frame("abc") + b"\x09\x00\x00\x00abc")
    with pytest.raises(E.CorruptedFileError):
        R.index_records(f"{tmp_path}/d.bin")
    (tmp_path / "e.bin").write_bytes(b"")
    assert R.index_records(f"{tmp_path}/e.bin") == 0 and R._split(f"{tmp_path}/e.bin", f"{tmp_path}/e.bin", 0, 10) == []


def test_written_files_have_indexes(spark, tmp_path):
    spark.dataSource.register(R.RecordSource)
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id").cast("string"), F.repeat(F.lit("y"), 1000)).alias("value"))
    df.coalesce(1).write.format("records").mode("append").save(f"{tmp_path}/out")
    assert spark.read.format("records").option("splitBytes", 1 << 20).load(f"{tmp_path}/out").rdd.getNumPartitions() >= 2
    df.limit(5).write.format("records").mode("overwrite").save(f"{tmp_path}/out")
    files = [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")]
    assert spark.read.format("records").load(f"{tmp_path}/out").count() == 5 and len(files) == 2 * sum(not f.startswith(".") for f in files)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    spark.dataSource.register(R.RecordSource)
    (tmp_path / "in").mkdir()

    def put(name, values):
        with R.BinaryStringFile(f"{tmp_path}/{name}", "w") as f:
            f.write_many(values)
        Path(f"{tmp_path}/{name}").rename(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.format("records").load(f"{tmp_path}/in")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path[-1], r.pos, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put("a", ["1", "2"])
    assert run() == [("a", 0, "1"), ("a", 1, "2")]
    put("b", ["3"])
    put("0", ["4"])
    want = [("0", 0, "4"), ("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3")]
    assert run() == want and run() == want
