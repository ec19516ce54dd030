"""Sample datasets: one Parquet row a sample, a header beside them, selection and metadata views on top."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.geometry import slug_of
from ..functions.names import remove_path
from ..plans.transforms import Compose, element_dtype, stored
from . import selection as S



def schema_of(data: str = "double", label: str = "double") -> str:
    """The columns of a dataset whose samples and labels have these element types."""
    return f"row_idx long, sample_id string, data array<{data}>, shape array<int>, label array<{label}>, label_shape array<int>, sample_meta binary"


@dataclass(frozen=True)
class DatasetMetadata:
    """The header of a dataset."""

    name: str
    split: str | None = None
    num_samples: int = 0
    version: int = 1
    description: str | None = None
    origin_path: str | None = None
    extra_data: dict | None = None
    created_at: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.UTC))
    git_hash: str | None = None
    comment: str | None = None

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self) | {"created_at": self.created_at.isoformat()}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> DatasetMetadata:
        state = json.loads(text)
        return cls(**state | {"created_at": dt.datetime.fromisoformat(state["created_at"])})

    def filename(self) -> str:
        return slug_of(self.name, self.split)


def user_block_size(raw: bytes) -> int:
    """The header's padded size in formats that embed it: a power of two, 512 at least."""
    return max(512, 1 << max(0, len(raw) - 1).bit_length())


def encode_json(meta) -> bytes:
    return json.dumps(meta).encode()


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_header(spark: SparkSession, path: str, header: DatasetMetadata | bytes) -> None:
    put_bytes(spark, path, "_header.json", header if isinstance(header, bytes) else header.to_json().encode())


def put_bytes(spark: SparkSession, path: str, name: str, raw: bytes) -> None:
    at, fs = _fs(spark, f"{path}/{name}")
    out = fs.create(at, True)
    out.write(bytearray(raw))
    out.close()


def _write_rows(out: DataFrame, path: str, mode: str = "errorifexists", compression: str = "zstd") -> dict:
    """Writes a dataset's rows and its manifest, which it gives: counts of rows and parts, and the range of row_idx of each file.

    The counts are observed while the rows are written; for the ranges only row_idx is read again. Ids get Bloom filters.
    """
    spark, seen = out.sparkSession, Observation()
    counted = out.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in ("data", "label", "sample_id", "sample_meta")])
    counted.write.mode(mode).option("compression", compression).option("parquet.bloom.filter.enabled#sample_id", "true").parquet(path)
    files = spark.read.parquet(path).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))
    manifest = dict(seen.get) | {"files": _files(spark, path), "ranges": [[r.file, r.first, r.last] for r in files.orderBy("first").toLocalIterator()]}
    put_bytes(spark, path, "_manifest.json", json.dumps(manifest).encode())
    return manifest


def _files(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return sorted(name for f in fs.listStatus(at) if not (name := f.getPath().getName()).startswith(("_", ".")))


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """A dataset's manifest, or None where there is none for just the files that are there."""
    raw = get_bytes(spark, path, "_manifest.json")
    found = json.loads(raw) if raw else None
    return found if found and found["files"] == _files(spark, path) else None


def files_of(manifest: dict, indices: Sequence[int]) -> list[str]:
    """The files whose range of row_idx holds any of the positions."""
    at = sorted(indices)
    return [name for name, first, last in manifest["ranges"] if bisect_left(at, first) < bisect_right(at, last)]


def _write_types(spark: SparkSession, path: str, data, label=None) -> None:
    """The numpy types of samples and labels, which Spark's element types don't tell all of (unsigned, half)."""
    put_bytes(spark, path, "_types.json", json.dumps({"data": np.dtype(data).name, "label": None if label is None else np.dtype(label).name}).encode())


def read_types(spark: SparkSession, path: str) -> dict[str, str | None]:
    raw = get_bytes(spark, path, "_types.json")
    return json.loads(raw) if raw else {"data": None, "label": None}


def get_bytes(spark: SparkSession, path: str, name: str) -> bytes | None:
    at, fs = _fs(spark, f"{path}/{name}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_header(spark: SparkSession, path: str) -> bytes | None:
    return get_bytes(spark, path, "_header.json")


def _lists(x: np.ndarray) -> pa.Array:
    """Row k of an array as list k, without a Python object for each element."""
    flat = x.reshape(len(x), -1).astype(_storage(x.dtype)) if len(x) else x.reshape(0, 1)
    at = np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.ravel()))


def _storage(dtype) -> np.dtype:
    return np.dtype({"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}[stored(dtype)])


def _check_lengths(n: int | None, **parts) -> None:
    ids, meta = parts.get("sample_ids"), parts.get("sample_meta")
    if (ids is None) != (meta is None):
        raise E.SampleMetaPairingError("sample ids and metadata go together")
    for name, part in parts.items():
        if part is not None and n is not None and len(part) != n:
            raise E.SampleSequenceLengthMismatchError(name, n, len(part))


def create_dataset_from_arrays(spark: SparkSession, path: str, *, data, labels=None, sample_ids: Sequence[str] | None = None, sample_meta: Sequence | None = None, encoder: Callable = encode_json, header: DatasetMetadata | bytes | None = None, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Writes aligned arrays in their order; fails if the path exists. Samples and labels keep their types.

    The driver holds the arrays anyway; they go to Spark a slice of rows at a time, as Arrow columns.
    """
    data = np.asarray(data)
    _check_lengths(len(data), labels=labels, sample_ids=sample_ids, sample_meta=sample_meta)
    labels = None if labels is None else np.asarray(labels)
    n = len(data)
    repeat = lambda shape: pa.array([list(map(int, shape))] * n, pa.list_(pa.int32()))
    nothing = lambda kind: pa.nulls(n, kind)
    label_kind = stored("float64" if labels is None else labels.dtype)
    table = pa.table({
        "row_idx": pa.array(np.arange(n), pa.int64()),
        "sample_id": nothing(pa.string()) if sample_ids is None else pa.array(list(sample_ids), pa.string()),
        "data": _lists(data), "shape": repeat(data.shape[1:]),
        "label": nothing(pa.list_(pa.float64())) if labels is None else _lists(labels),
        "label_shape": nothing(pa.list_(pa.int32())) if labels is None else repeat(labels.shape[1:]),
        "sample_meta": nothing(pa.binary()) if sample_meta is None else pa.array([encoder(m) for m in sample_meta], pa.binary()),
    })
    _write_rows(spark.createDataFrame(table, schema=schema_of(stored(data.dtype), label_kind)), path, mode, compression)
    _write_types(spark, path, data.dtype, None if labels is None else labels.dtype)
    if header is not None:
        _write_header(spark, path, header)


def create_dataset(samples: DataFrame, path: str, *, order: Sequence[str], shape: Sequence[int], header: DatasetMetadata | None = None, compression: str = "zstd", dtype: str | None = None) -> int:
    """Writes a DataFrame (data, and where it has them label, sample_id, sample_meta) in its order; gives the row count.

    Samples and labels keep their element types; dtype names the samples' numpy type where that says less (uint8 in small integers).
    Rows get dense positions in ranges of the order columns (see dense_index); nothing passes through the driver but counts.
    """
    have = set(samples.columns)
    if ("sample_id" in have) != ("sample_meta" in have):
        raise E.SampleMetaPairingError("sample ids and metadata go together")
    dtype = dtype or element_dtype(samples, "data")
    label_dtype = None
    if "label" in have:
        kind = samples.schema["label"].dataType
        label_dtype = element_dtype(samples, "label") if kind.typeName() == "array" else element_dtype(samples.select(F.array("label").alias("label")), "label")
    kinds = dict(part.split(" ", 1) for part in schema_of(stored(dtype), stored(label_dtype or "float64")).split(", "))
    rows = S.dense_index(samples, order)
    own = {"row_idx": F.col("row_idx"), "shape": F.array(*[F.lit(int(v)) for v in shape])}
    if "label" in have and "label_shape" not in have:
        flat = samples.schema["label"].dataType.typeName() != "array"
        own |= {"label": F.when(F.col("label").isNotNull(), F.array("label")) if flat else F.col("label")}
        own |= {"label_shape": F.array().cast("array<int>") if flat else F.array(F.size("label"))}
    out = rows.select(*[own.get(c, F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
    n = _write_rows(out, path, "errorifexists", compression)["rows"]
    _write_types(samples.sparkSession, path, dtype, label_dtype)
    if header is not None:
        _write_header(samples.sparkSession, path, dataclasses.replace(header, num_samples=n))
    return n


def create_dataset_from_paths(spark: SparkSession, path: str, *, sample_paths: Sequence[str], loader: Callable[[str], np.ndarray], sample_shape: Sequence[int], sample_dtype="float64", labels: Sequence | None = None, sample_ids: Sequence[str] | None = None, sample_meta: Sequence | None = None, encoder: Callable = encode_json, header: DatasetMetadata | None = None, partitions: int | None = None) -> list[E.BatchProcessItemError]:
    """Loads every path in the tasks and writes those that load, in input order; the others come back as errors.

    The tensors are loaded once, under a temporary name, with their path's position; only positions and errors are
    ranked afterwards, never the tensors.
    """
    _check_lengths(len(sample_paths), labels=labels, sample_ids=sample_ids, sample_meta=sample_meta)
    shape, element = list(map(int, sample_shape)), stored(sample_dtype)
    arrays = None if labels is None else [np.asarray(x) for x in labels]
    label_dtype = np.result_type(*arrays) if arrays else np.dtype("float64")
    rows = [
        (k, str(p), None if sample_ids is None else sample_ids[k], None if arrays is None else arrays[k].astype(_storage(label_dtype)).ravel().tolist(), None if arrays is None else list(arrays[k].shape), None if sample_meta is None else bytearray(encoder(sample_meta[k])))
        for k, p in enumerate(sample_paths)
    ]
    fields = f"path_idx long, path string, sample_id string, label array<{stored(label_dtype)}>, label_shape array<int>, sample_meta binary"
    items = spark.createDataFrame(rows, fields)
    items = items.repartition(partitions or max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4)))
    plain = _storage(sample_dtype)

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row, data, error = batch.slice(k, 1), None, None
                try:
                    x = np.asarray(loader(row.column(1)[0].as_py()))
                    if list(x.shape) != shape:
                        raise ValueError(f"shape {x.shape}, expected {tuple(shape)}")
                    data = x.astype(sample_dtype).astype(plain).ravel()
                except Exception as e:  # noqa: BLE001  any failure of one item is that item's
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.list_(pa.from_numpy_dtype(plain))), pa.array([error], pa.string())], names=[*batch.schema.names, "data", "error"])

    temporary = f"{path.rstrip('/')}_loading-{uuid.uuid4().hex}"
    items.mapInArrow(load, f"{fields}, data array<{element}>, error string").write.parquet(temporary)
    loaded = spark.read.parquet(temporary)
    failed = loaded.where("error is not null").select("path_idx", "path", "error").orderBy("path_idx").collect()
    good = loaded.where("error is null")
    # positions of what loaded are ranked alone, tensors join them afterwards
    place = S.dense_index(good.select("path_idx"), ["path_idx"]) if failed else good.select("path_idx", F.col("path_idx").alias("row_idx"))
    out = good.join(place, "path_idx").select("row_idx", "sample_id", "data", F.array(*[F.lit(s) for s in shape]).cast("array<int>").alias("shape"), "label", "label_shape", "sample_meta")
    _write_rows(out, path)
    _write_types(spark, path, sample_dtype, None if arrays is None else label_dtype)
    remove_path(spark, temporary)
    if header is not None:
        _write_header(spark, path, dataclasses.replace(header, num_samples=len(rows) - len(failed)))
    return [E.BatchProcessItemError(r.path, r.error) for r in failed]


def decoded(view: DataFrame, schema: str, header: DatasetMetadata | None = None) -> DataFrame:
    """Rows (view_idx, sample_id, meta) of a view's JSON metadata, resolved against id and header (see MetaStore.decoded)."""
    known = {"sample_id": F.col("sample_id")} | ({} if header is None else {"name": F.lit(header.name), "split": F.lit(header.split)})
    meta = F.from_json(F.col("sample_meta").cast("string"), schema)
    rows = view.select("view_idx", "sample_id", meta.alias("meta"))
    fields = rows.schema["meta"].dataType.fields
    full = [(F.coalesce(F.col(f"meta.`{f.name}`"), known[f.name].cast(f.dataType)) if f.name in known else F.col(f"meta.`{f.name}`")).alias(f.name) for f in fields]
    return rows.withColumn("meta", F.when(F.col("meta").isNotNull(), F.struct(*full)))


class MetaStore:
    """Ids and decoded metadata of a view (view_idx, sample_id, sample_meta), by position, id or all; lists are copies.

    decoder takes (bytes, id); what it gives is resolved against id and header if it offers that. An eager store keeps
    its rows in the executors' memory, a lazy one reads them when asked. Of rows that repeat an id the last counts.
    """

    def __init__(self, view: DataFrame, decoder: Callable[[bytes, str], object], *, header: DatasetMetadata | None = None, eager: bool = False) -> None:
        view = view.select("view_idx", "sample_id", "sample_meta")
        self.view, self.decoder, self.header = view.persist() if eager else view, decoder, header

    def decode(self, row):
        if row.sample_meta is None:
            return None
        meta = self.decoder(bytes(row.sample_meta), row.sample_id)
        return meta.resolve(row.sample_id, self.header) if hasattr(meta, "resolve") else meta

    def decoded(self, schema: str) -> DataFrame:
        """Rows (view_idx, sample_id, meta) of JSON metadata, decoded in the executors; meta is a struct of the schema.

        Where the schema names sample_id, name or split that the JSON lacks, the id and the header resolve them.
        """
        return decoded(self.view, schema, self.header)

    def values(self, **paths: tuple[str, str]) -> DataFrame:
        """Rows (view_idx, sample_id, and a column for each name) of JSON metadata of any form: name=(path, type), as ("$.size[0]", "int").

        Each row's JSON becomes a VARIANT once, without a schema, and stays in Catalyst; what a row lacks or doesn't convert is null.
        """
        meta = self.view.select("view_idx", "sample_id", F.try_parse_json(F.col("sample_meta").cast("string")).alias("meta"))
        return meta.select("view_idx", "sample_id", *[F.try_variant_get("meta", path, kind).alias(name) for name, (path, kind) in paths.items()])

    def decoded_by(self, kind: str) -> DataFrame:
        """Rows (view_idx, sample_id, meta) that the store's own decoder gives in the executors, as values of a Spark type."""
        decode, header = self.decoder, self.header

        @F.pandas_udf(kind)
        def run(raw, ids):
            import pandas as pd

            out = []
            for x, i in zip(raw, ids, strict=True):
                meta = None if x is None else decode(bytes(x), i)
                out.append(meta.resolve(i, header) if hasattr(meta, "resolve") else meta)
            return pd.Series(out)

        return self.view.select("view_idx", "sample_id", run("sample_meta", "sample_id").alias("meta"))

    def __len__(self) -> int:
        return self.view.count()

    def get_by_index(self, k: int):
        row = self.view.where(F.col("view_idx") == k).first()
        if row is None:
            raise IndexError(k)
        return self.decode(row)

    def get_by_id(self, sample_id: str):
        row = self.view.where(F.col("sample_id") == sample_id).orderBy(F.desc("view_idx")).first()
        if row is None:
            raise KeyError(sample_id)
        return self.decode(row)

    def get_all_ids(self) -> list[str]:
        return [r.sample_id for r in self.view.select("view_idx", "sample_id").orderBy("view_idx").toLocalIterator()]

    def get_all(self) -> list[tuple]:
        return [(r.sample_id, self.decode(r)) for r in self.view.orderBy("view_idx").toLocalIterator()]


class Dataset:
    """A view of a written dataset: selection, transforms, labels and metadata; checks run when it is made.

    mode="memory" persists the selected rows, mode="disk" leaves them lazy; meta_store="auto" does likewise for metadata.
    """

    def __init__(self, spark: SparkSession, path: str, *, mode: str = "disk", select_indices: Sequence[int] | None = None, select_sample_ids: Sequence[str] | None = None, static_label=None, transform: Compose | None = None, label_transform: Compose | None = None, meta_decoder: Callable[[bytes, str], object] | None = None, meta_store: str = "auto", data_row_dim: int | None = None, label_row_dim: int | None = None, ignore_header: bool = True, columns: Sequence[str] = ("data",)) -> None:
        if select_indices is not None and select_sample_ids is not None:
            raise E.ConflictingSelectorsError("select by indices or by ids, not both")
        if mode not in ("disk", "memory"):
            raise ValueError("the mode is disk or memory")
        if meta_store not in ("auto", "eager", "lazy"):
            raise ValueError("the metadata store is auto, eager or lazy")
        self.spark, self.static_label, self.decoder = spark, static_label, meta_decoder
        df = spark.read.parquet(path)
        for c in columns:
            if c not in df.columns:
                raise E.MissingKeyError(c)
        counts = read_manifest(spark, path)
        listed = counts is not None  # where nothing is listed, only what a check needs is counted
        known = lambda *names: [counts[n] for n in names] if listed else list(df.agg(*[F.count(F.lit(1) if n == "rows" else F.col(n)) for n in names]).first())
        self.metadata = None
        if not ignore_header and (raw := read_header(spark, path)):
            self.metadata = DatasetMetadata.from_json(raw.decode())
            if self.metadata.num_samples != (n := known("rows")[0]):
                raise E.NumSamplesMismatchError(self.metadata.num_samples, n)
        labels = None
        if static_label is None and "label" in df.columns:
            samples, labels = known("data", "label")
            if labels not in (0, samples):
                raise E.ShapeMismatchError(f"{samples} samples, {labels} labels")
        if meta_decoder is not None:
            ids, metas = known("sample_id", "sample_meta")
            if ids != metas:
                raise E.SampleMetaLengthMismatchError(ids, metas)
        along = data_row_dim is not None or label_row_dim is not None
        if along:
            df = self._along(df, known("rows")[0], bool(known("label")[0] if labels is None else labels), data_row_dim, label_row_dim)
        self.shape = tuple((df.select("shape").first() or [()])[0])
        if select_indices is not None:
            size = df.count() if along else known("rows")[0]
            if listed and not along:
                files = files_of(counts, [i + size if i < 0 else i for i in select_indices])
                df = spark.read.schema(df.schema).parquet(*[f"{path}/{f}" for f in files]) if 0 < len(files) < len(counts["ranges"]) else df
            df = S.select_indices(df, select_indices, size=size)
        elif select_sample_ids is not None:
            df = S.select_sample_ids(df, select_sample_ids)
        else:
            df = df.withColumn("view_idx", F.col("row_idx"))
        if static_label is not None:
            df = df.withColumn("label", F.array(*[F.lit(float(v)) for v in np.ravel(static_label)]))
        types = read_types(spark, path)
        self.dtype, label_dtype = types["data"] or element_dtype(df, "data"), types["label"] or "float64"
        if transform is not None and self.shape:
            df, self.shape = transform.apply(df, self.shape, dtype=self.dtype)
            self.dtype = transform.result(self.dtype)
        if label_transform is not None and (row := df.select("label_shape").where("label_shape is not null").first()):
            df, _ = label_transform.apply(df, tuple(row[0]), column="label", dtype=label_dtype)
        self.df = df.persist() if mode == "memory" else df
        if mode == "memory":
            self.df.count()
        self.meta = None
        if meta_decoder is not None:
            eager = meta_store == "eager" or (meta_store == "auto" and mode == "memory")
            self.meta = MetaStore(self.df, meta_decoder, header=self.metadata, eager=eager and mode != "memory")

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, k: int) -> tuple:
        row = self.df.where(F.col("view_idx") == k).first()
        if row is None:
            raise IndexError(k)
        return np.array(row.data, self.dtype).reshape(self.shape), None if row.label is None else np.array(row.label), None if self.meta is None else self.meta.decode(row)

    @staticmethod
    def _along(df: DataFrame, n: int, labelled: bool, data_dim: int | None, label_dim: int | None) -> DataFrame:
        """Samples along another axis of the stacked tensor of n samples: 0 is the stored one, 1 the first axis of a stored row."""
        parts, sizes = [], []
        for column, shape, dim in (("data", "shape", data_dim), ("label", "label_shape", label_dim)):
            size = list((df.select(shape).where(F.col(shape).isNotNull()).first() or [()])[0]) if column == "data" or labelled else []
            sizes.append(size[dim - 1] if dim and size else n)
            if not dim or not size:
                parts.append(df.select("row_idx", column, F.col(shape)))
                continue
            left = [n, *size[: dim - 1], *size[dim:]]
            taken = S.take_along(df, size, dim - 1, column=column, size=n)
            parts.append(taken.select(F.col("row").alias("row_idx"), F.col("data").alias(column), F.array(*map(F.lit, left)).cast("array<int>").alias(shape)))
        if labelled and sizes[0] != sizes[1]:
            raise E.ShapeMismatchError(f"{sizes[0]} samples, {sizes[1]} labels")
        data, label = parts
        return data.join(label, "row_idx", "left").join(df.select("row_idx", "sample_id", "sample_meta"), "row_idx", "left")

    def _store(self) -> MetaStore:
        if self.meta is None:
            raise E.SampleMetaStoreUnavailableError("a decoder is needed for ids and metadata")
        return self.meta

    def sample_ids(self) -> list[str]:
        return self._store().get_all_ids()

    def sample_ids_with_meta(self) -> list[tuple]:
        return self._store().get_all()

    def meta_by_id(self, sample_id: str):
        return self._store().get_by_id(sample_id)

    def batches(self, size: int) -> DataFrame:
        return S.collate(self.df, size, ["data", "label", "sample_meta"])
