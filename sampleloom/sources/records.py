"""Record files: strings with a 4-byte little-endian length before each; a file object and a Spark data source."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..errors import CorruptedFileError


class BinaryStringFile:
    """Reads ("r"), writes ("w") or appends ("a") framed strings. The end between frames is None, inside one an error."""

    def __init__(self, path: str, mode: str = "r") -> None:
        if mode not in ("r", "w", "a"):
            raise ValueError(f"no mode {mode!r}")
        self.mode, self.file = mode, open(path, mode + "b")

    def __enter__(self) -> BinaryStringFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __iter__(self) -> Iterator[str]:
        while (s := self.read_one()) is not None:
            yield s

    def read_one(self) -> str | None:
        if self.mode != "r":
            raise OSError("the file isn't open for reading")
        return read_frame(self.file)

    def read_all(self) -> list[str]:
        return list(self)

    def write_one(self, value: str) -> None:
        if self.mode == "r":
            raise OSError("the file isn't open for writing")
        self.file.write(frame(value))

    def write_many(self, values) -> None:
        for v in values:
            self.write_one(v)

    def flush(self) -> None:
        self.file.flush()

    def close(self) -> None:
        self.file.close()


def frame(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


def read_frame(file) -> str | None:
    head = file.read(4)
    if not head:
        return None
    if len(head) < 4:
        raise CorruptedFileError("the file ends inside a length")
    (n,) = struct.unpack("<I", head)
    raw = file.read(n)
    if len(raw) < n:
        raise CorruptedFileError(f"a record of {n} bytes has {len(raw)}")
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        raise CorruptedFileError("a record isn't UTF-8") from e


#: Bytes between the entries of an index, about; bytes of a partition, by default; bytes and rows that a reader holds, about.
INDEX_BYTES, SPLIT_BYTES, CHUNK_BYTES, BATCH_ROWS = 1 << 20, 64 << 20, 4 << 20, 10_000
_ENTRY = struct.Struct("<QQ")


def _opened(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _index_name(at: str) -> str:
    """An index lies beside its file under a name that listings leave out."""
    head, _, name = at.rpartition("/")
    return f"{head}/.{name}.idx"


class _IndexWriter:
    """Places where frames begin: an entry (offset, record) about every INDEX_BYTES, and at last the file's size and records."""

    def __init__(self) -> None:
        self.entries, self.at, self.records = [(0, 0)], 0, 0

    def add(self, size: int) -> None:
        self.at, self.records = self.at + size, self.records + 1
        if self.at - self.entries[-1][0] >= INDEX_BYTES:
            self.entries.append((self.at, self.records))

    def packed(self) -> bytes:
        last = (self.at, self.records)
        return b"".join(_ENTRY.pack(*e) for e in [*self.entries, *([last] if self.entries[-1] != last else [])])


def index_records(path: str) -> int:
    """Writes the index of a record file, reading the lengths and no records; gives the number of records."""
    fs, at = _opened(path)
    found, size = _IndexWriter(), fs.get_file_info(at).size
    with fs.open_input_file(at) as file:
        while found.at < size:
            file.seek(found.at)
            head = file.read(4)
            if len(head) < 4 or found.at + 4 + (n := struct.unpack("<I", head)[0]) > size:
                raise CorruptedFileError("the file ends inside a record")
            found.add(4 + n)
    with fs.open_output_stream(_index_name(at)) as out:
        out.write(found.packed())
    return found.records


def read_index(fs, at: str, size: int) -> list[tuple[int, int]] | None:
    """The entries of a file's index, or None where there is none for the file as it is."""
    name = _index_name(at)
    if fs.get_file_info(name).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(name) as file:
        found = list(_ENTRY.iter_unpack(file.read()))
    return found if found and found[-1][0] == size else None


def frames(file, start: int, end: int) -> Iterator[bytes]:
    """The records of whole frames between two places of a file that can seek."""
    file.seek(start)
    held, at = b"", start
    while at < end or held:
        if len(held) >= 4 and len(held) >= 4 + (n := struct.unpack_from("<I", held)[0]):
            k = 0
            while len(held) - k >= 4 and len(held) - k - 4 >= (n := struct.unpack_from("<I", held, k)[0]):
                yield held[k + 4 : k + 4 + n]
                k += 4 + n
            held = held[k:]
            continue
        need = 4 if len(held) < 4 else 4 + struct.unpack_from("<I", held)[0] - len(held)
        more = file.read(min(max(CHUNK_BYTES, need), end - at))
        if not more:
            raise CorruptedFileError("the file ends inside a record")
        held, at = held + more, at + len(more)


class _Part(InputPartition):
    """A stretch of a file between two frames, and the number of its first record."""

    def __init__(self, path: str, start: int, end: int, pos: int) -> None:
        self.path, self.start, self.end, self.pos = path, start, end, pos


def _listed(path: str) -> list[tuple[str, str, int]]:
    """(path, place in its file system, bytes) of a file, or of the files of a folder, in order of their names."""
    fs, at = _opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, at, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at))
    return [(f"{path.rstrip('/')}/{f.base_name}", f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]


def _split(path: str, at: str, size: int, split: int, low: int = 0, high: int | None = None) -> list[_Part]:
    """A file's parts of about `split` bytes that can hold records low to high; without an index it is one part."""
    fs, _ = _opened(path)
    entries = (read_index(fs, at, size) if size else None) or [(0, 0), (size, 1 << 62)]
    parts, first = [], entries[0]
    for k, e in enumerate(entries[1:], 1):
        if e[0] - first[0] >= split or k == len(entries) - 1:
            if e[1] > low and (high is None or first[1] <= high) and e[0] > first[0]:
                parts.append(_Part(path, first[0], e[0], first[1]))
            first = e
    return parts


def _batches(part: _Part) -> Iterator[pa.RecordBatch]:
    fs, at = _opened(part.path)
    pos, held, size = part.pos, [], 0

    def emit() -> pa.RecordBatch:
        try:
            values = pa.array([x.decode() for x in held], pa.string())
        except UnicodeDecodeError as e:
            raise CorruptedFileError("a record isn't UTF-8") from e
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array(range(pos, pos + n), pa.int64()), values], names=["path", "pos", "value"])

    with fs.open_input_file(at) as file:
        for raw in frames(file, part.start, part.end):
            held.append(raw)
            size += len(raw)
            if len(held) == BATCH_ROWS or size >= CHUNK_BYTES:
                yield emit()
                pos, held, size = pos + len(held), [], 0
        if held:
            yield emit()


class _Reader(DataSourceReader):
    """Large files are read by several tasks where they have an index."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split, self.paths, self.low, self.high = path, split, None, 0, None

    def partitions(self):
        files = [f for f in _listed(self.path) if self.paths is None or f[0] in self.paths]
        return [p for path, at, size in files for p in _split(path, at, size, self.split, self.low, self.high)] or [_Part("", 0, 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from _batches(partition)


class _FilteredReader(_Reader):
    """Filters on path and pos choose files and stretches; Spark applies them to the rows too."""

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif column == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
            yield f


class _StreamReader(DataSourceStreamReader):
    """Files as they appear; a file is complete when it has its name. An offset is the names and sizes of all files read so far."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        return {path: size for path, _, size in _listed(self.path)}

    def partitions(self, start, end):
        parts = []
        for path, size in sorted(end.items()):
            if path in start and start[path] != size:
                raise CorruptedFileError(f"{path} changed after it was read")
            if path not in start:
                parts += _split(path, _opened(path)[1], size, self.split)
        return parts

    def read(self, partition):
        yield from _batches(partition)

    def commit(self, end):
        pass


class _Message(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class _Writer(DataSourceWriter):
    """Each task writes a file with a fresh name, and its index; an aborted job removes those that had ended."""

    def __init__(self, path: str, column: int, overwrite: bool) -> None:
        self.path, self.column, self.overwrite = path.rstrip("/"), column, overwrite

    def write(self, iterator):
        import uuid

        fs, at = _opened(self.path)
        fs.create_dir(at, recursive=True)
        name, index = f"part-{uuid.uuid4().hex}.bin", _IndexWriter()
        with fs.open_output_stream(f"{at}/.{name}") as out:
            for row in iterator:
                raw = frame(row[self.column])
                out.write(raw)
                index.add(len(raw))
        with fs.open_output_stream(_index_name(f"{at}/{name}")) as out:
            out.write(index.packed())
        return _Message(f"{at}/{name}")

    def commit(self, messages):
        fs, at = _opened(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                if f.type == pafs.FileType.File and not f.base_name.startswith("."):
                    fs.delete_file(f.path)
                    if fs.get_file_info(_index_name(f.path)).type == pafs.FileType.File:
                        fs.delete_file(_index_name(f.path))
        for m in messages:
            if m:
                head, _, name = m.path.rpartition("/")
                fs.move(f"{head}/.{name}", m.path)

    def abort(self, messages):
        fs, _ = _opened(self.path)
        for m in messages:
            if m:
                head, _, name = m.path.rpartition("/")
                fs.delete_file(f"{head}/.{name}")
                fs.delete_file(_index_name(m.path))


class RecordSource(DataSource):
    """spark.read or readStream.format("records").load(path): rows (path, pos, value); writing takes a column `value`.

    Option splitBytes: bytes of a task's stretch of an indexed file. With option pushFilters, filters on path and pos choose what is
    read; the session must set spark.sql.python.filterPushdown.enabled for it.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "path string, pos long, value string"

    def reader(self, schema):
        kind = _FilteredReader if self.options.get("pushFilters", "false").lower() == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def streamReader(self, schema):  # noqa: N802
        return _StreamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema.names.index("value"), overwrite)
