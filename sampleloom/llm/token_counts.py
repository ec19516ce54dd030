"""Token counts: rollups by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

import base64
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, spread

#: Fixed value: the pre-token pattern of the byte-level BPE vocabularies.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "tokenizer")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@cache
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=BPE_PATTERN, mergeable_ranks=table, special_tokens={})


def count_words(text: str) -> int:
    return len(_WORD.findall(text))


def vocabulary(name: str, folder: str) -> bytes:
    """A vocabulary file's bytes, read by the driver."""
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


def token_rows(docs: DataFrame, vocabularies: dict[str, bytes]) -> DataFrame:
    """Rows (doc_id, source, lang, tokenizer, tokens): a row for each document and tokenizer version.

    vocabularies has a tiktoken vocabulary file's bytes for each version; the version `words` counts white-space words
    and is always there. A null or empty text has 0 tokens; long texts are counted whole. Rows that repeat a document
    count each; null sources and languages are keys of their own. Other columns are ignored, whatever their names. An
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)  # a few vocabulary files

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {"words": count_words} | {v: (lambda t, e=_encoding(raw): len(e.encode_ordinary(t))) for v, raw in shared.value.items()}
        for batch in batches:
            texts = batch.column(3)
            for version, counter in counters.items():
                tokens = pa.array([counter(t.as_py() or "") for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * len(batch)), tokens], names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return spread(rows).mapInArrow(count, "doc_id long, source string, lang string, tokenizer string, tokens long")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(1))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """A revised document leaves with its old count and enters with its new one, under whatever keys each has."""
    return deletes(before).unionByName(inserts(after))


def signed_totals(changes: DataFrame) -> DataFrame:
    """Additive totals (source, lang, tokenizer, docs, tokens) of signed rows. Nulls are keys of their own."""
    return changes.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))


@dataclass
class _State:
    """The log as read once: its last version, the ids that each live table holds, and all ids ever committed."""

    version: int = -1
    tables: dict[str, list[str]] = field(default_factory=dict)

    @property
    def ids(self) -> set[str]:
        return {b for ids in self.tables.values() for b in ids}


class TokenRollup:
    """Totals in a folder: Parquet tables of signed totals, and a log of which of them count. The sum of all is the rollup.

    Every change is one log entry, `_log/<version>.json`, which only one writer can make: an entry is written under a
    name of its own and then linked (local folders) or renamed without overwriting (HDFS and others whose rename is
    atomic; plain object stores aren't and need a layer that is). Who comes second reads the new entries and tries
    again, or finds that its batch is there. An entry adds tables, or, after compact(), gives the whole list anew.
    Readers take the log as it is at one moment. So a commit that is repeated, after a crash or by another driver,
    changes nothing; a half-written table is never read; and batches that come while compact() runs stay apart from it.
    Batches may come in any order. Tables of a crashed writer have no entry and only take space.
    """

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"_log/{version:020d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _state(self) -> _State:
        """The log's last whole list and what was added after it."""
        if not self._fs.exists(self._at("_log")):
            return _State()
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("_log"))]
        versions = sorted((int(n[:-5]) for n in names if re.fullmatch(r"[0-9]{20}\.json", n)), reverse=True)
        entries = []
        for v in versions:
            entries.append(self._entry(v))
            if "all" in entries[-1]:
                break
        state = _State(versions[0] if versions else -1)
        for e in reversed(entries):
            state.tables |= e.get("all") or e["add"]
        return state

    def _publish(self, version: int, entry: dict) -> bool:
        """Makes a version's entry; False if another writer has."""
        temporary, target = self._at(f"_log/.tmp-{uuid.uuid4().hex}"), self._at(f"_log/{version:020d}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._local:
                os.link(temporary.toUri().getPath(), target.toUri().getPath())
            else:
                rename = self._hadoop.Options.Rename
                kind = self.spark.sparkContext._gateway.new_array(rename, 1)
                kind[0] = rename.NONE
                self._hadoop.FileContext.getFileContext(temporary.toUri(), self._conf).rename(temporary, target, kind)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(temporary, False)

    def _read(self, tables: Iterable[str]) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{t}" for t in tables])
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def batches(self) -> list[str]:
        """Ids of the committed batches, those in compacted tables too."""
        return sorted(self._state().ids)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed rows once; False if it was there."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"batch ids are letters, digits, '_', '.' and '-': {batch!r}")
        if batch in self._state().ids:
            return False
        table = f"batch-{uuid.uuid4().hex}"
        signed_totals(changes).write.parquet(f"{self.path}/{table}")
        while batch not in (state := self._state()).ids:
            if self._publish(state.version + 1, {"add": {table: [batch]}}):
                return True
        self._fs.delete(self._at(table), True)
        return False

    def totals(self) -> DataFrame:
        """The rollup: rows of SCHEMA, without keys whose documents and tokens have all gone."""
        tables = self._state().tables
        return self._read(tables) if tables else self.spark.createDataFrame([], self.SCHEMA)

    def compact(self) -> bool:
        """Folds the tables that count now into one; batches that come meanwhile stay. False if another driver folded them first.

        The old tables are removed at once: who still reads them must ask for the totals again.
        """
        old = self._state().tables
        if not old:
            return False
        table = f"base-{uuid.uuid4().hex}"
        self._read(old).write.parquet(f"{self.path}/{table}")
        while set(old) <= set((state := self._state()).tables):
            rest = {t: ids for t, ids in state.tables.items() if t not in old}
            if self._publish(state.version + 1, {"all": {table: sorted(b for ids in old.values() for b in ids), **rest}}):
                for t in old:
                    self._fs.delete(self._at(t), True)
                return True
        self._fs.delete(self._at(table), True)
        return False


def replayed(rollup: TokenRollup, rows: DataFrame) -> DataFrame:
    """The totals of rows after a history that ends at rows: what the rollup is for, on one table.

    A load that counts an eighth of the documents wrongly; the deletion of another eighth; revisions of the wrong
    counts; the deleted ones again; the load once more under its id, which must change nothing; and a compact. rows
    should be a written table, it is read once for each step.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    wrong = rows.withColumn("tokens", F.col("tokens") + F.when(part == 1, 3).otherwise(0))
    rollup.commit("load", inserts(wrong))
    rollup.commit("takedown", deletes(rows.where(part == 0)))
    rollup.commit("recount", revisions(wrong.where(part == 1), rows.where(part == 1)))
    rollup.compact()
    rollup.commit("restore", inserts(rows.where(part == 0)))
    rollup.commit("load", inserts(wrong))
    rollup.compact()
    return rollup.totals()


#: DuckDB: documents and white-space words by source and language, the rows of the version `words`.
WORDS_SQL = r"""
SELECT source, lang, 'words' AS tokenizer, count(*) AS docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS tokens
FROM documents GROUP BY 1, 2
"""
