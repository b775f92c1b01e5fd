"""The index on disk: immutable segments of Parquet, snapshots made of them, and a pointer to the current snapshot.

A run writes what it made as one segment, and the ids it dropped from earlier ones; both lie in ``snapshot=<n>``.  A row is
alive unless its id was dropped by a later run than the one that wrote it.  Small segments at the end are merged with the
new one, as long as the last is at most ``GROWTH`` times as large, so their number grows with the logarithm of the index,
and so does how often a row is written again.  Terms and the corpus row are of the whole index and written with every
snapshot; they have the size of the vocabulary.

The pointer is replaced in one rename, so readers see one state or the other, and a failed run leaves the old one.  Files
of the snapshot before stay for its readers.  Paths may be of any file system that Spark can reach.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Collection
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexStoreError
from ..operators.ranking import LexicalIndex

SCHEMA_VERSION = 2
POINTER = "current.json"
GROWTH = 4
#: The tables that segments hold, with the id by which their rows are dropped.
KEYS = {"documents": "doc_id", "chunks": "doc_id", "postings": "chunk_id", "lengths": "chunk_id", "vectors": "chunk_id"}


def _folders(meta: dict) -> set[int]:
    """The numbers of all folders that a snapshot reads."""
    return {meta["snapshot"], *(n for n, _ in meta.get("segments", [])), *meta.get("gone", [])}


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    directory: str
    meta: dict

    @property
    def path(self) -> str:
        """The folder of the run that made this snapshot."""
        return f"{self.directory}/snapshot={self.meta['snapshot']}"

    def _read(self, number: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/snapshot={number}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.alive(name, [n for n, _ in self.meta["segments"]]) if name in KEYS else self._read(self.meta["snapshot"], name)

    def alive(self, name: str, numbers: Collection[int]) -> DataFrame:
        """Rows of the segments ``numbers`` that no later run dropped."""
        key, union = KEYS[name], functools.partial(functools.reduce, DataFrame.unionByName)
        rows = union([self._read(n, name).withColumn("_written", F.lit(n)) for n in numbers])
        later = [d for d in self.meta["gone"] if d > min(numbers)]
        if later:
            dropped = union([self._read(d, f"gone_{key}").select(key, F.lit(d).alias("_dropped")) for d in later])
            last = dropped.groupBy(key).agg(F.max("_dropped").alias("_dropped"))
            columns = rows.columns
            rows = rows.join(last, key, "left").where("_dropped is null or _dropped <= _written").select(*columns)
        return rows.drop("_written")

    @property
    def signature(self) -> str:
        return str(self.meta.get("embedder_signature") or "")

    def vectors_sound(self, dim: int) -> bool:
        """Whether the vector table can be read, names each chunk once, and holds vectors of ``dim`` only."""
        try:
            facts = self.table("vectors").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        except (PySparkException, Py4JError):
            return False
        return facts["n"] == facts["ids"] and (not facts["n"] or facts["low"] == facts["high"] == dim)

    def lexical(self) -> LexicalIndex:
        return LexicalIndex(self.table("postings"), self.table("lengths"), self.table("terms"), self.table("corpus"), bool(self.meta.get("stemmed", True)))


class IndexStore:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, str(directory).rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointer(self) -> dict | None:
        fs, p = self._fs(f"{self.directory}/{POINTER}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> Snapshot | None:
        meta = self._pointer()
        if meta is None:
            return None
        if meta.get("schema_version") != SCHEMA_VERSION:
            raise IndexStoreError(f"index at {self.directory} has schema version {meta.get('schema_version')}, not {SCHEMA_VERSION}; rebuild it")
        return Snapshot(self.spark, self.directory, meta)

    def publish(self, rows: dict[str, DataFrame], whole: dict[str, DataFrame], *, size: int, base: Snapshot | None = None, gone: dict[str, DataFrame] | None = None, renewed: Collection[str] = (), **meta: object) -> Snapshot:
        """Writes ``rows`` (new rows by table, ``size`` chunks) as a segment over ``base``, without which they are the
        whole index, and the tables ``whole`` beside it; then points to the new snapshot.

        ``gone`` has the ids dropped from ``base`` by name of id.  Of the tables in ``renewed`` no older row stays, for which
        all segments are merged.
        """
        before = self._pointer()
        number = (before["snapshot"] if before else 0) + 1
        path = f"{self.directory}/snapshot={number}"
        segments = [tuple(s) for s in base.meta["segments"]] if base else []
        dropping = list(base.meta["gone"]) if base else []
        if base and gone:
            for key, ids in gone.items():
                ids.select(key).write.mode("overwrite").parquet(f"{path}/gone_{key}")
            dropping.append(number)
        merged = []
        while segments and (renewed or segments[-1][1] <= GROWTH * size):
            last, held = segments.pop()
            merged.append(last)
            size += held
        state = Snapshot(self.spark, self.directory, {"snapshot": number, "segments": segments, "gone": dropping})
        for name, df in rows.items():
            if merged and name not in renewed:
                df = state.alive(name, merged).unionByName(df)
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        for name, df in whole.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        segments.append((number, size))
        first = segments[0][0]
        meta = {"schema_version": SCHEMA_VERSION, "snapshot": number, "segments": segments, "gone": [d for d in dropping if d > first], **meta}
        meta["before"] = sorted(_folders(before)) if before else []
        self._point(meta)
        for n in set(before.get("before", []) if before else []) - set(meta["before"]) - _folders(meta):
            fs, old = self._fs(f"{self.directory}/snapshot={n}")
            fs.delete(old, True)
        return Snapshot(self.spark, self.directory, meta)

    def _point(self, meta: dict) -> None:
        fs, new = self._fs(f"{self.directory}/.{POINTER}.new")
        stream = fs.create(new, True)
        stream.write(json.dumps(meta).encode())
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{POINTER}")), options)
