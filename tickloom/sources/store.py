"""Raw tables, caches, feature tables, runs, predictions and submissions, with manifests that say what they hold.

Places are paths or URIs that Spark can reach; small files are read and written through Spark's file systems,
so that a folder may lie in any store that executors share.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..schemas import RAW, SchemaReport, compare_schema
from .feather import file_digest, read_feather

SPLITS = ("train", "test")
#: Samples that lie in one shard of a cached table.
SHARD_SAMPLES = 25_000


class Folder:
    """Files below one path or URI."""

    def __init__(self, spark: SparkSession, root):
        self.spark, self.root = spark, str(root).rstrip("/")

    def at(self, *names: str) -> str:
        return "/".join((self.root, *names))

    def _held(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def exists(self, *names: str) -> bool:
        path, fs, _ = self._held(self.at(*names))
        return fs.exists(path)

    def text(self, *names: str) -> str | None:
        """A small file's text, or None if there is no such file."""
        path, fs, jvm = self._held(self.at(*names))
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, text: str, *names: str) -> None:
        """Whole or not at all: written under another name and then renamed."""
        self.join_parts([text.encode()], *names)

    def join_parts(self, parts: Iterator[bytes], *names: str) -> None:
        """One file of the given pieces, one after the other."""
        path, fs, jvm = self._held(self.at(*names))
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.at(*names)}.{uuid.uuid4().hex}.part")
        stream = fs.create(fresh, True)
        try:
            for part in parts:
                stream.write(bytearray(part))
        finally:
            stream.close()
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(fresh, path):
            raise OSError(f"{self.at(*names)} could not be replaced")

    def drop(self, *names: str) -> None:
        path, fs, _ = self._held(self.at(*names))
        fs.delete(path, True)


def identity(**facts) -> str:
    """A short digest of named facts, whatever their order."""
    h = hashlib.blake2b(digest_size=12, person=b"tickloom")
    for name in sorted(facts):
        h.update(f"{name}\x1f{facts[name]!r}\x1e".encode())
    return h.hexdigest()


def tables(split: str) -> tuple[str, ...]:
    return ("market", "order", "transaction") if split == "test" else ("label", "market", "order", "transaction")


def without_nan(rows: DataFrame) -> DataFrame:
    """NaN and infinities as NULL."""
    return rows.select(*(finite(F.col(n)).alias(n) if t in ("float", "double") else n for n, t in rows.dtypes))


class Catalog:
    """Feather tables ``<root>/<split>/<table>.feather``."""

    def __init__(self, spark: SparkSession, root):
        self.spark, self.folder = spark, Folder(spark, root)

    def path(self, split: str, table: str) -> str:
        return self.folder.at(split, f"{table}.feather")

    def read(self, split: str, table: str, columns: list[str] | None = None, max_samples: int | None = None) -> DataFrame:
        """Cleaned rows with ``row_seq``; of the first samples only, if asked."""
        rows = without_nan(read_feather(self.spark, self.path(split, table), columns))
        return rows if max_samples is None else rows.where(F.col("sample_id") < max_samples)

    def source(self, split: str, table: str) -> str:
        """A digest of the file's bytes: another file at the same place is another source."""
        return file_digest(self.path(split, table))

    def validate(self) -> list[tuple[str, str, SchemaReport | None]]:
        """(split, table, report) of every table; no report where the file is missing."""
        out = []
        for split in SPLITS:
            for table in tables(split):
                there = self.folder.exists(split, f"{table}.feather")
                have = read_feather(self.spark, self.path(split, table)).drop("row_seq").schema if there else None
                out.append((split, table, have and compare_schema(have, RAW[table])))
        return out


def failed(results: list[tuple[str, str, SchemaReport | None]]) -> list[tuple[str, str]]:
    return [(s, t) for s, t, r in results if r is None or not r.ok]


def one_of_each(rows: DataFrame) -> DataFrame:
    """The rows; an error unless their samples are 0 to n - 1, each once."""
    s = rows.agg(F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi"), F.count("*").alias("n"), F.count_distinct("sample_id").alias("d")).first()
    if s["n"] == 0 or (s["lo"], s["hi"], s["d"]) != (0, s["n"] - 1, s["n"]):
        raise ValueError("sample ids must be 0 to n - 1, each once")
    return rows


def load_labels(catalog: Catalog, max_samples: int | None = None) -> DataFrame:
    """Labels of samples 0 to n - 1; an error if any is missing or twice."""
    return one_of_each(catalog.read("train", "label", max_samples=max_samples).drop("row_seq"))


def digests(rows: DataFrame) -> dict:
    """Number of rows, and digests of the rows and of their samples that do not depend on the order, in one pass."""
    both = {"rows": F.xxhash64(*rows.columns), "samples": F.xxhash64("sample_id") if "sample_id" in rows.columns else F.lit(0)}
    s = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{name}") for k, c in both.items() for name, f in (("x", F.bit_xor), ("s", lambda c: F.sum(c.cast("decimal(38,0)")))))).first()
    return {"row_count": s["n"], **{k: identity(n=s["n"], x=s[f"{k}_x"], s=str(s[f"{k}_s"])) for k in both}}


class Tables:
    """Parquet tables below a root, each with a manifest; a finished one of the same source is not built again. Rows lie
    in a folder of their own for each build, which the manifest names, so that a broken build leaves the old table."""

    def __init__(self, spark: SparkSession, root):
        self.spark, self.folder = spark, Folder(spark, root)

    def manifest(self, *names: str) -> dict | None:
        text = self.folder.text(*names, "manifest.json")
        return None if text is None else json.loads(text)

    def sound(self, *names: str) -> bool:
        """The manifest agrees with the rows that are there."""
        m = self.manifest(*names)
        if m is None or not self.folder.exists(*names, m["at"], "_SUCCESS"):
            return False
        try:
            rows = self.load(*names)
            return rows.columns == m["columns"] and digests(rows)["rows"] == m["rows"]
        except Exception:  # a damaged file, of whatever kind: build it again
            return False

    def build(self, rows: DataFrame, *names: str, source: str = "", resume: bool = True, shards: bool = False, **notes) -> dict:
        """Writes rows and manifest, unless a sound table of the same source is there. notes: more facts for the manifest.
        shards: rows are dealt out and sorted by sample, in a folder for each ``SHARD_SAMPLES`` samples."""
        before = self.manifest(*names)
        if resume and before and before["source"] == source and self.sound(*names):
            return before
        name = f"rows-{uuid.uuid4().hex[:12]}"
        at = self.folder.at(*names, name)
        if shards:
            rows = rows.withColumn("shard", shard_of(F.col("sample_id"))).repartitionByRange("sample_id").sortWithinPartitions("shard", "sample_id", "row_seq")
        w = rows.write.option("compression", "zstd").option("parquet.enable.dictionary", "false")
        (w.partitionBy("shard") if shards else w).parquet(at)
        back = self.spark.read.parquet(at)
        m = {"at": name, "columns": back.columns, "source": source, **digests(back), **notes}
        self.folder.put(json.dumps(m, indent=1), *names, "manifest.json")
        if before:
            self.folder.drop(*names, before["at"])
        return m

    def load(self, *names: str) -> DataFrame:
        m = self.manifest(*names)
        if m is None:
            raise KeyError(f"no such table: {'/'.join(names)}")
        return self.spark.read.parquet(self.folder.at(*names, m["at"]))

    def load_shards(self, split: str, tables: tuple[str, ...], shards: list[int], columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
        """The cached rows of some shards of several tables, which hold the same samples; only those folders are read."""
        out = {}
        for t in tables:
            rows = self.load("cache", split, t).where(F.col("shard").isin(shards)).drop("shard")
            out[t] = rows.select(*columns[t]) if columns and t in columns else rows
        return out

    def load_blocks(self, split: str, blocks: tuple[str, ...]) -> DataFrame:
        """Feature blocks side by side; an error if one is unknown or, by their manifests, their samples differ."""
        found = {b: self.manifest("features", split, b) for b in blocks}
        if unknown := [b for b, m in found.items() if m is None]:
            raise KeyError(f"no such blocks: {unknown}")
        if len({m["samples"] for m in found.values()}) > 1:
            raise ValueError("blocks hold different samples")
        out = self.load("features", split, blocks[0])
        for b in blocks[1:]:
            out = out.join(self.load("features", split, b), "sample_id")
        return out


def shard_of(sample_id):
    """The shard that holds a sample."""
    return F.floor(sample_id / SHARD_SAMPLES).cast("int")


def place_of(spark: SparkSession, path) -> tuple[Folder, str]:
    """The folder and the name of a file."""
    folder, _, name = str(path).rpartition("/")
    return Folder(spark, folder or "."), name


def _pieces(folder: Folder, rows: DataFrame, name: str) -> Iterator[bytes]:
    """What sorted partitions of (line) rows hold, a file at a time; executors write, the driver only joins their files."""
    work = f"{name}.{uuid.uuid4().hex}.lines"
    rows.write.text(folder.at(work))
    path, fs, jvm = folder._held(folder.at(work))
    files = sorted(str(s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
    try:
        for f in files:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(f))
            try:
                yield bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
    finally:
        folder.drop(work)


def write_submission(rows: DataFrame, path) -> None:
    """One CSV file (sample_id, prediction) in the order of samples, as the contract of the competition asks for."""
    one_of_each(rows)
    if not rows.agg(F.sum(F.col("prediction") * F.col("prediction"))).first()[0]:
        raise ValueError("all predictions are zero")
    folder, name = place_of(rows.sparkSession, path)
    lines = rows.orderBy("sample_id").select(F.concat_ws(",", F.col("sample_id").cast("string"), F.col("prediction").cast("string")).alias("line"))

    def parts() -> Iterator[bytes]:
        yield b"sample_id,prediction\n"
        yield from _pieces(folder, lines, name)

    folder.join_parts(parts(), name)


def read_submission(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(RAW["submission"]).option("header", True).csv(str(path))


def npy_header(n: int) -> bytes:
    """The header of a one-dimensional array of n 64-bit floats in NumPy's file format, version 1."""
    said = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({n},), }}"
    said += " " * (-(10 + len(said) + 1) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + len(said).to_bytes(2, "little") + said.encode()


def write_vector(rows: DataFrame, path) -> None:
    """Predictions of samples 0 to n - 1 as a NumPy file, sample i at place i."""
    one_of_each(rows)
    folder, name = place_of(rows.sparkSession, path)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([x.to_numpy(zero_copy_only=False).astype("<f8").tobytes()], pa.binary())], ["data"])

    ordered = rows.orderBy("sample_id").select(F.col("prediction").cast("double").alias("prediction")).mapInArrow(packed, "data binary")

    def parts() -> Iterator[bytes]:
        yield npy_header(rows.count())
        yield from (bytes(r["data"]) for r in ordered.toLocalIterator())

    folder.join_parts(parts(), name)


def read_vector(spark: SparkSession, path) -> DataFrame:
    """(sample_id, prediction) of such a file: fixed-length records behind the header."""
    head = spark.read.format("binaryFile").load(str(path)).select(F.expr("substring(content, 1, 4096)").alias("h"), "length").first()
    header = bytes(head["h"])
    if header[:8] != b"\x93NUMPY\x01\x00" or b"'<f8'" not in header:
        raise ValueError("not a file of 64-bit floats")
    skip = 10 + int.from_bytes(header[8:10], "little")
    n = (head["length"] - skip) // 8

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                x = pa.py_buffer(data.as_py()[skip:])
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.Array.from_buffers(pa.float64(), n, [None, x])], ["sample_id", "prediction"])

    return spark.read.format("binaryFile").load(str(path)).select("content").mapInArrow(values, "sample_id int, prediction double")
