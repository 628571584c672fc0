"""File sources and sinks: channel tables, manifests, listings with digests, EDF recordings, write-once results."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavemill.functions.quantiles import same_key


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated channel table with ``name`` and ``type``. A missing column or blank type raises."""
    df = spark.read.csv(path, sep="\t", header=True, mode="FAILFAST")
    if missing := {"name", "type"} - set(df.columns):
        raise ValueError(f"{path}: no column {sorted(missing)}")
    blank = F.col("type").isNull() | (F.trim("type") == "")
    kind = F.when(blank, F.raise_error(F.concat(F.lit("blank type of channel "), F.coalesce("name", F.lit("?"))))).otherwise(F.col("type"))
    return df.select("name", kind.alias("type"))


def read_manifest(spark: SparkSession, path: str, digest: str | None = None, files: int | None = None) -> DataFrame:
    """``sha256``, ``size``, ``path`` of a manifest; lines after ``#`` are comments. A path listed twice raises, and so do
    another number of ``files`` or another ``digest`` (of ``manifest_digest``) than given."""
    df = spark.read.csv(path, sep="\t", comment="#", schema="sha256 string, size long, path string", mode="FAILFAST")
    twice = df.groupBy("path").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path} lists {twice[0]['path']} twice")
    if files is not None and (n := df.count()) != files:
        raise ValueError(f"{path} lists {n} files, not {files}")
    if digest is not None and (own := manifest_digest(df)) != digest:
        raise ValueError(f"{path} has digest {own}")
    return df


def manifest_digest(df: DataFrame) -> str:
    """A digest of a manifest's rows in any order: the sums of four parts of each row's digest."""
    row = F.sha2(F.concat_ws("\t", "sha256", F.col("size").cast("string"), "path"), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return "-".join(str(x or 0) for x in df.agg(*parts).first())


def write_manifest(df: DataFrame, path: str) -> None:
    """Writes ``sha256``, ``size``, ``path`` sorted by path as text lines, in as many files as Spark's range sort
    makes; the file names keep the order."""
    rows = df.orderBy("path").select(F.concat_ws("\t", "sha256", F.col("size").cast("string"), "path").alias("value"))
    rows.write.text(path)


def list_files(spark: SparkSession, root: str, glob: str = "*", hashed: bool = True) -> DataFrame:
    """``path`` (relative), ``size``, ``modified`` and, where asked, ``sha256`` of the files under ``root``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    cols = [F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return df.select(*cols, *([F.sha2("content", 256).alias("sha256")] if hashed else []))


def write_once(df: DataFrame, path: str, keep: str | None = None) -> bool:
    """Writes a result where there is none and gives True. An equal one (without the column ``keep``, such as
    provenance) stays, giving False; a different one raises ``FileExistsError``."""
    spark = df.sparkSession
    there, system = _system(spark, path)
    if not system.exists(there):
        df.write.mode("errorifexists").parquet(path)
        return True
    old = spark.read.parquet(path)
    a, b = (x.drop(keep) if keep else x for x in (old, df))
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise FileExistsError(f"{path} holds other columns")
    b = b.select(*a.columns)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise FileExistsError(f"{path} holds another result")
    return False


def read_document(spark: SparkSession, path: str, required: list[str], digest: str | None = None) -> dict:
    """A JSON document of one result, with its required keys and, where given, its SHA-256 digest checked; small by
    contract (one file, one object)."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
    if digest is not None and hashlib.sha256(text.encode()).hexdigest() != digest.lower():
        raise ValueError(f"{path} has another digest than expected")
    doc = json.loads(text)
    if missing := [k for k in required if k not in doc]:
        raise KeyError(f"{path} lacks {missing}")
    return doc


def _system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces a derived result: written beside it first, then renamed, so that readers see the old or the new one."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    new, system = _system(spark, f"{path}.new")
    old, _ = _system(spark, path)
    system.delete(old, True)
    if not system.rename(new, old):
        raise OSError(f"{path}.new could not be renamed")


def store_results(df: DataFrame, path: str, digest: str) -> None:
    """Appends results to a store, with the digest of the code and settings that they depend on."""
    df.withColumn("_digest", F.lit(digest)).write.mode("append").partitionBy("_digest").parquet(path)


def still_to_do(work: DataFrame, path: str, keys: list[str], digest: str) -> DataFrame:
    """The rows of ``work`` without a stored result of the same digest: where a stopped run goes on. Null keys match each
    other; without a store all rows are left."""
    there, system = _system(work.sparkSession, path)
    if not system.exists(there):
        return work
    done = work.sparkSession.read.parquet(path).filter(F.col("_digest") == digest).select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    return work.join(done, same_key(keys, "_k_"), "left_anti")


def claim(claims: DataFrame, path: str) -> None:
    """Enters claims (``block`` int, ``arm`` string) as started into an append-only ledger, before any work on them. One that
    is entered already, whatever its status, or whose block is entered for all arms (``*``) refuses the whole claim."""
    there, system = _system(claims.sparkSession, path)
    rows = claims.select(F.col("block").cast("int").alias("block"), "arm")
    if rows.groupBy("block", "arm").count().filter("count > 1").limit(1).count():
        raise ValueError("a claim names an entry twice")
    if system.exists(there):
        held = claims.sparkSession.read.parquet(path).select(F.col("block").alias("_b"), F.col("arm").alias("_a")).distinct()
        blocked = rows.join(held, (F.col("block") == F.col("_b")) & ((F.col("arm") == F.col("_a")) | (F.col("_a") == "*")), "left_semi").limit(1).collect()
        if blocked:
            raise PermissionError(f"block {blocked[0].block}, arm {blocked[0].arm} is claimed already")
    rows.withColumn("status", F.lit("started")).write.mode("append").parquet(path)


def complete(claims: DataFrame, path: str) -> None:
    """Enters claims as completed; each must be started and not yet completed."""
    rows = claims.select(F.col("block").cast("int").alias("block"), "arm").distinct()
    now = claims.sparkSession.read.parquet(path).groupBy("block", "arm").agg(F.max(F.col("status") == "completed").alias("_done"))
    wrong = rows.join(now, ["block", "arm"], "left").filter("_done is null or _done").limit(1).collect()
    if wrong:
        raise PermissionError(f"block {wrong[0].block}, arm {wrong[0].arm} isn't started")
    rows.withColumn("status", F.lit("completed")).write.mode("append").parquet(path)


def _open(path: str):
    """A file to read, local or by any address that Arrow knows."""
    if "://" not in path:
        return open(path, "rb")
    system, inner = pa_fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class EdfHead:
    """What the header of an EDF file says: labels, units, scales, samples a record."""

    def __init__(self, path: str):
        with _open(path) as f:
            head = f.read(256)
            n = int(head[252:256])
            self.records, self.seconds = int(head[236:244]), float(head[244:252])
            fields = f.read(256 * n)
            size = f.seek(0, 2)
        at = 0

        def column(width: int) -> list[str]:
            nonlocal at
            out = [fields[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
            at += n * width
            return out

        self.labels, _, self.units = column(16), column(80), column(8)
        self.lo, hi, self.dlo, dhi = (list(map(float, column(8))) for _ in range(4))
        column(80)
        self.counts = list(map(int, column(8)))
        self.scale = [(b - a) / (d - c) for a, b, c, d in zip(self.lo, hi, self.dlo, dhi)]
        self.start, self.width = 256 * (n + 1), 2 * sum(self.counts)
        whole = (size - self.start) // self.width
        if self.records > whole:
            raise ValueError(f"{path} ends in record {whole}")
        self.records = whole if self.records < 0 else self.records


class EdfPartition(InputPartition):
    def __init__(self, path: str, first: int, stop: int, checked: str):
        self.path, self.first, self.stop, self.checked = path, first, stop, checked


class EdfReader(DataSourceReader):
    """Some records of a file a partition, read a few at a time.

    Options: ``path`` (files, with commas between), ``labels`` (a pattern that labels must match), ``records`` (of a
    partition), ``sha256`` (digests in the order of the files; a file with another one raises)."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.labels = options.get("labels", "")
        self.records = int(options.get("records", 1024))
        self.digests = [d for d in options.get("sha256", "").split(",") if d]
        if self.digests and len(self.digests) != len(self.paths):
            raise ValueError("as many digests as files are needed")

    def partitions(self) -> list[InputPartition]:
        out = []
        for k, path in enumerate(self.paths):
            n = EdfHead(path).records
            out += [EdfPartition(path, i, min(i + self.records, n), self.digests[k] if self.digests and not i else "") for i in range(0, n, self.records)]
        return out

    def read(self, partition: EdfPartition) -> Iterator[pa.RecordBatch]:
        path = partition.path
        if partition.checked:
            digest = hashlib.sha256()
            with _open(path) as f:
                while part := f.read(1 << 20):
                    digest.update(part)
            if digest.hexdigest() != partition.checked.lower():
                raise ValueError(f"{path} has another digest than expected")
        h = EdfHead(path)
        wanted = [c for c, label in enumerate(h.labels) if re.search(self.labels, label)]
        begin = np.cumsum([0, *h.counts])
        with _open(path) as f:
            f.seek(h.start + partition.first * h.width)
            for k in range(partition.first, partition.stop, 16):
                m = min(16, partition.stop - k)
                raw = np.frombuffer(f.read(m * h.width), "<i2").reshape(m, -1)
                for c in wanted:
                    x = (raw[:, begin[c] : begin[c + 1]].astype(float).ravel() - h.dlo[c]) * h.scale[c] + h.lo[c]
                    n = len(x)
                    same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
                    yield pa.RecordBatch.from_arrays(
                        [same(path, pa.string()), same(c, pa.int32()), same(h.labels[c], pa.string()), same(h.units[c], pa.string()),
                         same(h.counts[c] / h.seconds, pa.float64()), pa.array(np.arange(n) + k * h.counts[c], pa.int64()), pa.array(x)],
                        ["path", "channel", "label", "unit", "fs_hz", "idx", "value"],
                    )


class EdfSource(DataSource):
    """``spark.read.format("edf").load(paths)``: one row a sample, in the file's physical unit; see ``EdfReader``."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return "path string, channel int, label string, unit string, fs_hz double, idx long, value double"

    def reader(self, schema) -> DataSourceReader:
        return EdfReader(self.options)


def write_edf(path: str, labels: list[str], unit: str, fs: int, values: np.ndarray, limit: float = 3276.8) -> None:
    """A small EDF file for tests: (channel, sample) values in records of one second."""
    n, total = values.shape
    pad = lambda s, w: str(s).ljust(w)[:w].encode("ascii")
    records = total // fs
    head = pad(0, 8) + pad("", 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8)
    head += pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(1, 8) + pad(n, 4)
    for field, width in ((labels, 16), ([""] * n, 80), ([unit] * n, 8), ([-limit] * n, 8), ([limit] * n, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([fs] * n, 8), ([""] * n, 32)):
        head += b"".join(pad(x, width) for x in field)
    step = 2 * limit / 65535
    with open(path, "wb") as f:
        f.write(head)
        for r in range(records):
            for c in range(n):
                part = np.round((values[c, r * fs : (r + 1) * fs] + limit) / step) - 32768
                f.write(struct.pack(f"<{fs}h", *np.clip(part, -32768, 32767).astype(int)))
