"""File sources and sinks, and the streaming form of the block operator."""

import hashlib

import numpy as np
import pytest

from wavemill.sources import files
from wavemill.streaming.blocks import block_stream


def test_channels(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("name\ttype\tunits\nC3\tEEG\tuV\nEOG\tEOG\tuV\n")
    assert [tuple(r) for r in files.read_channels(spark, str(tmp_path / "c.tsv")).collect()] == [("C3", "EEG"), ("EOG", "EOG")]
    (tmp_path / "d.tsv").write_text("name\tunits\nC3\tuV\n")
    with pytest.raises(ValueError):
        files.read_channels(spark, str(tmp_path / "d.tsv"))
    (tmp_path / "e.tsv").write_text("name\ttype\nC3\t \n")
    with pytest.raises(Exception, match="blank type"):
        files.read_channels(spark, str(tmp_path / "e.tsv")).collect()


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b" * 64, 2, "z/b"), ("a" * 64, 1, "a/a")], "sha256 string, size long, path string")
    files.write_manifest(df, str(tmp_path / "m"))
    assert [r.path for r in files.read_manifest(spark, str(tmp_path / "m")).collect()] == ["a/a", "z/b"]
    (tmp_path / "t").write_text("# note\n" + "\t".join(["a" * 64, "1", "x"]) + "\n" + "\t".join(["b" * 64, "1", "x"]) + "\n")
    with pytest.raises(ValueError, match="twice"):
        files.read_manifest(spark, str(tmp_path / "t"))


def test_listing_and_digest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.edf").write_bytes(b"abc")
    rows = files.list_files(spark, str(tmp_path), "*.edf").collect()
    assert [(r.path, r.size, r.sha256) for r in rows] == [("sub/a.edf", 3, hashlib.sha256(b"abc").hexdigest())]


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "now")], "a int, b string, made string")
    p = str(tmp_path / "r")
    assert files.write_once(df, p, "made") is True
    assert files.write_once(df.replace("now", "later", ["made"]), p, "made") is False
    with pytest.raises(FileExistsError):
        files.write_once(df.replace("x", "y", ["b"]), p, "made")


def test_edf(spark, tmp_path):
    x = np.array([np.sin(np.arange(512) / 9) * 50, np.arange(512) / 4.0])
    files.write_edf(str(tmp_path / "a.edf"), ["C3", "C4"], "uV", 256, x)
    spark.dataSource.register(files.EdfSource)
    df = spark.read.format("edf").load(str(tmp_path / "a.edf"))
    assert df.count() == 1024
    got = df.orderBy("channel", "idx").toPandas()
    assert np.abs(got.value.to_numpy() - x.ravel()).max() < 0.06
    assert set(got.unit) == {"uV"} and set(got.fs_hz) == {256.0} and list(got.label.unique()) == ["C3", "C4"]


def test_edf_parts_labels_and_digests(spark, tmp_path):
    x = np.array([np.sin(np.arange(256 * 40) / 9) * 50, np.arange(256 * 40) / 40.0, np.ones(256 * 40)])
    paths = [str(tmp_path / n) for n in ("a.edf", "b.edf")]
    for p in paths:
        files.write_edf(p, ["EEG C3", "EEG C4", "EOG"], "uV", 256, x)
    digests = [hashlib.sha256(open(p, "rb").read()).hexdigest() for p in paths]
    spark.dataSource.register(files.EdfSource)
    read = lambda **o: spark.read.format("edf").options(labels="^EEG", records="7", **o).load(",".join(paths))
    df = read(sha256=",".join(digests).upper())
    assert df.rdd.getNumPartitions() == 12
    got = df.orderBy("path", "channel", "idx").toPandas()
    assert len(got) == 2 * 2 * 256 * 40 and np.abs(got.value.to_numpy() - np.tile(x[:2].ravel(), 2)).max() < 0.06
    assert list(got.idx[: 256 * 40]) == list(range(256 * 40))
    with pytest.raises(Exception, match="another digest"):
        read(sha256=",".join(["0" * 64] * 2)).count()
    (tmp_path / "c.edf").write_bytes(open(paths[0], "rb").read()[:-100])
    with pytest.raises(Exception, match="ends in record"):
        spark.read.format("edf").load(str(tmp_path / "c.edf")).count()


def test_manifest_checks_and_documents(spark, tmp_path):
    df = spark.createDataFrame([("b" * 64, 2, "z/b"), ("a" * 64, 1, "a/a")], "sha256 string, size long, path string")
    files.write_manifest(df, str(tmp_path / "m"))
    own = files.manifest_digest(df)
    assert files.read_manifest(spark, str(tmp_path / "m"), own, 2).count() == 2
    for wrong in ({"digest": "0-0-0-0"}, {"files": 3}):
        with pytest.raises(ValueError):
            files.read_manifest(spark, str(tmp_path / "m"), **wrong)
    (tmp_path / "d.json").write_text('{"a": 1}')
    digest = hashlib.sha256(b'{"a": 1}').hexdigest()
    assert files.read_document(spark, str(tmp_path / "d.json"), ["a"], digest) == {"a": 1}
    with pytest.raises(ValueError):
        files.read_document(spark, str(tmp_path / "d.json"), ["a"], "0" * 64)
    with pytest.raises(KeyError):
        files.read_document(spark, str(tmp_path / "d.json"), ["b"])


def test_overwrite_store_and_resume(spark, tmp_path):
    p = str(tmp_path / "r")
    for n in (3, 2):
        files.overwrite(spark.range(n), p)
        assert spark.read.parquet(p).count() == n
    work = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    store = str(tmp_path / "s")
    assert files.still_to_do(work, store, ["k"], "d1").count() == 3
    files.store_results(work.filter("k = 1 or k is null"), store, "d1")
    assert [r.k for r in files.still_to_do(work, store, ["k"], "d1").collect()] == [2]
    assert files.still_to_do(work, store, ["k"], "d2").count() == 3


def test_ledger(spark, tmp_path):
    p = str(tmp_path / "ledger")
    pairs = lambda *r: spark.createDataFrame(r, "block int, arm string")
    files.claim(pairs((1, "x"), (2, "*")), p)
    for bad in (pairs((3, "x"), (1, "x")), pairs((2, "y")), pairs((4, "x"), (4, "x"))):
        with pytest.raises((PermissionError, ValueError)):
            files.claim(bad, p)
    files.claim(pairs((1, "y"), (3, "x")), p)
    files.complete(pairs((1, "x")), p)
    for bad in (pairs((1, "x")), pairs((9, "x"))):
        with pytest.raises(PermissionError):
            files.complete(bad, p)
    assert spark.read.parquet(p).count() == 5


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = str(tmp_path / "out")
    # far later rows of one user push the watermark on, so that every window of the data closes
    late = events.limit(1).selectExpr("event_id", "ts + interval 90 days as ts", "-1L as user_id", "event_type", "value", "props")
    src = str(tmp_path / "in")
    events.repartition(2).write.parquet(f"{src}/0")
    late.write.parquet(f"{src}/1")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(f"{src}/*")
    q = block_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).select("user_id", "start", "n").collect() if r.user_id >= 0}
    want = {tuple(r) for r in block_stream(events).select("user_id", "start", "n").collect()}
    assert got == want
