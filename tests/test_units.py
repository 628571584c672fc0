"""Units from text, cascade and classifier."""

import pytest
from pyspark.sql import functions as F

from wavemill.functions import units as U
from wavemill.operators import units as O


@pytest.mark.parametrize(
    "text, unit",
    [("uV", "uV"), ("µV RMS", "uV"), ("μV", "uV"), ("[mV]", "mV"), ("10^-3 V", "mV"), ("V (SI)", "V"), ("volts", "V"), ("nV rms", "nV"),
     ("raw counts", "count"), ("adc units", "count"), ("LSB", "count"), ("thousandths of a volt", "mV"), ("?", None), ("", None), (None, None), ("see V7", None)],
)
def test_unit_of(spark, text, unit):
    assert spark.createDataFrame([(text,)], "t string").select(U.unit_of(F.col("t"))).first()[0] == unit


@pytest.mark.parametrize(
    "remark, unit, value, size",
    [("input range 3.2 mV, not reached", None, None, None), ("battery at 3.7 V / all values µV", "uV", None, None),
     ("calibration pulse 100 uV ok; Angaben in milli-volt", "mV", None, None), ("numbers are in counts. LSB = 0.195 µV", "count", None, 195.0),
     ("resolution 250 nV/count", None, None, 250.0), ("1 digit = 195 nV", None, None, 195.0), ("one count is 0.5 µV", None, None, 500.0),
     ("0.125 uV per step; cap refitted", None, None, 125.0), ("spread came out at 23 846nV", None, 23846.0, None), ("sd=1,2E-2mV (hand entry)", None, 0.012, None),
     ("header mislabelled; treat as plain volts", "V", None, None), ("mains hum at 50 Hz", None, None, None), (None, None, None, None)],
)
def test_remarks(spark, remark, unit, value, size):
    parts = U.pieces(F.col("t"))
    row = spark.createDataFrame([(remark,)], "t string").select(U.stated(parts), U.reading(parts).value, U.count_size(parts)).first()
    assert row[0] == unit and row[2] == size
    assert row[1] == (pytest.approx(value) if value else None)


@pytest.mark.parametrize(
    "note, firmware, unit, size",
    [("Before firmware 2.12 the export is in mV, afterwards in µV.", "2.9", "mV", None), ("Before firmware 2.12 the export is in mV, afterwards in µV.", "2.12", "uV", None),
     ("Firmware 3.9 and older write volts; from 3.10 on microvolts.", "3.9", "V", None), ("Firmware 3.9 and older write volts; from 3.10 on microvolts.", "3.10", "uV", None),
     ("Counts up to firmware 4.2 (250 nV each). Microvolts after that.", "4.2", "count", 250.0), ("Counts up to firmware 4.2 (250 nV each). Microvolts after that.", "4.10", "uV", 250.0),
     ("µV since delivery, checked with a test signal of 2 mV.", "1.4", "uV", None), ("Raw converter counts, 0.195 µV per count.", "1.4", "count", 195.0),
     ("Loaner unit: thousandths of a volt.", None, "mV", None), (None, "1.4", None, None)],
)
def test_notes(spark, note, firmware, unit, size):
    row = spark.createDataFrame([(note, firmware)], "n string, f string").select(U.note_unit(F.col("n"), F.col("f")).alias("u")).first()[0]
    assert (row.unit, row.size) == (unit, size)


def tables(spark):
    rec = spark.createDataFrame(
        [(i, "s", "t1", [None, "mV", ""][i % 3], 1 + i % 2, "3.9", None, f"2024-01-0{1 + i % 9}", 9) for i in range(60)],
        "rec_id long, subject string, session string, unit_text string, device_id int, firmware string, remark string, received_at string, clash int",
    )
    checks = spark.createDataFrame(
        [(i, i % 60, [20.0, 0.02, float("nan"), None][i % 4], ["uV", "mV", None, None][i % 4], [None, None, "sd=3,5µV (hand entry)", None][i % 4], True, 1) for i in range(200)],
        "check_id long, rec_id long, median_sd_uv double, unit_text string, remark string, passed boolean, clash int",
    )
    samples = spark.createDataFrame([(i, c, k, float(k - 5)) for i in range(60) for c in (0, 1) for k in range(10)], "rec_id long, channel int, idx long, data_uv double")
    amps = spark.createDataFrame([(1, "Exports microvolts."), (2, "Writes millivolts in every export.")], "device_id int, note string")
    return rec, checks, samples, amps


def test_harmonise(spark):
    rec, checks, samples, amps = tables(spark)
    h = O.harmonise(rec, checks.unionByName(checks), samples, amps).toPandas()
    assert len(h) == 260
    c = h[h.kind == "check"].set_index("row_id").sort_index()
    assert list(c.nv[:3].astype(float)) == [20000.0, 20000.0, 3500.0] and c.nv[3] != c.nv[3]
    r = h[h.kind == "samples"].set_index("row_id").sort_index()
    assert r.unit[1] == "mV" and r.unit[0] == "uV" and r.unit[3] == "mV"
    found = O.not_in_microvolts(O.harmonise(rec, checks, samples, amps)).toPandas()
    assert set(found[found.kind == "check"].row_id) == {i for i in range(200) if i % 4 == 1}
    assert O.harmonise(rec.limit(0), checks.limit(0), samples.limit(0), amps.limit(0)).count() == 0


def test_classifier_accuracy(spark):
    """Held-out rows with a stated unit: the forest is right where it is confident."""
    d = "/root/testdata/sf0.01"
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    rows = O.check_rows(t("units_checks"), t("recordings"), t("amplifiers")).drop("passed").unionByName(O.recording_rows(t("recordings"), t("amplifiers"), t("samples")))
    held = F.pmod(F.xxhash64("row_id"), F.lit(3)) == 0
    model = O.train(rows.filter(~held))
    test = O.resolve(rows.filter(held & F.col("own_unit").isNotNull()), model).toPandas()
    sure = test[test.confidence >= O.CONFIDENT]
    assert len(sure) > 0.3 * len(test)
    assert (sure.model_unit == sure.own_unit).mean() > 0.85


def test_forest_decides_where_notes_are_masked(spark):
    """A device whose note says nothing: its rows without a statement get the forest's unit where it is sure, and are
    listed for review where not; without the forest they would have none. Recordings have one unit everywhere."""
    d = "/root/testdata/sf0.01"
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    rec, checks, samples = t("recordings"), t("units_checks"), t("samples")
    masked = t("amplifiers").withColumn("note", F.when(F.col("device_id") % 2 > 0, F.col("note")))
    h = O.harmonise(rec, checks, samples, masked).cache()
    won = h.filter("status = 'converted' and note_unit is null")
    assert won.count() > 5
    open_rows = O.for_review(h).filter("note_unit is null")
    assert open_rows.count() > 0 and open_rows.filter("unit is not null").count() == 0
    true = O.harmonise(rec, checks, samples, t("amplifiers")).select("kind", "row_id", F.col("unit").alias("want"))
    right = won.join(true, ["kind", "row_id"]).agg(F.avg((F.col("unit") == F.col("want")).cast("int"))).first()[0]
    assert right > 0.85
    plain = O.resolve(O.recording_rows(rec, masked), None).filter("unit is not null").count()
    units = O.recording_units(rec, checks, samples, masked)
    assert units.filter("unit is not null").count() > plain
    same = units.join(h.filter("kind = 'samples'").select(F.col("row_id").alias("rec_id"), F.col("unit").alias("u")), "rec_id")
    assert same.filter("not unit <=> u").count() == 0 and same.count() == units.count()


def test_masked_accuracy_and_review(spark):
    rec, checks, samples, amps = tables(spark)
    rows = O.check_rows(checks, rec, amps).drop("passed").unionByName(O.recording_rows(rec, amps, samples))
    found = O.masked_accuracy(rows, O.train(rows)).collect()
    assert sum(r.n for r in found) == rows.filter("own_unit is not null and magnitude is not null").count() and all(0 <= r.right <= 1 for r in found)
    assert O.for_review(O.harmonise(rec.limit(0), checks.limit(0), samples.limit(0), amps.limit(0))).count() == 0
