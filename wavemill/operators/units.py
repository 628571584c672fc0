"""Quantities recorded in different units, brought to microvolts (problem 2).

Each row's evidence is read in SQL: its own remark, its unit field, and the note of its device for the firmware.
Rows that state their unit train a calibrated random forest on magnitude, source, device and firmware; the forest
predicts the unit of the rows that do not. Confident predictions that no note contradicts are converted; all others
go to review with both candidates, where the note of the device settles those it covers.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import units as U
from wavemill.functions.lineage import cut

#: At most so many rows with a stated unit train and calibrate the forest; they are those with the least hash.
TRAIN_ROWS = 20_000
#: A prediction is taken over from this calibrated probability on.
CONFIDENT = 0.9
#: A median SD in this range (µV, both ends included) passes the units check.
PASS_UV = (2.0, 200.0)


def distinct_recordings(recordings: DataFrame) -> DataFrame:
    """One row for each ``rec_id``, the one received last; columns that no operator here needs are left out."""
    keep = ["subject", "session", "unit_text", "device_id", "firmware", "remark"]
    best = recordings.groupBy("rec_id").agg(F.max(F.struct("received_at", *keep)).alias("_r"))
    return best.select("rec_id", *[F.col(f"_r.{c}").alias(c) for c in keep])


def with_evidence(df: DataFrame, amplifiers: DataFrame, value: Column) -> DataFrame:
    """Adds ``value``, ``own_unit``, ``note_unit`` and ``count_nv`` to rows with ``remark``, ``unit_text``,
    ``device_id`` and ``firmware``. ``value`` comes from the remark where the field has none."""
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)  # few bytes, but much work a row
    notes = amplifiers.select(F.col("device_id").alias("_dev"), "note")  # a fixed small table: Spark broadcasts it
    parts = U.pieces(F.col("remark"))
    read = (
        df.join(notes, F.col("device_id") == F.col("_dev"), "left")
        .withColumn("_parts", parts)
        .withColumn("_given", F.when(~F.isnan(value), value))
        .withColumn("_reading", F.when(F.col("_given").isNull(), U.reading(F.col("_parts"))))
        .withColumn("_note", U.note_unit(F.col("note"), F.col("firmware")))
    )
    remark_unit = F.coalesce(F.col("_reading.unit"), U.stated(F.col("_parts")))
    return (
        read.withColumn("value", F.coalesce("_given", "_reading.value"))
        .withColumn("own_unit", F.coalesce(remark_unit, U.unit_of(F.col("unit_text"))))
        .withColumn("note_unit", F.col("_note.unit"))
        .withColumn("count_nv", F.coalesce(U.count_size(F.col("_parts")), F.col("_note.size")))
        .drop("_dev", "_parts", "_given", "_reading", "_note", "note")
    )


def nanovolts(unit: Column, count_nv: Column) -> Column:
    """Nanovolts of one unit."""
    out = F.when(unit == "count", count_nv)
    for name, size in U.NANOVOLTS.items():
        out = out.when(unit == name, size)
    return out


def _coded(c: Column) -> Column:
    out = F.lit(0.0)
    for k, name in enumerate(U.CLASSES):
        out = F.when(c == name, float(k + 1)).otherwise(out)
    return F.when(c.isNull(), 0.0).otherwise(out)


FEATURES = ["f_magnitude", "f_kind", "f_device", "f_major", "f_minor"]


def features(rows: DataFrame) -> DataFrame:
    version = U.version_key(F.coalesce(F.col("firmware"), F.lit("")))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return vector.transform(
        rows.withColumns(
            {
                "f_magnitude": F.coalesce("magnitude", F.lit(-12.0)),
                "f_kind": F.when(F.col("kind") == "check", 0.0).otherwise(1.0),
                "f_device": F.coalesce(F.col("device_id").cast("double"), F.lit(0.0)),
                "f_major": F.coalesce(F.get(version, F.lit(0)).cast("double"), F.lit(0.0)),
                "f_minor": F.coalesce(F.get(version, F.lit(1)).cast("double"), F.lit(0.0)),
            }
        )
    )


def train(rows: DataFrame, train_rows: int = TRAIN_ROWS):
    """The forest and its calibration, or None where fewer than two units are stated.

    Four fifths of the sample train the forest; on the rest an isotonic regression maps the forest's vote for
    its best class to how often that class is right.
    """
    sample = (
        features(rows.filter(F.col("own_unit").isNotNull() & F.col("magnitude").isNotNull()))
        .withColumn("_h", F.xxhash64("kind", "row_id"))
        .orderBy("_h", "kind", "row_id")
        .limit(train_rows)
        .select("features", (_coded(F.col("own_unit")) - 1).alias("label"), F.pmod("_h", F.lit(5)).alias("_fold"))
        .repartition(4)
        .cache()
    )
    try:
        fit, hold = sample.filter("_fold > 0"), sample.filter("_fold = 0")
        if fit.select("label").distinct().count() < 2 or hold.isEmpty():
            return None
        forest = RandomForestClassifier(numTrees=12, maxDepth=7, maxBins=32, seed=7).fit(fit)
        scored = _vote(forest.transform(hold)).select(
            F.col("vote").alias("feature"), (F.col("prediction") == F.col("label")).cast("double").alias("right")
        )
        calibration = IsotonicRegression(featuresCol="feature", labelCol="right", predictionCol="confidence").fit(scored)
        return forest, calibration
    finally:
        sample.unpersist()


def _vote(scored: DataFrame) -> DataFrame:
    return scored.withColumn("vote", F.array_max(vector_to_array("probability")))


def resolve(rows: DataFrame, model) -> DataFrame:
    """Adds ``model_unit``, ``confidence``, ``status`` and the final ``unit`` and ``unit_nv``.

    ``stated``: the row itself names the unit. ``converted``: the forest is confident and the device note names
    the same unit or none; a row without a note thus has the forest's unit. ``review``: everything else; the device
    note settles the unit, and where there is none it stays null.
    """
    if model is None:
        scored = rows.withColumns({"model_unit": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    else:
        forest, calibration = model
        label = F.element_at(F.array(*[F.lit(c) for c in U.CLASSES]), F.col("prediction").cast("int") + 1)
        scored = _vote(forest.transform(features(rows))).withColumn("model_unit", label)
        scored = calibration.transform(scored.withColumn("feature", F.col("vote")))
    sure = (F.col("confidence") >= CONFIDENT) & F.coalesce(F.col("model_unit") == F.col("note_unit"), F.col("note_unit").isNull())
    sure = sure & F.col("model_unit").isNotNull() & ((F.col("model_unit") != "count") | F.col("count_nv").isNotNull())
    status = F.when(F.col("own_unit").isNotNull(), "stated").when(sure, "converted").otherwise("review")
    unit = F.when(status == "stated", F.col("own_unit")).when(status == "converted", F.col("model_unit")).otherwise(F.col("note_unit"))
    return scored.withColumns({"status": status, "unit": unit}).withColumn(
        "unit_nv", nanovolts(F.col("unit"), F.col("count_nv"))
    )


def recording_rows(recordings: DataFrame, amplifiers: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Recordings with their evidence, and with the mean log magnitude of their samples where these are given."""
    rows = with_evidence(distinct_recordings(recordings), amplifiers, F.lit(0.0))
    if samples is None:
        magnitude = F.lit(None).cast("double")
    else:
        size = F.abs(F.col("data_uv"))
        level = samples.filter((size > 0) & (size < float("inf"))).groupBy(F.col("rec_id").alias("_rec")).agg(
            F.avg(F.log10(size)).alias("_level")
        )
        rows = rows.join(level, F.col("rec_id") == F.col("_rec"), "left").drop("_rec")
        magnitude = F.col("_level")
    return rows.select(
        F.lit("samples").alias("kind"), F.col("rec_id").alias("row_id"), magnitude.alias("magnitude"),
        F.lit(None).cast("double").alias("value"), "own_unit", "note_unit", "count_nv", "device_id", "firmware",
    )


def recording_units(recordings: DataFrame, checks: DataFrame, samples: DataFrame, amplifiers: DataFrame) -> DataFrame:
    """``rec_id``, ``unit`` and ``unit_nv`` of each recording, the same as in ``harmonise``.

    A statement or a note gives a recording's unit whatever the forest says; the forest is trained only where some
    recording has neither."""
    rows = cut(resolve(recording_rows(recordings, amplifiers), None).select(F.col("row_id").alias("rec_id"), "unit", "unit_nv"))
    if rows.filter("unit is null").isEmpty():
        return rows
    every = harmonise(recordings, checks, samples, amplifiers).filter("kind = 'samples'")
    return every.select(F.col("row_id").alias("rec_id"), "unit", "unit_nv")


def check_rows(checks: DataFrame, recordings: DataFrame, amplifiers: DataFrame) -> DataFrame:
    """Unit checks with their evidence; equal rows count once. The device is that of the check's recording."""
    devices = distinct_recordings(recordings).select(F.col("rec_id").alias("_rec"), "device_id", "firmware")
    own = checks.select("check_id", "rec_id", "median_sd_uv", "unit_text", "remark", "passed").distinct()
    rows = with_evidence(own.join(devices, F.col("rec_id") == F.col("_rec"), "left"), amplifiers, F.col("median_sd_uv"))
    size = F.abs("value")
    return rows.select(
        F.lit("check").alias("kind"), F.col("check_id").alias("row_id"), F.when(size > 0, F.log10(size)).alias("magnitude"),
        "value", "own_unit", "note_unit", "count_nv", "device_id", "firmware", "passed",
    )


def harmonise(recordings: DataFrame, checks: DataFrame, samples: DataFrame, amplifiers: DataFrame) -> DataFrame:
    """Every check and every recording with its unit: ``kind``, ``row_id``, ``value``, ``unit``, ``unit_nv``,
    ``status``, ``model_unit``, ``confidence``, ``note_unit``, ``nv`` (the reading, or one unit, in whole nanovolts)
    and the stored ``passed``.

    The evidence of all rows is written once; the forest is trained on it and scores it. Null or placeholder fields
    count as no statement. A check without any reading has a null ``nv``, and so has a count whose size is nowhere
    given. Empty tables give no rows. Other columns of the tables are ignored.
    """
    a = check_rows(checks, recordings, amplifiers)
    b = recording_rows(recordings, amplifiers, samples)
    rows = cut(a.unionByName(b.withColumn("passed", F.lit(None).cast("boolean"))))
    done = resolve(rows, train(rows))
    nv = F.when(F.col("kind") == "check", F.bround(F.col("value") * F.col("unit_nv"))).otherwise(F.bround("unit_nv"))
    return done.select(
        "kind", "row_id", "value", "unit", "unit_nv", "status", "model_unit", "confidence", "note_unit", nv.cast("long").alias("nv"), "passed"
    )


def for_review(harmonised: DataFrame) -> DataFrame:
    """The rows whose unit neither they nor the forest settle: ``kind``, ``row_id``, ``value``, both candidates
    (``model_unit`` with its ``confidence``, ``note_unit``) and the ``unit`` they have until someone has looked."""
    return harmonised.filter("status = 'review'").select("kind", "row_id", "value", "model_unit", "confidence", "note_unit", "unit").distinct()


def masked_accuracy(rows: DataFrame, model) -> DataFrame:
    """How the forest does on rows that state their unit, as if they did not: by fifths of the calibrated
    confidence (``confidence``, lower end), ``n`` rows and the share ``right``."""
    stated = rows.filter(F.col("own_unit").isNotNull() & F.col("magnitude").isNotNull())
    scored = resolve(stated.withColumn("_truth", F.col("own_unit")), model)
    fifth = F.floor(F.col("confidence") * 5) / 5
    return scored.groupBy(F.least(fifth, F.lit(0.8)).alias("confidence")).agg(
        F.count("*").alias("n"), F.avg((F.col("model_unit") == F.col("_truth")).cast("int")).alias("right")
    )


def not_in_microvolts(harmonised: DataFrame) -> DataFrame:
    """``kind``, ``row_id`` and ``nv`` of the rows recorded in another unit than microvolts."""
    return harmonised.filter((F.col("unit") != "uV") & F.col("nv").isNotNull()).select("kind", "row_id", "nv").distinct()


def checks_in_microvolts(harmonised: DataFrame) -> DataFrame:
    """Each check's median SD in µV and ``passed`` judged anew; null where the reading or unit is unknown."""
    uv = F.col("nv") / 1000
    return (
        harmonised.filter("kind = 'check'")
        .select(F.col("row_id").alias("check_id"), uv.alias("sd_uv"), uv.between(*PASS_UV).alias("passed"), "status")
        .distinct()
    )


def samples_in_microvolts(samples: DataFrame, units: DataFrame) -> DataFrame:
    """All samples in µV; null where the unit of the recording is unknown."""
    factor = units.select(F.col("rec_id").alias("_rec"), (F.col("unit_nv") / 1000).alias("_f"))
    return samples.join(factor, F.col("rec_id") == F.col("_rec"), "left").select(
        "rec_id", "channel", "idx", (F.col("data_uv") * F.col("_f")).alias("uv")
    )
