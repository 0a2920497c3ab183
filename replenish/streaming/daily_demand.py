"""Daily demand from a sales event stream, and a spike watch.

Daily sums are an event-time windowed aggregation with a watermark, so the
state per (day, sku) is dropped once the watermark passes the day and rows
later than the watermark are dropped.

E6 is an upsert log in update mode: each micro-batch writes its updated
(day, sku) rows into a folder of its own (a batch that is run again after a
failure overwrites it); the current view keeps the newest row per key.
``compact_log`` rewrites the newest rows under a folder that carries the last
batch it holds; readers take the latest complete one and the batches after
it, so they see the same view before, while and after it is written. A
second query over the same files, ``start_late_rows``, lists the events that
the watermark drops.

E7 emits in append mode: a day's alert is written once, by the file sink,
when the watermark closes the day; the sink's own log keeps a restart from
writing it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replenish.functions import planning as P
from replenish.session import scratch_path
from replenish.sources.tpch import purchase_events, utc_date, utc_instant

SPIKE_SCHEMA = "day timestamp, sku string, qty double, upper double, severity string"
LATE_SCHEMA = "ts timestamp, sku string, qty double, watermark timestamp, batch_id long"
DAILY_SCHEMA = "window struct<start:timestamp,end:timestamp>, sku string, qty double, events long, batch_id long"


def daily_demand_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming (or batch) daily demand per sku from purchase events."""
    p = purchase_events(events)
    return (p.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day"), "sku")
            .agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("events")))


def _read_stream(spark: SparkSession, source_dir: str, file_glob: str, files_per_batch: int | None) -> DataFrame:
    """Files and folders that match ``file_glob``; without ``files_per_batch``
    a micro-batch takes all files there are."""
    path = f"{source_dir.rstrip('/')}/{file_glob}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


#: A query with one stateful operator needn't let late rows through for one
#: micro-batch more, as the engine does by default for chains of them: with
#: this setting, which the checkpoint keeps, a batch's rows are held against
#: the watermark of all batches before it.
_ONE_STATE = "spark.sql.streaming.statefulOperator.allowMultiple"


def _start(writer, checkpoint: str, available_now: bool):
    spark = SparkSession.active()
    before = spark.conf.get(_ONE_STATE)
    spark.conf.set(_ONE_STATE, "false")
    try:
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
    finally:
        spark.conf.set(_ONE_STATE, before)


def start_daily_demand(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                       file_glob: str = "events*.parquet", available_now: bool = True, watermark: str = "1 day",
                       files_per_batch: int | None = 1000):
    """Start E6: updated (day, sku) rows to the log in ``out_dir``."""
    stream = _read_stream(spark, source_dir, file_glob, files_per_batch).observe("drained", F.count_if(_counted()).alias("rows"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return _start(daily_demand_stream(stream, watermark).writeStream.outputMode("update").foreachBatch(sink), checkpoint, available_now)


def start_spike_watch(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, thresholds: DataFrame,
                      file_glob: str = "events*.parquet", available_now: bool = True, watermark: str = "1 day",
                      files_per_batch: int | None = 1000, end_dir: str | None = None):
    """Start E7: one alert row per closed (day, sku) above its fence, appended to the files of ``out_dir``. ``end_dir`` holds
    the event that ends a bounded source (``write_end``)."""
    stream = _read_stream(spark, source_dir, file_glob, files_per_batch).observe("drained", F.count_if(_counted()).alias("rows"))
    if end_dir is not None:
        stream = stream.unionByName(spark.readStream.schema(stream.schema).parquet(end_dir))
    alerts = spike_watch_stream(daily_demand_stream(stream, watermark), thresholds)
    return _start(alerts.writeStream.outputMode("append").format("parquet").option("path", out_dir), checkpoint, available_now)


def start_late_rows(spark: SparkSession, source_dir: str, late_dir: str, checkpoint: str, file_glob: str = "events*.parquet",
                    available_now: bool = True, watermark: str = "1 day", files_per_batch: int | None = 1000):
    """List the purchase events that E6 drops: the same files in the same
    micro-batches, held against the watermark that the batches before left.
    Their latest event time is kept in ``late_dir``, one row a batch."""
    events = purchase_events(_read_stream(spark, source_dir, file_glob, files_per_batch))

    def sink(batch: DataFrame, batch_id: int) -> None:
        marks = _read(spark, f"{late_dir}/marks", "latest timestamp, batch_id long")
        # milliseconds, as the engine keeps its watermark
        before = marks.where(F.col("batch_id") < batch_id).agg(F.date_trunc("millisecond", F.max("latest")) - F.expr(f"interval {watermark}"))
        closed = F.lit(before.first()[0]).cast("timestamp")
        late = batch.where(F.window("ts", "1 day").getField("end") <= closed)
        out = late.select("ts", "sku", "qty", closed.alias("watermark"), F.lit(batch_id).cast("long").alias("batch_id"))
        out.write.mode("overwrite").parquet(f"{late_dir}/rows/batch={batch_id}")
        (batch.agg(F.max("ts").alias("latest")).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{late_dir}/marks/batch={batch_id}"))

    return _start(events.writeStream.outputMode("append").foreachBatch(sink), checkpoint, available_now)


def read_late_rows(spark: SparkSession, late_dir: str) -> DataFrame:
    return _read(spark, f"{late_dir}/rows", LATE_SCHEMA)


def _counted() -> Column:
    """Events that daily demand counts."""
    return (F.col("event_type") == "purchase") & F.col("ts").isNotNull()


#: The events table itself, a file or a folder of part files; as a pattern that
#: nothing else matches, since a stream reads a single file by pattern only.
TABLE, TABLE_GLOB = "events.parquet", "event[s].parquet"


def drain(spark: SparkSession, sf_dir: str, start) -> None:
    """Drain the whole events table through ``start(delay)``. Files needn't
    be in event-time order; with the delay given, the table's time range, as
    the watermark's no row is late, in however many micro-batches. Fails if
    the stream counted other rows than the batch read that found the range."""
    seen = spark.read.parquet(f"{sf_dir.rstrip('/')}/{TABLE}").where(_counted()).agg(
        F.count(F.lit(1)).alias("n"),
        F.ceil((F.unix_micros(utc_instant(F.max("ts"))) - F.unix_micros(utc_instant(F.min("ts")))) / 1e6).alias("range")).first()
    q = start(f"{(seen['range'] or 0) + 1} seconds")
    q.awaitTermination()
    got = sum(p.observedMetrics["drained"]["rows"] for p in q.recentProgress if "drained" in p.observedMetrics)
    if got != seen["n"] or late_rows(q):
        raise RuntimeError(f"{sf_dir}: the stream counted {got} of {seen['n']} purchase events and dropped {late_rows(q)} as late")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder's rows; empty only if nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*[f.name for f in T._parse_datatype_string(schema).fields])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def late_rows(query) -> int:
    """Rows that a drained or running query has dropped behind its watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def _compacted(spark: SparkSession, out_dir: str) -> int | None:
    """The last batch held by the latest complete compaction."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    pattern = hadoop(f"{out_dir}/_compacted/upto=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or ()), default=None)


def _newest(spark: SparkSession, out_dir: str) -> DataFrame:
    """(window, sku, qty, events, batch_id): newest row per key of the latest
    compaction and the batches after it."""
    log, upto = _read(spark, out_dir, DAILY_SCHEMA), _compacted(spark, out_dir)
    if upto is not None:
        held = spark.read.schema(DAILY_SCHEMA).parquet(f"{out_dir}/_compacted/upto={upto}")
        log = held.unionByName(log.where(F.col("batch_id") > upto))
    latest = log.groupBy("window", "sku").agg(F.max_by(F.struct("qty", "events", "batch_id"), "batch_id").alias("v"))
    return latest.select("window", "sku", "v.qty", "v.events", "v.batch_id")


def compact_log(spark: SparkSession, out_dir: str, drop: bool = True) -> int | None:
    """Rewrite the newest row per key under ``_compacted/upto=<last batch>``;
    with ``drop`` the batches and compactions it replaces are deleted once it
    is complete. Returns the last batch it holds (None: nothing to do)."""
    before = _compacted(spark, out_dir)
    last = _read(spark, out_dir, DAILY_SCHEMA).agg(F.max("batch_id")).first()[0]
    if last is None or (before is not None and last <= before):
        return before
    _newest(spark, out_dir).where(F.col("batch_id") <= last).write.mode("overwrite").parquet(f"{out_dir}/_compacted/upto={last}")
    if drop:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(out_dir).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for pattern, newest in ((f"{out_dir}/batch=*", last), (f"{out_dir}/_compacted/upto=*", last - 1)):
            for f in fs.globStatus(hadoop(pattern)) or ():
                if int(f.getPath().getName().split("=")[1]) <= newest:
                    fs.delete(f.getPath(), True)
    return last


def current_view(spark: SparkSession, out_dir: str) -> DataFrame:
    """Newest row per (window, sku) of the upsert log."""
    return _newest(spark, out_dir).select(utc_date(F.col("window.start")).alias("date"), "sku", "qty", "events")


def drain_daily_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the stream over the events table until drained; return the view."""
    out_dir, ckpt = scratch_path(spark, "daily-demand"), scratch_path(spark, "daily-demand-ckpt")
    drain(spark, sf_dir, lambda delay: start_daily_demand(spark, sf_dir, out_dir, ckpt, file_glob=TABLE_GLOB, watermark=delay))
    return current_view(spark, out_dir)


def write_end(events: DataFrame, watermark: str, path: str) -> None:
    """The event that ends a table: a purchase so late that the watermark closes the table's last day, but not its own. It
    has a sku, as rows without one don't reach the watermark of a stream that is joined by sku."""
    end = F.max("ts") + F.expr(f"interval {watermark}") + F.expr("interval 1 day")
    last = events.where(_counted()).agg(end.alias("ts"), F.max("user_id").alias("user_id"))
    given = {"event_type": F.lit("purchase"), "ts": F.col("ts"), "user_id": F.col("user_id")}
    last.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields]).write.parquet(path)


def drain_spike_watch(spark: SparkSession, sf_dir: str, watermark: str = "1 day") -> DataFrame:
    """E7 over the whole events table: the fences come from the batch
    history, the stream is drained against them in one micro-batch (files
    needn't be in event-time order) together with the event that ends the
    table, and a second, empty one closes all of its days. Their alerts."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/{TABLE}")
    out_dir, ckpt, end_dir = (scratch_path(spark, f"spike-watch{x}") for x in ("", "-ckpt", "-end"))
    write_end(events, watermark, end_dir)
    fences = spike_thresholds(daily_demand_stream(events))
    drain(spark, sf_dir, lambda _: start_spike_watch(spark, sf_dir, out_dir, ckpt, fences, file_glob=TABLE_GLOB, watermark=watermark,
                                                     files_per_batch=None, end_dir=end_dir))
    return read_alerts(spark, out_dir)


def read_alerts(spark: SparkSession, out_dir: str) -> DataFrame:
    return _read(spark, out_dir, SPIKE_SCHEMA).select(utc_date(F.col("day")).alias("date"), "sku", "qty", "upper", "severity")


def spike_thresholds(daily: DataFrame, min_days: int = P.SPIKE_MIN_DAYS) -> DataFrame:
    """D11's fences per sku over its daily quantities (batch side of the
    stream-static join): upper = Q3 + 1.5 IQR, which grades a spike, and
    fence = max(upper, mean + 2 std), which a day has to pass."""
    q = F.percentile("qty", F.array(F.lit(0.25), F.lit(0.75)))
    st = daily.groupBy("sku").agg(F.count(F.lit(1)).alias("n"), q.alias("qs"), F.avg("qty").alias("mu"), F.stddev_samp("qty").alias("sd"))
    upper = F.col("qs")[1] + (F.col("qs")[1] - F.col("qs")[0]) * P.SPIKE_IQR_FACTOR
    return (st.where(F.col("n") >= min_days).withColumn("upper", upper)
            .select("sku", "upper", F.greatest("upper", F.col("mu") + F.col("sd") * P.SPIKE_SIGMA_FACTOR).alias("fence")))


def spike_watch_stream(daily: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stream-static join of daily demand with per-sku thresholds (sku,
    upper, fence; without a fence, upper is it); a day above its fence is an
    alert row."""
    if "fence" not in thresholds.columns:
        thresholds = thresholds.withColumn("fence", F.col("upper"))
    j = daily.join(thresholds.select("sku", "upper", "fence"), "sku")
    return j.where(F.col("qty") > F.col("fence")).select(
        F.col("window.start").alias("day"), "sku", "qty", "upper",
        F.when(F.col("qty") < F.col("upper") * P.SPIKE_HIGH_FACTOR, F.lit("Medium")).otherwise(F.lit("High")).alias("severity"))
