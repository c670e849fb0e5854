"""Structured Streaming versions of the batch rules (K1-K6).

The stateless rules (vendor mapping, cleaning, normalisation) are the very
same column functions as in batch. Stateful parts:

* K2 dedupe: ``withWatermark`` + ``dropDuplicates`` on the five keys (the
  event time is one of them, so state is evicted by the watermark), or
  ``keep_first_stream``, which holds the best row per key by the batch order
  and emits it when the watermark passes the event time: the same survivors
  as batch, in whatever order files arrive;
* K3/K4 incidents and timeline: tumbling event-time windows in append
  mode; a window is emitted once the watermark passes its end. Incident
  keys are built from (organization, device, window start), as sequence
  ids need the whole, finished set;
* K5 escalation: ``applyInPandasWithState`` with event-time timeouts at
  first alert + 60 s;
* K6 tickets: ``foreachBatch`` that anti-joins each batch's incidents with
  the tickets of the same dates and appends the new ones.

Late rows and open ends: ``split_late`` writes rows whose group the watermark
has closed to a side table instead of losing them; ``run_to_end`` closes the
input with a marker far in the future, so every group still open is emitted.

Sinks are parquet folders under the session's checkpoint directory (a
shared folder on a cluster), each run in its own sub-folder.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from alertforge import schemas as S
from alertforge.functions import alerts as AF
from alertforge.operators import incidents as INC
from alertforge.operators import silver as SIL
from alertforge.operators.ordinals import ordinals_by_range
from alertforge.session import ensure_checkpoint_dir, store
from alertforge.sources import testdata as TD

DEFAULT_DELAY = "10 minutes"


def read_table_stream(spark: SparkSession, sf_dir: str, name: str,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """One table of a folder as a file stream (schema taken from the file)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(sf_dir)


def _run_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available, return the sink as a table."""
    spark = stream.sparkSession
    out = _run_dir(spark, name)
    q = (stream.writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/checkpoint").outputMode(output_mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


# event times lie before OPEN_UNTIL; the marker that closes an input lies behind it
OPEN_UNTIL, CLOSING_TIME = dt.datetime(9000, 1, 1), dt.datetime(9999, 1, 1)


def watermarked(stream: DataFrame, time_col: str, delay: str) -> DataFrame:
    """``stream`` with a watermark that a closing marker moves too; the marker itself goes no further.

    The filter reads the event time, so it stays above the watermark.
    """
    return stream.withWatermark(time_col, delay).where(F.col(time_col) < F.lit(OPEN_UNTIL))


def run_to_end(stream: DataFrame, time_col: str, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run ``build(stream)`` over everything available and flush what is still open.

    ``build`` sets its watermark by ``watermarked``. The stream is joined by a
    control folder of its own; once all input is read, one marker in it moves
    the watermark past every event time and the same query goes on from its
    checkpoint. Rows after that are late.
    """
    spark = stream.sparkSession
    out = _run_dir(spark, name)
    control = T.StructType([T.StructField(time_col, T.TimestampType())])
    spark.createDataFrame([], control).write.parquet(f"{out}/closing")

    def run() -> DataFrame:
        markers = spark.readStream.schema(control).parquet(f"{out}/closing")
        result = build(stream.unionByName(markers, allowMissingColumns=True))
        q = (result.writeStream.format("parquet").option("path", f"{out}/data")
             .option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return result

    run()
    spark.createDataFrame([(CLOSING_TIME,)], control).coalesce(1).write.mode("append").parquet(f"{out}/closing")
    return spark.read.schema(run().schema).parquet(f"{out}/data")


def split_late(stream: DataFrame, time_col: str, closes: F.Column, delay: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows in time as a stream, late rows as a table) of a stream, over everything available.

    A row is late if the time ``closes`` at which its group ends is not after
    the watermark: the largest event time of earlier micro-batches less
    ``delay`` (what the engine compares, which then drops the row unseen). A
    row without event time belongs to no group and counts as late. Each
    micro-batch writes its own folder, so a replay replaces it.
    """
    spark = stream.sparkSession
    out = _run_dir(spark, name)
    rows, seen = f"{out}/rows", f"{out}/seen"

    def handle(batch: DataFrame, batch_id: int) -> None:
        bs = batch.sparkSession
        mark = None
        if _path_exists(bs, seen):
            mark = (bs.read.parquet(seen).where(F.col("batch") < batch_id)
                    .select((F.max("latest") - F.expr(f"interval {delay}")).alias("mark")).first()["mark"])
        late = F.col(time_col).isNull() if mark is None else F.coalesce(closes <= F.lit(mark), F.lit(True))
        mine = f"{rows}/batch={batch_id}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(mine)
        if _path_exists(bs, f"{mine}/late=true") or _path_exists(bs, f"{mine}/late=false"):
            (bs.read.parquet(mine).agg(F.max(time_col).alias("latest"))
             .write.mode("overwrite").parquet(f"{seen}/batch={batch_id}"))

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{out}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    schema = stream.schema
    if not _path_exists(spark, seen):  # nothing arrived
        spark.createDataFrame([], schema).write.parquet(f"{rows}/batch=0/late=false")
    both = spark.read.schema(T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])).parquet(rows)
    return spark.readStream.schema(schema).parquet(f"{rows}/batch=*/late=false"), both.where("late").select(*schema.names)


# --------------------------------------------------------------------------
# K1, K2
# --------------------------------------------------------------------------

def silver_stream(events: DataFrame) -> DataFrame:
    """K1: vendor feeds -> cleaned silver rows (stateless)."""
    frames = {
        "meraki": TD.bronze_meraki_view(events),
        "auvik": TD.bronze_auvik_view(events),
        "ncentral": TD.bronze_ncentral_view(events),
    }
    return SIL.union_vendors(frames, clean=True)


def dedupe_stream(silver: DataFrame, delay: str = "2 days") -> DataFrame:
    """K2: first arrival per five keys; state kept until the watermark passes."""
    return silver.withWatermark("event_time", delay).dropDuplicates(S.SILVER_DEDUPE_KEYS)


def keep_first_stream(silver: DataFrame, delay: str = "2 days") -> DataFrame:
    """K2 with the batch rule (G4): per five keys the first row by source, ingestion time and alert id.

    The event time is one of the keys, so a key is final once the watermark has
    passed it; until then the state holds its best row, whatever came first.
    """
    best = F.min_by(F.struct(*silver.columns), F.struct(SIL.source_rank(), F.col("ingestion_time"), F.col("alert_id")))
    kept = watermarked(silver, "event_time", delay).groupBy(*S.SILVER_DEDUPE_KEYS).agg(best.alias("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) for c in silver.columns])


# --------------------------------------------------------------------------
# K3, K4
# --------------------------------------------------------------------------

def incident_key(org, device, start) -> F.Column:
    return F.concat_ws("|", org, device, F.unix_micros(start).cast("string"))


def incidents_stream(alerts: DataFrame, window: str = "5 minutes", delay: str = DEFAULT_DELAY) -> DataFrame:
    """K3: incidents per (organization, device, tumbling window), append mode."""
    return incidents_of(INC.normalize_alerts(alerts), window, delay)


def incidents_of(norm: DataFrame, window: str = "5 minutes", delay: str = DEFAULT_DELAY) -> DataFrame:
    """K3 over normalised alerts."""
    g = watermarked(norm, "timestamp", delay).groupBy(F.window("timestamp", window).alias("w"), "organization", "device").agg(
        F.count("alert_id").alias("alert_count"),
        F.sum("severity_weight").alias("severity_score"),
        F.sum("is_critical").cast("long").alias("critical_alert_count"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        AF.mode_or_unknown("alert_type").alias("root_cause_candidate"),
        AF.mode_or_unknown("cause").alias("incident_cause"),
        AF.mode_or_unknown("description").alias("description"))
    return g.select(
        incident_key(F.col("organization"), F.col("device"), F.col("w.start")).alias("incident_key"),
        "organization", "device", F.col("w.start").alias("time_window"),
        "alert_count", "severity_score", "critical_alert_count", "start_time", "end_time",
        F.greatest(AF.minutes_between("start_time", "end_time"), F.lit(0.0)).alias("duration_minutes"),
        "root_cause_candidate", "incident_cause", "description",
        AF.incident_type("root_cause_candidate", "description").alias("incident_type"))


def timeline_stream(alerts: DataFrame, freq: str = "5 minutes", delay: str = DEFAULT_DELAY) -> DataFrame:
    """K4: alerts per closed time bucket."""
    return timeline_of(INC.normalize_alerts(alerts), freq, delay)


def timeline_of(norm: DataFrame, freq: str = "5 minutes", delay: str = DEFAULT_DELAY) -> DataFrame:
    """K4 over normalised alerts."""
    return (watermarked(norm, "timestamp", delay).groupBy(F.window("timestamp", freq).alias("w")).agg(F.count("alert_id").alias("alerts_count"))
            .select(F.col("w.start").alias("timestamp"), "alerts_count"))


def run_windows(alerts: DataFrame, build: Callable[[DataFrame, str, str], DataFrame], window: str = "5 minutes",
                delay: str = DEFAULT_DELAY, name: str = "windows") -> tuple[DataFrame, DataFrame]:
    """(all windows, late rows): ``build`` is ``incidents_of`` or ``timeline_of``.

    Every alert is either in a window of the result or in the late rows.
    """
    norm = INC.normalize_alerts(alerts)
    end = AF.floor_time("timestamp", INC.window_seconds(window)) + F.expr(f"interval {window}")
    in_time, late = split_late(norm, "timestamp", end, delay, f"{name}-rows")
    return run_to_end(in_time, "timestamp", lambda s: build(s, window, delay), name), late


# --------------------------------------------------------------------------
# K5 escalation
# --------------------------------------------------------------------------

ESCALATION_SCHEMA = T.StructType([
    T.StructField("incident_key", T.StringType()),
    T.StructField("opened_at", T.TimestampType()),
    T.StructField("escalated_at", T.TimestampType()),
])
_STATE_SCHEMA = "opened_us long, resolved_us long, done boolean"


def escalation_stream(alerts: DataFrame, window: str = "5 minutes", delay_seconds: int = 60,
                      watermark: str = DEFAULT_DELAY, cancel_on_resolve: bool = False) -> DataFrame:
    """K5: escalate each incident once, ``delay_seconds`` (event time) after its first alert.

    Default parity: escalate even when a resolved alert arrived meanwhile;
    ``cancel_on_resolve`` drops incidents resolved before the deadline. A
    decided incident keeps a mark until the watermark has passed its window and
    the delay, after which no alert of the window can arrive.
    """
    secs = INC.window_seconds(window)
    norm = INC.normalize_alerts(alerts).withWatermark("timestamp", watermark)
    start = AF.floor_time("timestamp", secs)
    keyed = norm.select(
        incident_key(F.col("organization"), F.col("device"), start).alias("incident_key"),
        (F.unix_micros(start) + F.lit(secs * 1_000_000)).alias("window_end_us"),
        F.unix_micros("timestamp").alias("us"), "timestamp", "status")
    delay_us = int(delay_seconds) * 1_000_000

    def step(key, pdfs, state):
        window_end_us = int(key[1])
        if state.hasTimedOut:
            opened_us, resolved_us, done = state.get
            if done:
                state.remove()
                return
            # in milliseconds, the unit of the engine's timers; after the window nothing can reopen it
            closed_ms = max(window_end_us, opened_us + delay_us) // 1000 + 1
            if closed_ms <= state.getCurrentWatermarkMs():
                state.remove()
            else:
                state.update((opened_us, resolved_us, True))
                state.setTimeoutTimestamp(closed_ms)
            if cancel_on_resolve and resolved_us >= 0 and resolved_us <= opened_us + delay_us:
                return
            yield pd.DataFrame({"incident_key": [key[0]],
                                "opened_at": [pd.Timestamp(opened_us, unit="us")],
                                "escalated_at": [pd.Timestamp(opened_us + delay_us, unit="us")]})
            return
        opened_us, resolved_us, done = state.get if state.exists else (None, -1, False)
        for pdf in pdfs:
            us = pdf["us"].to_numpy()
            first = int(us.min())
            if not done:
                opened_us = first if opened_us is None else min(opened_us, first)
            res = us[(pdf["status"].fillna("").str.lower() == "resolved").to_numpy()]
            if len(res):
                r = int(res.min())
                resolved_us = r if resolved_us < 0 else min(resolved_us, r)
        state.update((opened_us, resolved_us, done))
        due = max(window_end_us, opened_us + delay_us) // 1000 + 1 if done else (opened_us + delay_us) // 1000
        # a timer may not lie behind the watermark: an alert within the delay can open an incident already due
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return keyed.groupBy("incident_key", "window_end_us").applyInPandasWithState(
        step, ESCALATION_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


# --------------------------------------------------------------------------
# K6 tickets
# --------------------------------------------------------------------------

TICKET_COLUMNS = ["ticket_id", "incident_key", "device_name", "issue", "status"]


def _path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, by the file system that Spark itself uses for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def tickets_of_dates(spark: SparkSession, table_path: str, dates: list) -> DataFrame | None:
    """Keys of the tickets whose windows begin on ``dates``; only those folders are listed or read."""
    folders = [f"{table_path}/window_date={d.isoformat()}" for d in dates]
    folders = [f for f in folders if _path_exists(spark, f)]
    if not folders:
        return None
    return spark.read.option("basePath", table_path).parquet(*folders).select("window_date", "batch", "incident_key")


def run_ticket_sink(alerts: DataFrame, window: str = "5 minutes", min_severity: str | None = None,
                    out_dir: str | None = None) -> DataFrame:
    """K6: at most one OPEN ticket per incident, appended per micro-batch.

    The ticket table lies by window date, then batch. A micro-batch anti-joins
    with earlier batches of its own dates only, and takes its first ticket id
    from a small table of the ids used so far, so its cost follows the batch,
    not the history. Its folders are overwritten when it is replayed after a
    failure, which yields the same tickets once (exactly-once output).

    ``min_severity`` (HIGH/MEDIUM/LOW on the weight scale 3/2/1) is the gate
    that never runs in the source behaviour; off by default.
    """
    spark = alerts.sparkSession
    out = out_dir or _run_dir(spark, "tickets")
    table_path, used_path = f"{out}/tickets", f"{out}/used_ids"
    secs = INC.window_seconds(window)
    norm = INC.normalize_alerts(alerts)

    def handle(batch: DataFrame, batch_id: int) -> None:
        bs = batch.sparkSession
        b = batch
        if min_severity is not None:
            need = {"LOW": 1.0, "MEDIUM": 2.0, "HIGH": 3.0}[min_severity]
            b = b.where(F.col("severity_weight") >= need)
        start = AF.floor_time("timestamp", secs)
        inc = store(b.groupBy("organization", "device", start.alias("time_window"))
                    .agg(AF.mode_or_unknown("alert_type").alias("issue"))
                    .select(incident_key(F.col("organization"), F.col("device"), F.col("time_window")).alias("incident_key"),
                            F.to_date("time_window").alias("window_date"), F.col("device").alias("device_name"), "issue"),
                    "ticket-batch")
        dates = [r["window_date"] for r in inc.select("window_date").distinct().collect()]  # calendar days of one batch
        existing = tickets_of_dates(bs, table_path, dates)
        if existing is not None:  # a retried batch replaces its own folders
            inc = inc.join(existing.where(F.col("batch") != batch_id), ["window_date", "incident_key"], "left_anti")
        offset = 0
        if _path_exists(bs, used_path):  # one row per batch
            offset = bs.read.parquet(used_path).where(F.col("batch") != batch_id).agg(F.max("last_id")).first()[0] or 0
        numbered = ordinals_by_range(inc, ["incident_key"], "_n").withColumn("ticket_id", F.col("_n") + F.lit(offset))
        used = Observation()
        (numbered.select("ticket_id", "incident_key", "device_name", "issue", F.lit("OPEN").alias("status"),
                         "window_date", F.lit(batch_id).alias("batch"))
         .observe(used, F.coalesce(F.max("ticket_id"), F.lit(offset)).cast("long").alias("last_id"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("window_date", "batch").parquet(table_path))
        bs.createDataFrame([(used.get["last_id"],)], "last_id long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{used_path}/batch={batch_id}")

    q = (norm.writeStream.foreachBatch(handle).option("checkpointLocation", f"{out}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if _path_exists(spark, used_path):
        return spark.read.parquet(table_path).select(*TICKET_COLUMNS)
    # nothing arrived
    schema = "ticket_id long, incident_key string, device_name string, issue string, status string"
    return spark.createDataFrame([], schema)
