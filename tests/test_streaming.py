"""Streaming jobs: batch equality is covered by the oracle; timers and replay here."""
import datetime as dt
import os

import pandas as pd
import pytest

from alertforge.streaming import jobs as STREAM


def alert_rows(times_status):
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = []
    for i, (dev, sec, status) in enumerate(times_status):
        rows.append({"alert_id": str(i), "source": "s", "timestamp": base + dt.timedelta(seconds=sec),
                     "organization": "o", "device": dev, "entity_type": "e", "alert_type": "t",
                     "severity": "low", "status": status, "description": "x", "cause": "c"})
    return pd.DataFrame(rows)


def test_escalation_timer(spark, tmp_dir):
    # dev-a opens at 0 s and is resolved at 30 s; dev-b opens at 100 s; a late row moves the watermark
    pdf = alert_rows([("a", 0, "open"), ("a", 30, "resolved"), ("b", 100, "open"), ("z", 3000, "open")])
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    pdf.to_parquet(os.path.join(src, "alerts.parquet"), coerce_timestamps="us")
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    out = STREAM.run_available(STREAM.escalation_stream(stream, watermark="1 second"), "esc")
    keys = sorted(r["incident_key"].split("|")[1] for r in out.collect())
    assert keys == ["a", "b"]  # parity: escalated even though resolved
    stream = spark.readStream.schema(schema).parquet(src)
    out2 = STREAM.run_available(STREAM.escalation_stream(stream, watermark="1 second", cancel_on_resolve=True), "esc2")
    assert sorted(r["incident_key"].split("|")[1] for r in out2.collect()) == ["b"]


def test_tickets_once_per_incident(spark, tmp_dir):
    pdf = alert_rows([("a", 0, "open"), ("a", 10, "open"), ("b", 20, "open")])
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    pdf.to_parquet(os.path.join(src, "alerts.parquet"), coerce_timestamps="us")
    schema = spark.read.parquet(src).schema
    t = STREAM.run_ticket_sink(spark.readStream.schema(schema).parquet(src))
    got = sorted((r["ticket_id"], r["device_name"]) for r in t.collect())
    assert got == [(1, "a"), (2, "b")]


def test_ticket_replay_adds_none(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    alert_rows([("a", 0, "open"), ("b", 20, "open")]).to_parquet(os.path.join(src, "p1.parquet"),
                                                              coerce_timestamps="us")
    schema = spark.read.parquet(src).schema
    out = os.path.join(tmp_dir, "sink")
    first = STREAM.run_ticket_sink(spark.readStream.schema(schema).parquet(src), out_dir=out).count()
    again = STREAM.run_ticket_sink(spark.readStream.schema(schema).parquet(src), out_dir=out).count()
    # a new file repeating incident "a" and opening "c"
    alert_rows([("a", 30, "open"), ("c", 40, "open")]).to_parquet(os.path.join(src, "p2.parquet"),
                                                               coerce_timestamps="us")
    t = STREAM.run_ticket_sink(spark.readStream.schema(schema).parquet(src), out_dir=out)
    got = sorted((r["ticket_id"], r["device_name"]) for r in t.collect())
    assert (first, again) == (2, 2)
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_escalates_once_over_out_of_order_files(spark, tmp_dir):
    # one row per file: "a" is escalated, then more alerts of its window arrive inside the watermark
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    rows = alert_rows([("a", 0, "open"), ("z", 90, "open"), ("z", 95, "open"), ("a", 200, "open"), ("a", 150, "open"),
                       ("z", 290, "open"), ("z", 3000, "open"), ("z", 3001, "open")])
    rows["timestamp"] += pd.Timedelta(microseconds=123)
    for i in range(len(rows)):
        path = os.path.join(src, f"p{i}.parquet")
        rows.iloc[i:i + 1].to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = STREAM.run_available(STREAM.escalation_stream(stream, watermark="20 seconds"), "esc-once").collect()
    of_a = [r for r in got if r["incident_key"].split("|")[1] == "a"]
    assert len(of_a) == 1
    assert of_a[0]["opened_at"].microsecond == 123  # event time is kept whole


def test_ticket_table_errors_surface(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    os.makedirs(src)
    alert_rows([("a", 0, "open")]).to_parquet(os.path.join(src, "p1.parquet"), coerce_timestamps="us")
    schema = spark.read.parquet(src).schema
    os.makedirs(os.path.join(out, "tickets", "batch=0"))
    with open(os.path.join(out, "tickets", "batch=0", "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        STREAM.run_ticket_sink(spark.readStream.schema(schema).parquet(src), out_dir=out)


def one_file_per_row(spark, pdf, folder):
    """Files that a stream reads one by one, in row order."""
    os.makedirs(folder)
    for i in range(len(pdf)):
        path = os.path.join(folder, f"p{i:03d}.parquet")
        pdf.iloc[i:i + 1].to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_rows_are_kept_aside_and_open_windows_flushed(spark, tmp_dir):
    # out of order within the delay: kept; 0 s after the watermark passed 300 s: late; the last windows stay open
    seconds = [0, 400, 100, 1200, 310, 0, 5, 2000, 1300, 2010]
    pdf = alert_rows([("a", s, "open") for s in seconds])
    stream = one_file_per_row(spark, pdf, os.path.join(tmp_dir, "in"))
    found, late = STREAM.run_windows(stream, STREAM.incidents_of, name="late-test")
    got = {r["time_window"].minute: r["alert_count"] for r in found.collect()}
    late_ids = sorted(int(r["alert_id"]) for r in late.collect())
    # by hand: after 1,200 s the watermark is 600 s, after 2,000 s it is 1,400 s
    assert late_ids == [4, 5, 6]
    assert got == {0: 2, 5: 1, 20: 2, 30: 2} and sum(got.values()) + len(late_ids) == len(pdf)
    again, none = STREAM.run_windows(stream, STREAM.timeline_of, delay="1 hour", name="late-none")
    assert none.count() == 0 and {r["timestamp"].minute: r["alerts_count"] for r in again.collect()} == {0: 4, 5: 2, 20: 2, 30: 2}


def test_nothing_arrives(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    alert_rows([("a", 0, "open")]).iloc[:0].astype({"timestamp": "datetime64[us]"}).to_parquet(os.path.join(src, "p.parquet"))
    schema = spark.createDataFrame(alert_rows([("a", 0, "open")])).schema
    found, late = STREAM.run_windows(spark.readStream.schema(schema).parquet(src), STREAM.incidents_of, name="empty")
    assert found.count() == 0 and late.count() == 0


def test_stream_keeps_the_batch_survivor_whatever_the_order(spark, tmp_dir):
    from pyspark.sql import functions as F

    from alertforge import schemas as S
    from alertforge.operators import silver as SIL
    base = dt.datetime(2024, 1, 1)
    names = ["source_system", "alert_id", "ingestion_time", "event_time", *[k for k in S.SILVER_DEDUPE_KEYS if k != "event_time"]]

    def row(source, alert, ingested, event, key):
        return (source, alert, base + dt.timedelta(seconds=ingested), base + dt.timedelta(hours=event),
                *[key if k == "device_name" else None if k == "correlation_id" else "x" for k in names[4:]])

    sources = SIL.SOURCE_ORDER
    data = [row(sources[2], "1", 0, 0, "d"), row(sources[0], "9", 50, 0, "d"), row(sources[0], "8", 50, 0, "d"),
            row(sources[1], "2", 1, 30, "e"), row(sources[1], "0", 1, 30, "e"), row(sources[0], "7", 90, 0, "d"),
            row(sources[2], "3", 5, 47, "f"), row(sources[2], "5", 2, 30, "e"), row(sources[2], "4", 4, 47, "f")]
    pdf = pd.DataFrame(data, columns=names)
    stream = one_file_per_row(spark, pdf, os.path.join(tmp_dir, "in"))
    table = spark.read.schema(stream.schema).parquet(os.path.join(tmp_dir, "in"))
    got = STREAM.run_to_end(stream, "event_time", STREAM.keep_first_stream, "keep-first-test")
    want = SIL.keep_first(table, S.SILVER_DEDUPE_KEYS, [SIL.source_rank(), F.col("ingestion_time"), F.col("alert_id")])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(r["alert_id"] for r in got.collect()) == ["0", "4", "8"]


def test_ticket_batch_reads_only_its_dates(spark, tmp_dir):
    day = 86400
    rows = alert_rows([("a", 0, "open"), ("b", 3 * day, "open"), ("a", 30, "open"), ("c", 3 * day + 9, "open"), ("d", 9 * day, "open")])
    out = os.path.join(tmp_dir, "sink")
    got = STREAM.run_ticket_sink(one_file_per_row(spark, rows, os.path.join(tmp_dir, "in")), out_dir=out).collect()
    assert sorted((r["ticket_id"], r["device_name"]) for r in got) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    found = STREAM.tickets_of_dates(spark, f"{out}/tickets", [dt.date(2024, 1, 4), dt.date(2030, 1, 1)])
    files = found.inputFiles()
    assert len(files) == 2 and all("window_date=2024-01-04" in f for f in files)
    assert sorted(r["incident_key"].split("|")[1] for r in found.collect()) == ["b", "c"]
    assert STREAM.tickets_of_dates(spark, f"{out}/tickets", [dt.date(2030, 1, 1)]) is None
