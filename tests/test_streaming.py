import datetime as dt
import os

from pyspark.sql import functions as F

from replenish.streaming.daily_demand import current_view, late_rows, start_daily_demand


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                       "value double, props string")


def test_stream_daily_demand_and_late_rows(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    t = dt.datetime(2024, 1, 10, 12, 0)
    b1 = [(1, t, 7, "purchase", 1.0, '{"k": 3}'), (2, t, 7, "purchase", 1.0, '{"k": 4}'),
          (3, t, 8, "view", 1.0, '{"k": 9}'), (4, t + dt.timedelta(days=3), 8, "purchase", 1.0, '{"k": 1}')]
    _events(spark, b1).coalesce(1).write.parquet(os.path.join(src, "events_1.parquet"))
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    import shutil
    flat = os.path.join(tmpdir_path, "flat")
    os.makedirs(flat)
    for i, name in enumerate(sorted(os.listdir(os.path.join(src, "events_1.parquet")))):
        if name.endswith(".parquet"):
            shutil.copy(os.path.join(src, "events_1.parquet", name), os.path.join(flat, f"events_1_{i}.parquet"))
    q = start_daily_demand(spark, flat, out, ck)
    q.awaitTermination()
    v = {(r["date"], r["sku"]): r["qty"] for r in current_view(spark, out).collect()}
    assert v == {(dt.date(2024, 1, 10), "7"): 7.0, (dt.date(2024, 1, 13), "8"): 1.0}
    # a second batch with one row far behind the watermark (dropped) and one on time
    late = [(5, t - dt.timedelta(days=5), 7, "purchase", 1.0, '{"k": 100}'),
            (6, t + dt.timedelta(days=3), 8, "purchase", 1.0, '{"k": 2}')]
    tmp = os.path.join(tmpdir_path, "b2")
    _events(spark, late).coalesce(1).write.parquet(tmp)
    part = [n for n in os.listdir(tmp) if n.endswith(".parquet")][0]
    shutil.copy(os.path.join(tmp, part), os.path.join(flat, "events_2_0.parquet"))
    q = start_daily_demand(spark, flat, out, ck)
    q.awaitTermination()
    v = {(r["date"], r["sku"]): r["qty"] for r in current_view(spark, out).collect()}
    assert v[(dt.date(2024, 1, 13), "8")] == 3.0
    assert (dt.date(2024, 1, 5), "7") not in v
    assert late_rows(q) == 1


def test_batch_form_equals_stream_form(spark):
    from replenish.streaming.daily_demand import daily_demand_stream
    t = dt.datetime(2024, 1, 10, 12, 0)
    df = _events(spark, [(1, t, 7, "purchase", 1.0, '{"k": 3}'), (2, t, 7, "purchase", 1.0, '{"k": 4}')])
    from replenish.sources.tpch import utc_date
    r = daily_demand_stream(df).select(utc_date(F.col("window.start")).alias("d"), "sku", "qty").collect()
    assert [(x["d"], x["sku"], x["qty"]) for x in r] == [(dt.date(2024, 1, 10), "7", 7.0)]


def test_day_windows_do_not_depend_on_session_time_zone(spark):
    from replenish.sources.tpch import utc_date
    from replenish.streaming.daily_demand import daily_demand_stream
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        late_evening = dt.datetime(2024, 1, 10, 23, 30)
        df = _events(spark, [(1, late_evening, 7, "purchase", 1.0, '{"k": 3}'),
                             (2, dt.datetime(2024, 1, 10, 0, 30), 7, "purchase", 1.0, '{"k": 4}')])
        r = daily_demand_stream(df).select(utc_date(F.col("window.start")).alias("d"), "qty").collect()
        assert [(x["d"], x["qty"]) for x in r] == [(dt.date(2024, 1, 10), 7.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_spike_watch_runs_as_stream_static_join(spark, tmpdir_path):
    import shutil
    from replenish.streaming.daily_demand import daily_demand_stream, spike_watch_stream
    src = os.path.join(tmpdir_path, "ev")
    t = dt.datetime(2024, 1, 10, 12, 0)
    rows = [(i, t + dt.timedelta(days=i), 7, "purchase", 1.0, '{"k": %d}' % (50 if i == 3 else 2)) for i in range(6)]
    tmp = os.path.join(tmpdir_path, "w")
    _events(spark, rows).coalesce(1).write.parquet(tmp)
    os.makedirs(src)
    part = [n for n in os.listdir(tmp) if n.endswith(".parquet")][0]
    shutil.copy(os.path.join(tmp, part), os.path.join(src, "events_0.parquet"))
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    thresholds = spark.createDataFrame([("7", 10.0)], "sku string, upper double")
    alerts = spike_watch_stream(daily_demand_stream(stream), thresholds)
    out = os.path.join(tmpdir_path, "alerts")

    def sink(df, batch_id):
        df.write.mode("append").parquet(out)

    q = (alerts.writeStream.outputMode("append").foreachBatch(sink)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out).collect()
    assert [(r["sku"], r["qty"], r["severity"]) for r in got] == [("7", 50.0, "High")]


def test_drains_read_a_folder_table(spark, tmpdir_path):
    from replenish.streaming.daily_demand import drain_daily_demand, drain_spike_watch
    t = dt.datetime(2024, 1, 10, 12, 0)
    rows = [(i, t + dt.timedelta(days=i), 7, "purchase", 1.0, '{"k": %d}' % (50 if i == 3 else 2)) for i in range(12)]
    _events(spark, rows).repartition(3).write.parquet(os.path.join(tmpdir_path, "events.parquet"))
    v = {r["date"]: r["qty"] for r in drain_daily_demand(spark, tmpdir_path).collect()}
    assert v == {t.date() + dt.timedelta(days=i): 50.0 if i == 3 else 2.0 for i in range(12)}
    assert [(r["date"], r["qty"]) for r in drain_spike_watch(spark, tmpdir_path).collect()] == [(dt.date(2024, 1, 13), 50.0)]


def test_spike_watch_alerts_the_last_days_too(spark, tmpdir_path):
    from replenish.streaming.daily_demand import drain_spike_watch
    t = dt.datetime(2024, 1, 10, 12, 0)
    quantity = {5: 40, 10: 50, 11: 60}  # 11 is the table's last day
    rows = [(i, t + dt.timedelta(days=i), 7, "purchase", 1.0, '{"k": %d}' % quantity.get(i, 2)) for i in range(12)]
    # as many days of 2 as the fence needs to stay below the spikes
    rows += [(20 + i, t - dt.timedelta(days=1 + i), 7, "purchase", 1.0, '{"k": 2}') for i in range(20)]
    rows += [(50, t + dt.timedelta(days=40), 7, "view", 1.0, '{"k": 99}'), (51, t, 7, "purchase", 1.0, None)]
    _events(spark, rows).repartition(3).write.parquet(os.path.join(tmpdir_path, "events.parquet"))
    got = sorted((r["date"], r["qty"]) for r in drain_spike_watch(spark, tmpdir_path).collect())
    assert got == [(t.date() + dt.timedelta(days=i), float(q)) for i, q in quantity.items()]


def test_drain_keeps_old_days_behind_newer_files(spark, tmpdir_path, monkeypatch):
    import shutil
    from replenish.streaming.daily_demand import drain_daily_demand
    # a stream of one file a batch by default; rows are late from its third batch on
    monkeypatch.setattr(start_daily_demand, "__defaults__", tuple(1 if x == 1000 else x for x in start_daily_demand.__defaults__))
    t, src = dt.datetime(2024, 1, 30, 12, 0), os.path.join(tmpdir_path, "src")
    os.makedirs(os.path.join(src, "events.parquet"))
    for name, day in (("new", t), ("old", t - dt.timedelta(days=20))):
        tmp = os.path.join(tmpdir_path, name)
        _events(spark, [(1, day, 7, "purchase", 1.0, '{"k": 3}')]).coalesce(1).write.parquet(tmp)
        part = [n for n in os.listdir(tmp) if n.endswith(".parquet")][0]
        for i in range(3 if name == "new" else 1):
            to = shutil.copy(os.path.join(tmp, part), os.path.join(src, "events.parquet", f"{name}_{i}.parquet"))
            os.utime(to, (1.7e9, 1.7e9 + (10 if name == "old" else i)))
    v = {r["date"]: r["events"] for r in drain_daily_demand(spark, src).collect()}
    assert v == {dt.date(2024, 1, 30): 3, dt.date(2024, 1, 10): 1}


def _parts(spark, folder, batches):
    """One file per list of (day offset, sku, quantity), in order of their times."""
    import shutil
    import tempfile
    os.makedirs(folder, exist_ok=True)
    have = len(os.listdir(folder))
    for i, rows in enumerate(batches):
        tmp = os.path.join(tempfile.mkdtemp(), "w")
        t = dt.datetime(2024, 1, 10, 12, 0)
        _events(spark, [(k, t + dt.timedelta(days=d), sku, "purchase", 1.0, '{"k": %s}' % q) for k, (d, sku, q) in enumerate(rows)]).coalesce(1).write.parquet(tmp)
        part = [n for n in os.listdir(tmp) if n.endswith(".parquet")][0]
        to = shutil.copy(os.path.join(tmp, part), os.path.join(folder, f"events_{have + i:03}.parquet"))
        os.utime(to, (1.7e9, 1.7e9 + have + i))


def test_the_table_alone_is_drained(spark, tmpdir_path):
    from replenish.streaming.daily_demand import drain_daily_demand
    for name, k in (("events.parquet", 3), ("events_old.parquet", 99)):
        _events(spark, [(1, dt.datetime(2024, 1, 10), 7, "purchase", 1.0, '{"k": %d}' % k)]).write.parquet(os.path.join(tmpdir_path, name))
    assert [r["qty"] for r in drain_daily_demand(spark, tmpdir_path).collect()] == [3.0]


def test_one_alert_per_closed_day_over_a_restart(spark, tmpdir_path):
    from replenish.streaming.daily_demand import read_alerts, start_spike_watch
    src, out, ck = (os.path.join(tmpdir_path, n) for n in ("src", "out", "ck"))
    fences = spark.createDataFrame([("7", 10.0, 20.0), ("8", 5.0, 5.0)], "sku string, upper double, fence double")

    def run():
        start_spike_watch(spark, src, out, ck, fences, files_per_batch=1).awaitTermination()
        return sorted((r["date"].day, r["sku"], r["qty"], r["severity"]) for r in read_alerts(spark, out).collect())

    # day 10 passes its fence with the second file only; 15 isn't above the fence of 20; day 13 is still open
    _parts(spark, src, [[(0, 7, 15), (0, 8, 4)], [(0, 7, 10), (1, 7, 15), (0, 8, 3)], [(3, 7, 90)]])
    first = run()
    assert first == [(10, "7", 25.0, "High"), (10, "8", 7.0, "Medium")]
    assert run() == first  # a restart without news
    _parts(spark, src, [[(3, 7, 5), (4, 8, 6)], [(0, 8, 100)], [(7, 7, 1)]])
    assert run() == sorted(first + [(13, "7", 95.0, "High"), (14, "8", 6.0, "Medium")])


def test_compaction_keeps_the_view_and_later_batches_win(spark, tmpdir_path):
    from replenish.streaming.daily_demand import compact_log
    src, out, ck = (os.path.join(tmpdir_path, n) for n in ("src", "out", "ck"))
    view = lambda: sorted((r["date"], r["sku"], r["qty"], r["events"]) for r in current_view(spark, out).collect())
    assert compact_log(spark, out) is None
    _parts(spark, src, [[(0, 7, 1), (0, 8, 2)], [(0, 7, 3)], [(1, 8, 4)]])
    start_daily_demand(spark, src, out, ck, files_per_batch=1).awaitTermination()
    before = view()
    assert [x[2] for x in before] == [4.0, 2.0, 4.0]
    last = compact_log(spark, out)
    assert view() == before and all(int(n[6:]) > last for n in os.listdir(out) if n.startswith("batch="))
    assert compact_log(spark, out) == last  # nothing new
    os.makedirs(os.path.join(out, "_compacted", f"upto={last + 50}"))  # one that a failed writer left
    assert view() == before
    _parts(spark, src, [[(1, 8, 10)], [(2, 7, 1)]])
    start_daily_demand(spark, src, out, ck, files_per_batch=1).awaitTermination()
    after = view()
    assert [x[2] for x in after] == [4.0, 2.0, 14.0, 1.0]
    assert compact_log(spark, out) > last and view() == after
    assert len([n for n in os.listdir(os.path.join(out, "_compacted")) if "_SUCCESS" in os.listdir(os.path.join(out, "_compacted", n))]) == 1


def test_late_rows_are_listed(spark, tmpdir_path):
    from replenish.streaming.daily_demand import read_late_rows, start_late_rows
    src, out, ck, late, lck = (os.path.join(tmpdir_path, n) for n in ("src", "out", "ck", "late", "lck"))
    assert read_late_rows(spark, late).collect() == []
    # the second file's old rows are on time only where their day ends after 13 Jan 12:00 less a day
    _parts(spark, src, [[(0, 7, 1), (3, 7, 2)], [(0, 7, 50), (1, 8, 60), (2, 9, 70), (5, 7, 3)], [(2, 7, 80), (5, 8, 1)]])
    q = start_daily_demand(spark, src, out, ck, files_per_batch=1)
    q.awaitTermination()
    start_late_rows(spark, src, late, lck, files_per_batch=1).awaitTermination()
    got = sorted((r.qty, r.sku, r.batch_id) for r in read_late_rows(spark, late).collect())
    assert got == [(50.0, "7", 1), (60.0, "8", 1), (80.0, "7", 2)]
    assert sum(x["qty"] for x in current_view(spark, out).collect()) + sum(x[0] for x in got) == 267.0
    # a restart lists what comes, and nothing twice
    _parts(spark, src, [[(0, 9, 90)]])
    start_late_rows(spark, src, late, lck, files_per_batch=1).awaitTermination()
    assert sorted(r.qty for r in read_late_rows(spark, late).collect()) == [50.0, 60.0, 80.0, 90.0]
