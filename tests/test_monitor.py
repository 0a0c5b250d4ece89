"""Quality, features, episodes, evaluation, serving, sinks and the stream."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import Monitor, Scorer, Sketch, dsn
from tidewatch.operators import alerts, diagnose, episodes, evaluate, features, quality
from tidewatch.plans import dashboards, memory, series, serving, tuning
from tidewatch.sources import readings as src
from tidewatch.sources import sinks
from tidewatch.streaming import monitor

T0 = datetime(2020, 1, 1)
NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([("a", i + 1, *r) for i, r in enumerate(rows)], "asset_id string, seq long, ts timestamp_ntz, v double, w double")


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_quality(spark):
    rows = [(at(0), 1.0, 1.0), (at(10), NAN, 1.0), (at(10), 1.0, None), (at(5), 1.0, 1.0), (None, 20.0, 1.0), (at(35), 1.0, 1.0), (at(66), 12.0, float("inf"))]
    got = quality.check(frame(spark, rows), ["v", "w"], {"v": (-1.0, 12.0), "w": (0.0, 9.0)}).orderBy("seq").collect()
    assert [r.missing_fields for r in got] == [[], ["v"], ["w"], [], [], [], []]
    assert [r.out_of_range for r in got] == [[], [], [], [], ["v"], [], ["w"]]
    assert [r.duplicate for r in got] == [False, False, True, False, False, False, False]
    assert [r.regression for r in got] == [False, False, False, True, False, False, False]
    assert [r.gap_seconds for r in got] == [0, 0, 0, 0, 0, 0, 31]  # exactly 30 s is no gap
    assert [r.usable for r in got] == [True, False, False, True, True, True, True]
    assert [r.clean for r in got] == [True, False, False, False, False, True, False]
    out = quality.outcomes(quality.check(frame(spark, rows), ["v", "w"], {}), 2).orderBy("seq").collect()
    assert [r.outcome for r in out] == ["warmup", "dropped", "dropped", "accepted", "accepted", "accepted", "accepted"]
    assert [r.clock for r in out] == [None, None, None, 1, 2, 3, 4]


def test_json(spark):
    lines = ['{"v": 1.5, "timestamp": "2020-01-01T00:00:10"}', '{"v": "2.5"}', '{"v": " 2.5 "}', '{"v": true}', '{"v": "nan"}', '{"v": null}', "{}", "[1]", '"x"', "3", "{", "", None, '{"v": 1, "timestamp": "soon", "_injected": true}']
    got = src.decode_json(spark.createDataFrame([(x,) for x in lines], "value string"), ["v"]).collect()
    assert [r.decoded for r in got] == [True] * 7 + [False] * 6 + [True]
    values = [r.vector[0] for r in got]
    assert values[:3] == [1.5, 2.5, 2.5] and all(v != v for v in values[4:7]) and values[13] == 1.0
    assert got[0].ts == at(10) and got[13].ts is None and got[13].injected and not got[0].injected


def test_features(spark):
    rng = np.random.default_rng(0)
    rows = [(at(10 * i), float(v), 7.0) for i, v in enumerate(rng.normal(10, 2, 60))]
    df = quality.outcomes(quality.check(frame(spark, rows), ["v", "w"], {}), 50)
    stats = {r.channel: r for r in features.warmup_stats(df, ["v", "w"], 50).collect()}
    first = np.array([r[1] for r in rows[:50]])
    assert stats["v"].mean == pytest.approx(first.mean()) and stats["v"].scale == pytest.approx(first.std()) and stats["w"].scale == 1.0
    z = features.standardize(df, features.warmup_stats(df, ["v", "w"], 50), ["v", "w"]).orderBy("seq").collect()
    assert z[5].z_v == pytest.approx((rows[5][1] - first.mean()) / first.std()) and z[5].z_w == 0
    assert features.warmup_stats(df, ["v"], 61).count() == 0
    none = features.inject(frame(spark, rows), ["v"], 0)
    assert none.filter("injected").count() == 0
    hit = features.inject(frame(spark, rows), ["v"], 3, 2, 10.0).filter("injected").collect()
    assert [r.seq for r in hit] == [3, 4] and hit[0].v == pytest.approx(rows[2][1] * 10)
    duty = features.duty_cycles(frame(spark, [(at(i), float(i % 3 == 0), 0.0) for i in range(10)]), ["v"], 4).orderBy("seq").collect()
    assert [r.duty_v for r in duty] == pytest.approx([np.mean([j % 3 == 0 for j in range(max(0, i - 3), i + 1)]) for i in range(10)])
    finite = spark.createDataFrame([([1.0, NAN],), ([1.0, float("inf")],), ([1.0, 2.0],)], "x array<double>")
    assert [r.f for r in finite.select(features.is_finite("x").alias("f")).collect()] == [False, False, True]


def timeline(spark, spikes, threshold=1.0, days=20):
    rows = [("a", i, T0 + timedelta(minutes=30 * i), 2.0 if i in spikes else 0.0, threshold) for i in range(48 * days)]
    return spark.createDataFrame(rows, "asset_id string, seq long, ts timestamp_ntz, score double, threshold double")


FAILURE = (("f", "2020-01-10 00:00:00", "2020-01-10 12:00:00"),)


def test_episodes_and_evaluation(spark):
    f = src.failures(spark, FAILURE)
    start = 9 * 48  # index of the failure's start
    base = timeline(spark, {10, 11, 12, 14, 15, 18, start - 20, start - 18, start + 50})
    eps = episodes.episodes(base, 3600.0).orderBy("episode").collect()
    assert [(r.n, r.started_at) for r in eps] == [(5, T0 + timedelta(hours=5)), (1, T0 + timedelta(hours=9)), (2, T0 + timedelta(minutes=30 * (start - 20))), (1, T0 + timedelta(minutes=30 * (start + 50)))]
    m = episodes.matched(episodes.episodes(base, 3600.0), episodes.windows(f, 24.0)).orderBy("episode").collect()
    assert [r.matched_failure for r in m] == [None, None, "f", None] and m[2].lead_hours == 10.0
    r = evaluate.evaluate(base, f).first()
    assert (r.events, r.detected, r.false_alarms, r.chance_alarms) == (1, 1, 3, 4) and r.mean_lead_hours == 10.0
    span = (48 * 20 - 1) / 48
    assert r.normal_days == pytest.approx(span - 1.5) and r.false_alarms_per_day == pytest.approx(3 / (span - 1.5))
    assert "1/1 failures, 3 false alarms" in evaluate.format_result(evaluate.evaluate(base, f)).first().text
    silent = evaluate.evaluate(timeline(spark, {}), f).first()
    assert (silent.events, silent.detected, silent.false_alarms, silent.mean_lead_hours) == (1, 0, 0, None)
    out = evaluate.evaluate(base, src.failures(spark, src.DOCUMENTED)).first()
    assert (out.events, out.detected, out.false_alarms) == (0, 0, 4)
    # an episode that begins before the horizon and runs into it is a false alarm
    early = evaluate.evaluate(timeline(spark, set(range(start - 60, start))), f).first()
    assert (early.detected, early.false_alarms) == (0, 1)
    # a score of exactly the threshold does not alert
    assert evaluate.evaluate(timeline(spark, {5}, 2.0), f).first().alerting_fraction == 0
    overlap = src.failures(spark, (*FAILURE, ("g", "2020-01-10 06:00:00", "2020-01-10 18:00:00")))
    days = [episodes.normal_days(episodes.spans(base), episodes.windows(overlap, 24.0), merge=m).first().normal_days for m in (False, True)]
    assert days == pytest.approx([span - 3.0, span - 1.75])
    labels = episodes.labelled(base, episodes.windows(overlap, 24.0)).filter("in_window").groupBy("window_index").count().collect()
    assert {r["window_index"]: r["count"] for r in labels} == {0: 12, 1: 73}
    assert episodes.first_failure(base, overlap).filter("failure is not null").groupBy("failure").count().orderBy("failure").collect()[0]["count"] == 25


def test_chance():
    assert evaluate.p_value(np.zeros(0), 1) == 1.0 and evaluate.p_value(np.array([0, 1, 2, 3]), 2) == 0.5
    bounds = np.array([[0, 10], [20, 25], [50, 70], [80, 81]], float)
    counts = evaluate.simulated_chance(bounds, 100.0, 7, trials=20_000)
    exact = evaluate.exact_chance([0.1, 0.05, 0.2, 0.01], 7)
    assert exact.sum() == pytest.approx(1) and np.bincount(counts, minlength=5) / 20_000 == pytest.approx(exact, abs=0.012)
    assert len(evaluate.simulated_chance(bounds, 100.0, 0)) == 0


def test_diagnosis(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(48 * 20):
        shift = 3.0 if 8 * 48 <= i < 9 * 48 else 0.0
        rows.append((T0 + timedelta(minutes=30 * i), float(rng.normal() + shift), 5.0))
    df, f = frame(spark, rows), src.failures(spark, FAILURE)
    e = {r.channel: r.effect for r in diagnose.effects(df, f, ["v", "w"]).collect()}
    assert e["v"] == pytest.approx(3.0, abs=0.5) and e["w"] == 0.0
    assert [r.channel for r in diagnose.strongest(diagnose.effects(df, f, ["v", "w"]), 1).collect()] == ["v"]


def test_alert_rules(spark):
    rule = alerts.Rule(30, 120)
    seen = [rule.step(10 * i, a) for i, a in enumerate([0, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1, *[0] * 13])]
    assert seen[:8] == ["inactive", "pending", "pending", "inactive", "pending", "pending", "pending", "firing"]
    assert seen[8:22] == ["firing"] * 14 and seen[22:] == ["inactive"] * 2
    rows = [("a", i, at(60 * i), float(s)) for i, s in enumerate([0, 2, 2, 2, 0, 5, 5, 0])]
    df = spark.createDataFrame(rows, "asset_id string, seq long, ts timestamp_ntz, score double")
    low, high = alerts.runs(df, 1.0, 60.0), alerts.runs(df, 4.0, 0.0)
    assert sorted((r.started_at, r.n) for r in low.collect()) == [(at(60), 3), (at(300), 2)]
    assert [r.started_at for r in alerts.inhibited(low, high).collect()] == [at(60)]
    assert alerts.stalled(df, 61.0).count() == 0 and alerts.stalled(df, 60.0).count() == 7


def anomalies(spark, rows):
    names = "anomaly_id long, started_at timestamp_ntz, ended_at timestamp_ntz, peak_score double, threshold double, matched_failure string, lead_hours double, asset_id string, method string"
    return spark.createDataFrame(rows, names)


def test_serving(spark):
    assets = spark.createDataFrame([("x", "a unit", 7, 0.1), ("idle", "never alarmed", 7, 0.1)], sinks.TABLES["assets"])
    day = timedelta(days=1)
    end = datetime(2020, 4, 20, 8)
    rows = [
        (1, end - 9 * day, end - 9 * day, 2.5, 1.25, None, None, "x", "m"),
        (2, end - 2 * day, end - 2 * day, 4.2, 0.0, "failure-1", 10.06, "x", "m"),
        (3, end - timedelta(hours=3), end, 1.9, 1.0, "failure-1", 0.2, "x", "m"),
    ]
    df = anomalies(spark, rows)
    h = serving.get_asset_health(assets, df, "x").first()
    assert (h.status, h.anomalies_24h, h.anomalies_7d, h.anomalies_total, h.anomalies_matched, h.window_end, h.error) == ("warning", 1, 2, 3, 2, end, None)
    idle = serving.get_asset_health(assets, df, "idle").first()
    assert (idle.status, idle.window_end, idle.anomalies_total) == ("healthy", datetime(1970, 1, 1), 0)
    assert serving.get_asset_health(assets, df, "who").first().error == "unknown asset 'who'"
    assert [r.anomaly_id for r in serving.recent(df, "x", 2).collect()] == [3, 2]
    assert [r.anomaly_id for r in serving.recent(df, "x", 9, hours=24).collect()] == [3]
    assert [r.anomaly_id for r in serving.recent(df, "x", 9, only_confirmed=True).collect()] == [3, 2]
    texts = [serving.explain_alert(df, i).first() for i in (1, 2, 3)]
    assert "false alarm" in texts[0].verdict and "2.0x" in texts[0].why_it_fired
    assert texts[1].verdict.endswith("firing 10.1h before that failure's recorded start.") and "0.0x" in texts[1].why_it_fired
    assert texts[2].verdict.endswith("essentially at the failure's recorded start.") and texts[2].duration_hours == 3.0
    assert serving.explain_alert(df, 9).count() == 0
    assert serving.integrity(df, assets.filter("asset_id = 'idle'")).count() == 3


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    sinks.bootstrap(spark, root)
    sinks.bootstrap(spark, root)
    one = anomalies(spark, [(1, T0, T0, 1.0, 1.0, None, None, "x", "m"), (2, T0, T0, 1.0, 1.0, None, None, "x", "n"), (3, T0, T0, 1.0, 1.0, None, None, "y", "m")])
    for _ in range(2):
        sinks.replace_partitions(one, root, "anomalies")
    sinks.replace_partitions(one.filter("anomaly_id = 1").withColumn("anomaly_id", F.lit(9).cast("long")), root, "anomalies")
    assert sorted(r.anomaly_id for r in sinks.read_table(spark, root, "anomalies").collect()) == [2, 3, 9]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    path = f"{root}/x.csv"
    with open(path, "w") as f:
        f.write("junk,timestamp,TP2,COMP\n1,2020-01-01 00:00:10,1.5,1\n2,never,bad,300\n")
    got = src.scan_csv(spark, path).collect()
    assert (got[0].timestamp, got[0].TP2, got[0].COMP, got[0].H1) == (at(10), 1.5, 1, None) and (got[1].timestamp, got[1].TP2, got[1].COMP) == (None, None, None)
    wire = sinks.wire_records(spark.createDataFrame([(at(10), 1.0)], "ts timestamp_ntz, v double"), ["v"]).first().value
    assert json.loads(wire) == {"v": 1.0, "timestamp": "2020-01-01T00:00:10"}


def test_settings(monkeypatch):
    monkeypatch.delenv("TIDEWATCH_DSN", raising=False)
    with pytest.raises(RuntimeError):
        dsn()
    with pytest.raises(ValueError):
        Monitor(warmup=0)
    with pytest.raises(ValueError):
        src.feature_columns("none")
    assert len(src.feature_columns("analog+duty")) == 15


def test_dashboards(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 20.0)], "asset_id string, v double")
    b = dashboards.histogram(df, "v", (2.0, 10.0))
    assert [r.n for r in b.orderBy("le").collect()] == [2, 3, 4]
    assert dashboards.quantile(b, 0.5).first().value == pytest.approx(2.0) and dashboards.quantile(b, 0.99).first().value == 10.0
    m = memory.sweep(spark.createDataFrame([("a", 1000)], "asset_id string, cells long"), 400, (100, 400), 3600, 7).orderBy("rows").collect()
    assert [r.cells for r in m] == [250, 1000] and m[1].crossover_dim == pytest.approx(1000 * memory.PACKED_CELL / 28800)


def test_tuning(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, float(np.exp(rng.normal(4.4, 0.3)) if i < 900 else np.exp(rng.normal(2.2, 0.3))), i >= 900) for i in range(1000)]
    tried = tuning.separation(spark.createDataFrame(rows, "asset_id string, clock long, density double, injected boolean"), (10, 80))
    assert tried.count() == 4 and tuning.best(tried).first().separation > 2


SETTINGS = Monitor(sketch=Sketch(rows=5, k=2, window=20, kernel="angular"), scorer=Scorer(history=50, min_history=10, smoothing=2), warmup=15, query_every=2)


def records(spark, n=120):
    rng = np.random.default_rng(4)
    rows = []
    for a in ("a", "b"):
        for i in range(n):
            v = None if i % 17 == 5 else float(rng.normal()) if i < 100 else 9.0
            rows.append((a, i + 1, None if i % 23 == 7 else at(10 * i if i % 19 else 10 * i - 40), v, float("inf") if i == 60 else float(rng.normal())))
    return spark.createDataFrame(rows, "asset_id string, seq long, ts timestamp_ntz, v double, w double")


@pytest.mark.parametrize("engine", ["exact", "eh"])
def test_stream_equals_batch(spark, tmp_path, engine):
    from dataclasses import replace

    settings = replace(SETTINGS, sketch=replace(SETTINGS.sketch, engine=engine))
    df, limits = records(spark), {"v": (-3.0, 3.0)}
    want = sorted(map(tuple, monitor.batch(df, ["v", "w"], limits, settings).collect()), key=str)
    for cuts in ((0, 40, 121), (0, 7, 61, 62, 121)):
        where = tmp_path / f"in-{engine}-{len(cuts)}"
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            df.filter((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1).write.mode("append").parquet(f"{where}/{i}")
        import shutil
        import time

        flat = where / "flat"
        flat.mkdir()
        for i in range(len(cuts) - 1):
            part = next((where / str(i)).glob("*.parquet"))
            shutil.copy(part, flat / f"{i}.parquet")
            time.sleep(0.05)
        stream = src.replay_stream(spark, str(flat), df.schema)
        name = f"out_{engine}_{len(cuts)}"
        q = monitor.stream(stream, ["v", "w"], limits, settings).writeStream.format("memory").queryName(name).option("checkpointLocation", str(where / "ck")).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect()), key=str) == want
    out = monitor.batch(df, ["v", "w"], limits, settings)
    kinds = {(r.asset_id, r.label): r.value for r in monitor.metrics(out).collect()}
    assert sum(v for (a, k), v in kinds.items() if a == "a" and k in ("dropped", "warmup", "accepted")) == 120
    first = out.filter("clock = 1").collect()
    assert len(first) == 2 and all(r.outcome == "accepted" for r in first)


def test_series_equals_the_monitor(spark):
    df = records(spark)
    want = {(r.asset_id, r.clock): (r.density, r.score) for r in monitor.batch(df, ["v", "w"], {}, SETTINGS).filter("score is not null").collect()}
    got = series.build(df, ["v", "w"], SETTINGS, "sketch").collect()
    assert len(want) > 40 and {(r.asset_id, r.clock): (r.density, r.score) for r in got} == want
    for method in ("exact", "unwindowed"):
        assert series.build(df, ["v", "w"], SETTINGS, method).count() == len(want)
    with pytest.raises(ValueError):
        series.build(df, ["v", "w"], SETTINGS, "other")
    assert "param_window" in series.run_log(series.build(df, ["v", "w"], SETTINGS), SETTINGS).columns


def test_states_are_those_of_the_rule(spark):
    rng = np.random.default_rng(5)
    rows, at = [], 0.0
    for i in range(400):
        at += float(rng.choice([0, 5, 10, 40, 150]))
        rows.append(("a", i, at, float(rng.choice([0.5, 1.5, 2.5], p=[0.5, 0.3, 0.2]))))
    df = spark.createDataFrame(rows, "asset_id string, seq long, s double, score double").selectExpr("asset_id", "seq", "timestamp_micros(bigint(s * 1e6))::timestamp_ntz as ts", "score")
    got: dict = {}
    for r in alerts.states(df).collect():
        got.setdefault(r.severity, []).append((r.ts, r.state))
    for severity, limit in alerts.LIMITS.items():
        rule = alerts.Rule()
        want = [rule.step(t, score > limit) for _, _, t, score in rows]
        # samples of one time are compared as a set: their order in the result is free
        stamps = [t for t, _ in sorted(got[severity], key=lambda x: x[0])]
        assert sorted(zip(stamps, want)) == sorted(got[severity]) and {"firing", "pending", "inactive"} == set(want)


def test_inhibition_against_pairs(spark):
    rng = np.random.default_rng(6)
    make = lambda n: [("ab"[int(rng.integers(2))], int(s), int(s + rng.integers(0, 5))) for s in rng.integers(0, 200, n)]
    low, high = make(60), make(15)
    frame = lambda x: spark.createDataFrame(x, "asset_id string, started_at int, ended_at int")
    got = sorted(map(tuple, alerts.inhibited(frame(low), frame(high)).collect()))
    assert got == sorted(w for w in low if not any(w[0] == h[0] and w[1] <= h[2] and w[2] >= h[1] for h in high)) and 0 < len(got) < 60


def test_strongest_operating_point(spark):
    shares = [0.05, 0.1, 0.02, 0.2]
    points = [("a", 0.1, 3, 9), ("a", 0.05, 3, 4), ("a", 0.01, 2, 4), ("b", 0.1, 0, 5), ("b", 0.05, 0, 2)]
    df = spark.createDataFrame([(*x, x[2] + x[3], shares) for x in points], "asset_id string, budget double, detected long, false_alarms long, chance_alarms long, shares array<double>")
    got = {(r.asset_id, r.budget): r.p_value for r in evaluate.with_chance(df).collect()}
    for asset, budget, detected, false in points:
        assert got[asset, budget] == pytest.approx(evaluate.exact_chance(shares, detected + false)[detected:].sum(), abs=1e-8)
    best = {r.asset_id: (r.budget, r.detected) for r in evaluate.strongest(evaluate.with_chance(df)).collect()}
    assert best == {"a": (0.05, 3), "b": (0.05, 0)}  # nothing found has p 1: the smaller budget
    assert evaluate.strongest(evaluate.with_chance(df.limit(0))).count() == 0
