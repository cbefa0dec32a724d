"""Trend flags on the stream against the batch, scans over ranges, and incremental updates."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import scan, symptoms
from cohortlab.streaming import flags, updates

LOG = "id long, person long, symptom string, ts timestamp, severity double"
RULES = (3.0, 6.0, 2, 86_400.0)
KEPT = ["n_entries", "baseline_severity", "peak_severity", "longest_run", "longest_gap", "worsened", "stayed_high", "log_gap"]


def entries(n, seed):
    r, t, out = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(minutes=r.choice([1, 7, 45, 600]), microseconds=r.randint(0, 999_999))
        out.append((i, r.choice([1, 1, 1, 2]), r.choice(["pain", "sleep"]), t, r.choice([None, 1.0, 5.0, 7.0, 9.0])))
    return out


def stream(spark, folder, **kw):
    raw = spark.readStream.schema(spark.createDataFrame([], LOG).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return flags.trend_flags(raw, "person", "symptom", "ts", "id", "severity", *RULES, delay="2 hours", **kw)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)


def test_stream_flags_equal_the_batch_whatever_the_order(spark, tmp_path):
    rows = entries(240, 3)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    r, end = random.Random(1), rows[-1][3]
    for i in range(0, 240, 60):  # four files, mixed up inside
        part = rows[i:i + 60]
        near = [x for x in part if x[3] > part[-1][3] - timedelta(hours=2)]
        r.shuffle(part)
        arrive(spark, folder, part)
        assert flags.run(stream(spark, folder), out, state) == 0
        assert near
    # a sign of life that moves the watermark past all entries, then an entry far too late
    arrive(spark, folder, [(999, 7, "pain", end + timedelta(days=1), 1.0)])
    flags.run(stream(spark, folder), out, state)
    arrive(spark, folder, [(1000, 1, "pain", rows[5][3], 9.0)])
    assert flags.run(stream(spark, folder), out, state) == 1
    updates_ = spark.read.parquet(out)
    got = {(x["person"], x["symptom"]): x for x in flags.flags_now(updates_, "person", "symptom").collect()}
    want = symptoms.symptom_flags(spark.createDataFrame(rows, LOG), "person", "symptom", "ts", "id", "severity", *RULES).collect()
    assert len(got) == len(want) == 4
    for w in want:
        g = got[w["person"], w["symptom"]]
        assert [g[c] for c in KEPT] == [w[c] for c in KEPT] and g["first_seen"] == w["first_seen"]
    changes = updates_.filter("changed").groupBy("person", "symptom").count().collect()
    assert all(1 <= c["count"] <= 3 for c in changes)  # a flag only ever goes up


def test_state_of_a_silent_person_goes(spark, tmp_path):
    t = datetime(2024, 1, 1)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in ([(1, 1, "pain", t, 1.0), (2, 1, "pain", t + timedelta(hours=1), 9.0)], [(3, 2, "pain", t + timedelta(days=9), 1.0)],
                  [(4, 1, "pain", t + timedelta(days=10), 5.0)], [(5, 2, "pain", t + timedelta(days=11), 1.0)]):
        arrive(spark, folder, batch)
        flags.run(stream(spark, folder, forget_days=5), out, state)
    mine = sorted((x["last_seen"], x["closed"], x["n_entries"], x["worsened"]) for x in spark.read.parquet(out).filter("person = 1").collect())
    late, last = t + timedelta(hours=1), t + timedelta(days=10)
    assert mine == [(late, False, 2, True), (late, True, 2, True), (last, False, 1, False)]  # the closed log does not count any more


def test_one_hour_of_one_person_spreads_over_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one range again
    try:
        _one_hour_of_one_person(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def _one_hour_of_one_person(spark):
    t = datetime(2024, 1, 1)
    r = random.Random(8)
    rows = [(i, 1, "pain", t + timedelta(milliseconds=i * 50), float(r.choice([1, 9, 9]))) for i in range(20_000)]
    rows += [(100_000 + i, 2 + i % 400, "pain", t + timedelta(minutes=i), 9.0) for i in range(40_000)]
    df = spark.createDataFrame(rows, LOG)
    parts = scan.ranged(df, ["person"], ["ts", "id"])
    assert parts.filter("person = 1").select(scan.PART).distinct().count() >= 2
    best = run = 0
    for x in rows[:20_000]:
        run = run + 1 if x[4] >= 5 else 0
        best = max(best, run)
    got = symptoms.symptom_flags(df, "person", "symptom", "ts", "id", "severity", *RULES).filter("person = 1").first()
    assert (got["longest_run"], got["longest_gap"], got["n_entries"]) == (best, 0.05, 20_000)
    since = {x["id"]: x["since"] for x in symptoms.asof_previous(df.filter("person = 1"), ["person"], "ts", "id", F.col("id") % 1000 == 7, F.col("id"), "since").collect()}
    assert all(since[i] == (None if i < 7 else (i - 7) // 1000 * 1000 + 7) for i in range(20_000))


def test_null_persons_and_values_scan_like_others(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, None, "pain", t, 9.0), (2, None, "pain", t + timedelta(hours=1), 9.0), (3, 4, "pain", t, None)], LOG)
    got = {x["person"]: x for x in symptoms.symptom_flags(df, "person", "symptom", "ts", "id", "severity", *RULES).collect()}
    assert (got[None]["longest_run"], got[None]["longest_gap"], got[None]["stayed_high"]) == (2, 3600.0, True)
    assert (got[4]["longest_run"], got[4]["longest_gap"], got[4]["log_gap"]) == (0, None, False)


def trajectories(spark, cases=40):
    return spark.createDataFrame([(c, p, float(d), 10.0 + p + d / 10 + c % 3) for c in range(cases) for p in range(6) for d in (0, 7, 14)],
                                 "case_id long, particle_id int, day double, predicted double")


def read_rows(df):
    """Rows that the scans of a query have read."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name.startswith("Scan parquet"):
                out += node.metrics().apply("numOutputRows").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


def test_a_batch_reads_the_buckets_of_its_cases_only(spark, tmp_path):
    store = updates.Store(spark, str(tmp_path / "store"), buckets=16)
    store.begin(trajectories(spark))
    batch = lambda cases, day, v: spark.createDataFrame([(c, day, v) for c in cases], "case_id long, day double, volume_ml double")
    store.update(batch(range(40), 0.0, 12.0), 0, 0.12).collect()
    whole = read_rows(store.read("trajectories", list(range(16))))
    assert whole == 40 * 18
    bucket = spark.range(1).select(updates.bucket(F.lit(3).cast("long"), 16)).first()[0]
    assert read_rows(store.read("trajectories", [bucket])) < whole / 4
    one = store.update(batch([3], 7.0, 13.0), 1, 0.12)
    assert {r["case_id"] for r in one.collect()} == {3}
    parts = spark.read.parquet(str(tmp_path / "store" / "parts" / "batch_id=1"))
    assert parts.count() == 6 and {r["day"] for r in parts.collect()} == {7.0}  # only the new day is computed


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = updates.Store(spark, str(tmp_path / "store"), buckets=4)
    store.begin(trajectories(spark))
    rows = [[(c, 0.0, 12.0 + c % 5) for c in range(40)], [(c, 0.0, 14.0) for c in range(10)] + [(c, 7.0, 13.0) for c in range(5)], [(2, 14.0, 20.0)]]
    schema = "case_id long, day double, volume_ml double"
    show = lambda df: sorted((r["case_id"], r["particle_id"], round(r["weight"], 12)) for r in df.collect())
    first = [show(store.update(spark.createDataFrame(b, schema), i, 0.12)) for i, b in enumerate(rows)]
    assert show(store.update(spark.createDataFrame(rows[2], schema), 2, 0.12)) == first[2]
    assert show(store.update(spark.createDataFrame(rows[1], schema), 1, 0.12)) == first[1]
    want = updates.touched_weights(spark.createDataFrame(sum(rows, []), schema), trajectories(spark), spark.createDataFrame([(2,)], "case_id long"), 0.12)
    assert [x[2] for x in first[2]] == pytest.approx([x[2] for x in show(want)])
