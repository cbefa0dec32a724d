"""Catalogue: symptom trends and their streaming twins, on the event log."""

from __future__ import annotations


from pyspark.sql import functions as F

from cohortlab.operators import symptoms
from cohortlab.plans import standins as S
from cohortlab.plans.catalog_ensemble import predictions, weights_sql
from cohortlab.plans.registry import R, query, rounded, table
from cohortlab.session import scratch
from cohortlab.streaming import checkins, flags, updates

HIGH, N_HIGH, RISE, GAP = 60.0, 2, 40.0, 86400.0 * 5

RUN = f"""SELECT user_id, event_type, max(r) AS longest_run FROM (SELECT user_id, event_type, grp, count(*) FILTER (hi) AS r FROM (
  SELECT *, sum((NOT hi)::INT) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS grp FROM (SELECT *, value >= {HIGH} AS hi FROM events)) GROUP BY ALL) GROUP BY ALL"""
GAPS = """SELECT user_id, event_type, max(g) / 1e6 AS longest_gap FROM (SELECT user_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) GROUP BY ALL"""


FLAGS = f"""SELECT user_id, event_type, n_entries, baseline_severity, peak_severity, longest_run::BIGINT AS longest_run, {R('longest_gap', 6)} AS longest_gap,
  peak_severity - baseline_severity >= {RISE} AS worsened, longest_run >= {N_HIGH} AS stayed_high, coalesce(longest_gap > {GAP}, false) AS log_gap, first_seen::VARCHAR AS first_seen FROM (
  SELECT user_id, event_type, count(*) AS n_entries, max(CASE WHEN r = 1 THEN value END) AS baseline_severity, max(value) AS peak_severity, date_trunc('second', min(ts)) AS first_seen FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) GROUP BY ALL) JOIN ({RUN}) USING (user_id, event_type) JOIN ({GAPS}) USING (user_id, event_type)"""
#: Entries that the stream's watermark has passed at the end.
CLOSED = "(SELECT * FROM events WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR)"


def _seen(df):
    return rounded(df.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss")), 6, ["longest_gap"])


@query("symptom_flags", FLAGS)
def symptom_flags(spark, sf):
    got = symptoms.symptom_flags(S.events(spark, sf), "user_id", "event_type", "ts", "event_id", "value", RISE, HIGH, N_HIGH, GAP)
    return _seen(got)


@query("new_symptoms", """SELECT user_id, event_type, n_entries, date_diff('day', min(first) OVER (PARTITION BY user_id)::DATE, first::DATE) >= 2 AS is_new FROM (
  SELECT user_id, event_type, min(ts) AS first, count(*) AS n_entries FROM events GROUP BY ALL)""")
def new_symptoms(spark, sf):
    return symptoms.new_symptoms(S.events(spark, sf), "user_id", "event_type", "ts", 2).select("user_id", "event_type", "n_entries", "is_new")


@query("paired_movement", """SELECT user_id, count(*) AS n_days, count(*) FILTER (u > pu AND d < pd) AS n_opposed FROM (SELECT *, lag(u) OVER w AS pu, lag(d) OVER w AS pd FROM (
  SELECT user_id, ts::DATE AS day, avg(value) FILTER (event_type = 'view') AS u, avg(value) FILTER (event_type = 'click') AS d FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)
  WHERE u IS NOT NULL AND d IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY day)) GROUP BY user_id""")
def paired_movement(spark, sf):
    return symptoms.paired_movement(S.events(spark, sf), "user_id", "event_type", "ts", "value", "view", "click")


SINCE = """SELECT *, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events"""


@query("asof_infusion", f"SELECT event_id, (epoch_us(ts) - epoch_us(since))::DOUBLE AS micros_since FROM ({SINCE})")
def asof_infusion(spark, sf):
    df = symptoms.asof_previous(S.events(spark, sf), ["user_id"], "ts", "event_id", F.col("event_type") == "error", F.col("ts"), "since")
    return df.select("event_id", (F.unix_micros("ts") - F.unix_micros("since")).cast("double").alias("micros_since"))


@query("treatment_day_peak", f"""WITH p AS (SELECT event_type, date_diff('day', since::DATE, ts::DATE) AS day_offset, count(*) AS n, avg(value) AS m FROM ({SINCE}) WHERE since IS NOT NULL AND event_type <> 'error' GROUP BY ALL)
  SELECT event_type, day_offset::INT AS day_offset, n, {R('m')} AS mean_severity, first_value(day_offset) OVER (PARTITION BY event_type ORDER BY m DESC, day_offset)::INT AS peak_offset FROM p""")
def treatment_day_peak(spark, sf):
    df = symptoms.asof_previous(S.events(spark, sf), ["user_id"], "ts", "event_id", F.col("event_type") == "error", F.col("ts"), "since")
    return rounded(symptoms.treatment_day_profile(df.filter(F.col("event_type") != "error"), "user_id", "event_type", "ts", "value", "since"))


VISIT = "2024-01-20 00:00:00"


@query("visit_summary", f"""SELECT user_id, event_type, count(*) AS n_entries, {R('avg(value)')} AS mean_severity, max(value) AS peak_severity,
  date_trunc('second', min(ts))::VARCHAR AS first_seen, count(DISTINCT CASE WHEN ts >= TIMESTAMP '{VISIT}' - INTERVAL 7 DAY AND value < 20 THEN ts::DATE END) AS low_days_of_last_7 FROM events WHERE ts < TIMESTAMP '{VISIT}' GROUP BY ALL""")
def visit_summary(spark, sf):
    got = symptoms.visit_summary(S.events(spark, sf), "user_id", "event_type", "ts", "value", F.lit(VISIT).cast("timestamp"), 20.0)
    return rounded(got.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss")))


WEIGHT = {"click": 0.5, "view": 0.25, "purchase": 1.0, "error": 2.0}
WEIGHT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHT.items()) + " ELSE 0 END"


@query("burden", f"""SELECT user_id, {R('sum(part)')} AS burden, min_by(event_type, (printf('%020.9f', 1e6 - part) || event_type)) AS dominant,
  CASE WHEN sum(part) < 120 THEN 'low' WHEN sum(part) < 200 THEN 'moderate' ELSE 'high' END AS burden_level FROM (
  SELECT user_id, event_type, avg(value) * max({WEIGHT_SQL}) AS part FROM events GROUP BY ALL) GROUP BY user_id""")
def burden(spark, sf):
    return rounded(symptoms.burden(S.events(spark, sf), "user_id", "event_type", "value", WEIGHT, 120.0, 200.0))


def _fresh(spark) -> str:
    return scratch(spark, "stream")


def _events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # the folder also holds other tables, so the reader picks this table's files by name
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_checkins", f"""SELECT time_bucket(INTERVAL 6 HOUR, ts)::VARCHAR AS window_start, event_type, count(*) AS n, {R('avg(value)')} AS mean_value FROM events
  WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_checkins(spark, sf):
    """Deduplicated check-ins in six-hour windows; the windows the watermark has closed."""
    clean = checkins.clean(_events_stream(spark, sf))
    windows = checkins.window_averages(clean, ["event_type"], "ts", "value", "6 hours")
    home = _fresh(spark)
    checkins.drain(windows, f"{home}/out", f"{home}/state")
    got = spark.read.schema("window_start timestamp, window_end timestamp, event_type string, n bigint, mean_value double").parquet(f"{home}/out")
    return rounded(got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "mean_value"))


@query("stream_sliding", f"""SELECT w::VARCHAR AS window_start, event_type, count(*) AS n, {R('avg(value)')} AS mean_value FROM (
  SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR * unnest([0, 1, 2]) AS w FROM events)
  WHERE w + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_sliding(spark, sf):
    """Six-hour windows every two hours; those that the watermark has closed."""
    windows = checkins.window_averages(checkins.clean(_events_stream(spark, sf)), ["event_type"], "ts", "value", "6 hours", "2 hours")
    home = _fresh(spark)
    checkins.drain(windows, f"{home}/out", f"{home}/state")
    got = spark.read.schema("window_start timestamp, window_end timestamp, event_type string, n bigint, mean_value double").parquet(f"{home}/out")
    return rounded(got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "mean_value"))


@query("stream_trend_flags", FLAGS.replace("FROM events", f"FROM {CLOSED}"))
def stream_trend_flags(spark, sf):
    """The flags of each person and symptom after all entries that the watermark has passed."""
    home = _fresh(spark)
    updates_ = flags.trend_flags(_events_stream(spark, sf), "user_id", "event_type", "ts", "event_id", "value", RISE, HIGH, N_HIGH, GAP)
    flags.run(updates_, f"{home}/out", f"{home}/state")
    got = spark.read.schema(updates_.schema).parquet(f"{home}/out")
    return _seen(flags.flags_now(got, "user_id", "event_type").drop("last_seen", "changed", "closed"))


@query("stream_sessions", """WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (
    SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events))
  SELECT user_id, n_sessions, n_entries FROM (SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_entries FROM (SELECT user_id, sid, count(*) AS n, max(ts) + INTERVAL 12 HOUR AS e FROM s GROUP BY ALL)
    WHERE e <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR GROUP BY user_id)""")
def stream_sessions(spark, sf):
    """Sessions per person (entries under twelve hours apart) that the watermark has closed."""
    clean = checkins.clean(_events_stream(spark, sf))
    home = _fresh(spark)
    checkins.drain(checkins.sessions(clean, ["user_id"], "ts", "12 hours"), f"{home}/out", f"{home}/state")
    got = spark.read.schema("session_start timestamp, session_end timestamp, user_id bigint, n bigint").parquet(f"{home}/out")
    return got.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_entries"))


@query("stream_update", f"SELECT case_id, particle_id, {R('weight')} AS weight FROM ({weights_sql('day % 16 = 7')})")
def stream_update(spark, sf):
    """Measurements arrive as a stream of two files; the weights after the last batch."""
    pred = predictions(spark, sf)
    home = _fresh(spark)
    arrivals = pred.filter(F.col("day") % 16 == 7).groupBy("case_id", "day").agg((F.avg("predicted") + 0.5).alias("volume_ml"))
    arrivals.repartition(2, "day").write.parquet(f"{home}/in")
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    updates.run(spark, stream, pred, f"{home}/store", f"{home}/out", f"{home}/state", noise=0.2)
    return rounded(updates.latest(spark.read.parquet(f"{home}/out")).select("case_id", "particle_id", "weight"))
