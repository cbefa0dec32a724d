"""Catalogue: curves with back-off, scenarios by particle, paths along edges, significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import curate, edges, metrics, outcomes, significance
from cohortlab.plans import standins as S
from cohortlab.plans.catalog_checks import LABEL, U
from cohortlab.plans.catalog_ensemble import predictions
from cohortlab.plans.catalog_outcomes import BASED, RANKS, based
from cohortlab.plans.registry import R, query, rounded, table

# ---- curves of strata as forecasts -------------------------------------------------------
STRATA_ROWS = f"""SELECT obs_id, c_mktsegment AS segment, c_nationkey AS nation, floor(day / 8)::BIGINT AS day_bin, volume_ml, baseline_volume_ml, {LABEL} AS split FROM (
  SELECT *, {U.replace('o_custkey', 'case_id')} AS u FROM ({BASED}) JOIN customer ON case_id = c_custkey)"""
LATTICE = f"""SELECT segment, nation, day_bin, (2 * grouping(segment) + grouping(nation))::INT AS mask, avg(volume_ml / baseline_volume_ml) AS mean_ratio, count(*) AS n_rows
  FROM ({STRATA_ROWS}) WHERE split = 'train' GROUP BY GROUPING SETS ((segment, nation, day_bin), (segment, day_bin), (nation, day_bin), (day_bin))"""
STRATA_POINTS = f"""SELECT obs_id, volume_ml AS observed, CASE mask WHEN 0 THEN 'segment+nation' WHEN 1 THEN 'segment' WHEN 2 THEN 'nation' WHEN 3 THEN 'population' END AS level, used_bin,
    baseline_volume_ml * mean_ratio AS point FROM (
  SELECT r.*, c.mask, c.day_bin AS used_bin, c.mean_ratio, row_number() OVER (PARTITION BY obs_id ORDER BY c.mask, abs(c.day_bin - r.day_bin), c.day_bin) AS pick
  FROM ({STRATA_ROWS}) r LEFT JOIN ({LATTICE}) c ON (c.mask >= 2 OR c.segment = r.segment) AND (c.mask % 2 = 1 OR c.nation = r.nation) AND abs(c.day_bin - r.day_bin) <= 1 AND c.n_rows >= 6
  WHERE r.split <> 'train') WHERE pick = 1"""


def strata(spark, sf):
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return based(spark, sf).join(who, "case_id")


def strata_points(spark, sf):
    df, train = strata(spark, sf), curate.split_of(F.col("case_id")) == "train"
    curves = curate.curve_lattice(df, ["segment", "nation"], "day", 8, train)
    return curate.stratum_forecast(df.filter(~train), curves, ["segment", "nation"], "day", 8, 6)


@query("stratum_lattice", f"SELECT segment, nation::VARCHAR AS nation, day_bin, mask, n_rows, {R('mean_ratio', 6)} AS mean_ratio FROM ({LATTICE})")
def stratum_lattice(spark, sf):
    train = curate.split_of(F.col("case_id")) == "train"
    got = curate.curve_lattice(strata(spark, sf), ["segment", "nation"], "day", 8, train)
    return rounded(got.withColumn("nation", F.col("nation").cast("string")), 6)


@query("stratum_forecast", f"SELECT obs_id, level, used_bin::VARCHAR AS used_bin, {R('point', 5)} AS point FROM ({STRATA_POINTS})")
def stratum_forecast(spark, sf):
    return rounded(strata_points(spark, sf).select("obs_id", "level", F.col("used_bin").cast("string").alias("used_bin"), "point"), 5)


@query("leaderboard_strata", f"""SELECT 'stratum_curve' AS method, level, count(*) AS n, {R('avg(abs(point - observed))', 6)} AS mae_ml, {R('sqrt(avg(pow(point - observed, 2)))', 6)} AS rmse_ml,
  {R('sqrt(avg(pow(ln(greatest(point, 1e-6)) - ln(observed), 2)))', 6)} AS log_volume_rmse, {R('quantile_cont(abs(point - observed) / observed, 0.5)', 6)} AS median_ape
  FROM ({STRATA_POINTS}) WHERE point IS NOT NULL GROUP BY level""")
def leaderboard_strata(spark, sf):
    rows = strata_points(spark, sf).select(F.lit("stratum_curve").alias("method"), "level", F.col("volume_ml").alias("observed"), "point")
    return rounded(metrics.forecast_metrics(rows, ["method", "level"], intervals=False), 6)


# ---- scenarios under the same particles ---------------------------------------------------
@query("scenario_bands", f"""WITH p AS (SELECT label AS case_id, vec_id AS particle_id, unnest([3, 19, 35, 51]) AS scenario, 10 + 20 * unnest([embedding[4], embedding[20], embedding[36], embedding[52]])::DOUBLE AS value FROM embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY case_id, particle_id ORDER BY value DESC, scenario) AS rank FROM p)
  SELECT case_id, scenario::BIGINT AS scenario, count(*) AS n_particles, {R('avg((rank = 1)::INT)')} AS chance_best, {R('avg(rank)')} AS mean_rank,
    {', '.join(f"{R(f'quantile_cont({c}, {p})')} AS {c}_{n}" for c in ('value', 'rank') for n, p in (('lo', 0.1), ('mid', 0.5), ('hi', 0.9)))} FROM r GROUP BY case_id, scenario""")
def scenario_bands(spark, sf):
    draws = predictions(spark, sf).filter(F.col("day") % 16 == 3).select("case_id", "particle_id", F.col("day").alias("scenario"), F.col("predicted").alias("value"))
    return rounded(outcomes.scenario_bands(draws, ["case_id"], "particle_id", "scenario", "value"))


# ---- paths along edges, with cycles ---------------------------------------------------------
GRAPH = """SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, (n_nationkey % 3 - 1) * 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 0.5 FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 7 + 3) % 25), 0.25 FROM nation WHERE n_nationkey % 6 = 1
  UNION ALL SELECT 'r' || r_regionkey, 'p' || (r_regionkey % 2), r_regionkey - 1.5 FROM region"""
WALKS = f"""(WITH RECURSIVE e AS ({GRAPH}), walk(source, node, weight, depth, seen) AS (
    SELECT 'n' || n_nationkey, 'n' || n_nationkey, 1.0::DOUBLE, 0, ['n' || n_nationkey] FROM nation
    UNION ALL SELECT source, dst, walk.weight * e.weight, depth + 1, list_append(seen, dst) FROM walk JOIN e ON node = src WHERE depth < 12 AND NOT list_contains(seen, dst))
  SELECT source, node AS target, sum(weight) AS weight, count(*) AS n_paths, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY source, node)"""
FIRST = "SELECT s_suppkey AS gene, 'n' || s_nationkey AS node, s_acctbal / 9973.0::DOUBLE AS weight FROM supplier WHERE s_acctbal >= 0"
GENES = "SELECT l_orderkey AS case_id, l_suppkey AS gene, l_discount AS effect FROM lineitem"


def graph(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    key, home = F.col("n_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    edge = lambda df, src, dst, w: df.select(src.alias("src"), dst.alias("dst"), w.cast("double").alias("weight"))
    return (edge(nation, n(key), home, key % 3 - 1)
            .unionByName(edge(nation.filter(key % 5 == 0), home, n(key), F.lit(0.5)))
            .unionByName(edge(nation.filter(key % 6 == 1), n(key), n((key * 7 + 3) % 25), F.lit(0.25)))
            .unionByName(edge(region, F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("p"), (F.col("r_regionkey") % 2).cast("string")), F.col("r_regionkey") - 1.5)))


def walks(spark, sf):
    return edges.edge_paths(graph(spark, sf), table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node")))


def genes_and_first(spark, sf):
    genes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("gene"), F.col("l_discount").alias("effect"))
    first = table(spark, sf, "supplier").filter("s_acctbal >= 0").select(
        F.col("s_suppkey").alias("gene"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node"), (F.col("s_acctbal") / 9973.0).alias("weight"))
    return genes, first


@query("edge_paths", f"SELECT source, target, {R('weight')} AS weight, n_paths, depth::INT AS depth FROM {WALKS}")
def edge_paths(spark, sf):
    return rounded(walks(spark, sf))


@query("edge_effects", f"""SELECT case_id, target, {R('sum(effect * way)')} AS shift, {R('exp(greatest(-30, least(30, sum(effect * way))))')} AS modifier, count(*) AS n_genes FROM (
  SELECT case_id, gene, sum(effect) AS effect FROM ({GENES}) GROUP BY ALL) JOIN (
  SELECT gene, target, sum(f.weight * w.weight) AS way FROM ({FIRST}) f JOIN {WALKS} w ON node = source WHERE target IN ('p0', 'p1') GROUP BY ALL) USING (gene) GROUP BY case_id, target""")
def edge_effects(spark, sf):
    genes, first = genes_and_first(spark, sf)
    parameters = table(spark, sf, "region").select(F.concat(F.lit("p"), (F.col("r_regionkey") % 2).cast("string")).alias("target")).distinct()
    return rounded(edges.edge_effects(genes, first, walks(spark, sf), parameters))


@query("missing_drivers", f"SELECT DISTINCT case_id, gene FROM ({GENES}) WHERE gene NOT IN (SELECT gene FROM ({FIRST}))")
def missing_drivers(spark, sf):
    return edges.missing_drivers(*genes_and_first(spark, sf))


# ---- significance ---------------------------------------------------------------------------
RELABELLINGS = 20
ROWS = "SELECT l_returnflag AS method, l_linestatus = 'F' AS first, l_extendedprice / 1024.0::DOUBLE AS observed, l_orderkey || '-' || l_linenumber AS id FROM lineitem"


def _labels() -> str:
    cuts = [f"(('0x' || md5(id || ':{b // 4}')[{1 + 8 * (b % 4)}:{8 + 8 * (b % 4)}])::BIGINT / 4294967296.0::DOUBLE < share) AS l{b}" for b in range(RELABELLINGS)]
    running = [f"count(*) FILTER ({c}) OVER w / count(*) FILTER ({c}) OVER g - count(*) FILTER (NOT {c}) OVER w / count(*) FILTER (NOT {c}) OVER g" for c in ("first", *[f"l{b}" for b in range(RELABELLINGS)])]
    gaps = ", ".join(f"max(abs(d{i})) AS k{i}" for i in range(len(running)))
    return f"""WITH r AS (SELECT *, avg(first::INT) OVER (PARTITION BY method) AS share FROM ({ROWS})), l AS (SELECT *, {', '.join(cuts)} FROM r),
  d AS (SELECT method, first, {', '.join(f'{e} AS d{i}' for i, e in enumerate(running))} FROM l WINDOW g AS (PARTITION BY method), w AS (PARTITION BY method ORDER BY observed)),
  k AS (SELECT method, count(*) FILTER (first) AS n_a, count(*) FILTER (NOT first) AS n_b, {gaps} FROM d GROUP BY method)
  SELECT method, n_a, n_b, {R('k0')} AS ks, {R(f"(1 + {' + '.join(f'coalesce((k{i + 1} >= k0)::INT, 0)' for i in range(RELABELLINGS))}) / {RELABELLINGS + 1}.0::DOUBLE")} AS p_value FROM k WHERE n_a > 0 AND n_b > 0"""


@query("ks_permutation", _labels())
def ks_permutation(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), (F.col("l_linestatus") == "F").alias("first"), (F.col("l_extendedprice") / 1024.0).alias("observed"),
                                             F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return rounded(significance.ks_permutation(df, ["method"], "observed", F.col("first"), F.col("id"), RELABELLINGS))


TAIL = " + ".join(f"pow(chi / 2, {k}) / {f}" for k, f in enumerate((1, 1, 2, 6, 24)))  # ten degrees: exp(-x/2) times a sum of five terms


@query("rank_histogram_test", f"""SELECT part, n_cases, {R('chi')} AS chi_square, {R(f'exp(-chi / 2) * ({TAIL})')} AS p_value FROM (
  SELECT part, sum(c)::BIGINT AS n_cases, sum(c * c) * 11.0::DOUBLE / sum(c) - sum(c) AS chi FROM (
    SELECT l_suppkey % 3 AS part, least(floor(rank * 11 / (n_particles + 1)), 10) AS bin, count(*) AS c FROM ({RANKS}) GROUP BY ALL) GROUP BY part)""")
def rank_histogram_test(spark, sf):
    truths = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (1000 + F.col("s_acctbal") * 8).alias("truth"), F.lit(1).alias("n"))
    ranks = outcomes.truth_ranks(table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice"), truths, ["l_suppkey"], "l_extendedprice", "truth")
    return rounded(significance.rank_histogram_test(ranks.withColumn("part", F.col("l_suppkey") % 3), ["part"], 11))
