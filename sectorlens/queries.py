"""Registered queries of the reference operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import fixed, fixed_multiply, fixed_point_ratio, length_prefixed, reciprocal_holds, row_tag
from .operators import align as alignment
from .operators import gbdt, rank, release, setops
from .operators.aggregate import CELL, bucket_midpoints, cdf, dense_histogram, histogram, interpolated, percentiles, reconcile, sector_ratios
from .operators.metrics import coverage, inclusion_audit, totals
from .operators.prep import duplicates, prepare
from .operators.privacy import RhoBudget, attack_report, noise_report, sigma
from .plans import panel
from .plans.panel import table
from .schema import CORE, INCOME, LENDING, METRICS, WORKFORCE
from .sources.files import hex_blocks
from .sources.generate import attack_trials, firm_panel, noise_draws
from .streaming.cells import event_cells

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# SQL building blocks -------------------------------------------------------------------------------------------------

CENTS = "CAST(round(({}) * 100) AS BIGINT)"
PERIOD = "CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS INTEGER)"
ID = "sha256('sector-panel|1|' || lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g')))"
_SUM = "CAST(coalesce(sum(CASE WHEN {} THEN c END), 0) AS BIGINT)"

RAW = f"""
ra AS (SELECT c_name AS raw_entity_id, period, c_nationkey + 1 AS sector, CAST(sum(c) AS BIGINT) AS total_outstanding_debt,
  {_SUM.format("o_orderstatus = 'P'")} AS annual_debt_service, {_SUM.format("o_orderstatus = 'F'")} AS delinquent_loan_balance,
  {_SUM.format("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")} AS nonperforming_loan_balance,
  {_SUM.format("o_orderpriority = '5-LOW'")} AS unsecured_loan_balance, {_SUM.format("month(o_orderdate) % 3 = 0")} AS debt_due_within_12_months
  FROM (SELECT *, {PERIOD} AS period, {CENTS.format("o_totalprice")} AS c FROM orders) o JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 <> 0 GROUP BY c_custkey, c_name, c_nationkey, period),
rb AS (SELECT c_name AS raw_entity_id, {PERIOD} AS period, c_nationkey + 1 + CAST(c_custkey % 17 = 0 AS INTEGER) AS sector,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST(4 * sum({CENTS.format("l_extendedprice")}) AS BIGINT) END AS annual_income,
  CAST(sum({CENTS.format("l_extendedprice * (1 - l_discount)")}) AS BIGINT) AS revenue, CAST(sum({CENTS.format("l_extendedprice * l_discount")}) AS BIGINT) AS operating_surplus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 GROUP BY c_custkey, c_name, c_nationkey, {PERIOD}),
rc AS (SELECT c_name AS raw_entity_id, {PERIOD} AS period, c_nationkey + 1 AS sector, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS employment_count,
  CAST(sum(CAST(l_quantity AS BIGINT)) + count(*) AS BIGINT) AS labour_force_count, CAST(sum(CAST(l_quantity AS BIGINT)) + 3 * count(*) AS BIGINT) AS working_age_population,
  CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS retrenchment_count, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS vacancy_count, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS unemployment_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0 GROUP BY c_custkey, c_name, c_nationkey, {PERIOD})"""  # fmt: skip


def _prep_sql(source: str, attributes: dict[str, int], status: bool) -> str:
    parts = [f"{ID.format('raw_entity_id')} AS entity_id", "period", "sector"]
    for a, most in attributes.items():
        ok = f"coalesce({a} BETWEEN 0 AND {most}, false)"
        parts.append(f"CASE WHEN {ok} THEN {a} END AS {a}")
        if status:
            parts += [f"CAST({a} IS NOT NULL AS INTEGER) AS {a}_nm", f"CAST({ok} AS INTEGER) AS {a}_ok"]
    if status:
        notes = ", ".join(f"CASE WHEN {a} IS NULL THEN '{a}: missing' WHEN NOT coalesce({a} BETWEEN 0 AND {m}, false) THEN '{a}: out of range' END" for a, m in attributes.items())
        parts.append(f"coalesce(array_to_string(list_filter([{notes}], lambda x: x IS NOT NULL), '; '), '') AS warnings")
    return f"SELECT {', '.join(parts)} FROM {source}"


def _growth_sql(source: str, value: str, out: str) -> str:
    w = "(PARTITION BY entity_id ORDER BY period)"
    return f"""SELECT * EXCLUDE (q, pq, pv), CASE WHEN q - pq = 1 AND pv > 0 THEN greatest(-10000, least(10000, CAST(CASE WHEN {value} < pv THEN -1 ELSE 1 END * ((abs({value} - pv) * CAST(10000 AS HUGEINT)) // pv) AS BIGINT))) END AS {out}
FROM (SELECT *, period // 10 * 4 + period % 10 AS q, lag(period // 10 * 4 + period % 10) OVER {w} AS pq, lag({value}) OVER {w} AS pv FROM {source})"""


PREP = f"""{RAW}, a AS ({_growth_sql("(" + _prep_sql("ra", LENDING, False) + ")", "total_outstanding_debt", "g_debt")}),
b AS ({_growth_sql("(" + _prep_sql("rb", INCOME, False) + ")", "annual_income", "g_income")}), c AS ({_prep_sql("rc", WORKFORCE, False)})"""
PAYLOAD = [*LENDING, "g_debt", *INCOME, "g_income", *WORKFORCE]
ALIGNED = f"""{PREP}, al AS (SELECT coalesce(a.entity_id, b.entity_id, c.entity_id) AS entity_id, coalesce(a.period, b.period, c.period) AS period, coalesce(a.sector, b.sector, c.sector) AS sector,
  CAST(coalesce(a.sector <> b.sector, false) OR coalesce(a.sector <> c.sector, false) OR coalesce(b.sector <> c.sector, false) AS INTEGER) AS sector_conflict,
  CAST(a.entity_id IS NOT NULL AS INTEGER) AS has_a, CAST(b.entity_id IS NOT NULL AS INTEGER) AS has_b, CAST(c.entity_id IS NOT NULL AS INTEGER) AS has_c, {", ".join(PAYLOAD)}
  FROM a FULL JOIN b ON a.entity_id = b.entity_id AND a.period = b.period FULL JOIN c ON coalesce(a.entity_id, b.entity_id) = c.entity_id AND coalesce(a.period, b.period) = c.period)"""


def _metric_sql(m) -> str:
    present = " AND ".join(f"has_{s} = 1" for s in m.sources)
    num = m.num if m.den else "g_debt - g_income"
    den = m.den or "CAST(1 AS BIGINT)"
    ok = f"coalesce({present} AND ({num}) IS NOT NULL" + (f" AND {m.den} BETWEEN 1 AND {m.den_max}" if m.den else "") + ", false)"
    shown = num if m.den else f"greatest({num}, 0)"
    fits = f"len(list_filter({list(m.edges)}, lambda e: CAST(e AS HUGEINT) * {den} <= CAST({shown} AS HUGEINT) * {m.scale}))"
    return f"SELECT entity_id, period, sector, '{m.name}' AS metric, CASE WHEN {ok} THEN {num} END AS num, CASE WHEN {ok} THEN {den} END AS den, CAST({ok} AS INTEGER) AS incl, CAST(CASE WHEN {ok} THEN greatest(0, least({len(m.edges) - 2}, {fits} - 1)) ELSE 0 END AS INTEGER) AS bucket FROM al"


LONG = f"WITH {ALIGNED}, m AS ({' UNION ALL '.join(map(_metric_sql, METRICS))})"
D38 = "CAST({} AS DECIMAL(38,0))"


def _totals_sql(by: str) -> str:
    return f"SELECT {by}metric, {D38.format('coalesce(sum(num), 0)')} AS sum_num, {D38.format('coalesce(sum(den), 0)')} AS sum_den, CAST(sum(incl) AS BIGINT) AS n_valid FROM m GROUP BY {by}metric"


RATIO = "CASE WHEN sum_den > 0 THEN CAST(sum_num AS DOUBLE) / CAST(sum_den AS DOUBLE) END AS ratio"
HIST = f"{LONG}, h AS (SELECT sector, period, metric, bucket, count(*) AS cnt FROM m WHERE incl = 1 GROUP BY ALL)"
CDF = f"{HIST}, f AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY sector, period, metric ORDER BY bucket) AS BIGINT) AS cum, CAST(sum(cnt) OVER (PARTITION BY sector, period, metric) AS BIGINT) AS total FROM h)"
PCT = ", ".join(f"min(CASE WHEN cum >= greatest(1, ({q} * total + 99) // 100) THEN bucket END) AS p{q}" for q in (25, 50, 75, 90, 95, 99))
RANK = f"""{LONG}, r AS (SELECT *, CASE WHEN incl = 1 THEN row_number() OVER (PARTITION BY metric, sector, period, incl ORDER BY bucket, entity_id) - 1 ELSE 0 END AS rank,
  CAST(sum(incl) OVER (PARTITION BY metric, sector, period) AS BIGINT) AS n_valid FROM m),
s AS (SELECT *, CASE WHEN incl = 1 THEN CAST(rank AS DOUBLE) / CAST(greatest(n_valid - 1, 1) AS DOUBLE) ELSE 0.0 END AS score FROM r)"""
GATE = f"{CDF}, t AS ({_totals_sql('sector, period, ')})"
_GATED = f"SELECT sector, period, metric, CAST(n_valid >= 5 AS INTEGER) AS released, {D38.format('CASE WHEN n_valid >= 5 THEN sum_num ELSE 0 END')} AS sum_num, {D38.format('CASE WHEN n_valid >= 5 THEN sum_den ELSE 0 END')} AS sum_den, CASE WHEN n_valid >= 5 THEN n_valid ELSE 0 END AS n_valid, CASE WHEN n_valid >= 5 AND sum_den > 0 THEN CAST(sum_num AS DOUBLE) / CAST(sum_den AS DOUBLE) END AS ratio FROM t"


# preparation and alignment -------------------------------------------------------------------------------------------


@query(f"WITH {RAW} {_prep_sql('ra', LENDING, True)}")
def prep_lending_status(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(panel.raw_lending(spark, sf), LENDING)


@query(f"WITH {RAW} {_prep_sql('rb', INCOME, True)}")
def prep_income_status(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(panel.raw_income(spark, sf), INCOME)


@query(f"WITH {RAW} {_prep_sql('rc', WORKFORCE, True)}")
def prep_workforce_status(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(panel.raw_workforce(spark, sf), WORKFORCE)


@query(f"SELECT o_custkey, period, o_orderkey, occurrence FROM (SELECT o_custkey, {PERIOD} AS period, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey, {PERIOD} ORDER BY o_orderkey) AS INTEGER) AS occurrence FROM orders) WHERE occurrence > 1")
def dup_entity_period(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates(table(spark, sf, "orders").select("o_custkey", panel._period().alias("period"), "o_orderkey"), ["o_custkey", "period"], "o_orderkey")


@query(f"WITH {PREP} SELECT entity_id, period, g_debt FROM a")
def period_growth(spark: SparkSession, sf: str) -> DataFrame:
    return panel.lending(spark, sf).select("entity_id", "period", "g_debt")


@query(f"WITH {ALIGNED} SELECT * FROM al")
def align_full(spark: SparkSession, sf: str) -> DataFrame:
    return panel.aligned(spark, sf)


@query(f"WITH {ALIGNED} SELECT has_a, has_b, has_c, count(*) AS n FROM al GROUP BY ALL")
def align_presence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return panel.aligned(spark, sf).groupBy("has_a", "has_b", "has_c").agg(F.count("*").alias("n"))


@query(f"WITH {ALIGNED} SELECT count(*) AS live, CAST(sum(has_a) AS BIGINT) AS with_a, CAST(sum(has_b) AS BIGINT) AS with_b, CAST(sum(has_c) AS BIGINT) AS with_c, CAST(sum(has_a * has_b * has_c) AS BIGINT) AS with_all, CAST(sum(sector_conflict) AS BIGINT) AS conflicts FROM al")
def alignment_audit(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignment_audit(panel.aligned(spark, sf))


@query(f"WITH {ALIGNED} SELECT entity_id, period, sector FROM al WHERE sector_conflict = 1")
def sector_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return panel.aligned(spark, sf).where("sector_conflict = 1").select("entity_id", "period", "sector")


# Hex digits are read by position, since the two engines share no conversion from hex.
@query("SELECT c_custkey, CAST(('0x' || substr(d, 1, 8)) AS BIGINT) >> 19 AS bin, CAST(('0x' || substr(d, 9, 15)) AS BIGINT) AS tag FROM (SELECT c_custkey, sha256('tag-key|' || c_name || '|20261') AS d FROM customer)")
def row_tags(spark: SparkSession, sf: str) -> DataFrame:
    bin_, tag = row_tag(F.col("c_name"), F.lit(20261), "tag-key")
    return table(spark, sf, "customer").select("c_custkey", bin_.alias("bin"), tag.alias("tag"))


# metrics and cells ---------------------------------------------------------------------------------------------------


@query(f"{LONG} SELECT entity_id, period, sector, metric, num, den, incl FROM m")
def inclusion_long(spark: SparkSession, sf: str) -> DataFrame:
    return panel.metrics(spark, sf, buckets=False)


@query(f"{LONG} SELECT metric, CAST(sum(incl) AS BIGINT) AS included, CAST(sum(1 - incl) AS BIGINT) AS live_but_excluded FROM m GROUP BY metric")
def inclusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inclusion_audit(panel.aligned(spark, sf))


@query(f"{LONG} SELECT *, CAST(core_available = 4 AS INTEGER) AS incl_strict, CAST(core_available >= 1 AS INTEGER) AS incl_renorm FROM (SELECT entity_id, period, CAST(sum(CASE WHEN metric IN ('DTI', 'DSI', 'Delq', 'NPL') THEN incl ELSE 0 END) AS BIGINT) AS core_available FROM m GROUP BY ALL)")
def coverage_flags(spark: SparkSession, sf: str) -> DataFrame:
    return coverage(panel.metrics(spark, sf, buckets=False))


@query(f"{LONG} {_totals_sql('')}")
def global_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return totals(panel.aligned(spark, sf))


@query(f"{LONG} SELECT *, CAST(n_valid > 0 AS INTEGER) AS incl, {RATIO} FROM ({_totals_sql('sector, period, ')})")
def sector_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return sector_ratios(panel.aligned(spark, sf))


@query(f"{LONG} SELECT sector, period, {', '.join(f'max(CASE WHEN metric = {chr(39)}{m.name}{chr(39)} THEN ratio END) AS {m.name.lower()}' for m in METRICS)} FROM (SELECT *, {RATIO} FROM ({_totals_sql('sector, period, ')})) GROUP BY ALL")
def sector_ratio_wide(spark: SparkSession, sf: str) -> DataFrame:
    return sector_ratios(panel.aligned(spark, sf)).groupBy("sector", "period").agg(*(F.max(F.when(F.col("metric") == m.name, F.col("ratio"))).alias(m.name.lower()) for m in METRICS))


@query(f"""{LONG}, g AS ({_totals_sql('')}), t AS (SELECT metric, sum(sum_num) AS sn, sum(sum_den) AS sd, sum(n_valid) AS n FROM ({_totals_sql('sector, period, ')}) GROUP BY metric)
SELECT metric, n_valid, CAST(sum_num = sn AND sum_den = sd AND n_valid = n AS INTEGER) AS reconciled FROM g JOIN t USING (metric)""")
def reconcile_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile(panel.aligned(spark, sf))


@query(f"{LONG} SELECT entity_id, period, metric, incl, bucket FROM m")
def metric_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return panel.metrics(spark, sf).select("entity_id", "period", "metric", "incl", "bucket")


@query(f"{HIST} SELECT * FROM h")
def sector_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(panel.metrics(spark, sf))


@query(f"{CDF} SELECT * FROM f")
def sector_cdf(spark: SparkSession, sf: str) -> DataFrame:
    return cdf(histogram(panel.metrics(spark, sf)))


@query(f"{CDF} SELECT sector, period, metric, max(total) AS n_valid, {PCT} FROM f GROUP BY sector, period, metric")
def sector_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles(histogram(panel.metrics(spark, sf)))


_EDGE = "CASE metric " + " ".join(f"WHEN '{m.name}' THEN {list(m.edges)}" for m in METRICS) + " END"


@query(f"{CDF}, g AS (SELECT *, {_EDGE} AS e, total * CAST(0.5 AS DOUBLE) AS goal FROM f) SELECT sector, period, metric, e[bucket + 1] + (e[bucket + 2] - e[bucket + 1]) * ((goal - (cum - cnt)) / CAST(cnt AS DOUBLE)) AS q50 FROM g WHERE cum >= goal AND cum - cnt < goal")
def sector_quantile_interp(spark: SparkSession, sf: str) -> DataFrame:
    return interpolated(histogram(panel.metrics(spark, sf)), 50)


@query(f"{HIST}, g AS (SELECT *, {_EDGE} AS e FROM h) SELECT sector, period, metric, bucket, cnt, (e[least(bucket, 127) + 1] + e[least(bucket, 127) + 2]) / CAST(2 AS DOUBLE) AS midpoint FROM g")
def bucket_midpoint(spark: SparkSession, sf: str) -> DataFrame:
    return bucket_midpoints(histogram(panel.metrics(spark, sf)))


# ranks and composite -------------------------------------------------------------------------------------------------


@query(f"{RANK} SELECT entity_id, period, sector, metric, incl, bucket, rank, n_valid, score FROM s")
def metric_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rank.ranks(panel.metrics(spark, sf)).drop("num", "den")


_SCORE = {m: f"max(CASE WHEN metric = '{m}' AND incl = 1 THEN score END)" for m in CORE}
_COMPOSITE = f"""{RANK}, w AS (SELECT entity_id, period, sector, {", ".join(f"{_SCORE[m]} AS {m.lower()}_s" for m in CORE)} FROM s GROUP BY entity_id, period, sector),
x AS (SELECT *, {" + ".join(f"CAST({m.lower()}_s IS NOT NULL AS BIGINT)" for m in CORE)} AS core_available, {" + ".join(f"coalesce({m.lower()}_s * CAST(0.25 AS DOUBLE), CAST(0 AS DOUBLE))" for m in CORE)} AS ws FROM w)"""


@query(f"{_COMPOSITE} SELECT entity_id, period, sector, core_available, ws AS strict FROM x WHERE core_available = 4")
def composite_strict(spark: SparkSession, sf: str) -> DataFrame:
    return rank.composite(rank.ranks(panel.metrics(spark, sf))).where("strict is not null").drop("renorm")


@query(f"{_COMPOSITE} SELECT entity_id, period, sector, core_available, ws / (core_available * CAST(0.25 AS DOUBLE)) AS renorm FROM x WHERE core_available >= 1")
def composite_renorm(spark: SparkSession, sf: str) -> DataFrame:
    return rank.composite(rank.ranks(panel.metrics(spark, sf))).where("renorm is not null").drop("strict")


@query("WITH o AS (SELECT *, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS seg FROM orders) SELECT o_custkey, o_orderkey, CAST(seg AS BIGINT) AS segment, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey, seg ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM o")
def segmented_sum(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return rank.segmented_sum(orders, ["o_custkey"], ["o_orderkey"], F.col("o_orderstatus") == "P", panel.cents("o_totalprice")).select("o_custkey", "o_orderkey", "segment", "running")


@query("SELECT o_custkey, o_orderkey, CAST(lag(o_orderkey) OVER w IS NULL OR lag(o_orderstatus) OVER w <> o_orderstatus AS INTEGER) AS run_start, CAST(lead(o_orderkey) OVER w IS NULL OR lead(o_orderstatus) OVER w <> o_orderstatus AS INTEGER) AS run_end FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def window_ends(spark: SparkSession, sf: str) -> DataFrame:
    return rank.run_edges(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderkey"]).select("o_custkey", "o_orderkey", "run_start", "run_end")


# release -------------------------------------------------------------------------------------------------------------


@query(f"{GATE} {_GATED}")
def kanon_release(spark: SparkSession, sf: str) -> DataFrame:
    return release.kanon_gate(sector_ratios(panel.aligned(spark, sf)))


@query(f"{GATE}, g AS ({_GATED}), p AS (SELECT sector, period, metric, {PCT} FROM f GROUP BY sector, period, metric) SELECT g.*, {', '.join(f'CASE WHEN released = 1 THEN p{q} ELSE 0 END AS p{q}' for q in (25, 50, 75, 90, 95, 99))} FROM g LEFT JOIN p USING (sector, period, metric)")
def release_exact(spark: SparkSession, sf: str) -> DataFrame:
    return release.exact_release(panel.metrics(spark, sf))


_RELEASED = f"{GATE}, g AS ({_GATED}), p AS (SELECT sector, period, metric, {PCT} FROM f GROUP BY sector, period, metric), e AS (SELECT g.*, {', '.join(f'CASE WHEN released = 1 THEN p{q} ELSE 0 END AS p{q}' for q in (25, 50, 75, 90, 95, 99))} FROM g LEFT JOIN p USING (sector, period, metric))"


@query(f"{_RELEASED} SELECT * FROM e")
def release_json(spark: SparkSession, sf: str) -> DataFrame:
    """The release as JSON rows, read back: nothing may be lost on the way."""
    released = release.exact_release(panel.metrics(spark, sf))
    return release.from_release_json(release.release_json(released), released.schema)


@query(f"""{_RELEASED} SELECT count(*) AS cells, CAST(sum(released) AS BIGINT) AS released, CAST(count(*) FILTER (n_valid < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (released = 0 AND n_valid <> 0) AS BIGINT) AS leaking,
CAST(count(*) FILTER (NOT (coalesce(p25, 0) <= coalesce(p50, 0) AND coalesce(p50, 0) <= coalesce(p75, 0) AND coalesce(p75, 0) <= coalesce(p90, 0) AND coalesce(p90, 0) <= coalesce(p95, 0) AND coalesce(p95, 0) <= coalesce(p99, 0))) AS BIGINT) AS falling FROM e""")
def release_audit(spark: SparkSession, sf: str) -> DataFrame:
    return release.release_audit(release.exact_release(panel.metrics(spark, sf)))


_U = "(CAST(CAST(('0x' || substr(sha256({}), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / CAST(4503599627370496 AS DOUBLE)"


def _cover_sql() -> str:
    key = "'seed|' || sector || '|' || period || '|' || metric"
    parts = [f"floor({_U.format(repr(x + '|') + ' || ' + key)} * 7)" for x in ("u1", "u2")]
    return f"{LONG} SELECT sector, period, metric, n_valid, CAST(n_valid + {parts[0]} + {parts[1]} + 3 AS BIGINT) AS n_covered FROM ({_totals_sql('sector, period, ')})"


@query(_cover_sql())
def cover_firms_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return release.cover_firms(totals(panel.aligned(spark, sf), "sector", "period"), 3, 15, "seed").select(*CELL, "n_valid", "n_covered")


_NORMAL = lambda s, *key: f"CAST(round(CAST('{s!r}' AS DOUBLE) * sqrt(-2 * ln({_U.format(chr(39) + 'u|' + chr(39) + ' || ' + key[0])})) * cos(CAST('{2 * math.pi!r}' AS DOUBLE) * ({_U.format(chr(39) + 'v|' + chr(39) + ' || ' + key[0])}))) AS BIGINT)"
_NOISED = f"""{GATE}, q AS (SELECT sector, period, metric, map_from_entries(list((bucket, cnt))) AS m FROM h GROUP BY ALL),
nh AS (SELECT t.*, list_transform(range(128), lambda b: greatest(0, coalesce(CAST(m[CAST(b AS INTEGER)] AS BIGINT), 0) + {_NORMAL(sigma(math.sqrt(2), 0.1), "'seed|' || sector || '|' || period || '|' || metric || '|' || b")})) AS hist FROM t LEFT JOIN q USING (sector, period, metric))"""


@query(f"{_NOISED} SELECT sector, period, metric, array_to_string(hist, ',') AS hist FROM nh")
def dp_histogram_seeded(spark: SparkSession, sf: str) -> DataFrame:
    m = panel.metrics(spark, sf)
    cells = totals(panel.aligned(spark, sf), "sector", "period").select(*CELL)
    return release.seeded_histogram_noise(dense_histogram(histogram(m), cells), 0.1, "seed").withColumn("hist", F.array_join("hist", ","))


_CLAMPED = f"""{_NOISED}, nb AS (SELECT sector, period, metric, unnest(range(128)) AS bucket, unnest(hist) AS cnt, CASE WHEN sum_den > 0 THEN CAST(sum_num AS DOUBLE) / CAST(sum_den AS DOUBLE) END AS ratio, CAST(n_valid > 0 AS INTEGER) AS ratio_incl FROM nh),
nf AS (SELECT *, sum(cnt) OVER (PARTITION BY sector, period, metric ORDER BY bucket) AS cum, sum(cnt) OVER (PARTITION BY sector, period, metric) AS total FROM nb)"""


@query(f"{_CLAMPED} SELECT sector, period, metric, max(ratio) AS ratio, max(ratio_incl) AS ratio_incl, CAST(max(total) AS BIGINT) AS n_valid, {', '.join(f'CAST(coalesce(min(CASE WHEN total > 0 AND cum >= greatest(1, ({q} * total + 99) // 100) THEN bucket END), 0) AS INTEGER) AS p{q}' for q in (25, 50, 75, 90, 95, 99))} FROM nf GROUP BY sector, period, metric")
def noisy_release_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return release.noisy_release_seeded(panel.metrics(spark, sf), 0.1, "seed").drop("hist")


@query()
def noisy_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return release.noisy_threshold(panel.metrics(spark, sf), release.NoisyThreshold(), RhoBudget(cap=1000.0))


@query(f"{HIST}, t AS ({_totals_sql('sector, period, ')}), s AS (SELECT sector, period, metric, sum(cnt) AS total FROM h GROUP BY ALL) SELECT sector, period, metric, n_valid, CAST(coalesce(total, 0) = n_valid AS INTEGER) AS exact FROM t LEFT JOIN s USING (sector, period, metric)")
def histogram_sums(spark: SparkSession, sf: str) -> DataFrame:
    return release.sums_to_n(histogram(panel.metrics(spark, sf)), totals(panel.aligned(spark, sf), "sector", "period"))


@query(f"""{_NOISED}, g AS ({_GATED}), r AS (SELECT metric, sum(sum_num) AS sn, sum(n_valid) AS n FROM t GROUP BY metric), w AS (SELECT metric, sum(num) AS sn, sum(incl) AS n FROM m GROUP BY metric)
SELECT (SELECT count(*) FROM al) AS aligned_rows, (SELECT count(*) > 0 FROM al) AS alignment_ok, (SELECT CAST(sum(incl) AS BIGINT) FROM m WHERE metric IN ('DTI', 'DSI', 'Delq', 'NPL')) AS core_included,
(SELECT bool_and(coalesce(r.sn, 0) = coalesce(w.sn, 0) AND r.n = w.n) FROM r JOIN w USING (metric)) AS totals_match, (SELECT bool_and(list_min(hist) >= 0) FROM nh) AS bins_not_negative, (SELECT CAST(sum(released) AS BIGINT) FROM g) AS cells_released""")
def pipeline_audit(spark: SparkSession, sf: str) -> DataFrame:
    m, budget = panel.metrics(spark, sf), RhoBudget()
    budget.charge(0.1)
    row, _ = release.pipeline_audit(panel.aligned(spark, sf), m, release.noisy_release_seeded(m, 0.1, "seed"), release.exact_release(m), budget)
    return row.select("aligned_rows", "alignment_ok", "core_included", "totals_match", "bins_not_negative", "cells_released")


def _trials_sql(epsilon: float, subsample: float) -> str:
    u = {x: _U.format(f"'trial|{x}|' || id") for x in ("coin", "sample", "noise")}
    return f"""(SELECT *, CAST(100 + counted - sign(u) * ln(1 - least(2 * abs(u), CAST(0.999999 AS DOUBLE))) / CAST({epsilon} AS DOUBLE) > CAST({100 + 0.5 * subsample} AS DOUBLE) AS INTEGER) AS guess
FROM (SELECT CAST({u["coin"]} < 0.5 AS INTEGER) AS member, CAST({u["coin"]} < 0.5 AND {u["sample"]} < {subsample} AS INTEGER) AS counted, {u["noise"]} - 0.5 AS u FROM range(4000) r(id)))"""


@query(f"SELECT member, guess, count(*) AS n FROM {_trials_sql(1.0, 1.0)} GROUP BY ALL")
def membership_trials(spark: SparkSession, sf: str) -> DataFrame:
    return attack_trials(spark, 4000, 1.0).groupBy("member", "guess").agg(F.count("*").alias("n"))


SWEEP = ((0.5, 1.0), (1.0, 1.0), (2.0, 1.0), (2.0, 0.5), (2.0, 0.1))


@query(" UNION ALL ".join(f"SELECT CAST({e} AS DOUBLE) AS noise_epsilon, CAST({q} AS DOUBLE) AS subsample, trials, accuracy, advantage, round(ln((0.5 + advantage) / (0.5 - advantage)), 9) AS epsilon FROM (SELECT count(*) AS trials, avg(CAST(member = guess AS DOUBLE)) AS accuracy, abs(avg(CAST(member = guess AS DOUBLE)) - 0.5) AS advantage FROM {_trials_sql(e, q)})" for e, q in SWEEP))
def attack_sweep(spark: SparkSession, sf: str) -> DataFrame:
    parts = [attack_report(attack_trials(spark, 4000, e, subsample=q)).select(F.lit(e).alias("noise_epsilon"), F.lit(q).alias("subsample"), "trials", "accuracy", "advantage", F.round("epsilon", 9).alias("epsilon")) for e, q in SWEEP]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"SELECT round(avg(x), 9) AS mean, round(var_pop(x), 6) AS variance, count(DISTINCT x) AS unique_values, CAST(10 AS DOUBLE) AS target_variance, abs(var_pop(x) - 10) / 10 < 0.2 AS passes FROM (SELECT {_NORMAL(math.sqrt(10), chr(39) + 'noise|' + chr(39) + ' || id')} AS x FROM range(20000) r(id))")
def noise_quality(spark: SparkSession, sf: str) -> DataFrame:
    found = noise_report(noise_draws(spark, 20_000, math.sqrt(10)), math.sqrt(10))
    return found.withColumns({"mean": F.round("mean", 9), "variance": F.round("variance", 6), "target_variance": F.round("target_variance", 9)})


# sets and joins ------------------------------------------------------------------------------------------------------

YEARS = (1995, 1996, 1997)
_PARTIES = ", ".join(f"p{i} AS (SELECT o_custkey AS id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders WHERE year(o_orderdate) = {y} GROUP BY o_custkey)" for i, y in enumerate(YEARS))
_MASK = " UNION ALL ".join(f"SELECT id, {1 << i} AS bit FROM p{i}" for i in range(3))
_VENN = f"WITH {_PARTIES}, k AS (SELECT id, CAST(bit_or(bit) AS INTEGER) AS mask FROM ({_MASK}) GROUP BY id), v AS (SELECT mask, count(*) AS n FROM k GROUP BY mask)"


def parties(spark: SparkSession, sf: str) -> list[DataFrame]:
    orders = table(spark, sf, "orders")
    return [orders.where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("id")).agg(F.sum(panel.cents("o_totalprice")).alias("value")) for y in YEARS]


@query(f"{_VENN} SELECT id FROM k WHERE mask = 7")
def party_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return setops.intersection(parties(spark, sf))


@query(f"{_VENN} SELECT id FROM k")
def party_union(spark: SparkSession, sf: str) -> DataFrame:
    return setops.union(parties(spark, sf))


@query(f"{_VENN} SELECT id, CAST(mask = 7 AS INTEGER) AS in_all FROM k WHERE mask & 1 = 1")
def party_membership(spark: SparkSession, sf: str) -> DataFrame:
    p = parties(spark, sf)
    return setops.membership(p[0], p[1:])


@query(f"{_VENN} SELECT count(*) AS n FROM k WHERE mask = 7")
def intersection_card(spark: SparkSession, sf: str) -> DataFrame:
    return setops.cardinality(parties(spark, sf))


@query(f"WITH {_PARTIES} SELECT count(*) AS n, CAST(coalesce(sum(p1.value + p2.value), 0) AS BIGINT) AS total FROM p0 JOIN p1 USING (id) JOIN p2 USING (id)")
def intersection_sum(spark: SparkSession, sf: str) -> DataFrame:
    return setops.cardinality_sum(parties(spark, sf))


@query(f"WITH {_PARTIES} SELECT c_nationkey + 1 AS sector, count(*) AS n, CAST(coalesce(sum(p1.value + p2.value), 0) AS BIGINT) AS total FROM p0 JOIN p1 USING (id) JOIN p2 USING (id) JOIN customer ON id = c_custkey GROUP BY 1")
def sector_intersection_sum(spark: SparkSession, sf: str) -> DataFrame:
    sector = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 1).alias("sector"))
    return setops.cardinality_sum([p.join(sector, "id") for p in parties(spark, sf)], by="sector")


@query(f"{_VENN} SELECT * FROM v")
def venn_cells(spark: SparkSession, sf: str) -> DataFrame:
    return setops.venn_cells(parties(spark, sf))


@query(f"{_VENN} SELECT CAST(b AS INTEGER) AS mask, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM range(1, 8) t(b) LEFT JOIN v ON v.mask & b = b GROUP BY b")
def zeta_counts(spark: SparkSession, sf: str) -> DataFrame:
    return setops.zeta(setops.venn_cells(parties(spark, sf)), 3)


@query(f"{_VENN} SELECT CAST(b AS INTEGER) AS mask, CAST(coalesce(max(n), 0) AS BIGINT) AS n FROM range(1, 8) t(b) LEFT JOIN v ON v.mask = b GROUP BY b")
def moebius_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return setops.moebius(setops.zeta(setops.venn_cells(parties(spark, sf)), 3))


@query(f"{_VENN} SELECT mask, n, 1.0 / CAST(n AS DOUBLE) AS risk, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS padded FROM v")
def venn_risk(spark: SparkSession, sf: str) -> DataFrame:
    return setops.identification_risk(setops.venn_cells(parties(spark, sf)))


@query(f"WITH {_PARTIES} SELECT id, p1.value AS value_2, p2.value AS value_3 FROM p0 JOIN p1 USING (id) JOIN p2 USING (id)")
def party_values(spark: SparkSession, sf: str) -> DataFrame:
    p = parties(spark, sf)
    return setops.party_values(p[0], p[1:])


@query(f"{_VENN} SELECT id FROM k WHERE mask = 7 AND (SELECT count(*) FROM k WHERE mask = 7) >= 5")
def threshold_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return setops.require(parties(spark, sf), 5)


_LAPLACE = f"(SELECT {_U.format(chr(39) + 'laplace|seed' + chr(39))} - 0.5 AS u)"


@query(f"{_VENN} SELECT round((SELECT count(*) FROM k WHERE mask = 7) - sign(u) * ln(1 - least(2 * abs(u), CAST(0.999999 AS DOUBLE))) / CAST(0.5 AS DOUBLE), 6) AS noisy FROM {_LAPLACE}")
def noisy_cardinality_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return setops.seeded_noisy_cardinality(parties(spark, sf), 0.5, "seed").select(F.round("noisy", 6).alias("noisy"))


@query(f"SELECT c_custkey FROM customer WHERE {_U.format(chr(39) + 'sample|seed|' + chr(39) + ' || c_custkey')} < 0.25")
def poisson_subsample(spark: SparkSession, sf: str) -> DataFrame:
    return setops.subsampled(table(spark, sf, "customer").select("c_custkey"), 0.25, "seed", "c_custkey")


@query("SELECT o_custkey AS id, o_orderkey AS payload FROM orders ORDER BY o_orderkey LIMIT 100")
def truncate_to_k(spark: SparkSession, sf: str) -> DataFrame:
    return setops.truncated(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("payload")), 100, "payload")


_SUMMED = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query(f"SELECT {', '.join(f'CAST(sum(CAST((chr(48) || chr(120) || substr(sha256(coalesce(CAST({c} AS VARCHAR), chr(0))), 1, 15)) AS BIGINT)) AS DECIMAL(38,0)) AS {c}' for c in _SUMMED)} FROM customer")
def column_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Of the rows after a random permutation; SQL adds up the table as it is."""
    return setops.column_sums(setops.shuffled(table(spark, sf, "customer").select(*_SUMMED), 7))


@query("SELECT c_custkey, lower(rpad(hex(c_name), 64, '0'))[1:32] AS c_name_b0, lower(rpad(hex(c_name), 64, '0'))[33:64] AS c_name_b1 FROM customer")
def payload_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = hex_blocks(F.col("c_name"), 2)
    return table(spark, sf, "customer").select("c_custkey", *(b.alias(f"c_name_b{i}") for i, b in enumerate(blocks)))


@query("SELECT c_custkey, sha256(strlen(c_name) || ':' || c_name || strlen(c_mktsegment) || ':' || c_mktsegment) AS digest FROM customer")
def prefixed_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.sha2(length_prefixed(F.col("c_name"), F.col("c_mktsegment")), 256).alias("digest"))


_FP = "CAST(floor({} * 4294967296.0::DOUBLE) AS HUGEINT)"


@query(f"SELECT p_partkey, CAST(({_FP.format('p_retailprice')} * {_FP.format('p_size / 64.0::DOUBLE')}) // 4294967296 AS DECIMAL(38,0)) AS product, CAST(4294967296 // p_size AS DECIMAL(38,0)) AS reciprocal, abs(p_size * (4294967296 // p_size) - 4294967296) <= p_size AS holds FROM part")
def fixed_point_product(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    reciprocal = F.call_function("div", F.lit(1 << 32), size).cast("decimal(38,0)")
    return table(spark, sf, "part").select("p_partkey", fixed_multiply(fixed(F.col("p_retailprice")), fixed(F.col("p_size") / 64.0)).alias("product"), reciprocal.alias("reciprocal"), reciprocal_holds(size, reciprocal).alias("holds"))


def _order_rows(spark: SparkSession, sf: str, year: int) -> DataFrame:
    return table(spark, sf, "orders").where(F.year("o_orderdate") == year).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("payload"))


@query("WITH a AS (SELECT o_custkey AS id, min(o_orderkey) AS payload_a FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1) SELECT payload_a, o_orderkey AS payload_b FROM a JOIN orders ON id = o_custkey WHERE year(o_orderdate) = 1996")
def psa2_join(spark: SparkSession, sf: str) -> DataFrame:
    return setops.two_party_join(_order_rows(spark, sf, 1995), _order_rows(spark, sf, 1996), order="payload")


@query(f"WITH {_PARTIES} SELECT id, p0.value AS value_1, p1.value AS value_2, p2.value AS value_3 FROM p0 JOIN p1 USING (id) JOIN p2 USING (id)")
def nparty_join(spark: SparkSession, sf: str) -> DataFrame:
    return setops.party_join(parties(spark, sf))


@query("SELECT a.o_custkey AS id, a.o_orderkey AS payload_1, b.o_orderkey AS payload_2, c.o_orderkey AS payload_3 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey JOIN orders c ON a.o_custkey = c.o_custkey WHERE year(a.o_orderdate) = 1995 AND year(b.o_orderdate) = 1996 AND year(c.o_orderdate) = 1997")
def table_join(spark: SparkSession, sf: str) -> DataFrame:
    return setops.table_join([_order_rows(spark, sf, y) for y in YEARS], cap=64)


@query("SELECT o_custkey AS id, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1 HAVING count(*) > 2")
def table_join_cap_check(spark: SparkSession, sf: str) -> DataFrame:
    return setops.over_cap(_order_rows(spark, sf, 1995), 2)


_X, _Y, _Z = (CENTS.format(x) for x in ("l_extendedprice", "l_discount", "l_tax"))


@query(f"SELECT l_orderkey, l_linenumber, CAST((({_X} + {_Y}) * CAST(1000000 AS HUGEINT)) // (CASE WHEN {_Z} = 0 THEN 1 ELSE {_Z} END) AS BIGINT) AS result, CAST({_Z} = 0 AS INTEGER) AS zero_den FROM lineitem")
def ratio_xyz(spark: SparkSession, sf: str) -> DataFrame:
    value, zero = fixed_point_ratio(*(panel.cents(c) for c in ("l_extendedprice", "l_discount", "l_tax")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", value.alias("result"), zero.cast("int").alias("zero_den"))


@query()
def guarded_release(spark: SparkSession, sf: str) -> DataFrame:
    import os
    import tempfile

    from .operators.privacy import EpsilonLedger

    with tempfile.TemporaryDirectory() as folder:
        found = setops.guarded_aggregate(parties(spark, sf), 1.0, 10**8, 5, EpsilonLedger(os.path.join(folder, "ledger.json"), 10.0), "query")
    return spark.createDataFrame([(found["released"], found["n"], found["total"])], "released boolean, n long, total long")


# boosting, generator, events -----------------------------------------------------------------------------------------

_FEATURES = ["l_quantity", "l_linenumber"]


def _training(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_quantity"), F.col("l_linenumber").cast("double").alias("l_linenumber"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


@query("SELECT 1 AS node, -sum(0.5 - y) / (0.25 * count(*) + 1) AS leaf, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE 0 END AS y FROM lineitem)")
def gbdt_leaf_values(spark: SparkSession, sf: str) -> DataFrame:
    g, h = gbdt.gradients(F.lit(0.0), F.col("label"))
    return gbdt.leaf_values(_training(spark, sf).select(F.lit(1).alias("node"), g.alias("g"), h.alias("h")))


@query("""WITH r AS (SELECT unnest(['l_quantity', 'l_linenumber']) AS feature, unnest([l_quantity, CAST(l_linenumber AS DOUBLE)]) AS v, 0.5 - CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE 0 END AS g, CAST(0.25 AS DOUBLE) AS h FROM lineitem),
s AS (SELECT feature, v, sum(g) AS g, sum(h) AS h FROM r GROUP BY feature, v),
c AS (SELECT feature, v, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER p AS gt, sum(h) OVER p AS ht, row_number() OVER u AS rk, count(*) OVER p AS k FROM s WINDOW p AS (PARTITION BY feature), u AS (PARTITION BY feature ORDER BY v)),
e AS (SELECT feature, v AS threshold, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM c WHERE (rk - 1) % greatest(1, k // 16) = 0 AND rk - 1 < greatest(1, k // 16) * ((k - 1) // greatest(1, k // 16)))
SELECT 1 AS node, feature, threshold, gain FROM e WHERE gain > 0 ORDER BY gain DESC, feature, threshold LIMIT 1""")
def gbdt_split_search(spark: SparkSession, sf: str) -> DataFrame:
    g, h = gbdt.gradients(F.lit(0.0), F.col("label"))
    return gbdt.split_search(_training(spark, sf).select(F.lit(1).alias("node"), g.alias("g"), h.alias("h"), *_FEATURES), _FEATURES)


@query()
def gbdt_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training(spark, sf)
    p = gbdt.Params(trees=8, depth=3)
    trees = gbdt.fit(rows, _FEATURES, "label", p)
    return gbdt.predict(rows, trees, p).groupBy("label", "predicted").agg(F.count("*").alias("n"))


@query()
def synthetic_panel_cells(spark: SparkSession, sf: str) -> DataFrame:
    return release.kanon_gate(sector_ratios(firm_panel(spark, 1_000_000)))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return event_cells(table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


__all__ = ["ORACLE_SQL", "QUERIES"]
