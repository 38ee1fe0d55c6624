"""Small fixtures for every phase, with known results."""

import pytest
from pyspark.sql import functions as F

from sectorlens.functions.columns import bucket_index, canonical_id
from sectorlens.functions.edges import linear_edges, log_edges
from sectorlens.operators.aggregate import cdf, histogram, interpolated, percentiles, sector_ratios
from sectorlens.operators.align import align, alignment_audit
from sectorlens.operators.metrics import coverage, entity_metrics, totals
from sectorlens.operators.prep import DuplicateEntity, duplicates, growth, prepare
from sectorlens.operators.rank import composite, ranks
from sectorlens.operators.release import kanon_gate
from sectorlens.schema import INCOME, LENDING, METRICS, WORKFORCE


def frame(spark, rows, attributes):
    columns = ["entity_id", "period", "sector", *attributes]
    schema = "entity_id string, period int, sector int, " + ", ".join(f"{a} long" for a in attributes)
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


FULL = {"total_outstanding_debt": 10_000_000, "annual_income": 50_000_000, "employment_count": 100, "delinquent_loan_balance": 1_000_000, "nonperforming_loan_balance": 500_000, "annual_debt_service": 2_000_000, "unsecured_loan_balance": 3_000_000, "debt_due_within_12_months": 4_000_000, "g_debt": 100, "g_income": 50}


def firm(spark, a=True, b=True, c=True, **change):
    r = {"entity_id": "x", "period": 20263, "sector": 10, **FULL, **change}
    one = lambda there, cols: frame(spark, [r] if there else [], cols)
    return align(one(a, [*LENDING, "g_debt"]), one(b, [*INCOME, "g_income"]), one(c, list(WORKFORCE)))


def included(metrics):
    return {r.metric for r in metrics.where("incl = 1").collect()}


def test_canonical_ids(spark):
    raw = ["ACME  PTE   LTD (200812345K)", "acme pte ltd 200812345k", " ACME-PTE-LTD-200812345K ", "BETA CORP 199988877A"]
    ids = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "r string").select(canonical_id(F.col("r"))).collect()]
    assert len(set(ids[:3])) == 1 and ids[3] != ids[0]


def test_prepare_status_and_warnings(spark):
    rows = spark.createDataFrame([("a", 20261, 1, None, 5, -1)], "raw_entity_id string, period int, sector int, annual_income long, revenue long, operating_surplus long")
    r = prepare(rows, INCOME).first()
    assert (r.annual_income, r.annual_income_nm, r.annual_income_ok) == (None, 0, 0)
    assert (r.revenue, r.revenue_nm, r.revenue_ok) == (5, 1, 1)
    assert (r.operating_surplus, r.operating_surplus_nm, r.operating_surplus_ok) == (None, 1, 0)
    assert r.warnings == "annual_income: missing; operating_surplus: out of range"


def test_duplicates(spark):
    raw = ["ACME 200812345K", "BETA 199988877A", "acme 200812345k", "GAMMA 200455566B", " ACME  200812345K "]
    rows = spark.createDataFrame(list(enumerate(raw)), "pos int, r string").select("pos", canonical_id(F.col("r")).alias("id"), F.lit(1).alias("period"))
    assert sorted(r.pos for r in duplicates(rows, ["id", "period"], "pos").collect()) == [2, 4]


def test_alignment(spark):
    a = frame(spark, [{"entity_id": k, "period": 1, "sector": 10, "total_outstanding_debt": 1} for k in ("100", "200")], list(LENDING))
    b = frame(spark, [{"entity_id": "100", "period": 1, "sector": 99, "annual_income": 2}], list(INCOME))
    c = frame(spark, [{"entity_id": "200", "period": 1, "sector": 10}], list(WORKFORCE))
    rows = {r.entity_id: r for r in align(a, b, c).collect()}
    assert len(rows) == 2
    assert (rows["100"].has_a, rows["100"].has_b, rows["100"].has_c, rows["100"].sector, rows["100"].sector_conflict) == (1, 1, 0, 10, 1)
    assert rows["200"].sector_conflict == 0 and alignment_audit(align(a, b, c)).first().conflicts == 1
    with pytest.raises(DuplicateEntity) as e:
        align(a.unionByName(a), b, c, check=True)
    assert "100" not in str(e.value)


@pytest.mark.parametrize(
    ("change", "out"),
    [({}, set()), ({"annual_income": None}, {"DTI", "DSI", "IPW"}), ({"annual_income": 0}, {"DTI", "DSI"}), ({"annual_income": 2 * 10**17}, {"DTI", "DSI"})],
)
def test_inclusion(spark, change, out):
    assert included(entity_metrics(firm(spark, **change))) == {m.name for m in METRICS} - out


def test_inclusion_by_source_and_coverage(spark):
    only_a = entity_metrics(firm(spark, b=False, c=False))
    assert included(only_a) == {"Delq", "NPL", "UnsecShare", "StDebtShare"}
    r = coverage(entity_metrics(firm(spark, annual_income=None))).first()
    assert (r.core_available, r.incl_strict, r.incl_renorm) == (2, 0, 1)


def test_gap_is_signed(spark):
    gap = {r.metric: r.num for r in entity_metrics(firm(spark, g_debt=30, g_income=80)).collect()}["Gap"]
    assert gap == -50


@pytest.mark.parametrize(("num", "den", "scale", "edges", "want"), [(250, 1, 1, (0, 1000, 10), 2), (50, 1, 1, (100, 1000, 10), 0), (2000, 1, 1, (100, 1000, 10), 9), (100, 1, 1, (100, 1000, 10), 0), (250, 0, 1, (0, 1000, 10), 0), (30000, 100000, 10000, (0, 10000, 128), 38), (500, 100000, 10000, (0, 10000, 128), 0), (8000, 100000, 10000, (0, 10000, 128), 10)])
def test_bucket_index(spark, num, den, scale, edges, want):
    row = spark.createDataFrame([(num, den)], "n long, d long")
    got = row.select(bucket_index(F.col("n"), F.col("d"), scale, linear_edges(*edges), F.lit(True)).alias("b"), bucket_index(F.col("n"), F.col("d"), scale, linear_edges(*edges), F.lit(False)).alias("z")).first()
    assert (got.b, got.z) == (want, 0)


def test_log_edges():
    e = log_edges(1, 10**8, 128)
    assert e[0] == 1 and e[-1] == 10**8 and all(a < b for a, b in zip(e, e[1:], strict=False)) and len(e) == 129


def buckets(spark, counts, sector=1):
    rows = [(sector, 1, "DTI", b, n) for b, n in enumerate(counts) if n]
    return spark.createDataFrame(rows, "sector int, period int, metric string, bucket int, cnt long")


def test_cdf_and_percentiles(spark):
    assert [r.cum for r in cdf(buckets(spark, [1, 3, 2, 4])).orderBy("bucket").collect()] == [1, 4, 6, 10]
    r = percentiles(buckets(spark, [10] * 10)).first()
    assert (r.p25, r.p50, r.p75, r.p90, r.p95, r.p99) == (2, 4, 7, 8, 9, 9)
    assert percentiles(buckets(spark, [2] * 5), (50,)).first().p50 == 2
    assert percentiles(buckets(spark, [0, 0, 5, 3, 0, 2]), (1, 100)).first()[-2:] == (2, 5)
    assert interpolated(buckets(spark, [10] * 10), 50).first().q50 == pytest.approx(linear_edges(0, 10_000, 128)[5])


def metric_rows(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, period int, sector int, metric string, num long, den long, incl int, bucket int")


def test_ranks_and_scores(spark):
    rows = [(f"e{i}", 1, 1, "DTI", 1, 1, 1, b) for i, b in enumerate((10, 4, 7, 4))] + [("x", 1, 1, "DTI", None, None, 0, 0), ("s", 1, 2, "DTI", 1, 1, 1, 3)]
    got = {r.entity_id: (r.rank, r.n_valid, r.score) for r in ranks(metric_rows(spark, rows)).collect()}
    assert got == {"e1": (0, 4, 0.0), "e3": (1, 4, 1 / 3), "e2": (2, 4, 2 / 3), "e0": (3, 4, 1.0), "x": (0, 4, 0.0), "s": (0, 1, 0.0)}


def test_composite(spark):
    scored = spark.createDataFrame([("a", 1, 1, m, 1, s) for m, s in (("DTI", 0.2), ("DSI", 0.4), ("Delq", 0.6), ("NPL", 0.8))] + [("b", 1, 1, "DTI", 1, 0.4), ("b", 1, 1, "NPL", 1, 0.8)], "entity_id string, period int, sector int, metric string, incl int, score double")
    got = {r.entity_id: r for r in composite(scored).collect()}
    assert (got["a"].strict, got["a"].core_available) == (pytest.approx(0.5), 4)
    assert got["b"].strict is None and got["b"].renorm == pytest.approx(0.6)


def test_cells_and_gate(spark):
    rows = [("a", 1, 1, "DTI", 30000, 100000, 1, 38), ("b", 1, 1, "DTI", 50000, 100000, 1, 64), ("c", 1, 2, "DTI", None, None, 0, 0)]
    cells = {r.sector: r for r in sector_ratios(metric_rows(spark, rows)).collect()}
    assert cells[1].ratio == 0.4 and (cells[2].incl, cells[2].sum_den, cells[2].ratio) == (0, 0, None)
    assert histogram(metric_rows(spark, rows)).count() == 2
    assert totals(metric_rows(spark, rows)).first().n_valid == 2
    many = spark.createDataFrame([(s, 1, "DTI", n, n, n) for s, n in ((1, 2), (2, 5), (3, 8))], "sector int, period int, metric string, sum_num long, sum_den long, n_valid long")
    assert {r.sector: (r.n_valid, r.sum_num) for r in kanon_gate(many, 5).collect()} == {1: (0, 0), 2: (5, 5), 3: (8, 8)}


def test_growth(spark):
    rows = spark.createDataFrame([("a", 20261, 100), ("a", 20262, 150), ("a", 20264, 900), ("b", 20254, 300), ("b", 20261, 200), ("b", 20262, 10**6)], "entity_id string, period int, v long")
    got = {(r.entity_id, r.period): r.g for r in growth(rows, "v", "g").collect()}
    assert got == {("a", 20261): None, ("a", 20262): 5000, ("a", 20264): None, ("b", 20254): None, ("b", 20261): -3333, ("b", 20262): 10000}
