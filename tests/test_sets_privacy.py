"""Set operations, joins, accountants, audit chain, boosting, sources."""

import math

import pytest
from pyspark.sql import functions as F

from sectorlens.operators import gbdt, setops
from sectorlens.operators.audit import AuditLog, Config, MetricsText
from sectorlens.operators.privacy import BudgetExceeded, EpsilonLedger, RhoBudget, cover, sigma
from sectorlens.operators.release import NoisyThreshold, noisy_threshold
from sectorlens.sources.files import binary_blocks, block_id, party_csv
from sectorlens.sources.generate import firm_panel, party_set


def party(spark, ids, **value):
    return spark.createDataFrame([(i, 100 * i) for i in ids], "id long, value long")


def test_intersection_of_many(spark):
    parties = [party(spark, range(i + 1, i + 65)) for i in range(3)]
    r = setops.cardinality_sum(parties).first()
    assert r.n == 62 and r.total == 2 * 100 * sum(range(3, 65))
    assert setops.union(parties).count() == 66
    repeated = [parties[0].unionByName(parties[0]), *parties[1:]]
    assert setops.cardinality(repeated).first().n == 62


def test_venn_zeta_moebius(spark):
    sets = [{i for i in range(200) if i % m} for m in (2, 3, 5, 7)]
    cells = setops.venn_cells([party(spark, s) for s in sets])
    zeta = {r.mask: r.n for r in setops.zeta(cells, 4).collect()}
    for mask in range(1, 16):
        assert zeta[mask] == len(set.intersection(*(s for i, s in enumerate(sets) if mask >> i & 1)))
    back = {r.mask: r.n for r in setops.moebius(setops.zeta(cells, 4)).collect() if r.n}
    assert back == {r.mask: r.n for r in cells.collect()}


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"{i}-{k}") for k, i in enumerate(ids)], "id long, p string")


def test_table_joins(spark):
    assert setops.table_join([rows(spark, 10, 10), rows(spark, 10, 10)], 2).count() == 4
    three = setops.table_join([rows(spark, 42, 42, 1), rows(spark, 42, 42, 2), rows(spark, 42, 42, 3)], 2)
    assert three.count() == 8 and {r.id for r in three.collect()} == {42}
    with pytest.raises(setops.TooManyRows):
        setops.table_join([rows(spark, 1, 1, 1), rows(spark, 1)], 2)
    assert setops.pad_to(rows(spark, 1, 2), 5).count() == 5


def test_accountants(tmp_path):
    assert sigma(math.sqrt(2), 0.5) == pytest.approx(math.sqrt(2)) and sigma(math.sqrt(2), 0.1) == pytest.approx(math.sqrt(10))
    b = RhoBudget(cap=0.11)
    for _ in range(5):
        b.charge(0.02)
    assert b.spent == pytest.approx(0.1) and b.queries == 5
    with pytest.raises(BudgetExceeded):
        b.charge(0.02)
    ledger = EpsilonLedger(str(tmp_path / "l.json"), 1.5)
    ledger.reserve("s", 1.0)
    with pytest.raises(BudgetExceeded):
        ledger.reserve("s", 1.0)
    assert ledger.peek("s") == (1.0, 1)
    ledger.reset("s")
    assert ledger.peek("s") == (0.0, 0)
    draws = [cover(3, 15) for _ in range(500)]
    assert min(draws) >= 3 and max(draws) <= 15


def test_noisy_threshold(spark):
    one = lambda n, s: [(f"{s}-{i}", 1, s, "DTI", 3, 10, 1, 38) for i in range(n)]
    m = spark.createDataFrame(one(1000, 1), "entity_id string, period int, sector int, metric string, num long, den long, incl int, bucket int")
    budget = RhoBudget(cap=1.0)
    r = noisy_threshold(m, NoisyThreshold(num_max=10, den_max=10), budget).first()
    assert r.released and budget.spent == pytest.approx(0.35) and abs(r.n_valid - 1000) < 60 and len(r.hist) == 128
    few = spark.createDataFrame(one(2, 1), m.schema)
    budget = RhoBudget(cap=1.0)
    r = noisy_threshold(few, NoisyThreshold(k=50), budget).first()
    assert not r.released and r.hist is None and budget.spent == pytest.approx(0.05)
    with pytest.raises(BudgetExceeded):
        noisy_threshold(m, NoisyThreshold(), RhoBudget(cap=0.2))


def test_audit_chain(tmp_path):
    log = AuditLog(str(tmp_path / "a.jsonl"))
    for i in range(3):
        log.append("reason", f"c{i}", i)
    assert log.verify()
    text = (tmp_path / "a.jsonl").read_text().replace('"c1"', '"cX"')
    (tmp_path / "a.jsonl").write_text(text)
    assert not log.verify()


def test_config_and_metrics_text():
    c = Config.parse("k_anonymity = 7 # firms\n\nunknown = 3\nrho_num=0.2\n")
    assert c.k_anonymity == 7 and c.rho_num == 0.2 and not c.problems() and c.digest() != Config().digest()
    with pytest.raises(ValueError, match="line 1"):
        Config.parse("nothing")
    assert Config(k_anonymity=0).problems()
    m = MetricsText()
    m.add("rows", 3)
    m.observe("t", 0.05)
    assert "rows 3" in m.render() and 't_bucket{le="0.1"} 1' in m.render() and 't_bucket{le="0.01"} 0' in m.render()


def test_boosting_learns(spark):
    rows_ = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y")).withColumn("label", ((F.col("x") > 9) & (F.col("y") > 2)).cast("int"))
    trees = gbdt.fit(rows_, ["x", "y"], "label", gbdt.Params(trees=3, depth=2))
    assert gbdt.accuracy(gbdt.predict(rows_, trees), "label") > 0.95


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a1,v"1\na2,v2\r\n')
    assert [(r.id, r.p1) for r in party_csv(spark, str(tmp_path / "p.csv")).orderBy("id").collect()] == [("a1", 'v"1'), ("a2", "v2")]
    (tmp_path / "b.bin").write_bytes(bytes(range(32)))
    assert [r.id for r in binary_blocks(spark, str(tmp_path / "b.bin")).orderBy("i").collect()] == [bytes(range(16)).hex(), bytes(range(16, 32)).hex()]
    ids = spark.createDataFrame([("AB" * 16,), ("xy",)], "r string").select(block_id(F.col("r")).alias("i")).collect()
    assert [r.i for r in ids] == ["ab" * 16, "xy".encode().hex().rjust(32, "0")]
    assert setops.intersection([party_set(spark, i, 30, 10) for i in range(3)]).count() == 10


def test_million_firm_shape(spark):
    from sectorlens.operators.aggregate import sector_ratios
    from sectorlens.operators.metrics import entity_metrics
    from sectorlens.operators.release import kanon_gate

    released = kanon_gate(sector_ratios(entity_metrics(firm_panel(spark, 20_000))))
    assert released.count() == 180 and released.where("released = 1").count() == 160


def test_noisy_release_percentiles(spark):
    rows = [(f"f{i}", 1, 1, "DTI", 3, 10, 1, 38) for i in range(20_000)]
    m = spark.createDataFrame(rows, "entity_id string, period int, sector int, metric string, num long, den long, incl int, bucket int")
    budget = RhoBudget(cap=1.0)
    found = noisy_threshold(m, NoisyThreshold(num_max=10, den_max=10), budget)
    r = found.first()
    assert found.first() == r  # drawn once
    sums = [sum(r.hist[: i + 1]) for i in range(128)]
    for q in (25, 50, 75, 90, 95, 99):
        assert r[f"p{q}"] == next(i for i, c in enumerate(sums) if c >= max(1, -(-q * sums[-1] // 100)))
    assert r.p50 == 38 and min(r.hist) >= 0


def test_attack_noise_and_private_step(spark):
    from sectorlens.operators.privacy import attack_report, attacker_accuracy_bound, basic_composition, clipped_mean_step, gaussian_rdp, laplace, noise_report
    from sectorlens.sources.generate import attack_trials, noise_draws

    full, part = (attack_report(attack_trials(spark, 4000, 2.0, subsample=q)).first() for q in (1.0, 0.1))
    assert 0.5 < full.accuracy < 0.9 and part.advantage < full.advantage and full.epsilon == pytest.approx(math.log((0.5 + full.advantage) / (0.5 - full.advantage)))
    r = noise_report(noise_draws(spark, 20_000, 3.0), 3.0).first()
    assert r.passes and abs(r.mean) < 0.1 and r.unique_values > 10 and not noise_report(noise_draws(spark, 1000, 3.0), 6.0).first().passes
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 100)], "v double")
    assert clipped_mean_step(values, "v", 1e6, 0.0) == pytest.approx(26.5) and clipped_mean_step(values, "v", 10.0, 0.0) == pytest.approx(26.5 + (10 - 30) / 4)
    assert clipped_mean_step(values.limit(0), "v", 1.0, 0.0) == 0.0
    assert attacker_accuracy_bound(0) == 0.5 and attacker_accuracy_bound(10) == pytest.approx(1, abs=1e-5) and basic_composition([(1, 0.1), (2, 0.2)]) == (3, pytest.approx(0.3))
    assert gaussian_rdp(10, 1, 1e-6) < gaussian_rdp(10, 4, 1e-6)
    draws = [laplace(2.0) for _ in range(4000)]
    assert abs(sum(draws)) / 4000 < 0.3 and 1.7 < sum(map(abs, draws)) / 4000 < 2.3


def test_thresholds_and_checksums(spark):
    parties = [party(spark, range(i + 1, i + 65)) for i in range(3)]
    assert setops.require(parties, 62).count() == 62
    with pytest.raises(setops.TooFew):
        setops.require(parties, 63)
    assert abs(setops.noisy_cardinality(parties, 50.0) - 62) < 2
    assert {(r.id, r.value_2, r.value_3) for r in setops.party_values(parties[0], parties[1:]).collect()} == {(i, 100 * i, 100 * i) for i in range(3, 65)}
    changed = parties[0].withColumn("value", F.when(F.col("id") == 5, 1).otherwise(F.col("value")))
    one, two, three = (setops.column_sums(x).first() for x in (parties[0], setops.shuffled(parties[0], 3), changed))
    assert one == two and one.id == three.id and one.value != three.value
    assert [r.id for r in setops.truncated(parties[0], 3).collect()] == [1, 2, 3]
    sampled = setops.subsampled(spark.range(4000), 0.25, "s")
    assert 850 < sampled.count() < 1150 and sampled.exceptAll(setops.subsampled(spark.range(4000), 0.25, "s")).count() == 0


def test_config_rules_and_warnings():
    assert not Config().problems()
    for change in ({"rho_num": 1.5}, {"rho_budget": 11.0}, {"rho_budget": 0.1}, {"delta": 1.0}, {"contribution_clip": 0}, {"k_anonymity": 0}, {"cover_min": 16}, {"cover_max": 10_001}, {"bin_bits": 25}, {"tag_bits": 7}, {"bin_cap": 0}, {"fraction_bits": 97}, {"guard_bits": 0}, {"buckets": 8192}, {"buckets": 100}, {"sessions": 65}):
        assert len(Config(**change).problems()) >= 1, change
    even = Config(delta=1e-13)
    assert not even.warnings() and len(Config(delta=1e-6, buckets=1024, query_cap=10**8, fraction_bits=60).warnings()) == 4


def test_fixed_point(spark):
    from sectorlens.functions.columns import fixed, fixed_multiply, length_prefixed, newton_reciprocal, reciprocal_holds

    for x in (1, 2, 3, 7, 1000, 123_457, 2**31):
        y, moved = newton_reciprocal(x)
        assert y == (1 << 32) // x and moved[-1] == 0 and len(moved) < 64
        row = spark.range(1).select(reciprocal_holds(F.lit(x), F.lit(y)).alias("a"), reciprocal_holds(F.lit(x), F.lit(y + 2)).alias("b")).first()
        assert (row.a, row.b) == (True, False)
    assert spark.range(1).select(fixed_multiply(fixed(F.lit(2.5)), fixed(F.lit(0.5))).alias("p")).first().p == int(1.25 * 2**32)
    r = spark.range(1).select(length_prefixed(F.lit("ab"), F.lit("c")).alias("x"), length_prefixed(F.lit("a"), F.lit("bc")).alias("y")).first()
    assert r.x != r.y


def test_buckets_equal_the_rule_at_every_edge(spark):
    from fractions import Fraction

    from sectorlens.functions.columns import bucket_index
    from sectorlens.schema import METRICS

    for m in METRICS:
        rows = [(max(0, (e * den + d) // m.scale), den) for e in m.edges for den in (1, 7, 10**7) for d in (-1, 0, 1)] + [(10**14, 1), (5, None), (None, 5)]
        got = spark.createDataFrame(rows, "n long, d long").select("n", "d", bucket_index(F.col("n"), F.col("d"), m.scale, m.edges, F.lit(True)).alias("b")).collect()
        for r in got:
            want = 0 if r.n is None or r.d is None else min(len(m.edges) - 2, max(0, sum(e <= Fraction(r.n * m.scale, r.d) for e in m.edges) - 1))
            assert r.b == want, (m.name, r)


def test_boosting_equals_a_plain_version(spark):
    import random

    r = random.Random(3)
    rows_ = [(float(r.randrange(60)), float(r.randrange(5)), r.randrange(2)) for _ in range(500)]
    p = gbdt.Params(trees=2, depth=2)
    trees = gbdt.fit(spark.createDataFrame(rows_, "x double, y double, label int"), ["x", "y"], "label", p)
    margins = [0.0] * len(rows_)
    for tree in trees:
        g = [1 / (1 + math.exp(-m)) - row[2] for m, row in zip(margins, rows_, strict=True)]
        h = [1 / (1 + math.exp(-m)) * (1 - 1 / (1 + math.exp(-m))) for m in margins]
        node = [1] * len(rows_)
        for level in range(p.depth):
            for n in range(1 << level, 2 << level):
                own = [i for i, x in enumerate(node) if x == n]
                score = lambda at, g=g, h=h: sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + p.lam)
                best = (0.0, None, None)
                for f in (0, 1):
                    values = sorted({rows_[i][f] for i in own})
                    step = max(1, len(values) // p.most_candidates)
                    for t in values[::step][:-1]:
                        left, right = ([i for i in own if (rows_[i][f] <= t) == side] for side in (True, False))
                        gain = 0.5 * (score(left) + score(right) - score(own))
                        if gain > best[0] + 1e-12:
                            best = (gain, f, t)
                assert tree.splits.get(n) == (None if best[1] is None else ("xy"[best[1]], best[2]))
                for i in own:
                    node[i] = n if best[1] is None else 2 * n + (rows_[i][best[1]] > best[2])
        leaves = {n: -sum(g[i] for i in range(len(node)) if node[i] == n) / (sum(h[i] for i in range(len(node)) if node[i] == n) + p.lam) for n in set(node)}
        assert tree.leaves == pytest.approx(leaves)
        margins = [m + p.rate * leaves[n] for m, n in zip(margins, node, strict=True)]


def test_blocks_csv(spark, tmp_path):
    from sectorlens.sources.files import write_blocks_csv, write_pairs_csv

    joined = spark.createDataFrame([("a", "xy", "z" * 20)], "id string, p1 string, p2 string")
    write_blocks_csv(joined, str(tmp_path / "b"), 2)
    row = spark.read.csv(str(tmp_path / "b")).first()
    assert list(row) == [x.encode().hex().ljust(64, "0")[i : i + 32] for x in ("xy", "z" * 20) for i in (0, 32)]
    write_pairs_csv(joined, str(tmp_path / "p"))
    assert list(spark.read.csv(str(tmp_path / "p")).first()) == ["xy", "z" * 20]
    with pytest.raises(Exception, match="longer than its blocks"):
        write_blocks_csv(joined, str(tmp_path / "c"), 1)
