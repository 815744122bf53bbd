"""Edge cases of retrieval and evaluation operators, and the label golden numbers."""

import pytest

from spanforge.operators import evaluation as E
from spanforge.operators import labeling as L
from spanforge.operators import markdown as M
from spanforge.operators import retrieval as R

HITS = "query_id int, id int, score double"


def _cut(spark, scores, **how):
    rows = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], HITS)
    return [r["id"] for r in R.adaptive_cutoff(rows, 4.0, **how).orderBy("rank").collect()]


def test_cutoff(spark):
    assert _cut(spark, [5, 4, 3, 2], top_k=10) == [0, 1, 2]
    assert _cut(spark, [1, 1, 1, 1], top_k=10) == [0, 1, 2]
    assert _cut(spark, [9, 8, 7, 6], top_k=1) == [0, 1, 2]
    assert _cut(spark, [9, 8, 7, 6], top_k=1, strict=True) == [0]
    assert _cut(spark, [9, 9, 9, 9, 9], top_k=4) == [0, 1, 2, 3]
    assert _cut(spark, [2, 1], top_k=5) == [0, 1]


def test_dbsf_single_hit_no_spread_and_scale(spark):
    legs = [(1, 0, 7, 3.0), (1, 1, 7, 2.0), (1, 1, 8, 2.0)]
    schema = "query_id int, leg int, id int, score double"
    got = {r["id"]: r["score"] for r in R.dbsf(spark.createDataFrame(legs, schema), 10).collect()}
    assert got == {7: 1.0, 8: 0.5}
    rows = [(1, 0, i, float(s)) for i, s in enumerate([1, 2, 4, 8])]
    one = R.dbsf(spark.createDataFrame(rows, schema), 10).collect()
    two = R.dbsf(spark.createDataFrame([(q, leg, i, 3 * s + 5) for q, leg, i, s in rows], schema), 10).collect()
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in two], abs=1e-5)


def test_dedup_does_not_fill_up(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "a", 2), (1, 3, None, 3), (1, 4, "", 4), (1, 5, "b", 5)], "query_id int, id int, parent_id string, rank int")
    once = R.dedup_parents(rows)
    assert [r["id"] for r in once.orderBy("rank").collect()] == [1, 3, 5]
    assert R.dedup_parents(once).count() == 3


def test_dense_leg_checks_its_batch(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, None)], "id long, embedding array<double>")
    assert [(r["id"], r["score"]) for r in R.dense_leg(q, p).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert R.dense_leg(q.limit(0), p).count() == 0


def test_dense_leg_takes_any_number_of_queries(spark, monkeypatch):
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(7)], "query_id long, vector array<double>")
    p = spark.createDataFrame([(k, [1.0, k / 2]) for k in range(20)], "id long, embedding array<double>")
    want = sorted(map(tuple, R.dense_leg(q, p, 3).collect()))
    monkeypatch.setattr(R, "MAX_QUERIES", 3)
    assert sorted(map(tuple, R.dense_leg(q, p, 3).collect())) == want and len(want) == 21


def test_grep_rejects_a_broken_pattern(spark):
    lines = spark.createDataFrame([("b", 0, "x")], "book string, ln int, line string")
    with pytest.raises(ValueError):
        R.grep(lines, "(", 5, 1)


def test_judge_agreement_golden(spark):
    # 60 pairs with the published summary: exact .683, within one 1.0, precision .95, recall .905
    cells = {(0, 0): 16, (0, 1): 2, (1, 0): 4, (1, 1): 13, (1, 2): 8, (2, 1): 5, (2, 2): 12}
    pairs = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "a int, b int")
    row = E.judge_agreement(pairs).first()
    assert (row["n"], round(row["exact"], 3), row["within_one"], round(row["precision"], 2), round(row["recall"], 3), row["passes"]) == (60, 0.683, 1.0, 0.95, 0.905, True)
    assert E.confusion(pairs).count() == 9


def test_mde_golden(spark):
    got = [r["mde"] for r in E.mde_table(spark, 0.2437, 440, [0.5, 0.7, 0.9]).orderBy("rho").collect()]
    assert got == [0.0326, 0.0252, 0.0146]


def test_graded_equals_binary_ndcg_with_equal_grades(spark):
    run = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id int, id int, rank int")
    import math

    qrels = spark.createDataFrame([(1, 2, 1), (1, 9, 1)], "query_id int, id int, grade int")
    want = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert E.graded_ndcg(run, qrels).first()["ndcg"] == pytest.approx(want)


def test_significance_tails():
    assert E.sign_test(0, 0) == 1.0 and E.sign_test(5, 5) == 1.0
    assert E.sign_test(10, 0) == pytest.approx(2 / 1024)
    assert E.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-5)
    assert E.verdict(0.1, 0.2, [0.01, 0.2]) and not E.verdict(-0.1, 0.2, [0.01])


def test_no_spread_gives_no_error(spark):
    pairs = spark.createDataFrame([(i, 0.5, 0.5, 0.0) for i in range(3)], "query_id int, x double, y double, delta double")
    row = E.paired_summary(pairs).first()
    assert row["rho"] == 0.0 and row["sd_delta"] == 0.0
    assert E.wilcoxon_sums(pairs).first()["z"] == 0.0


def test_bootstrap_replays_one_generator(spark):
    import random

    values = [0.4, -0.1, 0.0, 0.25, 0.3, -0.2, 0.1]
    got = E.bootstrap_ci(spark.createDataFrame(list(enumerate(values)), "query_id int, delta double"), resamples=400).first()
    rng = random.Random(42)
    means = []
    for _ in range(400):
        drawn = rng.choices(values, k=len(values))
        means.append(sum(drawn) / len(values))
    means.sort()
    assert (got["n"], got["low"], got["high"]) == (len(values), means[10], means[390]) and got["mean"] == pytest.approx(sum(values) / len(values))


def test_bootstrap_is_repeatable(spark):
    pairs = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "query_id int, delta double")
    assert E.bootstrap_ci(pairs, resamples=200).collect() == E.bootstrap_ci(pairs, resamples=200).collect()


def test_scrub_and_grades(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": [{"a": 2, "c": 3}]}',), ("no json",), (None,)], "j string")
    got = [(r["j"], r["removed"]) for r in L.scrub(rows, "j", {"a"}).collect()]
    assert got == [('{"b":[{"c":3}]}', 2), ("no json", 0), (None, 0)]
    reply = spark.createDataFrame([("ok [5, -1, 1]",), ("none",)], "r string")
    assert [r[0] for r in reply.select(L.parse_grades(reply["r"])).collect()] == [[2, 0, 1], None]


def test_matter_beyond_the_cap_is_not_trusted(spark):
    md = "# Real start\n" + "x\n" * 10 + "# Chapter 1\nlate\n# Index\na, 1"
    row = M.strip_matter(spark.createDataFrame([("s", md)], "slug string, markdown string")).first()
    assert row["markdown"].startswith("# Real start") and "Index" not in row["markdown"]
