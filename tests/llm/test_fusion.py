import random

import pytest
from pyspark.sql import functions as F

from parapheur.llm import fusion

SCHEMA = "row_id INT, run_id INT, field_name STRING, a DOUBLE, b DOUBLE, _bucket STRING"


def fuse(spark, rows):
    df = spark.createDataFrame([(*r, "kept out") for r in rows], SCHEMA)
    out = fusion.reciprocal_rank_fusion(df, ["run_id", "field_name"], {"a": F.col("a"), "b": F.col("b")}, "row_id")
    return {r.row_id: r.asDict() for r in out.collect()}


def brute(rows, k=60):
    out = {}
    for r in rows:
        mates = [x for x in rows if x[1:3] == r[1:3]]
        ranks = {}
        for name, i in (("a", 3), ("b", 4)):
            v = r[i]
            ranks[name] = None if v is None or v != v else 1 + sum(x[i] is not None and x[i] == x[i] and x[i] > v for x in mates)
        rrf = sum((1 / (k + v) if v else 0.0) for v in ranks.values())
        out[r[0]] = {"rank_a": ranks["a"], "rank_b": ranks["b"], "rrf": rrf}
    for r in rows:
        mates = [out[x[0]]["rrf"] for x in rows if x[1:3] == r[1:3]]
        out[r[0]]["fused_rank"] = 1 + sum(m > out[r[0]]["rrf"] for m in mates)
    return out


def test_against_brute_force_with_nulls_ties_and_odd_numbers(spark):
    rng = random.Random(1)
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -3.5, 1e-310, 0.5, 0.5, 0.7, 12.0, 1e300]
    rows = [(i, rng.choice([1, 2, None]), rng.choice(["x", "y", None]), rng.choice(values), rng.choice(values)) for i in range(120)]
    got, want = fuse(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert {k: got[i][k] for k in w} == {**w, "rrf": pytest.approx(w["rrf"])}


def test_scale_of_a_score_does_not_matter(spark):
    rows = [(i, 1, "x", i * 1.0, (i * 7) % 10 * 1.0) for i in range(10)]
    big = [(i, r, f, a * 1e6 - 5, b) for i, r, f, a, b in rows]
    assert {i: r["rrf"] for i, r in fuse(spark, rows).items()} == {i: r["rrf"] for i, r in fuse(spark, big).items()}


def test_one_list_that_holds_everything_is_ranked_in_buckets(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") % 1000 / 1000).alias("v"))
    ranks = {r.v: r._place for r in fusion.value_ranks(df, ["k"], "v").collect()}
    assert ranks == {i / 1000: 1 + 5 * (999 - i) for i in range(1000)}
    plan = fusion.value_ranks(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan


def test_empty(spark):
    assert fuse(spark, []) == {}


def test_page_confidence(spark):
    df = spark.createDataFrame([(v,) for v in (None, -1.0, 0.5, 1.0, 91.64, float("nan"))], "v DOUBLE")
    assert [r[0] for r in df.select(fusion.page_confidence_share(F.col("v"))).collect()] == [None, None, 0.5, 1.0, 0.9164, None]
