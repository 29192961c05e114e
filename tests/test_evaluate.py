from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from parapheur.functions.fuzzy import plain_ratio
from parapheur.operators import evaluate as ev
from parapheur.operators.degrade import degraded
from parapheur.operators.ordering import with_global_place
from parapheur.plans.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame(rows, "field_name STRING, strategy STRING, f1 DOUBLE")


def test_last_letter_wins_and_odd_names_have_no_key(spark):
    rows = [(1, "doc_007_tmpl1_x.pdf", "a"), (3, "doc_007_tmpl2_y.pdf", "b"), (2, "doc_07_z.pdf", "c"), (4, "scan.pdf", "d"), (5, None, "e")]
    gold = ev.gold_letters(spark.createDataFrame(rows, "row_no INT, filename STRING, source STRING"))
    assert {(r.doc_id, r.source) for r in gold.collect()} == {("doc_007", "b"), ("doc_07", "c")}


def test_overall_row_is_pooled_and_best_has_fixed_ties(spark):
    rows = [("Source", "Regex", 1.0), ("Source", "Regex", 0.0), ("Date", "Regex", 1.0), ("Source", "Heuristic", 0.5), ("Date", "Heuristic", None), ("Pj", "Heuristic", None), ("Pj", "RapidFuzzy", 0.2)]
    out = {r.field_name: r for r in ev.approach_matrix(frame(spark, rows), "f1").collect()}
    assert out["Overall"].Regex == pytest.approx(2 / 3) and out["Source"].best == "Regex" and out["Pj"].best == "RapidFuzzy" and out["Date"].Heuristic is None
    assert ev.approach_matrix(frame(spark, []), "f1").count() == 0


def test_population_deviation_of_the_published_run(spark):
    rows = [("x", "s", v) for v in (1, 1, 1, 1, 0, 0, 1)]
    r = ev.metric_stats(frame(spark, [(f, s, float(v)) for f, s, v in rows]), ["f1"]).first()
    assert (round(r["mean"], 6), round(r["std"], 6)) == (0.714286, 0.451754)


def test_every_field_of_the_report_is_there(spark):
    df = spark.createDataFrame([("Date", *[1.0] * 6)], "field_name STRING, prec DOUBLE, recall DOUBLE, f1 DOUBLE, exact_match DOUBLE, field_accuracy DOUBLE, iou DOUBLE")
    out = ev.field_means(df).orderBy("field_order").collect()
    assert [r.field_name for r in out] == list(ev.GOLD_COLUMNS) and [r.n for r in out] == [0, 0, 1, 0, 0, 0, 0]


def test_strategy_spellings(spark):
    df = spark.createDataFrame([("rapid_fuzzy",), ("Rapid Fuzzy",), ("REGEX",), ("sequence_fallback",), ("other",), (None,)], "s STRING")
    assert [r[0] for r in df.select(ev.strategy_label(F.col("s"))).collect()] == ["RapidFuzzy", "RapidFuzzy", "Regex", "Sequence Fallback", "other", None]


@pytest.mark.parametrize("names", [[], ["a"], ["doc_2", "doc_10", "doc_1", "é", "", "doc_1/x"], [f"doc_{i:05d}_x" for i in range(700)]])
def test_global_place_is_the_sorted_order(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n STRING").unionByName(spark.createDataFrame([(None,)], "n STRING"))
    got = {r.n: r.place for r in with_global_place(df, "n").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda s: s.encode()), 1)}


def test_resume_leaves_out_what_is_done(spark):
    files = spark.createDataFrame([("a",), ("b",), ("b",)], "n STRING")
    assert [r.n for r in ev.todo(files, spark.createDataFrame([("a",)], "n STRING"), "n").collect()] == ["b", "b"]


def test_winners_agree_with_ranking(spark, data):
    rows = spark.read.parquet(f"{data}/kie_approaches.parquet")
    first = ev.ranked_candidates(rows).where("place = 1").select("run_id", "document", "field_name", F.col("label").alias("selected_strategy"), F.col("cand_value").alias("selected"), F.col("ensemble_score").alias("selected_score"))
    assert first.exceptAll(ev.winners(rows)).isEmpty() and first.count() == ev.winners(rows).count()


def test_running_mean_ends_in_the_macro_average(spark):
    df = spark.createDataFrame([(1, "Source", 1.0), (1, "Date", 0.0), (2, "Source", 0.0), (3, "Date", 1.0), (3, "Date", None), (3, "unknown", 0.9)], "day INT, field_name STRING, f1 DOUBLE")
    out = {r.day: r.running_mean for r in ev.running_means(df, "day").collect()}
    assert out == {1: 0.5, 2: 0.25, 3: 0.5}


def test_degradation_is_reproducible_and_about_as_strong_as_asked(spark):
    df = spark.createDataFrame([(1, "e" * 20_000), (2, None), (3, "")], "id INT, x STRING")
    a, b = (df.select(degraded(F.col("x"), F.col("id"), 0.05).alias("y")).collect() for _ in range(2))
    assert a == b and 800 < a[0].y.count("c") < 1200 and a[1].y is None and a[2].y == ""


def test_printed(spark):
    df = spark.createDataFrame([(0.71428571,), (None,)], "x DOUBLE")
    assert [r[0] for r in df.select(ev.printed(F.col("x"))).collect()] == ["0.7143", "n/a"]


def test_ocr_metrics_clamp_and_skip_pages_without_letters(spark):
    pages = spark.createDataFrame([(1, "doc_1", "été chaud"), (2, "doc_1", None), (3, "doc_2", "x"), (4, None, "y")], "page_row_id INT, doc_id STRING, body STRING")
    letters = spark.createDataFrame([(1, "doc_1_a.pdf", "ete chaud")], "row_no INT, filename STRING, content STRING")
    out = {r.page_row_id: r for r in ev.ocr_metrics(pages, letters, "body", "content").collect()}
    assert out.keys() == {1, 2} and (out[1].edit_distance, out[1].wer) == (2, 0.5) and out[1].accuracy == pytest.approx(1 - 2 / 9) and out[2].cer == 1.0


def test_fuzzy_scores_are_plain_ratios_unless_a_strategy_gave_its_own(spark, data):
    letters = spark.createDataFrame([(1, "doc_1_a.pdf", " Service du Port ")], "row_no INT, filename STRING, source STRING").withColumns({c: F.lit(None).cast("string") for c in ev.GOLD_COLUMNS.values() if c != "source"})
    rows = [
        (1, "doc_1_a.pdf", "Source", "service port", None), (2, "doc_1_a.pdf", "Source", "service port", 0.25), (3, "doc_1_a.pdf", "Source", None, None),
        (4, "doc_1_a.pdf", "Date", "01/02/2020", None), (5, "doc_2_b.pdf", "Source", "x", None), (6, None, None, " ", None), (7, "doc_1_a.pdf", "Source", "SERVICE DU PORT", None),
    ]
    df = spark.createDataFrame([(i, d, f, "regex", v, s) for i, d, f, v, s in rows], "row_id INT, document STRING, field_name STRING, strategy STRING, cand_value STRING, strategy_score DOUBLE")
    out = {r.row_id: (round(r.text_ratio, 6), round(r.fuzzy_score, 6)) for r in ev.fuzzy_scores(df, letters).collect()}
    ratio = round(2 * 12 / 27, 6)  # "service " and "port" in 12 and 15 letters
    assert out == {1: (ratio, ratio), 2: (ratio, 0.25), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0), 7: (1, 1)}
    # letters that fill a right text of 200 or more are no block of their own, as in the reference
    assert plain_ratio("ba" * 5, "ab" * 100) == 0.0 and plain_ratio("ab" * 100, "ba" * 5) == pytest.approx(2 * 10 / 210)
    words = ["", "a", "abc", "bca", "ab" * 100, "abc d" * 50, "d cba" * 50, "xa" + "ab" * 120]
    kept = SequenceMatcher(None)
    assert all(plain_ratio(a, b, kept) == (SequenceMatcher(None, a, b).ratio() if a and b else 0) for b in words for a in words)
    scores = QUERIES["m12_fuzzy_scores"](spark, data)
    assert scores.count() == spark.read.parquet(f"{data}/kie_approaches.parquet").count() and scores.where("text_ratio IS NULL OR isnan(fuzzy_score)").isEmpty()


def test_ocr_metrics_of_pages_are_exact_in_one_step(spark, data):
    got = QUERIES["m4_ocr_metrics"](spark, data)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and plan.count("ArrowEvalPython [") <= 2  # the adaptive plan is printed twice at most
    gold = ev.gold_letters(spark.read.parquet(f"{data}/generated_documents.parquet"))
    pages = spark.read.parquet(f"{data}/ocr_pages.parquet").join(gold.select("doc_id", "content"), "doc_id")
    want = pages.select("page_row_id", F.levenshtein("body_text_no_tables", "content").alias("edit_distance"))
    assert sorted(map(tuple, got.select("page_row_id", "edit_distance").collect())) == sorted(map(tuple, want.collect()))
    one = ev.ocr_metrics(spark.createDataFrame([(1, "doc_1", None), (2, "doc_2", "x"), (3, "doc_3", "")], "page_row_id LONG, doc_id STRING, h STRING"), spark.createDataFrame([(1, "doc_1.pdf", "a b"), (2, "doc_2.pdf", None), (3, "doc_3.pdf", "")], "row_no LONG, filename STRING, content STRING"), "h", "content")
    assert [tuple(r)[2:] for r in one.orderBy("page_row_id").collect()] == [(1.0, 1.0, None, 0.0), (1.0, 1.0, None, 0.0), (0.0, 0.0, 0, 1.0)]
