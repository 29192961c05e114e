"""Named queries of the core operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapheur.functions import geometry as g
from parapheur.functions import metrics as m
from parapheur.functions import text as t
from parapheur.operators import evaluate as ev
from parapheur.operators import fields as fd
from parapheur.operators import shred
from parapheur.session import spread, table, written

Query = Callable[[SparkSession, str], DataFrame]
#: Size of a scanned page in pixels, for the share a table covers.
PAGE_WIDTH, PAGE_HEIGHT = 2480, 3508


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_pages")


def _worked_pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of the pages over all cores, for queries that work hard on every line."""
    return spread(_pages(spark, sf_dir).select("page_row_id", *columns))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "generated_documents")


def _approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "kie_approaches")
    return rows.withColumn("strategy", ev.strategy_label(F.col("strategy")))


def _rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Shredding -----------------------------------------------------------------------------------------------------------


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.kie_found(table(spark, sf_dir, "kie_documents"))


def p3_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.kie_nodes(table(spark, sf_dir, "kie_documents"))


def _p3_entity(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shred.kie_entities(written(shred.kie_nodes(table(spark, sf_dir, "kie_documents")), "nodes"))[name]

    return query


def _p3_rows(name: str, columns: tuple[str, ...]) -> Query:
    """An entity table by the places of its rows instead of node numbers."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shred.kie_entities(written(shred.kie_nodes(table(spark, sf_dir, "kie_documents")), "nodes"))[name].select("record_id", *columns)

    return query


def j8_selected_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["pages", "field_details", "candidates", "field", "selected", "strategy", "value"]
    return shred.selected_origins(shred.kie_entities(shred.kie_nodes(table(spark, sf_dir, "kie_documents"), labels), labels))


# Text ----------------------------------------------------------------------------------------------------------------


def t1_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_row_id", t.strip_html(F.col("raw_text")).alias("plain"))


def t2_normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.normalised_lines(t.strip_html(F.col("raw_text")))
    return _pages(spark, sf_dir).select("page_row_id", F.posexplode(lines).alias("line_no", "line"))


def t4_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select("row_no", t.norm(F.col("objet")).alias("objet_norm"), t.ref_norm(F.col("ref_code")).alias("ref_norm"), t.word_count(F.col("content")).alias("n_words"))


def f1_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fd.with_page_columns(_worked_pages(spark, sf_dir, "raw_text"), "raw_text").select("page_row_id", F.posexplode("_lines").alias("line_no", "line"))
    line = F.col("line")
    return lines.select("page_row_id", "line_no", t.is_noise(line).alias("noise"), t.is_reference(line).alias("reference"), t.is_keyword(line).alias("keyword"))


def x10_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_row_id", t.document_subtype(F.col("raw_text")).alias("doc_subtype"))


def _rule(rule: Callable[[fd.Page], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = fd.with_page_columns(_worked_pages(spark, sf_dir, "raw_text"), "raw_text")
        return pages.select("page_row_id", rule(fd.page_columns()).alias("value")).where("value IS NOT NULL")

    return query


def x9_decoded_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fd.with_page_columns(_worked_pages(spark, sf_dir, "raw_text"), "raw_text")
    sender, receiver = fd.decoded_head(fd.page_columns())
    return pages.select("page_row_id", sender.alias("sender"), receiver.alias("receiver"))


def kie_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.candidates(_pages(spark, sf_dir), "raw_text", "confidence", ["page_row_id"])


def kie_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.selected(kie_candidates(spark, sf_dir), ["page_row_id"])


def kie_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.extract(_pages(spark, sf_dir), "raw_text", "confidence", ["page_row_id"])


def p2_document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a doc_id, its pages in order; a page scanned again counts by its last delivery."""
    last = _pages(spark, sf_dir).groupBy("doc_id", "page").agg(F.max_by(F.struct("page_row_id", "raw_text", "confidence", "tables"), "page_row_id").alias("_p")).select("doc_id", "page", "_p.*")
    found = fd.extract(last, "raw_text", "confidence", ["page_row_id"])
    pages = last.select("doc_id", "page", "page_row_id", "tables", "raw_text").join(found, "page_row_id")
    page = F.struct(
        F.col("page").alias("page_number"), F.col("page_confidence").alias("ocr_confidence"), "fields", F.coalesce("tables", F.array().cast(pages.schema["tables"].dataType)).alias("tables"), "field_details"
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "raw_text"))), lambda x: x["raw_text"]), "\n")
    by_number = lambda a, b: F.when(a["page_number"] < b["page_number"], -1).when(a["page_number"] > b["page_number"], 1).otherwise(0)
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page), by_number).alias("pages"), F.count(F.lit(1)).alias("total_pages"), text.alias("_text"))
    body = F.struct(F.col("doc_id").alias("document_id"), "total_pages", F.lit("lettre_administrative").alias("doc_type"), t.document_subtype(t.strip_html(F.col("_text"))).alias("doc_subtype"), "pages")
    return docs.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


# Pages ---------------------------------------------------------------------------------------------------------------


def a1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("raw_text", "\n", -1)
    text = F.array_join(F.filter(lines, lambda x: t.strip(x) != ""), "\n")
    return _pages(spark, sf_dir).select("page_row_id", t.strip(t.strip_html(text)).alias("text"))


def a2_document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).where("doc_id IS NOT NULL")
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.coalesce(F.avg(m.normalised_confidence(F.col("confidence"))), F.lit(0.0)), 6).alias("confidence"))


def a3_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a document's pages in order; of a page scanned again the last delivery."""
    pages = _pages(spark, sf_dir).where("doc_id IS NOT NULL AND page IS NOT NULL")
    last = pages.groupBy("doc_id", "page").agg(F.max_by("raw_text", "page_row_id").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return last.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")).alias("text_md5"), F.max("page").alias("last_page"))


def m9_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_row_id", F.round(m.normalised_confidence(F.col("confidence")), 9).alias("share"))


def a6_filled_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _pages(spark, sf_dir).select("page_row_id", F.explode("tables").alias("x"))
    return tables.select("page_row_id", F.col("x.table_index").alias("table_index"), F.round(g.filled_share(F.col("x.data")), 2).alias("filled"), g.shape(F.col("x.data"))[0].alias("n_rows"), g.shape(F.col("x.data"))[1].alias("n_columns"))


def f6_large_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _pages(spark, sf_dir).select("page_row_id", F.explode("tables").alias("x"))
    share = g.area(F.col("x.bbox")) / (PAGE_WIDTH * PAGE_HEIGHT)
    return tables.select("page_row_id", F.col("x.table_index").alias("table_index"), F.round(share, 6).alias("page_share"), (share <= g.MAX_TABLE_SHARE).alias("kept"))


def j5_stamps_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = _pages(spark, sf_dir).select("page_row_id", "table_bboxes", F.explode("stamp_regions").alias("s"))
    return stamps.where(~g.inside_any(F.col("s.x"), F.col("s.y"), F.col("table_bboxes"))).select("page_row_id", F.col("s.x").alias("x"), F.col("s.y").alias("y"), F.col("s.radius").alias("radius"))


def p7_table_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box around all tables of a page; zeros without any."""
    boxes = F.transform("table_bboxes", lambda b: F.struct(b[0].alias("x1"), b[1].alias("y1"), b[2].alias("x2"), b[3].alias("y2")))
    box = g.box_of_cells(F.coalesce(boxes, F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>")))
    return _pages(spark, sf_dir).select("page_row_id", box.alias("b")).select("page_row_id", "b.*")


def p6_word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every line, a line being as wide as ten pixels a character."""
    lines = _worked_pages(spark, sf_dir, "raw_text").select("page_row_id", F.posexplode(F.split("raw_text", "\n", -1)).alias("line_no", "line")).where(t.strip(F.col("line")) != "")
    words = lines.select("page_row_id", "line_no", F.posexplode(g.word_boxes(F.col("line"), F.lit(100), F.lit(100) + 10 * F.length("line"))).alias("word_no", "w"))
    return words.select("page_row_id", "line_no", "word_no", F.col("w.value").alias("word"), F.col("w.x1").alias("x1"), F.col("w.x2").alias("x2"))


def j6_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as words on a grid of 4 x 4 boxes, each in the first row and column that hold it."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 400).cast("int").alias("x"), (F.col("l_suppkey") % 400).cast("int").alias("y"))
    boxes = lambda low, high: F.array(*[F.struct(F.lit(90 * i).alias(low), F.lit(90 * i + 100).alias(high)) for i in range(4)])
    return items.select("l_orderkey", "l_linenumber", g.first_interval(F.col("y"), boxes("y1", "y2"), "y1", "y2").alias("r"), g.first_interval(F.col("x"), boxes("x1", "x2"), "x1", "x2").alias("c"))


def a19_tables_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and stamps a document, over its pages as last delivered; zeros where there are none."""
    pages = _pages(spark, sf_dir).where("doc_id IS NOT NULL AND page IS NOT NULL")
    last = pages.groupBy("doc_id", "page").agg(F.max_by(F.struct(F.coalesce(F.size("tables"), F.lit(0)).alias("t"), F.coalesce(F.size("stamp_regions"), F.lit(0)).alias("s")), "page_row_id").alias("n"))
    count = lambda c: F.sum(F.greatest(F.col(f"n.{c}"), F.lit(0)))
    return last.groupBy("doc_id").agg(count("t").alias("tables_detected"), count("s").alias("stamps_detected"))


def p14_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _letters(spark, sf_dir).select("row_no", F.posexplode(g.cells_of_text(F.col("table_text"))).alias("r", "cells"))
    return rows.select("row_no", "r", F.posexplode("cells").alias("c", "cell"))


# Gold and joins ------------------------------------------------------------------------------------------------------


def s3_gold_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.gold_letters(_letters(spark, sf_dir)).select("doc_id", "row_no", "ref_code")


def j2_gold_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.gold_fields(_letters(spark, sf_dir))


def p9_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["source", "destination", "date_text", "ref_code", "objet", "pj", "content", "copie"]
    return _letters(spark, sf_dir).select("row_no", F.md5(ev.full_text(columns)).alias("text_md5"))


def j1_pages_with_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = ev.gold_letters(_letters(spark, sf_dir)).select("doc_id", F.col("row_no").alias("letter"))
    return _pages(spark, sf_dir).select("page_row_id", "doc_id").join(gold, "doc_id", "left")


def j4_letters_without_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = ev.gold_letters(_letters(spark, sf_dir)).select("doc_id")
    return ev.todo(gold, _pages(spark, sf_dir), "doc_id")


def j4_letters_not_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter files that no evaluation run has seen."""
    return ev.todo(_letters(spark, sf_dir).select("filename").where("filename IS NOT NULL").distinct(), table(spark, sf_dir, "kie_approaches").select(F.col("document").alias("filename")), "filename")


def w9_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.batch_numbers(_letters(spark, sf_dir), "filename", 20)


def e1_processed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents known from either table."""
    pages = _pages(spark, sf_dir).select("doc_id")
    exported = table(spark, sf_dir, "kie_documents").select(F.col("document_id").alias("doc_id"))
    return pages.unionByName(exported).where("doc_id IS NOT NULL").distinct()


# Metrics and summaries -----------------------------------------------------------------------------------------------


def m8_scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.scored_candidates(table(spark, sf_dir, "kie_approaches"), _letters(spark, sf_dir)), list(ev.METRICS))


def m12_fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.fuzzy_scores(table(spark, sf_dir, "kie_approaches"), _letters(spark, sf_dir)), ["text_ratio", "fuzzy_score"])


def m2_subject_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of the subject found on a page against the letter's, both folded to ASCII."""
    ascii_ = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")
    pages = fd.with_page_columns(_worked_pages(spark, sf_dir, "doc_id", "raw_text"), "raw_text")
    found = pages.select("page_row_id", "doc_id", ascii_(fd.subject_regex(fd.page_columns())).alias("h")).where("h IS NOT NULL")
    gold = ev.gold_letters(_letters(spark, sf_dir)).select("doc_id", ascii_(F.coalesce("objet", F.lit(""))).alias("r"))
    joined = found.join(gold, "doc_id")
    cer = m.character_error_rate(F.col("h"), F.col("r"))
    return joined.select("page_row_id", F.levenshtein("h", "r").alias("edit_distance"), F.round(cer, 6).alias("cer"), F.round(m.text_accuracy(cer), 6).alias("accuracy"))


def m3_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of the body found on a page against the letter's content."""
    pages = _worked_pages(spark, sf_dir, "doc_id", "body_text_no_tables").withColumnRenamed("body_text_no_tables", "h")
    gold = ev.gold_letters(_letters(spark, sf_dir)).select("doc_id", F.col("content").alias("r"))
    return pages.join(gold, "doc_id").select("page_row_id", F.round(m.word_error_rate(F.col("h"), F.col("r")), 6).alias("wer"))


def m4_ocr_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates, edit distance and accuracy of the body of every page against the letter's content."""
    pages = _worked_pages(spark, sf_dir, "doc_id", "body_text_no_tables")
    return ev.ocr_metrics(pages, _letters(spark, sf_dir), "body_text_no_tables", "content")


def a9_ocr_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.metric_stats(m4_ocr_metrics(spark, sf_dir), ["cer", "wer", "edit_distance", "accuracy"]), ["mean", "min", "max", "std"])


def a8_metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.metric_stats(_approaches(spark, sf_dir), list(ev.METRICS)), ["mean", "min", "max", "std"])


def a9_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.metric_stats(_approaches(spark, sf_dir), ["f1", "exact_match"], ["run_id"]), ["mean", "min", "max", "std"])


def a10_field_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.field_means(_approaches(spark, sf_dir)), list(ev.METRICS))


def _a12(metric: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(ev.approach_matrix(_approaches(spark, sf_dir), metric), list(ev.STRATEGY_ORDER))

    return query


def a14_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.macro_average(_approaches(spark, sf_dir), []), list(ev.METRICS))


def a15_macro_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.macro_average(_approaches(spark, sf_dir), ["strategy"]), list(ev.METRICS)).orderBy("strategy")


def a16_running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _approaches(spark, sf_dir).withColumn("day", F.to_date("evaluated_at"))
    return _rounded(ev.running_means(daily, "day"), ["running_mean"])


def a20_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.heatmap(_approaches(spark, sf_dir), "exact_match"), list(ev.STRATEGY_ORDER))


def w10_ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ranked_candidates(table(spark, sf_dir, "kie_approaches")).select("row_id", "place")


def w10_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.winners(table(spark, sf_dir, "kie_approaches"))


def p8_report_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _approaches(spark, sf_dir)
    return rows.select("row_id", F.substring("cand_value", 1, 120).alias("short_value"))


def p11_printed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approaches(spark, sf_dir).select("row_id", *[ev.printed(F.col(c)).alias(c) for c in ev.METRICS])


def x4_dates_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match of the date and reference found on a page against the letter's, averaged: the flagship's slice of the report."""
    pages = fd.with_page_columns(_worked_pages(spark, sf_dir, "doc_id", "raw_text"), "raw_text")
    page = fd.page_columns()
    found = F.array(F.struct(F.lit("Date").alias("field_name"), fd.date_regex(page).alias("predicted")), F.struct(F.lit("Ref").alias("field_name"), fd.reference_regex(page).alias("predicted")))
    long = pages.select("page_row_id", "doc_id", F.explode(found).alias("e")).select("page_row_id", "doc_id", "e.*")
    joined = long.join(ev.gold_fields(_letters(spark, sf_dir)), ["doc_id", "field_name"])
    scored = joined.select("field_name", F.inline(F.array(m.metric_pack(F.col("predicted"), F.col("gold"), F.col("field_name")))))
    out = scored.groupBy("field_name").agg(*[F.avg(c).alias(c) for c in ev.METRICS], F.count("f1").alias("n"))
    return _rounded(out, list(ev.METRICS))


RULES = {
    "x1_sender_regex": fd.sender_regex,
    "x1_sender_heuristic": fd.sender_heuristic,
    "x2_receiver_regex": fd.receiver_regex,
    "x2_receiver_heuristic": fd.receiver_heuristic,
    "x3_reference_regex": fd.reference_regex,
    "x3_reference_heuristic": fd.reference_heuristic,
    "x4_date_regex": fd.date_regex,
    "x4_date_heuristic": fd.date_heuristic,
    "x5_subject_regex": fd.subject_regex,
    "x5_subject_heuristic": fd.subject_heuristic,
    "x6_attachments_regex": fd.attachments_regex,
    "x6_attachments_heuristic": fd.attachments_heuristic,
    "x7_body_regex": fd.body_regex,
    "x7_body_heuristic": fd.body_heuristic,
    "x8_reference_in_body": fd.reference_in_body,
}

QUERIES: dict[str, Query] = {
    "p3_found": p3_found,
    "p3_nodes": p3_nodes,
    **{f"p3_{name}": _p3_entity(name) for name in ("documents", "pages", "tables", "cells", "details", "candidates")},
    "p3_page_rows": _p3_rows("pages", ("page_pos", "page_number", "ocr_confidence")),
    "p3_table_rows": _p3_rows("tables", ("page_pos", "item_pos", "table_index", "method", "x1", "y1", "x2", "y2")),
    "p3_cell_rows": _p3_rows("cells", ("page_pos", "item_pos", "row_pos", "col_pos", "cell")),
    "p3_detail_rows": _p3_rows("details", ("page_pos", "field_name", "selected")),
    "p3_candidate_rows": _p3_rows("candidates", ("page_pos", "field_name", "item_pos", "strategy", "cand_value", "strategy_score", "page_confidence", "score", "reason")),
    **{
        f.__name__: f
        for f in (
            t1_strip_html, t2_normalised_lines, t4_normal_forms, f1_line_classes, x10_subtype, x9_decoded_head, kie_candidates, kie_selected, kie_fields,
            a1_page_text, a2_document_confidence, a3_document_text, m9_confidence, a6_filled_share, f6_large_tables, j5_stamps_outside_tables, j6_grid_cells,
            a19_tables_per_document, s3_gold_letters, j2_gold_fields, j1_pages_with_letters, j4_letters_without_pages, j4_letters_not_evaluated, w9_batches, e1_processed_documents,
            m8_scored_candidates, m12_fuzzy_scores, m2_subject_errors, m3_word_errors, m4_ocr_metrics, a9_ocr_overall, a8_metric_stats, a9_run_stats, a10_field_means, a14_macro_average, a15_macro_by_strategy,
            j8_selected_origins, a16_running_means, a20_heatmap, w10_ranked_candidates, w10_winners, x4_dates_by_field,
        )
    },
    # operators of the projection group; their queries are not of the problems with the same letter
    "op_p2_document_json": p2_document_json,
    "op_p6_word_boxes": p6_word_boxes,
    "op_p7_table_extent": p7_table_extent,
    "op_p8_report_values": p8_report_values,
    "op_p14_table_cells": p14_table_cells,
    "op_p11_printed_metrics": p11_printed_metrics,
    "op_p9_full_text": p9_full_text,
    **{f"a12_matrix_{metric}": _a12(metric) for metric in ev.METRICS},
    **{name: _rule(rule) for name, rule in RULES.items()},
}
