"""Evaluation against gold letters, and the summary tables.

Everything is a map-side combined aggregate; a document that holds a third of all rows adds to the same few groups as any other.
Null metrics mean "not applicable" and are skipped by every mean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapheur.functions import edits, fuzzy, metrics as m
from parapheur.functions.text import non_empty, strip
from parapheur.session import spread

METRICS = ("prec", "recall", "f1", "exact_match", "field_accuracy", "iou")
# Fields in report order with the gold column of each, and the strategies in order of preference.
GOLD_COLUMNS = {"Source": "source", "Destination": "destination", "Date": "date_text", "Ref": "ref_code", "Objet": "objet", "Pj": "pj", "Content": "content"}
STRATEGY_LABELS = {"regex": "Regex", "heuristic": "Heuristic", "rapidfuzzy": "RapidFuzzy", "sequencefallback": "Sequence Fallback"}
STRATEGY_ORDER = ("Regex", "Heuristic", "RapidFuzzy")


def strategy_label(column: Column) -> Column:
    """One spelling of a strategy's name: display, internal and spaced names agree."""
    key = F.regexp_replace(F.lower(column), r"[\s_]+", "")
    return reduce(lambda a, kv: a.when(key == kv[0], F.lit(kv[1])), STRATEGY_LABELS.items(), F.when(F.lit(False), F.lit(""))).otherwise(column)


def document_key(column: Column) -> Column:
    """The ``doc_<digits>`` of a file name, null without one; leading zeros count."""
    return F.regexp_substr(column, F.lit(r"doc_\d+"))


def gold_letters(letters: DataFrame, order: str = "row_no") -> DataFrame:
    """One gold row a letter: the last in order wins. An argmax, so repeated letters are combined on the map side."""
    columns = [c for c in letters.columns if c != "doc_id"]
    keyed = letters.withColumn("doc_id", document_key(F.col("filename"))).where("doc_id IS NOT NULL")
    return keyed.groupBy("doc_id").agg(F.max_by(F.struct(*columns), order).alias("_last")).select("doc_id", "_last.*")


def gold_fields(letters: DataFrame) -> DataFrame:
    """(doc_id, field_name, gold) in long form; empty gold is null."""
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(c).alias("gold")) for f, c in GOLD_COLUMNS.items()])
    long = gold_letters(letters).select("doc_id", F.explode(entries).alias("_e")).select("doc_id", "_e.*")
    return long.withColumn("gold", F.when(strip(F.col("gold")) != "", F.col("gold")))


def scored_candidates(approaches: DataFrame, letters: DataFrame) -> DataFrame:
    """Candidate rows with their gold and the six metrics computed anew (``document`` is a file name)."""
    rows = spread(approaches).select("row_id", document_key(F.col("document")).alias("doc_id"), "field_name", strategy_label(F.col("strategy")).alias("strategy"), "cand_value")
    joined = rows.join(gold_fields(letters), ["doc_id", "field_name"], "left")
    return joined.select("row_id", "doc_id", "field_name", "strategy", F.inline(F.array(m.metric_pack(F.col("cand_value"), F.col("gold"), F.col("field_name")))))


def fuzzy_scores(approaches: DataFrame, letters: DataFrame) -> DataFrame:
    """Candidate rows with the plain ratio of value and gold, and the report's FuzzyScore: the strategy's own score where it gave one.

    A row without gold or without a value has the ratio 0. A selected value has no score of its own: its FuzzyScore is the ratio.
    """
    rows = spread(approaches).select("row_id", document_key(F.col("document")).alias("doc_id"), "field_name", strategy_label(F.col("strategy")).alias("strategy"), "cand_value", "strategy_score")
    joined = rows.join(gold_fields(letters), ["doc_id", "field_name"], "left").withColumn("text_ratio", fuzzy.text_ratio(F.col("cand_value"), F.col("gold")))
    return joined.select("row_id", "doc_id", "field_name", "strategy", "text_ratio", F.coalesce("strategy_score", "text_ratio").alias("fuzzy_score"))


def ocr_metrics(pages: DataFrame, letters: DataFrame, hypothesis: str, gold: str) -> DataFrame:
    """Character and word error rate, edit distance and accuracy of a page column against a gold column."""
    texts = gold_letters(letters.select("filename", "row_no", gold)).select("doc_id", F.col(gold).alias("_gold"))
    h, r, distance = F.col(hypothesis), F.col("_gold"), F.col("edit_distance")
    measured = pages.join(texts, "doc_id").select("page_row_id", "doc_id", h, r, edits.character_edits(h, r).alias("edit_distance"), m.word_error_rate(h, r).alias("wer"))
    cer = m.character_error_rate(h, r, distance)
    return measured.select("page_row_id", "doc_id", cer.alias("cer"), "wer", "edit_distance", m.text_accuracy(cer).alias("accuracy"))


def full_text(columns: list[str]) -> Column:
    """Non-empty trimmed columns joined by a blank."""
    return F.array_join(F.array_compact(F.array(*[non_empty(strip(F.col(c))) for c in columns])), " ")


def metric_stats(df: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """mean, min, max and population deviation of each metric, one row a metric; metrics without a value are left out."""
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*").where("v IS NOT NULL AND NOT isnan(v)")
    return long.groupBy(*keys, "metric").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"))


def field_means(df: DataFrame, columns: list[str] = list(METRICS)) -> DataFrame:  # noqa: B006
    """Mean of every metric a field, all fields of the report present, and how many rows had one."""
    spark = df.sparkSession
    fields = spark.createDataFrame([(i, f) for i, f in enumerate(GOLD_COLUMNS)], "field_order int, field_name string")
    means = df.groupBy("field_name").agg(*[F.avg(c).alias(c) for c in columns], F.count("f1").alias("n"))
    return fields.join(means, "field_name", "left").select("field_order", "field_name", *columns, F.coalesce("n", F.lit(0)).alias("n"))


def best_strategy(scores: dict[str, Column]) -> Column:
    """Name of the highest score; ties go to the earlier strategy, ``n/a`` if there is none."""
    options = F.array(*[F.when(c.isNotNull(), F.struct(c.alias("score"), F.lit(-i).alias("rank"), F.lit(s).alias("label"))) for i, (s, c) in enumerate(scores.items())])
    return F.coalesce(F.array_max(F.array_compact(options))["label"], F.lit("n/a"))


def approach_matrix(df: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric by field and strategy, with the pooled ``Overall`` row and the best strategy.

    One grouping-sets aggregate gives cells and pooled row; the pivot then has fields x strategies rows to read.
    """
    rows = df.where(F.col("strategy").isin(*STRATEGY_ORDER) & F.col(metric).isNotNull() & F.col("field_name").isNotNull())
    cells = rows.rollup("strategy", "field_name").agg(F.avg(metric).alias("v")).where("strategy IS NOT NULL").fillna("Overall", ["field_name"])
    wide = cells.groupBy("field_name").pivot("strategy", list(STRATEGY_ORDER)).agg(F.first("v"))
    return wide.withColumn("best", best_strategy({s: F.col(s) for s in STRATEGY_ORDER}))


def heatmap(df: DataFrame, metric: str) -> DataFrame:
    return df.where(F.col("strategy").isin(*STRATEGY_ORDER)).groupBy("field_name").pivot("strategy", list(STRATEGY_ORDER)).agg(F.avg(metric))


def macro_average(df: DataFrame, keys: list[str], columns: list[str] = list(METRICS)) -> DataFrame:  # noqa: B006
    """Mean of the per-field means, and how many fields had any."""
    per_field = df.groupBy(*keys, "field_name").agg(*[F.avg(c).alias(c) for c in columns])
    return per_field.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns], F.count("f1").alias("n_fields"))


def running_means(df: DataFrame, order: str, metric: str = "f1") -> DataFrame:
    """After each batch (``order``), the mean of the means so far of the report's fields.

    Rows are first summed a batch and field, so the window sees fields x batches rows.
    """
    sums = df.groupBy(order, "field_name").agg(F.sum(metric).alias("s"), F.count(metric).alias("n"))
    so_far = Window.partitionBy("field_name").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    every = sums.select(order).distinct().select(order, F.explode(F.array(*map(F.lit, GOLD_COLUMNS))).alias("field_name"))
    filled = every.join(sums, [order, "field_name"], "left").fillna(0, ["s", "n"])
    means = filled.select(order, (F.sum("s").over(so_far) / F.nullif(F.sum("n").over(so_far), F.lit(0))).alias("mean"))
    return means.groupBy(order).agg(F.avg("mean").alias("running_mean"))


def ranked_candidates(approaches: DataFrame) -> DataFrame:
    """Candidates of every run, document and field by score, strategy score, length and strategy; repeated rows rank apart by row."""
    rank = reduce(lambda a, kv: a.when(F.col("label") == kv[1], kv[0]), enumerate(STRATEGY_ORDER), F.when(F.lit(False), 0)).otherwise(len(STRATEGY_ORDER))
    rows = approaches.where(strip(F.col("cand_value")) != "").withColumn("label", strategy_label(F.col("strategy"))).withColumn("_rank", rank)
    order = [F.col("ensemble_score").desc_nulls_last(), F.col("strategy_score").desc_nulls_last(), F.length("cand_value").desc(), F.col("_rank"), F.col("row_id")]
    window = Window.partitionBy("run_id", "document", "field_name").orderBy(*order)
    return rows.select("row_id", "run_id", "document", "field_name", "label", "cand_value", "ensemble_score", F.row_number().over(window).alias("place"))


def winners(approaches: DataFrame) -> DataFrame:
    """The selected candidate of every run, document and field: an argmax, so no group is collected or sorted."""
    rank = reduce(lambda a, kv: a.when(F.col("label") == kv[1], -kv[0]), enumerate(STRATEGY_ORDER), F.when(F.lit(False), 0)).otherwise(-len(STRATEGY_ORDER))
    rows = approaches.where(strip(F.col("cand_value")) != "").withColumn("label", strategy_label(F.col("strategy")))
    low = lambda c: F.coalesce(F.col(c), F.lit(float("-inf"))).alias(c)
    best = F.max(F.struct(low("ensemble_score"), low("strategy_score"), F.length("cand_value").alias("n"), rank.alias("r"), (-F.col("row_id")).alias("first"), "label", "cand_value"))
    out = rows.groupBy("run_id", "document", "field_name").agg(best.alias("_b"))
    return out.select("run_id", "document", "field_name", F.col("_b.label").alias("selected_strategy"), F.col("_b.cand_value").alias("selected"), F.nullif(F.col("_b.ensemble_score"), F.lit(float("-inf"))).alias("selected_score"))


def batch_numbers(files: DataFrame, name: str, size: int) -> DataFrame:
    """Files in order of name with their number and batch. The one global order is over distinct names, range-partitioned:
    places are a running count a partition plus the counts of the partitions before."""
    from parapheur.operators.ordering import with_global_place

    placed = with_global_place(files.select(name).distinct(), name)
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / size) + 1)


def todo(files: DataFrame, done: DataFrame, name: str) -> DataFrame:
    """Files that no earlier run has finished."""
    return files.join(done.select(name).distinct(), name, "left_anti")


def printed(column: Column) -> Column:
    """Four places, or n/a. A value halfway in its decimal spelling goes up, where C would look at its binary value."""
    return F.when(column.isNotNull(), F.format_string("%.4f", column)).otherwise("n/a")
