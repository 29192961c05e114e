"""Command line: ``extract`` pages to fields, ``evaluate`` them against gold letters. Inputs and outputs are tables (parquet)."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parapheur.operators import evaluate, fields
from parapheur.operators.degrade import degraded
from parapheur.sources import files


def extract(spark: SparkSession, pages: str, out: str, docs: int | None = None, batch_size: int | None = None, resume: bool = False, degrade: bool = False) -> None:
    """Candidates and winners of every page below ``out``; ``resume`` leaves out documents that are there already.

    Pages without a document name make a batch of their own, the last; for ``docs`` they count as one document, after the named ones.
    """
    rows = spark.read.parquet(pages)
    done = os.path.join(out, "selected")
    if resume:
        earlier = files.earlier_results(spark, done, fields.selected(fields.candidates(rows.limit(0), "raw_text", "confidence", ["doc_id", "page_row_id"], fuzzy=False), ["doc_id", "page_row_id"]).schema)
        rows = evaluate.todo(rows, earlier, "doc_id")
    if docs is not None:
        first = rows.select(F.col("doc_id").alias("_first")).distinct().orderBy(F.asc_nulls_last("_first")).limit(docs)
        rows = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    if degrade:
        rows = rows.withColumn("raw_text", degraded(F.col("raw_text"), F.col("page_row_id")))
    keys = ["doc_id", "page_row_id"]
    parts = [rows]
    if batch_size:
        batches = evaluate.batch_numbers(rows.select("doc_id"), "doc_id", batch_size)
        last = batches.agg(F.max("batch")).first()[0] or 0
        parts = [rows.join(batches.where(F.col("batch") == b).select("doc_id"), "doc_id", "left_semi") for b in range(1, int(last) + 1)]
        nameless = rows.where("doc_id IS NULL")
        if not parts or not nameless.isEmpty():
            parts.append(nameless)
    for i, part in enumerate(parts):
        found = fields.candidates(part, "raw_text", "confidence", keys)
        mode = "append" if resume or i else "overwrite"
        files.write_table(found, os.path.join(out, "candidates"), mode)
        files.write_table(fields.selected(found, keys), done, mode)


def report(spark: SparkSession, approaches: str, letters: str, out: str) -> None:
    """Scores every candidate against the gold letters and writes the summary tables."""
    scored = evaluate.scored_candidates(spark.read.parquet(approaches), spark.read.parquet(letters))
    files.write_table(scored, os.path.join(out, "scored"))
    scored = spark.read.parquet(os.path.join(out, "scored"))
    files.export_report(evaluate.field_means(scored).orderBy("field_order"), out, "field_means")
    files.export_report(evaluate.metric_stats(scored, list(evaluate.METRICS)), out, "overall")
    for metric in evaluate.METRICS:
        files.export_report(evaluate.approach_matrix(scored, metric), out, f"approach_{metric}")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="parapheur", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    x = commands.add_parser("extract")
    x.add_argument("pages")
    x.add_argument("out")
    x.add_argument("--docs", type=int)
    x.add_argument("--batch-size", type=int)
    x.add_argument("--resume", action="store_true")
    x.add_argument("--degrade", action="store_true")
    e = commands.add_parser("evaluate")
    e.add_argument("approaches")
    e.add_argument("letters")
    e.add_argument("out")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("parapheur").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "extract":
        extract(spark, given.pages, given.out, given.docs, given.batch_size, given.resume, given.degrade)
    else:
        report(spark, given.approaches, given.letters, given.out)


if __name__ == "__main__":
    main()
