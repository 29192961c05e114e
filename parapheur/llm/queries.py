"""Named queries of the training-data problems."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapheur.llm import canonical, fusion, leakage, mixing, private, scanned, spans
from parapheur.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = fusion.candidate_ranking(table(spark, sf_dir, "kie_approaches"), fused_rank=False)
    return fusion.top_by_every_score(ranking).select("row_id")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = fusion.candidate_ranking(table(spark, sf_dir, "kie_approaches"))
    return ranking.withColumn("rrf", F.round("rrf", 12))


#: The tables that hold free text: name, key, text column.
TEXTS = (("generated_documents", "row_no", "content"), ("ocr_pages", "page_row_id", "raw_text"))
#: Key of the surrogates; a deployment sets its own and keeps it apart from the data. Where none is set nobody can know it later.
SECRET = os.environ.get("PARAPHEUR_SECRET") or secrets.token_hex(32)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key, text in TEXTS:
        parts.append(canonical.look_alike_pairs(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("tab"), "id_a", "id_b"))
    return parts[0].unionByName(parts[1])


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key, text in TEXTS:
        forms = canonical.canonical_form(table(spark, sf_dir, name), key, text)
        parts.append(forms.select(F.lit(name).alias("tab"), F.col(key).alias("row_id"), "canonical"))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [private.pieces(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("tab"), F.col(key).alias("row_id"), "kind", "start_pos") for name, key, text in TEXTS]
    return parts[0].unionByName(parts[1])


def p4_pseudonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [private.pseudonymised(table(spark, sf_dir, name), key, text, SECRET).select(F.lit(name).alias("tab"), F.col(key).alias("row_id"), "safe_text", "n_replaced") for name, key, text in TEXTS]
    return parts[0].unionByName(parts[1])


def _scanned_pages(spark: SparkSession, sf_dir: str) -> scanned.ScannedPages:
    letters = table(spark, sf_dir, "generated_documents").select("content")
    return scanned.ScannedPages(table(spark, sf_dir, "ocr_pages"), letters)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned_pages(spark, sf_dir).found()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned_pages(spark, sf_dir).repaired()


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).selection()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p6_found, with up to two characters of a passage edited."""
    return leakage.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), budget=2)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(p6_found(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(table(spark, sf_dir, "documents")).pairs()


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(table(spark, sf_dir, "documents")).stretches()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(table(spark, sf_dir, "documents")).shares()


def p8_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(table(spark, sf_dir, "documents")).clusters()


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(table(spark, sf_dir, "documents")).class_rows()


def p8_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(table(spark, sf_dir, "documents")).removals()


QUERIES = {
    "p1_found": p1_found,
    "p1_ranking": p1_ranking,
    "p2_found": p2_found,
    "p2_canonical": p2_canonical,
    "p4_found": p4_found,
    "p4_pseudonymised": p4_pseudonymised,
    "p5_found": p5_found,
    "p5_paragraphs": p5_paragraphs,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p6_found": p6_found,
    "p6_near": p6_near,
    "p6_report": p6_report,
    "p8_found": p8_found,
    "p8_stretches": p8_stretches,
    "p8_shares": p8_shares,
    "p8_clusters": p8_clusters,
    "p8_classes": p8_classes,
    "p8_removals": p8_removals,
}
