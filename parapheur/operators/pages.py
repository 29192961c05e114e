"""Pages from recognised lines: text, confidence, tables, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapheur.functions import geometry as g
from parapheur.functions.text import strip, strip_html

LINE = "struct<line_no:int,text:string,confidence:double,polygon:array<struct<x:double,y:double>>>"


def page_text(lines: Column) -> Column:
    """Non-blank lines, one below the other."""
    return F.array_join(F.filter(F.transform(lines, lambda x: x["text"]), lambda x: strip(x) != ""), "\n")


def page_confidence(lines: Column, default: float = 0.0) -> Column:
    """Mean over all lines, blank ones too; 0 for a page without lines."""
    total = F.aggregate(lines, F.lit(0.0), lambda a, x: a + F.coalesce(x["confidence"], F.lit(default)))
    return F.when(F.size(lines) > 0, total / F.size(lines)).otherwise(0.0)


def body_lines(lines: Column, boxes: Column) -> Column:
    """Lines whose centre lies in no table, from top to bottom and left to right; lines without a place come first."""
    free = F.filter(lines, lambda x: _outside(x, boxes))
    box = lambda x: g.box_of_polygon(x["polygon"])
    keyed = F.transform(free, lambda x: F.struct(F.coalesce(box(x)["y1"], F.lit(0.0)).alias("y"), F.coalesce(box(x)["x1"], F.lit(0.0)).alias("x"), x["line_no"].alias("line_no"), x["text"].alias("text")))
    return F.transform(F.array_sort(keyed), lambda x: x["text"])


def _outside(line: Column, boxes: Column) -> Column:
    centre = g.centroid(line["polygon"])
    return ~g.inside_any(centre["x"], centre["y"], F.coalesce(boxes, F.array().cast("array<array<int>>")))


def pages_from_lines(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """One row a page from ``ocr_lines`` (doc_id, page, line_no, text, confidence, polygon) and, if given, ``tables`` (doc_id, page, tables).

    One shuffle by page; a page's lines are bounded by the page.
    """
    own = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "confidence", "polygon"))).alias("_lines"))
    if tables is not None:
        own = own.join(tables, ["doc_id", "page"], "left")
    else:
        own = own.withColumn("tables", F.lit(None).cast("array<struct<table_index:int,data:array<array<string>>,bbox:array<int>,confidence:double,method:string,shape:array<int>>>"))
    boxes = F.coalesce(F.transform("tables", lambda x: x["bbox"]), F.array().cast("array<array<int>>"))
    return own.select(
        "doc_id",
        "page",
        strip(strip_html(page_text(F.col("_lines")))).alias("raw_text"),
        F.bround(page_confidence(F.col("_lines")), 2).alias("confidence"),
        F.coalesce("tables", F.array().cast(own.schema["tables"].dataType)).alias("tables"),
        F.array_join(F.filter(body_lines(F.col("_lines"), boxes), lambda x: strip(x) != ""), "\n").alias("body_text_no_tables"),
        boxes.alias("table_bboxes"),
    )


def words_of_lines(lines: DataFrame) -> DataFrame:
    """One row a word of every line that has text and a place, with its share of the line's width."""
    box = g.box_of_polygon(F.col("polygon"))
    placed = lines.withColumn("_box", box).where(F.col("_box").isNotNull() & (strip(F.col("text")) != ""))
    x1, x2 = F.floor("_box.x1").cast("int"), F.floor("_box.x2").cast("int")
    cells = placed.select("doc_id", "page", "line_no", "confidence", "_box", F.posexplode(g.word_boxes(strip(F.col("text")), x1, x2)).alias("word_no", "_w"))
    name = lambda kind, *parts: F.concat_ws("_", F.lit(kind), *[p.cast("string") for p in parts])
    return cells.select(
        "doc_id",
        "page",
        F.lit("ocrx_word").alias("class"),
        name("word", F.col("page"), F.col("line_no"), F.col("word_no")).alias("id"),
        name("line", F.col("page"), F.col("line_no")).alias("parent"),
        F.col("_w.value").alias("value"),
        F.bround(100 * F.coalesce("confidence", F.lit(0.9)), 0).cast("int").alias("confidence"),
        F.col("_w.x1").alias("x1"),
        F.floor("_box.y1").cast("int").alias("y1"),
        F.col("_w.x2").alias("x2"),
        F.floor("_box.y2").cast("int").alias("y2"),
    )


def kept_tables(pages: DataFrame, height: Column, width: Column) -> DataFrame:
    """Pages with only the tables that do not cover more than their share of the page."""
    return pages.withColumn("tables", F.filter("tables", lambda x: g.area(x["bbox"]) <= g.MAX_TABLE_SHARE * height * width))


def grid_tables(cells: DataFrame) -> DataFrame:
    """Tables (data, confidence, shape) from detected rows and columns; grids without both, or filled too little, are dropped.

    ``cells``: doc_id, page, table_index, bbox, rows, cols (boxes with a label) and lines (text, x, y).
    """
    order = lambda column, label, low: F.array_sort(F.filter(column, lambda b: F.lower(b["label"]).contains(label) & ~F.lower(b["label"]).contains("header")), lambda a, b: F.when(a[low] < b[low], -1).when(a[low] > b[low], 1).otherwise(0))
    ready = cells.withColumn("_rows", order(F.col("rows"), "row", "y1")).withColumn("_cols", order(F.col("cols"), "column", "x1"))
    ready = ready.where((F.size("_rows") > 0) & (F.size("_cols") > 0)).withColumn("data", g.grid(F.col("lines"), F.col("_rows"), F.col("_cols")))
    out = ready.withColumn("confidence", g.filled_share(F.col("data"))).where(F.col("confidence") >= g.MIN_FILLED)
    return out.select("doc_id", "page", "table_index", "data", "bbox", "confidence", F.lit("tatr").alias("method"), g.shape(F.col("data")).alias("shape"))
