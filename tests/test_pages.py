import pytest
from pyspark.sql import functions as F

from parapheur.functions import geometry as g
from parapheur.operators import pages


def box(x1, y1, x2, y2):
    return [(float(x1), float(y1)), (float(x2), float(y1)), (float(x2), float(y2)), (float(x1), float(y2))]


LINE = "doc_id STRING, page INT, line_no INT, text STRING, confidence DOUBLE, polygon ARRAY<STRUCT<x DOUBLE, y DOUBLE>>"


def test_pages_from_lines_masks_and_orders(spark):
    lines = spark.createDataFrame(
        [("d", 1, 2, "bas", 1.0, box(0, 90, 10, 100)), ("d", 1, 1, "<b>haut</b>", 0.5, box(0, 0, 10, 10)), ("d", 1, 3, "cellule", 0.6, box(50, 50, 60, 60)), ("d", 1, 4, " ", None, None)], LINE
    )
    tables = spark.createDataFrame([("d", 1, [(1, [["x"]], [40, 40, 70, 70], 1.0, "img2table", [1, 1])])], "doc_id STRING, page INT, tables ARRAY<STRUCT<table_index INT, data ARRAY<ARRAY<STRING>>, bbox ARRAY<INT>, confidence DOUBLE, method STRING, shape ARRAY<INT>>>")
    row = pages.pages_from_lines(lines, tables).first()
    assert row.raw_text == "haut\nbas\ncellule" and row.body_text_no_tables == "<b>haut</b>\nbas" and row.table_bboxes == [[40, 40, 70, 70]]
    assert row.confidence == pytest.approx(0.52, abs=0.01)
    bare = pages.pages_from_lines(lines).first()
    assert bare.body_text_no_tables == "<b>haut</b>\ncellule\nbas" and bare.tables == []


@pytest.mark.parametrize(("x", "inside"), [(12, True), (11, False), (108, True), (109, False)])
def test_mask_is_padded_by_eight_pixels(spark, x, inside):
    df = spark.createDataFrame([([[20, 20, 100, 100]],)], "b ARRAY<ARRAY<INT>>")
    assert df.select(g.inside_any(F.lit(x), F.lit(50), F.col("b"))).first()[0] is inside
    assert df.select(g.inside_any(F.lit(x), F.lit(50), F.lit(None).cast("array<array<int>>"))).first()[0] is False


def test_word_boxes_follow_the_step_rule(spark):
    line, x1, x2 = "le comité de suivi", 100, 333
    words = line.split()
    unit = (x2 - x1) / (sum(map(len, words)) + 0.5 * (len(words) - 1))
    expected, at = [], x1
    for i, w in enumerate(words):
        end = at + int(len(w) * unit)
        expected.append((w, at, x2 if i == len(words) - 1 else end))
        at = end + int(0.5 * unit)
    df = spark.createDataFrame([(line,), ("",), (None,)], "l STRING")
    got = [r[0] for r in df.select(g.word_boxes(F.col("l"), F.lit(x1), F.lit(x2))).collect()]
    assert [tuple(w) for w in got[0]] == expected and got[1] is None and got[2] is None


def test_words_of_lines(spark):
    lines = spark.createDataFrame([("d", 1, 1, "un mot", 0.9, box(0, 5, 60, 15)), ("d", 1, 2, "sans place", 0.9, None), ("d", 1, 3, " ", 0.9, box(0, 0, 1, 1))], LINE)
    rows = pages.words_of_lines(lines).collect()
    assert [(r.value, r.x1, r.y1, r.y2, r.confidence) for r in rows] == [("un", 0, 5, 15, 90), ("mot", rows[1].x1, 5, 15, 90)] and rows[1].x2 == 60


@pytest.mark.parametrize(("filled", "kept"), [(29, False), (30, True)])
def test_grid_needs_three_cells_in_ten(spark, filled, kept):
    rows = [("row", 0, 10 * i, 100, 10 * i + 9) for i in range(10)]
    cols = [("column", 10 * i, 0, 10 * i + 9, 100) for i in range(10)] + [("table column header", 0, 0, 100, 9)]
    lines = [(f"t{k}", float(k % 10 * 10 + 5), float(k // 10 * 10 + 5)) for k in range(filled)]
    cells = spark.createDataFrame(
        [("d", 1, 0, [0, 0, 100, 100], rows[::-1], cols, lines)],
        "doc_id STRING, page INT, table_index INT, bbox ARRAY<INT>, rows ARRAY<STRUCT<label STRING, x1 INT, y1 INT, x2 INT, y2 INT>>, cols ARRAY<STRUCT<label STRING, x1 INT, y1 INT, x2 INT, y2 INT>>, lines ARRAY<STRUCT<text STRING, x DOUBLE, y DOUBLE>>",
    )
    out = pages.grid_tables(cells).collect()
    assert bool(out) is kept
    if kept:
        assert out[0].data[0][:3] == ["t0", "t1", "t2"] and out[0]["shape"] == [10, 10]


def test_table_of_exactly_thirty_percent_is_kept(spark):
    df = spark.createDataFrame([([([0, 0, 30, 100],), ([0, 0, 31, 100],)],)], "tables ARRAY<STRUCT<bbox ARRAY<INT>>>")
    assert len(pages.kept_tables(df, F.lit(100), F.lit(100)).first().tables) == 1


def test_boxes(spark):
    df = spark.createDataFrame([([(1.0, 2.0), (5.0, 0.0)],), ([],), (None,)], "p ARRAY<STRUCT<x DOUBLE, y DOUBLE>>")
    rows = df.select(g.centroid(F.col("p")).alias("c"), g.box_of_polygon(F.col("p")).alias("b")).collect()
    assert tuple(rows[0].b) == (1, 0, 5, 2) and tuple(rows[0].c) == (3, 1) and [tuple(r.c) for r in rows[1:]] == [(-1, -1)] * 2 and rows[1].b is None
