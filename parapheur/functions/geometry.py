"""Boxes, tables and words of a page as Column expressions on arrays: no shuffle, no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapheur.functions.text import let, words

#: Pixels by which a table's box is widened when lines are masked.
MASK_PADDING = 8
#: A table that covers more of its page than this is the page's body.
MAX_TABLE_SHARE = 0.30
#: A grid with fewer filled cells than this is no table.
MIN_FILLED = 0.3


def box_of_points(xs: Column, ys: Column) -> Column:
    """STRUCT<x1, y1, x2, y2> around points; null without any."""
    box = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    return F.when(F.size(xs) > 0, box)


def box_of_polygon(polygon: Column) -> Column:
    return box_of_points(F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"]))


def box_of_cells(cells: Column) -> Column:
    """The box around the boxes of a table's cells; zeros where no cell has one."""
    present = F.filter(cells, lambda c: c.isNotNull())
    side = lambda name: F.transform(present, lambda c: c[name])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.struct(
        zero(F.array_min(side("x1"))).alias("x1"), zero(F.array_min(side("y1"))).alias("y1"), zero(F.array_max(side("x2"))).alias("x2"), zero(F.array_max(side("y2"))).alias("y2")
    )


def centroid(polygon: Column) -> Column:
    """STRUCT<x, y>, the mean of a polygon's points; (-1, -1) without any, which lies in no box."""
    mean = lambda name: F.aggregate(polygon, F.lit(0.0), lambda a, p: a + p[name].cast("double")) / F.size(polygon)
    none = F.struct(F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y"))
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y"))).otherwise(none)


def inside_any(x: Column, y: Column, boxes: Column, padding: int = MASK_PADDING) -> Column:
    """Whether a point lies in one of the boxes (ARRAY<x1, y1, x2, y2>), widened by the padding, edges included."""
    near = lambda b: x.between(b[0] - padding, b[2] + padding) & y.between(b[1] - padding, b[3] + padding)
    return F.coalesce(F.exists(boxes, near), F.lit(False))


def area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0)).cast("long") * F.greatest(box[3] - box[1], F.lit(0)).cast("long")


def filled_share(data: Column) -> Column:
    """Share of cells that hold something, to 2 places; 0 for a table without cells."""
    cells = F.flatten(F.filter(data, lambda r: r.isNotNull()))
    filled = F.size(F.filter(cells, lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0))
    return F.when(F.coalesce(F.size(cells), F.lit(0)) > 0, F.round(filled / F.size(cells), 2)).otherwise(0.0)


def shape(data: Column) -> Column:
    return F.array(F.coalesce(F.size(data), F.lit(0)), F.coalesce(F.size(F.get(data, F.lit(0))), F.lit(0)))


def first_interval(point: Column, intervals: Column, low: str, high: str) -> Column:
    """0-based place of the first interval that holds the point, edges included; null if none does."""
    place = F.array_position(F.transform(intervals, lambda b: point.between(b[low], b[high])), F.lit(True))
    return let(place, lambda p: F.when(p > 0, (p - 1).cast("int")))


def grid(lines: Column, rows: Column, columns: Column) -> Column:
    """ARRAY<ARRAY<STRING>> of a table: each line's text goes to the first row and column its centre lies in, in reading order.

    ``lines``: ARRAY<STRUCT<text, x, y>>, ``rows``: boxes in order of y1, ``columns``: boxes in order of x1.
    """
    placed = F.transform(
        lines, lambda w: F.struct(w["text"].alias("text"), first_interval(w["y"], rows, "y1", "y2").alias("r"), first_interval(w["x"], columns, "x1", "x2").alias("c"))
    )
    cell = lambda all_, r, c: F.array_join(F.transform(F.filter(all_, lambda w: (w["r"] == r) & (w["c"] == c)), lambda w: w["text"]), " ")
    return let(placed, lambda all_: F.transform(rows, lambda _, r: F.transform(columns, lambda __, c: cell(all_, r, c))))


def word_boxes(line: Column, x1: Column, x2: Column) -> Column:
    """ARRAY<STRUCT<value, x1, x2>>: a line's words with the width shared out by letters, half a letter between words.

    Places are whole pixels cut off at every step; the last word ends where the line ends.
    """
    parts = words(line)

    def laid_out(ws: Column) -> Column:
        letters = F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w))
        width = F.greatest(x2 - x1, F.lit(1)) / (letters + (F.size(ws) - 1) * 0.5)

        def place(unit: Column) -> Column:
            empty = F.array().cast("array<struct<value:string,x1:int,x2:int>>")

            def add(done: Column, w: Column) -> Column:
                start = F.when(F.size(done) == 0, x1.cast("int")).otherwise(F.coalesce(F.get(done, F.size(done) - 1)["x2"], F.lit(0)) + F.floor(0.5 * unit).cast("int"))
                return let(start, lambda s: F.concat(done, F.array(F.struct(w.alias("value"), s.alias("x1"), (s + F.floor(F.length(w) * unit).cast("int")).alias("x2")))))

            return F.aggregate(ws, empty, add)

        boxes = let(width, place)
        return let(boxes, lambda b: F.transform(b, lambda w, i: F.when(i == F.size(b) - 1, F.struct(w["value"].alias("value"), w["x1"].alias("x1"), x2.cast("int").alias("x2"))).otherwise(w)))

    return F.when(F.size(parts) > 0, let(parts, laid_out))


def cells_of_text(text: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: the cells of a table written as comma-separated lines; blank lines are no rows."""
    rows = F.filter(F.split(text, "\n", -1), lambda r: F.trim(r) != "")
    return F.transform(rows, lambda r: F.transform(F.split(r, ",", -1), lambda c: F.trim(c)))
