"""Problem 1: one ranking from several differently scaled scores, by reciprocal rank fusion.

Each score ranks the rows of a list on its own; a row's fused score is the sum of 1 / (k + rank). Only ranks enter, so
neither the unit nor the distribution of a score matters.

Defined results for odd input:
* a missing score (null, NaN) takes no place in its list and adds nothing to the sum; a row without any score has fused
  score 0 and comes last;
* equal scores share the best place (1 + number of rows strictly higher), repeated rows each count;
* null list keys form one list, as in GROUP BY; infinities rank above (below) all finite values;
* an empty input gives an empty result; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places a power of two of the value range is cut into when a list is ranked; only the work is divided by this, not the result.
STEPS_PER_OCTAVE = 128
_OFFSET = 1 << 20


def _bucket(value: Column) -> Column:
    """A number that never falls when ``value`` rises, so that a list can be ranked bucket by bucket."""
    size = F.abs(value)
    steps = F.floor(F.log2(F.greatest(F.least(size, F.lit(1e300)), F.lit(1e-300))) * STEPS_PER_OCTAVE).cast("int") + _OFFSET
    return F.when(value > 0, steps).when(value < 0, -steps).otherwise(F.lit(0))


def value_ranks(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Place of every distinct ``value`` in its list: (keys, value, _place).

    Rows are first counted a distinct value, on the map side. A list is then ranked in buckets of its value range: a window
    runs over one bucket only, and the buckets above it are added as one sum. So a list that holds a third of all rows is
    spread over its buckets, and a value that many rows share is one row.
    """
    counted = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", _bucket(F.col(value)))
    spot = [*keys, "_bucket"]
    inside = Window.partitionBy(*spot).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_above", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    higher = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*spot).agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(higher), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(f"_t_{k}") for k in spot], "_before")
    on = reduce(lambda a, b: a & b, (counted[k].eqNullSafe(totals[f"_t_{k}"]) for k in spot))
    return counted.join(totals, on).select(*keys, value, (F.col("_above") + F.col("_before") + 1).alias("_place"))


def reciprocal_rank_fusion(
    df: DataFrame, keys: Sequence[str], scores: Mapping[str, Column], row_id: str, k: float = 60.0, fused_rank: bool = True
) -> DataFrame:
    """Rank the rows of every list (``keys``) by several scores at once.

    Returns row_id, the keys, ``rank_<score>`` (null where the score is missing), ``rrf`` and, if asked for, ``fused_rank``.
    Working columns have names of their own, so that columns of the input can't clash with them.
    """
    names = list(scores)
    lists = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(
        F.col(row_id).alias("_row"),
        *[F.col(c).alias(a) for c, a in zip(keys, lists)],
        *[F.when(~F.isnan(scores[s].cast("double")), scores[s].cast("double")).alias(f"_s{i}") for i, s in enumerate(names)],
    )
    # -0.0 equals 0.0 in comparisons but not as a key
    rows = rows.select("_row", *lists, *[(F.col(f"_s{i}") + F.lit(0.0)).alias(f"_s{i}") for i in range(len(names))])
    stacked = rows.select(
        *lists, F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(f"_s{i}").alias("value")) for i in range(len(names))])).alias("_x")
    ).select(*lists, F.col("_x.which").alias("_which"), F.col("_x.value").alias("_value")).where(F.col("_value").isNotNull())
    ranks = value_ranks(stacked, [*lists, "_which"], "_value")
    out = rows
    for i in range(len(names)):
        mine = ranks.where(F.col("_which") == i).select(*[F.col(a).alias(f"_r{a}") for a in lists], F.col("_value").alias("_rv"), F.col("_place").alias(f"_p{i}"))
        on = reduce(lambda a, b: a & b, [out[a].eqNullSafe(mine[f"_r{a}"]) for a in lists] + [out[f"_s{i}"] == mine["_rv"]])
        out = out.join(mine, on, "left").drop("_rv", *[f"_r{a}" for a in lists])
    part = [F.coalesce(1.0 / (F.lit(float(k)) + F.col(f"_p{i}")), F.lit(0.0)) for i in range(len(names))]
    out = out.withColumn("_rrf", reduce(lambda a, b: a + b, part))
    if fused_rank:
        places = value_ranks(out.select(*lists, "_rrf"), lists, "_rrf")
        places = places.select(*[F.col(a).alias(f"_r{a}") for a in lists], F.col("_rrf").alias("_rv"), F.col("_place").alias("_fused"))
        on = reduce(lambda a, b: a & b, [out[a].eqNullSafe(places[f"_r{a}"]) for a in lists] + [out["_rrf"] == places["_rv"]])
        out = out.join(places, on, "left")
    return out.select(
        F.col("_row").alias(row_id),
        *[F.col(a).alias(c) for c, a in zip(keys, lists)],
        *[F.col(f"_p{i}").alias(f"rank_{s}") for i, s in enumerate(names)],
        F.col("_rrf").alias("rrf"),
        *([F.col("_fused").alias("fused_rank")] if fused_rank else []),
    )


def page_confidence_share(column: Column) -> Column:
    """A page confidence as a share: above 1 it is a percentage, below 0 (or NaN) unknown."""
    return F.when(column.isNull() | F.isnan(column) | (column < 0), None).when(column > 1, F.round(column / 100, 4)).otherwise(column)


def candidate_ranking(approaches: DataFrame, fused_rank: bool = True) -> DataFrame:
    """The three scores of candidate rows fused within each list of a run and a field."""
    scores = {
        "strategy_score": F.col("strategy_score"),
        "page_confidence": page_confidence_share(F.col("page_confidence")),
        "ensemble_score": F.col("ensemble_score"),
    }
    return reciprocal_rank_fusion(approaches, ["run_id", "field_name"], scores, "row_id", fused_rank=fused_rank)


def top_by_every_score(ranking: DataFrame, top: int = 20, k: float = 60.0) -> DataFrame:
    """Rows of a fused ranking within the first ``top`` of their list by each score taken alone.

    Such a row's fused score is at least that of a row at place ``top`` in every list; the fused score selects, the places verify.
    """
    places = [c for c in ranking.columns if c.startswith("rank_")]
    least = len(places) / (k + top) * (1 - 1e-12)
    return ranking.where(F.col("rrf") >= F.lit(least)).where(reduce(lambda a, b: a & b, (F.col(c) <= top for c in places)))
