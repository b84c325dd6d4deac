"""Mixing sources to target weights by capped water-filling.

A source's target is its weight times a common level, at most its cap (its size
times the maximum number of epochs). What a capped source leaves is shared again
by weight, until no target is above its cap. Each document is then taken whole as
often as its source's target holds the source's size; what remains of the target is
filled with further documents in a seeded order, of which the last is taken in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE, materialize

#: Hex digits of the seeded hash that name a block, within which the order is found; 16 ** 3 blocks a source.
BLOCK_DIGITS = 3


def count_words(text: Column) -> Column:
    """Number of words; 0 for null, empty and blank texts."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(trimmed, f"[{SPACE}]+"))
    ).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Target of each source from ``(source, source_size)``, one row a source.

    Weights are dealt by the source's place in code point order, null last, and repeat.
    The level is found in closed form: sources are ordered by cap over weight, and the
    first one whose cap the level doesn't reach ends the capped ones. Its level is the highest
    of all that reach no cap, as later ones count caps that aren't filled. Sources without
    words get 0. This table has one row a source, so its windows run in one task.
    """
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(epochs))
    order = W.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(1))
    rows = (
        rows.withColumn("want", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("filled", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("want") - F.col("filled")) / F.col("open"))
    )
    reached = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("level", F.coalesce(F.max(reached).over(every), F.lit(float("inf"))))
    fits = F.col("level") * F.col("weight") < F.col("cap")
    target = F.when(fits, F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each document: id, ``size``, ``source_size``, ``target``, ``taken`` (and ``repeats``).

    Every source's ``taken`` adds up to its target, rounded to words. A null source is a
    source of its own; null texts have size 0 and take 0. Rows with the same id and size
    are told apart by nothing, so either may be the one taken more often. The order in a
    source is by a seeded hash of the id: reruns agree. A source of any size is dealt over
    blocks of that hash, and only block totals meet in its running sum.
    """
    md = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), md.alias("h")
        ).withColumn("block", F.substring("h", 1, BLOCK_DIGITS))
    )
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    plan = targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, share, epochs)
    before = F.sum("block_size").over(
        W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    )
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0)))
    blocks = _null_safe(blocks, plan, ["source"]).select(
        "source", "block", "before", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).alias("whole"),
    )
    within = W.partitionBy("source", "block").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = _null_safe(rows, blocks, ["source", "block"])
    left = F.rint("target").cast("long") - F.col("whole") * F.col("source_size") - F.col("before") - F.col("ahead")
    part = F.greatest(F.lit(0), F.least("size", left))
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), F.col("whole").alias("repeats"),
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which null equals null."""
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    return left.join(right, on).drop(*[f"_{k}" for k in keys])


#: DuckDB SQL of :func:`mix` with its default parameters.
SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2 AS cap,
    CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
    - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
level AS (SELECT max(lev) FILTER (lev * weight <= cap) AS lev FROM levels),
plan AS (
  SELECT source, source_size,
    CASE WHEN level.lev * weight < cap THEN level.lev * weight ELSE CAST(cap AS DOUBLE) END AS target
  FROM levels, level),
ordered AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY h, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size,
    CAST(round_even(target, 0) AS BIGINT) - whole * source_size - ahead)) AS BIGINT) AS taken,
  whole AS repeats
FROM ordered
"""
