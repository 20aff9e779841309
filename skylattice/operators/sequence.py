"""Neighbours, carried values and running sums in long ordered sequences, without one task per sequence.

Rows are windowed inside entity chunks (BLOCK consecutive order keys). One summary row per chunk, at most 2**31 / BLOCK
per entity, carries what the next chunks need; it joins back on the chunk keys, by which the rows are already placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.session import BLOCK

CHUNK = "_chunk"


def annotate(
    df: DataFrame,
    entity: str,
    order: str,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    carry: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """df with more columns. lag / lead: the value in the row before / after. carry: the last non-null value in a row
    before. running: the sum up to and with the row (null counts as 0). (entity, order) must be unique and not null;
    order must be a 32-bit int."""
    lag, lead, carry, running = lag or {}, lead or {}, carry or {}, running or {}
    rows = df.withColumn(CHUNK, F.expr(f"cast(floor(`{order}` / {block}) as int)"))
    for name, c in [*lag.items(), *lead.items(), *carry.items(), *running.items()]:
        rows = rows.withColumn(f"_v_{name}", c)
    rows = rows.repartition(entity, CHUNK)
    at = Window.partitionBy(entity, CHUNK).orderBy(order)
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    upto = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wrap = lambda n: F.struct(F.col(f"_v_{n}").alias("v"))  # noqa: E731  (a struct keeps a null value apart from no row)
    placed = rows.select(
        "*",
        *[F.lag(wrap(n)).over(at).alias(f"_s_{n}") for n in lag],
        *[F.lead(wrap(n)).over(at).alias(f"_s_{n}") for n in lead],
        *[F.last(f"_v_{n}", ignorenulls=True).over(before).alias(f"_s_{n}") for n in carry],
        *[F.sum(F.coalesce(f"_v_{n}", F.lit(0))).over(upto).alias(f"_s_{n}") for n in running],
    )
    ends = rows.groupBy(entity, CHUNK).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(wrap(n), F.col(order)).alias(f"_e_{n}") for n in lag],
        *[F.min_by(wrap(n), F.col(order)).alias(f"_e_{n}") for n in lead],
        *[F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in carry],
        *[F.sum(F.coalesce(f"_v_{n}", F.lit(0))).alias(f"_e_{n}") for n in running],
    )
    over = Window.partitionBy(entity).orderBy(CHUNK)
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(
        F.col(entity).alias("_k0"),
        F.col(CHUNK).alias("_k1"),
        *[F.lag(f"_e_{n}").over(over).alias(f"_o_{n}") for n in lag],
        *[F.lead(f"_e_{n}").over(over).alias(f"_o_{n}") for n in lead],
        *[F.last(f"_e_{n}", ignorenulls=True).over(past).alias(f"_o_{n}") for n in carry],
        *[F.sum(f"_e_{n}").over(past).alias(f"_o_{n}") for n in running],
    )
    joined = placed.join(offsets, (F.col(entity) == F.col("_k0")) & (F.col(CHUNK) == F.col("_k1")), "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_s_{n}", f"_o_{n}")["v"].alias(n) for n in [*lag, *lead]],
        *[F.coalesce(f"_s_{n}", f"_o_{n}").alias(n) for n in carry],
        *[(F.col(f"_s_{n}") + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in running],
    )


def following(df: DataFrame, entity: str, order: str, value: Column, k: int, name: str, block: int = BLOCK) -> DataFrame:
    """df with an array of the values in the next k rows, fewer at an entity's end. (entity, order) must be unique and not
    null; order must be a 32-bit int. One shuffle; a chunk's first k values are handed to the chunks before it."""
    rows = df.withColumn(CHUNK, F.expr(f"cast(floor(`{order}` / {block}) as int)")).withColumn("_v", F.struct(value.alias("v"))).repartition(entity, CHUNK)
    at = Window.partitionBy(entity, CHUNK).orderBy(order)
    placed = rows.select("*", F.collect_list("_v").over(at.rowsBetween(1, k)).alias("_inside"), F.row_number().over(at).alias("_place"))
    heads = placed.where(F.col("_place") <= k).groupBy(entity, CHUNK).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_v"))), lambda s: s["_v"]).alias("_head"))
    over = Window.partitionBy(entity).orderBy(CHUNK).rowsBetween(1, k)  # each chunk has a row, so k chunks have k values
    after = heads.select(F.col(entity).alias("_k0"), F.col(CHUNK).alias("_k1"), F.flatten(F.collect_list("_head").over(over)).alias("_after"))
    joined = placed.join(after, (F.col(entity) == F.col("_k0")) & (F.col(CHUNK) == F.col("_k1")))
    return joined.select(*df.columns, F.transform(F.slice(F.concat("_inside", "_after"), 1, k), lambda s: s["v"]).alias(name))


def runs(df: DataFrame, entity: str, order: str, state: str) -> DataFrame:
    """Gaps and islands: entity, run (from 1), state, length, first_order, last_order of maximal runs of equal state."""
    marked = annotate(df.select(entity, order, state), entity, order, lag={"_before": F.struct(F.col(state).alias("s"))})
    start = (F.col("_before").isNull() | ~F.col("_before")["s"].eqNullSafe(F.col(state))).cast("int")
    numbered = annotate(marked.select(entity, order, state, start.alias("_start")), entity, order, running={"run": F.col("_start")})
    return numbered.groupBy(entity, "run").agg(F.first(state).alias(state), F.count(F.lit(1)).alias("length"), F.min(order).alias("first_order"), F.max(order).alias("last_order"))
