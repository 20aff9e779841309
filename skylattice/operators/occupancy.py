"""Voxel and column grids over point clouds, and lookups, neighbourhoods and rays against them.

Everything is keyed by integer cells, so neighbourhoods and rays become exploded offsets and equi-joins. A crowded cell
is reduced by partial aggregation before the shuffle; rays are cut to range before they are sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators import tiles
from skylattice.operators.chunks import by_chunk, changes, codes, whole_chunks
from skylattice.session import materialize


@dataclass(frozen=True)
class Grid:
    """Cell size and height bands in map metres (z up). Defaults are fixed values."""

    voxel: float = 1.5
    elevation: float = 0.0
    building: float = 6.0
    ground_below: float = 2.0
    support: float = 0.8
    obstacle: float = 0.6
    least_points: int = 2
    road_extent: float = 5.0
    large: float = 12.0
    large_cells: int = 9
    agl: float = 0.35


#: Cell numbers stay below this, as components() needs. Coordinates beyond REAL metres are impossible readings: nothing is sampled along them.
CELLS, REAL = 1 << 30, 1e5


def cell(c: Column, size: float) -> Column:
    """The number of the cell, null where there is none (NaN, infinite, or beyond what a cell number can say)."""
    return F.when(F.abs(c) < F.lit(size * CELLS), F.floor(c / F.lit(size)).cast("int"))


def real(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.abs(c) < REAL, F.lit(False))
    return out


def within(reach: float | None) -> Column:
    """Whether a ray (ax..az, bx..bz) is no longer than reach; false where it has no length."""
    if reach is None:
        return F.lit(True)
    return F.coalesce(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0)) <= reach * reach, F.lit(False))


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    return out


def placed(points: DataFrame, g: Grid) -> DataFrame:
    """Points that have a cell, with that cell ix, iy, iz."""
    return points.select("x", "y", "z", *[cell(F.col(c), g.voxel).alias(f"i{c}") for c in "xyz"]).dropna(subset=["ix", "iy", "iz"])


def voxels(points: DataFrame, g: Grid = Grid()) -> DataFrame:
    return placed(points, g).select("ix", "iy", "iz").distinct()


def extents(points: DataFrame, g: Grid = Grid()) -> tuple[DataFrame, DataFrame]:
    """The voxels ix, iy, iz and, per column, roof_z, ground_z, blocks and is_building as columns2d and building_flags have
    them, from one pass over the points."""
    band = (F.col("z") >= g.elevation - g.ground_below) & (F.col("z") < g.elevation + g.building)
    v = materialize(placed(points, g).groupBy("ix", "iy", "iz").agg(F.max("z").alias("high"), F.min("z").alias("low"), F.min(F.when(band, F.col("z"))).alias("ground")), "extents")
    roof, low = F.max("high"), F.min("low")
    columns = v.groupBy("ix", "iy").agg(roof.alias("roof_z"), F.min("ground").alias("ground_z"), (roof - low > g.road_extent).alias("blocks"), (roof >= g.elevation + g.building).alias("is_building"))
    return v.select("ix", "iy", "iz"), columns


def columns2d(points: DataFrame, g: Grid = Grid()) -> DataFrame:
    """Per column: roof_z, low_z, ground_z (lowest in the ground band), support (points just above it), obstacles (points
    above that and below building height), is_building, is_obstacle. Two aggregations; the first one's result is small."""
    p = placed(points, g)
    band = (F.col("z") >= g.elevation - g.ground_below) & (F.col("z") < g.elevation + g.building)
    first = p.groupBy("ix", "iy").agg(F.max("z").alias("roof_z"), F.min("z").alias("low_z"), F.min(F.when(band, F.col("z"))).alias("ground_z"), F.count(F.lit(1)).alias("points"))
    ground = first.select("ix", "iy", "ground_z").where("ground_z is not null")
    above = p.where(band).join(ground, ["ix", "iy"]).withColumn("h", F.col("z") - F.col("ground_z"))
    second = above.groupBy("ix", "iy").agg(F.count_if(F.col("h") <= g.support).alias("support"), F.count_if(F.col("h") >= g.obstacle).alias("obstacles"))
    out = first.join(second, ["ix", "iy"], "left").fillna(0, ["support", "obstacles"])
    return out.withColumn("is_building", F.col("roof_z") >= g.elevation + g.building).withColumn("is_obstacle", F.col("obstacles") >= g.least_points)


def square(radius: int, centre: bool = True) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if centre or i or j])


def disc(radius: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius])


def sphere(radius: int) -> Column:
    r = range(-radius, radius + 1)
    return F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("dz")) for i in r for j in r for k in r if i * i + j * j + k * k <= radius * radius])


def dilated2d(cells: DataFrame, radius: int) -> DataFrame:
    spread = cells.select("ix", "iy", F.explode(disc(radius)).alias("o"))
    return spread.select((F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy")).distinct()


def dilated3d(cells: DataFrame, radius: int) -> DataFrame:
    spread = cells.select("ix", "iy", "iz", F.explode(sphere(radius)).alias("o"))
    return spread.select(*[(F.col(f"i{c}") + F.col(f"o.d{c}")).alias(f"i{c}") for c in "xyz"]).distinct()


def neighbours(cells: DataFrame, radius: int = 2) -> DataFrame:
    """ix, iy, footprint: cells of the set within the square around each cell of it."""
    spread = cells.select("ix", "iy", F.explode(square(radius)).alias("o")).select((F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"))
    counts = spread.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("footprint"))
    return cells.select("ix", "iy").join(counts, ["ix", "iy"])


def building_flags(columns: DataFrame, g: Grid = Grid()) -> DataFrame:
    """columns with footprint, extent, blocks (occupied and not just road) and is_large (a building that hides a car)."""
    walls = neighbours(columns.where("is_building"), 2)
    out = columns.join(walls, ["ix", "iy"], "left").fillna(0, ["footprint"]).withColumn("extent", F.col("roof_z") - F.col("low_z"))
    high = F.col("roof_z") >= g.elevation + max(g.building, g.large)
    return out.withColumn("blocks", F.col("extent") > g.road_extent).withColumn("is_large", F.col("blocks") & F.col("is_building") & high & (F.col("footprint") >= g.large_cells))


def occupied(points: DataFrame, voxel_set: DataFrame, g: Grid = Grid()) -> DataFrame:
    """points with a flag whether their voxel is in the set, null for a point without a voxel."""
    keyed = points.withColumns({f"_i{c}": cell(F.col(c), g.voxel) for c in "xyz"})
    marks = voxel_set.select(*[F.col(f"i{c}").alias(f"_i{c}") for c in "xyz"]).distinct().withColumn("occupied", F.lit(True))
    return keyed.join(marks, ["_ix", "_iy", "_iz"], "left").select(*points.columns, F.when(F.col("_ix").isNotNull() & F.col("_iy").isNotNull() & F.col("_iz").isNotNull(), F.coalesce("occupied", F.lit(False))).alias("occupied"))


def samples(rays: DataFrame, g: Grid, least: int = 4) -> DataFrame:
    """The inner sample points of each ray (ray_id, ax..az, bx..bz): ray_id, step, steps, t, ix, iy, iz, x, y, z."""
    length = F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    steps = F.greatest(F.lit(least), F.floor(length / g.voxel).cast("int"))
    on = rays.withColumn("steps", steps).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps") - 1))).withColumn("t", F.col("step") / F.col("steps"))
    for c in "xyz":
        on = on.withColumn(c, F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("t"))
    return on.select("ray_id", "step", "steps", "t", "x", "y", "z", *[cell(F.col(c), g.voxel).alias(f"i{c}") for c in "xyz"])


def line_of_sight(rays: DataFrame, voxel_set: DataFrame, flags: DataFrame, g: Grid = Grid(), largest: bool = False, reach: float | None = None) -> DataFrame:
    """ray_id, blocked, first_t: whether an occupied voxel of a blocking column lies on the ray and where the first one
    is. With largest, only large buildings block. Rays beyond reach are not sampled; blocked is null for them."""
    solid = voxel_set.join(flags.where("is_large" if largest else "blocks").select("ix", "iy"), ["ix", "iy"], "left_semi")
    hits = samples(rays.where(within(reach)), g).join(solid, ["ix", "iy", "iz"]).groupBy("ray_id").agg(F.min("t").alias("first_t"))
    return rays.select("ray_id", within(reach).alias("near")).join(hits, "ray_id", "left").select("ray_id", F.when(F.col("near"), F.col("first_t").isNotNull()).alias("blocked"), "first_t")


def roof_los(rays: DataFrame, columns: DataFrame, g: Grid = Grid(), margin: float = 1.5, skip: float = 2.0, reach: float | None = None) -> DataFrame:
    """ray_id, blocked: a sample below a column's roof by more than margin, leaving out `skip` metres at both ends. Rays
    beyond reach are not sampled; blocked is null for them."""
    length = F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    inner = samples(rays.where(within(reach)), g).join(rays.select("ray_id", length.alias("length")), "ray_id").where((F.col("t") * F.col("length") >= skip) & ((1 - F.col("t")) * F.col("length") >= skip))
    hits = inner.join(columns.select("ix", "iy", "roof_z"), ["ix", "iy"]).groupBy("ray_id").agg(F.max(F.col("z") < F.col("roof_z") - margin).alias("blocked"))
    return rays.select("ray_id", within(reach).alias("near")).join(hits, "ray_id", "left").select("ray_id", F.when(F.col("near"), F.coalesce("blocked", F.lit(False))).alias("blocked"))


def nearest(points: DataFrame, sites: DataFrame, reach: float) -> DataFrame:
    """point_id, site_id, distance of the nearest site (site_id, x, y) within reach of each point (point_id, x, y); ties
    go to the smaller id. Points and sites meet in tiles of two by two cells as large as the reach; a point is shuffled once
    and looks at the sites near it only, however many a tile has."""
    cells = lambda df: df.withColumns({f"i{c}": cell(F.col(c), reach) for c in "xy"}).dropna(subset=["ix", "iy"])
    kinds = dict(points.dtypes)["point_id"], dict(sites.dtypes)["site_id"]

    def answer(questions: pa.Table, around: pa.Table, corner: tuple[int, int]) -> pa.Table:
        ids = around["site_id"]
        out = [pa.table([questions["point_id"].slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], ["point_id", "site_id", "distance"])]
        if around.num_rows:
            around = around.sort_by("site_id")
            near = tiles.Sites(*tiles.numbers(around, "x", "y"), reach)
            for lo in range(0, questions.num_rows, 4096):
                part = questions.slice(lo, 4096)
                number, distance = near.nearest(*tiles.numbers(part, "x", "y"))
                found = number >= 0
                out.append(pa.table([part["point_id"].filter(pa.array(found)), around["site_id"].take(pa.array(number[found])), pa.array(distance[found])], ["point_id", "site_id", "distance"]))
        return pa.concat_tables(out)

    asked = cells(points).select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *[tiles.tile(F.col(f"i{c}"), 2).alias(f"t{c}") for c in "xy"])
    return tiles.answered(asked, cells(sites).select("site_id", "x", "y", "ix", "iy"), 2, answer, f"point_id {kinds[0]}, site_id {kinds[1]}, distance double")


def site_pairs(sites: DataFrame, lo: float, hi: float) -> DataFrame:
    """site_a < site_b whose distance lies in [lo, hi]; a site is bound to meet only those of the nine cells around."""
    a = sites.withColumn("o", F.explode(square(1))).select(F.col("site_id").alias("site_a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (cell(F.col("x"), hi) + F.col("o.dx")).alias("cx"), (cell(F.col("y"), hi) + F.col("o.dy")).alias("cy"))
    b = sites.select(F.col("site_id").alias("site_b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell(F.col("x"), hi).alias("cx"), cell(F.col("y"), hi).alias("cy"))
    gap = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return a.join(b, ["cx", "cy"]).where("site_a < site_b").withColumn("gap", gap).where(F.col("gap").between(lo, hi)).select("site_a", "site_b", "gap")


def free_runs(starts: DataFrame, blocked: DataFrame, headings: int, reach: int) -> DataFrame:
    """For each start (start_id, ix, iy) and heading number: free, the cells ahead before the first blocked one. Offsets
    along each heading are constants, so a start meets the blocked cells by an equi-join."""
    rows = [(h, s, round(s * math.cos(2 * math.pi * h / headings)), round(s * math.sin(2 * math.pi * h / headings))) for h in range(headings) for s in range(1, reach + 1)]
    offsets = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(s).alias("s"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for h, s, dx, dy in rows])
    spread = starts.select("start_id", "ix", "iy", F.explode(offsets).alias("o")).select("start_id", F.col("o.h").alias("heading"), F.col("o.s").alias("s"), (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"))
    hit = spread.join(blocked.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi").groupBy("start_id", "heading").agg(F.min("s").alias("hit"))
    every = starts.select("start_id", F.explode(F.sequence(F.lit(0), F.lit(headings - 1))).alias("heading"))
    return every.join(hit, ["start_id", "heading"], "left").select("start_id", "heading", (F.coalesce("hit", F.lit(reach + 1)) - 1).alias("free"))


def corridor(free: DataFrame, headings: int) -> DataFrame:
    """start_id, heading, forward, back, width (free cells to both sides plus the start's own), road score and the best
    heading's place among the start's headings (ties to the smaller heading)."""
    q = headings // 4
    by = free.groupBy("start_id").agg(F.map_from_entries(F.collect_list(F.struct("heading", "free"))).alias("m"))
    on = by.select("start_id", "m", F.explode(F.sequence(F.lit(0), F.lit(headings - 1))).alias("heading"))
    at = lambda k: F.element_at(F.col("m"), F.pmod(F.col("heading") + k, F.lit(headings)).cast("int"))
    scored = on.select("start_id", "heading", at(0).alias("forward"), at(headings // 2).alias("back"), (at(q) + at(3 * q) + 1).alias("width"))
    scored = scored.withColumn("score", F.col("forward") + 0.25 * F.col("back") + 2.0 * F.col("width"))
    place = F.row_number().over(Window.partitionBy("start_id").orderBy(F.desc("score"), "heading"))
    return scored.withColumn("place", place)


def resolved_moves(moves: DataFrame, blocked: DataFrame, g: Grid = Grid(), shares: tuple[float, ...] = (1.0, 0.75, 0.5, 0.25, 0.1, 0.05)) -> DataFrame:
    """move_id, share: the largest share of each move (move_id, ax, ay, bx, by) whose way is free of blocked cells; 0 if
    none is, null where an end is an impossible reading. All shares are tested at once."""
    ends = real(*[F.col(c) for c in ("ax", "ay", "bx", "by")])
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    n = F.greatest(F.lit(2), F.ceil(length / (g.voxel * 0.5)).cast("int"))
    steps = moves.where(ends).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.col("k") / F.col("n")
    on = steps.select("move_id", t.alias("t"), cell(F.col("ax") + (F.col("bx") - F.col("ax")) * t, g.voxel).alias("ix"), cell(F.col("ay") + (F.col("by") - F.col("ay")) * t, g.voxel).alias("iy"))
    wall = on.join(blocked.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi").groupBy("move_id").agg(F.min("t").alias("wall"))
    best = F.lit(0.0)
    for s in sorted(shares):
        best = F.when(F.col("wall").isNull() | (F.col("wall") > s), F.lit(s)).otherwise(best)
    return moves.select("move_id", ends.alias("ends")).join(wall, "move_id", "left").select("move_id", F.when(F.col("ends"), best).alias("share"))


#: Cells along a side of a tile whose components one task finds.
TILE = 64


def tile_labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ix, iy, label of the cells of whole tiles, joined within their tile; label is the smallest cell number."""
    for table in whole_chunks(batches, ["tx", "ty"]):
        x, y = codes(table["ix"]).astype(np.int64), codes(table["iy"]).astype(np.int64)
        tile = np.cumsum(changes([codes(table["tx"]), codes(table["ty"])])) - 1
        # each cell finds those to one side of it; other pairs are found from the other end
        place = (tile * (TILE + 2) + x % TILE + 1) * (TILE + 2) + y % TILE + 1
        order = np.argsort(place)
        ranked = place[order]
        label = np.arange(len(x))
        ends = []
        for step in (1, TILE + 1, TILE + 2, TILE + 3):
            at = np.minimum(np.searchsorted(ranked, place + step), len(x) - 1)
            hit = np.flatnonzero(ranked[at] == place + step)
            ends.append((hit, order[at[hit]]))
        a, b = (np.concatenate(e) for e in zip(*ends))
        number = (x + (1 << 30)) * (1 << 31) + y + (1 << 30)
        rank = np.argsort(np.argsort(number))
        label = rank.copy()
        by_rank = np.argsort(rank)
        while True:  # take over smaller neighbours' labels and follow them, as components do between tiles
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            np.minimum.at(new, by_rank[label], new)
            new = new[by_rank[new]]
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([table["ix"].combine_chunks(), table["iy"].combine_chunks(), pa.array(number[by_rank[label]])], ["ix", "iy", "label"])


def linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label of the connected components of a graph: nodes (node bigint, each once), edges (node, other, in both
    directions); label is the smallest node.

    Labels of neighbours are taken over and then followed to their own labels (pointer jumping), so the number of rounds
    grows with the logarithm of a component's length. Each round is written to the shared folder; only whether there were
    changes reaches the driver."""
    labels = nodes.select("node", F.col("node").alias("label"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label")
        # hook: the old label's node learns the smaller label too, then every node follows its label once
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("least"))
        pair = labels.join(least, "node")
        roots = pair.groupBy("label").agg(F.min("least").alias("root"))
        hooked = pair.join(roots, "label").select("node", "label", F.least("least", "root").alias("new"))
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = materialize(hooked.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("new"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("changed")), "cc-labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("changed").isEmpty():
            return labels


def components(cells: DataFrame) -> DataFrame:
    """ix, iy, label of the connected components (eight neighbours) of a set of cells; label is the smallest cell number.

    Cells are joined within tiles first, in one pass; what is left is a small graph of the parts that touch across the
    borders of tiles, and only that goes through the rounds of linked."""
    tile = [F.expr(f"cast(floor(i{c} / {TILE}) as int)").alias(f"t{c}") for c in "xy"]
    tiled = by_chunk(cells.select("ix", "iy").distinct().select("ix", "iy", *tile), ["tx", "ty"], ["ix", "iy"])
    parts = materialize(tiled.mapInArrow(tile_labels, "ix int, iy int, label bigint"), "cc-parts")
    rim = parts.where(F.pmod("ix", F.lit(TILE)).isin(0, TILE - 1) | F.pmod("iy", F.lit(TILE)).isin(0, TILE - 1))
    around = rim.select(F.col("label").alias("node"), F.explode(square(1, centre=False)).alias("o"), "ix", "iy").select("node", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"))
    edges = materialize(around.join(rim.select("ix", "iy", F.col("label").alias("other")), ["ix", "iy"]).where("node <> other").select("node", "other").distinct(), "cc-edges")
    names = linked(edges.select("node").distinct(), edges)
    return parts.join(names.withColumnRenamed("label", "least"), F.col("label") == F.col("node"), "left").select("ix", "iy", F.coalesce("least", "label").alias("label"))


def column_floor(points: DataFrame, size: float, least: int = 5, share: float = 0.2, bin_size: float = 0.5) -> DataFrame:
    """ix, iy, floor: the lowest height bin with at least `share` of the fullest bin's points, over the middle 98 % of a
    column's heights; columns of fewer than `least` points are left out. Height bins are fixed multiples of bin_size, so
    the counts combine before the shuffle."""
    p = points.where(finite(F.col("x"), F.col("y"), F.col("z"))).select(cell(F.col("x"), size).alias("ix"), cell(F.col("y"), size).alias("iy"), F.floor(F.col("z") / F.lit(bin_size)).alias("b")).dropna(subset=["ix", "iy"])
    bins = p.groupBy("ix", "iy", "b").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("ix", "iy")
    up = of.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.select("ix", "iy", "b", "n", F.sum("n").over(of).alias("total"), F.sum("n").over(up).alias("upto"))
    inside = ranked.where((F.col("total") >= least) & (F.col("upto") > 0.01 * F.col("total")) & (F.col("upto") - F.col("n") < 0.99 * F.col("total")))
    peak = inside.withColumn("peak", F.max("n").over(of))
    return peak.where(F.col("n") >= share * F.col("peak")).groupBy("ix", "iy").agg((F.min("b") * F.lit(bin_size)).alias("floor"))


def openness(points: DataFrame, floors: DataFrame, size: float, slab: float = 1.0) -> DataFrame:
    """ix, iy, open: share of a column's points within slab of its floor."""
    p = points.where(finite(F.col("x"), F.col("y"), F.col("z"))).select(cell(F.col("x"), size).alias("ix"), cell(F.col("y"), size).alias("iy"), "z")
    return p.join(floors, ["ix", "iy"]).groupBy("ix", "iy").agg(F.avg((F.col("z") <= F.col("floor") + slab).cast("double")).alias("open"))


def parked_cars(points: DataFrame, floors: DataFrame, size: float, band: tuple[float, float] = (0.3, 2.2), sky: float = 4.0, extent: tuple[float, float] = (1.3, 7.0), least: int = 25) -> DataFrame:
    """label, points, width_x, width_y: groups of touching cells with points in the car band and nothing above."""
    p = points.where(finite(F.col("x"), F.col("y"), F.col("z"))).select("x", "y", "z", cell(F.col("x"), size).alias("ix"), cell(F.col("y"), size).alias("iy"))
    h = F.col("z") - F.col("floor")
    high = p.join(floors, ["ix", "iy"]).withColumn("h", h)
    open_ = high.groupBy("ix", "iy").agg(F.max("h").alias("top")).where(F.col("top") < sky).select("ix", "iy")
    body = high.where(F.col("h").between(*band)).join(open_, ["ix", "iy"], "left_semi")
    labels = components(body.select("ix", "iy"))
    boxes = body.join(labels, ["ix", "iy"]).groupBy("label").agg(F.count(F.lit(1)).alias("points"), (F.max("x") - F.min("x")).alias("width_x"), (F.max("y") - F.min("y")).alias("width_y"))
    longest = F.greatest("width_x", "width_y")
    return boxes.where((F.col("points") >= least) & longest.between(*extent))


def risk_field(blocked: DataFrame, g: Grid = Grid(), decay: float = 9.0) -> DataFrame:
    """ix, iy, edge, alley, risk of free cells within decay of a blocked one: how near the wall is, and on how many of
    the four sides there is one within three cells."""
    radius = int(decay / g.voxel)
    walls = blocked.select("ix", "iy").distinct()
    spread = walls.select("ix", "iy", F.explode(disc(radius)).alias("o")).select((F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"))
    d = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")) * g.voxel
    side = lambda a, b, sign: F.max(((F.col(a) == 0) & (F.col(b) * sign).between(1, 3)).cast("int"))
    cells = spread.groupBy("ix", "iy").agg(F.min(d).alias("d"), (side("dx", "dy", 1) + side("dx", "dy", -1)).alias("ns"), (side("dy", "dx", 1) + side("dy", "dx", -1)).alias("ew"))
    free = cells.join(walls, ["ix", "iy"], "left_anti")
    edge = F.greatest(F.lit(0.0), 1.0 - F.col("d") / decay)
    alley = F.when((F.col("ns") == 2) | (F.col("ew") == 2), 1.0).otherwise(F.least(F.lit(1.0), (F.col("ns") + F.col("ew")) / 2.0))
    out = free.select("ix", "iy", edge.alias("edge"), alley.alias("alley"))
    return out.withColumn("risk", F.least(F.lit(1.0), F.greatest(0.70 * F.col("alley"), 0.78 * F.col("edge"))))


def lookup_heights(points: DataFrame, columns: DataFrame, g: Grid = Grid(), clearance: float = 8.0) -> DataFrame:
    """points (point_id, x, y) with roof, ground (elevation where unknown), safe height and the height of a car there; all
    null for a point without a place."""
    keyed = points.withColumn("ix", cell(F.col("x"), g.voxel)).withColumn("iy", cell(F.col("y"), g.voxel))
    found = keyed.join(columns.select("ix", "iy", "roof_z", "ground_z"), ["ix", "iy"], "left")
    somewhere = F.col("ix").isNotNull() & F.col("iy").isNotNull()
    roof, ground = (F.when(somewhere, F.coalesce(c, F.lit(g.elevation))) for c in ("roof_z", "ground_z"))
    return found.select("point_id", roof.alias("roof"), ground.alias("ground"), (roof + clearance).alias("safe"), (ground + g.agl).alias("car"))
