"""Poses in several JSON shapes to x, y, z, yaw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_pose(text: str | Column) -> Column:
    """struct<x, y, z, yaw> of a list [x, y, z(, yaw)], an object {x, y, z, yaw | heading} or {pos, yaw | heading}.
    Null if the text is no JSON or lacks a number; yaw may be null."""
    v = F.try_parse_json(text)
    number = lambda path: F.try_variant_get(v, path, "double")
    at = lambda i, name: F.coalesce(number(f"$[{i}]"), number(f"$.pos[{i}]"), number(f"$.{name}"))
    xyz = [at(i, n) for i, n in enumerate("xyz")]
    yaw = F.coalesce(number("$[3]"), number("$.yaw"), number("$.heading"))
    whole = xyz[0].isNotNull() & xyz[1].isNotNull() & xyz[2].isNotNull()
    return F.when(whole, F.struct(xyz[0].alias("x"), xyz[1].alias("y"), xyz[2].alias("z"), yaw.alias("yaw")))
