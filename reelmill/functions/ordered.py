"""Ordered per-key computations that survive a key holding a large share of all rows.

A plain window over ``partitionBy(video)`` sends a whole video to one task, which is right until one video is huge.
:func:`find_heavy` counts rows per key once (a column-pruned, map-side combined aggregate) and names the *heavy* keys. Without any,
:func:`ordered_scan` is the plain window. With some, their rows are cut into slices by an expression that never decreases along the
order, e.g. the hour of media time: every slice is a window of its own, and what crosses a slice border (row
count, running sum, neighbour value) comes from one summary row per slice. The result is the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.materialize import materialize

HEAVY_FLOOR = 1_000_000
# A heavy key also holds more than this share of all rows, so there are at most 1/HEAVY_SHARE heavy keys:
# the bound on every broadcast of the heavy-key list.
HEAVY_SHARE = 1e-5
AUTO = "auto"


def find_heavy(
    df: DataFrame, keys: list[str], floor: int = HEAVY_FLOOR, share: float = HEAVY_SHARE
) -> DataFrame | None:
    """Keys with more than ``floor`` rows and more than ``share`` of all rows; None when there is no such key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(floor, (total or 0) * share)
    if (most or 0) <= limit:
        return None
    # enough salts for parts of about ``floor`` rows
    salts = F.ceil(F.col("_n") / max(floor, 1)).alias("_salts")
    return materialize(counts.where(F.col("_n") > limit).select(*keys, F.lit(True).alias("_heavy"), salts))


def resolve_heavy(heavy: DataFrame | None | str, df: DataFrame, keys: list[str]) -> DataFrame | None:
    return find_heavy(df, keys) if isinstance(heavy, str) else heavy


@dataclass(frozen=True)
class Ordered:
    """One output column of :func:`ordered_scan`.

    kind: ``row_number`` (1-based), ``sum`` (inclusive running sum), ``lag``, ``lead``, ``last``
    (latest non-null value up to the row), ``count_all``, ``min_all``, ``max_all`` (over the whole key).
    """

    name: str
    kind: str
    value: Column | None = None


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slice_by: Column,
    outputs: list[Ordered],
    heavy: DataFrame | None | str = AUTO,
) -> DataFrame:
    """Add ordered per-key columns to ``df``; ``order`` holds ascending expressions and must be total.

    Pass the result of :func:`find_heavy` on the base table as ``heavy`` when several scans follow each other.
    """
    heavy = resolve_heavy(heavy, df, keys)
    if heavy is None:
        return _plain_scan(df, keys, order, outputs)
    inputs = {o.name: f"_in_{i}" for i, o in enumerate(outputs) if o.value is not None}
    marked = (
        materialize(df)  # read by the rows and by the border summary
        .join(F.broadcast(heavy.select(*keys, "_heavy")), keys, "left")
        .withColumns(
            {"_slice": F.when(F.col("_heavy"), slice_by)}
            | {inputs[o.name]: o.value for o in outputs if o.value is not None}
            | {f"_ord_{i}": c for i, c in enumerate(order)}
        )
    )
    position = F.struct(*[f"_ord_{i}" for i in range(len(order))])
    in_slice = Window.partitionBy(*keys, "_slice")
    along = in_slice.orderBy(*[F.col(f"_ord_{i}") for i in range(len(order))])
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local: dict[str, Column] = {"_first": F.row_number().over(along) == 1}
    summary: list[Column] = []
    carried: dict[str, Column] = {}
    slices = Window.partitionBy(*keys).orderBy("_slice")
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    if any(o.kind == "lead" for o in outputs):
        local["_final"] = F.lead(F.lit(1)).over(along).isNull()

    merged: dict[str, Column] = {}
    for o in outputs:
        v = F.col(inputs[o.name]) if o.value is not None else None
        loc, out, car = f"_loc_{o.name}", f"_sum_{o.name}", f"_car_{o.name}"
        if o.kind == "row_number":
            local[loc] = F.row_number().over(along)
            summary.append(F.count(F.lit(1)).alias(out))
            carried[car] = F.sum(out).over(before)
            merged[o.name] = (F.col(loc) + F.coalesce(F.col(car), F.lit(0))).cast("long")
        elif o.kind == "sum":
            local[loc] = F.sum(v).over(upto)
            summary.append(F.sum(v).alias(out))
            carried[car] = F.sum(out).over(before)
            merged[o.name] = F.when(F.col(car).isNull(), F.col(loc)).otherwise(
                F.coalesce(F.col(loc), F.lit(0)) + F.col(car)
            )
        elif o.kind == "lag":
            local[loc] = F.lag(v).over(along)
            summary.append(F.max_by(v, position).alias(out))
            carried[car] = F.lag(out).over(slices)
            merged[o.name] = F.when(F.col("_first"), F.col(car)).otherwise(F.col(loc))
        elif o.kind == "lead":
            local[loc] = F.lead(v).over(along)
            summary.append(F.min_by(v, position).alias(out))
            carried[car] = F.lead(out).over(slices)
            merged[o.name] = F.when(F.col("_final"), F.col(car)).otherwise(F.col(loc))
        elif o.kind == "last":
            local[loc] = F.last(v, ignorenulls=True).over(upto)
            summary.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(out))
            carried[car] = F.last(out, ignorenulls=True).over(before)
            merged[o.name] = F.coalesce(F.col(loc), F.col(car))
        elif o.kind in ("count_all", "min_all", "max_all"):
            one = F.lit(1)
            fn, fold = {
                "count_all": (lambda c: F.count(one), F.sum),
                "min_all": (F.min, F.min),
                "max_all": (F.max, F.max),
            }[o.kind]
            local[loc] = fn(v).over(in_slice)
            summary.append(fn(v).alias(out))
            carried[car] = fold(out).over(whole)
            merged[o.name] = F.coalesce(F.col(car), F.col(loc))
        else:
            raise ValueError(f"unknown ordered output {o.kind!r}")

    borders = (
        marked.where("_heavy")
        .groupBy(*keys, "_slice")
        .agg(*summary)
        .select(*keys, "_slice", *[c.alias(n) for n, c in carried.items()])
    )
    scanned = marked.select("*", *[c.alias(n) for n, c in local.items()])
    joined = scanned.join(borders, [*keys, "_slice"], "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in merged.items()])


def _plain_scan(df: DataFrame, keys: list[str], order: list[Column], outputs: list[Ordered]) -> DataFrame:
    group = Window.partitionBy(*keys)
    along = group.orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    make = {
        "row_number": lambda v: F.row_number().over(along).cast("long"),
        "sum": lambda v: F.sum(v).over(upto),
        "lag": lambda v: F.lag(v).over(along),
        "lead": lambda v: F.lead(v).over(along),
        "last": lambda v: F.last(v, ignorenulls=True).over(upto),
        "count_all": lambda v: F.count(F.lit(1)).over(group),
        "min_all": lambda v: F.min(v).over(group),
        "max_all": lambda v: F.max(v).over(group),
    }
    return df.select("*", *[make[o.kind](o.value).alias(o.name) for o in outputs])
