"""Expressions over the ordered ``array<struct<start_sec,end_sec>>`` of one video and over single spans.

Bounds are rounded half-even. The arrays hold at most the fold limit of :mod:`reelmill.operators.segmentation`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelmill.functions.columns import round_even

SPANS = "array<struct<start_sec:double,end_sec:double>>"


def span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start_sec"), end.alias("end_sec"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def length(s: Column) -> Column:
    return s["end_sec"] - s["start_sec"]


def _parts(start: Column, end: Column, n: Column, last_end: Column) -> Column:
    """``n`` equal parts of a span, bounds to 2 decimals; the last part ends at ``last_end``."""
    step = (end - start) / n
    return F.transform(
        F.sequence(F.lit(1), n.cast("int")),
        lambda k: span(
            round_even(start + (k - 1) * step, 2),
            F.when(k == n, round_even(last_end, 2)).otherwise(round_even(start + k * step, 2)),
        ),
    )


def split_span(s: Column, max_sec: float | None, min_sec: float) -> Column:
    """One over-long span as equal parts no shorter than ``min_sec``; any other span as it is."""
    if not max_sec or max_sec <= 0:
        return F.array(s)
    dur = length(s)
    wanted = F.greatest(round_even(dur / max_sec, 0), F.lit(1.0))
    n = F.least(wanted, F.greatest(F.lit(1.0), F.floor(dur / max(min_sec, 1)).cast("double")))
    whole = F.array(span(s["start_sec"], s["end_sec"]))
    return F.when((dur <= max_sec) | (n <= 1), whole).otherwise(_parts(s["start_sec"], s["end_sec"], n, s["end_sec"]))


def cover_to(s: Column, duration: Column, max_sec: float, min_sec: float) -> Column:
    """The last span stretched to ``duration``, cut again when that makes it over-long."""
    end = round_even(duration, 2)
    dur = end - s["start_sec"]
    n = F.greatest(F.lit(1.0), round_even(dur / max_sec, 0)) if max_sec else F.lit(1.0)
    if min_sec:
        n = F.least(n, F.greatest(F.lit(1.0), F.floor(dur / max(min_sec, 1)).cast("double")))
    stretched = F.array(span(round_even(s["start_sec"], 2), end))
    if not max_sec:
        return stretched
    return F.when(dur > max_sec, _parts(s["start_sec"], end, n, end)).otherwise(stretched)


def ensure_coverage(spans: Column, duration: Column, max_sec: float = 0, min_sec: float = 0) -> Column:
    """Spans of a video extended to its duration unless the last one ends within a second of it."""
    last = F.element_at(spans, -1)
    head = F.slice(spans, 1, F.size(spans) - 1)
    done = (F.size(spans) == 0) | duration.isNull() | (duration == 0)
    return F.when(done, spans).otherwise(
        F.when(last["end_sec"] >= duration - 1.0, spans).otherwise(F.concat(head, cover_to(last, duration, max_sec, min_sec)))
    )


def _merge_shortest(spans: Column) -> Column:
    """Merge the first shortest span into its shorter neighbour (left on a tie; borders have one neighbour)."""
    lengths = F.transform(spans, length)
    n = F.size(spans)

    def at(shortest: Column) -> Column:
        left = F.get(F.transform(spans, length), shortest - 2)
        right = F.get(F.transform(spans, length), shortest)
        to_left = (shortest > 1) & ((shortest == n) | (left <= right))
        # 1-based position of the first of the two spans that become one
        first = F.when(to_left, shortest - 1).otherwise(shortest)
        return let(
            first,
            lambda i: F.concat(
                F.slice(spans, F.lit(1), i - 1),
                F.array(span(F.element_at(spans, i)["start_sec"], F.element_at(spans, i + 1)["end_sec"])),
                F.slice(spans, i + 2, n),
            ),
        )

    return let(F.array_position(lengths, F.array_min(lengths)).cast("int"), at)


def cap_spans(spans: Column, max_segments: int) -> Column:
    """Repeat the shortest-span merge until at most ``max_segments`` are left."""
    extra = F.greatest(F.size(spans) - max_segments, F.lit(0))
    steps = F.when(extra > 0, F.sequence(F.lit(1), F.greatest(extra, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, spans, lambda acc, _: _merge_shortest(acc))
