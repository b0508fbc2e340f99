"""Scalar column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122, as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stable_uuid(path: Column) -> Column:
    """Name-based (version 5) UUID of a path in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(path, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def safe_stem(path: Column, video_id: Column) -> Column:
    """File-name-safe stem of a path; ``results_<id8>`` when nothing usable is left."""
    name = basename(path)
    # a suffix is a last dot with something on both sides of it
    stem = F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
    safe = F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_")
    safe = F.regexp_replace(safe, r"^_+|_+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.concat(F.lit("results_"), F.substring(video_id, 1, 8)))


def truthy(text: Column) -> Column:
    """NULL for the empty string, the value otherwise (a blank is a value)."""
    return F.nullif(text, F.lit(""))


def first_truthy(*texts: Column) -> Column:
    return F.coalesce(*[truthy(t) for t in texts])


def round_even(x: Column, digits: int = 0) -> Column:
    """Half-even on the scaled double, as DuckDB and numpy round; decimal digits, as ``bround`` reads them, take other sides near a half.

    A value whose scaling overflows stays as it is.
    """
    scale = float(10**digits)
    return named(
        x.cast("double"),
        lambda v: F.when(F.abs(v * scale) == float("inf"), v).otherwise(F.rint(v * scale) / scale),
    )


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def search_tokens(text: Column) -> Column:
    """Lower-cased alphanumeric tokens, unstemmed, stop words kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def ordered_join(items: Column, field: str, sep: str = " ") -> Column:
    """Join ``field`` of a collected array of structs in the order of the leading struct fields."""
    return F.array_join(F.transform(F.sort_array(items), lambda x: x[field]), sep)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def difficulty_rank(value: Column, levels: Sequence[str]) -> Column:
    """Position in the scale; unknown values rank lowest."""
    rank = F.array_position(F.array(*[F.lit(x) for x in levels]), value)
    return F.greatest(rank - 1, F.lit(0))


def clock_label(sec: Column) -> Column:
    """m:ss of a position in seconds."""
    whole = F.floor(sec)
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value`` evaluated once, where a plain expression would be evaluated again at each place that it stands in.

    A chain of them also keeps the generated code of a stage small; large methods are left uncompiled by the JVM.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column as a one-row generator.

    Later filters and projections then refer to the generated value; as a plain alias the optimizer would copy the
    expression into each of them.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
