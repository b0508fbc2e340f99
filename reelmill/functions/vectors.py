"""Vectors as columns: query literals, batch scoring, a deterministic embedder, quality checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions.columns import named, norm, once, search_tokens

#: Slots of the digest embedder.
DIGEST_DIM = 64


def cosine_to(embedding: Column, query: Sequence[float]) -> Column:
    """Cosine similarity of an array column to one query vector; NULL for zero or missing vectors.

    One matrix-vector product per Arrow batch; the query travels with the task (one vector).
    """
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        ok = vectors.notna().to_numpy()
        if ok.any():
            m = np.stack(vectors[ok].to_numpy()).astype(np.float64)
            n = np.linalg.norm(m, axis=1)
            n[n == 0] = np.nan
            out[ok] = (m @ q) / n
        return pd.Series(out).replace({np.nan: None}).astype("Float64")

    return score(embedding)


def hashing_embedder(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 64) -> DataFrame:
    """Deterministic default embedder: hashed token counts, unit length; zeros for blank text."""
    prepared = df.withColumn("_tokens", search_tokens(F.coalesce(text_col, F.lit(""))))
    hashed = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_tf").transform(prepared)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(hashed)
    return unit.withColumn(out_col, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")


def digest_embedder(df: DataFrame, keys: list[str], text_col: str, out_col: str = "embedding", dim: int = DIGEST_DIM) -> DataFrame:
    """An embedder that other engines can repeat: counts of tokens in the slot that their MD5 names, unit length; zeros for blank text.

    ``keys`` name a text. Its tokens are counted in its row, so nothing is shuffled.
    """

    def slot(token: Column) -> Column:
        return F.pmod(F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int"), F.lit(dim))

    def counted(slots: Column) -> Column:
        found = F.array_distinct(slots)
        return F.map_from_arrays(found, F.transform(found, lambda s: (F.size(slots) - F.size(F.array_remove(slots, s))).cast("double")))

    def unit(n: Column) -> Column:
        length = F.sqrt(F.aggregate(F.map_values(n), F.lit(0.0), lambda total, x: total + x * x))
        return named(length, lambda size: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at(n, i), size), F.lit(0.0))
        ))

    slots = F.transform(search_tokens(F.coalesce(text_col, F.lit(""))), slot)
    return once(df, out_col, named(slots, lambda s: named(counted(s), unit)))


def vector_quality(df: DataFrame, dim: int) -> DataFrame:
    """Counts of missing, wrongly sized, zero and non-unit vectors."""
    e = F.col("embedding")
    length = norm(e)
    sized = e.isNotNull() & (F.size(e) == dim)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(e.isNull()).alias("missing"),
        F.count_if(e.isNotNull() & (F.size(e) != dim)).alias("wrong_width"),
        F.count_if(sized & (length == 0)).alias("zero"),
        F.count_if(sized & (F.abs(length - 1) > 1e-3)).alias("not_unit"),
    )


def require_width(df: DataFrame, dim: int) -> DataFrame:
    """Fail the job on the first vector of another width."""
    return df.where(
        F.assert_true(F.coalesce(F.size("embedding") == dim, F.lit(True)), F.lit(f"embedding width is not {dim}")).isNull()
    )
