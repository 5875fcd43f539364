"""Joins with frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, their keys (text or whole numbers) computed anew.

    AQE deals a frequent key of one side of a join to several tasks only where both sides are shuffled right before the
    join, for the join. The result of an aggregation by the key is in place already, and an explicit repartition doesn't
    count; a key that Catalyst takes for another one has the side shuffled for the join."""
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.substring(k, 1, 1 << 30) if kinds[k] == "string" else F.col(k).bitwiseOR(F.lit(0)) for k in keys})
