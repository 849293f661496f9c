"""Operators that can find bad rows return them beside the good ones; strict callers raise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Rows break a stated contract; the message has up to ten examples in order."""


@dataclass(frozen=True)
class Checked:
    good: DataFrame
    bad: DataFrame

    def strict(self, key: str, what: str) -> DataFrame:
        found = self.bad.select(F.col(key).cast("string").alias("k")).orderBy("k").limit(10).collect()
        if found:
            raise ContractError(f"{what}: {', '.join(str(r.k) for r in found)}")
        return self.good


def split_by(df: DataFrame, reason: Column) -> Checked:
    """Rows whose reason is null are good; the others carry it in "violation"."""
    marked = df.withColumn("violation", reason)
    return Checked(marked.where("violation is null").drop("violation"), marked.where("violation is not null"))


def require_columns(df: DataFrame, names) -> DataFrame:
    """The named columns in that order; missing ones raise, others are projected away."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def require_empty(bad: DataFrame, key: str, what: str) -> None:
    Checked(bad, bad).strict(key, what)
