"""Stable identifiers and seeds."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def canonical_json(value) -> str:
    """Sorted keys, no blanks, plain Unicode."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical(s: pd.Series) -> pd.Series:
    """A JSON text with sorted keys, no blanks and plain Unicode; fractions in their shortest form; null for no JSON."""
    def one(x):
        try:
            return None if x is None else canonical_json(json.loads(x))
        except json.JSONDecodeError:
            return None

    return s.map(one)


@F.pandas_udf(ArrayType(StringType()))
def canonical_all(s: pd.Series) -> pd.Series:
    """canonical of each text of a list."""
    def one(x):
        try:
            return None if x is None else canonical_json(json.loads(x))
        except json.JSONDecodeError:
            return None

    return s.map(lambda xs: None if xs is None else [one(x) for x in xs])


def stable_hex(*columns: Column, size: int = 32) -> Column:
    """BLAKE2b of the string columns as JSON strings, joined by the unit separator."""

    @F.pandas_udf(StringType())
    def digest(*parts: pd.Series) -> pd.Series:
        rows = zip(*parts, strict=True)
        return pd.Series([hashlib.blake2b("\x1f".join(canonical_json(x) for x in r).encode(), digest_size=size).hexdigest() for r in rows])

    return digest(*columns)


def stable_int(*columns: Column) -> Column:
    """Eight BLAKE2b bytes modulo 2**63 - 1."""
    wide = F.conv(stable_hex(*columns, size=8), 16, 10).cast("decimal(20,0)")
    return F.pmod(wide, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")


def seed_big(c: Column) -> Column:
    """First eight SHA-256 bytes, high byte first, as decimal(20,0)."""
    return F.conv(F.left(F.sha2(c, 256), F.lit(16)), 16, 10).cast("decimal(20,0)")


def seed_little(c: Column) -> Column:
    """First eight SHA-256 bytes, low byte first, without the sign bit."""
    h = F.sha2(c, 256)
    turned = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return F.pmod(F.conv(turned, 16, 10).cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def rank_epoch_seed(base: Column, rank: Column, epoch: Column) -> Column:
    return base + F.lit(1000003) * rank + F.lit(10000019) * epoch


def condition_seed(profile: str, master_seed: int, condition_id: Column, tag: str) -> Column:
    """A condition's own seed, the same in every shard and batch: stable_int of tag, profile, master seed and id.

    The tag names a generation of seeds; other tags give other seeds."""

    @F.pandas_udf(StringType())
    def digest(ids: pd.Series) -> pd.Series:
        head = "\x1f".join(canonical_json(x) for x in (tag, profile, master_seed))
        return pd.Series([hashlib.blake2b(f"{head}\x1f{canonical_json(str(x))}".encode(), digest_size=8).hexdigest() for x in ids])

    wide = F.conv(digest(condition_id.cast("string")), 16, 10).cast("decimal(20,0)")
    return F.pmod(wide, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")
