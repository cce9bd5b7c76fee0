"""Content-stable hashing of keys into [0, 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: Column | int | str, key: Column) -> Column:
    """First 16 hex digits of sha256("seed:key"); hex strings of one width sort as the numbers do."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")), 256), 1, 16)


def hash_fraction(seed: Column | int | str, key: Column) -> Column:
    """The same digits as a fraction of 2**64."""
    return F.conv(hash_hex(seed, key), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def threshold_hex(fraction: float) -> str:
    """The 16 hex digits below which lies the given fraction of hashes; "g" lies above all digits."""
    scaled = int(fraction * 2**64)
    return "g" if scaled >= 2**64 else f"{scaled:016x}"
