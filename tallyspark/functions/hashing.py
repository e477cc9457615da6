"""Stable hashes: buckets for splits, content digests, seeded order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The salt of the split buckets; pools are hashed without one.
SPLIT_SALT = "holdout:"


def bucket(key: Column, salt: str = "") -> Column:
    """sha256 of salt and key, as a number, modulo 100; in eight steps of 32 bits, all in the JVM."""
    digest = F.sha2(F.concat(F.lit(salt), key), 256)
    out = F.lit(0).cast("bigint")
    for i in range(8):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        out = (out * (4294967296 % 100) + part) % 100
    return out.cast("int")


def digest(*columns: Column) -> Column:
    """sha256 of a struct in JSON with its fields in the order given; null fields count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def seeded_order(seed: str, key: Column) -> Column:
    """A deterministic random order of keys."""
    return F.sha2(F.concat(F.lit(seed), key), 256)
