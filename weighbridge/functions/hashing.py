"""Seeded order and buckets: the only sources of 'randomness', so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weighbridge.functions.text import let


def seeded_order(seed: str, tag, id_col) -> Column:
    """Sort key sha256(seed|tag|id); an empty tag gives sha256(seed|id)."""
    parts = [F.lit(seed)]
    if tag is not None:
        parts.append(F.lit(tag) if isinstance(tag, str) else tag)
    parts.append(F.col(id_col) if isinstance(id_col, str) else id_col)
    return F.sha2(F.concat_ws("|", *parts), 256)


def hex_mod(hex64: Column, k: int) -> Column:
    """A 256-bit hex number modulo k, exactly, from pieces of 15 digits."""
    if not 0 < k < 1 << 31:
        raise ValueError("k must be a positive number below 2^31")
    total = None
    for start, digits in ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4)):
        piece = F.conv(F.substring(hex64, start, digits), 16, 10).cast("bigint") % F.lit(k)
        weight = pow(16, 65 - start - digits, k)
        total = piece * F.lit(weight) if total is None else total + piece * F.lit(weight)
    return (total % F.lit(k)).cast("int")


def seeded_bucket(key: Column, k: int) -> Column:
    """int(sha256(key), 16) mod k; the hash is bound once."""
    return let(F.sha2(key, 256), lambda h: hex_mod(h, k))
