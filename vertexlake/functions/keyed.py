"""Reproducible randomness: uniforms and sort keys from an md5 of (seed, stream, ids), the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int, stream: str, *ids: Column) -> Column:
    """A hexadecimal sort key; null ids count as empty text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[F.coalesce(i.cast("string"), F.lit("")) for i in ids]))


def uniform(seed: int, stream: str, *ids: Column) -> Column:
    """A number in [0, 1): the key's first twelve digits."""
    return F.conv(F.substring(key(seed, stream, *ids), 1, 12), 16, 10).cast("bigint") / float(16**12)


def normal(seed: int, stream: str, *ids: Column) -> Column:
    """A standard normal number by Box and Muller, from two streams."""
    u = F.greatest(uniform(seed, stream + "/r", *ids), F.lit(16.0**-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * uniform(seed, stream + "/a", *ids))


def exponential_rank(seed: int, stream: str, weight: Column, *ids: Column) -> Column:
    """ln(u) / w: the largest values are a weighted sample without replacement. Null where the weight is not positive."""
    u = F.greatest(uniform(seed, stream, *ids), F.lit(16.0**-12))
    return F.when(weight > 0, F.log(u) / weight)
