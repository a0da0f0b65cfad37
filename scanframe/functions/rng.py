"""Reproducible draws: every value is a hash of (seed, tag, ids), so results do not depend on partitions or order."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, tag: str, *ids: Column | str) -> Column:
    """U[0, 1) from the first 32 bits of md5(seed:tag:id:id...)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def between(lo: float, hi: float, *args) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * uniform(*args)


def log_uniform(lo: float, hi: float, *args) -> Column:
    return F.exp(between(math.log(lo), math.log(hi), *args))


def gate(p: float, *args) -> Column:
    """True with probability p."""
    return uniform(*args) < p


def choice(options: list, *args) -> Column:
    """One of the options."""
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(uniform(*args) * len(options)) + 1).cast("int"))


def normal(seed: int, tag: str, *ids: Column | str) -> Column:
    """N(0, 1) by Box-Muller from two draws."""
    a, b = uniform(seed, tag + "a", *ids), uniform(seed, tag + "b", *ids)
    return F.sqrt(-2 * F.log(F.greatest(a, F.lit(2.0**-33)))) * F.cos(2 * math.pi * b)


def hash_order(seed: int, tag: str, *ids: Column | str) -> Column:
    """A sort key that shuffles rows: the md5 text itself, so that ties do not occur between different ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]).cast("binary"))


def host(seed: int, tag: str, *ids: int) -> float:
    """The draw of uniform() for known ids, for code that works on one whole volume."""
    return int(hashlib.md5(":".join(map(str, (seed, tag, *ids))).encode()).hexdigest()[:8], 16) / 4294967296.0


def host_between(lo: float, hi: float, *args) -> float:
    return lo + (hi - lo) * host(*args)
