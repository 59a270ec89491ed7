"""Keyed draws: reproducible randomness that does not depend on partitioning.

Every draw is a function of (seed, key columns).  Recomputing a lost partition,
changing the number of partitions or re-running the job gives the same value,
which ``rand()`` does not promise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 2**32


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts) -> Column:
    """32 hex digits from the parts; strings and numbers are taken as constants."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def hex_number(hex_text: Column, start: int, length: int) -> Column:
    """``length`` (at most 15) hex digits from 1-based ``start`` as a long."""
    return F.conv(F.substring(hex_text, start, length), 16, 10).cast("long")


def word(hex_text: Column, index: int = 0) -> Column:
    """The ``index``-th 32-bit word of a digest."""
    return hex_number(hex_text, 1 + 8 * index, 8)


def uniform(*parts, index: int = 0) -> Column:
    """Uniform double in [0, 1)."""
    return word(digest(*parts), index) / F.lit(float(WORD))


def pick(size, *parts, index: int = 0) -> Column:
    """Uniform long in [0, size), from 60 bits; NULL for a size of 0.  ``index`` 0 or 1 takes either half of the digest."""
    whole = size if isinstance(size, Column) else F.lit(size)
    return F.pmod(hex_number(digest(*parts), 1 + 16 * index, 15), F.nullif(whole.cast("long"), F.lit(0).cast("long")))


def order_key(*parts) -> Column:
    """48-bit long that orders rows at random but reproducibly."""
    return hex_number(digest(*parts), 1, 12)


ORDER_KEY_BITS = 48


def normal(*parts) -> Column:
    """Standard normal draw; both uniforms come from one digest."""
    d = digest(*parts)
    radius = F.sqrt(F.lit(-2.0) * F.log((word(d, 0) + 1) / F.lit(float(WORD))))
    return radius * F.cos(F.lit(2 * math.pi) * word(d, 1) / F.lit(float(WORD)))


def pick_from(values: list, *parts, index: int = 0) -> Column:
    """Uniform choice from a constant list."""
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (pick(len(values), *parts, index=index) + 1).cast("int"))
