"""Repeatable random draws from md5, usable as columns and inside Python tasks.

A draw depends only on (seed, key parts), never on partitioning, so a re-run
task or another cluster size gives the same picture, order or trial.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(1 << 32)


def _text(seed: int, parts) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string")
                                               for p in parts])


def shuffle_key(seed: int, *parts) -> Column:
    """Sort key that shuffles rows in a fixed way."""
    return F.md5(_text(seed, parts))


def uniform(seed: int, *parts, word: int = 0) -> Column:
    """Uniform double in [0, 1); ``word`` picks one of the four 32-bit words of the digest."""
    return draw(shuffle_key(seed, *parts), word)


def draw(digest: Column, word: int) -> Column:
    """The uniform double in one of the four words of a digest."""
    return F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("double") / F.lit(_SPAN)


def uniforms(seed: int, *parts) -> tuple[float, float, float, float]:
    """The same four draws as :func:`uniform`, for use in a Python task."""
    digest = hashlib.md5(":".join([str(seed), *map(str, parts)]).encode()).hexdigest()
    return tuple(int(digest[8 * w:8 * w + 8], 16) / _SPAN for w in range(4))
