"""Row keys: surrogate user ids and repeatable sampling keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A sampling threshold is compared with this many leading hex digits of a key.
HEX_DIGITS = 13


def user_key(user: Column | str) -> Column:
    """64-bit surrogate for a textual user id."""
    return F.xxhash64(user)


def sample_key(row_id: Column | str, seed: int) -> Column:
    """Pseudo-random text that depends on the row id and the seed only.

    Ordering by it shuffles rows the same way on every run, however the data is
    partitioned and however often a task is retried.
    """
    return F.md5(F.concat_ws("|", F.col(row_id) if isinstance(row_id, str) else row_id, F.lit(str(seed))))


def key_mark(share: float) -> str:
    """The end of the lowest `share` (0..1) of the key space, as leading digits of a key."""
    top = int(min(share, 1.0) * (16 ** HEX_DIGITS - 1))
    return f"{top:0{HEX_DIGITS}x}"


def key_up_to(key: Column, mark: Column | str) -> Column:
    """True for the keys up to a mark."""
    return F.substring(key, 1, HEX_DIGITS) <= (F.lit(mark) if isinstance(mark, str) else mark)
