"""Size classes of encrypted payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from whisperlake.functions.text import as_col


def padded_length(n: str | Column) -> Column:
    """Padded size of an ``n``-byte text: 32-byte steps up to 256, then eighths of the next power of two."""
    n = as_col(n).cast("bigint")
    last = n - 1
    # Exact integer arithmetic: the number of binary digits gives the next power of two.
    power = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(last)))
    step = F.when(power <= 256, F.lit(32).cast("bigint")).otherwise(F.shiftright(power, 3))
    return F.when(n <= 32, F.lit(32).cast("bigint")).otherwise((last - F.pmod(last, step)) + step)


def payload_text_length(n: str | Column) -> Column:
    """Characters of the base64 payload for an ``n``-byte text: version, nonce, length, padding, MAC."""
    raw = F.lit(1 + 32 + 2 + 32) + padded_length(n)
    return (F.floor((raw + 2) / 3) * 4).cast("bigint")
