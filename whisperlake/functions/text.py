"""JSON string escaping, trimming and small text helpers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points that count as white space when trimming.
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` refers to it.

    Columns are expression trees: using one twice writes it twice, and nested uses multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def staged(df: DataFrame, keep: list[str], cols: list[Column]) -> DataFrame:
    """``keep`` plus ``cols``, computed once per row.

    A filter on a projected column is pushed below the projection with the whole expression
    copied into it. It is not pushed through a generator, so costly parsing goes behind one.
    The projection in front of the generator computes what the expressions have in common once.
    """
    computed = df.select(*keep, F.struct(*cols).alias("_c"))
    return computed.select(*keep, F.explode(F.array("_c")).alias("_s")).select(*keep, "_s.*")


def trimmed(c: str | Column) -> Column:
    """Removes any Unicode white space at both ends (Spark's ``trim`` drops blanks only)."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def is_blank(c: str | Column) -> Column:
    return F.coalesce(trimmed(c) == "", F.lit(True))


def lower_escapes(written: Column) -> Column:
    """Lower-case hex digits in ``\\u00XX`` escapes, but not in texts that merely look like one.

    An escape starts at a backslash with an even number of backslashes in front of it. Only
    control characters are escaped this way, so the digit before the letter is 0 or 1.

    Parts that are whole JSON values may be joined first and treated once: generated code with
    these patterns for each part is more than the JVM compiles.
    """
    fixed = reduce(lambda acc, letter: F.regexp_replace(
        acc, rf"(?=\\)(?<!\\)((?:\\\\)*\\u00[01]){letter}", f"$1{letter.lower()}"), "ABCDEF", written)
    return F.when(F.contains(written, F.lit("\\u00")), fixed).otherwise(written)


def json_string_array(c: str | Column) -> Column:
    """JSON of an array of strings without nulls, spelled as ``JSON.stringify`` does."""
    return lower_escapes(F.to_json(as_col(c)))


def tags_json(tags: str | Column) -> Column:
    """JSON of a list of tags without nulls."""
    return lower_escapes(F.to_json(as_col(tags)))


def quoted(c: str | Column) -> Column:
    """A quoted JSON string before :func:`lower_escapes`; null stays null."""
    c = as_col(c)
    # The quotes keep a bracket of the text itself from being trimmed.
    return F.when(c.isNotNull(), F.btrim(F.to_json(F.array(c)), F.lit("[]")))


def json_string(c: str | Column) -> Column:
    """A quoted JSON string; null stays null."""
    return lower_escapes(quoted(c))


def json_escape(c: str | Column) -> Column:
    """Escapes a string the way ``JSON.stringify`` does, without the quotes."""
    c = as_col(c)
    written = json_string_array(F.array(c))
    return F.when(c.isNotNull(), F.substring(written, F.lit(3), F.length(written) - 4))


def plain_decimal(c: Column, digits: int) -> Column:
    """A number with at most ``digits`` decimals, half away from zero, no trailing zeros."""
    fixed = F.round(c.cast("decimal(30,9)"), digits).cast(f"decimal(30,{digits})").cast("string")
    return F.regexp_replace(fixed, r"\.?0+\z", "")


def is_lower_hex(c: str | Column, n_bytes: int) -> Column:
    """Exactly ``2 * n_bytes`` characters of lower-case hex; null is false."""
    return F.coalesce(as_col(c).rlike(rf"\A[0-9a-f]{{{2 * n_bytes}}}\z"), F.lit(False))


def is_hex(c: str | Column) -> Column:
    """Non-empty, even number of hex digits in either case; null is false."""
    return F.coalesce(as_col(c).rlike(r"\A(?:[0-9A-Fa-f]{2})+\z"), F.lit(False))


def hex_lower(c: str | Column) -> Column:
    return F.lower(F.hex(as_col(c)))


def packed(c: str | Column) -> Column:
    """A text as bytes in which 64 digits of lower-case hex, the form of ids and keys, take 33; different texts stay different. :func:`unpacked` is its inverse."""
    c = as_col(c)
    return F.when(is_lower_hex(c, 32), F.concat(F.lit(b"\1"), F.unhex(c))).otherwise(F.concat(F.lit(b"\0"), c.cast("binary")))


def unpacked(c: str | Column) -> Column:
    c = as_col(c)
    rest = F.substring(c, F.lit(2), F.octet_length(c))
    return F.when(F.substring(c, 1, 1) == F.lit(b"\1"), hex_lower(rest)).otherwise(rest.cast("string"))
