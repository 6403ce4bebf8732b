"""Public keys: bech32 text forms, parsing, short names and avatar buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from whisperlake.functions.text import as_col, is_blank, is_lower_hex, let, trimmed

# bech32 alphabet and checksum generator.
ALPHABET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]


def _prefix_state(prefix: str) -> int:
    """Checksum state after the human-readable prefix; constant per prefix, so done once on the driver."""
    state = 1
    for v in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]:
        state = ((state & 0x1FFFFFF) << 5) ^ v ^ _mask(state >> 25)
    return state


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def _mask(top: int) -> int:
    out = 0
    for bit, g in enumerate(GENERATOR):
        out ^= g if top >> bit & 1 else 0
    return out


def _checksum_step(state: Column, value: Column) -> Column:
    # One lookup by the five top bits instead of five conditional XORs.
    masks = F.array(*[_long(_mask(top)) for top in range(32)])
    mixed = F.shiftleft(state.bitwiseAND(_long(0x1FFFFFF)), 5).bitwiseXOR(value.cast("bigint"))
    return mixed.bitwiseXOR(F.get(masks, F.shiftright(state, 25).cast("int")))


def _checksum(prefix: str, values: Column) -> Column:
    return F.aggregate(values, _long(_prefix_state(prefix)), _checksum_step)


def _symbols(text: Column) -> Column:
    """Alphabet index of every character; -1 where it is not in the alphabet."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


# A key of 32 bytes: so many symbols, which are dealt with twelve at a time (60 bits, 15 hex digits).
_KEY_SYMBOLS = 52
_GROUP = 12
# Digits of base 32 as ``conv`` writes them, in the order of the alphabet.
_BASE32 = "0123456789abcdefghijklmnopqrstuv"


def _key_table(prefix: str) -> tuple[int, list[int]]:
    """The checksum of a key's symbols as a map that is linear over GF(2): a constant, and what each value at each position adds (XOR)."""
    def run(values: list[int]) -> int:
        state = _prefix_state(prefix)
        for v in [*values, *[0] * 6]:
            state = ((state & 0x1FFFFFF) << 5) ^ v ^ _mask(state >> 25)
        return state ^ 1

    zero = [0] * _KEY_SYMBOLS
    constant = run(zero)
    return constant, [run([*zero[:i], v, *zero[i + 1:]]) ^ constant for i in range(_KEY_SYMBOLS) for v in range(32)]


def _key_checksum(prefix: str, groups: list[Column]) -> Column:
    """The 30 bits of the checksum from a key's symbols, given as numbers of up to twelve."""
    constant, table = _key_table(prefix)
    listed = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # one constant

    def added(known: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            group = F.get(known, F.call_function("div", i, F.lit(_GROUP)).cast("int"))
            symbol = F.call_function("shiftright", group, (_GROUP - 1 - i % _GROUP) * 5).bitwiseAND(_long(31))
            return state.bitwiseXOR(F.get(listed, i * 32 + symbol.cast("int")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(_KEY_SYMBOLS - 1)), _long(constant), step)

    short = 5 * (-_KEY_SYMBOLS % _GROUP)
    return let(F.array(*groups[:-1], F.shiftleft(groups[-1], short)), added)


def _slices(text: Column, total: int, size: int) -> list[Column]:
    return [F.substring(text, at + 1, min(size, total - at)) for at in range(0, total, size)]


def npub(pubkey: str | Column) -> Column:
    """Text form of a 64-digit hex key. Fifteen hex digits make exactly twelve 5-bit symbols."""
    digits = _slices(F.concat(as_col(pubkey), F.lit("0")), 65, 15)
    symbols = [F.lpad(F.lower(F.conv(d, 16, 32)), n, "0") for d, n in zip(digits, (12, 12, 12, 12, 4))]
    check = _key_checksum("npub", [F.conv(d, 16, 10).cast("bigint") for d in digits])
    ending = F.lpad(F.lower(F.conv(check.cast("string"), 10, 32)), 6, "0")
    return F.concat(F.lit("npub1"), F.translate(F.concat(*symbols, ending), _BASE32, ALPHABET))


def _npub_hex(text: Column) -> Column:
    """The 64 digits of a lower-case npub text; null when malformed. The same map as in :func:`npub`."""

    def read(body: Column) -> Column:
        symbols = _slices(body, _KEY_SYMBOLS, _GROUP)
        digits = F.concat(*(F.lpad(F.lower(F.conv(s, 32, 16)), n, "0") for s, n in zip(symbols, (15, 15, 15, 15, 5))))
        check = F.conv(F.substring(body, 53, 6), 32, 10).cast("bigint")
        good = _key_checksum("npub", [F.conv(s, 32, 10).cast("bigint") for s in symbols]) == check
        # The last symbol has four bits to spare, which are zero.
        return F.when(good, let(digits, lambda d: F.when(d.endswith("0"), F.substring(d, 1, 64))))

    shape_ok = text.rlike(rf"\Anpub1[{ALPHABET}]{{58}}\z")
    return F.when(shape_ok, let(F.translate(F.substring(text, 6, 58), ALPHABET, _BASE32), read))


def _bytes_of(data: Column) -> Column:
    """5-bit symbols regrouped to bytes, as hex; null when the bits left over are too many or not zero."""
    filled = F.concat(data, F.array_repeat(F.lit(0), F.pmod(-F.size(data), F.lit(8))))

    def digits_of(all_symbols: Column) -> Column:
        # Eight symbols are 40 bits, ten hex digits.
        groups = F.sequence(F.lit(0), (F.size(all_symbols) / 8).cast("int") - 1)
        return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(F.hex(F.aggregate(
            F.slice(all_symbols, g * 8 + 1, F.lit(8)), _long(0),
            lambda acc, v: F.shiftleft(acc, 5).bitwiseOR(v.cast("bigint")),
        ))), 10, "0")), "")

    n_bits = F.size(data) * 5
    spare = F.pmod(n_bits, F.lit(8))
    n_digits = ((n_bits - spare) / 4).cast("int")
    return let(let(filled, digits_of), lambda digits: F.when(
        (spare < 5) & F.substring(digits, n_digits + 1, F.length(digits)).rlike(r"\A0*\z"),
        F.substring(digits, F.lit(1), n_digits)))


def _decoded_hex(text: Column, prefix: str) -> Column:
    """Data bytes (as hex) of a lower-case bech32 text with this prefix; null when malformed."""
    body = F.substring(text, F.lit(len(prefix) + 2), F.length(text))
    shape_ok = body.rlike(rf"\A[{ALPHABET}]{{7,}}\z") & (F.length(text) <= 5000)
    return F.when(shape_ok, let(_symbols(body), lambda symbols: F.when(
        _checksum(prefix, symbols) == 1,
        let(F.slice(symbols, F.lit(1), F.size(symbols) - 6), _bytes_of))))


def _profile_key(data: Column) -> Column:
    """First type-0 entry of 32 bytes in a type-length-value list given as hex."""

    def byte_at(d: Column, i: Column) -> Column:
        return F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def walk(d: Column) -> Column:
        n = (F.length(d) / 2).cast("int")

        def step(s: Column, i: Column) -> Column:
            at_entry = (i == s["next"]) & s["found"].isNull() & (i + 2 <= n)
            # An entry that does not fit leaves "next" behind the index, which ends the walk.
            return F.when(at_entry, let(byte_at(d, i + 1), lambda size: F.when(i + 2 + size <= n, F.struct(
                (i + 2 + size).alias("next"), F.when((byte_at(d, i) == 0) & (size == 32), i + 2).alias("found"),
            )).otherwise(s))).otherwise(s)

        start = F.struct(F.lit(0).alias("next"), F.lit(None).cast("int").alias("found"))
        found = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["found"])
        return F.when(n > 0, F.substring(d, found * 2 + 1, F.lit(64)))

    return let(data, walk)


def _parsed(text: Column) -> Column:
    def by_form(low: Column) -> Column:
        one_case = (text == low) | (text == F.upper(text))
        return (
            F.when(low.startswith("npub1"), F.when(one_case, _npub_hex(low)))
            .when(low.startswith("nprofile1"), F.when(one_case, _profile_key(_decoded_hex(low, "nprofile"))))
            .otherwise(low)
        )

    return let(let(F.lower(text), by_form), lambda found: F.when(is_lower_hex(found, 32), found))


def parse_public_key(raw: str | Column) -> Column:
    """Hex key from hex, npub or nprofile text with an optional ``nostr:`` prefix; null when invalid."""
    return let(F.regexp_replace(trimmed(raw), r"\A(?i:nostr:)", ""), _parsed)


def short_npub(text: str | Column) -> Column:
    return let(as_col(text), lambda t: F.concat(
        F.substring(t, F.lit(1), F.lit(12)), F.lit("…"), F.substring(t, F.lit(-6), F.lit(6))))


def short_id(pubkey: str | Column) -> Column:
    return short_npub(npub(pubkey))


def display_name(name: str | Column, pubkey: str | Column) -> Column:
    return F.when(is_blank(name), short_id(pubkey)).otherwise(as_col(name))


def avatar_bucket(pubkey: str | Column, n_buckets: int = 10) -> Column:
    first_byte = F.conv(F.substring(as_col(pubkey), 1, 2), 16, 10).cast("int")
    return F.pmod(first_byte, F.lit(n_buckets))


def initial(name: str | Column) -> Column:
    return F.when(is_blank(name), F.lit("?")).otherwise(F.upper(F.substring(trimmed(name), 1, 1)))
