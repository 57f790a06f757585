"""Byte and bit expressions over BINARY and integer columns. Offsets count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | int) -> Column:
    return F.lit(c) if isinstance(c, int) else c


def take(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes at an offset; null if they aren't all there."""
    part = F.substring(data, _col(at) + 1, _col(n))
    return F.when((F.octet_length(part) == _col(n)) & (_col(at) >= 0), part)


def be_uint(data: Column, at: Column | int, n: int) -> Column:
    """Big-endian unsigned integer of n bytes, n at most 7."""
    return F.conv(F.hex(take(data, at, n)), 16, 10).cast("long")


def le_uint(data: Column, at: Column | int, n: int) -> Column:
    """Little-endian unsigned integer of n bytes, n at most 7."""
    byte = [F.hex(take(data, _col(at) + i, 1)) for i in reversed(range(n))]
    return F.conv(F.concat(*byte), 16, 10).cast("long")


def le_int32(data: Column, at: Column | int) -> Column:
    v = le_uint(data, at, 4)
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def hex_uint(hexadecimal: Column) -> Column:
    """Number of a string of at most 15 hexadecimal digits."""
    return F.conv(hexadecimal, 16, 10).cast("long")


def hex_words(data: Column, n: int) -> Column:
    """All whole words of n bytes, each in hexadecimal, as an array."""
    return F.regexp_extract_all(F.hex(data), F.lit("." * (2 * n)), F.lit(0))


def reversed_hex(hexadecimal: Column) -> Column:
    """The bytes of a 4-byte word in the other order."""
    return F.concat(*(F.substring(hexadecimal, i, 2) for i in (7, 5, 3, 1)))


def byte_at(data: Column, at: Column | int) -> Column:
    return be_uint(data, at, 1)


def be_words(data: Column, at: Column | int, n: int, size: int) -> Column:
    """n big-endian words of so many bytes from an offset, as an array; null where one isn't all there."""
    return F.array(*(be_uint(data, _col(at) + i * size, size) for i in range(n)))


def string_at(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes as characters of the same numbers; null if they aren't all there, or n is below one."""
    return F.when(_col(n) >= 1, F.decode(take(data, at, n), "ISO-8859-1"))


def bits_at(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bits (at most 48) from a bit offset, the first bit the highest; beyond the end bits are zero."""
    first = F.floor(_col(at) / 8).cast("int")
    seven = F.substring(F.concat(data, F.unhex(F.lit("00" * 7))), first + 1, F.lit(7))
    window = F.conv(F.rpad(F.hex(seven), 14, "0"), 16, 10).cast("long")
    low = F.call_function("shiftright", window, (56 - _col(at) % 8 - _col(n)).cast("int"))
    return low.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), _col(n).cast("int")) - 1)


def align(at: Column) -> Column:
    """A bit offset rounded up to a whole byte."""
    return ceil_div(at, 8) * 8


def at_end(data: Column, at: Column) -> Column:
    """Whether a bit offset lies at or beyond the last bit's end."""
    return at >= F.octet_length(data) * 8


def upper_nibble(b: Column) -> Column:
    return F.shiftright(b, 4).bitwiseAND(15)


def lower_nibble(b: Column) -> Column:
    return b.bitwiseAND(15)


def nibble(b: Column, place: Column | int) -> Column:
    """Place 0 is the upper, 1 the lower half; anything else is an error."""
    place = _col(place)
    return F.when(place == 0, upper_nibble(b)).when(place == 1, lower_nibble(b)).otherwise(F.raise_error("a byte has nibbles 0 and 1").cast("long"))


def bit_from_right(v: Column, place: Column | int) -> Column:
    return F.getbit(v, _col(place)).cast("int")


def bit_from_left(v: Column, place: Column | int, width: int) -> Column:
    return F.getbit(v, width - 1 - _col(place)).cast("int")


def swap_bytes(v: Column) -> Column:
    """A 16-bit number with its bytes exchanged."""
    return F.shiftleft(v.bitwiseAND(255), 8).bitwiseOR(F.shiftright(v, 8).bitwiseAND(255))


def hex_be(v: Column, n: int) -> Column:
    """The low n bytes of a number, in hexadecimal."""
    return F.substring(F.lpad(F.hex(v.cast("long")), 16, "0"), 17 - 2 * n, 2 * n)


def put_be(v: Column, n: int) -> Column:
    return F.unhex(hex_be(v, n))


def put_le(v: Column, n: int) -> Column:
    h = hex_be(v, n)
    return F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n)))))


def magnitude_bits(v: Column) -> Column:
    """Bits of |v|; 1 for zero."""
    return F.when(v == 0, 1).otherwise(F.length(F.bin(F.abs(v)))).cast("int")


def nearly_equal(a: Column, b: Column, eps: float) -> Column:
    return F.abs(a - b) < eps


def ceil_div(a: Column, b: Column | int) -> Column:
    return F.floor((a + _col(b) - 1) / _col(b)).cast("long")


def matches(data: Column, signature: str) -> Column:
    """Whether data begins with the bytes given in hexadecimal; false if it is shorter or null."""
    return F.coalesce(F.substring(data, 1, len(signature) // 2) == F.unhex(F.lit(signature)), F.lit(False))


def file_signature(data: Column) -> Column:
    """bmp, jpeg or none, by content."""
    return F.when(matches(data, "424D"), "bmp").when(matches(data, "FFD8FF"), "jpeg").otherwise("none")


def format_name(name: Column) -> Column:
    """A format's name in any case to bmp, jpeg or none."""
    low = F.lower(name)
    return F.when(low.isin("jpeg", "jpg"), "jpeg").when(low == "bmp", "bmp").otherwise("none")


def stuffed(hexadecimal: Column) -> Column:
    """Hexadecimal bytes with 00 after each FF."""
    pairs = F.filter(F.split(hexadecimal, "(?<=\\G..)"), lambda x: x != "")
    return F.array_join(F.transform(pairs, lambda x: F.when(x == "FF", "FF00").otherwise(x)), "")


def bits_to_hex(bits: Column) -> Column:
    """A string of 0 and 1 as hexadecimal bytes, the last filled with ones."""
    size = (F.floor((F.length(bits) + 7) / 8) * 8).cast("int")
    padded = F.rpad(bits, size, "1")
    pieces = F.filter(F.split(padded, "(?<=\\G.{8})"), lambda x: x != "")
    return F.array_join(F.transform(pieces, lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), "")


def words(text: Column) -> Column:
    """The pieces of a text between runs of blanks; none is empty."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def error_in(context: str, inner: Column) -> Column:
    """An error's text behind what was being done; null without an error."""
    return F.when(inner.isNotNull(), F.concat_ws(": ", F.lit(context), inner))
