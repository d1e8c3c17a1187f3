"""Column helpers over BINARY values (big-endian integers, zero bytes, hex clean-up)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_int(raw: Column, offset: Column | int, width: int) -> Column:
    """Unsigned big-endian integer of ``width`` (<= 7) bytes at a 0-based byte offset; NULL past the end."""
    start = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    piece = F.substring(raw, start, F.lit(width))
    return F.when(F.length(piece) == width, F.conv(F.hex(piece), 16, 10).cast("bigint"))


def clean_hex(text: Column) -> Column:
    """Hex text as found in dissector exports (colons, blanks) to BINARY; NULL when it is not hex."""
    return F.try_to_binary(F.regexp_replace(text, "[: ]", ""), F.lit("hex"))


def zeros(n: Column) -> Column:
    """``n`` zero bytes as BINARY (empty for n <= 0)."""
    return filler(n, 0)


def filler(n: Column, mask_byte: int) -> Column:
    return F.unhex(F.repeat(F.lit(f"{mask_byte & 0xFF:02X}"), n.cast("int")))


def zero_bytes(raw: Column) -> Column:
    """Number of 0x00 bytes. Latin-1 decoding keeps one character per byte, so plain string functions apply."""
    text = F.decode(raw, "ISO-8859-1")
    return F.length(text) - F.length(F.replace(text, F.lit("\x00"), F.lit("")))


def all_zero(raw: Column) -> Column:
    return zero_bytes(raw) == F.length(raw)


def latin1(raw: Column) -> Column:
    """One character per byte, so ``instr``/``split`` on text work on byte positions."""
    return F.decode(raw, "ISO-8859-1")


def int_to_be(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))
