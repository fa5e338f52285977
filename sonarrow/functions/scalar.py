"""Column expressions over samples, times, strings and half-precision bits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INT16 = 32768.0


def i16_to_float(x: Column) -> Column:
    """A 16-bit sample as a number from -1 to below 1."""
    return x / F.lit(INT16)


def u16_to_float(x: Column) -> Column:
    return (x - F.lit(INT16)) / F.lit(INT16)


def capture_i16_to_float(x: Column) -> Column:
    """Signed samples of a capture device are divided by the largest one instead."""
    return x / F.lit(32767.0)


def float_to_i16(x: Column) -> Column:
    """Clamped to [-1, 1], scaled and truncated towards zero."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int")


def hann(i: Column, n: int) -> Column:
    """The periodic Hann window."""
    return 0.5 * (1 - F.cos(2 * math.pi * i / n))


# Fixed values of the Slaney mel scale: linear up to 1000 Hz at 200/3 Hz a mel, then 27 mels for a factor of 6.4.
MEL_LINEAR, MEL_BREAK_HZ, MEL_STEP = 200.0 / 3, 1000.0, math.log(6.4) / 27


def hz_to_mel(hz: Column) -> Column:
    return F.when(hz < MEL_BREAK_HZ, hz / MEL_LINEAR).otherwise(MEL_BREAK_HZ / MEL_LINEAR + F.ln(hz / MEL_BREAK_HZ) / MEL_STEP)


def mel_to_hz(mel: Column) -> Column:
    knee = MEL_BREAK_HZ / MEL_LINEAR
    return F.when(mel < knee, mel * MEL_LINEAR).otherwise(MEL_BREAK_HZ * F.exp(MEL_STEP * (mel - knee)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def gelu(x: Column) -> Column:
    """The tanh approximation."""
    return 0.5 * x * (1 + F.tanh(0.7978846 * (x + 0.044715 * x * x * x)))


def milliseconds(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def clock(seconds: Column, point: str = ".") -> Column:
    """HH:MM:SS.mmm; hours are not bounded."""
    ms = milliseconds(seconds)
    return F.format_string(f"%02d:%02d:%02d{point}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def csv_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def json_escape(text: Column) -> Column:
    """Quotes, backslashes and control characters as JSON writes them, without surrounding quotes.

    Most texts have none of these and are only searched for them.
    """
    s = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    rare = s
    for c in (*range(9), 11, 12, *range(14, 32)):
        rare = F.replace(rare, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    s = F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), rare).otherwise(s)
    return F.when(text.rlike(r'["\\\x00-\x1f]'), s).otherwise(text)


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def drawtext_escape(text: Column) -> Column:
    s = text
    for c in ("\\", "'", ":"):
        s = F.replace(s, F.lit(c), F.lit("\\" + c))
    return s


def half_to_float(bits: Column) -> Column:
    """The value of 16 bits of IEEE half precision."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    normal = (1 + fraction / 1024.0) * F.pow(F.lit(2.0), exponent - 15)
    small = fraction / 1024.0 * 2.0**-14
    special = F.when(fraction == 0, float("inf")).otherwise(float("nan"))
    return sign * F.when(exponent == 0, small).when(exponent == 31, special).otherwise(normal)


def float_to_half(x: Column) -> Column:
    """The nearest half-precision bits, ties to even; too large is infinite."""
    a = F.abs(x)
    sign = F.when(x < 0, 0x8000).otherwise(0)
    e = F.greatest(F.lit(-14), F.floor(F.log2(F.greatest(a, F.lit(2.0**-30)))).cast("int"))
    e = F.when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).when((F.pow(F.lit(2.0), e) > a) & (e > -14), e - 1).otherwise(e)
    scaled = F.bround(a / F.pow(F.lit(2.0), e - 10)).cast("long")  # 11 bits, the leading one included
    bits = F.when(scaled >= 1024, ((e + 15) * 1024 + scaled - 1024)).otherwise(scaled)
    return (sign + F.when(F.isnan(x), 0x7E00).when(a >= 65520.0, 0x7C00).otherwise(bits)).cast("int")
