"""Text rules of marker names, notes and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the marker format.
WIN_PATTERN = r"(?i)\bwin\s*=\s*([0-9]+(?:\.[0-9]+)?)s\b"
COLOR_PATTERN = r"\[([A-Za-z]+)\]"
CAM_PATTERN = r"(?i)\bcam(\d+)\b"
LABEL_LIMIT = 120

_BLANKS = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(col, F.lit(_BLANKS))


def _first_match(col: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def parse_win_seconds(note: Column) -> Column:
    """Seconds of the first `win=..s`, else null."""
    return F.regexp_extract(note, WIN_PATTERN, 1).try_cast("double")  # no match is an empty text, which is no number


#: Frame numbers and lengths beyond this are no numbers: sums of a few of them stay exact.
MOST_FRAMES = 1 << 52


def win_frames(note: Column, fps: float) -> Column:
    """Frames of the first `win=..s`, half to even; null without one or beyond MOST_FRAMES."""
    return seconds_to_frames(parse_win_seconds(note), fps)


def seconds_to_frames(seconds: Column, fps: float) -> Column:
    """Frames, half to even; null beyond MOST_FRAMES."""
    frames = F.rint(seconds * F.lit(fps))
    return F.when(frames <= MOST_FRAMES, frames).try_cast("long")


def parse_color(name: Column, note: Column) -> Column:
    """First bracketed word of the name, then of the note, capitalised; Blue without one."""
    return F.initcap(F.coalesce(_first_match(name, COLOR_PATTERN), _first_match(note, COLOR_PATTERN), F.lit("Blue")))


def parse_cam_angle(name: Column, note: Column) -> Column:
    """0-based angle of the first `camN` in the name, then in the note; 0 without one. A number beyond
    the integers counts as none."""
    found = F.coalesce(_first_match(name, CAM_PATTERN).try_cast("int"), _first_match(note, CAM_PATTERN).try_cast("int"))
    return F.coalesce(found - 1, F.lit(0))


def marker_label(color: Column, name: Column, note: Column) -> Column:
    """`[color] name note` without the empty parts, on one line, at most 120 characters."""
    def filled(c: Column) -> Column:
        return F.when(F.length(c) > 0, c)

    parts = F.concat_ws(" ", F.when(F.length(color) > 0, F.concat(F.lit("["), color, F.lit("]"))), filled(name), filled(note))
    label = strip(F.translate(parts, "\n", " "))
    return F.when(F.length(label) > LABEL_LIMIT, F.concat(F.substring(label, 1, LABEL_LIMIT - 3), F.lit("..."))).otherwise(label)


def xml_escape(col: Column) -> Column:
    """Attribute escaping; the ampersand goes first."""
    for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def tag_note(color: Column, note: Column) -> Column:
    """`[Color] note`, or `[Color]` alone."""
    tag = F.concat(F.lit("["), color, F.lit("]"))
    body = strip(F.coalesce(note, F.lit("")))
    return F.when(F.length(body) > 0, F.concat(tag, F.lit(" "), body)).otherwise(tag)


def fixed(col: Column, decimals: int) -> Column:
    """A double with a fixed number of decimals, correctly rounded from its exact binary value.

    `format_string` rounds the shortest decimal form half up, so 0.15 would print as 0.2. The scaled
    value is split into a rounded product and its exact error (Veltkamp's splitting), which decides
    on which side of a half the true value lies; a true half goes to the even digit. NaN and infinite
    values print as nan, inf and -inf; values of 2^52 and more once scaled are
    printed by `format_string`, whose digits are the shortest that name the double.
    """
    scale = float(10 ** decimals)
    odd = F.isnan(col) | (F.abs(col) == float("inf"))
    large = ~odd & (F.abs(col) * F.lit(scale) >= float(1 << 52))
    x = F.when(odd | large, F.lit(0.0)).otherwise(F.abs(col))
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    low = x - high
    product = x * F.lit(scale)
    error = (high * F.lit(scale) - product) + low * F.lit(scale)
    floor = F.floor(product).cast("double")
    off = (product - floor - F.lit(0.5)) + error
    even = floor % F.lit(2.0) == 0
    digits = (floor + F.when((off > 0) | ((off == 0) & ~even), F.lit(1.0)).otherwise(F.lit(0.0))).cast("long")
    whole = F.floor(digits / F.lit(10 ** decimals)).cast("long")
    sign = F.when(col < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, whole.cast("string"))
    if decimals:
        text = F.concat(text, F.lit("."), F.lpad((digits % F.lit(10 ** decimals)).cast("string"), decimals, "0"))
    named = F.when(F.isnan(col), "nan").when(col > 0, "inf").otherwise("-inf")
    return F.when(odd, named).when(large, F.format_string(f"%.{decimals}f", col)).otherwise(text)
