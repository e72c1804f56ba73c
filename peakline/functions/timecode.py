"""Seconds, frames, timecodes and rational times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sec_to_frame(seconds: Column, fps: int) -> Column:
    """Nearest frame, halves to even."""
    return F.rint(seconds * F.lit(float(fps))).cast("long")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def tc_to_frames(tc: Column, fps: int) -> Column:
    """HH:MM:SS:FF to a frame number."""
    part = F.split(tc, ":")
    hh, mm, ss, ff = (part[i].cast("long") for i in range(4))
    return ((hh * 60 + mm) * 60 + ss) * fps + ff


def frames_to_tc(frames: Column, fps: int) -> Column:
    """A frame number to HH:MM:SS:FF; negative frames count as 0, hours are unbounded."""
    n = F.greatest(frames.cast("long"), F.lit(0).cast("long"))
    seconds = _div(n, fps)
    return F.format_string("%02d:%02d:%02d:%02d", _div(seconds, 3600), _div(seconds, 60) % 60, seconds % 60, n % fps)


def rational_time(frames: Column, fps: int) -> Column:
    """Reduced fraction of a second: `3/2s`, `2s`, `0s`."""
    n = frames.cast("long")
    divisors = [d for d in range(1, fps + 1) if fps % d == 0]
    shared = F.greatest(*[F.when(n % d == 0, F.lit(d)).otherwise(F.lit(1)) for d in divisors]) if len(divisors) > 1 else F.lit(1)
    top = (n / shared).cast("long").cast("string")
    below = (F.lit(fps) / shared).cast("long")
    return (F.when(n == 0, F.lit("0s")).when(below == 1, F.concat(top, F.lit("s")))
            .otherwise(F.concat(top, F.lit("/"), below.cast("string"), F.lit("s"))))
