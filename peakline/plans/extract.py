"""From raw tables to the signals that the detectors read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakline.config import DetectConfig
from peakline.operators import extract as EX
from peakline.operators.chunks import SERIES
from peakline.operators.cut import cut


def extract_signals(motion: DataFrame, rois: DataFrame, cfg: DetectConfig, audio: DataFrame | None = None, rate: int = 0, scale: float = 1.0) -> DataFrame:
    """(game, cam, idx, net, slot, audio): mean motion in the rectangles, and loudness at the same samples.

    `rois` are rectangles of the original picture, `scale` the analysed picture's share of it. Audio samples come at
    `rate` a second; a camera without audio, or none at all, gives zeros. Loudness behind the last window keeps its last value.
    """
    signals = EX.roi_mean_motion(motion, EX.scale_rois(rois, scale))
    if audio is None:
        return signals.withColumn("audio", F.lit(0.0))
    signals = cut(signals)
    loud = EX.interp_to_grid(EX.audio_rms(audio, rate), signals.select(*SERIES, "idx"), cfg.fps)
    return EX.audio_or_zeros(signals.withColumn("audio", F.lit(0.0)), loud)


def extract_frame_signals(frames: DataFrame, rois: DataFrame, scale: float = 1.0) -> DataFrame:
    """(game, cam, idx, net, slot): frame-difference energy in the rectangles, as the first detector reads it."""
    return EX.framediff_energy(frames, EX.scale_rois(rois, scale)).select(*SERIES, "idx", "net", "slot")
