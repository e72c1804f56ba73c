"""peakline: find, score and publish notable moments in paired sampled signals, on Spark."""

from peakline.config import DetectConfig

__all__ = ["DetectConfig"]
