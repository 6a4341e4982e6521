"""Scoring of gridded rows, and widths of targets, as they arrive."""

from .scoring import class_counts, halving_stream, score_stream
from .widths import arriving, class_widths, widened

__all__ = ["arriving", "class_counts", "class_widths", "halving_stream", "score_stream", "widened"]
