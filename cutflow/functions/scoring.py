"""Highlight scores of shots, as column arithmetic."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

#: Weights of the highlight score (fixed values).
WEIGHTS = {"motion": 0.25, "duration": 0.20, "face": 0.25, "camera": 0.15, "audio": 0.15}
#: Emotion words in order of precedence (fixed values).
EMOTIONS = {"angry": 0.9, "fear": 0.8, "surprise": 0.7, "sad": 0.6, "happy": 0.5, "disgust": 0.4, "neutral": 0.1}


def sigmoid(x: Column, center: float = 3.0, slope: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-slope * (x - center)))


def duration_score(seconds: Column) -> Column:
    """1 between 1 and 3 seconds, rising to it and falling slowly after it."""
    return F.when(seconds < 1, seconds).when(seconds <= 3, F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), 1 - 0.1 * (seconds - 3)))


def face_score(actions: Column) -> Column:
    """Score of the first emotion named by the first action that names one; 0.5 without actions, 0.3 without a match."""
    of = lambda a: F.coalesce(*[F.when(F.contains(F.lower(a), F.lit(e)), F.lit(v)) for e, v in EMOTIONS.items()])
    found = F.get(F.filter(F.transform(actions, of), lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.coalesce(F.size(actions), F.lit(0)) <= 0, F.lit(0.5)).otherwise(F.coalesce(found, F.lit(0.3)))


def camera_score(shake: Column, zoom: Column, dx: Column, dy: Column) -> Column:
    one = F.lit(1.0)
    return 0.4 * F.least(shake / 3, one) + 0.3 * F.least(F.abs(zoom - 1) / 0.5, one) + 0.3 * F.least((F.abs(dx) + F.abs(dy)) / 5, one)


def audio_score(seconds: Column) -> Column:
    return F.when(seconds < 0.5, F.lit(0.2)).when(seconds > 10, F.lit(0.4)).otherwise(F.lit(0.6))


def highlight_score(duration: Column, magnitude: Column, shake: Column, zoom: Column, dx: Column, dy: Column, actions: Column) -> Column:
    """Weighted sum of the component scores, clamped to [0, 1]."""
    w = WEIGHTS
    total = w["motion"] * sigmoid(magnitude) + w["duration"] * duration_score(duration) + w["face"] * face_score(actions) + w["camera"] * camera_score(shake, zoom, dx, dy) + w["audio"] * audio_score(duration)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def frame_score(sharpness: Column, mean: Column) -> Column:
    """Cover-frame score from Laplacian variance and mean brightness in [0, 1]."""
    bright = F.when(mean.between(0.35, 0.65), F.lit(1.0)).when(mean < 0.35, mean / 0.35).otherwise((1 - mean) / 0.35)
    bright = F.greatest(bright, F.lit(0.0))
    return 0.7 * F.log1p(sharpness) + 0.3 * bright * F.log1p(sharpness)
