"""Arithmetic of speech output: silence, samples, WAV bytes."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, functions as F


def silence_seconds(text: Column, rate: float = 1.0) -> Column:
    """How long a text that can't be spoken is silent: 0.04 s a character, 0.3 s at least."""
    return F.greatest(F.lit(0.3), F.char_length(text) * 0.04 / rate)


def samples(wave: np.ndarray) -> np.ndarray:
    """A wave from -1 to 1 as 16-bit samples; beyond that it is clipped."""
    return (np.clip(wave, -1, 1) * 32767).astype("<i2")


def wav(data: np.ndarray, rate: int = 24000) -> bytes:
    """A mono, 16-bit WAV file."""
    raw = data.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(raw)) + raw
