"""Spectra of trailing frames of a series (stream_id, t, value), t = 0, 1, ...

A frame grows from the eighth step until it has its full width (or the whole
stream, if that is shorter). Frames are cut out of bounded blocks of a stream
that carry a halo of earlier steps, some thousand frames at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.plans.blocks import Blocked

#: Steps before the first frame.
LEAST = 8
_FRAMES = 4096
_TINY = 1e-12


def _powers(frames: np.ndarray) -> np.ndarray:
    """Power of each frequency of the frames, their means taken off."""
    return np.abs(np.fft.rfft(frames - frames.mean(axis=1, keepdims=True), axis=1)) ** 2


def _whole(power: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Strongest frequency but the constant, entropy in bits, and total power."""
    total = power.sum(1)
    share = np.where(total[:, None] > _TINY, power / np.maximum(total, _TINY)[:, None], 0.0)
    entropy = -(share * np.log2(share + _TINY)).sum(1)
    return {"fft_dominant": power[:, 1:].argmax(1) + 1.0, "fft_entropy": entropy, "fft_power": total}


def _bands(power: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Mean power of the low, middle and high third, and the centroid."""
    thirds = np.array_split(power, 3, axis=1)
    total = power.sum(1)
    centre = np.where(total > _TINY, power @ np.fft.rfftfreq(size) / np.maximum(total, _TINY), 0.0)
    return {f"stft_{name}": third.mean(1) for name, third in zip(("low", "mid", "high"), thirds, strict=True)} | {"stft_centroid": centre}


def _framed(series: DataFrame, width: int, names: tuple[str, ...], measure: Callable[[np.ndarray, int], dict[str, np.ndarray]]) -> DataFrame:
    b = Blocked(series.select("stream_id", "t", "value"), width)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        t, x = rows["t"].to_numpy(), rows["value"].to_numpy(float)
        own = np.flatnonzero((rows["_block"] == rows["_own"]).to_numpy())
        out = {n: np.zeros(len(own)) for n in names}
        # a first block has frames that still grow; each size is a shape of its own
        size = np.minimum(t[own] + 1, width)
        for k in range(LEAST, width):
            for at in np.flatnonzero(size == k):
                e = own[at] + 1
                for n, v in measure(_powers(x[None, e - k : e]), k).items():
                    out[n][at] = v[0]
        full = np.flatnonzero(size == width) if width >= LEAST else np.zeros(0, int)
        for a in range(0, len(full), _FRAMES):
            at = full[a : a + _FRAMES]
            frames = x[own[at][:, None] + np.arange(1 - width, 1)]
            for n, v in measure(_powers(frames), width).items():
                out[n][at] = v
        return pd.DataFrame({"stream_id": rows["stream_id"].to_numpy()[own], "t": t[own], **out})

    return b.rows.groupBy("stream_id", "_block").applyInPandas(run, "stream_id string, t long, " + ", ".join(f"{n} double" for n in names))


def fft_features(series: DataFrame, width: int = 64) -> DataFrame:
    """(stream_id, t, fft_dominant, fft_entropy, fft_power); zeros before the
    eighth step. The dominant frequency is counted in cycles a frame."""
    return _framed(series, width, ("fft_dominant", "fft_entropy", "fft_power"), _whole)


def stft_features(series: DataFrame, width: int = 128) -> DataFrame:
    """(stream_id, t, stft_low, stft_mid, stft_high, stft_centroid): the centroid
    in cycles a step; zeros before the eighth step."""
    return _framed(series, width, ("stft_low", "stft_mid", "stft_high", "stft_centroid"), _bands)

