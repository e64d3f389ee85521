"""Octaves of a window's frequencies: smooth filters that add up to one, so that
a window is the sum of its shells.

Frequencies run from 0 to 1 (Nyquist). The lowest shell is half a bell around 0,
the highest half a bell around 1, those between are bells over the logarithm of
the frequency, an octave apart; at every frequency they are scaled to sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a bell in octaves, what keeps logarithms finite, and the
#: least response.
_WIDTH, _EPS, _LEAST = 0.6, 1e-4, 1e-6
#: Shorter windows are not taken apart: the lowest shell holds all of them.
LEAST_STEPS = 4


def filters(bins: int, shells: int = 4) -> np.ndarray:
    """(shells, bins) responses; each column sums to one."""
    if shells < 2:
        raise ValueError("there are two shells at least")
    w = np.linspace(0.0, 1.0, bins)
    centre = 2.0 ** np.arange(1 - shells, 1)
    centre[0] = 0.0
    low = (w / (centre[1] + _EPS)) ** 2
    high = ((1 - w) / (1 - centre[-2] + _EPS)) ** 2
    bells = [((np.log2(w + _EPS) - np.log2(c + _EPS)) / _WIDTH) ** 2 for c in centre[1:-1]]
    response = np.maximum(np.exp(-0.5 * np.array([low, *bells, high])), _LEAST)
    return response / response.sum(axis=0)


def split(x: np.ndarray, shells: int = 4) -> np.ndarray:
    """(shells, ..., steps) of windows whose last axis is time."""
    steps = x.shape[-1]
    if steps < LEAST_STEPS:
        return np.concatenate([x[None], np.zeros((shells - 1, *x.shape))])
    spectrum = np.fft.rfft(x, axis=-1)
    weight = filters(spectrum.shape[-1], shells).reshape(shells, *[1] * (x.ndim - 1), -1)
    return np.fft.irfft(spectrum[None] * weight, n=steps, axis=-1)


def shell_windows(windows: DataFrame, channels: int, shells: int = 4) -> DataFrame:
    """(stream_id, i, shell, x, energy) of windows (stream_id, i, x), whose x runs
    through all channels of a step, then of the next: each shell's part of the
    window in the same layout, and its mean square. Windows of one batch may
    differ in length; an empty one has empty shells without energy."""

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(batch["x"].map(len), sort=False):
                x = np.stack(rows["x"].to_numpy()).astype(float).reshape(len(rows), -1, channels)
                parts = split(x.transpose(0, 2, 1), shells) if x.size else np.zeros((shells, len(rows), channels, 0))
                energy = (parts**2).mean(axis=(2, 3)) if x.size else np.full((shells, len(rows)), np.nan)
                for j in range(shells):
                    flat = parts[j].transpose(0, 2, 1).reshape(len(rows), -1)
                    yield pd.DataFrame({"stream_id": rows["stream_id"], "i": rows["i"], "shell": np.int32(j), "x": list(flat), "energy": energy[j]})

    rows = windows.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("i").cast("long").alias("i"), F.coalesce(F.col("x").cast("array<double>"), F.array().cast("array<double>")).alias("x"))
    return rows.mapInPandas(apart, "stream_id string, i long, shell int, x array<double>, energy double")


def shell_energies(windows: DataFrame, channels: int, shells: int = 4) -> DataFrame:
    """(stream_id, i, energy, share, relative): one array entry for each shell:
    its mean square, its part of all shells' (0 where there is none), and its
    logarithm in units of the deviation among the window's shells."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(batch["x"].map(len), sort=False):
                x = np.stack(rows["x"].to_numpy()).astype(float).reshape(len(rows), -1, channels)
                energy = (split(x.transpose(0, 2, 1), shells) ** 2).mean(axis=(2, 3)).T if x.size else np.zeros((len(rows), shells))
                total, logs = energy.sum(axis=1, keepdims=True), np.log(energy + 1e-6)
                share = np.divide(energy, total, out=np.zeros_like(energy), where=total > 0)
                relative = (logs - logs.mean(axis=1, keepdims=True)) / (logs.std(axis=1, keepdims=True) + 1e-5)
                yield pd.DataFrame({"stream_id": rows["stream_id"], "i": rows["i"], "energy": list(energy), "share": list(share), "relative": list(relative)})

    rows = windows.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("i").cast("long").alias("i"), F.coalesce(F.col("x").cast("array<double>"), F.array().cast("array<double>")).alias("x"))
    return rows.mapInPandas(measured, "stream_id string, i long, energy array<double>, share array<double>, relative array<double>")
