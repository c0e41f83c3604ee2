"""NumPy kernels over Arrow batches: cosine transform, spectral power and frame quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cosine_basis(n: int, k: int) -> np.ndarray:
    """(n*n, k*k) matrix whose columns are the first k x k orthonormal 2-D DCT-II functions."""
    pos = np.arange(n)
    one = np.cos(np.pi * (2 * pos[None, :] + 1) * np.arange(k)[:, None] / (2 * n))
    one *= np.sqrt(np.where(np.arange(k) == 0, 1.0, 2.0) / n)[:, None]
    return np.einsum("uy,vx->yxuv", one, one).reshape(n * n, k * k)


def dct_lowfreq(df: DataFrame, n: int, k: int) -> DataFrame:
    """Adds ``coeffs``: the k x k lowest coefficients of an n x n grid in ``pixels``, row by row."""
    keep = [c for c in df.columns if c != "pixels"]
    schema = df.select(*keep, F.lit(None).cast("array<double>").alias("coeffs")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis = _cosine_basis(n, k)
        for batch in batches:
            out = batch[keep].copy()
            if len(batch):
                grid = np.stack(batch["pixels"].to_numpy()).astype("float64")
                out["coeffs"] = list(grid @ basis)
            else:
                out["coeffs"] = pd.Series(dtype=object)
            yield out

    return df.mapInPandas(run, schema)


def histogram_correlation(df: DataFrame, bins: int) -> DataFrame:
    """Adds ``_correlation`` of the histograms of ``pixels`` and ``next_pixels``, grey values 0 to 255.

    Values outside fall in the first or last bin.
    """
    schema = df.select("*", F.lit(0.0).alias("_correlation")).schema

    def counts(pixels) -> np.ndarray:
        at = np.clip(np.floor(np.asarray(pixels, float) * bins / 256), 0, bins - 1).astype(int)
        return np.bincount(at, minlength=bins).astype(float)

    def correlation(a: np.ndarray, b: np.ndarray) -> float:
        a, b = a - a.mean(), b - b.mean()
        spread = np.sqrt((a @ a) * (b @ b))
        return float(a @ b / spread) if spread > 0 else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = zip(batch["pixels"], batch["next_pixels"], strict=True)
            yield batch.assign(_correlation=np.array([correlation(counts(a), counts(b)) for a, b in both], float))

    return df.mapInPandas(run, schema)


def frequency_artifacts(df: DataFrame, n: int) -> DataFrame:
    """Adds ``artifact_score``: difference in high-frequency power of ``pixels`` and ``next_pixels``.

    Power is the mean magnitude outside 0.3 * n around the centre of the shifted spectrum,
    pixels scaled to [0, 1]; the difference is divided by 0.5 and capped at 1.
    """
    keep = [c for c in df.columns if c not in ("pixels", "next_pixels")]
    schema = df.select(*keep, F.lit(0.0).alias("artifact_score")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axis = np.arange(n) - n // 2
        outer = np.hypot(axis[:, None], axis[None, :]) > n * 0.3

        def power(column: pd.Series) -> np.ndarray:
            grid = np.stack(column.to_numpy()).astype("float64").reshape(-1, n, n) / 255.0
            spectrum = np.abs(np.fft.fftshift(np.fft.fft2(grid), axes=(1, 2)))
            return spectrum[:, outer].mean(axis=1)

        for batch in batches:
            out = batch[keep].copy()
            if len(batch):
                gap = np.abs(power(batch["pixels"]) - power(batch["next_pixels"]))
                out["artifact_score"] = np.minimum(1.0, gap / 0.5)
            else:
                out["artifact_score"] = pd.Series(dtype="float64")
            yield out

    return df.mapInPandas(run, schema)


def frame_quality(df: DataFrame, n: int) -> DataFrame:
    """Adds ``quality`` of the n x n grid in ``pixels``, in [0, 1].

    0.7 * sharpness (Laplacian variance / 500, at most 1) + 0.3 * contrast (deviation / 128).
    The Laplacian mirrors the grid at its border without repeating the edge pixel.
    """
    keep = [c for c in df.columns if c != "pixels"]
    schema = df.select(*keep, F.lit(0.0).alias("quality")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keep].copy()
            if len(batch):
                grid = np.stack(batch["pixels"].to_numpy()).astype("float64").reshape(-1, n, n)
                p = np.pad(grid, ((0, 0), (1, 1), (1, 1)), mode="reflect")
                around = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:]
                sharp = np.minimum((around - 4 * grid).var(axis=(1, 2)) / 500, 1.0)
                mixed = 0.7 * sharp + 0.3 * grid.std(axis=(1, 2)) / 128
                out["quality"] = np.clip(mixed, 0.0, 1.0)
            else:
                out["quality"] = pd.Series(dtype="float64")
            yield out

    return df.mapInPandas(run, schema)
