"""Batches of rows for training: padded series with masks, stacked arrays, views and crops of one row."""

from __future__ import annotations

import numpy as np


def pad_series(rows: list[dict], name: str = "series", label: str | None = "label") -> dict:
    """[B][T][C] zero-padded to the longest series of the batch, with a mask of what is real."""
    arrays = [np.asarray(r[name], np.float32) for r in rows]
    arrays = [a[:, None] if a.ndim == 1 else a for a in arrays]
    most, c = max((len(a) for a in arrays), default=0), max((a.shape[1] for a in arrays), default=1)
    x, mask = np.zeros((len(rows), most, c), np.float32), np.zeros((len(rows), most), bool)
    for i, a in enumerate(arrays):
        x[i, : len(a), : a.shape[1]], mask[i, : len(a)] = a, True
    out = {name: x, "mask": mask}
    return out | ({label: np.array([r[label] for r in rows])} if label else {})


def fit_series(x: np.ndarray, length: int, mean=0.0, std=1.0) -> tuple[np.ndarray, np.ndarray]:
    """A series cut or zero-padded to ``length`` after normalising its channels, with its mask; not a number becomes 0."""
    x = np.nan_to_num((np.asarray(x, np.float32)[:length] - mean) / np.maximum(std, 1e-6))
    out = np.zeros((length, *x.shape[1:]), np.float32)
    out[: len(x)] = x
    return out, np.arange(length) < len(x)


def stack(rows: list[dict]) -> dict:
    """Columns of equal-shaped values."""
    return {k: np.stack([np.asarray(r[k]) for r in rows]) for k in (rows[0] if rows else {})}


def views(rows: list[dict], name: str, transforms: list) -> list[dict]:
    """A batch for each view: every row's ``name`` through that view's transform."""
    return [stack([{**r, name: f(r[name])} for r in rows]) for f in transforms]
