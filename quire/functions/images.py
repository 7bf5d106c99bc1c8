"""Image measures on rows of Spark's image source (height, width, nChannels, data)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _array(h: int, w: int, n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, n)[:, :, :3].astype(float)


def foreground_box(height: Column, width: Column, channels: Column, data: Column, pad: bool = True) -> Column:
    """Box of pixels darker than 245; with ``pad`` 4 pixels wider and in page units. Null for blank images."""

    @F.pandas_udf("struct<x:double,y:double,w:double,h:double>")
    def run(h: pd.Series, w: pd.Series, n: pd.Series, d: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, raw in zip(h, w, n, d, strict=True):
            ys, xs = np.nonzero(_array(a, b, c, raw).mean(axis=2) < 245)
            if not len(xs):
                out.append((None,) * 4)
            elif pad:
                x1, y1, x2, y2 = max(0, xs.min() - 4), max(0, ys.min() - 4), min(b, xs.max() + 5), min(a, ys.max() + 5)
                out.append((x1 / b, y1 / a, max(1e-6, (x2 - x1) / b), max(1e-6, (y2 - y1) / a)))
            else:
                out.append((float(xs.min()), float(ys.min()), float(xs.max() + 1 - xs.min()), float(ys.max() + 1 - ys.min())))
        return pd.DataFrame(out, columns=["x", "y", "w", "h"], dtype=float)

    return run(height, width, channels, data)


def _uniform(x: np.ndarray, size: int = 7) -> np.ndarray:
    """Mean of each size by size window that lies inside."""
    s = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def structural_similarity(a: np.ndarray, b: np.ndarray, size: int = 7, span: float = 255.0) -> float:
    """SSIM with a uniform window, mean over channels; 0 for other shapes, equality for tiny images."""
    if a.shape != b.shape:
        return 0.0
    if min(a.shape[:2]) < size:
        return float(np.array_equal(a, b))
    c1, c2, n = (0.01 * span) ** 2, (0.03 * span) ** 2, size**2
    scores = []
    for k in range(a.shape[2]):
        x, y = a[..., k].astype(float), b[..., k].astype(float)
        ux, uy = _uniform(x), _uniform(y)
        vx, vy, vxy = ((_uniform(p) - q) * n / (n - 1) for p, q in ((x * x, ux * ux), (y * y, uy * uy), (x * y, ux * uy)))
        scores.append((((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux**2 + uy**2 + c1) * (vx + vy + c2))).mean())
    return float(np.clip(np.mean(scores), 0.0, 1.0))


def ssim(a: Column, b: Column) -> Column:
    """SSIM of two image structs (height, width, nChannels, data)."""

    @F.pandas_udf("double")
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        rows = zip(x.itertuples(index=False), y.itertuples(index=False), strict=True)
        return pd.Series([structural_similarity(_array(p.height, p.width, p.nChannels, p.data), _array(q.height, q.width, q.nChannels, q.data)) for p, q in rows])

    pick = lambda c: F.struct(c.height.alias("height"), c.width.alias("width"), c.nChannels.alias("nChannels"), c.data.alias("data"))
    return run(pick(a), pick(b))
