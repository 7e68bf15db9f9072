"""Batches of vectors as numpy arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd


def rows(vectors: pd.Series, dims: int = 0) -> np.ndarray:
    """A batch of equally long vectors as a matrix with a row for each; no vectors give a matrix of no rows."""
    a = np.array(vectors.tolist(), float)
    return a if a.ndim == 2 and len(a) else a.reshape(len(vectors), dims)
