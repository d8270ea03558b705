"""Order-insensitive comparison of two frames' values."""

import numpy as np
import pandas as pd


def values(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)

    return sorted((tuple(map(plain, row)) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert values(a) == values(b)
