"""Rows of a frame in a form in which Spark's and DuckDB's results can be compared."""

import math

import numpy as np


def plain(v):
    if v is None:
        return None
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return None if str(v) in ("NaT", "<NA>") else v if isinstance(v, int | bool) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)
