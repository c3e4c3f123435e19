"""Functions of users' own: modules of named similarity functions, of columns or of NumPy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_modules: dict[str, dict[str, Callable]] = {"builtin": {"custom_similarity": lambda a, b: F.greatest(F.lit(0.0), 1 - F.abs(a[0].cast("double") - b[0].cast("double")))}}


def load_module(name: str, functions: dict[str, Callable[[Column, Column], Column]]) -> None:
    """Registers functions of two vector columns, under a module's name."""
    _modules[name] = dict(functions)


def function(module: str, name: str) -> Callable[[Column, Column], Column]:
    """A registered function; an unknown one gives 0 for everything."""
    return _modules.get(module, {}).get(name, lambda a, b: F.lit(0.0))


def vectorised(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A function of two matrices (a row of each for each pair) as one of columns, by Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(np.array(a.tolist(), float), np.array(b.tolist(), float)), dtype=float)

    return run


def register(spark: SparkSession, name: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Makes a function of two matrices callable by name in SQL."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(np.array(a.tolist(), float), np.array(b.tolist(), float)), dtype=float)

    spark.udf.register(name, run)
