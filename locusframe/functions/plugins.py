"""Functions of users over whole columns: one or more arrays in, one or more out."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FUNCTIONS: dict[str, Callable] = {}


def register(name: str, f: Callable) -> None:
    _FUNCTIONS[name] = f


def find(name: str) -> Callable:
    """A registered function, or ``module.function``."""
    if name in _FUNCTIONS:
        return _FUNCTIONS[name]
    module, _, f = name.rpartition(".")
    if not module:
        raise KeyError(name)
    return getattr(importlib.import_module(module), f)


def elementwise(f: Callable, returns: str = "double") -> Callable[..., Column]:
    """A function whose output at a row depends on that row alone, as an Arrow-batched UDF of any number of columns."""

    @F.pandas_udf(returns)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(*[c.to_numpy() for c in cols])))

    return run


def call(df: DataFrame, f: str | Callable, inputs: Sequence[str], outputs: str | Sequence[str], by: Sequence[str] = (), key: str = "loc_id") -> DataFrame:
    """df with f's outputs as features. f gets whole columns, of each group if ``by``, in the order of key.

    Whole-column functions need their group in one task; without ``by`` that is
    the table, so give one for large tables, or use ``elementwise``.
    """
    work = find(f) if isinstance(f, str) else f
    names = [outputs] if isinstance(outputs, str) else list(outputs)
    schema = ", ".join([*(f"`{k}` {t}" for k, t in df.dtypes if k not in names), *(f"`{n}` double" for n in names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable") if key in pdf.columns else pdf
        got = work(*[pdf[c].to_numpy() for c in inputs])
        got = [got] if len(names) == 1 and not isinstance(got, tuple) else list(got)
        return pdf.assign(**{n: np.asarray(v, float) for n, v in zip(names, got, strict=True)})

    return df.drop(*names).groupBy(*(by or [F.lit("all")])).applyInPandas(run, schema)


def reduce_columns(df: DataFrame, f: Callable, inputs: Sequence[str], rows: int = 20_000_000) -> float:
    """A function of whole columns that gives one number, for printing. It runs in a task of an executor, and only the
    number comes to the driver; more than ``rows`` rows raise an error, as one task must hold the columns."""
    n = df.count()
    if n > rows:
        raise ValueError(f"{n} rows are too many for one task; aggregate first")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"value": [float(np.asarray(f(*[pdf[c].to_numpy() for c in inputs])).reshape(-1)[0])]})

    return df.select(*inputs).groupBy(F.lit("all")).applyInPandas(run, "value double").first()["value"]
