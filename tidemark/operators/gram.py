"""Least squares per key from sums of products.

One shuffle brings the rows of a key, which the calendar bounds, into one task; there the products of
z = [features, target] less their means (large levels with small changes would drown in the products otherwise) are
added up as one matrix product.  A row travels as its values only: with all products it would be twenty times as wide,
and aggregates that hold vectors sort and spill such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import solvers

FIT_SCHEMA = (
    "n long, weights array<double>, intercept double, std_coef array<double>, max_abs_coef double"
)
ARRAY = pa.list_(pa.float64())
FIT_FIELDS = [("n", pa.int64()), ("weights", ARRAY), ("intercept", pa.float64()), ("std_coef", ARRAY), ("max_abs_coef", pa.float64())]


def grouped(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], body: Callable[..., dict[str, Any]], fields: Sequence[tuple[str, pa.DataType | None]],
            schema: str, extra: Sequence[str] = ()) -> DataFrame:
    """``body(z, table)`` once a key: z has the key's rows of ``columns`` as doubles, the Arrow table those of ``extra``.

    It returns the result columns ``fields`` (``schema`` in DDL) as lists of equal length, or as Arrow arrays where no type is
    named; the keys go before them.
    """
    key_list, width = list(keys), len(columns)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    value = F.array(*[F.col(c).cast("double") for c in columns])
    slim = rows.select(*key_list, *[c for c in extra if c not in key_list], value.alias("__z"))

    def per_key(key: tuple, table: pa.Table) -> pa.Table:
        z = table["__z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        if np.isnan(z).any():
            raise ValueError("null or NaN among the values of a fit")
        out = body(z, table)
        size = len(out[fields[0][0]])
        named = {k: pa.array([v.as_py()] * size, type=v.type) for k, v in zip(key_list, key)}
        return pa.table(named | {name: out[name] if kind is None else pa.array(out[name], type=kind) for name, kind in fields})

    ddl = ", ".join([*[f"{k} {kinds[k]}" for k in key_list], schema])
    return slim.groupBy(*key_list).applyInArrow(per_key, ddl)


def keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all known: only those are fitted."""
    return rows.dropna(subset=list(keys))


def fit(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alpha: float = 0.0) -> DataFrame:
    """Standardised ridge (alpha 0: least squares) per key."""
    return ridge(rows, keys, features, target, [alpha]).drop("alpha")


def ridge(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alphas: Sequence[float]) -> DataFrame:
    """Ridge per key, its penalty the one of ``alphas`` with the least leave-one-out squared error, ties to the first."""
    p, grid = len(features), [float(a) for a in alphas]

    def fitted(z: np.ndarray, table: pa.Table) -> dict[str, Any]:
        weights, intercept, coef, alpha = solvers.row_ridge(z, p, grid)
        return {"n": [len(z)], "weights": [weights], "intercept": [intercept], "std_coef": [coef],
                "max_abs_coef": [abs(coef).max()], "alpha": [alpha]}

    fields = [*FIT_FIELDS, ("alpha", pa.float64())]
    return grouped(keyed(rows, keys), keys, [*features, target], fitted, fields, f"{FIT_SCHEMA}, alpha double")


def linear(features: Sequence[str], weights: str = "weights", intercept: str = "intercept") -> Column:
    """Prediction of a joined fit as one column expression."""
    out = F.col(intercept)
    for i, name in enumerate(features):
        out = out + F.col(name).cast("double") * F.col(weights)[i]
    return out
