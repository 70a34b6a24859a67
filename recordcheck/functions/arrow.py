"""Wrap plain Python functions as Arrow-batched columns that compute each distinct argument of a batch once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def _annotated(run: Callable, count: int, struct: bool) -> Callable:
    """pandas_udf reads a function's signature, so the wrapper needs as many annotated parameters as there are columns."""
    names = [f"c{k}" for k in range(count)]
    lambda_ = eval(f"lambda {', '.join(names)}: run({', '.join(names)})", {"run": run})  # noqa: S307  fixed names only
    lambda_.__annotations__ = dict.fromkeys(names, pd.Series) | {"return": pd.DataFrame if struct else pd.Series}
    return lambda_


def arrow_function(function: Callable, returns: str) -> Callable[..., Column]:
    """Columns to the column of `function`'s results. Nulls reach it as None; a struct is returned as a dict or None."""
    count = function.__code__.co_argcount

    def column(*arguments: Column | str) -> Column:  # types and UDFs can be built only once there is a session
        kind = _parse_datatype_string(returns)
        struct = isinstance(kind, StructType)
        fields = kind.names if struct else []

        def run(*columns: pd.Series) -> pd.Series | pd.DataFrame:
            lists = [c.to_dict("records") if isinstance(c, pd.DataFrame) else c.astype(object).where(c.notna(), None).tolist() for c in columns]
            known: dict = {}
            out = []
            for row in zip(*lists):
                try:
                    if row not in known:
                        known[row] = function(*row)
                    out.append(known[row])
                except TypeError:  # arrays, maps and structs have no hash
                    out.append(function(*row))
            return pd.DataFrame([x or {} for x in out], columns=fields) if struct else pd.Series(out, dtype=object)

        return F.pandas_udf(_annotated(run, count, struct), returns)(*arguments)

    return column


#: Texts of a batch that are Python strings at a time.
SLICE = 128


def in_slices(function: Callable, texts: pa.Array) -> pa.Array:
    """function's results of texts, each distinct one of a slice computed once: of a batch, only a slice is Python strings at a time."""
    done = []
    for k in range(0, len(texts), SLICE):
        listed = texts.slice(k, SLICE).to_pylist()
        known = {text: function(text) for text in set(listed)}
        done.append(pa.array([known[text] for text in listed], pa.string()))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def text_function(function: Callable) -> Callable[[Column | str], Column]:
    """A text column to the text column of `function`'s results, for whole documents: a batch of 10,000 may hold 64 MB."""

    def column(texts: Column | str) -> Column:
        def run(texts: pa.Array) -> pa.Array:
            return in_slices(function, texts)

        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "string")(texts)

    return column
