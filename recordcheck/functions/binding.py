"""Name an expression's arguments, so that each is planned and computed once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(build: Callable[..., Column], *arguments: Column) -> Column:
    """build(*arguments), with the arguments as fields of a lambda's variable: Catalyst cannot copy them into their uses."""
    item = F.struct(*[a.alias(f"x{k}") for k, a in enumerate(arguments)])
    return F.get(F.transform(F.array(item), lambda s: build(*[s[f"x{k}"] for k in range(len(arguments))])), F.lit(0))
