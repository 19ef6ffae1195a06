"""Several output rows from one input row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rows(names: str, *each: tuple) -> Column:
    """An array of structs with the same field names, to explode; strings name columns."""
    fields = names.split()
    of = lambda x: F.col(x) if isinstance(x, str) else x
    return F.array(*[F.struct(*[of(v).alias(n) for n, v in zip(fields, e, strict=True)]) for e in each])
