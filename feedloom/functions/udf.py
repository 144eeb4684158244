"""Arrow functions that are made when first used, as a session is needed to make them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(return_type: str) -> Callable[[Callable[..., pa.Array]], Callable[..., Column]]:
    def register(f: Callable[..., pa.Array]) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.arrow_udf(f, return_type)(*columns)

        return call

    return register
