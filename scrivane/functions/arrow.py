"""Arrow functions that are declared before a session exists."""

from __future__ import annotations

from functools import wraps

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and bytes of a batch that a function is given at once; a larger row comes alone.
STEP_ROWS, STEP_BYTES = 64, 1 << 20


def steps(columns: tuple[pa.Array, ...]):
    """(from, rows) of pieces of a batch, within STEP_ROWS and STEP_BYTES."""
    todo = [(0, len(columns[0]))]
    while todo:
        at, n = todo.pop()
        if n > 1 and (n > STEP_ROWS or sum(c.slice(at, n).nbytes for c in columns) > STEP_BYTES):
            todo += [(at + n // 2, n - n // 2), (at, n // 2)]
        else:
            yield at, n


def in_steps(function):
    """A row-wise function, so that a batch's Python values (trees, lists of rows) are held for one piece at a time."""

    @wraps(function)
    def run(*columns):
        return pa.concat_arrays([function(*(c.slice(at, n) for c in columns)) for at, n in steps(columns)])

    return run


def arrow_function(ddl: str):
    """Like arrow_udf, but the type text is parsed when the function is first applied to columns; `.udf()` gives it for registration. It is to work row by row."""

    def wrap(function):
        stepped = in_steps(function)

        def apply(*columns: Column) -> Column:
            return F.arrow_udf(stepped, ddl)(*columns)

        apply.__name__, apply.__doc__ = function.__name__, function.__doc__
        apply.udf = lambda: F.arrow_udf(stepped, ddl)
        return apply

    return wrap
