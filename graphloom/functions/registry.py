"""Functions and procedures that users add under qualified names.

A scalar function gets the SQL of its arguments and gives SQL, or is a Spark UDF under its registered name; a read procedure gives rows, a write procedure
a new graph and rows. Arguments may have defaults; types are those of the rows that come back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

#: name -> arguments' SQL -> SQL
SCALARS: dict[str, Callable[..., str]] = {}


def register_function(name: str, body: Callable, spark: SparkSession | None = None, returns: str | None = None) -> None:
    """body gets and gives SQL; or, with a session and a return type, body is a Python function over values, run as a vectorised UDF on Arrow batches."""
    if returns is None:
        SCALARS[name.lower()] = body
        return
    from pyspark.sql.functions import pandas_udf

    own = "graphloom_" + name.lower().replace(".", "_")

    def mapped(first, *rest):
        import pandas as pd

        return pd.Series([body(*values) for values in zip(first, *rest, strict=True)])

    import pandas as pd

    names = body.__code__.co_varnames[: body.__code__.co_argcount]
    scope = {"mapped": mapped, "pd": pd}
    exec(f"def f({', '.join(f'{n}: pd.Series' for n in names)}) -> pd.Series:\n    return mapped({', '.join(names)})", scope)  # the UDF's arity comes from its signature
    spark.udf.register(own, pandas_udf(scope["f"], returns))
    SCALARS[name.lower()] = lambda *args: f"{own}({', '.join(args)})"


def register_procedure(name: str, body: Callable, takes: tuple[int, ...] = (), writes: bool = False) -> None:
    """body(graph, *args) -> rows. takes: the places of arguments that are nodes or relationships; body then gets (graph, ids(source[, target]), *other args)
    and says by these columns to which ids a row belongs. writes: body gives (graph, rows)."""
    from ..operators import procedures

    key = name.lower()
    procedures.PROCEDURES[key] = body
    procedures.TAKES.pop(key, None)
    procedures.WRITES.discard(key)
    if takes:
        procedures.TAKES[key] = takes
    if writes:
        procedures.WRITES.add(key)


def register_alias(name: str, other: str) -> None:
    """Calls of name go to other."""
    from ..operators import procedures

    if other.lower() in SCALARS:
        SCALARS[name.lower()] = SCALARS[other.lower()]
    else:
        register_procedure(name, procedures.PROCEDURES[other.lower()], procedures.TAKES.get(other.lower(), ()), other.lower() in procedures.WRITES)
