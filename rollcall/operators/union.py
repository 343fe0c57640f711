"""Union by column name with missing columns filled, refusing type clashes up front."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SchemaClash(TypeError):
    """Two inputs carry the same column name with different types."""


def merge_schemas(schemas: list[T.StructType], names: list[str] | None = None) -> T.StructType:
    """The columns of all ``schemas``, the first one's first, then new names as they appear; one
    name with two types raises ``SchemaClash``, which calls the inputs by ``names``."""
    seen: dict[str, tuple[T.DataType, int]] = {}
    called = lambda i: names[i] if names else f"input {i}"
    for i, schema in enumerate(schemas):
        for f in schema.fields:
            prev = seen.get(f.name)
            if prev is None or isinstance(prev[0], T.NullType):
                seen[f.name] = (f.dataType, i)   # an all-missing column combines with anything
            elif not isinstance(f.dataType, T.NullType) and prev[0].simpleString() != f.dataType.simpleString():
                raise SchemaClash(
                    f"column {f.name!r}: {prev[0].simpleString()} in {called(prev[1])} "
                    f"but {f.dataType.simpleString()} in {called(i)}")
    return T.StructType([T.StructField(n, t, True) for n, (t, _) in seen.items()])


def bind_by_name(*dfs: DataFrame) -> DataFrame:
    """Stack frames matching columns by name; absent columns become null.

    Column order: the first frame's, then new names as they appear. Duplicates are
    kept. A type clash raises ``SchemaClash`` before anything runs (Spark alone
    would widen ``int`` + ``string`` and fail later, on data).
    """
    if not dfs:
        raise ValueError("bind_by_name needs at least one DataFrame")
    merge_schemas([df.schema for df in dfs])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
