"""JSON text as records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def json_objects(line: Column, schema: str) -> Column:
    """What :func:`is_object` and :func:`first_object` look at: the line and an empty object as one array.

    Text behind an object would be ignored by the parser; inside the array it makes the array malformed, or longer.
    Of equal names the last one counts, NaN and infinities are numbers, a field of another type than the
    schema's is null, and names that the schema lacks are skipped.
    """
    both = F.concat(F.lit("["), line, F.lit(",{}]"))
    return F.from_json(both, ArrayType(StructType.fromDDL(schema)), {"allowSingleQuotes": "false"})


def is_object(objects: Column, line: Column) -> Column:
    """Whether the line was one JSON object."""
    return F.coalesce(F.startswith(line, F.lit("{")) & (F.size(objects) == 2), F.lit(False))


def first_object(objects: Column) -> Column:
    return F.get(objects, 0)
