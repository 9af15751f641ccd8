"""Values that several expressions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row.

    A column that a lambda mentions is computed again for each element; a lambda's own variable isn't.
    So the value becomes the one element of an array, and the body a lambda over it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
