"""Global reductions of a superstep: each is one aggregate column over the vertices that computed."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregator:
    """``column(old, new)``: an aggregate over old and new values of the vertices that computed."""

    column: Callable[[Column, Column], Column]


SUM = Aggregator(lambda old, new: F.coalesce(F.sum(new.cast("double")), F.lit(0.0)))
MIN = Aggregator(lambda old, new: F.coalesce(F.min(new), F.lit(2147483647)))
MAX = Aggregator(lambda old, new: F.coalesce(F.max(new), F.lit(-2147483648)))
COUNT = Aggregator(lambda old, new: F.count(F.lit(1)))


def _difference(old: Column, new: Column) -> Column:
    return F.coalesce(F.sum(F.when(old.isNotNull(), F.abs(old - new))), F.lit(0.0))


ABS_DIFF = Aggregator(_difference)
#: As above with each new value added as well, as some older engines count.
LEGACY_ABS_DIFF = Aggregator(lambda old, new: _difference(old, new) + F.coalesce(F.sum(new), F.lit(0.0)))
#: Average change, over the vertices that computed.
AVERAGE_CHANGE = Aggregator(lambda old, new: F.try_divide(_difference(old, new), F.count(F.lit(1))))
