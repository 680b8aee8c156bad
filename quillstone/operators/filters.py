"""Optional conjunctive filters on orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def predicate(category=None, department=None, goid=None, date_from=None, date_to=None, go_no=None) -> Column:
    """A filter that is null or empty is absent.  Dates compare as text; go_no is a LIKE part, ASCII case folded."""
    held = F.lit(True)
    for column, value in (("category", category), ("department", department), ("goid", goid)):
        if value:
            held &= F.col(column) == F.lit(value)
    if date_from:
        held &= F.col("go_date_iso") >= date_from
    if date_to:
        held &= F.col("go_date_iso") <= date_to
    if go_no:
        held &= F.translate("go_no", _UPPER, _LOWER).like("%" + go_no.translate(str.maketrans(_UPPER, _LOWER)) + "%")
    return held
