"""Survey clauses written as boolean text over survey columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = re.compile(r"('[^']*'|\"[^\"]*\")")


def clause(text: str) -> Column:
    """Boolean Column for a clause such as ``(a > 0) | (b == 'severe')``.

    ``&`` and ``|`` are the logical AND and OR of whole comparisons, so they are
    spelled out before Spark reads the text (Spark's own ``|`` is bitwise).
    Quoted strings are left alone. A comparison with null counts as false.
    """
    pieces = _QUOTED.split(text)
    for i in range(0, len(pieces), 2):
        pieces[i] = pieces[i].replace("&", " AND ").replace("|", " OR ")
    for i in range(1, len(pieces), 2):
        if pieces[i].startswith('"'):
            pieces[i] = "'" + pieces[i][1:-1].replace("'", "\\'") + "'"
    return F.coalesce(F.expr("".join(pieces)), F.lit(False))
