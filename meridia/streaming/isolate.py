"""Which rows of a batch make the work on it fail.

``failing`` runs the work on ever smaller parts of a batch, by hash, and follows only the
parts that fail; rows stay in Spark, and what the driver holds is one number and one
message for each bad row.  Only data errors count as a row's fault: a lost executor, a
full disk or a mistake in a plan is never blamed on a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SQLSTATE classes of what is wrong with a value: data exceptions, and errors that an expression raises.
_DATA = re.compile(r"\[(\w[\w.]*)\](.*?)SQLSTATE: (?:22\w{3}|P0001)", re.S)
#: Parts that a failing part is cut into.
FAN = 8
#: Column with a row's number; equal rows share it.
ROW = "_row"
_SPAN = 1 << 60


class TooManyFailing(RuntimeError):
    """So many rows fail that the work is wrong rather than the rows."""


def row_error(failure: BaseException) -> str | None:
    """What is wrong with some row, if that is why Spark failed."""
    found = _DATA.search(str(failure))
    return f"{found[1]}: {' '.join(found[2].split())}"[:500] if found else None


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn(ROW, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(_SPAN)))


def failing(rows: DataFrame, work: Callable[[DataFrame], None], most: int) -> dict[int, str]:
    """{number: what is wrong} of the ``numbered`` rows on which ``work``, which writes nothing, fails by itself.

    Empty if the work fails on no part alone.  Each failing part costs FAN runs a level,
    so beyond ``most`` failing parts it is given up.
    """
    bad: dict[int, str] = {}
    parts = [(0, 1)]
    while parts:
        deeper = []
        for rest, modulus in parts:
            part = rows.filter(F.pmod(ROW, F.lit(modulus)) == rest)
            wrong = _tried(work, part)
            if wrong is None:
                continue
            here = [r[0] for r in part.select(ROW).distinct().limit(2).collect()]
            if len(here) == 1:
                bad[here[0]] = wrong
            else:
                deeper += [(rest + k * modulus, modulus * FAN) for k in range(FAN)]
            if len(bad) + len(deeper) // FAN > most:
                raise TooManyFailing(f"over {most} rows fail, for example: {wrong}")
        parts = deeper
    return bad


def _tried(work: Callable[[DataFrame], None], part: DataFrame) -> str | None:
    try:
        work(part)
    except Exception as e:
        wrong = row_error(e)
        if wrong is None:
            raise
        return wrong
    return None
