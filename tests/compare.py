"""Values of Spark and DuckDB in one form."""

from __future__ import annotations

import datetime
import decimal


def value(x) -> str:
    if isinstance(x, decimal.Decimal):
        x = int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        x = round(x, 6)
        return repr(int(x)) if x == int(x) else repr(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return repr([value(y) for y in x])
    return repr(x)


def normal(row) -> tuple[str, ...]:
    return tuple(value(x) for x in row)
