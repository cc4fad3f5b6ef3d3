"""Scalar column functions.

All return ``Column`` expressions or one-projection DataFrame transforms, so
they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c, fill: float | None = 0.0) -> Column:
    """lenient numeric cast; unparsable text is NULL, then ``fill`` (if any)."""
    v = F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return v if fill is None else F.coalesce(v, F.lit(float(fill)))


def bool_to_int(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """boolean columns (all, or the listed ones) become 0/1 integers."""
    targets = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"
    }
    return df.select(*[F.col(c).cast("int").alias(c) if c in targets else F.col(c) for c in df.columns])


def complement(p) -> Column:
    """``1 - p``."""
    return F.lit(1.0) - _c(p)


def first_field(array_col, field: str) -> Column:
    """``field`` of the first array element; empty, NULL or odd input gives NULL."""
    return F.try_element_at(_c(array_col), F.lit(1)).getField(field)


def null_defaults(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL defaults by name and type (V5).

    A numeric column (the ``percent``/``rate`` ones included) gets 0, a string
    column ``""``; other types are left alone. One projection.
    """
    cols = set(columns) if columns is not None else set(df.columns)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in cols:
            if isinstance(f.dataType, NumericType):
                c = F.coalesce(c, F.lit(0).cast(f.dataType))
            elif isinstance(f.dataType, StringType):
                c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def pick_winner(p, home_name, away_name, threshold: float = 0.5) -> tuple[Column, Column]:
    """(winner, confidence): home when p >= threshold, confidence max(p, 1-p)."""
    p = _c(p)
    winner = F.when(p >= threshold, _c(home_name)).otherwise(_c(away_name))
    return winner, F.greatest(p, F.lit(1.0) - p)


def round_half_away(c, digits: int) -> Column:
    """round to ``digits`` decimals, half away from zero, on the binary value.

    ``t = |x| * 10^digits``; the result is ``sign(x) * (floor(t) + [t - floor(t) >= 0.5]) / 10^digits``,
    the rounding SQL engines apply to DOUBLE. It stays inside generated code
    (``round()`` on a double goes through a BigDecimal per value, several
    times slower). Beyond 2^52 a double is already integral and is returned.
    """
    x = _c(c)
    m = 10.0 ** digits
    t = F.abs(x) * F.lit(m)
    fl = F.floor(t)
    up = fl + F.when(t - fl >= 0.5, F.lit(1)).otherwise(F.lit(0))
    return F.when(t >= F.lit(4503599627370496.0), x).otherwise(F.signum(x) * up / F.lit(m))


# Probabilities to 4 digits, margins to 1.
round_half_up = round_half_away


def safe_int(c) -> Column:
    """optional int; NaN, text or NULL become NULL."""
    c = _c(c)
    return F.when(~F.isnan(c.try_cast("double")), c.try_cast("double")).cast("long")


def safe_float(c) -> Column:
    """optional float; NaN becomes NULL (never mix NaN and NULL)."""
    d = _c(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def safe_str(c) -> Column:
    """optional string; NULL stays NULL."""
    return _c(c).cast("string")


def iso_timestamp(c) -> Column:
    """ISO-8601 text with offset, ``+00:00`` style (session time zone UTC)."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ssxxx")


def bool_default(c, default: bool = False) -> Column:
    """missing boolean takes ``default``."""
    return F.coalesce(_c(c), F.lit(default))


def season_of_date(d, first_month: int = 8) -> Column:
    """a date in month >= ``first_month`` belongs to its year, else the year before."""
    d = _c(d)
    return F.when(F.month(d) >= first_month, F.year(d)).otherwise(F.year(d) - 1)
