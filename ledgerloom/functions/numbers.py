"""Money, rates and amounts as Column to Column functions; decimals inside, text only at the edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What text recognition writes where it finds no number.
PLACEHOLDERS = ["-", "+", "%", "--", "N/A", "n/a", "na", "NA", ""]


def safe_decimal(raw: Column) -> Column:
    """A non-negative decimal(18,6); null for placeholders and what doesn't parse. One sign or % in front is dropped; a decimal comma isn't read."""
    text = F.trim(raw)
    bare = F.trim(F.regexp_replace(text, r"^[+\-%]", ""))
    return F.when(~text.isin(PLACEHOLDERS), F.abs(bare.try_cast("decimal(18,6)")))


def clean_value(raw: Column) -> Column:
    """A recognised value without its leading sign; null for placeholders."""
    text = F.trim(raw)
    return F.when(~text.isin(PLACEHOLDERS), F.nullif(F.trim(F.regexp_replace(text, r"^[+\-%]", "")), F.lit("")))


def comma_amount(value: Column) -> Column:
    """Two decimals, rounded half up, with a decimal comma."""
    return F.translate(F.round(value, 2).cast("decimal(18,2)").cast("string"), ".", ",")


def safe_float(raw: Column) -> Column:
    """Comma read as point; 0 for what doesn't parse, so also for thousands points with a comma."""
    return F.coalesce(F.replace(F.trim(raw), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def spanish_number(raw: Column) -> Column:
    """With a comma, points are thousands; 0 for what doesn't parse."""
    text = F.trim(raw)
    both = text.contains(",") & text.contains(".")
    plain = F.when(both, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def export_rate(rate: Column) -> Column:
    """The export's rate code: 9 for a zero rate, else the plain number."""
    plain = F.regexp_replace(F.regexp_replace(rate.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(rate == 0, F.lit("9")).otherwise(F.coalesce(plain, F.lit("")))


def is_editable(text: Column) -> Column:
    """What an amount may look like while it is typed: digits, one comma, one minus in front; also nothing."""
    return text.rlike(r"^-?\d*(,\d*)?$")


def csv_cell(value: Column) -> Column:
    """A cell for a semicolon CSV: quoted if it holds ; " CR or LF, quotes doubled."""
    return F.when(value.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_cell_lf(value: Column) -> Column:
    """As :func:`csv_cell`, without looking at CR: the client history's variant."""
    return F.when(value.rlike('[;"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def nearest(value: Column, choices: list[float], within: float) -> Column:
    """The closest of a few choices, the smaller on a tie, null if none is within the distance."""
    kind = "decimal(18,6)"
    best = F.least(*(F.struct(F.abs(value - F.lit(str(c)).cast(kind)).alias("d"), F.lit(str(c)).cast(kind).alias("c")) for c in choices))
    return F.when(best["d"] <= F.lit(str(within)).cast(kind), best["c"])
