"""Column functions of statistical disclosure control."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counts of 1 to FLOOR are hidden, others are rounded to a multiple of FLOOR.
FLOOR = 20
HIDDEN = "suppressed"


def disclosable(n: Column) -> Column:
    """True if n is 0 or above the floor, and whole and finite; false for null."""
    x = n.cast("double")
    whole = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e15) & (F.floor(x) == x)
    return F.coalesce(whole & ((x == 0) | (x > FLOOR)), F.lit(False))


def round20(n: Column) -> Column:
    """0 stays 0, hidden counts become null, others go to the nearest multiple, halves up."""
    return F.when(n == 0, F.lit(0)).when(disclosable(n), (F.floor((n + FLOOR / 2) / FLOOR) * FLOOR)).cast("long")


def reason(n: Column) -> Column:
    return F.when(n.isNull(), "missing").when(~disclosable(n), HIDDEN)


def is_legal_count(n: Column) -> Column:
    """A count as it may be written down: 0, or a positive multiple of the floor, which is all that rounding makes. A written
    20 stands for 21 to 29, where a true 20 may not be shown (``disclosable``)."""
    return F.coalesce((n >= 0) & (n % FLOOR == 0), F.lit(False))


def render_count(n: Column) -> Column:
    return F.when(n.isNull(), HIDDEN).otherwise(F.format_number(n, 0))


def percent(n: Column, total: Column) -> Column:
    """Whole percent of the rounded count in the rounded total; null if either is hidden or the total is 0."""
    a, b = round20(n), round20(total)
    return F.when(a.isNotNull() & (b > 0), F.floor(100 * a / b + 0.5)).cast("long")


def n_pct(n: Column, total: Column) -> Column:
    p = percent(n, total)
    return F.when(p.isNull(), HIDDEN).otherwise(F.concat(render_count(round20(n)), F.lit(" ("), p.cast("string"), F.lit("%)")))


def shown_part(part: Column, whole: Column) -> Column:
    """A part may be shown only if it, the whole and the rest all clear the floor."""
    return disclosable(part) & disclosable(whole) & disclosable(whole - part)


def is_hidden_cell(text: Column) -> Column:
    """A displayed cell that stands for a hidden value, in any sanctioned spelling."""
    return F.coalesce(F.lower(F.trim(text)).isin(HIDDEN, "<=20", "≤20", "1-20"), F.lit(False))


def parsed_count(text: Column) -> Column:
    """The count at the start of a displayed cell, separators taken out; null if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([0-9][0-9,]*)", 1), ",", "").try_cast("long")


def node(value: Column, display: Column, hidden: Column, why: Column) -> Column:
    """A value node: a number with its display text, or hidden with a reason."""
    return F.struct(F.when(~hidden, value.cast("double")).alias("value"), F.when(~hidden, display).alias("display"),
                    hidden.alias("suppressed"), F.when(hidden, why).alias("reason"))
