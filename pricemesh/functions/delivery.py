"""Delivery promises: text to days, days to a date and a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.functions.text import lookup

_MONTH = "(" + "|".join(vocab.MONTHS) + ")"
_MONTH_NUMBER = {m: str(i + 1) for i, m in enumerate(vocab.MONTHS)}


def _date(year: Column, month: Column, day: Column) -> Column:
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    # What is no date costs an exception inside, so nothing is parsed where a part is missing.
    written = F.concat_ws("-", year.cast("string"), pad(month), pad(day))
    return F.when(month.isNotNull() & day.isNotNull(), F.try_to_date(written, "yyyy-MM-dd"))


def with_delivery_days(df: DataFrame, text: str, as_of: Column, out: str = "delivery_days") -> DataFrame:
    """Add the days a delivery text promises, 99 where it promises none.

    ``as_of`` is the local date on which the text was read.
    """
    c = F.col
    # An empty text costs an exception in the cast.
    number = lambda p, g: F.nullif(F.regexp_extract(c("_t"), p, g), F.lit("")).try_cast("int")
    soon = r"\b\d+\s*(min|mins|minutes|hr|hrs|hour|hours)\b"
    in_days = r"(\d+)\s*(?:-|to)?\s*(\d+)?\s*(?:business\s+|working\s+)?days?"
    day_first, month_first = r"\b(\d{1,2})\s*" + _MONTH, r"\b" + _MONTH + r"[a-z]*\s*(\d{1,2})\b"

    staged = (
        # Blanks of any kind, the no-break ones included, count as blanks in all patterns below.
        df.withColumn("_t", F.lower(F.trim(F.regexp_replace(F.coalesce(c(text), F.lit("")), r"(?U)\s", " "))))
        .withColumn(
            "_plain",
            F.coalesce(
                F.when(c("_t") == "", vocab.UNKNOWN_DELIVERY_DAYS),
                F.when(c("_t").rlike(soon) | c("_t").contains("today") | c("_t").contains("same day"), 0),
                F.when(c("_t").contains("tomorrow") | c("_t").contains("next day"), 1),
                F.when(c("_t").rlike(in_days), F.coalesce(number(in_days, 2), number(in_days, 1))),
            ),
        )
        # Dates are only looked for where nothing plainer is said.
        .withColumn("_df", F.when(c("_plain").isNull(), c("_t").rlike(day_first)))
        .withColumn("_day", F.when(c("_df"), number(day_first, 1)).when(~c("_df"), number(month_first, 2)))
        .withColumn(
            "_month",
            lookup(
                F.when(c("_df"), F.regexp_extract(c("_t"), day_first, 2)).when(
                    c("_day").isNotNull(), F.regexp_extract(c("_t"), month_first, 1)
                ),
                _MONTH_NUMBER,
            ).cast("int"),
        )
        .withColumn("_date", _date(F.year(as_of), c("_month"), c("_day")))
    )
    # A day that is past this year means next year's; 29 February may not exist then.
    target = F.when(c("_date") >= as_of, c("_date")).otherwise(
        F.when(c("_date").isNotNull(), _date(F.year(as_of) + 1, c("_month"), c("_day")))
    )
    named = F.regexp_extract_all(c("_t"), F.lit(r"\b(" + "|".join(vocab.WEEKDAYS) + ")"), F.lit(1))
    weekday = F.array_min(F.transform(named, lambda d: F.array_position(F.lit(list(vocab.WEEKDAYS)), d).cast("int") - 1))
    staged = staged.withColumn("_told", F.coalesce("_plain", F.datediff(target, as_of)))
    staged = staged.withColumn("_ahead", F.when(c("_told").isNull(), F.pmod(weekday - F.weekday(as_of), F.lit(7))))
    days = F.coalesce("_told", F.when(c("_ahead") == 0, 7).otherwise(c("_ahead")), F.lit(vocab.UNKNOWN_DELIVERY_DAYS))
    return staged.withColumn(out, days).drop("_t", "_plain", "_df", "_day", "_month", "_date", "_told", "_ahead")


def delivery_note(text: Column) -> Column:
    """The store's own words, or a pointer to the store."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.nullif(raw, F.lit("")), F.lit(vocab.UNKNOWN_DELIVERY_TEXT))


def delivery_date(days: Column, as_of: Column) -> Column:
    return F.date_add(as_of, days.cast("int"))


def delivery_text(days: Column, available: Column, as_of: Column, own_text: Column | None = None) -> Column:
    shown = (
        F.when(~available, "Currently unavailable")
        .when(days <= 0, "Today")
        .when(days == 1, "Tomorrow")
        .when(days <= 3, F.concat(F.lit("In "), days.cast("string"), F.lit(" days")))
        .otherwise(F.concat(F.lit("By "), F.date_format(delivery_date(days, as_of), "E, dd MMM")))
    )
    return shown if own_text is None else F.coalesce(F.nullif(own_text, F.lit("")), shown)
