"""Dates as listings write them. The day that counts as today is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import found

#: How months begin, in the order in which they are tried.
MONTHS = [
    ("январ", 1), ("феврал", 2), ("март", 3), ("апрел", 4), ("май", 5), ("мая", 5), ("июн", 6), ("июл", 7), ("авг", 8),
    ("сен", 9), ("окт", 10), ("ноя", 11), ("дек", 12),
]
DATE = r"\b(?:сегодня|позавчера|вчера)\b|[0-9]{1,2}\s+[а-яё]{3,}(?:\s+[0-9]{4})?|(?<![0-9])[0-9]{1,2}[./\-][0-9]{1,2}[./\-][0-9]{2,4}(?![0-9])|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"


def _month(word: Column) -> Column:
    """By the first three letters, then the rest of how the month begins."""
    pairs = [(stem[:3], stem, n) for stem, n in MONTHS]
    stems = F.create_map(*(F.lit(x) for three, stem, _ in pairs for x in (three, stem)))
    numbers = F.create_map(*(F.lit(x) for three, _, n in pairs for x in (three, n)))
    three = F.substring(word, 1, 3)
    return F.when(word.startswith(F.try_element_at(stems, three)), F.try_element_at(numbers, three))


def _date(y: Column, m: Column, d: Column) -> Column:
    """Null where there is no such day."""
    return F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")


def parse_date(text: Column, today: Column) -> Column:
    """Today, yesterday and the day before; 5 авг 2024; август 5; 2024-08-05; 05.08.24."""
    t = F.lower(F.trim(text))
    n = lambda p, g: found(t, p, g).try_cast("int")
    day_first, month_first = r"([0-9]{1,2})\s+([а-яё]+)\s*([0-9]{4})?", r"([а-яё]{3,})\s+([0-9]{1,2})(?![0-9]),?\s*([0-9]{4})?"
    iso, dotted = r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", r"(?<![0-9])([0-9]{1,2})[./\-]([0-9]{1,2})[./\-]([0-9]{2,4})(?![0-9])"
    year = lambda p: F.coalesce(n(p, 3), F.year(today))
    named = _month(F.regexp_extract(t, day_first, 2))
    led = _month(F.regexp_extract(t, month_first, 1))
    short = F.length(found(t, dotted, 3)) == 2
    return (
        F.when(t.rlike(r"(?U)\bпозавчера\b"), F.date_sub(today, 2))
        .when(t.rlike(r"(?U)\bсегодня\b"), today)
        .when(t.rlike(r"(?U)\bвчера\b"), F.date_sub(today, 1))
        .when(named.isNotNull() & n(day_first, 1).between(1, 31), _date(year(day_first), named, n(day_first, 1)))
        .when(led.isNotNull() & n(month_first, 2).between(1, 31), _date(year(month_first), led, n(month_first, 2)))
        .when(t.rlike(iso), _date(n(iso, 1), n(iso, 2), n(iso, 3)))
        .when(t.rlike(dotted), _date(F.when(short, n(dotted, 3) + 2000).otherwise(n(dotted, 3)), n(dotted, 2), n(dotted, 1)))
    )


def extract_dates(text: Column, today: Column) -> Column:
    """Struct (published, updated). A date belongs to the label in the 14 characters before it or the 4 after, whatever other
    dates stand there too; of unlabelled ones the first is of publication and the next of the update."""
    low, date = F.lower(text), rf"(?U)(?:{DATE})"
    spans, between = F.regexp_extract_all(low, F.lit(date), 0), F.split(low, date, -1)
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))

    def labelled(span: Column, i: Column) -> Column:
        start = length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(spans, F.lit(1), i))
        near = F.substring(low, F.greatest(start - 13, F.lit(1)), F.least(start, F.lit(14)) + F.length(span) + 4)
        return F.struct(parse_date(span, today).alias("on"), F.when(near.contains("обнов"), "u").when(near.rlike("публик|размест|создан|добав"), "p").otherwise("").alias("label"))

    parts = F.transform(spans, labelled)
    dated = F.filter(parts, lambda p: p["on"].isNotNull())
    none = F.lit(None).cast("date")
    start = F.struct(none.alias("published"), none.alias("updated"))

    def step(acc: Column, p: Column) -> Column:
        first = (p["label"] == "p") | ((p["label"] == "") & acc["published"].isNull())
        return F.struct(
            F.when(first, F.coalesce(acc["published"], p["on"])).otherwise(acc["published"]).alias("published"),
            F.when(~first, F.coalesce(acc["updated"], p["on"])).otherwise(acc["updated"]).alias("updated"),
        )

    return F.aggregate(dated, start, step)


def provider_date(x: Column) -> Column:
    """An ISO text to the second, or seconds since 1970, as a timestamp; null otherwise."""
    number = x.rlike(r"^[0-9]{9,11}$")
    return F.when(number, F.timestamp_seconds(x.try_cast("bigint"))).otherwise(F.substring(x, 1, 19).try_cast("timestamp"))
