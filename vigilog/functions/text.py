"""Column helpers shared by the parsers and the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"  # cannot occur inside a line, so it safely separates captured fields


def lookup(table: dict, key: Column) -> Column:
    """Value of a small constant table, NULL when the key is absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def fields(c: Column, regex: str, groups: int) -> Column:
    """Capture all groups in one regex run: an array of ``groups`` strings, or of one if no match.

    The regex must match the whole line. A group that took no part gives ''. Lines of plain ASCII
    take the cheaper regex flags, which agree with the Unicode ones there.
    """
    template = NL.join(f"${i}" for i in range(1, groups + 1))
    replaced = F.when(is_ascii(c), F.regexp_replace(c, "(?d)" + regex, template)).otherwise(
        F.regexp_replace(c, "(?Ud)" + regex, template)
    )
    return F.split(replaced, NL, groups)


def not_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_cr(c: Column) -> Column:
    return F.rtrim(c, F.lit("\r"))


def iso_time(ts: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only when there are any."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == 0, F.concat(seconds, F.lit("+00:00"))).otherwise(
        F.concat(seconds, F.lit("."), F.lpad(micros.cast("string"), 6, "0"), F.lit("+00:00"))
    )


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def time_from_epoch(seconds: Column) -> Column:
    """Timestamp from seconds since 1970; NULL for 0, which stands for an unknown time."""
    micros = F.round(seconds * 1e6).cast("bigint")
    return F.when(seconds != 0, F.timestamp_micros(micros))


def utc_timestamp(year: Column, month: Column, day: Column, hh: Column, mm: Column, ss: Column):
    """NULL for a date or time that does not exist, a leap second included."""
    second = ss.try_cast("int")
    made = F.try_make_timestamp(
        year.try_cast("int"), month.try_cast("int"), day.try_cast("int"),
        hh.try_cast("int"), mm.try_cast("int"), second.cast("decimal(16,6)"),
    )
    return F.when(second < 60, made)


def no_fields() -> Column:
    return F.expr("CAST(map() AS map<string,string>)")


def present(always: dict, optional: dict) -> Column:
    """Map of the given values, without the optional ones that are NULL."""
    if not optional:
        pairs = [x for name, value in always.items() for x in (F.lit(name), value)]
        return F.create_map(*pairs) if pairs else no_fields()
    (name, value), *rest = optional.items()
    rest = dict(rest)
    return F.when(value.isNull(), present(always, rest)).otherwise(
        present({**always, name: value}, rest)
    )
