"""Dates and clocks, as Column expressions. Unparseable input gives NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# Zone names of RFC 822 with their offsets (fixed values).
_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def parse_iso(value: Column) -> Column:
    """ISO-8601 with a trailing ``Z`` or an offset; no zone means UTC."""
    text = F.trim(value)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def parse_day(value: Column) -> Column:
    """``YYYY-MM-DD`` at midnight UTC."""
    return F.when(
        value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(value, F.lit("yyyy-M-d"))
    )


def parse_epoch(value: Column) -> Column:
    """Whole seconds since 1970; anything else is NULL."""
    text = F.trim(value.cast("string"))
    seconds = F.when(text.rlike(r"^[+-]?\d{1,11}(\.0*)?$"), F.split_part(text, F.lit("."), F.lit(1)).cast("long"))
    return F.timestamp_seconds(F.when(F.abs(seconds) < 253402300800, seconds))


def parse_feed_date(value: Column) -> Column:
    """The date forms feeds use: RFC 822 and RFC 850 with or without weekday, the C
    library's form, ISO-8601, and days written with slashes or a month's name. No zone
    means UTC; two digits of a year from 69 on are of the last century."""
    text = F.regexp_replace(F.regexp_replace(F.trim(value), r"\s+", " "), r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? (?=[A-Za-z0-9])", "")
    zone = F.regexp_extract(text, r" ([A-Za-z]{1,5})$", 1)
    offset = F.create_map(*[F.lit(x) for kv in _ZONES.items() for x in kv])[F.upper(zone)]
    text = F.when(zone != "", F.concat(F.regexp_replace(text, r"[A-Za-z]{1,5}$", ""), offset)).otherwise(
        F.regexp_replace(text, r"([+-]\d{2}):(\d{2})$", "$1$2")
    )
    day = r"^(\d{1,2})[ -]([A-Za-z]{3})[ -]"
    text = F.regexp_replace(F.regexp_replace(text, day + r"(69|[7-9]\d)(?= |$)", "$1 $2 19$3"), day + r"([0-6]\d)(?= |$)", "$1 $2 20$3")
    text = F.regexp_replace(text, day + r"(\d{4})", "$1 $2 $3")

    def first_of(*formats: str) -> Column:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])

    return F.coalesce(
        parse_iso(value),
        F.when(text.rlike(r"^\d{1,2} "), first_of("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy")),
        F.when(text.rlike(r"^\d{4}/"), first_of("yyyy/M/d HH:mm:ss", "yyyy/M/d")),
        F.when(text.rlike("^[A-Za-z]{3} "), first_of("MMM d HH:mm:ss yyyy")),
        F.when(text.rlike("^[A-Za-z]{3,9} [0-9]{1,2},"), first_of("MMMM d, yyyy", "MMM d, yyyy")))


def make_run_id(started_at: Column, seed: Column) -> Column:
    """UTC second stamp and four hex digits drawn from a seed column."""
    stamp = F.date_format(started_at, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(stamp, F.lit("-"), F.substring(F.md5(seed.cast("string")), 1, 4))


def eastern(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, C.EASTERN)


def eastern_seconds(ts: Column) -> Column:
    """Whole seconds since Eastern midnight."""
    local = eastern(ts)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def is_late(ended_at: Column) -> Column:
    return eastern_seconds(ended_at) > C.DEADLINE_SECONDS


def window_is_open(now: Column) -> Column:
    return F.floor(eastern_seconds(now) / 60) >= C.WINDOW_OPEN_MINUTES


def permalink(day: Column) -> Column:
    return F.date_format(day, "/yyyy/MM/dd/")


def date_long(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")


def date_short(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def month_heading(day: Column) -> Column:
    return F.date_format(day, "MMMM yyyy")


def feed_date(day: Column) -> Column:
    return F.date_format(day, "EEE, dd MMM yyyy '10:00:00 GMT'")


def duration(seconds: Column) -> Column:
    return F.concat(
        F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")
    )


def read_time(points: Column) -> Column:
    """Twelve seconds a point, rounded half up to 15, at least 15."""
    seconds = F.greatest(F.lit(15), F.floor(points * 12 / 15 + 0.5) * 15)
    return F.concat(seconds.cast("string"), F.lit("-second read"))


def local_instant(day: Column, clock: Column, zone: Column) -> Column:
    """UTC instant of a wall-clock time on a local day.

    A time inside a skipped hour moves to the first instant after the gap, a
    time inside a repeated hour is its first occurrence.
    """
    wall = F.to_timestamp(F.concat(day.cast("string"), F.lit(" "), clock))
    instant = F.to_utc_timestamp(wall, zone)  # the first of a repeated pair
    shown = F.from_utc_timestamp(instant, zone)
    gap = F.unix_timestamp(shown) - F.unix_timestamp(wall)  # above zero in a skipped hour only
    first_valid = F.timestamp_seconds(F.unix_timestamp(shown) - F.unix_timestamp(shown) % gap)
    return F.when(gap > 0, F.to_utc_timestamp(first_valid, zone)).otherwise(instant)
