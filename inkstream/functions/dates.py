"""Date and time functions as Columns. `now` is always a parameter, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in order after ISO 8601 (fixed values).
FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd MMM yyyy HH:mm:ss", "dd MMM yyyy",
    "EEE, dd MMM yyyy HH:mm:ss Z", "EEE, dd MMM yyyy HH:mm:ss z", "dd/MM/yyyy", "yyyyMMdd'T'HHmmss", "yyyyMMdd", "yyyy-MM", "yyyy",
)
#: Words for times of day (fixed values).
TIME_WORDS = {"midnight": "00:00:00", "morning": "09:00:00", "noon": "12:00:00", "evening": "18:00:00", "all day": "00:00:00"}


#: A date as far as it is given; anything may follow it.
PARTIAL = r"^(\d{4})(?:[/-]?(\d\d)(?:[/-]?(\d\d))?)?(?:(?:T|\s+)(\d\d)(?::?(\d\d)(?::?(\d\d)(?:\.?\d+)?)?)?)?(Z|[-+]\d\d:?\d\d)?"


def register(pattern: str) -> None:
    """Adds a format that is tried before the others."""
    global FORMATS
    FORMATS = (pattern, *FORMATS)


def zone_parts(ts: Column, zone: str) -> dict[str, Column]:
    """Of a time in UTC: its ISO offset in a zone, the minutes of it, and whether summer time holds there then."""
    minutes = lambda t: ((F.unix_timestamp(F.from_utc_timestamp(t, zone)) - F.unix_timestamp(t)) / 60).cast("int")
    year = F.year(ts)
    usual = F.least(minutes(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))), minutes(F.make_timestamp(year, F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
    now = minutes(ts)
    iso = F.format_string("%s%02d:%02d", F.when(now < 0, "-").otherwise("+"), F.floor(F.abs(now) / 60), F.abs(now) % 60)
    return {"offset": iso, "minutes": now, "summer": now > usual}


def to_utc(c: Column, now: Column | None = None) -> Column:
    """ISO 8601 as a timestamp; no zone means UTC (the session's zone); null is now; null if it is no date."""
    return F.when(c.isNull(), F.current_timestamp() if now is None else now).otherwise(F.try_to_timestamp(c))


def parse(c: Column) -> Column:
    """The first reading of ISO 8601 or FORMATS that fits."""
    trimmed = F.trim(c)
    short = F.regexp_replace(trimmed, "^[A-Za-z]{3}, ", "")
    tried = [F.try_to_timestamp(trimmed, F.lit(f)) for f in FORMATS if not f.startswith("EEE")]
    tried += [F.try_to_timestamp(short, F.lit(f.removeprefix("EEE, "))) for f in FORMATS if f.startswith("EEE")]
    return F.coalesce(F.when(trimmed.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), F.try_to_timestamp(trimmed)), F.when(trimmed.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(trimmed)), *tried)


#: Marks of Korean dates, months and days as Greek and Hungarian feeds write them, zones beside the usual ones.
KOREAN = {"year": "년", "month": "월", "day": "일", "am": "오전", "pm": "오후"}
GREEK_MONTHS = {
    "Ιαν": 1, "Φεβ": 2, "Μάώ": 3, "Μαώ": 3, "Απρ": 4, "Μάι": 5, "Μαϊ": 5, "Μαι": 5, "Ιούν": 6, "Ιον": 6, "Ιούλ": 7, "Ιολ": 7, "Αύγ": 8, "Αυγ": 8, "Σεπ": 9, "Οκτ": 10, "Νοέ": 11, "Νοε": 11, "Δεκ": 12,
}
GREEK_DAYS = ("Κυρ", "Δευ", "Τρι", "Τετ", "Πεμ", "Παρ", "Σαβ")
HUNGARIAN_MONTHS = {"január": 1, "februári": 2, "március": 3, "április": 4, "május": 5, "június": 6, "július": 7, "augusztus": 8, "szeptember": 9, "október": 10, "november": 11, "december": 12}
ZONES = {
    "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00", "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "AT": "-04:00", "ET": "-05:00", "CT": "-06:00", "MT": "-07:00", "PT": "-08:00",
}


def _table(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _moment(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: Column) -> Column:
    """A time from its parts; hours beyond the day go into the next, a zone is Z, a name or an offset; null for parts that are
    no date."""
    offset = F.when(zone.rlike(r"^[-+]\d\d?:?\d\d$"), zone).otherwise(F.try_element_at(_table(ZONES), F.upper(zone)))
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    away = sign * (F.regexp_extract(offset, r"^[-+](\d\d?):?\d\d$", 1).cast("int") * 60 + F.regexp_extract(offset, r"(\d\d)$", 1).cast("int"))
    number = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    date = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))
    after = (F.coalesce(number(hour), F.lit(0)) * 60 + F.coalesce(number(minute), F.lit(0)) - away) * 60 + F.coalesce(number(second), F.lit(0))
    return F.timestamp_seconds(F.unix_timestamp(date) + after)


def parse_feed(c: Column) -> Column:
    """A date as feeds write it: by the rules for mail, W3DTF (also days of the year), Hungarian and Greek dates, those of
    databases and of two Korean services (all three at +09:00), then ISO 8601 and what `parse` knows. Null if none fits."""
    c = F.trim(c)

    def matched(pattern: str, make) -> Column:
        return F.when(c.rlike(pattern), make(lambda n: F.regexp_extract(c, pattern, n)))

    seoul, zero = F.lit("+09:00"), F.lit("0")
    months = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
    century = lambda y: F.when(F.length(y) == 4, y).otherwise(F.concat(F.when(y.try_cast("int") < 69, "20").otherwise("19"), y))
    mail = r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*[\s-]+(\d{4}|\d\d)(?:\s+(\d{1,2}):(\d\d)(?::(\d\d))?)?\s*([-+]\d{4}|[a-z]+)?$"
    w3 = r"^(\d{4})-?(\d\d)-?(\d\d)T(\d\d):?(\d\d)(?::?(\d\d)(?:[.,]\d+)?)?(Z|[-+]\d\d:?\d\d)$"
    hungarian = r"^(\d{4})-([^-]+)-(\d{1,2})T(\d{1,2}):(\d\d)([-+]\d{1,2}:\d\d)"
    greek = r"^([^,]+),\s+(\d\d)\s+(\S+)\s+(\d{4})\s+(\d\d):(\d\d):(\d\d)\s+(\S+)"
    nate = rf"^(\d{{4}})-(\d\d)-(\d\d)\s+({KOREAN['am']}|{KOREAN['pm']})\s+(\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}})"
    onblog = rf"^(\d{{4}}){KOREAN['year']}\s+(\d\d){KOREAN['month']}\s+(\d\d){KOREAN['day']}\s+(\d\d):(\d\d):(\d\d)"
    return F.coalesce(
        matched(mail, lambda g: _moment(century(g(3)), F.try_element_at(_table(months), F.lower(g(2))), g(1), g(4), g(5), g(6), F.coalesce(F.nullif(g(7), F.lit("")), F.lit("Z")))),
        matched(w3, lambda g: _moment(g(1), g(2), g(3), g(4), g(5), g(6), g(7))),
        F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{3}$"), c), F.lit("yyyy-DDD")),
        F.try_to_timestamp(F.when(c.rlike(r"^\d{7}$"), c), F.lit("yyyyDDD")),
        matched(hungarian, lambda g: _moment(g(1), F.try_element_at(_table(HUNGARIAN_MONTHS), g(2)), g(3), g(4), g(5), zero, g(6))),
        F.when(F.regexp_extract(c, greek, 1).isin(*GREEK_DAYS), matched(greek, lambda g: _moment(g(4), F.try_element_at(_table(GREEK_MONTHS), g(3)), g(2), g(5), g(6), g(7), g(8)))),
        matched(r"^(\d{4})-(\d\d)-(\d\d)\s+(\d\d):(\d\d):(\d\d)", lambda g: _moment(g(1), g(2), g(3), g(4), g(5), g(6), seoul)),
        matched(nate, lambda g: _moment(g(1), g(2), g(3), (g(5).try_cast("int") + F.when(g(4) == KOREAN["pm"], 12).otherwise(0)).cast("string"), g(6), g(7), seoul)),
        matched(onblog, lambda g: _moment(g(1), g(2), g(3), g(4), g(5), g(6), seoul)),
        parse(c),
    )


def normalize(c: Column) -> Column:
    """A date or time as far as it is given: year, month, day, hour, minute and second, with zone; fractions go, zero
    offset is Z; what follows is passed over; empty if the text opens with no date."""
    part = lambda n: F.regexp_extract(c, PARTIAL, n)
    shown = lambda mark, n: F.when(part(n) != "", F.concat(F.lit(mark), part(n))).otherwise("")
    zone = F.when(part(7).rlike("^[-+]00:?00$"), "Z").otherwise(F.regexp_replace(part(7), r"([-+]\d\d)(\d\d)", "$1:$2"))
    whole = F.concat(part(1), shown("-", 2), shown("-", 3), shown("T", 4), shown(":", 5), shown(":", 6), zone)
    return F.when(F.coalesce(c, F.lit("")).rlike(PARTIAL), whole).otherwise("")


def parts(ts: Column) -> dict[str, Column]:
    """Named parts of a timestamp, as text and (n_) as numbers."""
    formats = {"year": "yyyy", "month": "MM", "month_name": "MMMM", "month_abbr": "MMM", "weekday": "EEEE", "weekday_abbr": "EEE", "day": "dd", "hour24": "HH", "hour12": "hh", "ampm": "a", "minute": "mm", "second": "ss", "tz": "XXX"}
    out = {k: F.date_format(ts, f) for k, f in formats.items()}
    return out | {f"n_{k}": fn(ts) for k, fn in {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}.items()}


def add_months(ts: Column, n: Column) -> Column:
    """Some months later; a day the month lacks becomes the 30th, or the 28th in February; the time of day stays."""
    target = F.add_months(F.trunc(ts, "month"), n)
    last = F.dayofmonth(F.last_day(target))
    day = F.when(F.dayofmonth(ts) <= last, F.dayofmonth(ts)).when(last >= 30, F.lit(30)).otherwise(F.lit(28))
    return F.to_timestamp(F.concat_ws(" ", F.date_format(F.date_add(target, day - 1), "yyyy-MM-dd"), F.date_format(ts, "HH:mm:ss")))


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def rfc822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")


def age_in_days(ts: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86_400)


def age_in_minutes(ts: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 60)


def time_of_day(c: Column) -> Column:
    """HH:MM:SS of a time or a word for one; null if it is neither."""
    word = F.lower(F.trim(c))
    out = F.when(word.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"), F.date_format(F.to_timestamp(F.concat(F.lit("2000-01-01 "), F.regexp_replace(F.regexp_replace(word, r"^(\d):", "0$1:"), r"^(\d\d:\d\d)$", "$1:00"))), "HH:mm:ss"))
    for name, time in TIME_WORDS.items():
        out = out.when(word == name, time)
    return out


def duration(start: Column, stop: Column) -> Column:
    """HH:MM:SS between two times; hours go beyond 24."""
    s = F.unix_timestamp(stop) - F.unix_timestamp(start)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def next_refresh(now: Column, minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now) + minutes * 60)


def zones(spark, at: str = "2024-01-01"):
    """(zone, offset_minutes): the system's time zones from west to east, by their offset at a time."""
    from datetime import datetime
    from zoneinfo import ZoneInfo, available_timezones

    when = datetime.fromisoformat(at)
    rows = [(z, int(ZoneInfo(z).utcoffset(when).total_seconds() // 60)) for z in sorted(available_timezones()) if "/" in z]
    return spark.createDataFrame(rows, "zone string, offset_minutes int").orderBy("offset_minutes", "zone")
