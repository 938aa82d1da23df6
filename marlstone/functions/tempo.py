"""Dates, times, zones, durations and periods as expressions.

Times of day and durations are nanoseconds: a bigint of the day, a decimal(38,0) of a duration.
Timestamps have microseconds; a parsed fraction beyond them is kept in the time of day only.
What cannot be parsed is null. An offset value is struct<local timestamp_ntz, offset_s int>.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds of each unit, and the resolutions of local times that a zone skips or repeats.
UNITS = {"nanoseconds": 1, "microseconds": 1_000, "milliseconds": 1_000_000, "seconds": 1_000_000_000, "minutes": 60_000_000_000, "hours": 3_600_000_000_000, "days": 86_400_000_000_000}
DAY = UNITS["days"]
SKIPPED = ("next_valid", "previous_valid", "boundary_start", "boundary_end", "boundary_nearest", "reject")
AMBIGUOUS = ("earliest", "latest", "reject")
LONG = "decimal(38,0)"

_DATE = r"(\d{4})-(\d{2})-(\d{2})"
_TIME = r"(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?"
_OFFSET = r"(Z|z|[+\-]\d{2}:\d{2})"


# -- dates ------------------------------------------------------------------------------------


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i).try_cast("int")


def make_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is none."""
    fine = month.between(1, 12) & (day >= 1) & year.between(1, 9999)
    first = F.make_date(F.when(fine, year), F.when(fine, month), F.lit(1))
    return F.when(fine & (day <= F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def ordinal_date(year: Column, day: Column) -> Column:
    return F.when(year.between(1, 9999) & day.between(1, days_in_year(year)), F.date_add(F.make_date(F.when(year.between(1, 9999), year), F.lit(1), F.lit(1)), day - 1))


def parse_date(text: Column) -> Column:
    """Strict YYYY-MM-DD."""
    p = rf"^{_DATE}\z"
    return make_date(_part(text, p, 1), _part(text, p, 2), _part(text, p, 3))


def with_fields(date: Column, year: Column | None = None, month: Column | None = None, day: Column | None = None) -> Column:
    """The date with other fields, or null if that is none."""
    pick = lambda new, own: own if new is None else new
    return make_date(pick(year, F.year(date)), pick(month, F.month(date)), pick(day, F.dayofmonth(date)))


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def days_in_year(year: Column) -> Column:
    return F.when(is_leap_year(year), 366).otherwise(365)


def days_in_month(year: Column, month: Column) -> Column:
    """Days of a month; null for a month that is none."""
    return F.when(month == 2, F.when(is_leap_year(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31)


def components(date: Column) -> Column:
    """struct of a date's calendar fields; weeks by ISO 8601."""
    weekday = F.weekday(date) + 1
    return F.struct(
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day"),
        F.quarter(date).alias("quarter"),
        F.dayofyear(date).alias("day_of_year"),
        weekday.alias("day_of_week"),
        F.dayofweek(date).alias("day_of_week_sunday"),
        F.weekofyear(date).alias("week_of_year"),
        F.extract(F.lit("yearofweek"), date).alias("year_of_week"),
        (F.floor((F.dayofmonth(date) + weekday_of_first(date) - 2) / 7) + 1).cast("int").alias("week_of_month"),
        (F.floor((F.dayofmonth(date) - 1) / 7) + 1).cast("int").alias("day_of_week_in_month"),
        F.unix_date(date.cast("date")).alias("days_since_epoch"),
    )


def weekday_of_first(date: Column) -> Column:
    """Weekday (1 Monday) of the first of the date's month."""
    return F.weekday(F.trunc(date, "month")) + 1


def from_days(days: Column) -> Column:
    return F.date_from_unix_date(days)


def format_date(date: Column) -> Column:
    """YYYY-MM-DD; years beyond 9999 with all their digits and, as in SQL, without the sign that Spark puts before them."""
    return F.regexp_replace(date.cast("string"), r"^\+", "")


def range_of(field: str, date: Column) -> Column:
    """struct<low, high> of the values a field can have at a date."""
    high = {"month": F.lit(12), "day": F.dayofmonth(F.last_day(date)), "day_of_year": days_in_year(F.year(date)), "day_of_week": F.lit(7), "hour": F.lit(23), "minute": F.lit(59), "second": F.lit(59), "nanosecond": F.lit(999_999_999), "week_of_year": F.weekofyear(F.make_date(F.year(date), F.lit(12), F.lit(28)))}[field]
    return F.struct(F.lit(0 if field in ("hour", "minute", "second", "nanosecond") else 1).alias("low"), high.alias("high"))


def add_calendar(ts: Column, years: int = 0, months: int = 0, weeks: int = 0, days: int = 0) -> Column:
    """Calendar addition: months first, the day cut to the month's end; then weeks and days, which roll over."""
    return ts + F.make_ym_interval(F.lit(years), F.lit(months)) + F.make_dt_interval(F.lit(7 * weeks + days))


# -- times of day -----------------------------------------------------------------------------


def _nanos(text: Column, pattern: str, first: int) -> Column:
    h, m, s = (_part(text, pattern, first + i).cast("bigint") for i in range(3))
    fraction = F.rpad(F.coalesce(F.regexp_extract(text, pattern, first + 3), F.lit("")), 9, "0").try_cast("bigint")
    fine = h.between(0, 23) & m.between(0, 59) & (s.between(0, 59) | (h == 23) & (m == 59) & (s == 60))
    return F.when(fine, (h * 3600 + m * 60 + s) * 1_000_000_000 + fraction)


def parse_time(text: Column) -> Column:
    """Nanoseconds of the day of HH:MM:SS[.f]; 23:59:60 rolls over to midnight."""
    return _nanos(text, rf"^{_TIME}\z", 1) % DAY


def format_time(nanos: Column) -> Column:
    """HH:MM:SS with the fraction that is there."""
    s = F.floor(nanos / 1_000_000_000).cast("bigint")
    fraction = F.rtrim(F.lpad((nanos % 1_000_000_000).cast("string"), 9, "0"), F.lit("0"))
    return F.concat(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60), F.when(nanos % 1_000_000_000 != 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")))


def parse_datetime(text: Column) -> Column:
    """timestamp_ntz of YYYY-MM-DDTHH:MM:SS[.f]; a leap second goes to the next day."""
    p = rf"^{_DATE}[Tt]{_TIME}\z"
    return _local(make_date(_part(text, p, 1), _part(text, p, 2), _part(text, p, 3)), _nanos(text, p, 4))


def _local(date: Column, nanos: Column) -> Column:
    micros = F.floor(nanos / 1_000).cast("bigint")
    return date.cast("timestamp_ntz") + F.make_dt_interval(secs=(micros.cast("decimal(18,6)") / 1_000_000).cast("decimal(18,6)"))


def parse_offset(text: Column) -> Column:
    """Seconds of Z or ±HH[:MM[:SS]], at most 18 hours."""
    p = r"^([+\-])(\d{2})(?::?(\d{2})(?::?(\d{2}))?)?\z"
    h, m, s = (F.coalesce(_part(text, p, i), F.lit(0)) for i in (2, 3, 4))
    total = h * 3600 + m * 60 + s
    return F.when(text.isin("Z", "z"), F.lit(0)).when(text.rlike(p) & (m < 60) & (s < 60) & (total <= 64_800), F.when(text.startswith("-"), -total).otherwise(total))


def format_offset(seconds: Column, style: str = "default") -> Column:
    """An offset's text: `complete` ±HH:MM:SS, `default` without zero seconds and Z for none, `minimal` without zero minutes."""
    a = F.abs(seconds)
    h, m, s = F.floor(a / 3600), F.floor(a % 3600 / 60), a % 60
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit("+"))
    whole = F.concat(sign, F.format_string("%02d:%02d:%02d", h, m, s))
    if style == "complete":
        return whole
    short = F.when(s != 0, whole).when((m != 0) if style == "minimal" else F.lit(True), F.substring(whole, 1, 6)).otherwise(F.substring(whole, 1, 3))
    return F.when(seconds == 0, F.lit("Z")).otherwise(short)


def parse_offset_time(text: Column) -> Column:
    """struct<nanos, offset_s>; a leap second only where it is 23:59:60 in UTC, and it becomes midnight there."""
    p = f"^(\\d{{2}}):(\\d{{2}}):(\\d{{2}})(?:\\.(\\d{{1,9}}))?{_OFFSET}\\z"
    h, m, s = (_part(text, p, i).cast("bigint") for i in (1, 2, 3))
    fraction = F.rpad(F.regexp_extract(text, p, 4), 9, "0").try_cast("bigint")
    offset = parse_offset(F.regexp_extract(text, p, 5))
    leap = (s == 60) & (F.pmod(h * 60 + m - F.floor(offset / 60), F.lit(1440)) == 1439)
    fine = h.between(0, 23) & m.between(0, 59) & (s.between(0, 59) | leap) & offset.isNotNull()
    nanos = F.pmod((h * 3600 + m * 60 + s) * 1_000_000_000 + fraction, F.lit(DAY))
    return F.when(fine, F.struct(nanos.alias("nanos"), offset.alias("offset_s")))


def parse_offset_datetime(text: Column) -> Column:
    """struct<local, offset_s> of an RFC 3339 date-time."""
    p = rf"^{_DATE}[Tt ]((?s:.*))\z"
    date = make_date(_part(text, p, 1), _part(text, p, 2), _part(text, p, 3))
    time = parse_offset_time(F.regexp_extract(text, p, 4))
    leap = F.regexp_extract(text, p, 4).rlike(r"^\d{2}:\d{2}:60")
    # A leap second ends in the next local minute, which may be the next day.
    roll = F.when(leap & (time["nanos"] < UNITS["minutes"]), 1).otherwise(0)
    return F.when(date.isNotNull() & time.isNotNull(), F.struct(_local(F.date_add(date, roll), time["nanos"]).alias("local"), time["offset_s"].alias("offset_s")))


def instant_of(value: Column) -> Column:
    """Instant of a struct<local, offset_s>, as timestamp_ntz in UTC; values compare by it."""
    return value["local"] - F.make_dt_interval(secs=value["offset_s"])


def at_offset(value: Column, offset_s: Column, anchor: str = "same_instant") -> Column:
    """The value at another offset: of the same instant, or of the same local time."""
    local = value["local"] if anchor == "same_local_time" else instant_of(value) + F.make_dt_interval(secs=offset_s)
    return F.struct(local.alias("local"), offset_s.alias("offset_s"))


# -- zones ------------------------------------------------------------------------------------


def to_zone(utc: Column, zone: Column | str) -> Column:
    """Local timestamp_ntz in a zone of a timestamp_ntz in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, utc)


def zone_offset(utc: Column, zone: Column | str) -> Column:
    """Seconds that a zone's local time is ahead of UTC at an instant."""
    return _seconds_between(utc, to_zone(utc, zone))


def _seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b).cast("int")


def valid_offsets(local: Column, zone: Column | str) -> Column:
    """Offsets at which a local time occurs in a zone: none in a gap, two in an overlap, larger (earlier instant) first.

    The offsets a day before and a day after are tried; a zone changes at most once in between.
    """
    before, after = (zone_offset(local + F.make_dt_interval(F.lit(d)), zone) for d in (-1, 1))
    tried = F.array_distinct(F.array(F.greatest(before, after), F.least(before, after)))
    return F.filter(tried, lambda o: to_zone(local - F.make_dt_interval(secs=o), zone) == local)


def resolve(local: Column, zone: Column | str, skipped: str = "next_valid", ambiguous: str = "earliest") -> Column:
    """UTC timestamp_ntz of a local time in a zone.

    A skipped time moves on by the gap (next_valid), back by it (previous_valid), to the last
    instant before the gap or the first after it (boundary_start, boundary_end), or that of the two
    whose local time is nearer (boundary_nearest; the end from the middle on), or is null (reject).
    A repeated time is the earlier or the later instant, or null.
    """
    if skipped not in SKIPPED or ambiguous not in AMBIGUOUS:
        raise ValueError("unknown resolution")
    if (skipped, ambiguous) == ("next_valid", "earliest"):  # what the engine itself does
        return F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), local)
    offsets = valid_offsets(local, zone)
    before, after = (zone_offset(local + F.make_dt_interval(F.lit(d)), zone) for d in (-1, 1))
    at = lambda o: local - F.make_dt_interval(secs=o)
    # In a gap the offset grows from before to after at the instant of the change.
    gap = {"next_valid": at(before), "previous_valid": at(after), "reject": F.lit(None).cast("timestamp_ntz")}
    if skipped.startswith("boundary"):
        change = _change_in_gap(local, zone, before, after)
        last = change - F.make_dt_interval(secs=F.lit(0.000001).cast("decimal(18,6)"))
        # The gap's edges as local times: the change as read before it and as read after it.
        low, high = change + F.make_dt_interval(secs=before), change + F.make_dt_interval(secs=after)
        nearer_end = F.timestamp_diff("MICROSECOND", low, local) >= F.timestamp_diff("MICROSECOND", local, high)
        gap |= {"boundary_end": change, "boundary_start": last, "boundary_nearest": F.when(nearer_end, change).otherwise(last)}
    twice = {"earliest": at(F.element_at(offsets, 1)), "latest": at(F.element_at(offsets, -1)), "reject": F.lit(None).cast("timestamp_ntz")}[ambiguous]
    return F.when(local.isNull(), F.lit(None).cast("timestamp_ntz")).when(F.size(offsets) == 0, gap[skipped]).when(F.size(offsets) > 1, twice).otherwise(at(F.try_element_at(offsets, F.lit(1))))


def _change_in_gap(local: Column, zone: Column | str, before: Column, after: Column) -> Column:
    """Instant of a change between the two readings of a skipped time, by bisection to the second."""
    low = local - F.make_dt_interval(secs=after)
    high = local - F.make_dt_interval(secs=before)
    start = F.struct(F.lit(0).cast("int").alias("low"), _seconds_between(low, high).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        early = zone_offset(low + F.make_dt_interval(secs=mid), zone) < after
        return F.struct(F.when(early, mid + 1).otherwise(acc["low"]).cast("int").alias("low"), F.when(early, acc["high"]).otherwise(mid).cast("int").alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(18)), start, step)
    return low + F.make_dt_interval(secs=found["high"])


def parse_zoned_datetime(text: Column) -> Column:
    """struct<local, offset_s, zone> of `date-time[offset][Area/City]`; the zone is required."""
    p = r"^([^\[]*)\[([^\]]+)\]\z"
    head, zone = F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)
    with_offset = parse_offset_datetime(head)
    plain = parse_datetime(head)
    known = F.when(text.rlike(p) & (with_offset.isNotNull() | plain.isNotNull()), zone)
    utc = F.when(with_offset.isNotNull(), instant_of(with_offset)).otherwise(resolve(plain, F.coalesce(known, F.lit("UTC"))))
    local = to_zone(utc, F.coalesce(known, F.lit("UTC")))
    return F.when(known.isNotNull(), F.struct(local.alias("local"), _seconds_between(utc, local).alias("offset_s"), known.alias("zone")))


def _zone_detail(utc: datetime, zone: str) -> dict | None:
    """What a zone says of an instant: name, standard and saving offsets, and the changes around it."""
    try:
        z = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return None
    at = utc.replace(tzinfo=timezone.utc)

    def state(t: datetime) -> tuple:
        x = t.astimezone(z)
        return x.utcoffset(), x.dst(), x.tzname()

    def change(step: timedelta) -> datetime | None:
        here, a = state(at), at
        for _ in range(400):  # about three years of steps of three days
            try:
                b = a + step
                other = state(b) != here
            except OverflowError:
                return None
            if other:
                low, high = (a, b) if step > timedelta() else (b, a)
                first = state(low)
                while high - low > timedelta(seconds=1):
                    mid = low + (high - low) // 2
                    mid = mid.replace(microsecond=0)
                    if state(mid) == first:
                        low = mid if mid > low else low + timedelta(seconds=1)
                    else:
                        high = mid
                return high.replace(microsecond=0)
            a = b
        return None

    offset, saving, name = state(at)
    naive = lambda t: None if t is None else t.replace(tzinfo=None)
    saving = saving or timedelta()
    return {"designation": name, "offset_s": int(offset.total_seconds()), "standard_offset_s": int((offset - saving).total_seconds()), "saving_s": int(saving.total_seconds()), "is_saving": bool(saving), "prior_transition": naive(change(timedelta(days=-3))), "next_transition": naive(change(timedelta(days=3)))}


ZONE_DETAIL = "designation string, offset_s int, standard_offset_s int, saving_s int, is_saving boolean, prior_transition timestamp_ntz, next_transition timestamp_ntz"


def zone_detail(utc: Column, zone: Column | str) -> Column:
    """struct of designation, standard and saving offsets, and the changes before and after an instant within three years."""

    @F.pandas_udf(ZONE_DETAIL)
    def run(ts: pd.Series, zones: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for t, z in zip(ts, zones, strict=True):
            key = None if pd.isna(t) or z is None else (t.floor("h"), z)
            if key is not None and key not in known:
                known[key] = _zone_detail(t.to_pydatetime().replace(microsecond=0), z)
            rows.append(known.get(key) or dict.fromkeys(c.split()[0] for c in ZONE_DETAIL.split(", ")))
        return pd.DataFrame(rows)

    return run(utc, F.lit(zone) if isinstance(zone, str) else zone)


# -- clocks -----------------------------------------------------------------------------------


class Clock:
    """Where `now` comes from: the engine's clock, which stands still within a query, or a fixed instant.

    snapshot() reads the clock once, on the driver, and gives one that stays there, for several
    queries that must agree.
    """

    def __init__(self, at: datetime | None = None):
        self.at = at

    def now(self) -> Column:
        """timestamp_ntz in UTC."""
        if self.at is None:
            return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
        return F.lit(self.at.isoformat(sep=" ")).cast("timestamp_ntz")

    def local(self, zone: Column | str) -> Column:
        return to_zone(self.now(), zone)

    def snapshot(self) -> Clock:
        return self if self.at is not None else Clock(datetime.now(timezone.utc).replace(tzinfo=None))


# -- instants ---------------------------------------------------------------------------------


def plus(ts: Column, nanos: Column) -> Column:
    """An instant later by a duration (earlier by a negative one); what is below a microsecond is cut."""
    return F.timestamp_add("MICROSECOND", truncated_micros(nanos), ts)


def minus(ts: Column, nanos: Column) -> Column:
    return plus(ts, -nanos.cast(LONG))


def truncated_micros(nanos: Column) -> Column:
    """Whole microseconds of a duration, towards zero."""
    return total(nanos, "microseconds")


def elapsed(since: Column, ts: Column) -> Column:
    """Nanoseconds from one instant to another; negative if the other is earlier."""
    return (_micros(ts) - _micros(since)).cast(LONG) * F.lit(1_000).cast(LONG)


def since_epoch(value: Column) -> Column:
    """Nanoseconds since 1970 of an offset value's instant."""
    return elapsed(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), instant_of(value))


# -- durations --------------------------------------------------------------------------------


def duration(**units: Column | int) -> Column:
    """Nanoseconds of a sum of units: days=1, hours=..., nanoseconds=..."""
    out = F.lit(0).cast(LONG)
    for name, n in units.items():
        n = F.lit(n) if isinstance(n, (int, float)) else n
        out = out + (n.cast("decimal(28,9)") * F.lit(UNITS[name])).cast(LONG)
    return out.cast(LONG)


def _unit(unit: str) -> Column:
    return F.lit(UNITS[unit]).cast(LONG)


def duration_sum(a: Column, b: Column) -> Column:
    return (a.cast(LONG) + b.cast(LONG)).cast(LONG)


def duration_difference(a: Column, b: Column) -> Column:
    return (a.cast(LONG) - b.cast(LONG)).cast(LONG)


def scaled_by(nanos: Column, factor: Column | int) -> Column:
    """A duration times a whole number."""
    return (nanos.cast(LONG) * (F.lit(factor) if isinstance(factor, int) else factor).cast("decimal(19,0)")).cast(LONG)


def split_by(nanos: Column, divisor: Column | int) -> Column:
    """A duration over a whole number, towards zero; null for 0."""
    d = F.nullif((F.lit(divisor) if isinstance(divisor, int) else divisor).cast(LONG), F.lit(0).cast(LONG))
    return ((nanos.cast(LONG) - nanos.cast(LONG) % d) / d).cast(LONG)


def ratio(a: Column, b: Column) -> Column:
    """How many times one duration goes into another, towards zero; null for none."""
    return split_by(a, b)


def left_over(a: Column, b: Column) -> Column:
    """What is left of a duration after the whole multiples of another; null for none."""
    return (a.cast(LONG) % F.nullif(b.cast(LONG), F.lit(0).cast(LONG))).cast(LONG)


def truncated(nanos: Column, unit: str) -> Column:
    """Towards zero to whole units."""
    return (nanos.cast(LONG) - nanos.cast(LONG) % _unit(unit)).cast(LONG)


def remainder(nanos: Column, unit: str) -> Column:
    return (nanos.cast(LONG) % _unit(unit)).cast(LONG)


def divided_at(nanos: Column, unit: str) -> Column:
    return F.struct(total(nanos, unit).alias("quotient"), remainder(nanos, unit).alias("remainder"))


def total(nanos: Column, unit: str) -> Column:
    """Whole units of a duration, towards zero."""
    return (truncated(nanos, unit) / _unit(unit)).cast("bigint")


def component(nanos: Column, unit: str, of: str) -> Column:
    """Whole units within the next larger given unit, as minutes of the hour."""
    return total(remainder(nanos, of), unit)


def between(a: Column, b: Column) -> Column:
    """Nanoseconds from the earlier of two timestamps to the later."""
    return F.abs(_micros(b) - _micros(a)).cast(LONG) * F.lit(1_000).cast(LONG)


def _micros(ts: Column) -> Column:
    """Microseconds of a timestamp of either kind since 1970, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def describe(nanos: Column) -> Column:
    """`1 minute, 40 seconds`: the units that are not zero, `0 seconds` for none."""
    n, parts, rest = F.abs(nanos.cast(LONG)), [], F.abs(nanos.cast(LONG))
    for unit in ("days", "hours", "minutes", "seconds", "milliseconds", "microseconds", "nanoseconds"):
        k = total(rest, unit)
        parts.append(F.when(k != 0, F.concat(k.cast("string"), F.lit(" "), F.when(k == 1, F.lit(unit[:-1])).otherwise(F.lit(unit)))))
        rest = remainder(rest, unit)
    text = F.concat_ws(", ", *parts)
    return F.when(n == 0, F.lit("0 seconds")).otherwise(F.concat(F.when(nanos < 0, F.lit("-")).otherwise(F.lit("")), text))


# -- periods ----------------------------------------------------------------------------------

_PERIOD = r"^P(?=\d|T)(?:(\d+)W|(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?)?)\z"


def parse_period(text: Column) -> Column:
    """struct<years, months, weeks, days, nanos> of an ISO 8601 duration: weeks alone, or the others; a fraction is a fraction."""
    g = lambda i: F.coalesce(F.regexp_extract(text, _PERIOD, i).try_cast("bigint"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(text, _PERIOD, 8), 9, "0").try_cast("bigint")
    nanos = (g(5) * 3600 + g(6) * 60 + g(7)) * 1_000_000_000 + F.coalesce(fraction, F.lit(0))
    return F.when(text.rlike(_PERIOD), F.struct(g(2).cast("int").alias("years"), g(3).cast("int").alias("months"), g(1).cast("int").alias("weeks"), g(4).cast("int").alias("days"), nanos.alias("nanos")))


def describe_period(p: Column) -> Column:
    """ISO 8601 text of the fields that are not zero; P0D for none. Weeks beside other fields count as days."""
    only_weeks = (p["weeks"] != 0) & (p["years"] == 0) & (p["months"] == 0) & (p["days"] == 0) & (p["nanos"] == 0)
    days = p["days"] + 7 * p["weeks"]
    mark = lambda n, c: F.when(n != 0, F.concat(n.cast("string"), F.lit(c))).otherwise(F.lit(""))
    s = F.floor(p["nanos"] / 1_000_000_000).cast("bigint")
    fraction = F.rtrim(F.lpad((p["nanos"] % 1_000_000_000).cast("string"), 9, "0"), F.lit("0"))
    seconds = F.when(fraction != "", F.concat((s % 60).cast("string"), F.lit("."), fraction, F.lit("S"))).otherwise(mark(s % 60, "S"))
    time = F.concat(mark(F.floor(s / 3600), "H"), mark(F.floor(s % 3600 / 60), "M"), seconds)
    text = F.concat(F.lit("P"), mark(p["years"], "Y"), mark(p["months"], "M"), mark(days, "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(F.lit("")))
    return F.when(p.isNull(), F.lit(None).cast("string")).when(only_weeks, F.concat(F.lit("P"), p["weeks"].cast("string"), F.lit("W"))).when(text == "P", F.lit("P0D")).otherwise(text)


def add_period(ts: Column, p: Column) -> Column:
    """Calendar fields first, the day cut to the month's end, then days and time."""
    seconds = (F.floor(p["nanos"] / 1_000).cast("decimal(18,6)") / 1_000_000).cast("decimal(18,6)")
    return ts + F.make_ym_interval(p["years"], p["months"]) + F.make_dt_interval(p["days"] + 7 * p["weeks"]) + F.make_dt_interval(secs=seconds)


def sum_periods(a: Column, b: Column) -> Column:
    """Field by field, nothing carried."""
    return F.struct(*((a[f] + b[f]).alias(f) for f in ("years", "months", "weeks", "days", "nanos")))


def period_length(p: Column, since: Column) -> Column:
    """Nanoseconds of a period that begins at a timestamp."""
    return between(since, add_period(since, p))
