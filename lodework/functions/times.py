"""Recurrence rules, cron schedules, nanosecond instants and time-ordered ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekday names of recurrence rules, Monday first.
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


def _part(rule: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.upper(rule), rf"(?:^|[;:]){name}=([^;]*)", 1), F.lit(""))


# The parts of a recurrence rule that are read, and what they may hold.
RULE_PARTS = (r"FREQ=(DAILY|WEEKLY|MONTHLY|YEARLY)", r"INTERVAL=[1-9]\d*", r"COUNT=[1-9]\d*", r"UNTIL=\d{8}(T\d{6}Z?)?",
              r"BYDAY=(MO|TU|WE|TH|FR|SA|SU)(,(MO|TU|WE|TH|FR|SA|SU))*", r"WKST=MO")


def _understood(rule: Column) -> Column:
    """The rule, if every part of it is one of ``RULE_PARTS`` and it has a frequency; else an error."""
    part = "(" + "|".join(RULE_PARTS) + ")"
    good = F.upper(rule).rlike(rf"^(RRULE:)?{part}(;{part})*;?$") & F.upper(rule).rlike(r"(^|[;:])FREQ=")
    return F.when(good | rule.isNull(), rule).otherwise(F.raise_error(F.concat(F.lit("recurrence rule not understood: "), rule)))


def rrule_occurrences(rules: DataFrame, rule: str, start: str, horizon: dt.date | str) -> DataFrame:
    """One row per occurrence: all columns, ``seq`` from 1 and ``occurrence``.

    Reads FREQ (DAILY, WEEKLY, MONTHLY, YEARLY), INTERVAL, COUNT, UNTIL and plain BYDAY.  Weeks begin on
    Monday.  A month or year without the day of the start is skipped.  Nothing lies after ``horizon``.
    A rule with any other part, or one of these that is not well formed, raises.
    """
    text, begin = _understood(F.col(rule)), F.col(start).cast("timestamp_ntz")
    until_text = F.rpad(F.regexp_replace(_part(text, "UNTIL"), "[TZ]", ""), 14, "235959")
    # the parts become columns first: the array functions below would read the text once per element
    parsed = rules.select(
        "*", _part(text, "FREQ").alias("_freq"), F.coalesce(_part(text, "INTERVAL").cast("int"), F.lit(1)).alias("_every"),
        _part(text, "COUNT").cast("int").alias("_count"), F.split(_part(text, "BYDAY"), ",").alias("_byday"),
        F.try_to_timestamp(until_text, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("_until"),
        begin.alias("_begin"), begin.cast("date").alias("_day0"))
    freq, every, count, byday, until, begin, day0 = (
        F.col(c) for c in ("_freq", "_every", "_count", "_byday", "_until", "_begin", "_day0"))
    last = F.least(F.lit(str(horizon)).cast("date"), F.coalesce(until.cast("date"), F.lit(str(horizon)).cast("date")))

    # without BYDAY: the k-th step of the rule; the step bound stops at the last day
    days_left = F.date_diff(last, day0)
    unit_days = F.when(freq == "WEEKLY", 7).otherwise(1) * every
    months = F.when(freq == "YEARLY", 12).otherwise(1) * every
    by_days = freq.isin("DAILY", "WEEKLY")
    steps = F.when(by_days, F.floor(days_left / unit_days)).otherwise(
        F.floor(F.months_between(last, F.trunc(day0, "month")) / months)).cast("int")
    # only month steps can be invalid, so a count bounds the day steps directly
    steps = F.when(by_days & count.isNotNull(), F.least(steps, count - 1)).otherwise(steps)

    def step(k: Column) -> Column:
        return F.when(by_days, F.date_add(day0, k * unit_days)).otherwise(F.add_months(day0, k * months))

    plain = F.filter(F.transform(F.sequence(F.lit(0), steps), step),
                     lambda d: (d <= last) & (by_days | (F.day(d) == F.day(day0))))

    # with BYDAY: days of the wanted weekdays inside the periods the interval selects
    week0 = F.date_sub(day0, F.weekday(day0))

    def chosen(d: Column) -> Column:
        name = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(d) + 1)
        period = (F.when(freq == "DAILY", F.date_diff(d, day0))
                  .when(freq == "WEEKLY", F.floor(F.date_diff(d, week0) / 7))
                  .when(freq == "MONTHLY", (F.year(d) - F.year(day0)) * 12 + F.month(d) - F.month(day0))
                  .otherwise(F.year(d) - F.year(day0)))
        return F.array_contains(byday, name) & (period % every == 0)

    listed = F.filter(F.sequence(day0, last), chosen)

    dates = F.when(last < day0, F.array().cast("array<date>")).when(byday.isNull(), plain).otherwise(listed)
    dates = F.when(count.isNull(), dates).otherwise(F.slice(dates, 1, F.coalesce(count, F.lit(1))))
    out = parsed.select("*", F.posexplode(dates).alias("_i", "_d"))
    # clock time of the start is kept
    moment = F.col("_d").cast("timestamp_ntz") + (begin - F.date_trunc("day", begin).cast("timestamp_ntz"))
    out = out.withColumn("seq", (F.col("_i") + 1).cast("long")).withColumn("occurrence", moment)
    return out.where(until.isNull() | (F.col("occurrence") <= until)).select(*rules.columns, "seq", "occurrence")


def cron_field(field: Column, lo: int, hi: int) -> Column:
    """Values of one cron field: ``*``, ``a``, ``a-b``, each with an optional ``/step``, joined by commas."""

    def one(item: Column) -> Column:
        span = F.split_part(item, F.lit("/"), F.lit(1))
        step = F.coalesce(F.nullif(F.split_part(item, F.lit("/"), F.lit(2)), F.lit("")).cast("int"), F.lit(1))
        first = F.when(span == "*", lo).otherwise(F.split_part(span, F.lit("-"), F.lit(1)).try_cast("int"))
        end = F.nullif(F.split_part(span, F.lit("-"), F.lit(2)), F.lit("")).try_cast("int")
        end = F.when(span == "*", hi).otherwise(F.coalesce(end, F.when(item.contains("/"), F.lit(hi)), first))
        return F.sequence(first, end, step)

    return F.array_distinct(F.flatten(F.transform(F.split(field, ","), one)))


# Names in cron schedules.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")


def _schedule(text: Column) -> Column:
    """A cron schedule with names as numbers; an error if it is not five well-formed fields within their ranges."""
    plain = F.upper(F.trim(text))
    for names, first in ((MONTHS, 1), (DAYS, 0)):
        for i, name in enumerate(names, first):
            plain = F.regexp_replace(plain, rf"\b{name}\b", str(i))
    number = {"min": r"[0-5]?\d", "hour": r"([01]?\d|2[0-3])", "dom": r"(0?[1-9]|[12]\d|3[01])", "mon": r"(0?[1-9]|1[0-2])", "dow": r"[0-7]"}
    fields = []
    for n in number.values():
        item = rf"(\*|{n}(-{n})?)(/[1-9]\d*)?"
        fields.append(rf"{item}(,{item})*")
    return F.when(plain.rlike("^" + r"\s+".join(fields) + "$") | text.isNull(), plain).otherwise(
        F.raise_error(F.concat(F.lit("schedule not understood: "), text)))


def cron_runs(jobs: DataFrame, schedule: str, start: str, end: str) -> DataFrame:
    """Due times of each job in [start, end) as ``due`` (minute, hour, day of month, month, day of week).

    Days are filtered first, then only the hours and minutes of the schedule are produced.  If both day
    fields are restricted a day matching either is due; Sunday is 0 or 7, months and weekdays may have their
    English names of three letters.  A schedule that is none of this raises.
    """
    fields = F.split(_schedule(F.col(schedule)), r"\s+")
    dom, dow = fields.getItem(2), fields.getItem(4)
    # the value lists become columns first, so they are built once per job and not once per day
    compiled = jobs.select(
        "*", cron_field(fields.getItem(0), 0, 59).alias("_min"), cron_field(fields.getItem(1), 0, 23).alias("_hour"),
        cron_field(dom, 1, 31).alias("_dom"), cron_field(fields.getItem(3), 1, 12).alias("_mon"),
        F.transform(cron_field(dow, 0, 6), lambda d: F.when(d == 7, 0).otherwise(d)).alias("_dow"),
        ((dom != "*") & (dow != "*")).alias("_either"))
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    days = compiled.select("*", F.explode(F.sequence(lo.cast("date"), hi.cast("date"))).alias("_day"))
    in_dom = F.array_contains("_dom", F.day("_day"))
    in_dow = F.array_contains("_dow", F.dayofweek("_day") - 1)
    day_ok = F.when(F.col("_either"), in_dom | in_dow).otherwise(in_dom & in_dow)
    hours = (days.where(F.array_contains("_mon", F.month("_day")) & day_ok)
             .select(*jobs.columns, "_day", "_min", F.explode("_hour").alias("_h")))
    due = F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("_h"), mins=F.col("_m"))
    return (hours.select(*jobs.columns, "_day", "_h", F.explode("_min").alias("_m")).withColumn("due", due)
            .where((F.col("due") >= lo) & (F.col("due") < hi)).drop("_day", "_h", "_m"))


def schedule_job(jobs: DataFrame, name: str, schedule: str, command: str) -> DataFrame:
    """Job table with one more job (or a new schedule for a known name)."""
    added = jobs.sparkSession.createDataFrame([(name, schedule, command)], "jobname string, schedule string, command string")
    return unschedule_job(jobs, name).unionByName(added)


def unschedule_job(jobs: DataFrame, name: str) -> DataFrame:
    return jobs.where(F.col("jobname") != name)


def to_nanos(ts: Column, extra: Column | int = 0) -> Column:
    """Epoch nanoseconds of a timestamp (Spark timestamps hold microseconds) plus ``extra`` nanoseconds."""
    return F.unix_micros(ts.cast("timestamp")) * 1000 + extra


def from_nanos(ns: Column) -> Column:
    """Timestamp of an epoch-nanosecond count, cut to microseconds."""
    return F.timestamp_micros(_floor_div(ns, 1000)).cast("timestamp_ntz")


def _floor_div(value: Column, divisor: int) -> Column:
    """Integer floor division; stays exact where a double would round."""
    whole = F.lit(divisor).cast("long")
    return F.call_function("div", value - F.pmod(value, whole), whole)


def nanos_bucket(df: DataFrame, column: str, every_ns: int, name: str = "bucket") -> DataFrame:
    """Start of the bucket of ``every_ns`` nanoseconds each row falls into."""
    return df.withColumn(name, F.col(column) - F.pmod(F.col(column), F.lit(every_ns).cast("long")))


def uuid7(ts: Column, key: Column) -> Column:
    """Id that sorts by time: 48 bits of epoch milliseconds, version 7, and a hash of the row key.

    The same row always gets the same id, so a repeated task writes the same values.
    """
    millis = F.lpad(F.lower(F.hex(F.unix_millis(ts.cast("timestamp")))), 12, "0")
    noise = F.md5(key.cast("string"))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(noise, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4), F.lit("-7"), F.substring(noise, 1, 3),
                    F.lit("-"), variant, F.substring(noise, 5, 3), F.lit("-"), F.substring(noise, 8, 12))


def assign_uuid7(df: DataFrame, ts: str, key: str, name: str = "id") -> DataFrame:
    return df.withColumn(name, uuid7(F.col(ts), F.col(key)))


def uuid7_ts(value: Column) -> Column:
    """Instant (to the millisecond) inside a time-ordered id."""
    millis = F.conv(F.concat(F.substring(value, 1, 8), F.substring(value, 10, 4)), 16, 10).cast("long")
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def uuid7_floor(moment: dt.datetime) -> str:
    """Lowest id of an instant: ``id >= uuid7_floor(a)`` and ``id < uuid7_floor(b)`` prune files by id alone."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
    text = f"{int(aware.timestamp() * 1000):012x}"
    return f"{text[:8]}-{text[8:]}-7000-8000-000000000000"
