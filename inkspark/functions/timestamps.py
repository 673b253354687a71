"""Mixed timestamp strings to one UTC instant or one calendar day.

An ordered cascade of anchored patterns turns each string into year, month, day, time, half of day and
zone; strict checks follow. A wall time without a zone is taken in its record's home zone: if the zone
showed it twice (clocks put back) or never (clocks put forward), the string stays undecided.
All arithmetic is on microseconds since 1970, so the session's time zone plays no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?)?"
ZONE = r"(?: ?(Z|[+-]\d{2}:?\d{2}|[A-Z]{3,5}))?(?:\[([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)\])?"
TAIL = f"(?:(?:T|,? +){TIME}{ZONE})?"
WEEKDAY = r"(?:([A-Za-z]{3,9}),? )?"

# name, pattern, replacement that gives y|m|d|hour|minute|second|fraction|half|zone|bracket|weekday
CASCADE = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}}){TAIL}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:[T ](\d{2})(\d{2})(\d{2})?(Z|[+-]\d{2}:?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|||$7||"),
    ("epoch_s", r"^(\d{10})$", "$1||||||||||"),
    ("epoch_ms", r"^(\d{13})$", "$1||||||||||"),
    ("epoch_us", r"^(\d{16})$", "$1||||||||||"),
    ("numeric", rf"^(\d{{1,4}})([/.])(\d{{1,2}})\2(\d{{1,4}}){TAIL}$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|"),
    ("day_month", rf"^{WEEKDAY}(\d{{1,2}})\.? ([A-Za-z]{{3,9}})\.?,? (\d{{4}}){TAIL}$", "$4|$3|$2|$5|$6|$7|$8|$9|$10|$11|$1"),
    ("month_day", rf"^{WEEKDAY}([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}}){TAIL}$", "$4|$2|$3|$5|$6|$7|$8|$9|$10|$11|$1"),
)
FIELDS = ("y", "m", "d", "hour", "minute", "second", "fraction", "half", "zone", "bracket", "weekday")

# Month and weekday names, and the zone abbreviations in minutes from UTC, by zone.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
ABBREVIATIONS = {
    "America/New_York": {"EST": -300, "EDT": -240},
    "America/Toronto": {"EST": -300, "EDT": -240},
    "America/Chicago": {"CST": -360, "CDT": -300},
    "America/Denver": {"MST": -420, "MDT": -360},
    "America/Phoenix": {"MST": -420},
    "America/Los_Angeles": {"PST": -480, "PDT": -420},
    "Europe/London": {"GMT": 0, "BST": 60},
    "Europe/Dublin": {"GMT": 0, "IST": 60},
    "Europe/Lisbon": {"WET": 0, "WEST": 60},
    "Europe/Berlin": {"CET": 60, "CEST": 120},
    "Europe/Paris": {"CET": 60, "CEST": 120},
    "Europe/Madrid": {"CET": 60, "CEST": 120},
    "Europe/Rome": {"CET": 60, "CEST": 120},
    "Europe/Vienna": {"CET": 60, "CEST": 120},
    "Europe/Zurich": {"CET": 60, "CEST": 120},
    "Europe/Amsterdam": {"CET": 60, "CEST": 120},
    "Europe/Athens": {"EET": 120, "EEST": 180},
    "Europe/Helsinki": {"EET": 120, "EEST": 180},
    "Asia/Kolkata": {"IST": 330},
    "Asia/Shanghai": {"CST": 480},
    "Asia/Tokyo": {"JST": 540},
    "Asia/Seoul": {"KST": 540},
    "Australia/Brisbane": {"AEST": 600},
    "Australia/Sydney": {"AEST": 600, "AEDT": 660},
    "Australia/Melbourne": {"AEST": 600, "AEDT": 660},
}

SECOND = 1_000_000
DAY = 86_400 * SECOND


def _names(words: list[str]) -> Column:
    """Map of each name and its first three letters to its number from 1."""
    pairs = {w: i for i, full in enumerate(words, 1) for w in (full, full[:3])} | ({"sept": 9} if words is MONTHS else {})
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _local(micros: Column, zone: Column) -> Column:
    """Wall-clock microseconds of an instant in a zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone))


def valid_zones(df: DataFrame) -> list[str]:
    """The zone names that this session's JVM knows."""
    return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())


def normalize_timestamps(df: DataFrame, raw: str, zone: str, order: str) -> DataFrame:
    """Add ts_format, ts_status (instant, day, undecided), ts_micros and ts_value to df.

    raw: the string column. zone, order: columns with the home zone (IANA) and DMY, MDY or YMD.
    Null, blank, unreadable and impossible values, a weekday that contradicts the date, abbreviations
    that aren't of the home zone, wall times shown twice or never, and wall times without a known zone
    are undecided with a null value. A day without time is a day, whatever the zone. An offset counts
    even where a bracketed zone name follows. Columns of df keep their names and order; columns of df
    named like the four new ones are replaced.
    """
    new = ["ts_format", "ts_status", "ts_micros", "ts_value"]
    keep = [c for c in df.columns if c not in new]
    ts = parse(F.col(raw), F.col(zone), F.upper(F.col(order)), valid_zones(df))
    out = df.withColumn("__ts", ts)
    micros, is_day = F.col("__ts.micros"), F.col("__ts.is_day")
    status = F.when(micros.isNull(), "undecided").when(is_day, "day").otherwise("instant")
    return out.select(
        *keep, F.col("__ts.fmt").alias("ts_format"), status.alias("ts_status"), micros.alias("ts_micros"), render(micros, is_day).alias("ts_value")
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound once, so that filters pushed below don't repeat it at every use."""
    return F.transform(F.array(value), body)[0]


def parse(raw: Column, zone: Column, order: Column, zones: list[str]) -> Column:
    """Struct of fmt, micros and is_day; micros is null where the value is undecided."""

    def cascade(s: Column) -> Column:
        fmt = F.lit(None).cast("string")
        for name, pattern, _ in reversed(CASCADE):
            fmt = F.when(s.rlike(pattern), F.lit(name)).otherwise(fmt)
        return let(fmt, lambda f: let(fields(s, f), lambda p: let(checked(f, p), lambda x: let(x["days"] * DAY + x["of_day"], lambda w: instant(f, p, x, w)))))

    def fields(s: Column, fmt: Column) -> Column:
        canon = F.lit(None).cast("string")
        for name, pattern, replacement in reversed(CASCADE):
            canon = F.when(fmt == name, F.regexp_replace(s, pattern, replacement)).otherwise(canon)
        return F.transform(F.split(canon, r"\|"), lambda x: F.when(x != "", x))

    def checked(fmt: Column, p: Column) -> Column:
        """Days since 1970, microseconds of the day and minutes of offset, each null where impossible."""
        c = {f: p[i] for i, f in enumerate(FIELDS)}
        numeric = fmt == "numeric"
        year = F.when(~numeric, c["y"]).when(order == "YMD", c["y"]).when(order.isin("DMY", "MDY"), c["d"])
        day = F.when(~numeric, c["d"]).when(order == "YMD", c["d"]).when(order == "DMY", c["y"]).when(order == "MDY", c["m"])
        month = F.when(~numeric, c["m"]).when(order == "MDY", c["y"]).when(order.isin("DMY", "YMD"), c["m"])
        year = let(year, lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).when(F.length(y) == 4, y))
        month = F.when(fmt.isin("day_month", "month_day"), _names(MONTHS)[F.lower(c["m"])].cast("string")).otherwise(month)
        day = let(day, lambda d: F.when(F.length(d) <= 2, F.lpad(d, 2, "0")))
        date = let(F.concat_ws("-", year, F.lpad(month, 2, "0"), day), lambda d: F.when(F.length(d) == 10, d)).try_cast("date")
        weekday = _names(WEEKDAYS)[F.lower(F.substring(c["weekday"], 1, 3))]
        days = let(date, lambda d: F.when(c["weekday"].isNull() | (weekday == F.weekday(d) + 1), F.unix_date(d)).cast("long"))

        hour, minute, second = (c[k].cast("int") for k in ("hour", "minute", "second"))
        half = F.lower(c["half"])
        hour24 = F.when(half.isNull(), hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        fraction = F.coalesce(F.rpad(F.substring(c["fraction"], 1, 6), 6, "0").cast("long"), F.lit(0))
        of_day = let(
            F.struct(hour24.alias("h"), minute.alias("m"), F.coalesce(second, F.lit(0)).alias("s")),
            lambda t: F.when((t["h"] <= 23) & (t["m"] <= 59) & (t["s"] <= 59), ((t["h"] * 60 + t["m"]).cast("long") * 60 + t["s"]) * SECOND + fraction),
        )
        signed = c["zone"].rlike("^[+-]")
        hh = F.when(signed, F.substring(c["zone"], 2, 2)).cast("int")
        mm = F.when(signed, F.substring(c["zone"], -2, 2)).cast("int")
        abbreviations = F.create_map(*[F.lit(x) for z, a in ABBREVIATIONS.items() for k, v in a.items() for x in (f"{z} {k}", v)])
        offset = (
            F.when(c["zone"].isin("Z", "UTC", "GMT"), F.lit(0))
            .when(signed & (hh <= 18) & (mm <= 59), F.when(c["zone"].startswith("-"), -1).otherwise(1) * (hh * 60 + mm))
            .when(~signed, abbreviations[F.concat_ws(" ", zone, c["zone"])])
        )
        home = F.when(zone.isin(zones), zone)
        return F.struct(days.alias("days"), of_day.alias("of_day"), offset.cast("long").alias("offset"), home.alias("home"))

    def instant(fmt: Column, p: Column, x: Column, wall: Column) -> Column:
        c = {f: p[i] for i, f in enumerate(FIELDS)}
        # The zone's offsets a day before and a day after give the two candidates of any change between them.
        before = wall - (_local(wall - DAY, x["home"]) - (wall - DAY))
        after = wall - (_local(wall + DAY, x["home"]) - (wall + DAY))
        single = let(before, lambda u1: let(after, lambda u2: let(_local(u1, x["home"]) == wall, lambda ok1: let(_local(u2, x["home"]) == wall, lambda ok2: (
            F.when(u1 == u2, F.when(ok1, u1)).when(ok1 & ~ok2, u1).when(ok2 & ~ok1, u2)
        )))))
        zoned = F.when(c["zone"].isNotNull(), wall - x["offset"] * 60 * SECOND).when(c["bracket"].isNull(), single)
        epoch = fmt.startswith("epoch")
        number = F.when(epoch, c["y"]).cast("long")
        micros = (
            F.when(fmt == "epoch_s", number * SECOND)
            .when(fmt == "epoch_ms", number * 1000)
            .when(fmt == "epoch_us", number)
            .when(c["hour"].isNotNull(), zoned)
            .otherwise(x["days"] * DAY)
        )
        return F.struct(fmt.alias("fmt"), micros.alias("micros"), (c["hour"].isNull() & ~epoch).alias("is_day"))

    return let(F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), cascade)


def render(micros: Column, is_day: Column) -> Column:
    """yyyy-MM-dd of a day, yyyy-MM-ddTHH:mm:ss.SSSSSSZ of an instant, both from UTC microseconds."""
    of_day = F.pmod(micros, F.lit(DAY))
    date = F.date_from_unix_date(((micros - of_day) / DAY).cast("int")).cast("string")
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    second = F.floor(of_day / SECOND)
    clock = F.concat(
        F.lit("T"), pad(F.floor(second / 3600), 2), F.lit(":"), pad(F.floor(second / 60) % 60, 2), F.lit(":"),
        pad(second % 60, 2), F.lit("."), pad(of_day % SECOND, 6), F.lit("Z"),
    )
    return F.when(micros.isNull(), None).when(is_day, date).otherwise(F.concat(date, clock))
