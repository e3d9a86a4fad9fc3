"""Partial dates, times and durations as structs, by expressions only.

``parse_fragment`` reads any of the seven date/time types into
``struct<year, month, day, hour, minute, second, zone_min>``; parts that a value lacks
are null, and so is the whole struct for a value that is none of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})?"
# kind -> pattern with the parts year, month, day, hour, minute, second, zone in this order
_KINDS = {
    "dateTime": (r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)" + _ZONE + r"\z", (1, 2, 3, 4, 5, 6, 7)),
    "date": (r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})" + _ZONE + r"\z", (1, 2, 3, 0, 0, 0, 4)),
    "time": (r"^([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)" + _ZONE + r"\z", (0, 0, 0, 1, 2, 3, 4)),
    "gYearMonth": (r"^(-?[0-9]{4,})-([0-9]{2})" + _ZONE + r"\z", (1, 2, 0, 0, 0, 0, 3)),
    "gYear": (r"^(-?[0-9]{4,})" + _ZONE + r"\z", (1, 0, 0, 0, 0, 0, 2)),
    "gMonthDay": (r"^--([0-9]{2})-([0-9]{2})" + _ZONE + r"\z", (0, 1, 2, 0, 0, 0, 3)),
    "gMonth": (r"^--([0-9]{2})" + _ZONE + r"\z", (0, 1, 0, 0, 0, 0, 2)),
    "gDay": (r"^---([0-9]{2})" + _ZONE + r"\z", (0, 0, 1, 0, 0, 0, 2)),
}
FRAGMENT = "struct<year:int,month:int,day:int,hour:int,minute:int,second:decimal(12,9),zone_min:int>"


def parse_zone(z: Column) -> Column:
    """Minutes east of UTC; null without a zone or beyond 14 hours."""
    minutes = F.regexp_extract(z, r"^[+-]([0-9]{2}):", 1).try_cast("int") * 60 + F.regexp_extract(z, r":([0-9]{2})\z", 1).try_cast("int")
    signed = F.when(F.startswith(z, F.lit("-")), -minutes).otherwise(minutes)
    return F.when(z == "Z", 0).when(F.abs(signed) <= 840, signed)


def parse_kind(s: Column, kind: str) -> Column:
    pattern, groups = _KINDS[kind]

    def part(k: int, as_type: str) -> Column:
        return F.regexp_extract(s, pattern, groups[k]).try_cast(as_type) if groups[k] else F.lit(None).cast(as_type)

    got = F.struct(*[part(k, "int").alias(n) for k, n in enumerate(("year", "month", "day", "hour", "minute"))], part(5, "decimal(12,9)").alias("second"), parse_zone(F.regexp_extract(s, pattern, groups[6])).alias("zone_min"))
    return F.when(F.regexp_like(s, F.lit(pattern)), got.cast(FRAGMENT))


def parse_fragment(s: Column) -> Column:
    return F.coalesce(*[F.get(F.filter(F.array(parse_kind(s, k)), check), F.lit(0)) for k in _KINDS])


def days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(year.isNull() | leap, 29).otherwise(28)).otherwise(31)


def check(f: Column) -> Column:
    """Every part that is there lies in its range; an hour of 24 only as 24:00:00, a leap second up to 60.x."""
    def part(name: str, low, high) -> Column:
        return f[name].isNull() | f[name].between(low, high)

    fits = part("month", 1, 12) & (f["day"].isNull() | f["day"].between(1, days_in_month(f["year"], f["month"]))) & part("hour", 0, 24) & part("minute", 0, 59)
    second = f["second"].isNull() | ((f["second"] >= 0) & (f["second"] < 61))
    late = (F.coalesce(f["hour"], F.lit(0)) != 24) | ((F.coalesce(f["minute"], F.lit(0)) == 0) & (F.coalesce(f["second"], F.lit(0).cast("decimal(12,9)")) == 0))
    return f.isNotNull() & fits & second & late


def includes_date(f: Column) -> Column:
    return f["year"].isNotNull() | f["month"].isNotNull() | f["day"].isNotNull()


def includes_time(f: Column) -> Column:
    return f["hour"].isNotNull() | f["minute"].isNotNull() | f["second"].isNotNull()


def microsecond(f: Column) -> Column:
    return ((f["second"] - F.floor(f["second"])) * 1_000_000).cast("int")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def to_utc(f: Column) -> Column:
    """The instant as TIMESTAMP: local time less its offset; null unless date and time are there."""
    at = F.try_make_timestamp(f["year"], f["month"], f["day"], F.coalesce(f["hour"], F.lit(0)) % 24, f["minute"], F.least(f["second"], F.lit(59.999999).cast("decimal(12,9)")).cast("decimal(16,6)"), F.lit("UTC"))
    at = F.when(f["hour"] == 24, at + F.expr("INTERVAL 1 DAY")).otherwise(at)
    return at - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(f["zone_min"], F.lit(0)), F.lit(0).cast("decimal(18,6)"))


def to_date(f: Column) -> Column:
    return F.make_date(f["year"], f["month"], f["day"])


def from_timestamp(ts: Column) -> Column:
    """A TIMESTAMP as a fragment in UTC."""
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.day(ts).alias("day"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.extract(F.lit("SECOND"), ts).cast("decimal(12,9)").alias("second"), F.lit(0).alias("zone_min")).cast(FRAGMENT)


def zone_text(f: Column) -> Column:
    z = f["zone_min"]
    return F.when(z.isNull(), "").when(z == 0, "Z").otherwise(F.concat(F.when(z < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(z) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(z) % 60).cast("string"), 2, "0")))


def date_text(f: Column) -> Column:
    return F.concat(F.when(f["year"] < 0, "-").otherwise(""), F.lpad(F.abs(f["year"]).cast("string"), 4, "0"), F.lit("-"), F.lpad(f["month"].cast("string"), 2, "0"), F.lit("-"), F.lpad(f["day"].cast("string"), 2, "0"))


def time_text(f: Column) -> Column:
    whole = F.lpad(F.floor(f["second"]).cast("string"), 2, "0")
    rest = F.regexp_replace(F.regexp_extract(f["second"].cast("string"), r"(\.[0-9]*)\z", 1), r"\.?0*\z", "")
    return F.concat(F.lpad(f["hour"].cast("string"), 2, "0"), F.lit(":"), F.lpad(f["minute"].cast("string"), 2, "0"), F.lit(":"), whole, rest)


def to_text(f: Column) -> Column:
    """The lexical form of the parts that are there, zone last."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year = F.concat(F.when(f["year"] < 0, "-").otherwise(""), F.lpad(F.abs(f["year"]).cast("string"), 4, "0"))
    body = (
        F.when(f["year"].isNotNull() & f["day"].isNotNull() & f["hour"].isNotNull(), F.concat(date_text(f), F.lit("T"), time_text(f)))
        .when(f["hour"].isNotNull(), time_text(f))
        .when(f["year"].isNotNull() & f["day"].isNotNull(), date_text(f))
        .when(f["year"].isNotNull() & f["month"].isNotNull(), F.concat(year, F.lit("-"), two(f["month"])))
        .when(f["year"].isNotNull(), year)
        .when(f["month"].isNotNull() & f["day"].isNotNull(), F.concat(F.lit("--"), two(f["month"]), F.lit("-"), two(f["day"])))
        .when(f["month"].isNotNull(), F.concat(F.lit("--"), two(f["month"])))
        .otherwise(F.concat(F.lit("---"), two(f["day"])))
    )
    return F.concat(body, zone_text(f))


_DURATION = r"^(-?)P(?=[0-9T])(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?=[0-9])(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?\z"


def parse_duration(s: Column) -> Column:
    """``PnYnMnDTnHnMnS`` as struct<negative, years, months, days, hours, minutes, seconds>; absent parts are 0."""
    def part(k: int, as_type: str) -> Column:
        return F.coalesce(F.regexp_extract(s, _DURATION, k).try_cast(as_type), F.lit(0).cast(as_type))

    names = ("years", "months", "days", "hours", "minutes")
    got = F.struct((F.regexp_extract(s, _DURATION, 1) == "-").alias("negative"), *[part(k + 2, "bigint").alias(n) for k, n in enumerate(names)], part(7, "decimal(18,9)").alias("seconds"))
    return F.when(F.regexp_like(s, F.lit(_DURATION)), got)


def duration_text(d: Column) -> Column:
    def part(name: str, mark: str) -> Column:
        return F.when(d[name] > 0, F.concat(d[name].cast("string"), F.lit(mark))).otherwise("")

    seconds = F.when(d["seconds"] > 0, F.concat(F.regexp_replace(F.regexp_replace(d["seconds"].cast("string"), r"0+\z", ""), r"\.\z", ""), F.lit("S"))).otherwise("")
    time = F.concat(part("hours", "H"), part("minutes", "M"), seconds)
    date = F.concat(part("years", "Y"), part("months", "M"), part("days", "D"))
    body = F.concat(date, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.when(d.isNotNull(), F.concat(F.when(d["negative"], "-").otherwise(""), F.lit("P"), F.when(body == "", "T0S").otherwise(body)))


def add_duration(ts: Column, d: Column) -> Column:
    """A TIMESTAMP plus a duration; intervals are only made inside the expression."""
    sign = F.when(d["negative"], -1).otherwise(1)
    months = F.make_ym_interval((sign * d["years"]).cast("int"), (sign * d["months"]).cast("int"))
    rest = F.make_dt_interval((sign * d["days"]).cast("int"), (sign * d["hours"]).cast("int"), (sign * d["minutes"]).cast("int"), (sign * d["seconds"]).cast("decimal(18,6)"))
    return ts + months + rest
