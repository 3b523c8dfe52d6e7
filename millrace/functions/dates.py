"""PostgreSQL date and time functions; a mixed interval is a struct of months, days, micros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.registry import sql

_DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def date_bin(stride_us: int, ts: Column, origin_us: int = 0) -> Column:
    """The start of the stride that holds the time."""
    return from_micros(F.floor((micros(ts) - origin_us) / stride_us) * stride_us + origin_us)


def extract(field: str, ts: Column) -> Column:
    """Fields with PostgreSQL's meaning: epoch, dow from Sunday 0, isodow, century, ..."""
    own = {"epoch": lambda: micros(ts) / 1e6, "dow": lambda: F.dayofweek(ts) - 1, "isodow": lambda: F.weekday(ts) + 1, "doy": lambda: F.dayofyear(ts), "week": lambda: F.weekofyear(ts), "quarter": lambda: F.quarter(ts), "century": lambda: F.ceil(F.year(ts) / 100), "decade": lambda: F.floor(F.year(ts) / 10), "millennium": lambda: F.ceil(F.year(ts) / 1000), "milliseconds": lambda: F.pmod(micros(ts), F.lit(60_000_000)) / 1000, "microseconds": lambda: F.pmod(micros(ts), F.lit(60_000_000))}
    return own[field]() if field in own else F.date_part(F.lit(field), ts)


def interval(months: Column | int = 0, days: Column | int = 0, us: Column | int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(months).cast("long").alias("months"), lit(days).cast("long").alias("days"), lit(us).cast("long").alias("micros"))


def age(later: Column, earlier: Column) -> Column:
    """Whole months, then days and microseconds that are left."""
    sign = F.when(later < earlier, -1).otherwise(1)
    hi, lo = F.greatest(later, earlier), F.least(later, earlier)
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    months = months - F.when(F.add_months(lo.cast("date"), months).cast("timestamp").cast("long") * 1_000_000 + F.pmod(micros(lo), F.lit(_DAY)) > micros(hi), 1).otherwise(0)
    start = F.unix_micros(F.add_months(lo.cast("date"), months).cast("timestamp")) + F.pmod(micros(lo), F.lit(_DAY))
    rest = micros(hi) - start
    return interval(months * sign, F.floor(rest / _DAY) * sign, F.pmod(rest, F.lit(_DAY)) * sign)


def justify_hours(i: Column) -> Column:
    carry = F.floor(i["micros"] / _DAY)
    return interval(i["months"], i["days"] + carry, i["micros"] - carry * _DAY)


def justify_days(i: Column) -> Column:
    carry = F.floor(i["days"] / 30)
    return interval(i["months"] + carry, i["days"] - carry * 30, i["micros"])


def justify_interval(i: Column) -> Column:
    return justify_days(justify_hours(i))


def interval_text(i: Column) -> Column:
    """months-days-micros, for results that are compared."""
    return F.concat_ws("-", i["months"].cast("string"), i["days"].cast("string"), i["micros"].cast("string"))


_PATTERNS = (("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("Month", "MMMM"), ("Mon", "MMM"), ("MM", "MM"), ("Day", "EEEE"), ("Dy", "EEE"), ("DDD", "DDD"), ("DD", "dd"), ("YY", "yy"), ("Q", "Q"), ("AM", "a"), ("PM", "a"))


def to_char(ts: Column, pattern: str) -> Column:
    """Common PostgreSQL template patterns as a Spark date format."""
    out, k = "", 0
    while k < len(pattern):
        for a, b in _PATTERNS:
            if pattern.startswith(a, k):
                out, k = out + b, k + len(a)
                break
        else:
            out, k = out + (f"'{pattern[k]}'" if pattern[k].isalpha() else pattern[k]), k + 1
    return F.date_format(ts, out)


def to_number(text: Column, pattern: str) -> Column:
    return F.try_to_number(F.trim(text), F.lit(pattern.replace("G", ",").replace("D", ".")))


_FIELDS = ["year", "month", "day", "hour", "minute", "quarter", "week", "dow", "doy"]
_DUCK = ", ".join(f"CAST(extract({f} FROM ts) AS BIGINT) AS {f}_" for f in _FIELDS)
_SPARK = {"dow": "dayofweek(ts) - 1"}
sql("fn_extract", "SELECT event_id, " + ", ".join(f"CAST({_SPARK.get(f, f'extract({f} FROM ts)')} AS BIGINT) AS {f}_" for f in _FIELDS) + " FROM events", f"SELECT event_id, {_DUCK} FROM events")
sql("fn_epoch", "SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events", "SELECT event_id, epoch_us(ts) AS us FROM events")
sql("fn_date_trunc", "SELECT event_id, " + ", ".join(f"date_format(date_trunc('{u}', ts), 'yyyy-MM-dd HH:mm:ss') AS {u}_" for u in ("year", "quarter", "month", "week", "day", "hour", "minute")) + " FROM events",
    "SELECT event_id, " + ", ".join(f"strftime(date_trunc('{u}', ts), '%Y-%m-%d %H:%M:%S') AS {u}_" for u in ("year", "quarter", "month", "week", "day", "hour", "minute")) + " FROM events")
sql("fn_make_dates", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(make_date(1990 + o_orderkey % 30, 1 + o_orderkey % 12, 1 + o_orderkey % 28) AS STRING) AS d, CAST(make_timestamp_ntz(2000, 1, 1 + o_orderkey % 28, 3, 4, 5) AS STRING) AS t FROM (SELECT CAST(o_orderkey AS INT) AS o_orderkey FROM orders)",
    "SELECT o_orderkey, strftime(make_date(1990 + o_orderkey % 30, 1 + o_orderkey % 12, 1 + o_orderkey % 28), '%Y-%m-%d') AS d, strftime(make_timestamp(2000, 1, 1 + o_orderkey % 28, 3, 4, 5), '%Y-%m-%d %H:%M:%S') AS t FROM orders")
sql("fn_to_char", "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS s, date_format(ts, 'dd/MM/yy') AS d FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, strftime(ts, '%d/%m/%y') AS d FROM events")
sql("fn_timezone", "SELECT event_id, date_format(convert_timezone('UTC', 'Asia/Tokyo', ts), 'yyyy-MM-dd HH:mm:ss') AS t FROM events", "SELECT event_id, strftime(ts + INTERVAL 9 HOURS, '%Y-%m-%d %H:%M:%S') AS t FROM events")
sql("fn_date_arithmetic", "SELECT o_orderkey, CAST(date_add(CAST(o_orderdate AS DATE), 45) AS STRING) AS a, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS b, CAST(last_day(CAST(o_orderdate AS DATE)) AS STRING) AS c FROM orders",
    "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 45, '%Y-%m-%d') AS a, (CAST(o_orderdate AS DATE) - DATE '1995-01-01')::INTEGER AS b, strftime(last_day(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS c FROM orders")
