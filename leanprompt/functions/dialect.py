"""The few spellings in which Spark SQL and the SQL of the oracle engine differ; everything else is written once."""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def lit(self, pattern: str) -> str:
        return ("r'" if self.spark else "'") + pattern + "'"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, '{by}')" if self.spark else f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.lit(pattern)})" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def hits(self, x: str, pattern: str) -> str:
        return f"cast(regexp_count({x}, {self.lit(pattern)}) as bigint)" if self.spark else f"cast(len(regexp_extract_all({x}, '{pattern}')) as bigint)"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)" if self.spark else f"regexp_extract_all({x}, '{pattern}')"

    def explode(self, x: str) -> str:
        return f"explode({x})" if self.spark else f"unnest({x})"

    def days(self, date: str, n: str) -> str:
        return f"date_sub({date}, cast({n} as int))" if self.spark else f"cast({date} - cast({n} as integer) as date)"

    def sunday(self, date: str) -> str:
        return f"date_sub({date}, dayofweek({date}) - 1)" if self.spark else f"cast({date} - cast(dayofweek({date}) as integer) as date)"

    def month(self, date: str) -> str:
        return f"cast(date_trunc('month', {date}) as date)"

    def seconds(self, ts: str) -> str:
        return f"(unix_micros(cast({ts} as timestamp)) / 1000000.0D)" if self.spark else f"(epoch_us({ts}) / 1000000.0)"

    def later(self, ts: str, hours: str, minutes: str) -> str:
        if self.spark:
            return f"({ts} + make_dt_interval(0, cast({hours} as int), cast({minutes} as int), 0))"
        return f"({ts} + to_hours(cast({hours} as integer)) + to_minutes(cast({minutes} as integer)))"

    def trim(self, x: str) -> str:
        return self.replace(x, r"^\s+|\s+$", "")


SPARK, ORACLE = Dialect(True), Dialect(False)
