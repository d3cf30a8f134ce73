"""Days named in texts: numbers with their marks are read from left to right, and what a day lacks it takes from before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of a year, a month, a day; what joins two days of a range.
YEAR, MONTH, DAYS, JOINTS = "年", "月", ("日", "号"), ("至", "到", "—", "~", "～", "-", "/")
DAY = "struct<y:int,m:int,d:int,marked:boolean,ranged:boolean>"


def days(text: Column, month: Column | None = None) -> Column:
    """array<DAY> of the days a text names, in their order.

    A number is a year before 年, or of four digits before a dash; a month before 月, or behind such a year; a day
    before 日 or 号 (marked), behind a dashed month, or before a dash or 至 and the like where a month is known. Year and month
    hold until others are named (``month`` before the first). ranged: the day ends a range that the day before it began.
    Null texts have none.
    """
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(\d+)\s*([{YEAR}{MONTH}{''.join(DAYS)}])?\s*([{''.join(JOINTS[:-2])}/-])?"), F.lit(i)) for i in (1, 2, 3)]
    tokens = F.arrays_zip(*[c.alias(n) for c, n in zip(found, ("n", "mark", "joint"))])
    none = F.lit(None).cast("int")
    zero = F.struct(none.alias("y"), (month if month is not None else none).cast("int").alias("m"), F.lit(0).alias("dashed"), F.lit(False).alias("linked"), F.expr(f"cast(array() as array<{DAY}>)").alias("found"))

    def read(a: Column, x: Column) -> Column:
        n, bare = x["n"].try_cast("int"), x["mark"] == ""
        dash = x["joint"].isin("-", "/")
        is_year = (x["mark"] == YEAR) | (bare & dash & (F.length(x["n"]) == 4))
        is_month = (x["mark"] == MONTH) | (bare & (a["dashed"] == 1))
        is_day = x["mark"].isin(*DAYS) | (bare & ((a["dashed"] == 2) | ((x["joint"] != "") & a["m"].isNotNull())))
        new = lambda y, m, dashed, linked, found: F.struct(y.alias("y"), m.alias("m"), dashed.alias("dashed"), linked.alias("linked"), found.alias("found"))
        day = F.struct(a["y"].alias("y"), a["m"].alias("m"), n.alias("d"), (~bare).alias("marked"), a["linked"].alias("ranged"))
        no = F.lit(0)
        return (
            F.when(is_year, new(n, none, F.when(bare, 1).otherwise(0), a["linked"], a["found"]))
            .when(is_month, new(a["y"], n, F.when(bare, 2).otherwise(0), a["linked"], a["found"]))
            .when(is_day, new(a["y"], a["m"], no, x["joint"] != "", F.concat(a["found"], F.array(day.cast(DAY)))))
            .otherwise(new(a["y"], a["m"], no, F.lit(False), a["found"]))
        )

    return F.aggregate(tokens, zero, read, lambda a: a["found"])


def as_date(day: Column) -> Column:
    """The calendar day, null where there is no such one or a part is unknown."""
    return F.try_to_date(F.concat(day["y"].cast("string"), F.lit("-"), day["m"].cast("string"), F.lit("-"), day["d"].cast("string")), "yyyy-M-d")


def first_range(found: Column) -> Column:
    """struct(a, b): the first two neighbouring days of which the second ends a range; null if there are none."""
    pairs = F.arrays_zip(found.alias("a"), F.slice(found, 2, 1 << 30).alias("b"))
    return F.get(F.filter(pairs, lambda x: x["b"]["ranged"]), F.lit(0))
