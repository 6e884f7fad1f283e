"""Chinese numerals and article numbers as column expressions.

A numeral is groups of up to four digits, each but the last before a 万. In a group, each unit counts for the digit before it, or
once; the digit that ends it is ones. Both are found by patterns, so everything stays in the JVM and needs no dimension table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

# Digits and units of Chinese numerals.
DIGITS = {"零": 0, "○": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}

_CLASS = "".join(DIGITS) + "".join(UNITS)


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _group(c: Column) -> Column:
    """The value of a numeral below 万: for each of 千, 百 and 十 the digits before it, and the digit at the end."""
    digits = _table(DIGITS)
    total = F.coalesce(digits[F.regexp_extract(c, f"([{''.join(DIGITS)}])$", 1)], F.lit(0)).cast("long")
    for unit in ("千", "百", "十"):
        before = F.regexp_extract_all(c, F.lit(f"([{''.join(DIGITS)}]?){unit}"), F.lit(1))
        worth = F.transform(before, lambda d: F.greatest(F.coalesce(digits[d], F.lit(1)), F.lit(1)) * UNITS[unit])
        total = total + F.aggregate(worth, F.lit(0).cast("long"), lambda a, x: a + x)
    return total


def to_int(c: Column) -> Column:
    """The value of a Chinese or decimal numeral, null for other text."""
    def worth(groups: Column) -> Column:
        myriads = F.aggregate(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
        return myriads * UNITS["万"] + F.element_at(groups, -1)

    return F.when(c.rlike(r"^\d+$"), F.try_to_number(c, F.lit("9" * 18)).cast("long")).when(c.rlike(f"^[{_CLASS}]+$"), let(F.transform(F.split(c, "万"), _group), worth))


def from_int(n: Column) -> Column:
    """The Chinese numeral of 0..9999, null for other numbers."""
    digits = F.array(*map(F.lit, "零一二三四五六七八九"))
    text = F.lpad(n.cast("string"), 4, "0")
    out = F.concat(*(F.concat(F.get(digits, F.substring(text, k + 1, 1).cast("int")), F.lit(unit)) for k, unit in enumerate(("千", "百", "十", ""))))
    out = F.regexp_replace(F.regexp_replace(out, "零[千百十]", "零"), "零+", "零")
    out = F.regexp_replace(F.regexp_replace(out, "^零|零$", ""), "^一十", "十")
    return F.when(n == 0, "零").when(n.between(1, 9999), out)


def _parts(c: Column) -> Column:
    """Struct of an article's number and the text of its supplement."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "[《》第条 ]", "")
    return let(bare, lambda b: F.struct(to_int(F.substring_index(b, "之", 1)).alias("number"), F.regexp_extract(b, "^[^之]*之(.*)$", 1).alias("more")))


def article_key(c: Column) -> Column:
    """An article number as a comparison key: 第五百三十三条之一, 第533条之1 and 533之一 are 533之1; other text stays, trimmed."""
    def key(x: Column) -> Column:
        tail = F.when(x["more"] == "", "").otherwise(F.concat(F.lit("之"), let(to_int(x["more"]), lambda n: F.coalesce(n.cast("string"), x["more"]))))
        return F.when(x["number"].isNull(), F.trim(F.coalesce(c, F.lit("")))).otherwise(F.concat(x["number"].cast("string"), tail))

    return let(_parts(c), key)


def article_name(c: Column) -> Column:
    """An article number in its standard form 第X条, with 之X after it; other text stays, trimmed."""
    def name(x: Column) -> Column:
        tail = F.when(x["more"] == "", "").otherwise(F.concat(F.lit("之"), let(from_int(to_int(x["more"])), lambda n: F.coalesce(n, x["more"]))))
        return let(from_int(x["number"]), lambda n: F.when(n.isNull(), F.trim(F.coalesce(c, F.lit("")))).otherwise(F.concat(F.lit("第"), n, F.lit("条"), tail)))

    return let(_parts(c), name)
