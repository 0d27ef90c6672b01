"""Typed values of texts: dates, numbers with units, words of truth, members of a list.

Each parser is a column expression that gives a struct (type, int_value, float_value,
datetime_value, bool_value, enum_value, unit, confidence), or null where the text is no
such value, so that a chain of parsers is a coalesce. Null and blank texts have no value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: factors of units, case matters
UNIT_FACTORS = {
    "元": 1, "美元": 1, "USD": 1, "$": 1, "万": 10000, "万元": 10000, "亿": 100000000, "亿元": 100000000, "克": 0.001, "g": 0.001, "kg": 1, "公斤": 1,
    "千克": 1, "吨": 1000, "米": 1, "m": 1, "公里": 1000, "km": 1000, "厘米": 0.01, "cm": 0.01, "秒": 1, "s": 1, "分钟": 60, "小时": 3600, "天": 86400,
}
# fixed values: Chinese numerals
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "百": 100, "千": 1000, "万": 10**4, "亿": 10**8, "兆": 10**12}
# fixed values: measure words that may stand before a unit
MEASURES = ("个", "件", "条", "项", "批", "次", "笔", "单", "组")
# fixed values: words of truth
TRUE_WORDS = ("是", "对", "真", "yes", "true", "已", "有", "启用", "开启")
FALSE_WORDS = ("否", "错", "假", "no", "false", "未", "无", "禁用", "关闭")
# fixed values: marks of an amount, with which four digits are no year
AMOUNT_MARKS = "元 美元 USD \\$ ¥ 万元 亿元 块 角 分 块钱 毛 EUR £ RMB CNY HKD /月 /年 /天 /周 每月 每年 起 左右 约".split()
# fixed values: parts of the names of types whose values are dates
TIME_TYPES = ("时间", "日期", "time", "date")
NUMBER = r"([0-9,.]+(?:[eE][+-]?[0-9]+)?)"
_KINDS = {"int_value": "bigint", "float_value": "double", "datetime_value": "timestamp_ntz", "bool_value": "boolean", "enum_value": "string"}


def _value(kind: Column | str, confidence: Column | float, unit: Column | None = None, **given: Column) -> Column:
    parts = [(F.lit(kind) if isinstance(kind, str) else kind).alias("type")]
    parts += [given.get(name, F.lit(None)).cast(form).alias(name) for name, form in _KINDS.items()]
    return F.struct(*parts, (F.lit(None) if unit is None else unit).cast("string").alias("unit"), F.lit(confidence).cast("double").alias("confidence"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _moment(text: Column, pattern: str, n: int) -> Column:
    """The first place where the pattern's n numbers are a date and time; null where they are none."""
    parts = [F.regexp_extract(text, pattern, i + 1).try_cast("int") for i in range(n)]
    whole = parts + [F.lit(x) for x in (1, 1, 1, 0, 0, 0)[n:]]
    return F.when(whole[5] < 60, F.try_make_timestamp_ntz(*whole))


def _first_moment(*options: tuple[Column, float]) -> Column:
    of = lambda when, sure: _bound(when, lambda w: F.when(w.isNotNull(), _value("datetime", sure, datetime_value=w)))
    return F.coalesce(*(of(when, sure) for when, sure in options))


def parse_datetime(text: Column) -> Column:
    """A date somewhere in the text, with or without a time; or a year from 1970 to 2099 at its start."""
    dashed = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[年月]", "-"), "日", ""), "-+", "-")
    plain = F.regexp_replace(dashed, "^-|-$", "")
    day, minute = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"[\sT]+(\d{1,2}):(\d{1,2})"
    year = F.regexp_extract(plain, r"^(\d{4})(?:[^\d]|$)", 1).try_cast("int")
    in_years = year.between(1970, 2099) & ~F.lower(text).rlike("|".join(AMOUNT_MARKS).lower())
    return _first_moment(
        (_moment(plain, day + minute + r":(\d{1,2})", 6), 0.98), (_moment(plain, day + minute, 5), 0.95), (_moment(plain, day, 3), 0.98),
        (_moment(plain, r"(\d{4})-(\d{1,2})(?:[^\d]|$)", 2), 0.90), (F.when(in_years, _moment(plain, r"^(\d{4})(?:[^\d]|$)", 1)), 0.85),
    )


def parse_compact_datetime(text: Column) -> Column:
    """14, 12, 8 or 6 digits and nothing else."""
    two = r"(\d{2})"
    return _first_moment(*((_moment(text, r"^(\d{4})" + two * n + "$", n + 1), sure) for n, sure in ((5, 0.95), (4, 0.92), (2, 0.95), (1, 0.90))))


def numeral_value(text: Column) -> Column:
    """A number in Chinese numerals, read from the right; a bare ten in front adds nothing, null if nothing is added."""
    known = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("unit"))

    def add(state: Column, numeral: Column) -> Column:
        n = F.try_element_at(known, numeral).cast("double")
        unit = F.when(n < 10, state["unit"]).when(n > state["unit"], n).otherwise(state["unit"] * n)
        return F.struct(F.when(n < 10, state["total"] + n * state["unit"]).otherwise(state["total"]).alias("total"), unit.alias("unit"))

    total = F.aggregate(F.reverse(F.split(text, "")), start, add, lambda s: s["total"])
    return F.when(text.rlike(f"^[{''.join(NUMERALS)}]+$"), F.nullif(total, F.lit(0.0)))


def _typed_number(value: Column, written: Column, unit: Column, confidence: float, force: str | None) -> Column:
    """int or float; whole numbers are int unless ``force`` says otherwise, and int refuses a point or an exponent."""
    fits = F.lit(True) if force != "int" else ~written.rlike("[.eE]")

    def typed(n: Column) -> Column:
        is_int = F.lit(force == "int") if force else n == F.floor(n)
        as_int = F.when(is_int & (F.abs(n) < 9e18), F.floor(n))
        return F.when(n.isNotNull() & fits, _value(F.when(is_int, "int").otherwise("float"), confidence, unit, int_value=as_int, float_value=F.when(~is_int, n)))

    return _bound(value, typed)


def parse_number(text: Column, unit: str | None = None, force: str | None = None) -> Column:
    """A number with an optional unit whose factor is applied; or up to six Chinese numerals.

    With ``unit`` a number before that unit, and an optional measure word, is tried first
    and kept as written. ``force`` is int or float.
    """
    pattern = f"^{NUMBER}\\s*([a-zA-Z一-龥]*)$"
    written = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    found = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    factors = F.create_map(*(F.lit(x) for name, factor in UNIT_FACTORS.items() for x in (name, float(factor))))
    value = written.try_cast("double") * F.coalesce(F.try_element_at(factors, found), F.lit(1.0))
    none = F.lit(None).cast("string")
    numerals = F.when(F.length(text) <= 6, numeral_value(text))
    options = [_typed_number(value, written, found, 0.95, force), _typed_number(numerals, F.lit(""), none, 0.85, force)]
    if unit:
        options = [parse_with_unit(text, unit, force), *options]
    return F.coalesce(*options)


def parse_with_unit(text: Column, unit: str, force: str | None = None) -> Column:
    """A number, or Chinese numerals, directly before the given unit or a measure word and the unit."""
    ending = f"(?:{'|'.join(MEASURES)})?\\Q{unit}\\E$"
    written = F.regexp_replace(F.regexp_extract(text, f"(?i)^{NUMBER}{ending}", 1), ",", "")
    value = written.try_cast("double")
    has_point = written.rlike("[.eE]")
    kind = F.lit(force) if force else F.when(has_point, "float").otherwise("int")
    fits = value.isNotNull() & (~has_point if force == "int" else F.lit(True))
    plain = F.when(fits, _value(kind, 0.95, F.lit(unit), int_value=F.when((kind == "int") & (F.abs(value) < 9e18), F.floor(value)), float_value=F.when(kind == "float", value)))
    total = numeral_value(F.regexp_extract(text, f"^([{''.join(NUMERALS)}]+){ending}", 1))
    as_float = F.lit(force == "float")
    spelled = F.when(total.isNotNull(), _value(F.when(as_float, "float").otherwise("int"), 0.90, F.lit(unit), int_value=F.when(~as_float, total), float_value=F.when(as_float, total)))
    return F.coalesce(plain, spelled)


def parse_bool(text: Column) -> Column:
    """A word of truth of at most ten characters."""
    low = F.lower(text)
    truth = F.when(F.length(text) <= 10, F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False))
    return F.when(truth.isNotNull(), _value("bool", 0.95, bool_value=truth))


def parse_enum(text: Column, values: list[str]) -> Column:
    """The member that equals the text, else the first that holds it or is held by it, else UNKNOWN."""
    low = F.lower(text)
    options = F.array(*(F.lit(v) for v in values))
    near = F.get(F.filter(options, lambda v: F.contains(low, F.lower(v)) | F.contains(F.lower(v), low)), F.lit(0))
    exact = F.array_contains(options, text)
    sure = F.when(exact, 1.0).when(near.isNotNull(), 0.8).otherwise(0.0)
    return F.when(text.isNotNull(), _value("enum", sure, enum_value=F.when(exact, text).otherwise(F.coalesce(near, F.lit("UNKNOWN")))))


def parse_value(kind: Column, text: Column, constraint: str | None = None, unit: str | None = None, values: list[str] | None = None) -> Column:
    """The typed value of a text, with ``raw`` beside it; null for null and blank texts.

    Without a constraint the order is: compact dates for time types, dates, numbers,
    members of ``values``, words of truth, and the text itself. With a constraint (int,
    float, enum, datetime, bool, text) only that type is tried and may give null.
    """
    if constraint not in (None, "int", "float", "datetime", "enum", "bool", "text"):
        raise ValueError(f"no such type: {constraint}")
    as_text = _value("text", 1.0)

    def parsed(plain: Column) -> Column:
        if constraint in ("int", "float"):
            found = parse_number(plain, unit, constraint)
        elif constraint == "datetime":
            found = F.coalesce(parse_compact_datetime(plain), parse_datetime(plain))
        elif constraint == "enum":
            found = parse_enum(plain, values or [])
        elif constraint == "bool":
            found = parse_bool(plain)
        elif constraint == "text":
            found = as_text
        else:
            is_time = F.lower(F.coalesce(kind, F.lit(""))).rlike("|".join(TIME_TYPES))
            options = [F.when(is_time, parse_compact_datetime(plain)), parse_datetime(plain), parse_number(plain, unit)]
            options += [parse_enum(plain, values)] if values else []
            found = F.coalesce(*options, parse_bool(plain), as_text)
        return F.when(plain != "", found.withField("raw", plain))

    return _bound(stripped(text), parsed)


def raw_value(name: Column, value: Column, unit: Column, kind: Column) -> Column:
    """The whole text of a value that a model gave in parts: its name, with value and unit where the name lacks them."""
    name = F.coalesce(name, F.lit(""))
    has_unit = F.coalesce(unit, F.lit("")) != ""
    with_unit = lambda text: F.when(has_unit & ~F.contains(text, unit), F.concat(text, unit)).otherwise(text)
    dated = name.rlike(r"\d{4}年|\d{1,2}月|\d{1,2}日|\d{1,2}[:：点]|\d{4}-")
    return (
        F.when((kind == "text") | (F.coalesce(value, F.lit("")) == ""), name)
        .when(kind == "datetime", F.when(dated, name).otherwise(F.concat(name, value)))
        .when(name.rlike(r"\d"), with_unit(name))
        .otherwise(with_unit(F.concat(name, value)))
    )


def typed_value(kind: Column, name: Column, value_type: Column | None = None, value: Column | None = None, unit: Column | None = None) -> Column:
    """The typed columns of an entity: by the type a model gave, where it is one, else parsed from the name.

    A model's type holds even where its value cannot be read; its confidence is 0.90.
    """
    columns = lambda v: [v[c].alias(c) for c in _KINDS]
    parsed = _bound(parse_value(kind, name), lambda own: F.struct(
        F.coalesce(own["type"], F.lit("text")).alias("value_type"), F.coalesce(own["raw"], name, F.lit("")).alias("value_raw"), *columns(own),
        own["unit"].alias("value_unit"), F.coalesce(own["confidence"], F.lit(1.0)).alias("value_confidence"), F.lit("code").alias("origin"),
    ))
    if value_type is None:
        return parsed
    by_model = _bound(parse_value(kind, value), lambda given: F.struct(
        value_type.alias("value_type"), raw_value(name, value, unit, value_type).alias("value_raw"), *columns(given),
        F.coalesce(F.nullif(unit, F.lit("")), given["unit"]).alias("value_unit"), F.lit(0.90).alias("value_confidence"), F.lit("model").alias("origin"),
    ))
    return F.when(value_type.isin("text", "int", "float", "datetime", "bool", "enum"), by_model).otherwise(parsed)
