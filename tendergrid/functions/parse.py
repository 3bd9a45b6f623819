"""Parsing and normalising of contract fields, as Column functions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import AGENCY_CLASSES, JV_MARKER, LEGAL_FORMS, MONTHS, NULL_WORDS, OTHER_AGENCY, WORK_GROUPS

ERA = 543
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"


def trim(x: Column) -> Column:
    """White space of any script cut at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    return trim(F.regexp_replace(x, r"(?U)\s+", " "))


def is_blank(x: Column) -> Column:
    return x.isNull() | F.lower(trim(x)).isin(*NULL_WORDS)


def arabic_digits(x: Column) -> Column:
    return F.translate(x, THAI_DIGITS, "0123456789")


def money(x: Column) -> Column:
    """Text to decimal(18,2); Thai digits, thousands separators and marks of the currency are accepted, all else is null."""
    bare = F.regexp_replace(F.regexp_replace(arabic_digits(trim(x)), ",", ""), r"(?U)^฿\s*|\s*บาท$", "")
    return F.when(~is_blank(x), bare.try_cast("double").try_cast("decimal(18,2)"))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _number(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(x, pattern, group).try_cast("int")


def thai_date(x: Column) -> tuple[Column, Column]:
    """Text to a date and the name of the format that it has: iso, thai, slash, empty or unknown.

    ISO and slash years over 2400 are of the Buddhist era, and years of two digits are too; a date with a month's
    name always is, even where its year looks like one of the common era.
    """
    t = arabic_digits(trim(x))
    iso, slash, named = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$", r"(?U)^(\d{1,2})\s+(\S+)\s+(\d{2,4})$"
    common = lambda y: F.when(y > 2400, y - ERA).otherwise(y)
    full = lambda y: F.when(y < 100, y + 2500).otherwise(y)
    month = F.element_at(F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair]), F.regexp_extract(t, named, 2))
    by_iso = _date(common(_number(t, iso, 1)), _number(t, iso, 2), _number(t, iso, 3))
    by_slash = _date(common(full(_number(t, slash, 3))), _number(t, slash, 2), _number(t, slash, 1))
    by_name = _date(full(_number(t, named, 3)) - ERA, month, _number(t, named, 1))
    kind = F.when(is_blank(x), "empty").when(t.rlike(iso), "iso").when(t.rlike(slash), "slash").when(t.rlike(named) & month.isNotNull(), "thai").otherwise("unknown")
    return F.when(kind == "iso", by_iso).when(kind == "slash", by_slash).when(kind == "thai", by_name), kind


def to_thai_date(x: Column) -> Column:
    """A date as day, short month and two digits of the Buddhist year."""
    names = F.array(*[F.lit(n) for n, _ in sorted(list(MONTHS.items())[:12], key=lambda p: p[1])])
    return F.when(x.isNotNull(), F.format_string("%d %s %02d", F.day(x), F.element_at(names, F.month(x)), (F.year(x) + ERA) % 100)).otherwise("")


def wkt_point(x: Column) -> Column:
    """WKT to a struct (lat, lon, geom_type): the mean of its vertices, null outside the country's frame."""
    numbers = F.transform(F.regexp_extract_all(x, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.cast("double"))
    pick = lambda odd: F.filter(numbers, lambda _, i: i % 2 == odd)
    mean = lambda a, n: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    n = F.floor(F.size(numbers) / 2)
    lon, lat = (F.when(n > 0, mean(F.slice(pick(k), 1, F.greatest(n, F.lit(1)).cast("int")), F.greatest(n, F.lit(1)))) for k in (0, 1))
    inside = lat.between(5, 21) & lon.between(96, 106)
    kind = F.when(~is_blank(x), F.upper(trim(F.substring_index(x, "(", 1))))
    kind = F.regexp_extract(kind, r"^([A-Z]+)", 1)
    return F.struct(F.when(inside, F.round(lat, 6)).alias("lat"), F.when(inside, F.round(lon, 6)).alias("lon"), F.when(~is_blank(x), kind).alias("geom_type"))


def point_wkt(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))).otherwise("")


def canonical_name(x: Column) -> Column:
    """A company's name without joint-venture marker and without legal forms that another legal form follows."""
    marker = rf"(?U)\(\s*{JV_MARKER}\s*\)"
    forms = "|".join(re.escape(f).replace("\\ ", " ") for f in LEGAL_FORMS)
    name = squeeze(F.regexp_replace(squeeze(F.coalesce(x, F.lit(""))), marker, ""))
    return F.regexp_replace(name, rf"^(?:(?:{forms}) )+(?=(?:{forms}))", "")


def is_joint_venture(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).contains(JV_MARKER)


def is_masked(tin: Column) -> Column:
    return F.lower(F.coalesce(tin, F.lit(""))).contains("x")


def first_group(name: Column, groups=WORK_GROUPS, other: str = "other") -> Column:
    """The first group whose pattern is found in the name."""
    out = F.lit(other)
    for key, pattern in reversed(groups):
        out = F.when(F.coalesce(name, F.lit("")).rlike(f"(?U){pattern}"), key).otherwise(out)
    return out


def all_groups(name: Column, groups) -> Column:
    """All groups whose patterns are found in the name, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(name, F.lit("")).rlike(f"(?U){pattern}"), key) for key, pattern in groups]))


def agency_class(name: Column) -> Column:
    out = F.lit(OTHER_AGENCY)
    for prefix, label in reversed(AGENCY_CLASSES):
        out = F.when(F.coalesce(name, F.lit("")).startswith(prefix), label).otherwise(out)
    return out


def method_group(method: Column) -> Column:
    m = F.coalesce(method, F.lit(""))
    return F.when(m.rlike("เฉพาะเจาะจง"), "เฉพาะเจาะจง").when(m.rlike("e-bidding|ประกวดราคา"), "e-bidding").when(m.rlike("คัดเลือก"), "คัดเลือก").otherwise("อื่น ๆ")


def place_of(name: Column) -> Column:
    """Village number and subdistrict where a name has both, else null."""
    n = F.coalesce(name, F.lit(""))
    village, area = F.regexp_extract(n, r"(?U)หมู่ที่\s*(\d+|[๐-๙]+)", 1), F.regexp_extract(n, r"(?U)(?:ตำบล|ต\.)\s*([ก-ฮ][ก-๙]*)", 1)
    return F.when((village != "") & (area != ""), F.format_string("หมู่ %s ต.%s", village, area))


def min_notice_days(project_money: Column) -> Column:
    """Days that an electronic bid of this size must be announced."""
    return F.when(project_money > 50_000_000, 20).when(project_money > 10_000_000, 12).when(project_money > 5_000_000, 10).when(project_money > 500_000, 5)


def band(score: Column) -> Column:
    return F.when(score >= 60, "critical").when(score >= 40, "high").when(score >= 20, "medium").when(score >= 0.0001, "low").otherwise("none")


def round_kind(value: Column) -> Column:
    v = F.floor(value)
    return F.when(v % 1000 == 0, "000").when(v % 100 == 0, "x00").when(v % 10 == 0, "xx0").otherwise("xxx")


def significant_round(value: Column, digits: int) -> Column:
    """True where the value has at most so many significant digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(value)) - digits + 1)
    q = value / unit
    return F.abs(q - F.round(q)) < 1e-9


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def road_area(name: Column) -> Column:
    """Square metres that a road project's name states, or its width times its length."""
    n = arabic_digits(F.coalesce(name, F.lit("")))
    number = r"(\d+(?:[,\.]\d+)*)"
    value = lambda p: F.regexp_replace(F.regexp_extract(n, p, 1), ",", "").try_cast("double")
    long_ = rf"(?U)ยาว\s*(?:รวม)?\s*{number}\s*(กิโลเมตร|กม\.|เมตร|ม\.)"
    length = value(long_) * F.when(F.regexp_extract(n, long_, 2).isin("กิโลเมตร", "กม."), 1000).otherwise(1)
    width = value(rf"(?U)กว้าง\s*(?:เฉลี่ย)?\s*{number}\s*(?:เมตร|ม\.)")
    return F.coalesce(value(rf"(?U)(?:พื้นที่|ไม่น้อยกว่า)\s*{number}\s*(?:ตารางเมตร|ตร\.\s*ม)"), width * length)
