"""Format models of numbers and dates, compiled to columns: TO_CHAR, TO_NUMBER, TO_DATE, DEFAULT ... ON CONVERSION ERROR, VALIDATE_CONVERSION.

A model is read once, on the driver, and becomes an expression of built-in functions; rows never see it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for "an error is an error", where a default may be given.
ERROR = object()


@dataclass(frozen=True)
class NumberModel:
    """whole and part: what stands before and after the decimal point, as 9, 0 and `,`; sign: "" (before the number), S, trailing S, MI or PR."""

    whole: str
    part: str
    point: bool
    sign: str
    dollar: bool
    fill: bool

    @property
    def digits(self) -> int:
        return len(self.whole.replace(",", ""))


def number_model(model: str) -> NumberModel:
    """Reads a model of 9, 0, `,` or G, `.` or D, $, and S, MI, PR or FM; anything else is an error."""
    m = re.fullmatch(r"(?i)(FM)?(S)?(\$)?([90,G]*)(?:([.D])([90]*))?(S|MI|PR)?", model)
    if not m or (m[2] and m[7]) or not re.search("[90]", (m[4] or "") + (m[6] or "")) or (m[4] or "").startswith((",", "G", "g")):
        raise ValueError(f"not a number model: {model}")
    sign = "S" if m[2] else {"S": "trailing S"}.get((m[7] or "").upper(), (m[7] or "").upper())
    return NumberModel((m[4] or "").upper().replace("G", ","), m[6] or "", bool(m[5]), sign, bool(m[3]), not m[1])


def _masked(digits: Column, mask: str) -> Column:
    """Digits (as many as the mask has) with the mask's separators."""
    parts, at = [], 1
    for piece in re.findall(r"[90]+|,", mask):
        parts.append(F.lit(",") if piece == "," else F.substring(digits, at, len(piece)))
        at += 0 if piece == "," else len(piece)
    return F.concat(*parts) if parts else F.lit("")


def to_char_number(x: Column, model: str) -> Column:
    """A number as text, rounded half up to the model's decimals; `#` for one that does not fit; null for null and for what is no finite number."""
    m = number_model(model)
    exact = F.round(x.cast(f"decimal(38,{max(len(m.part) + 4, 10)})"), len(m.part))
    plain = F.split(F.abs(exact).cast(f"decimal(38,{len(m.part)})").cast("string"), r"\.")
    whole = F.when(plain[0] == "0", F.lit("")).otherwise(plain[0])
    part = F.get(plain, F.lit(1)) if m.part else F.lit("")
    if not m.fill and m.part:  # trailing zeros where the model has 9s go
        least = m.part.rfind("0") + 1
        part = F.concat(F.substring(part, 1, least), F.regexp_replace(F.substring(part, least + 1, len(m.part)), "0+$", ""))
    padded = F.lpad(whole, m.digits, "0") if m.digits else F.lit("")
    mask = re.sub(r"9(?=$)", "0", m.whole) if not m.point else m.whole  # without decimals a zero shows
    masked = _masked(padded, mask)
    must = mask.find("0") if "0" in mask else len(mask)
    shown = F.least(F.when(F.length(whole) > 0, F.length(masked) - F.length(F.regexp_replace(masked, r"^[0,]+", ""))).otherwise(len(mask)), F.lit(must))
    none = (F.length(part) == 0) & (F.length(masked) <= shown) & F.lit(not m.fill and m.point and m.digits > 0)  # then a zero shows
    text = F.concat(F.lit("$") if m.dollar else F.lit(""), F.when(none, "0").otherwise(F.substr(masked, shown + 1, F.lit(len(mask) or 1))), F.lit(".") if m.point else F.lit(""), part)
    minus = exact < 0
    text = {
        "": F.concat(F.when(minus, "-").otherwise(" " if m.fill else ""), text), "S": F.concat(F.when(minus, "-").otherwise("+"), text), "trailing S": F.concat(text, F.when(minus, "-").otherwise("+")),
        "MI": F.concat(text, F.when(minus, "-").otherwise(" " if m.fill else "")), "PR": F.concat(F.when(minus, "<").otherwise(" " if m.fill else ""), text, F.when(minus, ">").otherwise(" " if m.fill else "")),
    }[m.sign]
    width = len(mask) + m.point + len(m.part) + m.dollar + {"PR": 2}.get(m.sign, 1)
    full = F.lpad(text, width, " ") if m.fill else text
    return F.when(exact.isNull(), F.lit(None).cast("string")).when(F.length(whole) > m.digits, F.lit("#" * width)).otherwise(full)


def _number_pattern(m: NumberModel) -> str:
    groups = m.whole.split(",")
    grouped = f"\\d{{1,{len(groups[0])}}}" + "".join(f",\\d{{{len(g)}}}" for g in groups[1:])
    for k in range(1, len(groups)):  # fewer groups
        grouped += f"|\\d{{1,{len(groups[k])}}}" + "".join(f",\\d{{{len(g)}}}" for g in groups[k + 1 :])
    whole = f"(?:{grouped}|\\d{{0,{m.digits}}})" if len(groups) > 1 else f"\\d{{0,{m.digits}}}"
    number = (r"\$?" if m.dollar else "") + whole + (f"(?:\\.\\d{{0,{len(m.part)}}})?" if m.point else "")
    return {"": f"-?{number}", "S": f"[+-]{number}", "trailing S": f"{number}[+-]", "MI": f"{number}[- ]?", "PR": f"<{number}>|{number}"}[m.sign]


def _or_default(given: Column, made: Column, default: object, kind: str, what: str) -> Column:
    other = F.raise_error(F.concat(F.lit(f"{what}: "), given.cast("string"))).cast(kind) if default is ERROR else F.lit(default).cast(kind)
    return F.when(given.isNull(), F.lit(None).cast(kind)).when(made.isNotNull(), made).otherwise(other)


def _read_number(text: Column, model: str | None) -> Column:
    trimmed = F.trim(text)
    if model is None:
        return F.when(trimmed.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), trimmed.try_cast("decimal(38,12)"))
    m = number_model(model)
    bare = F.regexp_replace(trimmed, r"[,$<>+\- ]", "")
    minus = trimmed.rlike("[-<]")
    value = bare.try_cast("decimal(38,12)")
    return F.when(trimmed.rlike(f"^(?:{_number_pattern(m)})$") & bare.rlike(r"\d"), F.when(minus, -value).otherwise(value))


def to_number(text: Column, model: str | None = None, default: object = ERROR) -> Column:
    """A text as a decimal(38,12) by a model (none: plain decimals with an exponent). default: DEFAULT ... ON CONVERSION ERROR. A null is null."""
    return _or_default(text, _read_number(text, model), default, "decimal(38,12)", "no number")


_DATE = re.compile(r"(?i)FM|YYYY|YY|RRRR|RR|MONTH|MON|MM|MI|DDD|DD|DAY|DY|D|HH24|HH12|HH|SSSSS|SS|FF[1-6]|AM|PM|A\.M\.|P\.M\.|IW|WW|Q|J|\"[^\"]*\"|[-/,.;: ]")
#: Lengths of blank-padded names.
_NAME = 9
_MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
_MONTH_NAMES = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()


def date_model(model: str) -> list[str]:
    """A model's elements; an unknown one is an error."""
    out, at = [], 0
    while at < len(model):
        m = _DATE.match(model, at)
        if not m:
            raise ValueError(f"not a date model from here: {model[at:]}")
        out.append(m[0])
        at = m.end()
    return out


def _cased(c: Column, element: str) -> Column:
    return F.upper(c) if element.isupper() else F.lower(c) if element.islower() else F.initcap(c)


def to_char_date(x: Column, model: str) -> Column:
    """A date or timestamp as text; names are English, in the case of the model's element, and padded with blanks without FM."""
    fill, parts = True, []
    ts = x.cast("timestamp_ntz")
    number = lambda c, width: F.lpad(c.cast("string"), width, "0") if fill else c.cast("string")
    for e in date_model(model):
        u = e.upper()
        if u == "FM":
            fill = not fill
        elif u.startswith('"') or not u[0].isalpha():
            parts.append(F.lit(e.strip('"')))
        elif u in ("MONTH", "DAY"):
            name = _cased(F.date_format(ts, "MMMM" if u == "MONTH" else "EEEE"), e)
            parts.append(F.rpad(name, _NAME, " ") if fill else name)
        elif u in ("MON", "DY"):
            parts.append(_cased(F.date_format(ts, "MMM" if u == "MON" else "E"), e))
        elif u in ("AM", "PM", "A.M.", "P.M."):
            dots = "." in u
            half = F.when(F.hour(ts) < 12, "A.M." if dots else "AM").otherwise("P.M." if dots else "PM")
            parts.append(F.lower(half) if e.islower() else half)
        elif u.startswith("FF"):
            parts.append(F.substring(F.date_format(ts, "SSSSSS"), 1, int(u[2])))
        else:
            hour = F.hour(ts)
            value, width = {
                "YYYY": (F.year(ts), 4), "RRRR": (F.year(ts), 4), "YY": (F.year(ts) % 100, 2), "RR": (F.year(ts) % 100, 2), "MM": (F.month(ts), 2), "MI": (F.minute(ts), 2), "DDD": (F.dayofyear(ts), 3), "DD": (F.dayofmonth(ts), 2), "D": (F.dayofweek(ts), 1),
                "HH24": (hour, 2), "HH12": ((hour + 11) % 12 + 1, 2), "HH": ((hour + 11) % 12 + 1, 2), "SS": (F.second(ts).cast("int"), 2), "SSSSS": (hour * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int"), 5), "IW": (F.weekofyear(ts), 2),
                "WW": (F.floor((F.dayofyear(ts) - 1) / 7) + 1, 2), "Q": (F.quarter(ts), 1), "J": (F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")) + 2440588, 7),
            }[u]
            parts.append(number(value, width))
    return F.when(x.isNotNull(), F.concat(*parts))


def _read_date(text: Column, model: str, century: int) -> Column:
    pattern, groups = [], {}
    sizes = {"YYYY": r"\d{4}", "RRRR": r"\d{4}", "SSSSS": r"\d{5}", "DDD": r"\d{1,3}", "J": r"\d{1,7}"}
    for e in date_model(model):
        u = e.upper()
        if u == "FM":
            continue
        if u.startswith('"') or not u[0].isalpha():
            pattern.append(re.escape(e.strip('"')))
            continue
        if u in ("D", "Q", "WW", "IW"):
            raise ValueError(f"a date can't be read by {u}")
        kind = {"MONTH": "|".join(_MONTH_NAMES), "MON": "|".join(_MONTHS), "DAY": r"[A-Za-z]+ *", "DY": "[A-Za-z]{3}", "AM": "AM|PM", "PM": "AM|PM", "A.M.": r"A\.M\.|P\.M\.", "P.M.": r"A\.M\.|P\.M\."}.get(u) or (rf"\d{{1,{u[2]}}}" if u.startswith("FF") else sizes.get(u, r"\d{1,2}"))
        name = {"RRRR": "YYYY", "HH12": "HH", "PM": "AM", "A.M.": "AM", "P.M.": "AM", "MONTH": "MON"}.get(u, "FF" if u.startswith("FF") else u)
        if name in groups:
            raise ValueError(f"two of {name} in {model}")
        groups[name] = len(groups) + 1
        pattern.append(f"({kind})" + (" *" if u == "MONTH" else ""))
    whole = "(?i)^" + "".join(pattern) + "$"
    got = lambda name: F.regexp_extract(text, whole, groups[name])
    number = lambda name, otherwise: got(name).try_cast("int") if name in groups else F.lit(otherwise)
    short = lambda y: y + century * 100
    year = number("YYYY", None) if "YYYY" in groups else short(number("YY", 0)) if "YY" in groups else F.when(number("RR", 0) < 50, short(number("RR", 0))).otherwise(short(number("RR", 0)) - 100) if "RR" in groups else F.lit(century * 100)
    month = number("MM", 1)
    if "MON" in groups:
        month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.upper(F.substring(got("MON"), 1, 3))).cast("int")
    hour = number("HH24", 0)
    if "HH" in groups:
        half = F.upper(got("AM")).startswith("P") if "AM" in groups else F.lit(False)
        hour = F.when(number("HH", 12).between(1, 12), number("HH", 12) % 12 + F.when(half, 12).otherwise(0)).otherwise(99)
    second = number("SS", 0).cast("decimal(8,6)")
    minute = number("MI", 0)
    if "FF" in groups:
        second = second + F.concat(F.lit("0."), got("FF")).try_cast("decimal(8,6)")
    made = F.try_make_timestamp_ntz(year, month, number("DD", 1), hour, minute, second)
    if "DDD" in groups:
        first = F.try_make_timestamp_ntz(year, F.lit(1), F.lit(1), hour, minute, second)
        days = number("DDD", 1)
        made = F.when(days.between(1, 365 + ((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))).cast("int")), first + F.make_dt_interval(days - 1))
    if "J" in groups:
        made = F.try_make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), hour, minute, second) + F.make_dt_interval(number("J", 0) - 2440588)
    if "SSSSS" in groups:
        made = F.when(number("SSSSS", 0) < 86400, made + F.make_dt_interval(secs=number("SSSSS", 0).cast("decimal(18,6)")))
    return F.when(text.rlike(whole), made)


def to_date(text: Column, model: str, default: object = ERROR, century: int = 20) -> Column:
    """A text as a timestamp without zone by a model. default: DEFAULT ... ON CONVERSION ERROR. A null is null.

    Names are English, of any case; a missing month and day are the first. YY is a year of the century; RR of it below 50, else of the one before. What no calendar has (31 April, hour 24) is an error.
    """
    return _or_default(text, _read_date(text, model, century), default, "timestamp_ntz", "no date")


def validate_conversion(text: Column, kind: str, model: str | None = None) -> Column:
    """1 if a text converts to a number, date or any other type, else 0; a null converts."""
    made = _read_number(text, model) if kind == "number" else _read_date(text, model, 20) if kind == "date" else text.try_cast(kind)
    return F.when(text.isNull() | made.isNotNull(), 1).otherwise(0)


def cast_default(x: Column, kind: str, default: object = ERROR) -> Column:
    """CAST with DEFAULT ... ON CONVERSION ERROR."""
    return _or_default(x, x.try_cast(kind), default, kind, f"no {kind}")
