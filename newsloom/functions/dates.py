"""Calendar helpers and date phrases in search text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import as_number, ascii_digits, let, localise_digits, strip

# ---- fixed values: names used in the archive's headers and phrases ---------
MONTH_NAMES = (
    "كانون الثاني", "شباط", "آذار", "نيسان", "أيار", "حزيران",
    "تموز", "آب", "أيلول", "تشرين الأول", "تشرين الثاني", "كانون الأول",
)
MONTH_NAMES_ALT = (
    "يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو",
    "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر",
)
MONTH_SPELLINGS = {"ابريل": 4, "اغسطس": 8, "اكتوبر": 10}
DAY_NAMES = ("الإثنين", "الثلاثاء", "الأربعاء", "الخميس", "الجمعة", "السبت", "الأحد")
ENGLISH_MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
LUNAR_MONTHS = (
    "شوال", "شعبان", "رمضان", "ذي القعدة", "ذي الحجة", "محرم", "صفر",
    "ربيع الأول", "ربيع الثاني", "جمادى الأولى", "جمادى الثانية", "رجب",
)
LUNAR_MARK = "هـ"  # ends every lunar date
LUNAR_DATE = r"\d+\s+(?:" + "|".join(LUNAR_MONTHS) + r")\s+\d+\s+" + LUNAR_MARK
TODAY, YESTERDAY = "اليوم", ("أمس", "البارحة")
DAY_UNITS, WEEK_UNITS, MONTH_UNITS = ("يوم", "أيام"), ("أسبوع", "أسابيع"), ("شهر", "شهور", "أشهر")
AGO_WORDS = ("قبل", "منذ")
LAST_WEEK, LAST_MONTH, THIS_WEEK = "الأسبوع الماضي", "الشهر الماضي", "هذا الأسبوع"
# ---------------------------------------------------------------------------


def pick(names: Sequence[str], index: Column) -> Column:
    """1-based choice from a short fixed list."""
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def localised_day_name(day: Column, names: Sequence[str] = DAY_NAMES) -> Column:
    """Monday-first weekday name."""
    return pick(names, F.weekday(day) + 1)


def localised_date(day: Column, names: Sequence[str] = MONTH_NAMES, ascii_only: bool = False) -> Column:
    """``d month yyyy``, with local or ASCII digits."""
    number, year = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    if not ascii_only:
        number, year = localise_digits(number), localise_digits(year)
    return F.concat_ws(" ", number, pick(names, F.month(day)), year)


def date_label(day: Column) -> Column:
    """I10."""
    return localised_date(day, MONTH_NAMES_ALT, ascii_only=True)


def lunar_date(text: Column) -> Column:
    """First lunar date phrase, digits localised, with a full stop."""
    found = F.regexp_extract(text, "(?U)" + LUNAR_DATE, 0)
    return F.when(text.contains(LUNAR_MARK) & (found != ""), F.concat(localise_digits(found), F.lit(".")))


def week_key(day: Column) -> Column:
    """I4: ``%Y-W%W``: Monday weeks, days before the first Monday are week 00."""
    number = F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7)
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def period_key(day: Column, grouping: str) -> Column:
    """I4: daily, weekly or (anything else) monthly period."""
    if grouping == "daily":
        return F.date_format(day, "yyyy-MM-dd")
    return week_key(day) if grouping == "weekly" else month_key(day)


def hour_of(time: Column) -> Column:
    """I5."""
    return F.substring(time, 1, 2).try_cast("int")


def dow_of(day: Column) -> Column:
    """0 = Sunday."""
    return F.dayofweek(day) - 1


def shift_day(day: Column, days: int) -> Column:
    """I3."""
    return F.date_add(day, days)


def day_phase(*times: Column) -> Column:
    """Part of the day of the first non-empty time."""
    chosen = F.coalesce(*[F.nullif(t, F.lit("")) for t in times], F.lit("00:00"))
    hour = F.split(chosen, ":")[0].try_cast("int")
    # Bounds and names of the four phases.
    return F.when(hour < 5, "fajr").when(hour < 12, "sabah").when(hour < 16, "zuhr").otherwise("masaa")


def month_ordinal(day: Column, origin_year: int = 2023, origin_month: int = 9) -> Column:
    """I8: months since an origin month."""
    return (F.year(day) - origin_year) * 12 + F.month(day) - origin_month


def clamp_date(day: Column, low: Column, high: Column) -> Column:
    """I9."""
    return F.greatest(low, F.least(high, day))


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """A calendar day, or null where there is none."""
    return F.when(year != "", F.concat_ws("-", year, month, day).try_cast("date"))


def default_range(today: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The month of ``today`` inside the days that have data."""
    return (
        F.greatest(F.trunc(today, "MM"), low),
        F.least(F.last_day(today), high),
    )


# --------------------------------------------------------------------------
# Date phrases


def _without(text: Column, token: Column) -> Column:
    """Remove the first literal occurrence, collapse runs of blanks, trim."""
    at = F.instr(text, token)
    cut = F.when(
        at > 0,
        F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(token), F.length(text))),
    ).otherwise(text)
    return strip(F.regexp_replace(cut, r"(?U)\s{2,}", " "))


def _found(kind: str, start: Column, end: Column, remaining: Column, label: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), start.alias("start"), end.alias("end"),
        remaining.alias("remaining"), label.alias("label"),
    )


def _single(when: Column, day: Column, remaining: Column, label: Column | None = None) -> Column:
    return F.when(when & day.isNotNull(), _found("single", day, day, remaining, label if label is not None else date_label(day)))


def _word(body: str) -> str:
    """ASCII word boundaries, also next to letters of other scripts."""
    return rf"(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])"


def extract_date_range(query: Column, as_of: Column) -> Column:
    """The first date phrase of a search text, as
    ``struct<type, start, end, remaining, label>``.

    Eight matchers in fixed order; ``as_of`` takes the place of the clock. A
    text without a date gives type null and comes back unchanged. Days that do
    not exist are no match.
    """
    return let(F.struct(query.alias("q"), as_of.alias("d"), ascii_digits(strip(query)).alias("t")), _with_lower)


def _with_lower(ctx: Column) -> Column:
    bound = F.struct(ctx["q"].alias("q"), ctx["d"].alias("d"), ctx["t"].alias("t"), F.lower(ctx["t"]).alias("l"))
    return let(bound, lambda c: _date_range(c["q"], c["t"], c["l"], c["d"]))


def _date_range(query: Column, text: Column, low: Column, as_of: Column) -> Column:
    def grab(source: Column, pattern: str, group: int = 0) -> Column:
        return F.regexp_extract(source, "(?U)" + pattern, group)

    found: list[Column] = []

    # 1. today, yesterday
    english = grab(low, _word("today"))
    token = F.when(english != "", english).otherwise(F.lit(TODAY))
    found.append(_single((english != "") | text.contains(TODAY), as_of, _without(text, token), F.lit(TODAY)))
    local = grab(text, "|".join(YESTERDAY))
    english = grab(low, _word("yesterday"))
    token = F.when(english != "", english).otherwise(local)
    found.append(
        _single((english != "") | (local != ""), F.date_sub(as_of, 1), _without(text, token), F.lit(YESTERDAY[0]))
    )

    # 2. N units ago
    english_ago = r"([0-9]+)\s*(days?|weeks?|months?)\s+ago"
    units = "|".join(DAY_UNITS + WEEK_UNITS + MONTH_UNITS)
    local_ago = rf"(?:{'|'.join(AGO_WORDS)})\s+([0-9]+)\s+({units})"
    for source, pattern in ((low, english_ago), (text, local_ago)):
        whole, unit = grab(source, pattern), grab(source, pattern, 2)
        n = as_number(grab(source, pattern, 1))
        rest, ok = _without(text, whole), (whole != "") & n.isNotNull() & (n < 1_000_000)
        safe = F.when(ok, n).otherwise(F.lit(0))
        found.append(
            _single(
                ok & (unit.startswith("day") | unit.isin(*DAY_UNITS)), F.date_sub(as_of, safe), rest,
                F.concat(F.lit("قبل "), n.cast("string"), F.lit(" يوم")),
            )
        )
        for prefix, local_units, length, name in (("week", WEEK_UNITS, 7, "أسبوع"), ("month", MONTH_UNITS, 30, "شهر")):
            found.append(
                F.when(
                    ok & (unit.startswith(prefix) | unit.isin(*local_units)),
                    _found(
                        "range", F.date_sub(as_of, safe * length),
                        F.least(F.date_sub(as_of, (safe - 1) * length - 1), as_of), rest,
                        F.concat(F.lit("قبل "), n.cast("string"), F.lit(f" {name}")),
                    ),
                )
            )

    # 3. named periods
    monday = F.date_sub(as_of, F.weekday(as_of))
    for first, second, local_name, start in (
        ("last", "week", LAST_WEEK, F.date_sub(as_of, 7)),
        ("last", "month", LAST_MONTH, F.date_sub(as_of, 30)),
        ("this", "week", THIS_WEEK, monday),
    ):
        english = grab(low, rf"{first}\s+{second}")
        token = F.when(english != "", english).otherwise(F.lit(local_name))
        here = low.rlike("(?U)" + _word(rf"{first}\s+{second}")) | text.rlike("(?U)" + local_name.replace(" ", r"\s+"))
        found.append(F.when(here, _found("range", start, as_of, _without(text, token), F.lit(local_name))))

    # 4. year-month-day, 5. day/month/year
    iso = _word(r"([0-9]{4})-([0-9]{2})-([0-9]{2})")
    parts = [grab(text, iso, i) for i in range(4)]
    found.append(_single(parts[0] != "", valid_date(*parts[1:]), _without(text, parts[0])))
    dmy = _word(r"([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})")
    parts = [grab(text, dmy, i) for i in range(4)]
    found.append(_single(parts[0] != "", valid_date(parts[3], parts[2], parts[1]), _without(text, parts[0])))

    # 6. English month names with a day, 7. without
    names = sorted({n for m in ENGLISH_MONTHS for n in (m, m[:3])}, key=len, reverse=True)
    month = "(" + "|".join(names) + ")"

    def month_number(name: Column) -> Column:
        return F.lpad((F.array_position(F.array(*[F.lit(m[:3]) for m in ENGLISH_MONTHS]), F.substring(name, 1, 3))).cast("string"), 2, "0")

    for pattern, order in (
        (_word(month + r"\s+([0-9]{1,2}),?\s+([0-9]{4})"), (3, 1, 2)),
        (_word(r"([0-9]{1,2})\s+" + month + r"\s+([0-9]{4})"), (3, 2, 1)),
    ):
        year, name, day = (grab(low, pattern, i) for i in order)
        found.append(_single(grab(low, pattern) != "", valid_date(year, month_number(name), day), _without(text, grab(low, pattern))))
    pattern = _word(month + r"\s+([0-9]{4})")
    whole = grab(low, pattern)
    first = valid_date(grab(low, pattern, 2), month_number(grab(low, pattern, 1)), F.lit("1"))
    last = F.last_day(first)
    found.append(
        F.when(
            (whole != "") & first.isNotNull(),
            _found("range", first, last, _without(text, whole), F.concat(date_label(first), F.lit(" – "), date_label(last))),
        )
    )

    # 8. Arabic day-month-year, longest month name first
    spellings = {n: i + 1 for i, n in enumerate(MONTH_NAMES)}
    spellings.update({n: i + 1 for i, n in enumerate(MONTH_NAMES_ALT)})
    spellings.update(MONTH_SPELLINGS)
    for name in sorted(spellings, key=len, reverse=True):
        pattern = r"([0-9]{1,2})\s+" + name.replace(" ", r"\s+") + r"\s+([0-9]{4})"
        whole = grab(text, pattern)
        day = valid_date(grab(text, pattern, 2), F.lit(str(spellings[name])), grab(text, pattern, 1))
        found.append(_single(whole != "", day, _without(text, whole)))

    none = F.struct(
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("date").alias("start"),
        F.lit(None).cast("date").alias("end"), query.alias("remaining"), F.lit(None).cast("string").alias("label"),
    )
    return F.coalesce(*found, none)
