"""Points and spans of time from English words: "tomorrow", "next tuesday", "-2 weeks", "jan 12 2009 at 5pm", "x to y"."""

from __future__ import annotations

import calendar
import datetime as dt
import re

Span = tuple[dt.datetime, dt.datetime]
_UNITS = {"y": "years", "mo": "months", "w": "weeks", "d": "days", "h": "hours", "m": "minutes", "s": "seconds"}
_UNIT = r"(years?|yrs?|ys?|months?|mons?|mos?|weeks?|wks?|ws?|days?|dys?|ds?|hours?|hrs?|hs?|minutes?|mins?|ms?|seconds?|secs?|s)"
_MONTHS = {m.lower()[:3]: i for i, m in enumerate(calendar.month_name) if m}
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
_DAYS = {d.lower()[:3]: i for i, d in enumerate(calendar.day_name)}
_DAY = r"(mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs?(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b"


def add_months(d: dt.datetime, n: int) -> dt.datetime:
    """The same day n months on, or the month's last."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return d.replace(year=y, month=m + 1, day=min(d.day, calendar.monthrange(y, m + 1)[1]))


def relative_days(today: int, weekday: int, direction: int) -> int:
    """Days to the next (1) or last (-1) weekday; the same weekday is a week away."""
    if direction > 0:
        return (weekday - today) % 7 or 7
    return -((today - weekday) % 7 or 7)


def floor_of(year: int, month: int | None = None, day: int | None = None, hour: int | None = None, minute: int | None = None, second: int | None = None) -> dt.datetime:
    return dt.datetime(year, month or 1, day or 1, hour or 0, minute or 0, second or 0)


def ceil_of(year: int, month: int | None = None, day: int | None = None, hour: int | None = None, minute: int | None = None, second: int | None = None) -> dt.datetime:
    m = month or 12
    d = day or calendar.monthrange(year, m)[1]
    return dt.datetime(year, m, d, 23 if hour is None else hour, 59 if minute is None else minute, 59 if second is None else second, 999_999)


def datetime_to_long(d: dt.datetime) -> int:
    """Microseconds since the first moment that datetime knows."""
    return (d - dt.datetime.min) // dt.timedelta(microseconds=1)


def long_to_datetime(n: int) -> dt.datetime:
    return dt.datetime.min + dt.timedelta(microseconds=n)


class DateParser:
    """parse() gives the first and last moment of what is said, or None."""

    def __init__(self, basedate: dt.datetime | None = None):
        self.base = basedate or dt.datetime.now()

    def parse(self, text: str) -> Span | None:
        text = re.sub(r"\s+", " ", text.strip().lower())
        if m := re.fullmatch(r"(?:from )?(.+?) (?:to|until|-) (.+)", text):
            a, b = self._point(m[1]), self._point(m[2])
            if a and b:
                if not re.search(r"\d{4}", m[1]) and re.search(r"\d{4}", m[2]) and a[0].year != b[0].year:
                    a = tuple(x.replace(year=b[0].year) for x in a)
                if a[0] > b[1]:
                    a, b = (b, a) if a[0].date() != b[0].date() else (a, tuple(x + dt.timedelta(days=1) for x in b))
                return a[0], b[1]
        return self._point(text)

    def _point(self, text: str) -> Span | None:
        base = self.base
        if text in ("now", "right now"):
            return base, base
        if m := re.fullmatch(r"(\d{4})(?:[-/. ]?(\d{2})(?:[-/. ]?(\d{2})(?:[t ]?(\d{2})(?::?(\d{2})(?::?(\d{2}))?)?)?)?)?", text):
            return self._span(*(int(x) if x else None for x in m.groups()))
        if span := self._relative(text):
            return span
        time = None
        if m := re.search(r"(?:^| )(?:at )?(?:(\d{1,2})(?::(\d{2}))?(?::(\d{2}))? ?([ap])\.?m?\.?|(\d{1,2}):(\d{2})(?::(\d{2}))?|(noon)|(midnight))$", text):
            if m[4]:
                hour = int(m[1]) % 12 + (12 if m[4] == "p" else 0)
                time = (hour, int(m[2]) if m[2] else None, int(m[3]) if m[3] else None)
            elif m[5]:
                time = (int(m[5]), int(m[6]), int(m[7]) if m[7] else None)
            else:
                time = (12, 0, 0) if m[8] else (0, 0, 0)
            if time[0] > 23 or (time[1] or 0) > 59:
                return None
            text = text[: m.start()].strip().removesuffix(" at").rstrip(",").strip()
        day = self._day(text) if text else (base.year, base.month, base.day)
        if day is None:
            return None
        return self._span(*day, *(time or ()))

    def _span(self, *parts: int | None) -> Span | None:
        try:
            return floor_of(*parts), ceil_of(*parts)
        except ValueError:
            return None

    def _relative(self, text: str) -> Span | None:
        m = re.fullmatch(rf"([-+]?)((?: ?\d+ ?{_UNIT},?)+)( ago| from now)?", text)
        if not m or not (m[1] or m[4]):
            return None
        sign = -1 if m[1] == "-" or m[4] == " ago" else 1
        at = self.base
        for n, unit in re.findall(rf"(\d+) ?{_UNIT}", m[2]):
            key = _UNITS["mo" if unit.startswith("mo") else unit[0]]
            k = sign * int(n)
            if key == "years":
                at = add_months(at, 12 * k)
            elif key == "months":
                at = add_months(at, k)
            else:
                at += dt.timedelta(**{key: k})
        return at, at

    def _day(self, text: str) -> tuple[int | None, ...] | None:
        base = self.base
        for name, n in (("today", 0), ("tomorrow", 1), ("tmw", 1), ("yesterday", -1)):
            if text == name:
                d = base + dt.timedelta(days=n)
                return d.year, d.month, d.day
        if m := re.fullmatch(rf"(?:(next|last|this) )?{_DAY}", text):
            d = base + dt.timedelta(days=relative_days(base.weekday(), _DAYS[m[2][:3]], -1 if m[1] == "last" else 1))
            return d.year, d.month, d.day
        if m := re.fullmatch(r"(next|last|this) (year|month)", text):
            n = {"next": 1, "last": -1, "this": 0}[m[1]]
            d = add_months(base.replace(day=1), n * (12 if m[2] == "year" else 1))
            return (d.year,) if m[2] == "year" else (d.year, d.month)
        text = re.sub(rf"^{_DAY},? ", "", text)
        day, year = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4})"
        for pattern, order in (
            (rf"{_MONTH} {day}(?:,? {year})?", "mdy"), (rf"{day} (?:of )?{_MONTH}(?:,? {year})?", "dmy"), (rf"{_MONTH}(?:,? {year})?", "my"), (rf"{year} {_MONTH}(?: {day})?", "ymd"), (rf"{day}[/-](\d{{1,2}})[/-]{year}", "123"),
        ):
            m = re.fullmatch(pattern, text)
            if not m:
                continue
            g = m.groups()
            if order == "123":
                return int(g[2]), int(g[0]), int(g[1])
            got = dict(zip(order, g))
            return int(got["y"]) if got.get("y") else base.year, _MONTHS[got["m"][:3]], int(got["d"]) if got.get("d") else None
        return None
