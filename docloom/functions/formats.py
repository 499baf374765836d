"""Format checks of strings as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the public grammars (RFC 5321/5322, 1123, 791, 4291, 4122, 3986, ISO 8601).
# Each ends with \z: Java's $ would let a last newline pass.
_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
EMAIL = rf"^[a-zA-Z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{_LABEL}(?:\.{_LABEL})*\z"
HOSTNAME = rf"^{_LABEL}(?:\.{_LABEL})*\.?\z"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IP4 = rf"^{_V4}\z"
_H = "[0-9a-fA-F]{1,4}"
IP6 = (
    "^(?:"
    + "|".join(
        [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{1,7}}:", rf"(?:{_H}:){{6}}{_V4}", rf"::(?:{_H}:){{0,5}}{_V4}", rf"(?:{_H}:){{1,5}}:{_V4}", rf":(?::{_H}){{1,7}}", "::"]
        + [rf"(?:{_H}:){{1,{7 - k}}}(?::{_H}){{1,{k}}}" for k in range(1, 7)]
    )
    + ")\\z"
)
UUID = r"^(?:urn:uuid:|URN:UUID:)?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z"
DURATION = r"^P(?!\z)(?:\d+W|(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+S)?)?)\z"
DATE = r"^(\d{4})-(\d\d)-(\d\d)\z"
TIME = r"^(\d\d):(\d\d):(\d\d(?:\.\d+)?)(?:[zZ]|([+-])(\d\d)(?::?(\d\d))?)\z"


def _uri_pattern() -> str:
    """The grammar of RFC 3986, section 3 and appendix A; a scheme alone is none."""
    name = r"[a-zA-Z0-9\-._~!$&'()*+,;="
    escaped = "%[0-9a-fA-F]{2}"
    char = rf"(?:{name}:@]|{escaped})"
    loose = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
    last = rf"(?:{_H}:{_H}|(?:{loose}\.){{3}}{loose})"
    before = [rf"(?:(?:{_H}:){{0,{k}}}{_H})?::" for k in range(7)]
    tails = [rf"(?:{_H}:){{{4 - k}}}{last}" for k in range(5)] + [_H, ""]
    address = "|".join([rf"(?:{_H}:){{6}}{last}", rf"::(?:{_H}:){{5}}{last}", *(x + y for x, y in zip(before, tails, strict=True))])
    host = rf"(?:\[(?:{address}|[vV][0-9a-fA-F]+\.{name}:]+)\]|(?:{name}]|{escaped})*)"
    authority = rf"/?/(?:(?:{name}:]|{escaped})*@)?{host}(?::\d*)?(?:/{char}*)*"
    rooted, loose_path = rf"/(?:{char}+(?:/{char}*)*)?", rf"{char}+(?:/{char}*)*"
    rest = rf"(?:{name}:@/?]|{escaped})*"
    return rf"^[a-zA-Z][a-zA-Z0-9+\-.]*:(?:{authority}|{rooted}|{loose_path})(?:\?{rest})?(?:#{rest})?\z"


URI = _uri_pattern()


def email(c: Column) -> Column:
    return c.rlike(EMAIL)


def hostname(c: Column) -> Column:
    return F.octet_length(c).between(1, 253) & c.rlike(HOSTNAME)


def ip4(c: Column) -> Column:
    return c.rlike(IP4)


def ip6(c: Column) -> Column:
    return c.rlike(IP6)


def uuid(c: Column) -> Column:
    return c.rlike(UUID)


def uri(c: Column) -> Column:
    return c.rlike(URI)


def duration(c: Column) -> Column:
    return c.rlike(DURATION)


def date(c: Column) -> Column:
    """YYYY-MM-DD of the Gregorian calendar."""
    year, month, day = (F.regexp_extract(c, DATE, k).try_cast("int") for k in (1, 2, 3))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return c.rlike(DATE) & F.coalesce(month.between(1, 12) & (day >= 1) & (day <= last), F.lit(False))


def time(c: Column) -> Column:
    """RFC 3339 time with its zone; other clock readings only in the last minute of a UTC day."""
    part = lambda k: F.coalesce(F.regexp_extract(c, TIME, k).try_cast("int"), F.lit(0))
    hour, minute, zh, zm = part(1), part(2), part(5), part(6)
    second = F.coalesce(F.regexp_extract(c, TIME, 3).try_cast("double"), F.lit(99.0))
    sign = F.when(F.regexp_extract(c, TIME, 4) == "-", -1).otherwise(1)
    utc_minute = minute - zm * sign
    utc_hour = hour - zh * sign - F.when(utc_minute < 0, 1).otherwise(0)
    plain = (hour <= 23) & (minute <= 59) & (second < 60)
    leap = utc_hour.isin(23, -1) & utc_minute.isin(59, -1) & (second < 61)
    return c.rlike(TIME) & (zh <= 23) & (zm <= 59) & (plain | leap)


def date_time(c: Column) -> Column:
    parts = F.split(c, r"[tT ]", -1)
    return (F.size(parts) == 2) & F.coalesce(date(F.get(parts, F.lit(0))) & time(F.get(parts, F.lit(1))), F.lit(False))
