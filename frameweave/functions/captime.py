"""Reading of written capture times: every valid interpretation of a value.

A value is read by shape (dates with colons, dashes, slashes or dots, compact
digits, mail dates, numbers since the epoch), then placed on the time line by the
offset or zone inside it, else by the zone column.  All arithmetic is on whole
microseconds; finer digits are cut off, never rounded.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

# Zone abbreviations and their minutes east of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "COT": -300,
    "AST": -240, "ADT": -180, "NST": -210, "NDT": -150, "BRT": -180, "ART": -180, "SAST": 120,
}
# Month names of mail dates.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:\s*[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_REST = r"\s*(?P<zone>.*)$"
SHAPES = (
    ("ymd", re.compile(r"(?P<y>\d{4})(?P<sep>[:\-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?:\s*[Tt]\s*|\s+)" + _TIME + _REST)),
    ("compact", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt_ \-]?(?P<H>\d{2})(?P<M>\d{2})(?:(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?!\d)" + _REST)),
    ("slash", re.compile(r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})(?:\s*[Tt,]\s*|\s+)" + _TIME + _REST)),
    ("dotted", re.compile(r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})(?:\s*[Tt,]\s*|\s+)" + _TIME + _REST)),
    ("mail", re.compile(r"(?:(?P<wd>[A-Za-z]{3}),\s*)?(?P<d>\d{1,2})\s+(?P<mon>[A-Za-z]{3})[a-z]*\s+(?P<y>\d{4})\s+" + _TIME + _REST)),
)
_NUMBER = re.compile(r"(\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:[.,](\d+))?$")
_OFFSET = re.compile(r"(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?$", re.I)
_BRACKET = re.compile(r"^(.*?)\s*\[([^\]]*)\]$")
_MICRO = 1_000_000
_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=1)
def _regions() -> dict[str, str]:
    """Lower-case names, with blanks as underscores, to the zones of the installed database."""
    return {z.lower(): z for z in available_timezones() if "/" in z and not z.lower().startswith(("posix/", "right/", "systemv/"))}


@lru_cache(maxsize=8192)
def zone_of(text: str) -> int | str | None:
    """Minutes east of UTC, the name of a region, or None for what is missing or unknown."""
    t = _clean(text).replace("\u2212", "-").replace("\u2013", "-")
    if not t:
        return None
    if t.upper() in ABBREVIATIONS:
        return ABBREVIATIONS[t.upper()]
    m = _OFFSET.match(t)
    if m:
        h, mi = int(m[2]), int(m[3] or 0)
        east = h * 60 + mi
        return None if mi > 59 or east > 14 * 60 else (-east if m[1] == "-" else east)
    return _regions().get(re.sub(r"\s+", "_", t.lower()))


def _clean(text: str) -> str:
    return re.sub(r"[\s\u00a0\u2000-\u200b\u202f\u3000]+", " ", re.sub(r"[\x00-\x08\x0e-\x1f\x7f\ufeff]", "", text)).strip()


def _micros(wall: datetime) -> int:
    d = wall - _EPOCH
    return (d.days * 86400 + d.seconds) * _MICRO + d.microseconds


@lru_cache(maxsize=65536)
def _offsets(region: str, wall: datetime) -> tuple[int, ...]:
    """Seconds east of UTC that a wall time (whole seconds) can have in a region: none in a gap, two where it occurs twice."""
    z = ZoneInfo(region)
    found = []
    for fold in (0, 1):
        off = wall.replace(tzinfo=z, fold=fold).utcoffset()
        back = (wall - off).replace(tzinfo=timezone.utc).astimezone(z).replace(tzinfo=None)
        if back == wall and int(off.total_seconds()) not in found:
            found.append(int(off.total_seconds()))
    return tuple(found)


def interpretations(value: str | None, zone: str | None, slash_orders: tuple[str, ...] = ("mdy",)) -> list[tuple[int, str]]:
    """All valid readings of a value as ``(utc_us, format)``.

    None for a null, blank, invalid or zoneless value, two where a wall time
    occurs twice in its region, and one for each allowed order of a slash date.
    """
    if value is None:
        return []
    t = _clean(value)
    if not t or not any(c.isdigit() for c in t):
        return []
    m = _NUMBER.match(t)
    if m and not (len(m[1]) == 14):
        power = {9: 6, 10: 6, 12: 3, 13: 3, 15: 0, 16: 0, 18: -3, 19: -3}[len(m[1])]
        whole = int(m[1])
        if power < 0:
            return [(whole // 1000, "epoch_ns")]
        rest = int((m[2] or "")[:power].ljust(power, "0")) if power else 0
        return [(whole * 10**power + rest, f"epoch_{ {6: 's', 3: 'ms', 0: 'us'}[power] }")]
    for shape, pattern in SHAPES:
        m = pattern.match(t)
        if not m:
            continue
        g = m.groupdict()
        month = MONTHS.get(g["mon"].lower()) if shape == "mail" else int(g["m"])
        if month is None:
            return []
        orders = slash_orders if shape == "slash" else ("",)
        out: list[tuple[int, str]] = []
        for order in orders:
            mo, d = (int(g["d"]), month) if order == "dmy" else (month, int(g["d"]))
            hour = int(g["H"])
            if g.get("ap"):
                if not 1 <= hour <= 12:
                    continue
                hour = hour % 12 + (12 if g["ap"] in "Pp" else 0)
            try:
                wall = datetime(int(g["y"]), mo, d, hour, int(g["M"]), int(g["S"] or 0))
            except ValueError:
                continue
            us = int((g.get("f") or "")[:6].ljust(6, "0"))
            inside = g["zone"].strip()
            where: int | str | None
            if inside:
                b = _BRACKET.match(inside)
                where = (zone_of(b[1]) if b[1] else zone_of(b[2])) if b else zone_of(inside)
                if where is None:
                    continue  # what stands behind the time is no zone: the value isn't a time
            else:
                where = zone_of(zone) if zone is not None else None
            if where is None:
                continue
            fmt = shape + order
            if isinstance(where, int):
                out.append((_micros(wall) - where * 60 * _MICRO + us, fmt))
            else:
                try:
                    offs = _offsets(where, wall)
                except OverflowError:
                    continue
                out += [(_micros(wall) - o * _MICRO + us, fmt) for o in offs]
        return list(dict.fromkeys(out))
    return []


__all__ = ["ABBREVIATIONS", "MONTHS", "SHAPES", "interpretations", "zone_of"]
