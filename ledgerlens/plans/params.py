"""Parameters of a report run: ranges, views, configuration, keys, exit codes.  No Spark."""

from __future__ import annotations

import calendar
import os
import re
import sys
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

OK, FAILED, USAGE, NO_RELAY, NO_EVENTS, BAD_KEY = 0, 1, 2, 3, 4, 5
CODES = {FAILED: "general_error", USAGE: "usage_error", NO_RELAY: "all_relays_failed", NO_EVENTS: "no_usable_events", BAD_KEY: "invalid_pubkey"}
SECTIONS, FORMATS, VIEWS, COLORS = ("fetch", "activity", "stats", "recommendations"), ("console", "plain", "json"), ("daily", "monthly", "yearly"), ("always", "never")
APP = "ledgerlens"
#: Automatic view: daily up to so many days, monthly up to so many years; a warning above so many rows.
DAILY_DAYS, MONTHLY_YEARS, WIDE_ROWS = 92, 5, 366


class UsageError(ValueError):
    """A parameter that no report can be made from (exit code 2)."""


class KeyFormatError(ValueError):
    """A public key that was given but is none (exit code 5)."""


# ---------------------------------------------------------------- keys

BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def _polymod(values: Sequence[int]) -> int:
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check


def _regroup(data: Sequence[int], old: int, new: int, pad: bool) -> list[int]:
    held, bits, out = 0, 0, []
    for v in data:
        held, bits = held << old | v, bits + old
        while bits >= new:
            bits -= new
            out.append(held >> bits & (1 << new) - 1)
    if pad and bits:
        out.append(held << new - bits & (1 << new) - 1)
    elif not pad and (bits >= old or held & (1 << bits) - 1):
        raise KeyFormatError("stray bits in the key")
    return out


def parse_pubkey(text: str) -> str:
    """A 64-digit hex key from hex or bech32 (npub) form."""
    if re.fullmatch(r"[0-9a-fA-F]{64}", text):
        return text.lower()
    low = text.lower()
    if not low.startswith("npub1") or text not in (low, text.upper()) or not set(low[5:]) <= set(BECH32):
        raise KeyFormatError(f"not a public key: {text!r} (64 hex digits or npub1... expected)")
    data = [BECH32.index(c) for c in low[5:]]
    prefix = [ord(c) >> 5 for c in "npub"] + [0] + [ord(c) & 31 for c in "npub"]
    if len(data) < 6 or _polymod(prefix + data) != 1:
        raise KeyFormatError(f"checksum of {text!r} does not hold")
    raw = bytes(_regroup(data[:-6], 5, 8, False))
    if len(raw) != 32:
        raise KeyFormatError(f"{text!r} has {len(raw)} bytes, not 32")
    return raw.hex()


def to_npub(pubkey: str) -> str:
    data = _regroup(bytes.fromhex(pubkey), 8, 5, True)
    prefix = [ord(c) >> 5 for c in "npub"] + [0] + [ord(c) & 31 for c in "npub"]
    check = _polymod(prefix + data + [0] * 6) ^ 1
    return "npub1" + "".join(BECH32[v] for v in [*data, *[check >> 5 * (5 - i) & 31 for i in range(6)]])


# ---------------------------------------------------------------- ranges


def months_back(day: date, n: int) -> date:
    """``n`` calendar months earlier, clamped to that month's last day."""
    at = day.year * 12 + day.month - 1 - n
    if at < 12:
        raise UsageError("the range reaches before year 1")
    year, month = divmod(at, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def parse_day(text: str, today: date) -> date:
    """An ISO date, or N days (today included), months or years back: 30d, 6mo, 1y."""
    m = re.fullmatch(r"([0-9]+)(d|mo|y)", text)
    try:
        if not m:
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
                raise ValueError
            return date.fromisoformat(text)
        n = int(m[1])
        if n < 1:
            raise ValueError
        if m[2] == "d":
            return today - timedelta(days=n - 1)
        return months_back(today, n if m[2] == "mo" else 12 * n)
    except (ValueError, OverflowError):
        raise UsageError(f"not a date or duration: {text!r} (YYYY-MM-DD, 30d, 6mo or 1y expected)") from None


def bucket_start(day: date, view: str) -> date:
    return day if view == "daily" else day.replace(day=1) if view == "monthly" else day.replace(month=1, day=1)


def bucket_end(day: date, view: str) -> date:
    if view == "daily":
        return day
    return day.replace(day=calendar.monthrange(day.year, day.month)[1]) if view == "monthly" else day.replace(month=12, day=31)


@dataclass(frozen=True)
class Range:
    """The grid's days, inclusive; None is open.  ``empty`` ranges have no bucket."""

    since: date | None
    until: date | None
    view: str | None
    explicit_view: bool = False

    def resolved(self, first: date | None, today: date) -> tuple[str, date, date] | None:
        """View, first and last day after defaults and snapping; None for an empty range."""
        since, until = self.since or first, self.until or today
        if since is None or since > until:
            return None
        view = self.view or auto_view(since, until)
        return view, bucket_start(since, view), bucket_end(until, view)


def auto_view(since: date, until: date) -> str:
    days = (until - since).days + 1
    return "daily" if days <= DAILY_DAYS else "monthly" if days <= MONTHLY_YEARS * 366 else "yearly"


def grid_rows(view: str, since: date, until: date) -> int:
    if view == "daily":
        return (until - since).days + 1
    months = (until.year - since.year) * 12 + until.month - since.month + 1
    return months if view == "monthly" else until.year - since.year + 1


def wide_warning(view: str, since: date, until: date) -> str | None:
    n = grid_rows(view, since, until)
    return f"the {view} view of {since} to {until} has {n} rows; a coarser view has fewer" if n > WIDE_ROWS else None


def make_range(since: str | None, until: str | None, view: str | None, today: date, explicit_view: bool) -> Range:
    """Validated before any source is read."""
    a, b = (parse_day(x, today) if x else None for x in (since, until))
    if a and a > (b or today):
        raise UsageError(f"--since {a} is later than --until {b or today}")
    if explicit_view and view:
        for day, edge, flag in ((a, bucket_start, "since"), (b, bucket_end, "until")):
            if day and edge(day, view) != day:
                raise UsageError(f"--{flag} {day} is not on a boundary of the {view} view (nearest: {edge(day, view)})")
    return Range(a, b, view, explicit_view)


def parse_sections(text: str | None) -> tuple[str, ...]:
    if text is None:
        return SECTIONS
    names = text.split(",")
    if bad := [n for n in names if n not in SECTIONS]:
        raise UsageError(f"no such section: {', '.join(bad)} (valid: {', '.join(SECTIONS)})")
    return tuple(s for s in SECTIONS if s in names)


def parse_relays(text: str) -> list[str]:
    found = [r.strip() for r in text.split(",") if r.strip()]
    if not found:
        raise UsageError("no relay is named")
    return found


# ---------------------------------------------------------------- configuration

STARTER = """# Sources of events, and the first value of their y tag.
relays = ["events.json"]
marker = "demo"
# format = "console"
# view = "monthly"
# color = "never"
"""


def config_path(directory: str | None, env: Mapping[str, str] = os.environ, system: str = sys.platform) -> Path:
    if directory:
        return Path(directory) / "config.toml"
    home = Path(env.get("HOME", "~")).expanduser()
    if system == "darwin":
        return home / "Library/Application Support" / APP / "config.toml"
    if system == "win32":
        return Path(env.get("APPDATA", str(home))) / APP / "config.toml"
    return Path(env.get("XDG_CONFIG_HOME") or home / ".config") / APP / "config.toml"


def load_config(path: Path) -> tuple[dict, str | None]:
    """The file's settings, or none of them and a warning if any part of it is wrong."""
    try:
        if not path.exists() and not path.is_symlink():
            return {}, None
        found = tomllib.loads(path.read_text(encoding="utf-8"))
        allowed = {"format": FORMATS, "view": VIEWS, "color": COLORS}
        for key, value in found.items():
            if key == "relays":
                good = isinstance(value, list) and all(isinstance(x, str) and x.strip() for x in value)
            elif key == "marker":
                good = isinstance(value, str) and bool(value)
            else:
                good = key in allowed and value in allowed[key]
            if not good:
                raise ValueError(f"bad setting {key} = {value!r}")
        if found.get("relays") == []:
            del found["relays"]
        return found, None
    except (OSError, ValueError) as e:
        return {}, f"{path} is ignored: {e}"


def init_config(path: Path, force: bool) -> None:
    if (path.exists() or path.is_symlink()) and not force:
        raise FileExistsError(f"{path} exists; --force overwrites it")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(STARTER, encoding="utf-8")


def use_color(flag: str | None, setting: str | None, tty: bool, env: Mapping[str, str] = os.environ) -> bool:
    """``flag`` and ``setting``: "always", "never" or None."""
    choice = flag or setting
    if choice == "never" or env.get("TERM") == "dumb":
        return False
    return choice == "always" or (tty and not env.get("NO_COLOR"))


def choose_format(flag: str | None, setting: str | None, color: str | None, tty: bool) -> str:
    return flag or setting or ("console" if tty or color == "always" else "plain")


def utc_today(as_of: int) -> date:
    return datetime.fromtimestamp(as_of, timezone.utc).date()
