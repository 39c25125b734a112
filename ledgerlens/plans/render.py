"""One node's report as console text, plain text or JSON.  No Spark."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Sequence
from datetime import datetime, timezone

from ledgerlens.plans.params import CODES, to_npub
from ledgerlens.plans.report import MEANING, SCHEMA_VERSION, SECTIONS as GROUPS

TITLES = {"fetch": "SOURCES", "activity": "ACTIVITY", "stats": "STATISTICS", "samples": "SAMPLE EVENTS", "recommendations": "RECOMMENDATIONS"}
TIMES = ("first_seen_at", "last_successful_trade_at")
BOLD, RED, GREEN, YELLOW, CYAN, PLAIN = "\x1b[1m", "\x1b[31m", "\x1b[32m", "\x1b[33m", "\x1b[36m", "\x1b[0m"
BANDS = {"green": GREEN, "yellow": YELLOW, "red": RED}


def shown(name: str, value) -> str:
    if value is None:
        return "unknown" if name == "bond_enabled" else "not applicable"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if name in TIMES:
        return datetime.fromtimestamp(value, timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")
    if isinstance(value, (int, float)):
        return f"{value:,.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else f"{value:,}"
    return str(value)


def risky(name: str, value) -> bool:
    return value is not None and (name in ("disputes_per_100_trades", "active_disputes") and value > 0 or name == "days_since_last_trade" and value > 30 or name == "max_consecutive_inactive_days_last_30d" and value > 7)


def _lines(report: dict, relays: Sequence[dict], sections: Sequence[str]) -> list[tuple[str, str, str, bool | str]]:
    """(section, label, text, risk or the name of a band) in order; labels are empty for free
    text.  A colour only repeats what the text says."""
    out = [("identity", "Node", to_npub(report["pubkey"]), False), ("identity", "Key", report["pubkey"], False)]
    if "fetch" in sections:
        out += [("fetch", f"Source {r['relay']}", ("ok" if r["ok"] else "failed") + (f": {r['message']}" if r["message"] else "") + (f"; {r['delivered']:,} events, {r['only_here']:,} only here, {r['missing_here']:,} missing here" if "delivered" in r else ""), not r["ok"]) for r in relays]
        out += [("fetch", k.replace("_", " "), shown(k, v), False) for k, v in (report["fetch"] or {}).items()]
    if "activity" in sections:
        for row in report["activity"]:
            out.append(("activity", str(row["bucket"]), f"trades {row['trades']:,}, volume {row['volume_sats']:,} sats, median {shown('', row['median_trade_sats'])}", False))
        if not report["activity"]:
            out.append(("activity", "Grid", "no bucket in this range", False))
    if "stats" in sections:
        for group, names in [*GROUPS.items(), ("bond_policy", ("bond_enabled",))]:
            for n in names:
                value = report["stats"][group][n]
                label, meaning, better = MEANING[n]
                out.append(("stats", label, f"{shown(n, value)}{' [!]' if risky(n, value) else ''} ({meaning}; {better})", risky(n, value)))
        for group, label, key in (("fiat", "Currency", "f"), ("payment_methods", "Payment method", "method")):
            rows = report["stats"][group]
            out += [("stats", f"{label} {r[key]}", f"{r['mentions']:,} ({100 * r['share']:.1f} % of mentions)", False) for r in sorted(rows, key=lambda r: (-r["mentions"], r[key]))]
            if not rows:
                out.append(("stats", label, "not applicable", False))
        legacy = report.get("legacy", {})
        band = legacy.get("score_band", False)
        for name, value in legacy.items():
            if name == "legacy_trust_score":
                out.append(("stats", "Legacy trust score", f"{shown(name, value)}/100, {band} (older formula: age, volume and number of trades)", band))
            elif name != "score_band":
                out.append(("stats", name.replace("_", " ").capitalize(), shown(name, value), False))
    if "fetch" in sections:
        out += [("samples", f"Event {e['id'][:16]}", f"kind {e['kind']}, {shown('first_seen_at', e['created_at'])}, tags {json.dumps(e['tags'], ensure_ascii=False)}", False) for e in report.get("samples", [])]
    if "recommendations" in sections:
        out += [("recommendations", "", x, False) for x in report["recommendations"]]
    return out


def plain(report: dict, relays: Sequence[dict], sections: Sequence[str]) -> str:
    return "\n".join(f"{label or 'Note'}: {text}" for _, label, text, _ in _lines(report, relays, sections)) + "\n"


def console(report: dict, relays: Sequence[dict], sections: Sequence[str], width: int = 80, color: bool = True) -> str:
    paint = (lambda code, text: f"{code}{text}{PLAIN}") if color else (lambda code, text: text)
    out, now = [paint(CYAN, "=" * min(width, 40)), paint(BOLD, "NODE REPUTATION REPORT")], "identity"
    rows = _lines(report, relays, sections)
    wide = min(max(len(label) for _, label, _, _ in rows), max(width // 2, 10))
    for section, label, text, risk in rows:
        if section != now:
            out += ["", paint(BOLD, TITLES[section])]
            now = section
        head = f"  {label:<{wide}}  " if label else "  - "
        body = textwrap.wrap(text, max(width - len(head), 20)) or [""]
        lines = [head + body[0], *[" " * len(head) + x for x in body[1:]]]
        out += [paint(BANDS.get(risk, YELLOW), x) if risk else x for x in lines]
    return "\n".join(out) + "\n"


def as_json(report: dict, relays: Sequence[dict]) -> str:
    return json.dumps({**report, "relays": list(relays), "schema_version": SCHEMA_VERSION}, default=str, ensure_ascii=False)


def error(code: int, message: str, form: str, relays: Sequence[dict] = ()) -> str:
    """A fatal error: its own envelope in JSON, one line else."""
    if form == "json":
        return json.dumps({"schema_version": SCHEMA_VERSION, "error": {"code": CODES[code], "message": message, "relays": list(relays)}}, ensure_ascii=False)
    return f"error: {message}"
