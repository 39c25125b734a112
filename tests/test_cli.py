from __future__ import annotations

import io
import json

import pytest

from ledgerlens import cli
from ledgerlens.plans import params as P
from tests.test_goldens import AS_OF, DAY, NODE, dispute, info, order


@pytest.fixture
def run(spark, tmp_path, monkeypatch):
    rows = [order("a", AS_OF - 40 * DAY, amt="1000000", tags=[("f", "USD"), ("pm", "SEPA", "Cash"), ("premium", "2")]), order("b", AS_OF - 39 * DAY, amt="3000000", tags=[("f", "EUR")]), dispute("x", "initiated"), info("i", 5, "true")]
    path = tmp_path / "events.json"
    names = ("id", "pubkey", "kind", "created_at", "tags")
    path.write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows) + "not json\n")
    for name in (cli.ENV_KEY, cli.ENV_RELAYS, cli.ENV_MARKER):
        monkeypatch.delenv(name, raising=False)

    def go(*args, relays=str(path), key=NODE):
        out, err = io.StringIO(), io.StringIO()
        more = [*(["-r", relays] if relays else []), *(["-p", key] if key else []), "-m", "demo", "-d", str(tmp_path / "conf"), "--as-of", str(AS_OF)]
        code = cli.main([*args, *more], spark, out, err)
        return code, out.getvalue(), err.getvalue()

    go.path = str(path)
    return go


def test_json_report(run):
    code, out, err = run("--format", "json", relays=run.path + ",/no/such/file.json")
    doc = json.loads(out)
    assert code == P.OK and doc["schema_version"] == 1 and [r["ok"] for r in doc["relays"]] == [True, False] and "/no/such/file.json" in err
    assert doc["stats"]["cumulative"] == {"total_successful_trades": 2, "total_volume_sats": 4000000}
    assert doc["stats"]["trade_statistics"]["median_trade_sats"] == 2000000 and doc["stats"]["bond_policy"] == {"bond_enabled": True}
    assert doc["fetch"]["unique_disputes"] == 1 and len(doc["activity"]) == 41
    assert doc["stats"]["premium"] == {"premium_baseline": None, "premium_dispersion": None}


def test_what_each_source_brought(run, tmp_path):
    lines = open(run.path).read().splitlines()
    second = tmp_path / "second.json"
    second.write_text("\n".join([*lines[:2], json.dumps({**json.loads(lines[0]), "id": "only-here"})]))
    code, out, _ = run("--format", "json", relays=f"{run.path},{second},/no/such")
    told = [{k: r.get(k) for k in ("ok", "delivered", "only_here", "missing_here")} for r in json.loads(out)["relays"]]
    assert code == 0 and told == [{"ok": True, "delivered": 4, "only_here": 2, "missing_here": 1}, {"ok": True, "delivered": 3, "only_here": 1, "missing_here": 2}, {"ok": False, "delivered": None, "only_here": None, "missing_here": None}]
    assert "3 events, 1 only here, 2 missing here" in run("--format", "plain", relays=f"{run.path},{second}")[1]


def test_verified_dumps(run):
    code, _, err = run("--verify")
    assert code == P.NO_EVENTS and "4 events without a valid id" in err


def test_plain_and_console(run):
    code, out, _ = run("--format", "plain", "--view", "monthly")
    assert code == 0 and "Total volume (sats): 4,000,000" in out and "[!]" in out and "\x1b" not in out and "2023-10-01: trades 2" in out
    assert all(": " in line for line in out.splitlines())
    code, out, _ = run("--color", "--sections", "stats")
    assert code == 0 and "\x1b[" in out and "STATISTICS" in out and "ACTIVITY" not in out and "npub1" in out
    code, out, _ = run("--no-color", "--format", "console", "--since", "2023-10-01", "--until", "2023-10-31")
    assert "\x1b[" not in out and "RECOMMENDATIONS" in out


def test_legacy_lines(run):
    code, out, _ = run("--legacy", "--format", "plain")
    assert code == 0 and "Legacy trust score: 5/100" in out and "Legacy status: INACTIVE" in out and "Last trade age: 1 month ago" in out
    assert "legacy" in json.loads(run("--legacy", "--format", "json")[1])


def test_exit_codes(run, tmp_path):
    assert run(key=None)[0] == P.USAGE
    assert run("--sections", "nope")[0] == P.USAGE
    assert run("--color", "--no-color")[0] == P.USAGE
    assert run("--force")[0] == P.USAGE
    assert run("--view", "weekly")[0] == P.USAGE
    assert run(key="npub1bad")[0] == P.BAD_KEY
    assert run(relays="/no/a,/no/b")[0] == P.NO_RELAY
    assert run(key="cc" * 32)[0] == P.NO_EVENTS
    code, out, _ = run("--format", "json", key="zz")
    assert code == P.BAD_KEY and json.loads(out)["error"]["code"] == "invalid_pubkey"


def test_config_and_env(run, tmp_path, monkeypatch):
    assert run("--init-config")[0] == 0 and (tmp_path / "conf/config.toml").exists()
    assert run("--init-config")[0] == P.FAILED and run("--init-config", "--force")[0] == 0
    (tmp_path / "conf/config.toml").write_text(f'relays = ["{run.path}"]\nformat = "json"\n')
    monkeypatch.setenv(cli.ENV_KEY, NODE)
    code, out, _ = run(relays=None, key=None)
    assert code == 0 and json.loads(out)["pubkey"] == NODE
    (tmp_path / "conf/config.toml").write_text("format = 3")
    code, out, err = run()
    assert code == 0 and "is ignored" in err and out.startswith("Node: ")
