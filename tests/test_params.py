from __future__ import annotations

from datetime import date

import pytest

from ledgerlens.plans import params as P

TODAY = date(2023, 11, 14)


@pytest.mark.parametrize("text, today, want", [("30d", TODAY, date(2023, 10, 16)), ("1d", TODAY, TODAY), ("1mo", date(2025, 3, 31), date(2025, 2, 28)), ("1y", date(2024, 2, 29), date(2023, 2, 28)), ("2023-01-05", TODAY, date(2023, 1, 5))])
def test_days(text, today, want):
    assert P.parse_day(text, today) == want


@pytest.mark.parametrize("text", ["0d", "30x", "-1d", "", "2023-02-30", "20230105", "99999999999d", "9999y"])
def test_bad_days(text):
    with pytest.raises(P.UsageError):
        P.parse_day(text, TODAY)


def test_ranges():
    with pytest.raises(P.UsageError):
        P.make_range("2023-02-01", "2023-01-01", None, TODAY, False)
    with pytest.raises(P.UsageError):
        P.make_range("2023-02-02", None, "monthly", TODAY, True)
    with pytest.raises(P.UsageError):
        P.make_range(None, "2023-02-27", "monthly", TODAY, True)
    assert P.make_range("2023-02-02", None, "monthly", TODAY, False).resolved(None, TODAY) == ("monthly", date(2023, 2, 1), date(2023, 11, 30))
    assert P.make_range("2023-02-01", "2023-02-28", "monthly", TODAY, True).resolved(None, TODAY) == ("monthly", date(2023, 2, 1), date(2023, 2, 28))
    assert P.make_range(None, "2020-01-01", "yearly", TODAY, False).resolved(date(2021, 5, 5), TODAY) is None
    assert P.make_range(None, None, None, TODAY, False).resolved(None, TODAY) is None
    assert [P.auto_view(date(2023, 1, 1), d) for d in (date(2023, 3, 1), date(2025, 1, 1), date(2033, 1, 1))] == ["daily", "monthly", "yearly"]
    assert P.wide_warning("daily", date(2020, 1, 1), date(2023, 1, 1)) and not P.wide_warning("monthly", date(2020, 1, 1), date(2023, 1, 1))


def test_keys():
    key = "3bf0c63fcb93463407af97a5e5ee64fa883d107ef9e558472c4eb9aaaefa459d"
    npub = P.to_npub(key)
    assert npub == "npub180cvv07tjdrrgpa0j7j7tmnyl2yr6yr7l8j4s3evf6u64th6gkwsyjh6w6"
    assert P.parse_pubkey(npub) == P.parse_pubkey(key.upper()) == P.parse_pubkey(npub.upper()) == key
    for bad in ("npub1", npub[:-1] + "q", key[:-1], "nsec" + npub[4:], npub[:10].upper() + npub[10:], ""):
        with pytest.raises(P.KeyFormatError):
            P.parse_pubkey(bad)


def test_sections_and_relays():
    assert P.parse_sections(None) == P.SECTIONS and P.parse_sections("stats,fetch") == ("fetch", "stats")
    with pytest.raises(P.UsageError, match="valid: fetch"):
        P.parse_sections("Stats")
    assert P.parse_relays(" a , b,") == ["a", "b"]


def test_config(tmp_path):
    path = P.config_path(str(tmp_path))
    assert P.load_config(path) == ({}, None)
    P.init_config(path, False)
    assert P.load_config(path) == ({"relays": ["events.json"], "marker": "demo"}, None)
    with pytest.raises(FileExistsError):
        P.init_config(path, False)
    P.init_config(path, True)
    for bad in ('format = "xml"', "relays = [1]", "other = 1", "not toml", 'color = "maybe"'):
        path.write_text('view = "daily"\n' + bad)
        found, warning = P.load_config(path)
        assert found == {} and str(path) in warning
    path.write_text("relays = []\nview = 'daily'")
    assert P.load_config(path) == ({"view": "daily"}, None)
    assert str(P.config_path(None, {"XDG_CONFIG_HOME": "/x"}, "linux")) == "/x/ledgerlens/config.toml"
    assert str(P.config_path(None, {"HOME": "/h"}, "darwin")).startswith("/h/Library")


def test_color_and_format():
    assert P.use_color(None, None, True, {}) and not P.use_color(None, None, False, {}) and not P.use_color(None, None, True, {"NO_COLOR": "1"})
    assert P.use_color("always", None, False, {"NO_COLOR": "1"}) and not P.use_color("always", None, True, {"TERM": "dumb"}) and not P.use_color("never", "always", True, {})
    assert [P.choose_format(*a) for a in (("json", "plain", None, True), (None, "plain", "always", True), (None, None, None, True), (None, None, None, False), (None, None, "always", False))] == ["json", "plain", "console", "plain", "console"]
