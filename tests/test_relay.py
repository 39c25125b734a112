"""The relay source against small servers on this machine."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import socket
import struct
import threading
import time

import pytest

from ledgerlens.sources import relay as R
from ledgerlens.sources import schnorr as S
from ledgerlens.sources import verify as V
from ledgerlens.sources.events import read_relays

SECRET = 0xB7E151628AED2A6ABF7158809CF4F3C762E7160F38B4DA56A784D9045190CFEF


def sign(secret, message, nonce=12345):
    """A BIP-340 signature with a fixed nonce: for tests only."""
    x, y = S.affine(S.combined(secret, S.G, 0, S.G))
    d = secret if y % 2 == 0 else S.N - secret
    r, ry = S.affine(S.combined(nonce, S.G, 0, S.G))
    k = nonce if ry % 2 == 0 else S.N - nonce
    key, rb = x.to_bytes(32, "big"), r.to_bytes(32, "big")
    return key, rb + ((k + S.challenge(rb, key, message) * d) % S.N).to_bytes(32, "big")


KEY_BYTES = sign(SECRET, b"")[0]
KEY = KEY_BYTES.hex()


def event(n, **more):
    e = {"pubkey": KEY, "created_at": 100 + n, "kind": 38383, "tags": [["z", "order"], ["d", f"ö{n}"]], "content": 'a "quoted"\nline', **more}
    e["id"] = V.event_id(e)
    return {**e, "sig": sign(SECRET, bytes.fromhex(e["id"]))[1].hex()}


def test_published_vectors():
    """Of BIP-340: a valid signature, and a key that is on no curve point."""
    key, sig = bytes.fromhex("F9308A019258C31049344F85F89D5229B531C845836F99B08601F113BCE036F9"), bytes.fromhex("E907831F80848D1069A5371B402410364BDF1C5F8307B0084C55F1CE2DCA821525F66A4A85EA8B71E482A74F382D2CE5EBEEE8FDB2172F477DF4900D310536C0")
    assert S.verified(key, bytes(32), sig) and not S.verified(key, bytes(31) + b"\1", sig) and not S.verified(key, bytes(32), sig[:63] + b"\0")
    assert not S.verified(bytes.fromhex("EEFDEA4CDB677750A420FEE807EACF21EB9898AE79B9768766E4FAA04A2D4A34"), bytes(32), sig)
    assert not S.verified(key, bytes(32), sig[:32] + S.N.to_bytes(32, "big")) and not S.verified(key, bytes(32), S.P.to_bytes(32, "big") + sig[32:]) and not S.verified(b"", bytes(32), sig)
    for secret in (1, 2, 3, S.N - 1, SECRET):
        k, made = sign(secret, b"m" * 32, secret + 7)
        assert S.verified(k, b"m" * 32, made) and not S.verified(k, b"n" * 32, made)


def test_many_at_once_equal_one_by_one():
    rnd = random.Random(8)
    for size, wrong in ((0, 0), (1, 0), (3, 1), (40, 0), (40, 1), (60, 20), (30, 30)):
        made = []
        for i in range(size):
            message = hashlib.sha256(bytes([i, size])).digest()
            key, signature = sign(rnd.choice((SECRET, SECRET + 1, 5)), message, rnd.randrange(1, S.N))
            made.append((key, message, signature))
        for i in rnd.sample(range(size), wrong):
            key, message, signature = made[i]
            made[i] = rnd.choice([(key, message, made[i - 1][2][:32] + signature[32:]), (key, bytes(32), signature), (bytes(31) + b"\5", message, signature), (key, message, signature[:63]), (b"\xff" * 32, message, signature), (key, message, signature[:32] + S.N.to_bytes(32, "big")), (key, message, signature[:32] + bytes(32))])
        assert S.all_verified(made) == [S.verified(*m) for m in made], (size, wrong)
    # two wrong signatures whose errors cancel in an unweighted sum
    (k, m, a), (_, n, b) = [(KEY_BYTES, x, sign(SECRET, x, y)[1]) for x, y in ((b"m" * 32, 3), (b"n" * 32, 4))]
    move = lambda s, by: s[:32] + ((int.from_bytes(s[32:], "big") + by) % S.N).to_bytes(32, "big")
    pair = [(k, m, move(a, 1)), (k, n, move(b, -1)), *[(k, m, a)] * 6]
    assert S.all_verified(pair) == [False, False, *[True] * 6]


def test_many_at_once_are_much_faster():
    made = [(KEY_BYTES, m, sign(SECRET, m, i + 9)[1]) for i, m in enumerate(hashlib.sha256(bytes([i >> 8, i & 255])).digest() for i in range(1024))]

    def took(check, n):
        clock = time.perf_counter()
        assert all(check(made[:n]))
        return (time.perf_counter() - clock) / n

    ratios = [took(lambda some: [S.verified(*m) for m in some], 60) / took(S.all_verified, 1024) for _ in range(3)]
    assert max(ratios) > 5, ratios


def test_sums_of_points():
    rnd = random.Random(2)
    for n in (1, 2, 5, 70):
        terms = [(rnd.randrange(1 << rnd.choice((1, 8, 128, 256))), *S.affine(S.combined(rnd.randrange(1, 99), S.G, 0, S.G))) for _ in range(n)]
        want = S.ZERO
        for k, x, y in terms:
            want = S.add(want, S.combined(k, (x, y, 1), 0, S.G))
        got = S.summed(terms)
        assert bool(got[2]) == bool(want[2]) and (not got[2] or S.affine(got) == S.affine(want))
    assert not S.summed([(5, S.G[0], S.G[1]), (5, S.G[0], S.P - S.G[1])])[2] and not S.summed([])[2]


class Simulated:
    """Stands for a relay that sends its newest events, ``most`` at a time, over connections of
    which every ``drops``-th breaks off in the middle of an answer."""

    def __init__(self, events, most=1 << 30, drops=0, deaf=False, late=False):
        self.events, self.most, self.drops, self.deaf, self.late = sorted(events, key=lambda e: -e["created_at"]), most, drops, deaf, late
        self.opened, self.asked = 0, []

    def __call__(self, url, timeout):
        self.opened += 1
        return Line(self, self.drops and self.opened % self.drops == 0)

    def answer(self, q):
        found = [e for e in self.events if self.deaf or q.get("since", 0) <= e["created_at"] <= q.get("until", 1 << 60)]
        found = [e for e in found if "authors" not in q or e["pubkey"] in q["authors"]]
        return found[: min(self.most, q.get("limit", self.most))]


class Line:
    def __init__(self, relay, breaks):
        self.relay, self.breaks, self.request = relay, breaks, None

    def send(self, payload, opcode=1):
        what = json.loads(payload)
        if what[0] == "REQ":
            self.request = what[1:]
            self.relay.asked.append(what[2])

    def messages(self):
        name, q = self.request
        found = self.relay.answer(q)
        if self.relay.late:  # what still comes for a request of before counts for nothing
            yield said("EVENT", "q0", {"id": "x", "created_at": 1})
            yield said("EOSE", "q0")
        for i, e in enumerate(found):
            if self.breaks and i >= len(found) // 2:
                raise ConnectionError("connection closed")
            yield said("EVENT", name, e)
        yield said("EOSE", name)

    def renew(self, timeout):
        pass

    def close(self):
        pass


def plain(n, at=None, key=KEY, **more):
    """An event that nobody verifies."""
    return {"id": f"{n:064x}", "pubkey": key, "kind": 38383, "created_at": 100 + n if at is None else at, "tags": [["d", str(n)]], "content": "", "sig": "", **more}


def got(monkeypatch, relay, query=None, since=None, until=None):
    monkeypatch.setattr(R, "Connection", relay)
    rows = [*R.fetch("ws://x", query or {"kinds": [38383]}, since, until)]
    return [r[0] for r in rows if r[0]], [r[4][0][1] for r in rows if not r[0]]


@pytest.mark.parametrize("most", [5, 7, 39, 40, 41, 100])
def test_capped_answers_are_cut_until_they_are_whole(monkeypatch, most):
    for a_second in (1, 3):
        events = [plain(n, 100 + n // a_second) for n in range(40)]
        ids, errors = got(monkeypatch, Simulated(events, most, late=True))
        assert sorted(ids) == [e["id"] for e in events] and not errors
    # a slice of the time is what it says, and no event is asked for twice by two slices
    ids, errors = got(monkeypatch, Simulated(events, most), since=101, until=105)
    assert sorted(ids) == [e["id"] for e in events if 101 <= e["created_at"] <= 105] and not errors


def test_a_capped_relay_that_drops_connections(monkeypatch):
    events = [plain(n) for n in range(1200)]
    ids, errors = got(monkeypatch, Simulated(events, 500, drops=2))
    assert len(ids) == len(set(ids)) == 1200 and not errors
    ids, errors = got(monkeypatch, Simulated(events, 500, drops=1))
    assert not ids and "closed" in errors[0]


def test_what_cannot_be_proven_whole_is_an_error(monkeypatch):
    ids, errors = got(monkeypatch, Simulated([plain(n, 7) for n in range(1200)], 500))
    assert not ids and "second 7" in errors[0]
    ids, errors = got(monkeypatch, Simulated([plain(n, 7 if n < 600 else n) for n in range(1200)], 500))
    assert len(ids) == len(set(ids)) and "second 7" in errors[0]
    ids, errors = got(monkeypatch, Simulated([plain(n) for n in range(40)], 7, deaf=True))
    assert not ids and "ignores" in errors[0]


def test_one_full_second_is_whole_if_the_relay_ever_sent_more(monkeypatch):
    mine, others = [plain(n, 7) for n in range(30)], [plain(n, key="aa" * 32) for n in range(50, 100)]
    relay = Simulated(mine + others, 40)
    ids, errors = got(monkeypatch, relay, {"kinds": [38383], "authors": [KEY]})
    assert sorted(ids) == [e["id"] for e in mine] and not errors and relay.asked[-1] == {"kinds": [38383], "limit": 60}
    ids, errors = got(monkeypatch, Simulated(mine + others, 30), {"kinds": [38383], "authors": [KEY]})
    assert not ids and "30 events of second 7" in errors[0]
    assert len(got(monkeypatch, Simulated(mine[:4]))[0]) == 4 and got(monkeypatch, Simulated([])) == ([], [])


def test_long_answers_are_cut(monkeypatch):
    monkeypatch.setattr(R, "MAX_ANSWER", 100)
    ids, errors = got(monkeypatch, Simulated([plain(n) for n in range(1000)]))
    assert len(ids) == len(set(ids)) == 1000 and not errors


def test_what_was_not_asked_for_is_left_out(monkeypatch):
    events = [plain(1), plain(2, key="bb" * 32), plain(3, tags=[["z", "info"]]), {"id": 3}]
    relay = Simulated([])
    relay.answer = lambda q: events
    assert got(monkeypatch, relay, {"authors": [KEY], "#d": ["1", "2"]})[0] == [plain(1)["id"]]


def frame(text, opcode=1, final=True):
    data = text if isinstance(text, bytes) else text.encode()
    n = len(data)
    size = bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n) if n < 1 << 16 else b"\x7f" + struct.pack(">Q", n)
    return bytes([(0x80 if final else 0) | opcode]) + size + data


@pytest.fixture
def serve():
    """Starts a server that answers the handshake and then sends the given frames."""
    sockets, asked = [], []

    def go(*frames, shake=True, wait=0.0):
        server = socket.create_server(("127.0.0.1", 0))
        sockets.append(server)

        def run():
            while True:
                try:
                    c, _ = server.accept()
                except OSError:
                    return
                head = b""
                while b"\r\n\r\n" not in head:
                    head += c.recv(4096)
                key = next(x.split(": ")[1] for x in head.decode().split("\r\n") if x.startswith("Sec-WebSocket-Key"))
                if not shake:
                    c.sendall(b"HTTP/1.1 404 Not Found\r\n\r\n")
                    c.close()
                    continue
                accept = base64.b64encode(hashlib.sha1((key + R.GUID).encode()).digest()).decode()
                c.sendall(f"HTTP/1.1 101 Switching\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())
                got = c.recv(65536)
                n = got[1] & 127
                at = 2 + (2 if n == 126 else 0)
                n = struct.unpack(">H", got[2:4])[0] if n == 126 else n
                asked.append(json.loads(bytes(b ^ got[at + (i & 3)] for i, b in enumerate(got[at + 4 : at + 4 + n]))))
                for f in frames:
                    c.sendall(f)
                time.sleep(wait)
                c.close()

        threading.Thread(target=run, daemon=True).start()
        return f"ws://127.0.0.1:{server.getsockname()[1]}"

    go.asked = asked
    yield go
    for s in sockets:
        s.close()


def said(*x):
    return json.dumps(list(x))


def test_events_until_the_end_mark(serve):
    long = event(2, content="x" * 70_000)
    text = said("EVENT", "q1", event(1))
    url = serve(frame(text[:20], final=False), frame(b"hi", 9), frame(text[20:], 0), frame(said("NOTICE", "hello")), frame(said("EVENT", "other", event(5))), frame(said("EOSE", "other")), frame(said("EVENT", "q1", long)), frame(said("EVENT", "q1", {"id": 3})), frame(said("EOSE", "q1")), frame(said("EVENT", "q1", event(3))), wait=0.2)
    found = list(R.fetch(url, {"authors": [KEY], "#z": ["order"]}))
    assert [g[0] for g in found] == [event(1)["id"], long["id"]] and found[0][4][1] == ["d", "ö1"] and found[0][5] == url and found[1][6] == long["content"] and found[0][7] == event(1)["sig"]
    assert serve.asked[0] == ["REQ", "q1", {"authors": [KEY], "#z": ["order"]}]


@pytest.mark.parametrize("frames, options, words", [((), {"shake": False}, "no WebSocket"), ((frame(said("CLOSED", "q1", "auth-required")),), {}, "auth-required"), ((frame(b"\x03\xe8", 8),), {}, "closed before"), ((), {"wait": 5.0}, "timed out"), ((frame("not json"),), {}, "Expecting"), ((b"\x81",), {}, "closed")])
def test_failures_are_rows(serve, frames, options, words):
    found = list(R.fetch(serve(*frames, **options), {}, timeout=0.5))
    assert len(found) == 1 and found[0][0] is None and words in found[0][4][0][1]


def test_unreachable_and_odd_addresses():
    with socket.create_server(("127.0.0.1", 0)) as s:
        port = s.getsockname()[1]
    for url in (f"ws://127.0.0.1:{port}", "http://x", "ws://"):
        assert [g[0] for g in R.fetch(url, {}, timeout=0.5)] == [None]


def test_spark_reads_relays_and_paths_together(spark, serve, tmp_path):
    asked_for = {"tags": [["z", "order"], ["y", "demo", "x"]]}
    good = serve(frame(said("EVENT", "q1", event(1, **asked_for))), frame(said("EVENT", "q1", event(3))), frame(said("EVENT", "q1", {**event(2, **asked_for), "sig": event(1)["sig"]})), frame(said("EOSE", "q1")), wait=0.2)
    bad = serve(shake=False)
    (tmp_path / "e.json").write_text(json.dumps({k: event(7)[k] for k in ("id", "pubkey", "kind", "created_at", "tags")}))
    events, statuses = read_relays(spark, [good, bad, str(tmp_path / "e.json")], author=KEY, marker="demo")
    assert sorted(r.created_at for r in events.collect()) == [101, 107]
    assert statuses[0].message.startswith("1 events without")
    assert {s.relay: s.ok for s in statuses} == {good: True, bad: False, str(tmp_path / "e.json"): True}
    assert serve.asked[0][2] == {"#z": ["dev-fee-payment", "order", "info", "dispute"], "#y": ["demo"], "authors": [KEY], "kinds": [8383, 38383, 38385, 38386]}
    assert read_relays(spark, [bad])[0] is None


def test_unreadable_files_are_failed_sources(spark, tmp_path):
    line = json.dumps({k: event(7)[k] for k in ("id", "pubkey", "kind", "created_at", "tags")})
    (tmp_path / "good.json").write_text(line + "\n{half\n" + line)
    (tmp_path / "garbage.json").write_text("this is\nno event")
    (tmp_path / "bad.json.gz").write_bytes(b"\x1f\x8b\x08\0\0\0\0\0\0\0 no gzip at all")
    (tmp_path / "empty.json").write_text("")
    names = [str(tmp_path / n) for n in ("good.json", "garbage.json", "bad.json.gz", "empty.json", "none.json")]
    events, statuses = read_relays(spark, names, author=KEY)
    assert events.count() == 2 and [s.ok for s in statuses] == [True, False, False, True, False]
    assert "1 of 3 lines" in statuses[0].message and "none of 2 lines" in statuses[1].message and all(s.message for s in statuses if not s.ok)
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not really PAR1")
    assert read_relays(spark, [str(tmp_path / "bad.parquet")], "parquet", KEY)[0] is None


class Live:
    """A relay on this machine that evaluates ids, authors, kinds, times, tags and limit; its
    events may grow."""

    def __init__(self, events=(), most=500):
        self.events, self.most, self.asked = list(events), most, []
        self.server = socket.create_server(("127.0.0.1", 0))
        self.url = f"ws://127.0.0.1:{self.server.getsockname()[1]}"
        threading.Thread(target=self.accept, daemon=True).start()

    def accept(self):
        while True:
            try:
                c, _ = self.server.accept()
            except OSError:
                return
            threading.Thread(target=self.talk, args=(c,), daemon=True).start()

    def talk(self, c):
        head = b""
        while b"\r\n\r\n" not in head:
            head += c.recv(4096)
        key = next(x.split(": ")[1] for x in head.decode().split("\r\n") if x.startswith("Sec-WebSocket-Key"))
        accept = base64.b64encode(hashlib.sha1((key + R.GUID).encode()).digest()).decode()
        c.sendall(f"HTTP/1.1 101 Switching\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())
        f = c.makefile("rb")
        while len(first := f.read(2)) == 2:
            n = first[1] & 127
            n = struct.unpack(">H", f.read(2))[0] if n == 126 else n
            mask, data = f.read(4), f.read(n)
            what = json.loads(bytes(b ^ mask[i & 3] for i, b in enumerate(data)))
            if what[0] != "REQ":
                continue
            self.asked.append(what[2])
            c.sendall(b"".join([frame(said("EVENT", what[1], e)) for e in self.answer(what[2])]) + frame(said("EOSE", what[1])))
        c.close()

    def answer(self, q):
        def fits(e):
            for k, v in q.items():
                if k in ("ids", "authors", "kinds") and e[{"ids": "id", "authors": "pubkey", "kinds": "kind"}[k]] not in v:
                    return False
                if k[0] == "#" and not any(t[0] == k[1:] and t[1] in v for t in e["tags"]):
                    return False
            return q.get("since", 0) <= e["created_at"] <= q.get("until", 1 << 60)

        found = sorted((e for e in self.events if fits(e)), key=lambda e: -e["created_at"])
        return found[: min(self.most, q.get("limit", self.most))]

    def close(self):
        self.server.close()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_relay(spark):
    other = "bb" * 32
    relay = Live([plain(n, key=KEY if n % 2 else other, kind=(38383, 8383)[n % 4 < 2]) for n in range(60)], most=25)
    try:
        frame_ = R.read_live(spark, [relay.url, "ws://127.0.0.1:1"], kinds=[38383, 8383, 1], verify=False)
        cases = (
            (f"pubkey = '{KEY}'", {"authors": [KEY]}, lambda e: e["pubkey"] == KEY, False),
            ("kind = 8383 and created_at > 110", {"kinds": [8383], "since": 111}, lambda e: e["kind"] == 8383 and e["created_at"] > 110, False),
            ("created_at between 120 and 130", {"since": 120, "until": 130}, lambda e: 120 <= e["created_at"] <= 130, False),
            (f"pubkey in ('{KEY}', '{other}') and created_at < 109 and kind in (38383, 77)", {"authors": [KEY, other], "until": 108, "kinds": [38383]}, lambda e: e["created_at"] < 109 and e["kind"] == 38383, False),
            (f"id = '{3:064x}'", {"ids": [f"{3:064x}"]}, lambda e: e["id"] == f"{3:064x}", False),
            ("created_at = 125", {"since": 125, "until": 125}, lambda e: e["created_at"] == 125, False),
            (f"pubkey = '{KEY}' and tags[0][1] = '7'", {"authors": [KEY]}, lambda e: e["pubkey"] == KEY and e["tags"][0][1] == "7", True),
        )
        for text, asked, keep, rest in cases:
            relay.asked.clear()
            rows = frame_.filter(text).collect()
            want = sorted(e["id"] for e in relay.events if keep(e))
            assert sorted(r.id for r in rows if r.id) == want, text
            assert all(relay.asked[0].get(k) == v for k, v in asked.items()) and relay.asked[0].get("kinds", [])[:1] in ([38383], [8383]), (text, relay.asked[0])
            assert (" Filter " in plan(frame_.filter(text))) == rest, text
            # the relay that is not there is told of, where no filter on other columns removes the row
            assert rest or [r.relay for r in rows if r.id is None] == ["ws://127.0.0.1:1"]
        relay.asked.clear()
        assert frame_.filter("kind = 5 or kind = 38383").filter("id is not null").count() == 30  # the whole table, then a filter of Spark's
        assert frame_.filter("kind = 5").collect() == [] and frame_.filter("created_at > 9 and created_at < 3").collect() == []
    finally:
        relay.close()


def test_slices_of_time_are_partitions(spark):
    relay = Live([plain(n) for n in range(300)], most=40)
    try:
        df = R.read_live(spark, [relay.url], [KEY], [38383], verify=False, since=100, until=399, slices=8)
        assert df.rdd.getNumPartitions() == 8
        rows = df.collect()
        assert sorted(r.created_at for r in rows) == [*range(100, 400)] and {q["since"] for q in relay.asked} >= {100, 137}
        with pytest.raises(ValueError, match="no relay"):
            R.Request.of({})
    finally:
        relay.close()


def test_thousands_of_signed_events_pass_whatever_checking_takes(spark, monkeypatch):
    """What the network takes is on the clock of ``timeout``, what signatures take is not."""
    made = [event(n, content="") for n in range(900)]
    forged = [{**e, "content": "changed"} for e in made[:50]] + [{**e, "sig": made[0]["sig"]} for e in made[50:100]]
    relay = Live(forged + made[100:], most=2000)
    try:
        got_ = R.read_live(spark, [relay.url], [KEY], [38383], timeout=1.0).collect()
        assert sorted(r.id for r in got_) == sorted(e["id"] for e in made[100:])
        events, statuses = read_relays(spark, [relay.url], author=KEY)
        assert statuses[0].ok and statuses[0].message.startswith("100 events") and events.count() == 800
    finally:
        relay.close()


def test_dumps_are_verified_on_demand(spark, tmp_path):
    lines = [event(n) for n in range(30)]
    lines[4] = {**lines[4], "content": "changed"}
    lines[5] = {k: v for k, v in lines[5].items() if k != "sig"}
    (tmp_path / "dump.json").write_text("".join(json.dumps(e) + "\n" for e in lines))
    for author in (KEY, None):
        events, statuses = read_relays(spark, [str(tmp_path / "dump.json")], author=author, verify=True)
        assert events.count() == 28 and statuses[0].ok and "2 events" in statuses[0].message
        assert read_relays(spark, [str(tmp_path / "dump.json")], author=author)[0].count() == 30


def test_a_stream_starts_again_where_it_was(spark, tmp_path):
    """Neither lost nor repeated: restarts, events of one second in two batches, a second relay."""
    relay, second = Live([plain(n, 100 + n // 3) for n in range(40)], most=15), Live([plain(n) for n in range(500, 510)])

    def batch(*relays):
        query = R.stream_live(spark, [r.url for r in relays], [KEY], [38383], verify=False).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    try:
        assert batch(relay, second) == sorted(e["id"] for e in relay.events + second.events)
        relay.events += [plain(40, 113), plain(41, 113), plain(42, 113)]  # one more of the newest second's, twice
        assert batch(relay, second) == sorted(e["id"] for e in relay.events + second.events)
        assert batch(relay, second) == sorted(e["id"] for e in relay.events + second.events)
        relay.events += [plain(n, 100 + n) for n in range(50, 90)]
        second.events += [plain(600, 999)]
        assert batch(relay, second) == sorted(e["id"] for e in relay.events + second.events)
    finally:
        relay.close()
        second.close()


def test_offsets_of_a_stream(monkeypatch):
    relay = Simulated([plain(1), plain(2, 102), plain(3, 102)])
    monkeypatch.setattr(R, "Connection", relay)
    reader = R.RelayStreamReader({"relays": "ws://x", "kinds": "38383"})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert start == {"ws://x": {"at": -1, "ids": ""}} and end == {"ws://x": {"at": 102, "ids": f"{2:064x},{3:064x}"}}
    relay.events.insert(0, plain(4, 102))  # came after the offset was taken: of the next batch
    (piece,) = reader.partitions(start, end)
    assert [r[0] for r in reader.read(piece)] == [plain(n)["id"] for n in (2, 3, 1)]
    later = reader.latestOffset()
    (piece,) = reader.partitions(end, later)
    assert [r[0] for r in reader.read(piece)] == [plain(4)["id"]] and reader.partitions(later, later) == []
    monkeypatch.setattr(R, "Connection", Simulated([plain(1, 102)], drops=1))
    assert reader.latestOffset() == later  # a relay that fails stays where it was
    with pytest.raises(RuntimeError, match="ws://x"):
        R.RelayStreamReader({"relays": "ws://x"}).latestOffset()
    with pytest.raises(ConnectionError):
        [*reader.read(piece)]
    monkeypatch.setattr(R, "Connection", Simulated([]))
    assert R.RelayStreamReader({"relays": "ws://x"}).latestOffset() == start
