"""Live sources: event relays over WebSocket, as a Spark data source named "relay".

A partition is a relay and a slice of time.  A relay sends at most so many events for a request,
how many it does not say, so an answer counts as whole only if it is proven: it holds fewer
events than another answer of the same relay did (``scan``).  Any other slice is cut in two at
the middle of its events and asked for again, down to single seconds; a second that cannot be
proven whole is an error.  Lost connections are opened again, ``TRIES`` times for a request.
What fails beyond that gives one row without an id whose only tag is ["error", message], beside
the slices that were whole; so a failing relay never fails the query, and never looks whole.

Options: relays (comma-separated ws:// or wss:// addresses), authors, ids, kinds
(comma-separated), tag.<name> (comma-separated values of that tag), since and until (epoch
seconds, both included), slices (partitions of that range for each relay, 1), timeout (seconds
for one request and its answer, 10).

Equality and ``in`` on id, pubkey and kind and comparisons of created_at that a query applies to
the frame become part of the request; they are also evaluated here, since relays may ignore what
they are asked.  Error rows stay, whatever is pushed.

As a stream, a relay's offset is the second of its newest event and the ids of that second; a
batch is what lies between two offsets, whichever run reads it.  A relay that fails keeps its
offset, one that fails before its first answer of a run fails the query (its offset is in the
checkpoint only), and so does a batch that cannot be read whole.  Events that a relay takes in
late, older than its newest, are not seen.

Events come as they were sent, with content and signature; ``sources.verify`` proves them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import socket
import ssl
import struct
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from statistics import median_low
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ledgerlens.schema import RAW
from ledgerlens.sources.verify import authentic

TIMEOUT, MAX_MESSAGE = 10.0, 32 << 20
#: Connections tried for one request; events of an answer after which the rest is asked for in
#: smaller slices; the least number of events at which any relay caps its answers.
TRIES, MAX_ANSWER, LEAST_CAP = 3, 50_000, 5
# Fixed value of the WebSocket protocol (RFC 6455).
GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


class Connection:
    """A WebSocket client connection with a deadline for what is asked of it."""

    def __init__(self, url: str, timeout: float) -> None:
        self.held = b""
        self.renew(timeout)
        at = urlsplit(url)
        if at.scheme not in ("ws", "wss") or not at.hostname:
            raise ValueError(f"not a ws:// or wss:// address: {url}")
        raw = socket.create_connection((at.hostname, at.port or (443 if at.scheme == "wss" else 80)), timeout)
        self.sock = ssl.create_default_context().wrap_socket(raw, server_hostname=at.hostname) if at.scheme == "wss" else raw
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        self.sock.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        while b"\r\n\r\n" not in self.held:
            self._fill()
            if len(self.held) > 1 << 16:
                raise ConnectionError("no end of the handshake")
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        lines = head.decode("latin-1").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if " 101 " not in lines[0] + " " or fields.get("sec-websocket-accept") != base64.b64encode(hashlib.sha1((key + GUID).encode()).digest()).decode():
            raise ConnectionError(f"no WebSocket at {url}: {lines[0]}")

    def renew(self, timeout: float) -> None:
        self.until = time.monotonic() + timeout

    def _fill(self) -> None:
        left = self.until - time.monotonic()
        if left <= 0:
            raise TimeoutError("timed out")
        self.sock.settimeout(left)
        data = self.sock.recv(1 << 16)
        if not data:
            raise ConnectionError("connection closed")
        self.held += data

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:
            self._fill()
        out, self.held = self.held[:n], self.held[n:]
        return out

    def send(self, payload: bytes, opcode: int = 1) -> None:
        n, mask = len(payload), os.urandom(4)
        size = bytes([0x80 | n]) if n < 126 else b"\xfe" + struct.pack(">H", n) if n < 1 << 16 else b"\xff" + struct.pack(">Q", n)
        masked = bytes(b ^ mask[i & 3] for i, b in enumerate(payload))
        self.sock.sendall(bytes([0x80 | opcode]) + size + mask + masked)

    def messages(self) -> Iterator[str]:
        """Whole text messages; pings are answered, a close ends them."""
        parts = b""
        while True:
            first, second = self._take(2)
            n = second & 127
            if n > 125:
                n = int.from_bytes(self._take(2 if n == 126 else 8), "big")
            if len(parts) + n > MAX_MESSAGE:
                raise ConnectionError("message too long")
            mask = self._take(4) if second & 128 else b"\0\0\0\0"
            data = self._take(n)
            if mask != b"\0\0\0\0":
                data = bytes(b ^ mask[i & 3] for i, b in enumerate(data))
            opcode = first & 15
            if opcode == 8:
                return
            if opcode == 9:
                self.send(data, 10)
            elif opcode in (0, 1, 2):
                parts += data
                if first & 128:
                    yield parts.decode("utf-8")
                    parts = b""

    def close(self) -> None:
        self.sock.close()


class Incomplete(ValueError):
    """What a relay sent cannot be proven to be all it has."""


@dataclass
class Session:
    """Requests to one relay, over as many connections as they need."""

    url: str
    timeout: float = TIMEOUT
    connection: Connection | None = None
    asked: int = 0
    #: The most events in an answer so far: no answer with fewer was capped.
    largest: int = 0
    probed: bool = False

    def ask(self, query: dict) -> list[dict]:
        """The events of a whole answer to one request, each once."""
        for left in reversed(range(TRIES)):
            try:
                if self.connection is None:
                    self.connection = Connection(self.url, self.timeout)
                self.connection.renew(self.timeout)
                return self._answer(self.connection, query)
            except TimeoutError:
                self.close()
                raise
            except (ConnectionError, ssl.SSLError):
                self.close()
                if not left:
                    raise
        raise AssertionError

    def _answer(self, connection: Connection, query: dict) -> list[dict]:
        self.asked += 1
        name, found = f"q{self.asked}", {}
        connection.send(json.dumps(["REQ", name, query]).encode())
        for text in connection.messages():
            said = json.loads(text)
            if not isinstance(said, list) or len(said) < 2 or said[1] != name:
                continue  # a notice, or what still comes for an earlier request
            if said[0] == "EVENT" and len(said) > 2 and isinstance(said[2], dict):
                found[str(said[2].get("id"))] = said[2]
                if len(found) < MAX_ANSWER:
                    continue
            elif said[0] == "CLOSED":
                raise ValueError(f"refused: {said[-1]}")
            elif said[0] != "EOSE":
                continue
            connection.send(json.dumps(["CLOSE", name]).encode())
            return [*found.values()]
        raise ConnectionError("closed before all events were sent")

    def close(self) -> None:
        if self.connection is not None:
            self.connection.close()
        self.connection = None


def scan(session: Session, query: dict, since: int | None, until: int | None) -> Iterator[dict]:
    """All events of a relay that match ``query`` in a slice of time (both ends included, None
    is open), each once, from answers that are proven whole."""
    todo = [(since, until)]
    while todo:
        a, b = todo.pop()
        bounds = {k: v for k, v in (("since", a), ("until", b)) if v is not None}
        events = session.ask({**query, **bounds})
        dated = [e["created_at"] for e in events if type(e.get("created_at")) is int]
        if any(a is not None and t < a or b is not None and t > b for t in dated):
            raise Incomplete("the relay ignores the times it is asked for")
        known, n = session.largest, len(events)
        session.largest = max(known, n)
        if n < max(known, LEAST_CAP) or not dated:
            yield from events
            continue
        first, last = min(dated), max(dated)
        if first < last:
            middle = min(median_low(dated), last - 1)
            todo += [(a, middle), (middle + 1, b)]
        elif a == b:
            if not session.probed:  # any more events, whoever wrote them, prove the second whole
                session.probed = True
                more = session.ask({**{k: v for k, v in query.items() if k == "kinds"}, "limit": 2 * n})
                session.largest = max(session.largest, len(more))
            if n >= session.largest:
                raise Incomplete(f"the relay may have more than the {n} events of second {first} that it sends at a time")
            yield from events
        else:
            todo += [(x, y) for x, y in ((a, first - 1), (first, first), (first + 1, b)) if x is None or y is None or x <= y]


def matches(e: dict, query: dict) -> bool:
    """Whether an event is what was asked for, whatever the relay makes of it."""
    for key, values in query.items():
        if key in ("ids", "authors", "kinds"):
            if e[{"ids": "id", "authors": "pubkey", "kinds": "kind"}[key]] not in values:
                return False
        elif key.startswith("#") and not any(t[:1] == [key[1:]] and t[1:2] and t[1] in values for t in e["tags"]):
            return False
    return True


def row(e: dict, relay: str, query: dict) -> tuple | None:
    """An event as a row; None if it is malformed or was not asked for."""
    try:
        tags = [[str(x) for x in t] for t in e["tags"]]
        if not matches({**e, "tags": tags}, query):
            return None
        return str(e["id"]), str(e["pubkey"]), int(e["kind"]), int(e["created_at"]), tags, relay, str(e.get("content", "")), str(e["sig"])
    except (KeyError, TypeError, ValueError):
        return None


def fetch(url: str, query: dict, since: int | None = None, until: int | None = None, timeout: float = TIMEOUT) -> Iterator[tuple]:
    """The stored events of one relay that match ``query``, then an error row if it failed."""
    session = Session(url, timeout)
    try:
        yield from (made for e in scan(session, query, since, until) if (made := row(e, url, query)))
    except (OSError, ValueError) as e:
        yield None, None, None, None, [["error", str(e) or type(e).__name__]], url, None, None
    finally:
        session.close()


@dataclass
class Slice(InputPartition):
    """A relay and a slice of time.  In a stream also ids of the first second that an earlier
    batch had, and the ids that alone count of the last second."""

    url: str
    since: int | None
    until: int | None
    had: frozenset = frozenset()
    only: frozenset | None = None


@dataclass
class Request:
    """What the options ask for, narrowed by the filters that a query pushes."""

    relays: list[str]
    timeout: float
    slices: int
    since: int | None
    until: int | None
    query: dict = field(default_factory=dict)
    empty: bool = False

    @classmethod
    def of(cls, options: dict[str, str]) -> Request:
        given = {k.lower(): v for k, v in options.items()}
        split = lambda v: [x.strip() for x in v.split(",") if x.strip()]
        second = lambda k: int(given[k]) if k in given else None
        relays = split(given.get("relays", ""))
        if not relays:
            raise ValueError('option "relays" names no relay')
        query: dict = {f"#{k[4:]}": split(v) for k, v in given.items() if k.startswith("tag.")}
        query |= {k: split(given[k]) for k in ("authors", "ids") if k in given}
        if "kinds" in given:
            query["kinds"] = [int(k) for k in split(given["kinds"])]
        return cls(relays, float(given.get("timeout", TIMEOUT)), max(1, int(given.get("slices", "1"))), second("since"), second("until"), query)

    def among(self, key: str, values: list) -> None:
        kept = [v for v in values if v is not None and (key not in self.query or v in self.query[key])]
        self.query[key] = kept
        self.empty = self.empty or not kept

    def between(self, since: int | None, until: int | None) -> None:
        self.since = max((x for x in (self.since, since) if x is not None), default=None)
        self.until = min((x for x in (self.until, until) if x is not None), default=None)
        self.empty = self.empty or None not in (self.since, self.until) and self.since > self.until

    def take(self, f: Filter) -> bool:
        """Makes a filter part of the request, if a relay can evaluate it."""
        name, key = f.attribute[-1], {"pubkey": "authors", "id": "ids", "kind": "kinds"}.get(f.attribute[-1])
        if key and isinstance(f, EqualTo | In):
            self.among(key, [f.value] if isinstance(f, EqualTo) else list(f.value))
        elif name == "created_at" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.value is not None:
            low = f.value + isinstance(f, GreaterThan) if not isinstance(f, LessThan | LessThanOrEqual) else None
            high = f.value - isinstance(f, LessThan) if not isinstance(f, GreaterThan | GreaterThanOrEqual) else None
            self.between(low, high)
        else:
            return False
        return True

    def cut(self) -> list[Slice]:
        if self.empty:
            return []
        if self.slices == 1 or self.since is None or self.until is None:
            return [Slice(r, self.since, self.until) for r in self.relays]
        n = min(self.slices, self.until - self.since + 1)
        at = [self.since + (self.until - self.since + 1) * i // n for i in range(n + 1)]
        return [Slice(r, a, b - 1) for r in self.relays for a, b in zip(at, at[1:])]


class RelayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.request = Request.of(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        taken = {f.attribute for f in filters if not isinstance(f, IsNotNull) and len(f.attribute) == 1 and self.request.take(f)} if all(hasattr(f, "attribute") for f in filters) else set()
        for f in filters:
            # What Spark adds to a comparison (is not null) would drop the error rows.
            if not (getattr(f, "attribute", None) in taken and isinstance(f, EqualTo | In | IsNotNull | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)):
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.request.cut()

    def read(self, partition: Slice | None) -> Iterator[tuple]:
        if partition is None:  # Spark's way to read no partition at all
            return iter(())
        return fetch(partition.url, self.request.query, partition.since, partition.until, self.request.timeout)


class RelayStreamReader(DataSourceStreamReader):
    """Offsets are {relay: {"at": second of the newest event, "ids": that second's ids}}."""

    def __init__(self, options: dict[str, str]) -> None:
        self.request = Request.of(options)
        self.last: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {r: {"at": -1, "ids": ""} for r in self.request.relays}

    def latestOffset(self) -> dict:
        for relay in self.request.relays:
            try:
                self.last[relay] = self._newest(relay, self.last.get(relay))
            except (OSError, ValueError) as e:
                if relay not in self.last:
                    raise RuntimeError(f"{relay}: {e}") from e
        return dict(self.last)

    def _newest(self, relay: str, last: dict | None) -> dict:
        session, query = Session(relay, self.request.timeout), self.request.query
        try:
            found = [made for e in session.ask({**query, "limit": 1}) if (made := row(e, relay, query))]
            if not found:
                return last or {"at": -1, "ids": ""}
            at = max(f[3] for f in found)
            ids = sorted(made[0] for e in scan(session, query, at, at) if (made := row(e, relay, query)))
            return {"at": at, "ids": ",".join(ids)}
        finally:
            session.close()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for relay, to in end.items():
            since = start.get(relay, {"at": -1, "ids": ""})
            if to != since and to["at"] >= since["at"]:
                out.append(Slice(relay, since["at"] if since["at"] >= 0 else None, to["at"], frozenset(since["ids"].split(",")), frozenset(to["ids"].split(","))))
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        session = Session(partition.url, self.request.timeout)
        try:
            for e in scan(session, self.request.query, partition.since, partition.until):
                made = row(e, partition.url, self.request.query)
                if made is None or made[3] == partition.since and made[0] in partition.had or made[3] == partition.until and made[0] not in partition.only:
                    continue
                yield made
        finally:
            session.close()


class RelaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "relay"

    def schema(self):
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return RelayReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RelayStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and filters of its frames part of its requests."""
    spark.dataSource.register(RelaySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _options(relays: list[str], authors: list[str] | None, kinds: list[int] | None, timeout: float, more: dict) -> dict[str, str]:
    out = {"relays": ",".join(relays), "timeout": str(timeout), **{k: str(v) for k, v in more.items() if v is not None and k in ("since", "until", "slices")}}
    out |= {"authors": ",".join(authors)} if authors else {}
    out |= {"kinds": ",".join(map(str, kinds))} if kinds else {}
    return out | {f"tag.{k}": v for k, v in more.items() if k not in ("since", "until", "slices")}


def read_live(spark: SparkSession, relays: list[str], authors: list[str] | None = None, kinds: list[int] | None = None, timeout: float = TIMEOUT, verify: bool = True, **more: str | int | None) -> DataFrame:
    """Events of live relays, filtered there; error rows included (``id`` is null).  ``more`` are
    since, until, slices and values of tags by their name.  Unless ``verify`` is false, events
    whose id or signature is not their own are left out."""
    register(spark)
    frame = spark.read.format("relay").options(**_options(relays, authors, kinds, timeout, more)).load()
    return authentic(frame) if verify else frame


def stream_live(spark: SparkSession, relays: list[str], authors: list[str] | None = None, kinds: list[int] | None = None, timeout: float = TIMEOUT, verify: bool = True, **tags: str) -> DataFrame:
    """Events of live relays as a stream, from the oldest on; see above for its offsets."""
    register(spark)
    frame = spark.readStream.format("relay").options(**_options(relays, authors, kinds, timeout, tags)).load()
    return authentic(frame) if verify else frame
