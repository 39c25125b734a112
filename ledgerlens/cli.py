"""Command line: one node's report from dumped events.

    python -m ledgerlens.cli --pubkey KEY --relays a.json,b.json --marker NAME
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import threading
import time
from collections.abc import Sequence
from contextlib import contextmanager
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import grid, metrics, state
from ledgerlens.plans import params, render, report
from ledgerlens.sources.events import read_relays, typed
from ledgerlens.sources.storage import scratch

VERSION = "0.1.0"
ENV_KEY, ENV_RELAYS, ENV_MARKER = "LEDGERLENS_PUBKEY", "LEDGERLENS_RELAYS", "LEDGERLENS_MARKER"
ENV_LOG = "LEDGERLENS_LOG"  # Spark's log level


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlens", description="Reputation report of one node from its signed events.")
    p.add_argument("-p", "--pubkey", help=f"the node, as 64 hex digits or npub (or {ENV_KEY})")
    p.add_argument("-r", "--relays", help=f"comma-separated sources of events: paths, or ws:// and wss:// addresses (or {ENV_RELAYS}, or the configuration file)")
    p.add_argument("-m", "--marker", help=f"first value of the y tag of events in scope (or {ENV_MARKER}, or the configuration file)")
    p.add_argument("--input-format", default="json", help="format of the sources, as Spark names it")
    p.add_argument("--since", help="first day of the activity grid: YYYY-MM-DD, 30d, 6mo, 1y")
    p.add_argument("--until", help="last day of the activity grid")
    p.add_argument("--view", choices=params.VIEWS, help="bucket of the activity grid")
    p.add_argument("--sections", help=f"comma-separated, of {','.join(params.SECTIONS)}")
    p.add_argument("--format", choices=params.FORMATS)
    p.add_argument("--color", action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true", help="no progress narration")
    p.add_argument("-d", "--config-dir", help="where config.toml is")
    p.add_argument("--init-config", action="store_true", help="write a starter config.toml and exit")
    p.add_argument("--force", action="store_true", help="with --init-config: overwrite")
    p.add_argument("--as-of", type=int, help="the report's instant in epoch seconds (now)")
    p.add_argument("--legacy", action="store_true", help="add the older score, its band, activity label and age in words")
    p.add_argument("--samples", type=int, default=0, metavar="N", help="add the node's first N events with their tags")
    p.add_argument("--verify", action="store_true", help="check ids and signatures of dumped events as well (they need content and sig)")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    path = params.config_path(args.config_dir)
    if args.init_config:
        try:
            params.init_config(path, args.force)
            return params.OK
        except OSError as e:
            print(f"error: {e}", file=err)
            return params.FAILED
    config, warning = params.load_config(path)
    if warning:
        print(f"warning: {warning}", file=err)
    tty = bool(getattr(out, "isatty", lambda: False)())
    color = "always" if args.color else "never" if args.no_color else None
    form = params.choose_format(args.format, config.get("format"), color, tty)

    def fail(code: int, message: str, relays: Sequence[dict] = ()) -> int:
        print(render.error(code, message, form, relays), file=out if form == "json" else err)
        return code

    as_of = args.as_of if args.as_of is not None else int(time.time())
    today = params.utc_today(as_of)
    try:
        if args.force:
            raise params.UsageError("--force goes with --init-config only")
        if args.color and args.no_color:
            raise params.UsageError("--color and --no-color contradict each other")
        key = args.pubkey or os.environ.get(ENV_KEY)
        if not key:
            raise params.UsageError(f"no public key: give --pubkey or {ENV_KEY}")
        sections = params.parse_sections(args.sections)
        wanted = params.make_range(args.since, args.until, args.view or config.get("view"), today, args.view is not None)
        named = args.relays or os.environ.get(ENV_RELAYS)
        relays = params.parse_relays(named) if named else config.get("relays")
        if not relays:
            raise params.UsageError(f"no source: give --relays, {ENV_RELAYS} or a configuration file")
        marker = args.marker or os.environ.get(ENV_MARKER) or config.get("marker")
        if not marker:
            raise params.UsageError(f"no protocol marker: give --marker, {ENV_MARKER} or a configuration file")
        pubkey = params.parse_pubkey(key)
    except params.UsageError as e:
        return fail(params.USAGE, str(e))
    except params.KeyFormatError as e:
        return fail(params.BAD_KEY, str(e))
    progress = Progress(err, shown=tty and not args.quiet)
    spark = spark or SparkSession.builder.appName("ledgerlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if os.environ.get(ENV_LOG):
        spark.sparkContext.setLogLevel(os.environ[ENV_LOG].upper())
    with progress.stage(f"Reading events from {len(relays)} source(s)"):
        events, said = read_relays(spark, relays, args.input_format, pubkey, marker, args.verify)
    statuses = [vars(s) for s in said]
    for s in said:
        if s.message:
            print(f"warning: {s.relay}: {s.message}", file=err)
    if events is None:
        return fail(params.NO_RELAY, "no source could be read", statuses)
    # One node's events are few against the sources: they are kept while the report is made.
    sent = state.in_scope(typed(events), marker, pubkey).persist()
    mine = state.unique_events(sent).persist()
    try:
        for r in metrics.source_coverage(sent).collect():
            next(s for s in statuses if s["relay"] == r["relay"]).update(delivered=r["delivered"], only_here=r["only_here"], missing_here=r["missing_here"])
        with progress.stage("Computing the report"), scratch(spark):
            made, warning = node_report(mine, as_of, wanted, today, args.legacy)
            if made and args.samples > 0:
                made["samples"] = sample_events(events.filter(F.col("pubkey") == pubkey), args.samples)
    finally:
        mine.unpersist()
        sent.unpersist()
    if made is None:
        return fail(params.NO_EVENTS, f"no usable event of {pubkey} in {len([s for s in said if s.ok])} source(s)", statuses)
    if warning:
        print(f"warning: {warning}", file=err)
    if form == "json":
        print(render.as_json(made, statuses), file=out)
    elif form == "plain":
        print(render.plain(made, statuses, sections), end="", file=out)
    else:
        width = shutil.get_terminal_size((80, 24)).columns
        print(render.console(made, statuses, sections, width, params.use_color(color, config.get("color"), tty)), end="", file=out)
    return params.OK


class Progress:
    """A line on the terminal that tells what goes on, once it has taken ``after`` seconds."""

    def __init__(self, err, shown: bool, after: float = 2.0) -> None:
        self.err, self.shown, self.after = err, shown, after

    @contextmanager
    def stage(self, what: str):
        done = threading.Event()

        def tell() -> None:
            began, wait = time.monotonic(), self.after
            while not done.wait(wait):
                wait = 0.5
                print(f"\r{what}... {time.monotonic() - began:.0f} s", end="", file=self.err, flush=True)
            if wait != self.after:
                print("\r" + " " * (len(what) + 12) + "\r", end="", file=self.err, flush=True)

        teller = threading.Thread(target=tell, daemon=True)
        if self.shown:
            teller.start()
        try:
            yield
        finally:
            done.set()
            if self.shown:
                teller.join()


def sample_events(events, n: int) -> list[dict]:
    """The first ``n`` events by time, with their tags."""
    rows = events.dropDuplicates(["id"]).orderBy("created_at", "id").limit(n).select("id", "kind", "created_at", "tags").collect()
    return [r.asDict() for r in rows]


def node_report(events, as_of: int, wanted: params.Range, today: date, legacy: bool = False) -> tuple[dict | None, str | None]:
    """The nested report of the only node in ``events`` and a warning about its grid."""
    past, facts = state.not_future(events, as_of), report.latest_states(events, as_of)
    trades, fees = state.successes(state.order_states(facts)), state.dev_fees(facts)
    first = fees.select("created_at").union(trades.select("created_at")).agg(F.min("created_at")).first()[0]
    resolved = wanted.resolved(params.utc_today(first) if first is not None else None, today)
    warning = params.wide_warning(*resolved) if resolved else None
    view, since, until = resolved or ("daily", date(1970, 1, 2), date(1970, 1, 1))
    buckets = grid.activity_grid(fees, trades, as_of, view, since, until)
    figures = report.metrics_of(facts, as_of)
    whole = report.whole(figures, metrics.fetch_summary(past), metrics.fiat_shares(trades), metrics.payment_shares(trades), buckets)
    row = report.as_json(whole).first()
    made = json.loads(row["json"]) if row else None
    if made and legacy:
        made["legacy"] = report.legacy_columns(figures, as_of).select(*report.LEGACY).first().asDict()
    return made, warning


if __name__ == "__main__":
    sys.exit(main())
