"""Command line: index, search, sessions, usage, audit, diff, atif, serve."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import functions as F

from wirespan.functions.times import GRANULARITIES, parse_when
from wirespan.operators import atif, compare, redact, trajectory, usage
from wirespan.serve import as_json, serve, started
from wirespan.session import session
from wirespan.sources import logs
from wirespan.sources.store import Store
from wirespan.sources.wire import decoded

#: Days that `usage` covers where no range is given.
DAYS = 30


def show(df, json_rows: bool) -> None:
    """All rows, read partition by partition: a JSON list, or a line each."""
    if json_rows:
        for part in as_json(started(df)):
            print(part, end="\n" if part.startswith(("[", "]", "{", ", ")) else "")
        return
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if x is None else " ".join(str(x).split()) for x in row))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wirespan")
    p.add_argument("--store", default="wirespan-store")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("paths", nargs="*", default=["."])
    for name in ("search", "sessions", "usage"):
        c = sub.add_parser(name)
        if name == "search":
            c.add_argument("query")
            c.add_argument("--in", dest="field", choices=("all", "message", "reasoning", "tool-input", "tool-output"), default="all")
        if name == "usage":
            c.add_argument("granularity", nargs="?", choices=(*GRANULARITIES, "statusline"), default="daily")
            c.add_argument("--breakdown", action="store_true")
            c.add_argument("--tz", default="UTC")
        else:
            c.add_argument("--tool")
            c.add_argument("--errored", action="store_true")
            c.add_argument("--limit", type=int, default=20)
            c.add_argument("--min-cost", type=float)
        for option in ("model", "project", "agent", "since", "until"):
            c.add_argument(f"--{option}")
    audit = sub.add_parser("audit")
    audit.add_argument("paths", nargs="*", default=["."])
    audit.add_argument("--mode", choices=("standard", "strict"), default="standard")
    audit.add_argument("--redact-check", action="store_true")
    two = sub.add_parser("diff")
    two.add_argument("a")
    two.add_argument("b")
    out = sub.add_parser("atif")
    out.add_argument("log")
    out.add_argument("--write", action="store_true", help="to a file beside the log")
    out.add_argument("--redact", choices=("off", "standard", "strict"), default="standard")
    served = sub.add_parser("serve")
    served.add_argument("--port", type=int, default=4848)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    store = Store(spark, a.store)
    filters = {}
    if a.command in ("search", "sessions", "usage"):
        tz = getattr(a, "tz", "UTC")
        filters = {"model": a.model, "project": a.project, "agent": a.agent, "since": parse_when(a.since, tz=tz) if a.since else None, "until": parse_when(a.until, True, tz) if a.until else None}
    if a.command == "index":
        print(json.dumps(store.index_paths(a.paths)))
    elif a.command == "search":
        hits = store.search(a.query, field=a.field, tool=a.tool, errored=a.errored, limit=a.limit, min_cost=a.min_cost, **filters)
        show(hits.select("session_id", "step_index", "role", "agent", "model", "score", "snippet_field", "snippet"), a.json)
    elif a.command == "sessions":
        filters["agent_part"] = filters.pop("agent")
        show(store.list_sessions(tool=a.tool, errored=a.errored, limit=a.limit, min_cost=a.min_cost, **filters), a.json)
    elif a.command == "usage":
        if a.granularity == "statusline":
            show(usage.status_line(store.usage_events(), dt.datetime.now(dt.timezone.utc).date().isoformat(), a.tz), a.json)
        else:
            if a.granularity != "total" and filters["since"] is None:
                filters["since"] = parse_when(f"{DAYS}d", tz=a.tz)
            show(usage.usage_rows(store.usage_events(**filters), a.granularity, a.breakdown, a.tz).orderBy("bucket", "label"), a.json)
    elif a.command == "audit":
        pairs = logs.pairs(spark, logs.discover(a.paths), loose=True)
        found = redact.scanned(pairs, a.mode)
        show(redact.grouped(found).orderBy(F.desc("egress_count"), "first_ts", "fingerprint"), a.json)
        if a.redact_check:
            show(redact.redact_check(pairs), a.json)
        return int(redact.audit_totals(found).first().total_egress > 0)
    elif a.command == "diff":
        show(run_diff(spark, a.a, a.b), a.json)
    elif a.command == "atif":
        turns = trajectory.conversations(decoded(logs.pairs_or_fail(spark, [a.log])))
        docs = [json.loads(r.document) for r in atif.documents(turns, trajectory.steps(turns), a.redact).collect()]
        text = json.dumps(docs[0] if len(docs) == 1 else docs, indent=2, ensure_ascii=False)
        if a.write:
            with open(a.log.removesuffix(".jsonl") + ".atif.json", "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text)
    else:
        serve(store, a.port)
    return 0


def run_diff(spark, a: str, b: str):
    """section, name, a, b of everything that differs or is compared between two logs."""
    runs = [compare.run_of(decoded(logs.pairs_or_fail(spark, [path]))) for path in (a, b)]
    return compare.listed(compare.compare(*runs))


if __name__ == "__main__":
    sys.exit(main())
