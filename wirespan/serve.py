"""JSON over HTTP, read only: the store's operations by route, and a stream of its changes."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.functions.times import parse_when
from wirespan.operators import fleet, redact, usage
from wirespan.sources import logs
from wirespan.sources.store import Store

POLL_S = 1.5


def rows_of(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().toLocalIterator()]


def one_of(df: DataFrame) -> dict:
    return next(iter(rows_of(df.limit(1))), {})


def started(value):
    """value with each DataFrame in it as an iterator of JSON rows whose first row is computed, so that a query which fails
    does so before an answer begins."""
    if isinstance(value, DataFrame):
        rows = iter(value.toJSON().toLocalIterator())
        return chain([x for x in [next(rows, None)] if x is not None], rows)
    return {k: started(v) for k, v in value.items()} if isinstance(value, dict) else value


def as_json(value) -> Iterator[str]:
    """JSON text in parts, of what started gives; an iterator is a list of its rows, however many, read partition by partition."""
    if isinstance(value, chain):
        yield "["
        for i, row in enumerate(value):
            yield f", {row}" if i else row
        yield "]"
    elif isinstance(value, dict):
        for i, (key, one) in enumerate(value.items()):
            yield f"{', ' if i else '{'}{json.dumps(key)}: "
            yield from as_json(one)
        yield "}" if value else "{}"
    else:
        yield json.dumps(value, ensure_ascii=False)


class Api:
    """Answers by route; each takes the query's parameters and returns what becomes JSON, or None for none. Lists of rows
    are whole unless the query names a limit; search has one of its own."""

    def __init__(self, store: Store):
        self.store = store
        self.audits: dict[tuple, dict] = {}

    def answer(self, path: str, q: dict[str, str]):
        parts = [unquote(x) for x in path.strip("/").split("/")]
        if parts[:1] != ["api"] or len(parts) < 2:
            return None
        route = getattr(self, f"get_{parts[1]}", None)
        return route(q, *parts[2:]) if route else None

    def filters(self, q: dict[str, str]) -> dict:
        out = {k: q[k] for k in ("model", "project", "agent") if q.get(k)}
        return out | {k: parse_when(q[k], k == "until", q.get("tz", "UTC")) for k in ("since", "until") if q.get(k)}

    def get_meta(self, q):
        counts = {n: self.store.table(n).count() for n in ("sessions", "steps", "requests")}
        return counts | {"prompts": self.store.prompts().count()}

    def get_sessions(self, q):
        filters = self.filters(q)
        if "agent" in filters:
            filters["agent_part"] = filters.pop("agent")
        more = {"min_cost": float(q["minCost"])} if q.get("minCost") else {}
        return self.store.list_sessions(tool=q.get("tool"), errored=q.get("errored") == "1", text=q.get("text"), sort=q.get("sort", "started_at"), descending=q.get("dir") != "asc", limit=float(q["limit"]) if q.get("limit") else None, **filters, **more)

    def get_search(self, q):
        return self.store.search(q.get("q", ""), limit=int(q.get("limit", 20)), tool=q.get("tool"), errored=q.get("errored") == "1", **self.filters(q))

    def get_session(self, q, session_id=""):
        head = one_of(self.store.get_session(session_id))
        requests = self.store.list_requests(session_id)
        return head | {"steps": self.store.list_steps(session_id), "requests": requests, "compactions": fleet.compactions(requests), "layout": fleet.waterfall(requests)} if head else None

    def get_usage(self, q):
        events = self.store.usage_events(**self.filters(q))
        rows = usage.usage_rows(events, q.get("granularity", "daily"), q.get("breakdown") == "1", q.get("tz", "UTC")).orderBy("bucket", "label")
        return {"rows": rows, "totals": one_of(usage.usage_totals(events)), "unpriced": [r["model"] for r in rows_of(usage.unpriced_models(events))]}

    def get_analytics(self, q):
        requests, heads = self.store._of_sessions("requests"), self.store.sessions()
        events = self.store.usage_events().withColumn("errored", F.lit(False))
        tops = heads.orderBy(F.coalesce("cost_usd", F.lit(0.0)).desc(), "session_id").limit(8)
        wire = requests.agg(F.count("*").alias("requests"), F.count_if("errored").alias("errored"))
        return {
            "totals": one_of(fleet.totals(events)) | one_of(wire), "agents": (fleet.per_agent(events).orderBy(F.desc("cost_usd"))), "projects": (fleet.per_project(events).orderBy(F.desc("cost_usd"))), "trend": (fleet.daily_trend(events)),
            "models": (fleet.wire_metrics(requests).orderBy(F.desc("requests"))), "tools": (usage.merged_histogram(heads, 20)), "top_sessions": (tops), "compactions": one_of(fleet.compaction_summary(requests)),
        }

    def get_prompts(self, q):
        return self.store.prompts(q.get("agent"), int(q["limit"]) if q.get("limit") else None)

    def get_prompt(self, q, prefix=""):
        found = one_of(self.store.get_prompt(prefix))
        if not found:
            return None
        used = self.store._of_sessions("requests").filter(F.col("prompt_hash") == found["prompt_hash"]).groupBy("session_id").agg(F.max("ts").alias("last_used"))
        return found | {"sessions": used.orderBy(F.col("last_used").desc_nulls_last(), "session_id")}

    def get_audit(self, q):
        mode = redact.parse_mode(q.get("mode"))
        files = tuple((r.source_path, r.content_hash) for r in self.store.table("files").select("source_path", "content_hash").orderBy("source_path").toLocalIterator())
        key = (mode, files)
        if key not in self.audits:
            pairs = logs.pairs(self.store.spark, self.store.log_files(), loose=True)
            found = redact.scanned(pairs, mode)
            groups = redact.grouped(found).orderBy(F.desc("egress_count"), "fingerprint").persist()
            for old in self.audits.values():
                old["groups"].unpersist()
            self.audits = {key: {"mode": mode, "groups": groups, "totals": one_of(redact.audit_totals(found)), "redact_check": one_of(redact.redact_check(pairs))}}
        return self.audits[key]

    def signature(self) -> int:
        """Changes with each commit to the store."""
        return self.store.version()


def handler(api: Api) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def send(self, status: int, body: bytes) -> None:
            self.send_response(status)
            self.send_header("content-type", "application/json; charset=utf-8")
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path == "/api/events":
                return self.events()
            try:
                found = started(api.answer(url.path, {k: v[0] for k, v in parse_qs(url.query).items()}))
            except (ValueError, LookupError) as e:
                return self.send(400, json.dumps({"error": str(e)}).encode())
            except PySparkException as e:
                return self.send(500, json.dumps({"error": str(e)}).encode())
            if found is None:
                return self.send(404, b'{"error": "not found"}')
            # Without a length, as rows are sent as they come; the connection's end is theirs.
            self.send_response(200)
            self.send_header("content-type", "application/json; charset=utf-8")
            self.end_headers()
            if self.command != "HEAD":
                for part in as_json(found):
                    self.wfile.write(part.encode())

        do_HEAD = do_GET

        def refuse(self) -> None:
            self.send(405, b'{"error": "only GET and HEAD"}')

        do_POST = do_PUT = do_DELETE = do_PATCH = refuse

        def events(self) -> None:
            self.send_response(200)
            self.send_header("content-type", "text/event-stream")
            self.end_headers()
            known = api.signature()
            try:
                self.wfile.write(b"event: hello\ndata: {}\n\n")
                while True:
                    self.wfile.flush()
                    time.sleep(POLL_S)
                    now = api.signature()
                    self.wfile.write(b": ping\n\n" if now == known else b"event: change\ndata: {}\n\n")
                    known = now
            except OSError:
                pass  # the reader has gone

    return Handler


def serve(store: Store, port: int) -> None:
    with ThreadingHTTPServer(("127.0.0.1", port), handler(Api(store))) as server:
        print(f"http://127.0.0.1:{server.server_port}/api/meta")
        server.serve_forever()
