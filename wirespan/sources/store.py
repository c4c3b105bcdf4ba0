"""A store of traces: Parquet tables under one folder that change by snapshots, and an index of their steps' words.

Each run adds one part to each table, whatever the number of logs, and commits once; the rows of a log that changed stop
counting in the same commit. A Store reads the last commit with each operation, and all tables of an operation from it.
The prompt registry is only added to: a prompt stays when its log goes.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wirespan.functions import prices as P
from wirespan.functions.texts import project_of
from wirespan.operators import postings
from wirespan.operators import search as S
from wirespan.operators import sessions, trajectory
from wirespan.sources import logs
from wirespan.sources.snapshots import Snapshot, Snapshots
from wirespan.sources.wire import decoded

#: Tables of another version are left aside and built anew.
VERSION = 3
TABLES = ("files", "turns", "steps", "sessions", "requests", "usage_events", "documents", "postings", "prompts", "hidden")
#: The index is built anew once so large a share of its steps no longer counts.
DEAD_SHARE = 0.2


class Store:
    """Tables and the operations on them; each returns a DataFrame unless it says otherwise."""

    def __init__(self, spark: SparkSession, folder: str, prices: P.Prices | None = None, at: Snapshot | None = None):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/v{VERSION}"
        self.prices = P.price_table(spark, prices)
        self.snapshots = Snapshots(spark, self.folder, "source_path")
        self.fixed = at

    def snapshot(self) -> Snapshot:
        return self.fixed or self.snapshots.snapshot()

    def pinned(self) -> Store:
        """This store as it is now, whatever runs follow."""
        out = Store.__new__(Store)
        out.__dict__ |= self.__dict__ | {"fixed": self.snapshot()}
        return out

    def version(self) -> int:
        """Number of the last commit: it changes with each run that changes the store."""
        return self.snapshots.version()

    def table(self, name: str) -> DataFrame:
        return self.snapshots.table(self.snapshot(), name)

    def index_paths(self, roots: list[str]) -> dict[str, int]:
        """Reads the logs under roots that changed; returns counts: files indexed and skipped, sessions, steps, lines that are
        no JSON and pairs that no provider matches (neither is kept). Conflict if another run commits meanwhile."""
        base, paths, run = self.snapshots.snapshot(), logs.discover(roots), uuid.uuid4().hex
        found = logs.hashes(self.spark, paths)
        if base.version:
            known = self.snapshots.table(base, "files")
            found = logs.changed(found, known).join(known.select("source_path", F.col("run").alias("old_run")), "source_path", "left")
        else:
            found = found.withColumn("old_run", F.lit(None).cast("string"))
        # One row a changed log, as Spark takes the paths of its input from the driver. Read once: a file may change
        # meanwhile, and its rows must carry the hash under which it will be known.
        rows = found.collect()
        counts = {"files_indexed": len(rows), "files_skipped": len(paths) - len(rows), "sessions": 0, "steps": 0, "lines_not_json": 0, "pairs_unmatched": 0}
        if not rows:
            return counts
        gone: dict[str, list[str]] = {}
        for r in rows:
            if r.old_run:
                gone.setdefault(r.old_run, []).append(r.source_path)
        read, whole, known_pairs = Observation(), Observation(), Observation()
        lines = logs.lines(self.spark, [r.source_path for r in rows]).observe(read, F.count("*").alias("n"))
        pairs = logs.json_pairs(lines).observe(whole, F.count("*").alias("n"))
        records = decoded(pairs).observe(known_pairs, F.count("*").alias("n"))
        added = {}

        def add(name: str, rows: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
            added[name] = self.snapshots.add(name, rows, run, by, **options)
            return added[name][1]

        turns = add("turns", trajectory.conversations(records))
        steps = add("steps", postings.numbered(trajectory.steps(turns), run))
        heads = add("sessions", trajectory.session_rows(turns, steps, self.prices).withColumn("project_cwd", project_of(F.col("source_path"))))
        requests = trajectory.request_rows(turns, steps)
        add("requests", requests.drop("system_prompt"))
        add("usage_events", trajectory.usage_rows(steps, heads, self.prices))
        texts = trajectory.search_rows(steps, "segment", "doc")
        documents = add("documents", postings.documents(texts, [*trajectory.KEY, "step_index"]))
        add("postings", self._laid_out(postings.blocks(texts)), ["bucket"], **postings.WRITER)
        calls = requests.filter("prompt_hash <> ''").select("agent", "session_id", F.when(F.col("ts") > 0, F.col("ts")).alias("ts"), "seq", F.col("system_prompt").alias("prompt"))
        add("prompts", sessions.prompt_registry(calls).drop("request_count", "session_count"))
        files = self.spark.createDataFrame(rows, found.schema).drop("old_run")
        add("files", files.withColumns({"indexed_at": F.current_timestamp(), "run": F.lit(run)}))
        made = self.snapshots.after(base, added, gone)
        built = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
        self.snapshots.commit(self._counted(made, run, {"built": built.n, "n": built.n, "words": built.words}, bool(gone)))
        # Where no pair is kept, Spark leaves out the empty part of the plan, and what it observes with it.
        n_lines, n_pairs, n_known = (x.get["n"] for x in (read, whole, known_pairs)) if added["turns"][0].rows else (lines.count(), pairs.count(), 0)
        counts |= {"sessions": added["sessions"][0].rows, "steps": added["steps"][0].rows, "lines_not_json": n_lines - n_pairs, "pairs_unmatched": n_pairs - n_known}
        return counts

    def _laid_out(self, blocks: DataFrame) -> DataFrame:
        return postings.laid_out(blocks, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def _counted(self, made: Snapshot, run: str, own: dict[str, int], gone: bool) -> Snapshot:
        """made with the conversations that a later source hides, and with the index's counts of steps that count."""
        heads = self.snapshots.table(made, "sessions").select("source_path", "session_id")
        hidden = heads.join(trajectory.latest_source(heads), ["source_path", "session_id"], "left_anti").distinct()
        part = self.snapshots.add("hidden", hidden, run)
        segments = {**made.notes.get("segments", {}), run: own}
        made = self.snapshots.after(made, {"hidden": part}, replaced=("hidden",), notes={"segments": segments})
        if gone or part[0].rows:
            live = self._live(made).groupBy("segment").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
            left = {r.segment: r for r in live.collect()}  # a row a run
            segments = {s: {"built": c["built"], "n": left[s].n, "words": left[s].words} for s, c in segments.items() if s in left}
            made = self.snapshots.after(made, {}, notes={"segments": segments})
        return made

    def _live(self, snapshot: Snapshot) -> DataFrame:
        """The index's steps that count: of logs as they are now, and of sessions' latest sources."""
        return self.snapshots.table(snapshot, "documents").join(self.snapshots.table(snapshot, "hidden"), ["source_path", "session_id"], "left_anti")

    def _index(self, snapshot: Snapshot) -> postings.Index:
        segments = snapshot.notes.get("segments", {})
        dirty = tuple(s for s, c in segments.items() if c["n"] < c["built"])
        rows = self.snapshots.table(snapshot, "postings").filter(F.col("segment").isin(*segments))
        return postings.Index(rows, sum(c["n"] for c in segments.values()), sum(c["words"] for c in segments.values()), dirty, self._live(snapshot))

    def sessions(self) -> DataFrame:
        """One row a session_id: that of the last source by path, where several hold it."""
        return trajectory.latest_source(self.table("sessions"))

    def _of_sessions(self, name: str) -> DataFrame:
        return self.table(name).join(self.sessions().select("session_id", "source_path"), ["session_id", "source_path"], "left_semi")

    def steps(self) -> DataFrame:
        return trajectory.search_rows(self._of_sessions("steps"))

    def search(self, query: str, *, field: str = "all", limit: int | None = S.LIMIT, role: str | None = None, tool: str | None = None, errored: bool = False, **filters) -> DataFrame:
        """As operators.search.search, from the stored index. Blocks that can't hold one of the limit's hits are passed over
        where the query is of single words in all fields, nothing else filters its hits, and every indexed step counts."""
        store, phrases = self.pinned(), S.query_phrases(query, True)
        snapshot = store.fixed
        index = store._index(snapshot)
        plain = limit is not None and field == "all" and not (role or tool or errored or any(v is not None for v in filters.values()))
        if plain and not index.dirty and all(len(p) == 1 for p in phrases):
            found = index.top([w for p in phrases for w in p], limit)
        else:
            found = index.scores(phrases or [["\0"]], field)
        found = found.join(store._live(snapshot), ["segment", "doc"]).select("session_id", "step_index", "score")
        return S.search(store.steps(), store.sessions().drop("source_path"), query, field=field, limit=limit, role=role, tool=tool, errored=errored, found=found, **filters)

    def list_sessions(self, *, tool: str | None = None, errored: bool = False, text: str | None = None, sort: str = "started_at", descending: bool = True, limit: float | None = None, **filters) -> DataFrame:
        store = self.pinned()
        rows, steps = sessions.filtered(store.sessions(), **filters), store.steps()
        if tool:
            rows = sessions.with_steps(rows, steps, sessions.has_tool(tool))
        if errored:
            rows = sessions.with_steps(rows, steps, F.col("errored"))
        if text:
            found = store._index(store.fixed).hits(S.query_phrases(text, True) or [["\0"]])
            each = found.groupBy("segment", "doc").agg(F.count("*").alias("c")).filter(F.col("c") == max(1, len(S.query_phrases(text, True))))
            rows = rows.join(each.join(store._live(store.fixed), ["segment", "doc"]).select("session_id"), "session_id", "left_semi")
        return sessions.listed(sessions.with_counts(rows, steps), sort, descending, limit)

    def newest(self, n: int = 50) -> DataFrame:
        """The sessions that started last, as a listing without a terminal shows them."""
        return self.list_sessions(limit=n)

    def load_session(self, source_path: str, session_id: str | None = None) -> DataFrame:
        """Steps of one session of a log: the one of that id, else the first of the log."""
        own = F.col("source_path") == source_path
        heads = self.table("turns").filter(own).groupBy("adapter", "session_id").agg(F.min("pair_index").alias("at"))
        wanted = heads.orderBy(F.coalesce(F.col("session_id") != F.lit(session_id), F.lit(True)), "at").limit(1)
        return self.table("steps").filter(own).join(wanted, ["adapter", "session_id"], "left_semi").orderBy("step_index")

    def get_session(self, session_id: str) -> DataFrame:
        return sessions.with_counts(self.sessions().filter(F.col("session_id") == session_id), self.steps())

    def list_steps(self, session_id: str) -> DataFrame:
        return self.steps().filter(F.col("session_id") == session_id).orderBy("step_index")

    def list_requests(self, session_id: str) -> DataFrame:
        return self._of_sessions("requests").filter(F.col("session_id") == session_id).orderBy("seq")

    def usage_events(self, **filters) -> DataFrame:
        """Events with their session's project, in order of time; filters as sessions.filtered takes them."""
        events = self._of_sessions("usage_events").drop("source_path").withColumnRenamed("micro_cost", "indexed_cost")
        # A model that has lost its price keeps the cost it had when its log was indexed.
        events = P.priced(events, self.prices).withColumn("micro_cost", F.coalesce("micro_cost", "indexed_cost")).drop("indexed_cost")
        events = events.join(self.sessions().select("session_id", "project_cwd"), "session_id", "left").withColumn("cost_usd", P.usd(F.col("micro_cost")))
        return sessions.filtered(events, time="ts", **filters).orderBy("ts", "session_id", "step_index")

    def _known_prompts(self) -> DataFrame:
        rows = self.table("prompts")
        merged = rows.groupBy("prompt_hash").agg(F.min_by("agent", "first_seen").alias("agent"), F.first("content").alias("content"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.first("approx_tokens").alias("approx_tokens"))
        return merged.select(*rows.columns)

    def prompts(self, agent: str | None = None, limit: int | None = None) -> DataFrame:
        """Prompts by last use, with the requests and sessions that use them now."""
        known = self._known_prompts()
        used = self._of_sessions("requests").groupBy("prompt_hash").agg(F.count("*").alias("request_count"), F.count_distinct("session_id").alias("session_count"))
        rows = known.join(used, "prompt_hash", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("request_count", "session_count")})
        rows = rows.filter(F.lower("agent") == agent.lower()) if agent else rows
        rows = rows.orderBy(F.col("last_seen").desc_nulls_last(), "prompt_hash")
        return rows if limit is None else rows.limit(limit)

    def get_prompt(self, prefix: str) -> DataFrame:
        return sessions.prompt_by_prefix(self.prompts(), prefix)

    def log_files(self) -> list[str]:
        """Paths of the indexed logs that are still there."""
        return [r.source_path for r in self.table("files").select("source_path").distinct().toLocalIterator() if os.path.exists(r.source_path)]

    def vacuum(self, hours: float = 24.0) -> int:
        """Joins small parts, makes the prompt registry one row a prompt, builds the index anew if a share of its steps no
        longer counts, and deletes what no commit of the last hours names; returns how many parts were deleted."""
        base = self.snapshots.snapshot()
        if base.version:
            run, added, notes = uuid.uuid4().hex, {}, dict(base.notes)
            if len(base.parts["prompts"]) > 1:
                added["prompts"] = self.snapshots.add("prompts", self.pinned()._known_prompts(), run)
            segments = base.notes.get("segments", {})
            lost = sum(c["built"] - c["n"] for c in segments.values())
            if lost > DEAD_SHARE * sum(c["built"] for c in segments.values()):
                texts = self._anew(base, run)
                added["documents"] = self.snapshots.add("documents", postings.documents(texts, [*trajectory.KEY, "step_index"]), run)
                added["postings"] = self.snapshots.add("postings", self._laid_out(postings.blocks(texts)), run, ["bucket"], **postings.WRITER)
                # Logs name the run that read them; their rows are in these parts now.
                runs = tuple({r for p in base.parts["documents"] for r in p.runs} | {run})
                added["documents"] = (replace(added["documents"][0], runs=runs), added["documents"][1])
                sizes = added["documents"][1].agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
                notes["segments"] = {run: {"built": sizes.n, "n": sizes.n, "words": sizes.words}}
            made = self.snapshots.after(base, added, replaced=tuple(added), notes=notes)
            made = self.snapshots.merged(made, [n for n in TABLES if n not in ("prompts", "hidden")], layouts={"postings": (self._laid_out, ["bucket"], postings.WRITER)})
            if made.parts != base.parts:
                self.snapshots.commit(made)
        return self.snapshots.vacuum(hours)

    def _anew(self, base: Snapshot, run: str) -> DataFrame:
        """The texts of all steps that count, numbered anew and written, so that both tables of the index see the same numbers."""
        steps = self.snapshots.table(base, "steps").drop("segment", "doc").join(self.snapshots.table(base, "hidden"), ["source_path", "session_id"], "left_anti")
        return self.snapshots.add("texts", postings.numbered(trajectory.search_rows(steps), run), run)[1]
