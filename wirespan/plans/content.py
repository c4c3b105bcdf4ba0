"""Queries over steps, texts and secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirespan.functions import tables
from wirespan.functions import texts as T
from wirespan.functions.times import bucket_label, iso_time
from wirespan.operators import diff, postings, redact, search, sessions
from wirespan.plans import bindings as B
from wirespan.session import scratch
from wirespan.sources.snapshots import Snapshots

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ERROR_SQL = rf"regexp_matches(observation, '(?i)\b({'|'.join(T.ERROR_WORDS)})\b')"


@query("session_header_from_steps", f"WITH {B.STEPS_SQL}, {B.STEP_SESSIONS_SQL} SELECT s.session_id, s.agent, count(*) AS steps, count(*) FILTER (WHERE role = 'agent') AS agent_steps, sum(len(tool_names))::BIGINT AS tool_calls FROM step_sessions s JOIN steps t USING (session_id) GROUP BY 1, 2")
def session_header_from_steps(spark, sf_dir):
    rows = B.steps(spark, sf_dir).join(B.step_sessions(spark, sf_dir), "session_id")
    return rows.groupBy("session_id", "agent").agg(F.count("*").alias("steps"), F.count_if(F.col("role") == "agent").alias("agent_steps"), F.sum(F.size("tool_names")).alias("tool_calls"))


@query("step_text", f"WITH {B.STEPS_SQL} SELECT session_id, step_index, role, array_to_string(tool_names, ' ') AS tool_name, tool_input, observation, {ERROR_SQL} AS errored FROM steps")
def step_text(spark, sf_dir):
    rows = B.steps(spark, sf_dir)
    return rows.select("session_id", "step_index", "role", F.array_join("tool_names", " ").alias("tool_name"), "tool_input", "observation", T.looks_errored(F.col("observation")).alias("errored"))


@query("error_heuristic", f"WITH {B.STEPS_SQL} SELECT observation, {ERROR_SQL} AS errored, count(*) AS n FROM steps GROUP BY 1, 2")
def error_heuristic(spark, sf_dir):
    return B.steps(spark, sf_dir).groupBy("observation", T.looks_errored(F.col("observation")).alias("errored")).agg(F.count("*").alias("n"))


@query("sessions_with_error_steps", f"WITH {B.STEPS_SQL}, {B.STEP_SESSIONS_SQL} SELECT session_id, agent FROM step_sessions s WHERE EXISTS (SELECT 1 FROM steps t WHERE t.session_id = s.session_id AND {ERROR_SQL}) AND EXISTS (SELECT 1 FROM steps t WHERE t.session_id = s.session_id AND list_contains(tool_names, 'Edit'))")
def sessions_with_error_steps(spark, sf_dir):
    steps = B.steps(spark, sf_dir)
    rows = sessions.with_steps(B.step_sessions(spark, sf_dir), steps, T.looks_errored(F.col("observation")))
    return sessions.with_steps(rows, steps, sessions.has_tool("edit")).select("session_id", "agent")


TERMS_SQL = f"""{B.STEPS_SQL}, {B.STEP_SESSIONS_SQL},
cells AS (SELECT session_id, step_index, unnest(['message', 'reasoning', 'tool_name', 'tool_input', 'observation']) AS col, unnest([coalesce(message, ''), reasoning, array_to_string(tool_names, ' '), tool_input, observation]) AS text FROM steps),
words AS (SELECT session_id, step_index, col, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM cells),
terms AS (SELECT session_id, step_index, col, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM words),
sizes AS (SELECT session_id, step_index, count(*) AS size FROM terms GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes)"""


def _hits_sql(phrases: list[list[str]], cols: tuple[str, ...]) -> str:
    scope = ", ".join(f"'{c}'" for c in cols)
    parts = []
    for i, phrase in enumerate(phrases):
        joins = " ".join(f"JOIN terms t{k} ON t{k}.session_id = t0.session_id AND t{k}.step_index = t0.step_index AND t{k}.col = t0.col AND t{k}.pos = t0.pos + {k} AND t{k}.term = '{w}'" for k, w in enumerate(phrase) if k)
        parts.append(f"SELECT t0.session_id, t0.step_index, count(*) AS tf, {i} AS phrase FROM terms t0 {joins} WHERE t0.term = '{phrase[0]}' AND t0.col IN ({scope}) GROUP BY ALL")
    return f"""{TERMS_SQL}, hits AS ({' UNION ALL '.join(parts)}),
rare AS (SELECT phrase, count(*) AS df FROM hits GROUP BY 1),
scored AS (SELECT session_id, step_index, -sum(greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
  FROM hits JOIN rare USING (phrase) JOIN sizes USING (session_id, step_index), corpus GROUP BY ALL HAVING count(*) = {len(phrases)})"""


def _search(name: str, text: str, field: str = "all", where: str = "true", **more):
    phrases = search.query_phrases(text)
    sql = f"WITH {_hits_sql(phrases, search.FIELDS[field])} SELECT session_id, step_index, agent, round(score, 6) AS score FROM scored JOIN step_sessions USING (session_id) JOIN steps USING (session_id, step_index) WHERE {where}"

    def run(spark, sf_dir):
        steps = B.steps(spark, sf_dir).withColumn("errored", T.looks_errored(F.col("observation")))
        hits = search.search(steps, B.step_sessions(spark, sf_dir), text, field=field, stem=False, limit=None, **more)
        return hits.select("session_id", "step_index", "agent", F.round("score", 6).alias("score"))

    query(name, sql)(run)


_search("search_all", "the of")
_search("search_field", "permission", field="tool-output")
_search("search_phrase", "permission.denied the")
_search("search_filtered", "make", where="agent = 'codex' AND cost_usd >= 0.2 AND lower(project_cwd) LIKE '%p%' AND started_at >= 1700010000", agent="codex", min_cost=0.2, project="/P", since=1700010000.0)


def _stored(name: str, text: str, field: str = "all", k: int | None = None):
    """A search of an index that is written first; with k, of the best hits, which passes over blocks."""
    phrases = search.query_phrases(text)
    cut = f"ORDER BY scored.score, session_id, step_index LIMIT {k}" if k else ""
    sql = f"WITH {_hits_sql(phrases, search.FIELDS[field])} SELECT session_id, step_index, round(score, 6) AS score FROM scored {cut}"

    def run(spark, sf_dir):
        folder = scratch(spark, "index")
        postings.numbered(B.steps(spark, sf_dir), "all").write.parquet(f"{folder}/steps")
        steps = spark.read.parquet(f"{folder}/steps")
        postings.documents(steps, ["session_id", "step_index"]).write.parquet(f"{folder}/documents")
        laid = postings.laid_out(postings.blocks(steps, stem=False), int(spark.conf.get("spark.sql.shuffle.partitions")))
        laid.write.partitionBy("bucket").options(**postings.WRITER).parquet(f"{folder}/postings")
        documents = spark.read.parquet(f"{folder}/documents")
        sizes = documents.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
        index = postings.Index(spark.read.parquet(f"{folder}/postings"), sizes.n, sizes.words or 0)
        found = index.top([p[0] for p in phrases], k) if k else index.scores(phrases, field)
        found = found.join(documents, ["segment", "doc"]).select("session_id", "step_index", "score")
        found = found.orderBy("score", "session_id", "step_index").limit(k) if k else found
        return found.withColumn("score", F.round("score", 6))

    query(name, sql)(run)


_stored("search_stored_best", "make the", k=10)
_stored("search_stored_phrase", "permission.denied the")
_stored("search_stored_field", "ok", field="tool-output")


@query("snapshot_upsert", """SELECT doc_id, lang, n_chars FROM documents WHERE lang IS DISTINCT FROM 'de'
  UNION ALL SELECT doc_id, lang, n_chars + 1 FROM documents WHERE lang = 'de' AND doc_id % 3 <> 0
  UNION ALL SELECT -doc_id, 'new', n_chars FROM documents WHERE doc_id % 5 = 0""")
def snapshot_upsert(spark, sf_dir):
    """Documents keyed by language: a run writes all, a second replaces one key's rows, a third adds a key and breaks off, a
    fourth adds it again; parts are merged and what no commit names is deleted."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    store = Snapshots(spark, scratch(spark, "snapshots"), "lang")
    now = store.commit(store.after(store.snapshot(), {"documents": store.add("documents", d, "one")}))
    later = d.filter("lang = 'de' and doc_id % 3 <> 0").withColumn("n_chars", F.col("n_chars") + 1)
    now = store.commit(store.after(now, {"documents": store.add("documents", later, "two")}, {"one": ["de"]}))
    new = d.filter("doc_id % 5 = 0").select((-F.col("doc_id")).alias("doc_id"), F.lit("new").alias("lang"), "n_chars")
    store.add("documents", new, "three")
    now = store.commit(store.after(now, {"documents": store.add("documents", new, "four")}))
    now = store.commit(store.merged(now, ["documents"], parts=2))
    store.vacuum(hours=-1)
    return store.table(now, "documents")


@query("search_top")
def search_top(spark, sf_dir):
    """Ten best stemmed hits with snippets."""
    steps = B.steps(spark, sf_dir).withColumn("errored", T.looks_errored(F.col("observation")))
    return search.search(steps, B.step_sessions(spark, sf_dir), "makes denied", limit=10).select("session_id", "step_index", "role", "agent", "score", "snippet_field", "snippet")


@query("snippet", f"WITH {B.STEPS_SQL} SELECT observation, CASE observation WHEN '' THEN '' WHEN 'terror ok' THEN 'terror ok' ELSE '[make]: Permission [Denied]' END AS snippet FROM (SELECT DISTINCT observation FROM steps)")
def snippet(spark, sf_dir):
    return B.steps(spark, sf_dir).select("observation").distinct().withColumn("snippet", T.snippet(F.col("observation"), ["denied", "make"]))


@query("volatile_normalize", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('Generated 2026-01-02 03:04:05 cch=0a' || doc_id || '; <system-reminder>x' || chr(10) || 'y</system-reminder> The user opened the file a' || doc_id || '.py in the IDE. ' || coalesce(text, ''), 'Generated \d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}', 'Generated [TIMESTAMP]', 'g'), 'The user opened the file [^\s]+ in the IDE\.', 'The user opened file in IDE.', 'g'), '<system-reminder>.*?</system-reminder>', '[SYSTEM-REMINDER]', 'gs'), 'cch=[0-9a-f]+;?', 'cch=[HASH];', 'g') AS text FROM documents")
def volatile_normalize(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    text = F.expr(r"concat('Generated 2026-01-02 03:04:05 cch=0a', cast(doc_id as string), '; <system-reminder>x\ny</system-reminder> The user opened the file a', cast(doc_id as string), '.py in the IDE. ', coalesce(text, ''))")
    return d.select("doc_id", T.without_volatile(text).alias("text"))


# The planted tokens stand at the end of a text, after a space, so plain anchors express the detectors there.
FOUND_SQL = r"""found AS (
  SELECT doc_id, unnest(list_concat(
    list_transform(regexp_extract_all(text, '\bsk-(?:proj-)?[A-Za-z0-9_-]{19,}[A-Za-z0-9_]\b'), lambda t: {'type': 'openai_key', 'token': t}),
    list_transform(regexp_extract_all(text, '\bgh[pousr]_[A-Za-z0-9]{20,255}\b'), lambda t: {'type': 'github_token', 'token': t}),
    list_transform(regexp_extract_all(text, '\bxox[baprs]-[A-Za-z0-9-]{9,}[A-Za-z0-9_]\b'), lambda t: {'type': 'slack_token', 'token': t}),
    list_transform(regexp_extract_all(text, '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b'), lambda t: {'type': 'aws_access_key_id', 'token': t}),
    list_transform(regexp_extract_all(text, '\bBearer\s+([A-Za-z0-9._~+/=-]{20,})', 1), lambda t: {'type': 'bearer_token', 'token': t}))) AS f FROM planted),
secrets AS (SELECT doc_id, f.type AS type, f.token AS token, CASE WHEN doc_id % 4 = 0 THEN 'response' ELSE 'egress' END AS direction FROM found)"""


def _secrets(spark, sf_dir):
    found = redact.detected(B.planted(spark, sf_dir))
    return found.withColumns({"direction": F.expr("CASE WHEN doc_id % 4 = 0 THEN 'response' ELSE 'egress' END"), "location": F.lit("messages[0] (user)"), "source_path": F.expr("concat('log', cast(doc_id % 3 as string))"), "ts": F.col("doc_id").cast("double")})


@query("detect_secrets", f"WITH {B.PLANTED_SQL}, {FOUND_SQL} SELECT doc_id, type, token FROM secrets")
def detect_secrets(spark, sf_dir):
    return redact.detected(B.planted(spark, sf_dir))


@query("redact_standard", rf"""WITH {B.PLANTED_SQL} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bsk-(?:proj-)?[A-Za-z0-9_-]{{19,}}[A-Za-z0-9_]\b', '[REDACTED:openai_key]', 'g'), '\bgh[pousr]_[A-Za-z0-9]{{20,255}}\b', '[REDACTED:github_token]', 'g'), '\bxox[baprs]-[A-Za-z0-9-]{{9,}}[A-Za-z0-9_]\b', '[REDACTED:slack_token]', 'g'),
  '\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b', '[REDACTED:aws_access_key_id]', 'g'), '\bBearer\s+([A-Za-z0-9._~+/=-]{{20,}})', 'Bearer [REDACTED:bearer_token]', 'g') AS text FROM planted""")
def redact_standard(spark, sf_dir):
    return B.planted(spark, sf_dir).select("doc_id", redact.redacted(F.col("text")).alias("text"))


@query("redaction_counts", f"WITH {B.PLANTED_SQL}, {FOUND_SQL} SELECT doc_id, count(*)::INT AS n, list_sort(list(DISTINCT type)) AS types FROM secrets GROUP BY 1")
def redaction_counts(spark, sf_dir):
    rows = redact_standard(spark, sf_dir)
    return rows.select("doc_id", redact.redaction_count(F.col("text")).alias("n"), F.array_sort(redact.redaction_types(F.col("text"))).alias("types")).filter("n > 0")


@query("audit_groups", f"WITH {B.PLANTED_SQL}, {FOUND_SQL} SELECT substr(sha256(token), 1, 12) AS fingerprint, type, right(any_value(token), 4) AS last4, count(*) FILTER (WHERE direction = 'egress') AS egress_count, count(*) FILTER (WHERE direction = 'response') AS response_count, list_sort(list(DISTINCT 'log' || (doc_id % 3))) AS files, coalesce(min(doc_id) FILTER (WHERE doc_id > 0), 0)::DOUBLE AS first_ts FROM secrets GROUP BY 1, 2")
def audit_groups(spark, sf_dir):
    return redact.grouped(_secrets(spark, sf_dir)).select("fingerprint", "type", "last4", "egress_count", "response_count", "files", "first_ts")


@query("audit_totals", f"WITH {B.PLANTED_SQL}, {FOUND_SQL} SELECT count(*) FILTER (WHERE direction = 'egress') AS total_egress, count(*) FILTER (WHERE direction = 'response') AS total_response FROM secrets")
def audit_totals(spark, sf_dir):
    return redact.audit_totals(_secrets(spark, sf_dir))


@query("audit_strict")
def audit_strict(spark, sf_dir):
    """Placeholders of strict redaction over planted texts with assigned secrets."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" API_TOKEN="), F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 24))
    rows = B.planted(spark, sf_dir).select("doc_id", redact.redacted(text, "strict").alias("text"))
    return rows.select("doc_id", redact.redaction_count(F.col("text")).alias("n"))


@query("entropy", "WITH c AS (SELECT doc_id, length(t) AS n, unnest(string_split(t, '')) AS c FROM (SELECT doc_id, text AS t FROM documents WHERE text <> '')), k AS (SELECT doc_id, n, c, count(*) AS m FROM c GROUP BY ALL) SELECT doc_id, round(-sum(m / n::DOUBLE * log2(m / n::DOUBLE)), 6) AS bits FROM k GROUP BY 1")
def entropy(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").filter("text <> ''")
    return d.select("doc_id", F.round(T.entropy(F.col("text")), 6).alias("bits"))


@query("header_mask", r"""WITH h AS (SELECT doc_id, ['authorization', 'X-Api-Key', 'cookie', 'accept'][doc_id % 4 + 1] AS name, substr(coalesce(text, ''), 1, (doc_id % 20)::INT) AS value FROM documents)
  SELECT doc_id, name, CASE WHEN name = 'accept' THEN value WHEN length(value) > 14 THEN substr(value, 1, 10) || '...' || right(value, 4) WHEN length(value) > 4 THEN substr(value, 1, 2) || '...' || right(value, 2) ELSE '[REDACTED]' END AS value FROM h""")
def header_mask(spark, sf_dir):
    """A header a document, of four names, its value the text's beginning."""
    d = B.table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.expr("element_at(array('authorization', 'X-Api-Key', 'cookie', 'accept'), cast(doc_id % 4 as int) + 1)").alias("name"), F.expr("substring(coalesce(text, ''), 1, cast(doc_id % 20 as int))").alias("value"))
    return rows.select("doc_id", "name", T.masked_header(F.col("name"), F.col("value")).alias("value"))


@query("approx_tokens", "SELECT doc_id, floor(length(text) / 4.0 + 0.5)::BIGINT AS tokens FROM documents")
def approx_tokens(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query("fingerprint", "SELECT doc_id, substr(sha256(text), 1, 12) AS fingerprint, CASE WHEN length(text) >= 8 THEN right(text, 4) ELSE '' END AS last4 FROM documents WHERE text IS NOT NULL")
def fingerprint(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"), T.last4(F.col("text")).alias("last4"))


@query("iso_week_label", f"WITH {B.REQUESTS_SQL} SELECT session_id, seq, strftime(make_timestamp((ts * 1000000)::BIGINT + seq * 86400000000 * 11), '%G-W%V') AS week FROM requests")
def iso_week_label(spark, sf_dir):
    return B.requests(spark, sf_dir).select("session_id", "seq", bucket_label(F.col("ts") + F.col("seq") * 86400 * 11, "weekly").alias("week"))


@query("iso_timestamp", f"WITH {B.REQUESTS_SQL} SELECT session_id, seq, strftime(make_timestamp(round(round(ts, 3) * 1000)::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM requests")
def iso_timestamp(spark, sf_dir):
    return B.requests(spark, sf_dir).select("session_id", "seq", iso_time(F.col("ts")).alias("at"))


@query("djb2", """WITH letters AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT) AS cs FROM documents),
units AS (SELECT doc_id, flatten(list_transform(cs, lambda c: CASE WHEN c > 65535 THEN [55296 + (c - 65536) // 1024, 56320 + (c - 65536) % 1024] ELSE [c] END)) AS us FROM letters)
SELECT doc_id, printf('%x', list_reduce(list_prepend(5381::BIGINT, us), lambda h, c: (h * 33 + c) % 4294967296)) AS hash FROM units""")
def djb2(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.djb2(F.col("text")).alias("hash"))


@query("fuzzy_palette", f"""WITH {B.STEP_SESSIONS_SQL}, t AS (SELECT session_id, lower(concat_ws(' ', session_id, agent, model, project_cwd)) AS t FROM step_sessions),
a AS (SELECT *, instr(t, 'c') AS p1 FROM t), b AS (SELECT *, instr(substr(t, p1 + 1), 'x') + p1 AS p2 FROM a WHERE p1 > 0), c AS (SELECT *, instr(substr(t, p2 + 1), 'p') + p2 AS p3 FROM b WHERE p2 > p1),
d AS (SELECT *, instr(substr(t, p3 + 1), '3') + p3 AS p4 FROM c WHERE p3 > p2), e AS (SELECT *, p2 = p1 + 1 AS x, p3 = p2 + 1 AS y, p4 = p3 + 1 AS z FROM d WHERE p4 > p3)
SELECT session_id, CASE WHEN x AND y AND z THEN 20 WHEN x AND y OR y AND z THEN 14 WHEN x AND z THEN 12 WHEN x OR y OR z THEN 10 ELSE 8 END
  + 4 * list_sum(list_transform([p1, p2, p3, p4], lambda p: CASE WHEN p = 1 OR substr(t, p - 1, 1) IN (' ', '/') THEN 1 ELSE 0 END))::INT AS score
FROM e ORDER BY score DESC, session_id LIMIT 12""")
def fuzzy_palette(spark, sf_dir):
    rows = B.step_sessions(spark, sf_dir).withColumn("score", T.fuzzy(F.concat_ws(" ", "session_id", "agent", "model", "project_cwd"), "cxp3"))
    return rows.filter("score >= 0").select("session_id", "score").orderBy(F.desc("score"), "session_id").limit(12)


def _run(spark, sf_dir, half: int):
    return B.requests(spark, sf_dir).filter(F.expr("cast(substring(session_id, 2) as bigint) % 2") == half)


_HALF = "(substr(session_id, 2)::BIGINT % 2)"


@query("tools_diff", f"WITH {B.REQUESTS_SQL}, a AS (SELECT DISTINCT tool || (seq % 2) AS name, status::VARCHAR AS d FROM requests WHERE {_HALF} = 0 AND tool <> 'view'), b AS (SELECT DISTINCT tool || (seq % 3) AS name, status::VARCHAR || CASE WHEN tool = 'click' THEN 'x' ELSE '' END AS d FROM requests WHERE {_HALF} = 1 AND tool <> 'signup') SELECT name, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' WHEN a.d <> b.d THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b USING (name)")
def tools_diff(spark, sf_dir):
    a = _run(spark, sf_dir, 0).filter("tool <> 'view'").select(F.expr("concat(tool, cast(seq % 2 as string))").alias("name"), F.col("status").cast("string").alias("definition")).distinct()
    b = _run(spark, sf_dir, 1).filter("tool <> 'signup'").select(F.expr("concat(tool, cast(seq % 3 as string))").alias("name"), F.expr("concat(cast(status as string), CASE WHEN tool = 'click' THEN 'x' ELSE '' END)").alias("definition")).distinct()
    return diff.tools_diff(a, b)


@query("histogram_diff", f"WITH {B.REQUESTS_SQL} SELECT tool AS name, count(*) FILTER (WHERE {_HALF} = 0) AS n_a, count(*) FILTER (WHERE {_HALF} = 1 AND tool <> 'view') AS n_b, count(*) FILTER (WHERE {_HALF} = 1 AND tool <> 'view') - count(*) FILTER (WHERE {_HALF} = 0) AS delta FROM requests GROUP BY 1")
def histogram_diff(spark, sf_dir):
    a, b = (_run(spark, sf_dir, h).groupBy(F.col("tool").alias("name")).agg(F.count("*").alias("n")) for h in (0, 1))
    return diff.histogram_diff(a, b.filter("name <> 'view'"))


_SHAPE = ("requests", "errored", "prompt_tokens", "completion_tokens", "cache_creation_tokens", "cache_read_tokens")
_SHAPE_SQL = "count(*)::DOUBLE AS requests, (count(*) FILTER (WHERE errored))::DOUBLE AS errored, " + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in _SHAPE[2:])


@query("shape_diff", f"WITH {B.REQUESTS_SQL}, a AS (SELECT {_SHAPE_SQL} FROM requests WHERE {_HALF} = 0), b AS (SELECT {_SHAPE_SQL} FROM requests WHERE {_HALF} = 1) " + " UNION ALL ".join(f"SELECT '{c}' AS metric, a.{c} AS a, b.{c} AS b, b.{c} - a.{c} AS delta FROM a, b" for c in _SHAPE))
def shape_diff(spark, sf_dir):
    shape = lambda h: _run(spark, sf_dir, h).agg(F.count("*").alias("requests"), F.count_if("errored").alias("errored"), *(F.sum(c).alias(c) for c in _SHAPE[2:]))
    return diff.shape_diff(shape(0), shape(1))


@query("model_diff", f"WITH {B.REQUESTS_SQL}, f AS (SELECT {_HALF} AS half, model, min(ts) AS first_at FROM requests WHERE model IS NOT NULL GROUP BY ALL), m AS (SELECT half, list(model ORDER BY first_at, model) AS models FROM f GROUP BY 1) SELECT a.models AS models_a, len(a.models) > 1 AS swapped_a, b.models AS models_b, len(b.models) > 1 AS swapped_b, a.models <> b.models AS changed FROM m a, m b WHERE a.half = 0 AND b.half = 1")
def model_diff(spark, sf_dir):
    # seq counts within a session, so the order over all sessions of a half is that of time.
    a, b = (diff.models_in_order(_run(spark, sf_dir, h).withColumn("seq", F.col("ts")), []) for h in (0, 1))
    return diff.model_diff(a, b)


@query("diff_lines_sql", r"""WITH cut AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CASE WHEN text = '' THEN 0 WHEN n = 1 THEN 0 ELSE 1 END AS deleted, CASE WHEN text = '' THEN 2 ELSE 1 END AS added, CASE WHEN text = '' THEN 0 WHEN n = 1 THEN 1 ELSE n - 1 END AS same FROM cut""")
def diff_lines_sql(spark, sf_dir):
    """In SQL text: how many lines differ between each document and a copy that lost its second line and gained a last one."""
    tables.register(spark)
    d = B.table(spark, sf_dir, "documents").filter("text is not null")
    lines = F.split("text", "\n", -1)
    changed = F.array_join(F.concat(F.slice(lines, 1, 1), F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), F.array(F.concat(F.lit("end of "), F.col("doc_id").cast("string")))), "\n")
    return spark.sql("SELECT doc_id, count_if(op = 'del') AS deleted, count_if(op = 'add') AS added, count_if(op = 'context') AS same FROM {pairs}, LATERAL diff_lines(text, changed) GROUP BY doc_id", pairs=d.select("doc_id", "text", changed.alias("changed")))


BODY_SQL = """bodies AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM planted)"""


def _pairs(spark, sf_dir):
    """A captured pair a document: its text (some with a planted token) as a user's message, in a request without a role,
    and, of every fourth, raw in the response."""
    d = B.planted(spark, sf_dir, "lang", "source")
    said = "named_struct('role', 'user', 'content', array(named_struct('type', 'text', 'text', coalesce(text, ''))))"
    body = f"named_struct('system', coalesce(lang, 'none'), 'messages', array(named_struct('role', 'assistant', 'content', array(named_struct('type', 'none', 'text', coalesce(source, 'none')))), {said}), 'meta', named_struct('note', coalesce(text, '')))"
    raw = F.expr(f"to_json(named_struct('request', named_struct('timestamp', cast(doc_id as double), 'headers', named_struct('x', coalesce(text, '')), 'body', {body}), 'response', named_struct('body', coalesce(lang, 'none'), 'body_raw', CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') END)))")
    return d.select(F.concat(F.lit("log"), (F.col("doc_id") % 3).cast("string")).alias("source_path"), F.col("doc_id").alias("pair_index"), F.col("doc_id").cast("double").alias("ts"), raw.alias("raw"))


@query("scan_pairs", f"""WITH {B.PLANTED_SQL}, {FOUND_SQL} SELECT doc_id AS pair_index, 'log' || (doc_id % 3) AS source_path, type, token, p.location, p.direction
  FROM secrets, (VALUES ('messages[1] (user)', 'egress', 1), ('meta', 'egress', 1), ('response', 'response', 4)) p(location, direction, every) WHERE doc_id % p.every = 0""")
def scan_pairs(spark, sf_dir):
    return redact.scanned(_pairs(spark, sf_dir)).select("pair_index", "source_path", "type", "token", "location", "direction")


@query("walk_pairs", f"""WITH {B.PLANTED_SQL.replace('SELECT doc_id, CASE', 'SELECT doc_id, lang, source, CASE')}, {BODY_SQL}
  SELECT doc_id AS pair_index, l.location, sum(l.n)::BIGINT AS strings, sum(l.size)::BIGINT AS chars FROM bodies,
    LATERAL (VALUES ('system', 1, length(lang)), ('messages[0] (assistant)', 3, length('assistant') + length('none') + length(source)), ('messages[1] (user)', 3, length('user') + length('text') + length(text)), ('meta', 1, length(text)), ('(body)', 1, length(lang)), ('response', CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END, length(text))) l(location, n, size)
  WHERE l.n > 0 GROUP BY ALL""")
def walk_pairs(spark, sf_dir):
    """Every string of the bodies, by place."""
    return redact.strings(_pairs(spark, sf_dir)).groupBy(F.col("place.pair_index").alias("pair_index"), "location").agg(F.count("*").alias("strings"), F.sum(F.length("text")).alias("chars"))


@query("walk_strings_sql", f"""WITH {B.PLANTED_SQL.replace('SELECT doc_id, CASE', 'SELECT doc_id, lang, source, CASE')}, {BODY_SQL}
  SELECT doc_id AS pair_index, 'request.headers.x' AS at, length(text) AS chars FROM bodies UNION ALL SELECT doc_id, 'request.body.messages[1].content[0].text', length(text) FROM bodies""")
def walk_strings_sql(spark, sf_dir):
    """In SQL text: where a pair's JSON holds the document's text."""
    tables.register(spark)
    return spark.sql("SELECT pair_index, substr(path, 2) AS at, length(text) AS chars FROM {pairs}, LATERAL walk_strings(raw) WHERE path IN ('.request.headers.x', '.request.body.messages[1].content[0].text')", pairs=_pairs(spark, sf_dir))


@query("text_diff")
def text_diff(spark, sf_dir):
    """Lines of the diff of each document with a copy that lost its second line and gained a last one."""
    d = B.table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    changed = F.array_join(F.concat(F.slice(lines, 1, 1), F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), F.array(F.lit("end"))), "\n")
    rows = diff.text_diffs(d.filter("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("a"), changed.alias("b")))
    return diff.folded_context(rows).groupBy("id", "op").agg(F.count("*").alias("lines"))
