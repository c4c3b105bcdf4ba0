import json
import re
import time

import pytest
from pyspark.sql import functions as F

from tests import logs as L
from tests.test_functions import tokens
from wirespan.functions import prices as P
from wirespan.operators import atif, redact, trajectory
from wirespan.sources import logs
from wirespan.sources.store import Store
from wirespan.sources.wire import decode, decoded
from wirespan.streaming.tail import TailReader, follow, steps_so_far


def rebuilt(spark, *runs):
    rows = [(f"log{i}", k, json.dumps(p)) for i, run in enumerate(runs) for k, p in enumerate(run)]
    turns = trajectory.conversations(decoded(spark.createDataFrame(rows, "source_path string, pair_index long, raw string")))
    return turns, trajectory.steps(turns)


@pytest.mark.parametrize(
    "run, agent, model, call, output, totals",
    [
        (L.claude, "claude", "claude-sonnet-4", ("g-17", "Gauge", '{"station":"north"}'), "17 millimetres", (700, 63, 64, 1088, None)),
        (L.codex, "codex", "gpt-5", ("b-2", "run_shell", '{"line":"git branch"}'), "* main", (925, 45, 0, 512, 13)),
        (L.gemini, "gemini", "gemini-2.5-pro", ("w-5", "forecast", '{"city":"Bergen"}'), "showers", (219, 29, 0, 32, 6)),
    ],
)
def test_providers(spark, run, agent, model, call, output, totals):
    turns, steps = rebuilt(spark, run())
    rows = steps.orderBy("step_index").collect()
    assert [r.role for r in rows] == ["user", "agent", "agent"]
    assert [tuple(c) for c in rows[1].tool_calls] == [call]
    assert [o.content for o in rows[1].observations] == [output] and rows[2].observations is None
    head = trajectory.session_rows(turns, steps, P.price_table(spark)).first()
    assert (head.agent, head.model, head.steps) == (agent, model, 3)
    assert (head.prompt_tokens, head.completion_tokens, head.cache_creation_tokens, head.cache_read_tokens, head.reasoning_tokens) == totals
    assert head.tool_histogram == {call[1]: 1}


def test_costs_and_requests(spark):
    turns, steps = rebuilt(spark, L.claude())
    head = trajectory.session_rows(turns, steps, P.price_table(spark)).first()
    assert head.cost_usd == pytest.approx((700 * 3 + 63 * 15 + 64 * 3.75 + 1088 * 0.3) / 1e6) and head.duration_ms == 5000
    first, second = trajectory.request_rows(turns, steps).orderBy("seq").collect()
    assert (first.ttft_ms, first.duration_ms, first.stop_reason, first.transcript_items, first.agent_step_index) == (500, 2000, "tool_use", 1, 2)
    assert (second.ttft_ms, second.transcript_items, second.agent_step_index) == (None, 4, 3)
    assert first.prompt_hash == second.prompt_hash != ""


def test_odd_pairs(spark):
    lost = L.pair({"model": "m", "messages": [{"role": "user", "content": "hi"}]})
    plain = L.pair({"model": "m", "messages": [{"role": "user", "content": "hi"}]}, {"body_raw": "overloaded", "status_code": 529})
    failed = L.pair({"model": "m", "messages": [{"role": "user", "content": "hi"}]}, {"body": {"error": "x"}, "status_code": 400})
    assert decode("{") is None and decode("[]") is None and decode(json.dumps(L.pair({"x": 1}))) is None
    turns, steps = rebuilt(spark, [lost, plain, failed])
    assert [(r.role, r.message) for r in steps.orderBy("step_index").collect()] == [("user", "hi"), ("agent", "")]
    rows = trajectory.request_rows(turns, steps).orderBy("seq").collect()
    assert [(r.status, r.errored) for r in rows] == [(None, True), (529, True), (400, True)]


def test_compaction_keeps_cursors(spark):
    said = lambda *texts: L.pair({"model": "m", "messages": [{"role": "user", "content": t} for t in texts]}, {"body": {"content": [{"type": "text", "text": "ok"}]}})
    _, steps = rebuilt(spark, [said("a", "b", "c"), said("summary"), said("summary", "d", "e", "f")])
    assert [r.message for r in steps.orderBy("step_index").collect() if r.role == "user"] == ["a", "b", "c", "f"]


def test_unmatched_results_go_to_the_last_agent_step(spark):
    back = {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "none", "content": "lost"}]}
    answer = {"body": {"content": [{"type": "text", "text": "ok"}]}}
    _, steps = rebuilt(spark, [L.pair({"model": "m", "messages": [back]}, answer), L.pair({"model": "m", "messages": [back, back]}, answer)])
    assert [[o.content for o in r.observations or []] for r in steps.orderBy("step_index").collect()] == [["lost"], []]


def test_documents(spark):
    task = {"type": "tool_use", "id": "k1", "name": "Task", "input": {"prompt": "look around"}}
    answer = lambda *blocks: {"body": {"content": list(blocks), "usage": {"input_tokens": 5, "output_tokens": 1}}}
    top = L.pair({"model": "m", "system": "top", "messages": [{"role": "user", "content": "go " + tokens()["github_token"]}], "tools": [{"name": "Task"}]}, answer(task))
    sub = L.pair({"model": "m", "system": "sub", "messages": [{"role": "user", "content": "please look around now"}]}, answer({"type": "text", "text": "done"}))
    docs = [json.loads(r.document) for r in atif.documents(*rebuilt(spark, [top, sub])).collect()]
    assert len(docs) == 1 and docs[0]["schema_version"] == "ATIF-v1.7" and docs[0]["agent"]["tool_definitions"] == [{"name": "Task"}]
    inner = docs[0]["subagent_trajectories"][0]
    ref = docs[0]["steps"][1]["observation"]["results"][0]["subagent_trajectory_ref"][0]
    assert ref["trajectory_id"] == inner["trajectory_id"] and docs[0]["steps"][0]["message"] == "go [REDACTED:github_token]"
    assert docs[0]["final_metrics"]["total_prompt_tokens"] == 5 and docs[0]["steps"][0]["timestamp"] == "2024-04-01T19:33:20.000Z"


def test_subagents_go_to_the_first_free_run(spark):
    def run(name, message, *prompts):
        calls = [{"type": "tool_use", "id": f"{name}{i}", "name": "Task", "input": p} for i, p in enumerate(prompts)]
        return L.pair({"model": "m", "system": name, "messages": [{"role": "user", "content": message}]}, {"body": {"content": calls or [{"type": "text", "text": "done"}], "usage": {"input_tokens": 5, "output_tokens": 1}}})

    top = run("top", "go", {"prompt": "count"}, {"prompt": "count"}, {"prompt": 5}, {"description": "sort the words at once"}, {"prompt": "none of them"})
    subs = [run("a", "please count"), run("b", "sort the words"), run("c", "count the words"), run("d", "something else")]
    docs = [json.loads(r.document) for r in atif.documents(*rebuilt(spark, [top, *subs], [top, subs[0], top | {"request": top["request"] | {"body": top["request"]["body"] | {"system": "other"}}}])).collect()]
    alone, nested = sorted(docs, key=lambda d: "subagent_trajectories" in d)[:-1], next(d for d in docs if "subagent_trajectories" in d)
    inner = [d["steps"][0]["message"] for d in nested["subagent_trajectories"]]
    assert inner == ["please count", "sort the words", "count the words", "something else"]
    message = {d["trajectory_id"]: d["steps"][0]["message"] for d in nested["subagent_trajectories"]}
    results = nested["steps"][1]["observation"]["results"]
    # By prompt, by prompt again, none (its place is taken), by prompt, none (there is no fifth run).
    assert [(r["source_call_id"], message[r["subagent_trajectory_ref"][0]["trajectory_id"]]) for r in results] == [("top0", "please count"), ("top1", "count the words"), ("top3", "sort the words")]
    assert len(alone) == 3  # two runs of the second log call tasks, so none is put under another


def test_audit(spark):
    token = tokens()["github_token"]
    leak = L.pair({"model": "m", "messages": [{"role": "user", "content": "use " + token}]}, {"body_raw": "echo " + token})
    pairs = spark.createDataFrame([("a", 0, 5.0, json.dumps(leak)), ("b", 0, 0.0, json.dumps(leak))], "source_path string, pair_index long, ts double, raw string")
    group = redact.grouped(redact.scanned(pairs)).first()
    assert (group.type, group.egress_count, group.response_count, group.locations, group.files, group.first_ts, group.last4) == ("github_token", 2, 2, ["messages[0] (user)", "response"], ["a", "b"], 5.0, token[-4:])
    assert tuple(redact.redact_check(pairs).first()) == (4, 4, 2)


def test_walk_in_the_jvm_equals_a_walk_of_each_pair(spark):
    import random

    rng, shapes = random.Random(6), tokens()

    def value(depth):
        kind = rng.randrange(8 if depth < 5 else 4)
        if kind < 4:
            return rng.choice(["", "plain", 5, None, True, 1.5, "é\u0001\n" + rng.choice(list(shapes.values())), f"a {rng.choice(list(shapes.values()))} b", "PASSWORD=h4x0r9q2w8e7z1 DB_PASSWORD=h4x0r9q2w8e7z1", "[REDACTED:jwt]"])
        if kind < 6:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["role", "content", "messages", "response", "x y", "é"]): value(depth + 1) for _ in range(rng.randrange(4))}

    pairs = [{"request": {"timestamp": i, "headers": {"x": shapes["jwt"]}, "body": value(0)}, "response": rng.choice([None, {"body": value(0)}, {"body_raw": value(3)}, {"body": value(0), "body_raw": f"raw {shapes['slack_token']}"}])} for i in range(150)]
    pairs += [{}, {"request": None}, {"response": {"body": shapes["github_token"]}}, {"request": {"body": {"role": "user", "messages": [[{"role": {"a": 1}, "c": [shapes["openai_key"]]}]]}}}]
    nested = shapes["github_token"]
    for _ in range(150):
        nested = [nested]
    texts = [json.dumps(p, ensure_ascii=i % 2 == 0) for i, p in enumerate([*pairs, {"request": {"body": nested}}])]
    texts.append(json.dumps({"request": {"body": shapes["aws_access_key_id"]}}).replace("AKIA", "\\u0041KIA"))
    rows = spark.createDataFrame([("log", i, float(i), t) for i, t in enumerate(texts)], "source_path string, pair_index long, ts double, raw string")
    for mode in ("standard", "strict"):
        want = sorted((i, *found) for i, t in enumerate(texts) for found in redact.scan_pair(json.loads(t), mode))
        assert len(want) > 100 and sorted((r.pair_index, r.type, r.token, r.location, r.direction) for r in redact.scanned(rows, mode).collect()) == want
    assert redact.scanned(rows, "off").count() == 0
    masked = [sum(len(re.findall(redact.PLACEHOLDER, json.dumps(redact.redact_pair(json.loads(t), m)))) for t in texts) for m in ("standard", "strict")]
    assert tuple(redact.redact_check(rows).first()) == (*masked, len(texts))


def test_a_walk_shuffles_nothing(spark):
    from wirespan.plans import content

    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    body = {"messages": [{"role": "u", "content": [{"text": 'brackets [[{{ "quoted" \\'}, "]"]}], "s": "\\"}
    rows = spark.createDataFrame([("log", 0, 0.0, json.dumps({"request": {"body": body}}))], "source_path string, pair_index long, ts double, raw string")
    found = redact.strings(rows)
    assert sorted((r.location, r.text) for r in found.collect()) == [("messages[0] (u)", "]"), ("messages[0] (u)", 'brackets [[{{ "quoted" \\'), ("messages[0] (u)", "u"), ("s", "\\")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "UnionLoop" not in plan
    plan = content.QUERIES["walk_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "UnionLoop" not in plan  # the sums by place alone
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_table_functions(spark):
    from wirespan.functions import tables

    tables.register(spark)
    rows = spark.createDataFrame([(1, '{"messages":[{"role":"u","content":["x"]}],"s":"y"}', "a\nb", "a\nc"), (2, "no json", None, "n"), (3, None, "", "")], "id int, raw string, a string, b string")
    found = spark.sql("SELECT id, text, path, role, location FROM {rows}, LATERAL walk_strings(raw)", rows=rows).collect()
    assert sorted(map(tuple, found), key=str) == [(1, "u", ".messages[0].role", "u", "messages[0] (u)"), (1, "x", ".messages[0].content[0]", "u", "messages[0] (u)"), (1, "y", ".s", None, "s")]
    ops = spark.sql("SELECT id, line, op, text FROM {rows}, LATERAL diff_lines(a, b)", rows=rows).collect()
    assert sorted(map(tuple, ops)) == [(1, 0, "context", "a"), (1, 1, "del", "b"), (1, 2, "add", "c"), (2, 0, "add", "n")]


def test_longest_prefix_is_an_equal_join(spark):
    models = spark.createDataFrame([("GPT-5-mini-2025",), ("gpt-5",), ("Gpt",), ("o3",), ("",), (None,)], "model string")
    prices = P.price_table(spark, {"gpt-5": (1, 2, 3, 4), "GPT-5-mini": (2, 2, 3, 4), "gpt-5-MINI": (9, 2, 3, 4), "gpt": (5, 2, 3, 4)})
    out = P.resolved(models, prices)
    assert {r.model: r.key for r in out.collect() if r.model != "o3"} == {"GPT-5-mini-2025": "gpt-5-MINI", "gpt-5": "gpt-5", "Gpt": "gpt", "": None}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_store(spark, tmp_path):
    for name, run in (("claude", L.claude), ("codex", L.codex), ("gemini", L.gemini)):
        L.write(tmp_path / "work" / f".{name}-trace" / "log.jsonl", run(), tail="{broken\n\n")
    (tmp_path / "work" / "node_modules" / ".claude-trace").mkdir(parents=True)
    store = Store(spark, str(tmp_path / "store"))
    assert store.index_paths([str(tmp_path / "work")]) == {"files_indexed": 3, "files_skipped": 0, "sessions": 3, "steps": 9, "lines_not_json": 3, "pairs_unmatched": 0}
    assert store.index_paths([str(tmp_path / "work")]) == {"files_indexed": 0, "files_skipped": 3, "sessions": 0, "steps": 0, "lines_not_json": 0, "pairs_unmatched": 0}
    assert {r.project_cwd for r in store.sessions().collect()} == {str(tmp_path / "work")}
    hits = store.search("17 millimetre", field="tool-output").collect()
    assert [(h.agent, h.step_index, h.snippet) for h in hits] == [("claude", 2, "[17] [millimetre]s")]
    assert [r.agent for r in store.list_sessions(tool="run_shell").collect()] == ["codex"]
    assert store.list_sessions(text="branches").count() == 1 and store.list_sessions(errored=True).count() == 0
    assert store.usage_events(agent="CODEX").count() == 2 and store.prompts().count() == 2
    path = str(tmp_path / "work" / ".gemini-trace" / "log.jsonl")
    steps = [r.message for r in store.load_session(path).collect()]
    assert steps[0] == "Will Bergen stay dry?" and [r.message for r in store.load_session(path, "no such id").collect()] == steps
    assert [r.session_id for r in store.newest(2).collect()] == [r.session_id for r in store.list_sessions().collect()][:2]
    lost = Store(spark, str(tmp_path / "store"), {"gpt": (1, 1, 1, 1)})
    costs = lambda s: {r.model: r.cost_usd for r in s.usage_events().groupBy("model").agg(F.sum("cost_usd").alias("cost_usd")).collect()}
    assert costs(lost)["claude-sonnet-4"] == costs(store)["claude-sonnet-4"] > 0  # as it was when indexed
    # A log that grows replaces its own rows alone.
    more = L.codex()
    L.write(tmp_path / "work" / ".codex-trace" / "log.jsonl", more[:1])
    assert store.index_paths([str(tmp_path / "work")])["files_indexed"] == 1
    assert store.steps().count() == 8
    store.vacuum()
    assert store.prompts().count() == 2
    digest = store.prompts("claude").first()
    assert digest.content == "Only quote gauges. cch=[HASH];" and store.get_prompt(digest.prompt_hash[:8]).first().agent == "claude"

    import threading
    import urllib.error
    import urllib.request
    from http.server import ThreadingHTTPServer

    from wirespan.serve import Api, handler

    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(Api(store)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}").read())
    assert get("/api/meta") == {"sessions": 3, "steps": 8, "requests": 5, "prompts": 2}
    assert get("/api/usage?granularity=total")["totals"]["events"] == 5
    assert len(get("/api/session/" + get("/api/sessions?agent=claude")[0]["session_id"].replace(":", "%3A"))["steps"]) == 3
    assert get("/api/analytics")["totals"]["requests"] == 5 and get("/api/audit")["groups"] == []
    for path, method, status in (("/api/none", "GET", 404), ("/api/meta", "POST", 405), ("/api/usage?granularity=odd", "GET", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", method=method))
        assert e.value.code == status
    server.shutdown()
    # A log that is replaced by one without a call leaves nothing behind, and one that can't be read stops no other.
    L.write(tmp_path / "work" / ".codex-trace" / "log.jsonl", [L.pair({"x": 1})])
    (tmp_path / "work" / ".codex-trace" / "odd.jsonl").write_bytes(b"\xff\xfe{broken\x00\n")
    assert store.index_paths([str(tmp_path / "work")]) == {"files_indexed": 2, "files_skipped": 2, "sessions": 0, "steps": 0, "lines_not_json": 1, "pairs_unmatched": 1}
    assert store.sessions().count() == 2 and store.steps().count() == 6 and store.usage_events(agent="codex").count() == 0
    assert {r.agent for r in store.list_sessions().collect()} == {"claude", "gemini"}


def test_reading_logs(spark, tmp_path):
    path = L.write(tmp_path / "a b.jsonl", L.claude(), tail='\n{"x": 1}\nnot json\n5\n')
    assert [(r.pair_index, r.ts) for r in logs.pairs(spark, [path], loose=True).orderBy("pair_index").collect()] == [(0, L.START), (1, L.START + 5)]
    assert {r.source_path for r in logs.pairs(spark, [path]).collect()} == {path}
    with pytest.raises(ValueError):
        logs.pairs_or_fail(spark, [L.write(tmp_path / "none.jsonl", [])])
    calls = spark.createDataFrame([("https://h/v1/messages?b=1",), ("https://h/v1/responses",), ("https://h/x:streamGenerateContent",)], "url string")
    assert [logs.agent_calls(calls, a).count() for a in ("claude", "codex", "gemini")] == [1, 1, 1]


def test_command_line(spark, tmp_path, capsys):
    from wirespan.cli import main

    a, b = L.write(tmp_path / "a.jsonl", L.claude()), L.write(tmp_path / "b.jsonl", L.claude()[:1])
    main(["--json", "diff", a, b])
    rows = {(r["section"], r["name"]): r for r in json.loads(capsys.readouterr().out)}
    assert rows["shape", "steps"]["a"] == "3.0" and rows["shape", "steps"]["b"] == "2.0" and rows["tools", "Gauge"]["a"] == "same"
    assert main(["--json", "audit", a]) == 0
    capsys.readouterr()
    main(["atif", a])
    assert json.loads(capsys.readouterr().out)["session_id"].startswith("claude:")
    main(["atif", a, "--write"])
    assert json.loads((tmp_path / "a.atif.json").read_text())["session_id"].startswith("claude:")


def test_tail(spark, tmp_path):
    path = tmp_path / ".claude-trace" / "log.jsonl"
    L.write(path, L.claude()[:1], tail='{"request": {"time')
    reader = TailReader({"path": str(tmp_path)})

    def between(start, end):
        return [r[2] for p in reader.partitions(start, end) for r in reader.read(p)]

    offset = reader.latestOffset()
    assert between(reader.initialOffset(), offset) == [L.START] and reader.partitions(offset, offset) == []
    L.write(path, L.claude())
    later = reader.latestOffset()
    assert between(offset, later) == [L.START + 5] == between(offset, later)  # a batch can run again
    path.write_text(json.dumps(L.claude()[1]) + "\n")  # shorter: replaced
    assert between(later, reader.latestOffset()) == [L.START + 5]


def test_lines_belong_to_the_range_in_which_they_end(tmp_path, monkeypatch):
    import random

    from wirespan.streaming import tail

    rng = random.Random(3)
    monkeypatch.setattr(tail, "READ_BYTES", 7)
    data = b"".join(bytes(rng.choice(b"ab\xc3\xa9 ") for _ in range(rng.choice([0, 1, 5, 40]))) + b"\n" for _ in range(60)) + b"rest"
    (tmp_path / "f").write_bytes(data)
    whole = list(tail.ended_lines(str(tmp_path / "f"), 0, len(data)))
    assert len(whole) == 60
    for _ in range(50):
        cuts = [0, *sorted(rng.sample(range(len(data)), rng.randrange(6))), len(data)]
        assert [x for a, b in zip(cuts, cuts[1:]) for x in tail.ended_lines(str(tmp_path / "f"), a, b)] == whole


def test_follow(spark, tmp_path):
    path = tmp_path / "logs" / ".claude-trace" / "log.jsonl"
    L.write(path, L.claude()[:1])
    seen = []
    run = lambda: follow(spark, [str(tmp_path / "logs")], str(tmp_path / "state"), lambda changes, n: seen.append(sorted((r.kind, r.step_index) for r in changes.collect())))
    query = run()
    try:
        for want, write in (([("step", 1), ("step", 2)], None), ([("observation", 2), ("step", 3)], L.claude())):
            if write:
                query.stop()  # what goes on from its checkpoint brings what is new alone
                L.write(path, write)
                query = run()
            stop = time.time() + 90
            while time.time() < stop and (not seen or seen[-1] != want):
                time.sleep(0.2)
            assert seen[-1:] == [want], query.exception()
    finally:
        query.stop()
    _, steps = rebuilt(spark, L.claude())
    shown = lambda rows: [(r.step_index, r.role, r.message, r.observations) for r in rows.orderBy("step_index").collect()]
    assert shown(steps_so_far(spark, str(tmp_path / "state"), str(path))) == shown(steps)
    assert steps_so_far(spark, str(tmp_path / "state"), session_id="no such").count() == 0


def test_state_equals_batch_after_any_split(spark, tmp_path):
    import random

    from wirespan.streaming import state

    rng = random.Random(8)
    use = lambda i: {"type": "tool_use", "id": f"t{i % 5}", "name": "Run", "input": {"n": i}}
    said = lambda t: {"role": "user", "content": t}
    back = lambda i: {"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"t{i}", "content": f"r{rng.random()}"}]}
    runs = []
    for k in range(6):
        held, run = [], []
        for i in range(9):
            if rng.random() < 0.15:
                held = held[: rng.randrange(3)]  # compacted
            held = held + rng.sample([said(f"m{i}"), said(" \u3000\n"), back(rng.randrange(6)), back(9), {"role": "user", "content": [{"type": "tool_result", "content": "no id"}]}], rng.randrange(4))
            answer = {"body": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": f"a{i}"}] + [use(rng.randrange(9)) for _ in range(rng.randrange(3))], "usage": {"input_tokens": i}}}
            run.append(L.pair({"model": "m", "system": f"run {k}", "messages": held}, None if rng.random() < 0.2 else answer))
        runs.append(run)
    _, steps = rebuilt(spark, *runs)
    columns = ["source_path", "session_id", "step_index", "seq", "ts", "role", "message", "reasoning", "tool_calls", "observations", "usage"]
    shown = lambda rows: sorted(map(repr, rows.select(*columns).collect()))
    want = shown(steps)
    rows = [(f"log{i}", n, json.dumps(p)) for i, run in enumerate(runs) for n, p in enumerate(run)]
    schema = "source_path string, pair_index long, raw string"
    spark.conf.set(*state.STATE_STORE)
    try:
        assert shown(state.steps_of(state.events(decoded(spark.createDataFrame(rows, schema))))) == want  # one batch, no stream
        cuts = {i: sorted(rng.sample(range(10), 2)) for i in range(6)}
        for part in range(3):
            of = lambda r: sum(r[1] >= c for c in cuts[int(r[0][3:])])
            spark.createDataFrame([r for r in rows if of(r) == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            found = state.events(decoded(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset(state.STATE_STORE[0])
    assert shown(state.steps_of(spark.read.schema(state.EVENT).parquet(str(tmp_path / "out")))) == want


def test_display(spark, tmp_path):
    from wirespan.operators import display

    turns, steps = rebuilt(spark, L.claude(), L.codex() + L.gemini())
    heads = turns.groupBy(*trajectory.KEY).agg(F.min("pair_index").alias("at"), F.max_by("agent", "seq").alias("agent"), F.max_by("model", "seq").alias("model"))
    got = {r.source_path: r.digest for r in display.digests(steps, heads).collect()}
    assert got["log0"] == '## Session — claude (claude-sonnet-4)\nUSER: How much rain fell in the north?\nAGENT: Asking the north station.\n  TOOL Gauge({"station":"north"})\n    -> 17 millimetres\nAGENT: The north had 17 millimetres.'
    assert got["log1"].startswith("## Session 1 — codex (gpt-5)\n") and "\n\n## Session 2 — gemini (gemini-2.5-pro)\nUSER: Will Bergen" in got["log1"]
    stats = display.summary(turns, trajectory.session_rows(turns, steps, P.price_table(spark)))
    path = display.write_stats(str(tmp_path / "a.jsonl"), stats)
    assert path.endswith("a.stats.json") and json.loads(open(path).read())["pair_count"] == 6
    row = spark.range(1).select(display.short_tokens(F.lit(45_300)).alias("a"), display.short_tokens(F.lit(950)).alias("b"), display.short_cost(F.lit(123.4), F.lit(True)).alias("c"), display.histogram_text(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(3))).alias("d"), display.histogram_of(F.lit("{bad")).alias("e")).first()
    assert tuple(row) == ("45.3K", "950", "$123+", "b×3, a×1", {})
    assert display.sorted_json('{"b":1,"a":[2]}') == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}'
