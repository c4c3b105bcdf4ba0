"""Snapshots, the stored text index and counts of what a run left out."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests import logs as L
from wirespan.operators import postings
from wirespan.operators import search as S
from wirespan.sources.snapshots import Conflict, Snapshots
from wirespan.sources.store import Store

SCHEMA = "source_path string, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def listed(store, snapshot, name="t"):
    return sorted(map(tuple, store.table(snapshot, name).collect()), key=str)


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s", "source_path")
    assert store.version() == 0 and store.snapshot().parts == {}
    with pytest.raises(LookupError):
        store.table(store.snapshot(), "t")
    one = store.commit(store.after(store.snapshot(), {"t": store.add("t", rows(spark, ("a", 1), ("b", 2), (None, 3)), "r1")}))
    left_by_a_broken_run = store.add("t", rows(spark, ("z", 9)), "r0")
    two = store.commit(store.after(one, {"t": store.add("t", rows(spark, ("a", 10)), "r2")}, {"r1": ["a"]}))
    # The old snapshot reads as before, the new one has a's rows of its last run alone.
    assert listed(store, one) == [("a", 1), ("b", 2), (None, 3)]
    assert listed(store, two) == listed(store, store.snapshot()) == [("a", 10), ("b", 2), (None, 3)]
    with pytest.raises(Conflict):
        store.commit(store.after(one, {"t": left_by_a_broken_run}))
    with pytest.raises(ValueError):
        store.after(two, {"t": store.add("t", spark.createDataFrame([("a", "x")], "source_path string, n string"), "r3")})
    gone = store.commit(store.after(two, {}, {"r2": ["a"], "r1": ["b", "unknown"]}))
    assert listed(store, gone) == [(None, 3)]
    assert store.vacuum(hours=24) == 0 and listed(store, one) == [("a", 1), ("b", 2), (None, 3)]
    assert store.vacuum(hours=-1) == 2  # both that no commit ever named
    assert listed(store, store.snapshot()) == [(None, 3)]


def test_many_dead_keys_are_joined_away_and_parts_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("wirespan.sources.snapshots.LISTED", 3)
    store = Snapshots(spark, f"file://{tmp_path}/s", "source_path")
    now = store.commit(store.after(store.snapshot(), {"t": store.add("t", rows(spark, *((f"k{i}", i) for i in range(10))), "r")}))
    now = store.commit(store.after(now, {}, {"r": [f"k{i}" for i in range(6)]}))
    assert now.parts["t"][0].gone == () and [n for _, n in listed(store, now)] == [6, 7, 8, 9]
    for i in range(12):
        now = store.commit(store.after(now, {"t": store.add("t", rows(spark, (f"m{i}", i)), f"run{i}")}, {"r": ["k6"]}))
    before = listed(store, now)
    now = store.commit(store.merged(now, ["t"], parts=4))
    assert len(now.parts["t"]) == 3 and listed(store, now) == before
    now = store.commit(store.after(now, {}, {"run3": ["m3"], "r": ["k7"]}))  # merged rows know their runs
    assert listed(store, now) == [r for r in before if r[0] not in ("m3", "k7")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Steps, their stored index, and the same index as one table of words."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "permission", "denied", "makes", "makers", "tests"]
    weights = [30, 20, 10, 6, 4, 3, 2, 1, 1]
    text = lambda n: " ".join(rng.choices(words, weights, k=rng.randrange(n)))
    found = [(f"s{i % 40}", i // 40, "agent", text(40), text(9), [rng.choice(words)] if i % 3 else [], text(5), text(12)) for i in range(800)]
    found += [("s900", 0, "agent", "", "", [], "", ""), ("s900", 1, "agent", None, None, [], None, None), ("s900", 2, "user", "Permission-denied: ÉTÉ makes", "", [], "", ""), ("s901", 0, "user", "alpha " * 4000, "", [], "", "")]
    steps = spark.createDataFrame(found, "session_id string, step_index int, role string, message string, reasoning string, tool_names array<string>, tool_input string, observation string")
    folder = str(tmp_path_factory.mktemp("index"))
    postings.numbered(steps.repartition(3), "seg").write.parquet(f"{folder}/steps")
    numbered = spark.read.parquet(f"{folder}/steps")
    postings.documents(numbered, ["session_id", "step_index"]).write.parquet(f"{folder}/documents")
    postings.laid_out(postings.blocks(numbered), 4).write.partitionBy("bucket").options(**postings.WRITER).parquet(f"{folder}/postings")
    documents, blocks = (spark.read.parquet(f"{folder}/{n}") for n in ("documents", "postings"))
    sizes = documents.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    return steps, documents, postings.Index(blocks, sizes.n, sizes.words), S.index_terms(steps).cache()


def by_step(found, documents):
    return {(r.session_id, r.step_index): r.score for r in found.join(documents, ["segment", "doc"]).collect()}


@pytest.mark.parametrize("query, field", [("alpha", "all"), ("gamma delta", "all"), ("permission.denied makes", "all"), ("makes", "tool-output"), ("alpha.beta", "tool-input"), ("été", "all"), ("alpha alpha", "all"), ("none", "all"), ("alpha none", "message")])
def test_stored_index_scores_as_full_scoring(spark, corpus, query, field):
    _, documents, index, terms = corpus
    phrases = S.query_phrases(query, True)
    want = {(r.session_id, r.step_index): r.score for r in S.scores(terms, phrases, field).collect()}
    got = by_step(index.scores(phrases, field), documents)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    if query == "été":
        assert list(got) == [("s900", 2)]


@pytest.mark.parametrize("k", [1, 7, 1000])
@pytest.mark.parametrize("query", ["test", "gamma delta", "alpha alpha beta", "none", "denied none"])
def test_best_hits_equal_full_scoring(spark, corpus, monkeypatch, query, k):
    for name, value in (("FIRST", 2), ("NAMED", 1 if k == 7 else 1000)):
        monkeypatch.setattr(postings, name, value)
    _, documents, index, _ = corpus
    words = [w for p in S.query_phrases(query, True) for w in p]
    every = sorted(by_step(index.scores([[w] for w in words]), documents).items(), key=lambda x: (x[1], x[0]))
    got = sorted(by_step(index.top(words, k), documents).items(), key=lambda x: (x[1], x[0]))
    assert [x for x, _ in got[:k]] == [x for x, _ in every[:k]]
    assert all(a[1] == pytest.approx(b[1], rel=1e-9) for a, b in zip(got, every))


def test_search_reads_one_bucket_and_passes_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    monkeypatch.setattr(postings, "FIRST", 2)
    steps = spark.range(600).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit(1).alias("step_index"), F.expr("concat('common ', repeat('filler ', cast(id as int)))").alias("message"), F.lit("").alias("reasoning"), F.array().cast("array<string>").alias("tool_names"), F.lit("").alias("tool_input"), F.lit("").alias("observation"))
    postings.numbered(steps.coalesce(1), "seg").write.parquet(f"{tmp_path}/steps")
    numbered = spark.read.parquet(f"{tmp_path}/steps")
    postings.laid_out(postings.blocks(numbered), 2).write.partitionBy("bucket").options(**postings.WRITER).parquet(f"{tmp_path}/postings")
    index = postings.Index(spark.read.parquet(f"{tmp_path}/postings"), 600, 600 + sum(range(600)))
    plan = index.best(["common"], 5)
    assert plan.bounds.count() == 38 and plan.rest.count() == 0 and plan.first[0] == ("seg", 0)  # the shortest steps come first
    assert [r.doc for r in index.top(["common"], 5).orderBy("score").collect()] == [0, 1, 2, 3, 4]
    text = index.of(["common"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in text and "PushedFilters: [" in text
    read = index.of(["common"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in read}) == 1
    import pyarrow.parquet as pq

    path = read[0].f.removeprefix("file://")
    columns = pq.ParquetFile(path).metadata.row_group(0)
    encodings = {columns.column(i).path_in_schema: columns.column(i).encodings for i in range(columns.num_columns)}
    assert any("DELTA_BINARY_PACKED" in e for n, e in encodings.items() if n.startswith("places")) and any("DELTA_BINARY_PACKED" in e for n, e in encodings.items() if n.endswith("off"))


def test_store_index_after_changes(spark, tmp_path):
    """Hidden and replaced conversations leave the ranking; a search after vacuum equals one before."""
    work = tmp_path / "work"
    said = lambda *texts: L.pair({"model": "m", "system": texts[0][:9], "messages": [{"role": "user", "content": t} for t in texts]}, {"body": {"content": [{"type": "text", "text": "fine"}]}})
    for i in range(3):
        L.write(work / f"p{i}" / ".claude-trace" / "log.jsonl", [said(f"project {i} asks about rivers", f"and lakes {'deep ' * i}")], tail="no json\n")
    L.write(work / "p3" / ".claude-trace" / "log.jsonl", [said("project 0 asks about rivers", "and lakes ")])  # a copy of p0
    store = Store(spark, f"{tmp_path}/store")
    first = store.index_paths([str(work)])
    assert (first["files_indexed"], first["lines_not_json"], first["pairs_unmatched"]) == (4, 3, 0)
    old = store.pinned()
    L.write(work / "p1" / ".claude-trace" / "log.jsonl", [said("project 1 asks about mountains"), L.pair({"x": 1})])
    second = store.index_paths([str(work)])
    assert (second["files_indexed"], second["lines_not_json"], second["pairs_unmatched"]) == (1, 0, 1)
    assert old.steps().count() > store.steps().count()  # a reader that began before sees what it saw

    def ranked(query, **options):
        steps, heads = store.steps(), store.sessions().drop("source_path")
        want = [(r.session_id, r.step_index, round(r.score, 9)) for r in S.search(steps, heads, query, **options).collect()]
        got = [(r.session_id, r.step_index, round(r.score, 9)) for r in store.search(query, **options).collect()]
        assert got == want
        return got

    assert len(ranked("rivers")) == 2 and store.sessions().count() == 3 and ranked("asks about", limit=2)
    parts = [p for p in (tmp_path / "store").glob("v*/data/*/*")]
    assert len(parts) == 2 * 10  # a run adds a folder to each table, whatever the number of logs
    version = store.version()
    store.vacuum(hours=-1)
    assert store.version() == version + 1 and ranked("deep lakes", limit=1)
    L.write(work / "p2" / ".claude-trace" / "log.jsonl", [said("project 2: now only deserts")])  # a log that an older run read
    store.index_paths([str(work)])
    assert ranked("deserts") and not ranked("deep")
    notes = store.snapshot().notes["segments"]
    assert sum(c["n"] for c in notes.values()) == store.table("documents").count() and json.dumps(notes)
