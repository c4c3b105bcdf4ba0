"""The registered queries and the pipeline over small tables with nulls, ties, repeated rows, clashing names and no rows."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, item long, copies long, gone string, kept string, lines int, node long, score double, component_id long, n_lines long, sequence_id long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of the same tables: with rows, and without."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = lambda n: "\n".join(line(9) + "." for _ in range(n))
    bad = lambda n: "$$$ ".join(line(4).upper() + " !!!" for _ in range(n))
    texts = [good(rng.randrange(4, 12)) if k % 3 else bad(6) for k in range(60)]
    single = line(60) + "."
    texts += [texts[1], texts[1] + "\n" + texts[2], None, "", " \n\n ", good(400), single, single + " end."]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[1]), (1, texts[4]), (None, texts[5]), (None, None), (7, None)]
    rows = [(i, t, "en", None if k % 7 == 3 else f"s{k % 4}", len(t or ""), 1, 2, "x", "y", 3, 4, 0.5, 5, 6, 7) for k, (i, t) in enumerate(rows)]
    labels = [(k, int(k % 3 != 0), 0) for k in range(55)] + [(3, None, 0), (None, 1, 0), (4, 1, 0), (9999, 0, 1)]
    vectors = [(k, [rng.uniform(-1, 1) for _ in range(6)], 0) for k in range(70)]
    vectors += [(70, vectors[3][1], 0), (3, vectors[3][1], 0), (80, None, 0), (100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (120, [0.0] * 6, 0), (140, [float("nan")] * 6, 0), (None, [1.0] * 6, 0)]
    pages = [(k, f"u{k}", f"<nav><a href='/'>home</a></nav><article><p>{line(20)}</p></article>") for k in range(5)] + [(0, "u0", None), (9, None, ""), (None, "v", "<p>" + line(3000))]
    out = {}
    for kind in ("rows", "none"):
        folder = tmp_path_factory.mktemp(kind)
        for name, data, schema in (("documents", rows, DOCUMENTS), ("labels", labels, "doc_id long, quality int, toxic int"), ("embeddings", vectors, "vec_id long, embedding array<float>, label int"), ("pages", pages, "page_id long, url string, html string")):
            spark.createDataFrame(data if kind == "rows" else [], schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        out[kind] = str(folder)
    return out


def names():
    from wirespan.llm.queries import queries

    return sorted(queries())


@pytest.mark.parametrize("name", names())
def test_queries_over_odd_and_empty_tables(spark, tables, name):
    from wirespan.llm.queries import queries

    run = queries()[name]
    assert run(spark, tables["none"]).count() == 0
    got = run(spark, tables["rows"]).collect()
    of = {n: spark.read.parquet(f"{tables['rows']}/{n}.parquet").count() for n in ("documents", "pages")}
    if name.startswith(("op3", "op4", "op5", "op7", "op8", "op9")):
        assert len(got) == of["documents"]
    if name.startswith("op2"):
        assert len({(r.sequence_id, r.offset) for r in got}) == len(got) >= of["documents"]
        room = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == room.get(r.sequence_id, 0)
            room[r.sequence_id] = r.offset + r.length
        assert max(room.values()) <= 1024
    if name.startswith(("op1_", "op6")):
        by = {}
        for r in got:
            by.setdefault(r.query_id, []).append((-r.score, r.vec_id, r["rank"]))
        assert set(by) == ({0, 20, 40, 60, 120} if name.startswith("op1_") else {0, 20, 40, 60})
        for q, hits in by.items():
            assert len(hits) == 20 and q not in {v for _, v, _ in hits} and [h[2] for h in sorted(hits)] == list(range(1, 21))
    if name.startswith("op10"):
        assert len(got) == of["pages"] and sorted(r.n_chars for r in got)[:2] == [0, 0]


def test_pipeline(spark, tables):
    import corpus_pipeline
    from wirespan.llm.common import stored

    counts = {}
    for kind, folder in tables.items():
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES:
            before = docs
            docs = stored(run(spark, before, folder), f"test-{stage}")
            counts[kind, stage] = docs.count()
            if stage != "packing":
                assert docs.dtypes == before.dtypes, stage
    assert not any(n for (kind, _), n in counts.items() if kind == "none")
    # Line dedup shortens texts and keeps documents; of the two single lines that are alike, one goes after it.
    assert 73 > counts["rows", "quality"] == counts["rows", "line_dedup"] > counts["rows", "near_duplicates"] > 0
    placed = corpus_pipeline.run(spark, tables["rows"])
    assert placed.count() == counts["rows", "packing"]


def test_classifier_against_direct_computation(spark):
    from wirespan.llm import quality as Q

    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 22))
    a = Q.design(z)[:, :-1]
    exact = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * 22))
    assert np.abs(a @ a.T - exact).mean() < 0.06  # the features stand for a Gaussian kernel
    for _ in range(50):  # isotonic regression by its min-max formula
        n = int(rng.integers(1, 9))
        y, w = rng.integers(0, 5, n).astype(float), rng.integers(1, 4, n).astype(float)
        mean = lambda i, j: (y[i:j] * w[i:j]).sum() / w[i:j].sum()
        want = [max(min(mean(i, j) for j in range(k + 1, n + 1)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(Q.monotone(y, w), want)
    x = rng.normal(size=(300, 22))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    stats = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "doc_id long, stats array<double>")
    model = Q.fit(stats, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"))
    import zlib

    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(300)])
    used, own = fold > 0, fold >= 2
    mean, scale = x[used].mean(0), x[used].std(0)
    d = Q.design((x - mean) / scale)
    penalty = np.eye(d.shape[1]) * Q.RIDGE * own.sum() / Q.FEATURES
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(d[own].T @ d[own] + penalty, d[own].T @ y[own])
    assert np.allclose(model.weights, weights, atol=1e-6)
    assert np.mean((model.score(x[fold == 0]) >= 0.5) == y[fold == 0]) > 0.7  # 22 dimensions, 180 rows with noise


def test_token_file_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    from wirespan.llm.queries import WORD_VOCABULARY, vocabulary
    from wirespan.llm.token_files import write_tokens

    docs = spark.createDataFrame([(i, f"word {i} " * 50) for i in range(500)], "doc_id long, text string")
    write_tokens(docs, f"{tmp_path}/t", vocabulary(WORD_VOCABULARY), files=2)
    seen = []
    for path in sorted((tmp_path / "t").glob("*.parquet")):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert "RLE_DICTIONARY" in ids.encodings or "PLAIN_DICTIONARY" in ids.encodings
            for name in ("doc_id", "at", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in columns[name].encodings
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
            stats = columns["doc_id"].statistics
            seen.append((stats.min, stats.max))
    assert seen == sorted(seen) and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
