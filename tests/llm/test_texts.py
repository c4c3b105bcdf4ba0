"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item long, node long, ids string, key string, size long, s string"
WORDS = "der die das and the of in rain würde naïve über 12 3.5 x_y don't it's ## |".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "x", "y", 3, "z") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    lines = lambda n: "\n".join(text(rng.randrange(3, 12)) for _ in range(n))
    rows = [(i, lines(rng.randrange(2, 30)), f"s{i % 3}") for i in range(40)]
    base = rows[5][1]
    rows += [(40 + i, base.replace("rain", "snow", i), "s1") for i in range(6)]
    rows += [(50, None, "s0"), (51, "", None), (52, " \t\n ", "s2"), (53, "one two", "s2"), (54, "Two words", "s9"), (55, "two words", "s9"), (56, lines(600), "s0"), (57, "a" * 5000, "s0"), (58, rows[7][1] + "\n" + rows[8][1], "s2")]
    return rows


def encoded(name, text):
    from wirespan.llm.encoding import library_encoder

    return np.frombuffer(library_encoder(public_tokenizers.path(name))(text or ""), "<u4").tolist() + [2]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_equal_the_library(name, corpus):
    from wirespan.llm.encoding import encoder, library_encoder

    path = public_tokenizers.path(name)
    fast, whole = encoder(path), library_encoder(path)
    rng = random.Random(1)
    alphabet = "ab éß'sS1 2\n\t  .,<|endoftext|>ñÜ—“\x1c\xa0　中́"
    texts = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(1500)] + [t or "" for _, t, _ in corpus] + ["x <|endoftext|> y"]
    assert all(fast(t) == whole(t) for t in texts)


def test_packing(spark, corpus):
    from wirespan.llm.packing import pack_documents, sequences

    packed = pack_documents(frame(spark, corpus), public_tokenizers.path("byte_bpe_50k.json"))
    rows = packed.collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(by_doc.setdefault(r.doc_id, [])) and r.length == len(r.ids) <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.piece == 0 or r.length == 1024
        by_doc[r.doc_id] += r.ids
    assert by_doc == {i: encoded("byte_bpe_50k.json", t) for i, t, _ in corpus}
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        ends = np.cumsum([n for _, n in sorted(x)])
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 1024
    least = -(-sum(len(x) for x in by_doc.values()) // 1024)
    assert len(places) <= least + 2
    assert sequences(packed).count() == len(places)


def test_packing_rounds_lose_nothing(spark):
    from pyspark.sql import functions as F

    from wirespan.llm.packing import pack

    items = spark.range(5000).select(F.col("id").alias("item"), (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length"))
    out = pack(items, 1024, task_items=600).collect()
    assert sorted(r.item for r in out) == list(range(5000))
    fill = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * sum(fill.values()) / 1024 + 1


def test_token_files(spark, corpus):
    from wirespan.llm.common import shared_path
    from wirespan.llm.token_files import checksums, read_metadata, read_tokens, write_tokens

    path = shared_path(spark, "test")
    write_tokens(frame(spark, corpus), path, public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for i, t, _ in sorted(corpus):
        ids = encoded("word_bpe_49k.json", t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, checksums(read_tokens(spark, path)).collect())) == want
    assert sorted(map(tuple, read_metadata(spark, path).collect())) == [x[:3] for x in want]
    some = read_tokens(spark, path, 10, 12).collect()
    assert sorted((r.doc_id, r.start) for r in some) == [x[:2] for x in want if 10 <= x[0] <= 12]


def test_reading_tokens_shuffles_no_ids(spark, corpus):
    from wirespan.llm.common import shared_path
    from wirespan.llm.token_files import read_tokens, write_tokens

    path = shared_path(spark, "test")
    write_tokens(frame(spark, corpus), path, public_tokenizers.path("word_bpe_49k.json"))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # the small table stands for one that Spark takes for large
    try:
        plan = read_tokens(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_batches_of_texts_equal_the_library():
    import pyarrow as pa

    from wirespan.llm.encoding import encode_batch, library_encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = library_encoder(path), random.Random(8)
    words = ["a<|startoftext|>b", "<|endoftext|>", "a\x01b", "\x7f", "ß Straße", "don't I'LL", "\xa0a\u0085b\u3000", "日本 語", "Ω Σας", "é\u0301", "1234 5a6", "\n\n", "Hello, ", "World! ", "\t"]
    for more in ([], ["x\x1cy"]):  # a separator that the library keeps sends its whole batch to the plain path
        texts = [None, "", "  ", *words, *more, *("".join(rng.choices(words + more, k=6)) for _ in range(200)), *(f"a{chr(c)}b {chr(c)}" for c in range(0x20, 0x500))]
        counts, ids = encode_batch(path, pa.array(texts, pa.string()), 2)
        want = [whole(t or "") + (2).to_bytes(4, "little") for t in texts]
        assert counts.tolist() == [len(x) // 4 for x in want] and ids.astype("<u4").tobytes() == b"".join(want)


def test_ngram_join(spark, corpus):
    from wirespan.llm.ngram_join import jaccard_components, one_of_each

    def grams(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}

    rng = random.Random(8)
    middle = [f"v{k}" for k in range(300)]
    rows = list(corpus)
    for i in range(60):  # a large group: copies are like what they were made from more than like each other
        copy = list(middle)
        for k in rng.sample(range(300), 7):
            copy[k] = f"u{rng.randrange(10**6)}"
        rows.append((200 + i, " ".join(copy), "s0"))
    rows.append((299, " ".join(middle), "s0"))
    sets = {i: grams(t) for i, t, _ in rows}
    least = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    docs = frame(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if least[i] == i)


def test_line_dedup(spark, corpus, monkeypatch):
    from wirespan.llm import line_dedup as D

    monkeypatch.setattr(D, "MAX_LINES", 5)

    def chunks(text):
        lines = text.split("\n")
        h = [hashlib.md5(x.encode()).hexdigest() for x in lines]
        out = set()
        for k in range(D.HASHES):
            first = 0
            for i in range(1, len(lines) + 1):
                cut = i == len(lines) or int(h[i - 1][k], 16) >= D.ENDS or int(h[i][k], 16) < D.BEGINS
                if cut or i - first == D.MAX_LINES:
                    out |= {(first, i)} if i - first >= 2 else set()
                    first = i
        return sorted(out)

    passage = corpus[3][1].split("\n")[:4]
    rows = corpus + [(70, "+a\n-b\n+c\n\n\n", "s"), (71, "+a\n-b\n+c\n\n\n", "s"), (72, "x\n" * 40, "s"), (73, "\n \n" * 9, "s"), (74, "\n \n" * 9, "s"), (75, "q\nr", "s"), (75, "q\nr", "s"), (75, "q\nr\ns", "s")]
    rows += [(80 + i, "\n".join([f"{i} before", *passage[i % 2 :], f"{i} after"]), "s") for i in range(20)]
    version = {t: r for t, r in ((r.t, r.v) for r in spark.createDataFrame([(t,) for _, t, _ in rows], "t string").selectExpr("t", "xxhash64(t) as v").collect())}
    places = {}
    for i, t, _ in rows:
        for a, b in chunks(t) if t is not None else ():
            x = "\n".join(t.split("\n")[a:b])
            if x.replace("\n", "").strip(" "):
                places.setdefault(x, set()).add((i, version[t], a, b))
    gone = {}
    for found in places.values():
        for i, v, a, b in sorted(found)[1:]:
            gone.setdefault((i, v), set()).update(range(a, b))
    want = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        own = gone.get((i, version[t]), set())
        want.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in own), len(lines), len(own)))
    for collide in (False, True):
        if collide:  # all chunks share a few keys, so that bytes alone tell them apart
            keys = D.chunk_keys
            monkeypatch.setattr(D, "chunk_keys", lambda docs: keys(docs).selectExpr("doc_id", "version", "chunk", "key % 3 as key"))
        out = D.dedup_lines(frame(spark, rows), counts=True)
        assert out.columns == [*frame(spark, rows).columns, "n_lines", "n_removed_lines"]
        got = out.collect()
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in got), key=str) == sorted(want, key=str)
        assert all(r.n_chars == len(r.text or "") for r in got)
    assert sum(w[3] >= len(passage) - 1 - w[0] % 2 for w in want if 80 <= w[0] < 100) >= 18  # of the copies between other lines


def test_repeated_passages_between_other_lines(spark, corpus):
    from wirespan.llm.line_dedup import dedup_passages

    passage = corpus[3][1].split("\n")[:3]
    rows = corpus + [(80 + i, "\n".join([f"{i} before", *passage[i % 2 :], f"{i} after"]), "s") for i in range(20)]
    rows += [(110, "a\n\n\n\nb", "s"), (111, "c\n\n\n\nd", "s"), (112, "x\nx\nx", "s"), (113, "one line", "s"), (114, "one line", "s"), (115, "q\nr", "s"), (115, "q\nr", "s")]
    seen, want = {}, {}
    for i, t, _ in sorted({(i, t, "") for i, t, _ in rows}):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            if "".join(pair).strip(" ") and seen.setdefault(pair, (i, k)) != (i, k):
                gone |= {k, k + 1}
        want[i] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    got = dedup_passages(frame(spark, rows), counts=True)
    assert got.columns == [*frame(spark, rows).columns, "n_lines", "n_removed_lines"]
    found = got.collect()
    assert len(found) == len(rows) and {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in found} == want
    assert all(r.n_chars == len(r.text or "") for r in found)
    assert all(want[80 + i][0] == f"{i} before\n{i} after" for i in range(20))


def test_substring_dedup(spark, corpus):
    from wirespan.llm import repeats

    rows = corpus + [(80 + i, f"{i} begins {corpus[3][1][:140]} ends {i}", "s") for i in range(30)] + [(120, "ab" * 400, "s")]
    seen, want = set(), {}
    for i, t, _ in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i] = (bytes(x for x, y in zip(b, gone) if not y), len(b), sum(gone), spans)
    for variants in (repeats.VARIANTS, 3):  # either way of comparing what differs under an anchor
        old, repeats.removed_ranges.__defaults__ = repeats.removed_ranges.__defaults__, (100, 32, variants)
        got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in repeats.dedup_substrings(frame(spark, rows)).collect()}
        repeats.removed_ranges.__defaults__ = old
        assert got == want


def test_substring_dedup_of_rows_that_share_a_doc_id(spark, corpus):
    from wirespan.llm import repeats

    rng = random.Random(4)
    fresh = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b, c, d = fresh(300), fresh(150), fresh(150), fresh(300)
    texts = [(1, a), (2, a + b), (2, fresh(400)), (2, None), (3, b + c), (3, c + d), (None, fresh(350)), (None, "x" + a), (None, None), (4, c[:120] + fresh(200)), (4, d[50:200] + fresh(220))]
    rows = [(i, t, "s") for i, t in texts] + [(2, a + b, "s"), (None, None, "s")]  # repeated rows are one document
    version = {r.t: r.v for r in spark.createDataFrame([(t,) for _, t in texts], "t string").selectExpr("t", "xxhash64(t) v").collect()}
    seen, want = set(), []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, version[x[1]])):
        data = (t or "").encode()
        gone = set()
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone |= set(range(k, k + 100))
            seen.add(data[k : k + 100])
        want += [(i, bytes(x for k, x in enumerate(data) if k not in gone), len(data), len(gone))] * sum((i, t) == r[:2] for r in rows)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    for variants in (repeats.VARIANTS, 0):
        old, repeats.removed_ranges.__defaults__ = repeats.removed_ranges.__defaults__, (100, 32, variants)
        got = [(r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed) for r in repeats.dedup_substrings(frame(spark, rows)).collect()]
        repeats.removed_ranges.__defaults__ = old
        assert sorted(got, key=order) == sorted(want, key=order)


def test_equal_windows():
    from wirespan.llm.suffix_array import equal_windows

    rng = random.Random(1)
    for _ in range(60):
        n = rng.choice([3, 5, 8])
        texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        places = {}
        for i, x in enumerate(texts):
            for k in range(len(x) - n + 1):
                places.setdefault(x[k : k + n], set()).add((i, k))
        classes = {}
        for c, i, k in zip(*(x.tolist() for x in equal_windows(texts, n))):
            classes.setdefault(c, set()).add((i, k))
        assert {frozenset(x) for x in classes.values()} == {frozenset(x) for x in places.values() if len(x) > 1}


def test_quality(spark):
    from wirespan.llm.quality import fit, keep_good, score_documents, text_statistics

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS[:10]) for _ in range(rng.randrange(30, 90))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "s"))
        labels.append((i, int(good)))
    rows += [(900, None, "s"), (901, "", "s"), (902, "word " * 50_000, "s"), (None, "no id", "s")]
    docs = frame(spark, rows)
    known = spark.createDataFrame([*labels, (5000, 1), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_documents(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    kept = keep_good(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    empty = fit(text_statistics(docs), known.filter("false"))
    assert empty.score(np.zeros((1, 22))).tolist() == [0.5]


def test_mixing(spark, corpus):
    from wirespan.llm.mixing import mix_documents, mixed_rows

    rows = corpus + [(corpus[0][0], corpus[0][1], "s0")]
    got = mix_documents(frame(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, free = {}, sum(sizes.values()), set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] if s in over else weight[s] * level for s in over or free}
        if not over:
            break
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s in sizes:
        assert taken[s] <= target[s] + 1e-6
        assert target[s] - taken[s] <= max(20, 0.1 * target[s])
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_documents(frame(spark, rows)).collect()))
    mixed = mixed_rows(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect()) == sum(taken.values())


def test_empty_tables(spark):
    from wirespan.llm.line_dedup import dedup_lines
    from wirespan.llm.mixing import mix_documents
    from wirespan.llm.ngram_join import jaccard_components
    from wirespan.llm.packing import pack_documents
    from wirespan.llm.quality import score_documents
    from wirespan.llm.repeats import dedup_substrings
    from wirespan.llm.token_files import checksums, round_trip

    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    path = public_tokenizers.path
    for df in (pack_documents(none, path("byte_bpe_50k.json")), checksums(round_trip(none, path("word_bpe_49k.json"))), jaccard_components(none), dedup_lines(none), dedup_substrings(none), mix_documents(none), score_documents(none, labels)):
        assert df.count() == 0
