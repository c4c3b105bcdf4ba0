"""WARC archives, Merkle manifest and fill-in-middle against direct computation."""

import hashlib
import io
import random
import re
import struct
import zlib

import pytest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Fill in middle


def lines_of(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def expected_middle(doc_id, text, rate=100, spm_rate=50, seed="7"):
    text = text or ""
    g = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = lines_of(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(5)
    texts = ["", None, "\n", "\n\n\n", "one", "one\n", "a\n\nb", "é\n漢字\U0001f600\nü", "\r\n\r\n", "<P>\nx", "x <\nS>y\n", "ends <\n", "<\n<\n<", "l1\n" * 5000 + "x" * 300_000]
    return texts + ["".join(rng.choice("ab \n<PSM>é\U0001f600") for _ in range(rng.randrange(60))) for _ in range(120)]


@pytest.mark.parametrize("rates", [(100, 50), (40, 100), (0, 0)])
def test_fill_in_middle_against_lines(spark, rates):
    from pyspark.sql import functions as F

    from wirespan.llm.fill_in_middle import fill_in_middle, restored

    rows = [(k, t, "keep", "n?") for k, t in enumerate(odd_texts())] + [(None, "a\nb\nc\n", "keep", "x"), (3, "\n\n\n", "keep", "x"), (3, "\n\n\n", "keep", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ranks string, form string").repartition(3)
    out = fill_in_middle(docs, rate=rates[0], spm_rate=rates[1])
    assert out.columns == ["doc_id", "text", "ranks", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((expected_middle(i, t, *rates) for i, t, _, _ in rows), key=key)
    assert all(r.back == (r.text or "") and r.ranks == "keep" for r in got)


def test_units_and_sentinels(spark):
    import numpy as np

    from wirespan.llm.fill_in_middle import Sentinels, boundaries, fill_in_middle, restored

    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4")
    assert boundaries(codes("a  b\tc d "), "word").tolist() == [0, 3, 5, 7, 9]
    assert boundaries(codes(" a"), "word").tolist() == [0, 1, 2]
    assert boundaries(codes("aé\U0001f600"), "char").tolist() == [0, 1, 2, 3]
    assert boundaries(codes("")).tolist() == [0]
    for wrong in (("", "b", "c"), ("ab", "b", "c"), ("ab", "ba", "c"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            Sentinels(*wrong)
    marks = Sentinels("|pre|x", "|suf|y", "\\E[mid]")
    docs = spark.createDataFrame([(k, "words of some text | and more " * 3) for k in range(40)], "doc_id long, text string")
    for unit in ("word", "char", "line"):
        out = fill_in_middle(docs, unit, sentinels=marks)
        from pyspark.sql import functions as F

        rows = out.withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
        assert {r.form for r in rows} == {"psm", "spm"} and all(r.back == r.text for r in rows)
    with pytest.raises(ValueError):
        fill_in_middle(docs, "page")


# Merkle manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def expected_manifest(rows, fanout):
    """leaf, subroot, root and the siblings before and after, level by level, of each of (lang, key, leaf)."""
    groups = {}
    for lang, key, leaf in rows:
        groups.setdefault(lang, []).append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels_of([x[2] for x in sorted(groups[g])], fanout) for g in order]
    upper = levels_of([t[-1][0] for t in trees], fanout)
    out = []
    for at_group, (g, tree) in enumerate(zip(order, trees)):
        for i, (some, key, leaf) in enumerate(sorted(groups[g])):
            path, node = "", leaf
            for levels, at in ((tree, i), (upper, at_group)):
                for level in levels[:-1]:
                    start = at // fanout * fanout
                    run = level[start : start + fanout]
                    path += f"{''.join(run[: at - start])}|{''.join(run[at - start + 1 :])}/"
                    at //= fanout
            out.append((key if some else None, leaf, tree[-1][0], upper[-1][0], path))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 16])
@pytest.mark.parametrize("sizes", [(1,), (2, 1), (37, 5, 1, 8), (1, 1, 1, 1, 1)])
def test_manifest_against_direct_tree(spark, fanout, sizes):
    from pyspark.sql import functions as F

    from wirespan.llm.merkle import folded, leaf_digest, manifest

    langs = [None, "", "z", "é", "Z"]
    rows = [(langs[g], None if i == 3 else 100 - i // 2, f"text {g} {i // 2}", "own") for g, n in enumerate(sizes) for i in range(n)]
    table = spark.createDataFrame(rows, "lang string, doc_id long, text string, digest string").repartition(3)
    got = manifest(table, leaf_digest(F.col("doc_id"), F.col("text")), fanout=fanout)
    got = got.withColumn("back", folded(F.col("leaf"), F.col("path"))).collect()
    want = expected_manifest([(lang, i, sha(field(i), field(t))) for lang, i, t, _ in rows], fanout)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert all(r.back == r.root for r in got)


def test_tampering_is_found(spark):
    from wirespan.llm.merkle import tamper_check

    rows = [(i, f"t{i}", [None, "en", "de"][i % 3], "s", None if i % 5 == 0 else i) for i in range(200)] + [(None, "x", "en", None, 2**63 - 1), (7, "t7", "en", "s", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = tamper_check(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1
    for r in got:
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.doc_id % 5 != 0
        assert r.verified is not changed and (r.folded_root == r.root) is not changed
    assert any(not r.verified for r in got)
    assert tamper_check(spark.createDataFrame([], schema)).count() == 0


# WARC


PAGES = "page_id long, url string, html string, payload string, first string"


def odd_pages():
    same, rng = "<p>same words in each copy</p>" * 5, random.Random(2)
    prose = lambda: " ".join(rng.choice(["<p>", "</p>", "alpha", "beta", "gamma", "é", "漢"]) for _ in range(rng.randrange(400)))
    rows = [(k, f"http://x/{k}", prose()) for k in range(60)]
    rows += [(100 + k, f"http://y/{k}?a=b c\r\nWARC-Type: x%0A é", same) for k in range(40)] + [(99, None, same), (99, "http://z", same), (99, None, same), (None, "http://n", same), (None, None, None)]
    rows += [(200, "u", None), (201, "u", ""), (202, "v", "x" * 99), (203, "v", "x" * 99), (204, "v", "x" * 100), (205, "v", "x" * 100), (206, "v", "é" * 50), (207, "v", "é" * 50), (-5, "neg", "x" * 100), (300, "long", prose() * 3000), (301, "crlf", "a\r\n\r\nb\r\n\r\n" * 20)]
    return [(*r, "p", "f") for r in rows]


def expected_records(rows):
    firsts = {}
    for page_id, url, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            place = (page_id, url is not None, url or "")
            firsts[data] = min(firsts.get(data, place), place)
    out = []
    for page_id, url, html, *_ in rows:
        data = (html or "").encode()
        first = firsts.get(data)
        refers = first[0] if first and page_id is not None and (page_id, url is not None, url or "") != first else None
        out.append((page_id, url, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers, None if refers is not None else data))
    return out


def test_archives_round_trip(spark, tmp_path):
    from wirespan.llm.warc import read_archives, read_records, write_archives

    rows = odd_pages()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = f"file://{tmp_path}/w"
    write_archives(pages, path, sample_bytes=20_000)
    (tmp_path / "w" / "archives" / "000000-left-by-a-lost-task.warc.zst").write_bytes(b"half a record")
    got = [tuple(r) for r in read_archives(spark, path).collect()]
    key = lambda r: tuple(map(str, r[:6]))
    as_bytes = lambda r: (*r[:6], None if r[6] is None else bytes(r[6]))
    assert sorted(map(as_bytes, got), key=key) == sorted(expected_records(rows), key=key)
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == len(rows)
    some = read_records(index.filter("record_type = 'revisit' or record_id = 'urn:page:300'"), path).collect()
    assert sorted(map(as_bytes, map(tuple, some)), key=key) == sorted((r for r in expected_records(rows) if r[4] == "revisit" or r[0] == 300), key=key)


def test_archive_layout(spark, tmp_path):
    import zstandard

    from wirespan.llm.warc import frames, parsed, write_archives

    words = [f"word{k}" for k in range(300)]
    rng = random.Random(1)
    shared = " ".join(rng.choice(words) for _ in range(200))
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<html><body><nav>{shared}</nav>" + " ".join(rng.choice(words) for _ in range(100)) + "</body></html>") for k in range(200)], "page_id long, url string, html string").coalesce(1)
    write_archives(pages, f"file://{tmp_path}/w")
    (path,) = (tmp_path / "w" / "archives").glob("*.warc.zst")
    data = path.read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert struct.unpack("<I", raw[:4])[0] == 0xEC30A437
    dictionary = zstandard.ZstdCompressionDict(raw)
    rest, count, lengths = data[8 + size :], 0, 0
    while rest:
        assert zstandard.get_frame_parameters(rest).dict_id == dictionary.dict_id()
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        fields, _ = parsed(one.decompress(rest))
        assert fields["warc-type"] == ("response" if count else "warcinfo")
        rest, count, lengths = one.unused_data, count + 1, lengths + len(rest) - len(one.unused_data)
    assert count == 201 and len(list(frames(io.BytesIO(data)))) == 201
    plain = sum(len(zstandard.compress(r.html.encode(), 3)) for r in pages.collect())
    assert lengths < 0.8 * plain  # the dictionary holds what the records share
    for cut in (len(data) - 3, 8 + size + 2, len(data) // 2):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(frames(io.BytesIO(data[:cut])))


def test_small_archives_have_no_dictionary(spark, tmp_path):
    from wirespan.llm.warc import read_archives, write_archives

    write_archives(spark.createDataFrame([(1, None, "x")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert [tuple(r) for r in read_archives(spark, f"file://{tmp_path}/w", payloads=False).collect()] == [(1, None, 1, hashlib.sha256(b"x").hexdigest(), "response", None)]
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert read_archives(spark, f"file://{tmp_path}/none").count() == 0
