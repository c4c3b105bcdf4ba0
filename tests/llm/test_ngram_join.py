"""The n-gram join against brute force where passages are in many documents, and where doc_ids are null or repeat."""

import random

import pytest

from wirespan.llm import ngram_join

SCHEMA = "doc_id long, text string, node long, block int, n int, gram long, a long"


def components(rows, percent=75):
    """Smallest doc_id of each row's component, None where it has none, by comparing all pairs."""
    sets = []
    for _, t in rows:
        words = (t or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), least.get(find(i)) if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))]


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)
    return [tuple(r) for r in ngram_join.jaccard_components(docs).collect()]


def order(x):
    return tuple((v is not None, v) for v in x)


@pytest.mark.parametrize("seed, frequent, listed, side", [(1, 2, 1_000_000, 3), (2, 1, 1_000_000, 1024), (3, 2, 40, 4), (4, 0, 1_000_000, 2)])
def test_passages_in_many_documents(spark, monkeypatch, seed, frequent, listed, side):
    for name, value in (("FREQUENT", frequent), ("LISTED", listed), ("SIDE", side)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(seed)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [own(n) for n in (60, 40, 25)]
    texts = [passages[0] + own(k % 24) for k in range(70)]  # one passage, and more or fewer words beside it
    texts += [own(rng.randrange(6)) + passages[k % 3] + own(rng.randrange(6)) + passages[(k + 1) % 3] for k in range(40)]
    for _ in range(70):  # copies with changed words, similar to their source or not
        copy = passages[0] + passages[1]
        for k in rng.sample(range(100), rng.randrange(9)):
            copy[k] = own(1)[0]
        texts.append(copy)
    texts += [passages[2][: rng.randrange(3, 25)] for _ in range(20)] + [own(30) for _ in range(10)]
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
    assert sorted(found(spark, rows)) == sorted(components(rows))


def test_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(100)]
    near = lambda *ks: " ".join("x" if k in ks else w for k, w in enumerate(words))
    rows = [(1, near()), (None, near(50, 51)), (3, near(50, 51, 90, 91, 92, 10)), (None, "quite alone"), (None, None), (7, None), (7, ""), (8, near(50, 51)), (8, "another text of the same id in here"), (8, near(50, 51))]
    rows += [(None, near(50, 51))] * 3
    assert sorted(found(spark, rows), key=order) == sorted(components(rows), key=order)
    assert len({i for _, _, i in components(rows)[:3]}) == 1  # the row without an id joins the two beside it
