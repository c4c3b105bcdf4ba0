"""Vector searches: exact top-k by ball trees, and approximate neighbours by balanced posting lists.

The stated queries are rows of the table. They travel in blocks of bounded size, and vectors in shards or lists of
bounded size, so each task holds one of each; what a query found travels as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
SHARD_ROWS = 8192
LEAF_ROWS = 64
BLOCK_QUERIES = 512


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (array of doubles) of rows with a vec_id and a vector of finite numbers."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def _one_each(rows: DataFrame) -> DataFrame:
    """One row for each vec_id: of rows that repeat one, that with the least vector."""
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _one_length(rows: DataFrame) -> DataFrame:
    """Rows whose vectors have the commonest length (the shorter of equally common ones); others take no part."""
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    return rows.filter(F.size("v") == (lengths.d if lengths else 0))


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _packed(rows: DataFrame, key: Column, kind: str, dtype: str) -> DataFrame:
    """Rows of a group as one blob: part long, ids binary, data binary, n long, dim int; groups are bounded by key."""

    def blobs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            part = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            data = _matrix(batch.column(2)).astype(dtype)
            for p in np.unique(part).tolist():
                own = part == p
                held.setdefault(p, []).append((ids[own], data[own]))
        for p, parts in held.items():
            ids = np.concatenate([x[0] for x in parts])
            data = np.concatenate([x[1] for x in parts])
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([data[order].tobytes()], pa.binary()), pa.array([len(ids)], pa.int64())], ["part", "ids", "data", "n"])

    return rows.select(key.cast("long").alias("part"), "vec_id", "v").repartition("part").mapInArrow(blobs, "part long, ids binary, data binary, n long")


class BallTree:
    """Balls over integer vectors, split at the median of the widest direction between two far points."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, leaf: int = LEAF_ROWS):
        self.ids, self.data = ids, data
        order = np.arange(len(ids))
        self.start, self.stop, self.left, self.right = [], [], [], []
        centres, radii = [], []

        def grow(a: int, b: int) -> int:
            node = len(self.start)
            own = data[order[a:b]].astype(np.float64)
            centre = own.mean(0)
            far = ((own - centre) ** 2).sum(1)
            centres.append(centre)
            radii.append(np.sqrt(far.max()) * (1 + 1e-12))
            self.start.append(a)
            self.stop.append(b)
            self.left.append(-1)
            self.right.append(-1)
            if b - a > leaf and far.max() > 0:
                one = own[far.argmax()]
                two = own[((own - one) ** 2).sum(1).argmax()]
                split = np.argsort(own @ (two - one), kind="stable")
                order[a:b] = order[a:b][split]
                middle = (a + b) // 2
                self.left[node] = grow(a, middle)
                self.right[node] = grow(middle, b)
            return node

        if len(ids):
            grow(0, len(ids))
        self.order = order
        self.rows = data[order].astype(np.float64)
        self.row_ids = ids[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, smaller id) of each query other than its own row with scores of at least `least`.

        Branch and bound for all queries of the block together: a node is visited by the queries whose upper bound
        q.c + |q| r reaches their current kth score; of two children the one with the larger bounds comes first, so
        that kth scores rise early. Returns scores (-inf where fewer) and ids, best first.
        """
        m = len(queries)
        scores, found = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
        if not len(self.ids):
            return scores, found
        norms = np.sqrt((queries**2).sum(1)) * (1 + 1e-12)
        bounds = queries @ self.centres.T + norms[:, None] * self.radii[None, :] + 1e-6
        kth = least.astype(np.float64).copy()
        stack = [(0, np.arange(m))]
        while stack:
            node, who = stack.pop()
            who = who[bounds[who, node] >= kth[who]]
            if not len(who):
                continue
            if self.left[node] >= 0:
                two = sorted((self.left[node], self.right[node]), key=lambda c: bounds[who, c].sum())
                stack += [(c, who) for c in two]
                continue
            at = slice(self.start[node], self.stop[node])
            got = queries[who] @ self.rows[at].T
            got[self.row_ids[at][None, :] == own[who][:, None]] = -np.inf
            got[got < kth[who][:, None]] = -np.inf
            some = np.flatnonzero((got > -np.inf).any(1))
            who, got = who[some], got[some]
            if not len(who):
                continue
            all_scores = np.hstack([scores[who], got])
            all_ids = np.hstack([found[who], np.broadcast_to(self.row_ids[at], got.shape)])
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[who] = np.take_along_axis(all_scores, best, 1)
            found[who] = np.take_along_axis(all_ids, best, 1)
            kth[who] = np.maximum(kth[who], scores[who, -1])
        return scores, found


HITS = "query_id long, vec_id long, score double"


def exact_top_k(rows: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products with all other rows.

    rows: vec_id long (of repeated ids the least vector counts), v array of whole numbers. Rows are dealt by a hash of vec_id to shards of about shard_rows, each with its own ball tree. The first
    round searches each query in one shard; its kth score bounds the second round in all other shards, where only
    nodes that may reach it are opened. Fewer rows than k give all; ties go to smaller vec_id; no rows give none.
    """
    spark = rows.sparkSession
    rows = _one_length(stored(_one_each(rows).withColumn("is_query", F.coalesce(is_query, F.lit(False))), "vectors"))
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    packed = stored(_packed(rows, dealt, "shard", "int64").select(F.col("part").alias("shard"), "ids", "data", "n"), "shards")
    queries = rows.filter("is_query").select("vec_id", "v", dealt.alias("home"))
    n_blocks = max(1, -(-queries.count() // (BLOCK_QUERIES * max(1, shards))))

    def search(first: bool):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            tree, shard = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if shard != r["shard"]:
                        ids = np.frombuffer(r["ids"], np.int64)
                        tree, shard = BallTree(ids, np.frombuffer(r["data"], np.int64).reshape(len(ids), -1)), r["shard"]
                    own = np.frombuffer(r["q_ids"], np.int64)
                    q = np.frombuffer(r["q_data"], np.int64).reshape(len(own), -1).astype(np.float64)
                    least = np.full(len(own), -np.inf) if first else np.frombuffer(r["least"], np.float64)
                    scores, found = tree.search(q, own, least, k)
                    there = scores > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, there.sum(1))), pa.array(found[there]), pa.array(scores[there])], ["query_id", "vec_id", "score"])

        return run

    # Round one: blocks of queries of one shard.
    home = stored(_packed(queries, F.col("home") * n_blocks + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)), "block", "int64").select("part", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "query-blocks")
    at_home = home.withColumn("shard", F.floor(F.col("part") / n_blocks)).join(packed, "shard")
    near = stored(at_home.mapInArrow(search(True), HITS), "near")
    kth = near.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("least")).select("query_id", F.when(F.col("c") >= k, F.col("least")).otherwise(float("-inf")).alias("least"))
    # Round two: every block, with its kth scores, in every other shard.
    known = kth.join(queries.select(F.col("vec_id").alias("query_id"), "home").distinct(), "query_id")
    part = F.col("home") * n_blocks + F.pmod(F.xxhash64(F.col("query_id"), F.lit(1)), F.lit(n_blocks))
    levels = known.groupBy(part.alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("query_id", "least"))).alias("levels"))

    def aligned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            least = []
            for ids, level in zip(batch.column("q_ids").to_pylist(), batch.column("levels").to_pylist(), strict=True):
                level = dict(level or [])
                least.append(np.array([level.get(i, -np.inf) for i in np.frombuffer(ids, np.int64).tolist()], np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("q_ids"), batch.column("q_data"), pa.array(least, pa.binary())], ["part", "q_ids", "q_data", "least"])

    bounded = home.join(levels, "part", "left").select("part", "q_ids", "q_data", "levels").mapInArrow(aligned, "part long, q_ids binary, q_data binary, least binary")
    others = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != F.floor(F.col("part") / n_blocks))
    far = others.join(packed, "shard").mapInArrow(search(False), HITS)
    return ranked(near.union(far), k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query's hits; each task has sent at most k of them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, of the valid rows."""
    return valid(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


# Approximate neighbours.

SAMPLE_ROWS = 20_000
LIST_ROWS = 200
MOST_LISTS = 16_384
COPIES = 2
STRETCH = 1.15
PROBE_STRETCH = 1.6
#: Recall that the number of lists to search is set for, on sampled rows.
RECALL = 0.96
PART_ROWS = 4096
#: Hits that a task holds before it keeps each query's best alone.
HELD_HITS = 400_000


def balanced_centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of lists of about equal size: Lloyd rounds whose distances carry a penalty that grows with a list's load."""
    rng = np.random.Generator(np.random.PCG64(seed))
    lists = max(1, min(lists, len(sample)))
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    penalty = np.zeros(lists)
    fair = len(sample) / lists
    for _ in range(rounds):
        near = _nearest(sample, centres, penalty)
        load = np.bincount(near, minlength=lists)
        scale = ((sample - centres[near]) ** 2).sum(1).mean() or 1.0
        penalty = np.clip(penalty + 0.1 * scale * np.clip(load / fair - 1, -1, 2), -scale, scale)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        full = load > 0
        centres[full] = sums[full] / load[full, None]
        if (~full).any():
            centres[~full] = sample[rng.choice(len(sample), int((~full).sum()))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    cost = (centres**2).sum(1) + penalty
    return np.concatenate([(cost - 2 * (x[a : a + 2048] @ centres.T)).argmin(1) for a in range(0, len(x), 2048)] or [np.zeros(0, int)])


class CentreGraph:
    """A graph of near centres, held in memory, and best-first search in it."""

    def __init__(self, centres: np.ndarray, degree: int = 24, seed: int = 5):
        n = len(centres)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.centres = centres
        self.squares = (centres**2).sum(1)
        near = min(degree, n - 1)
        links = []
        for a in range(0, n, 1024):
            d = self.squares - 2 * (centres[a : a + 1024] @ centres.T)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            links.append(np.argpartition(d, near - 1, axis=1)[:, :near] if near else np.zeros((len(d), 0), int))
        far = rng.integers(0, n, (n, 8))  # long links keep the graph connected
        self.links = np.hstack([np.concatenate(links), far])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, x: np.ndarray, wanted: int, beam: int = 48, hops: int = 40) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the near centres, nearest first, and their squared distances; all rows step together."""
        m, n = len(x), len(self.centres)
        wanted, beam = min(wanted, n), min(max(beam, wanted), n)
        own = (x**2).sum(1)
        seen = np.zeros((m, n), bool)
        front = np.full((m, beam), -1)
        dist = np.full((m, beam), np.inf)
        done = np.zeros((m, beam), bool)
        rows = np.arange(m)

        def take(new: np.ndarray) -> None:  # new: (m, c) centre numbers, -1 for none
            nonlocal front, dist, done
            fresh = (new >= 0) & ~seen[rows[:, None], np.maximum(new, 0)]
            ordered = np.sort(np.where(fresh, new, -1), axis=1)
            fresh = ordered >= 0
            fresh[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
            r, c = np.nonzero(fresh)
            seen[r, ordered[r, c]] = True
            d = np.full(ordered.shape, np.inf)
            d[r, c] = self.squares[ordered[r, c]] - 2 * np.einsum("ij,ij->i", x[r], self.centres[ordered[r, c]]) + own[r]
            front, dist, done = np.hstack([front, np.where(fresh, ordered, -1)]), np.hstack([dist, d]), np.hstack([done, np.zeros(d.shape, bool)])
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            front, dist, done = (np.take_along_axis(y, best, 1) for y in (front, dist, done))

        take(np.broadcast_to(self.entries, (m, len(self.entries))))
        for _ in range(hops):
            open_ = np.where(done | (front < 0), np.inf, dist)
            next_ = np.argsort(open_, axis=1)[:, :4]
            live = np.isfinite(np.take_along_axis(open_, next_, 1))
            if not live.any():
                break
            np.put_along_axis(done, next_, np.take_along_axis(done, next_, 1) | live, 1)
            at = np.take_along_axis(front, next_, 1)
            new = np.where(live[:, :, None], self.links[np.maximum(at, 0)], -1).reshape(m, -1)
            take(new)
        return front[:, :wanted], np.maximum(dist[:, :wanted], 0)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """One more component, so that nearness in distance orders as inner products do with queries of component 0."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]])


def probes_for(sample: np.ndarray, centres: np.ndarray, most: float, k: int, recall: float = RECALL, tried: int = 300) -> int:
    """How many lists a query must search so that sampled queries find that share of their k best sampled rows.

    Among more rows the best are nearer to the query, so the number holds for tables larger than the sample.
    """
    lifted = _lifted(sample, most)
    squares = (centres**2).sum(1)
    picks = np.linspace(0, len(sample) - 1, min(tried, len(sample))).astype(int)
    ranks = []
    for i in picks.tolist():
        scores = sample @ sample[i]
        scores[i] = -np.inf
        best = np.argsort(-scores)[: min(k, len(sample) - 1)]
        if not len(best):
            return 1
        query = np.append(sample[i] * np.sqrt(most / max((sample[i] ** 2).sum(), 1e-300)), 0.0)
        far = squares - 2 * (centres @ query) + most
        rank = np.empty(len(centres), int)
        rank[np.argsort(far)] = np.arange(len(centres))
        own = squares - 2 * (lifted[best] @ centres.T) + (lifted[best] ** 2).sum(1)[:, None]
        lists = np.argsort(own, axis=1)[:, :COPIES]
        near = np.take_along_axis(own, lists, 1)
        listed = np.sqrt(np.maximum(near, 0)) <= STRETCH * np.sqrt(np.maximum(near[:, :1], 0)) + 1e-9
        ranks.append(np.where(listed, rank[lists], len(centres)).min(1))
    return int(np.quantile(np.concatenate(ranks), recall)) + 2


def nearest_lists(rows: DataFrame, is_query: Column, k: int = K, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products that each query finds in its posting lists.

    rows: vec_id long, v array of doubles, all of one length and not zero. Centres are fitted on at most sample_rows
    rows (those with the smallest hashes of vec_id); every row is then listed at its nearest centre and, near a
    boundary, at up to COPIES centres within STRETCH of the nearest distance. A query takes the centres that the graph
    finds nearest, as many as probes_for says, within PROBE_STRETCH times the nearest distance. Lists longer than PART_ROWS are split in
    parts that all its queries meet, so common vectors spread over tasks. Fewer rows than k give all rows found.
    """
    spark = rows.sparkSession
    rows = _one_length(stored(_one_each(rows).withColumn("is_query", F.coalesce(is_query, F.lit(False))), "vectors"))
    n, most = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, sample_rows / n)
    hashed = (F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)) < 1.5 * share
    picked = rows.filter(hashed).orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(sample_rows)
    sample = np.array([r.v for r in picked.select("v").toLocalIterator()])
    if not len(sample):
        sample = np.array([r.v for r in rows.select("v").limit(sample_rows).collect()])
    centres = balanced_centres(_lifted(sample, most), min(MOST_LISTS, max(1, len(sample) // 8), -(-n // list_rows)))
    probes = probes_for(sample, centres, most, k)
    graph = spark.sparkContext.broadcast(CentreGraph(centres))

    def listed(query: bool):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    x = _matrix(part.column(1))
                    z = np.hstack([x * np.sqrt(most / np.maximum((x**2).sum(1), 1e-300))[:, None], np.zeros((len(x), 1))]) if query else _lifted(x, most)
                    near, dist = graph.value.search(z, probes if query else COPIES)
                    stretch = PROBE_STRETCH if query else STRETCH
                    keep = (near >= 0) & (np.sqrt(dist) <= stretch * np.sqrt(dist[:, :1]) + 1e-9)
                    if query:  # as many lists as k results need at least
                        keep[:, :8] = near[:, :8] >= 0
                    r, c = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(near[r, c]), part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r)), pa.array(c == 0)], ["list", "vec_id", "v", "first"])

        return run

    lists = stored(rows.select("vec_id", "v").mapInArrow(listed(False), "list long, vec_id long, v array<double>, first boolean"), "postings")
    loads = lists.groupBy("list").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / PART_ROWS).cast("int"))
    loads = stored(loads, "loads")
    cut = lists.join(F.broadcast(loads.select("list", "parts")), "list").withColumn("p", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    width = 1 << 20
    packed = stored(_packed(cut, F.col("list") * width + F.col("p"), "list", "float64"), "lists")
    asked = rows.filter("is_query").select("vec_id", "v").mapInArrow(listed(True), "list long, vec_id long, v array<double>, first boolean")
    asked = asked.join(F.broadcast(loads.select("list", "parts")), "list").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    salt = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(max(1, n // 100_000)))  # blocks of a list's queries
    blocks = _packed(asked, (F.col("list") * width + F.col("p")) * 4096 + salt % 4096, "queries", "float64")
    blocks = blocks.select(F.shiftright("part", 12).alias("part"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The k best of each query so far, each vector once."""
            own, ids, score = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.lexsort((ids, -score, own))
            own, ids, score = own[order], ids[order], score[order]
            once = np.ones(len(own), bool)  # copies of a row in two lists have the same score, so they stand together
            once[1:] = (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])
            own, ids, score = own[once], ids[once], score[once]
            top = np.arange(len(own)) - np.searchsorted(own, own) < k
            return own[top], ids[top], score[top]

        for batch in batches:
            for r in batch.to_pylist():
                ids, own = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                data, q = np.frombuffer(r["data"]).reshape(len(ids), -1), np.frombuffer(r["q_data"]).reshape(len(own), -1)
                for a in range(0, len(own), 256):
                    got = q[a : a + 256] @ data.T
                    got[own[a : a + 256][:, None] == ids[None, :]] = -np.inf
                    kth = np.partition(got, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                    # Products as one sum a row, equal for equal vectors; a margin covers the matrix product's rounding.
                    i, j = np.nonzero((got >= kth[:, None] - 1e-9 * (1 + np.abs(kth[:, None]))) & (got > -np.inf))
                    held.append((own[a + i], ids[j], (q[a + i] * data[j]).sum(1)))
                    size += len(i)
                    if size > HELD_HITS:
                        held = [merged()]
                        size = len(held[0][0])
                        if size > HELD_HITS // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["query_id", "vec_id", "score"])
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["query_id", "vec_id", "score"])

    hits = blocks.join(packed, "part").select("ids", "data", "q_ids", "q_data").mapInArrow(search, HITS)
    return ranked(hits.dropDuplicates(["query_id", "vec_id"]), k)
