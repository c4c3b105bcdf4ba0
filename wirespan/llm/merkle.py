"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups' roots.

Leaves are numbered within their group by ranges of the key, so no task holds a group. Each level is one aggregation of
the one below: indices divided by the fanout, the children of a node sorted and hashed. Going down, each level joins its
nodes with what their parents carry and appends the siblings, so every leaf ends with the path that proves it. A level has
1/fanout of the rows of the one below, in that share of its partitions; a path grows by one step a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, stored

#: Levels of paths joined in one plan before they are written.
JOINED = 8


def leaf_digest(*columns: Column) -> Column:
    """sha256 of the columns as text, each '-' if null, else its count of UTF-8 bytes, ':' and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _parts(fanout: int, level: int, whole: int) -> int:
    return max(1, whole // fanout**level)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows (grp, key, digest and others), stored, with n (rows of its grp) and idx (row number in it from 0, by key and digest).

    Rows are dealt and sorted by ranges; a row's number is its place in its range, after the rows of its group in earlier
    ranges. The table of ranges and groups has a row for each pair that occurs.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), "grp", "key", "digest").sortWithinPartitions("grp", "key", "digest")
    table = stored(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33).alias("part")
    counted = table.groupBy("grp", part).agg(F.count("*").alias("c"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(group).alias("n"))
    joined = table.withColumn("part", part).join(offsets, ["grp", "part"])
    return joined.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift", "key")


def _levels(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """From leaves to roots, stored: grp, n (nodes of the level below in it), idx, digest, children (in order) of each node.

    A group with one leaf has one node that is the leaf itself; other nodes are hashes of their children.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    whole, out = partitions(nodes.sparkSession), []
    while not out or most > 1:
        others = [c for c in nodes.columns if c not in ("grp", "n", "idx")]
        runs = nodes.groupBy("grp", "n", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", *others))).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        runs = runs.withColumn("digest", F.when(F.col("n") == 1, joined).otherwise(F.sha2(joined, 256)))
        out.append(stored(runs.coalesce(_parts(fanout, len(out), whole)), f"{name}-{len(out)}"))
        nodes = out[-1].filter(F.col("n") > fanout).select("grp", F.ceil(F.col("n") / fanout).alias("n"), "idx", "digest")
        most = -(-most // fanout)
    return out


def _roots(levels: list[DataFrame], fanout: int) -> DataFrame:
    """grp, digest and level (of the node) of each group's root."""
    out = None
    for k, level in enumerate(levels):
        found = level.filter(F.col("n") <= fanout).select("grp", "digest", F.lit(k).alias("level"))
        out = found if out is None else out.unionAll(found)
    return out


def _down(levels: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The leaves' own columns, digest, subroot and path, from tops (grp, level, subroot, path of the roots); and the tables
    written meanwhile."""
    written, known = [], None
    for k in reversed(range(len(levels))):
        here = tops.filter(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("idx"), "subroot", "path")
        known = here if known is None else known.unionAll(here)
        if known is not here and (len(levels) - 1 - k) % JOINED == 0:
            known = stored(known.coalesce(_parts(fanout, k + 1, partitions(known.sparkSession))), f"{name}-paths-{k}")
            written.append(known)
        rows = levels[k].drop("digest").join(known, ["grp", "idx"])
        rows = rows.select("grp", "n", "subroot", "path", "children", F.posexplode("children").alias("pos", "child"))
        digests = F.transform("children", lambda c: c["digest"])
        before = F.array_join(F.slice(digests, F.lit(1), F.col("pos")), "")
        after = F.array_join(F.slice(digests, F.col("pos") + 2, F.lit(fanout)), "")
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(before, F.lit("|"), after, F.lit("/"), F.col("path"))).alias("path")
        known = rows.select("grp", F.col("child.idx").alias("idx"), "subroot", path, *([F.col("child")] if k == 0 else []))
    return known.select("child.*", "grp", "subroot", "path").drop("idx"), written


def manifest(rows: DataFrame, leaf: Column, group: str = "lang", key: str = "doc_id", fanout: int = 2, carry: dict[str, Column] | None = None) -> DataFrame:
    """The columns of carry (by default key), and leaf, subroot, root, path of each row.

    In each group leaves ascend by key, nulls first, ties by leaf; while a level has more than one node, every fanout
    consecutive ones (the last run may have fewer) become the hash of their digests. What remains is the group's subroot;
    subroots in the order of groups (null first, then by UTF-8 bytes) are the leaves of the tree that gives root. path has a
    step a level from leaf to root, each the digests of the siblings before and after, as 'before|after/'; it is empty where
    a tree has one leaf. Rows that repeat are leaves of their own. An empty table gives no rows.
    """
    carry = {key: F.col(key)} if carry is None else carry
    if clash := set(carry) & {"leaf", "subroot", "root", "path"}:
        raise ValueError(f"carry holds names of the result: {sorted(clash)}")
    spark = rows.sparkSession
    grp = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # null first
    leaves = rows.select(grp.alias("grp"), F.col(key).alias("key"), leaf.alias("digest"), F.struct(*(c.alias(n) for n, c in carry.items())).alias("carried"))
    levels = _levels(_numbered(leaves, "leaves"), fanout, "nodes")
    tops = stored(_roots(levels, fanout), "subroots")
    above = _levels(_numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.struct("grp", "level").alias("top")), "groups"), fanout, "groups")
    root = _roots(above, fanout).select("digest").first()
    root = root[0] if root else None
    starts, first = _down(above, _roots(above, fanout).select("grp", "level", F.lit(None).cast("string").alias("subroot"), F.lit("").alias("path")), fanout, "groups")
    starts = stored(starts.select("top.grp", "top.level", F.col("digest").alias("subroot"), "path"), "starts")
    discard(tops, *above, *first)
    found, _ = _down(levels, starts, fanout, "nodes")
    return found.select("carried.*", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path")


def proof_digest(path: Column) -> Column:
    """sha256 of a path's siblings, level by level, left to right."""
    return F.sha2(F.translate(path, "|/", ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path from manifest lead to."""
    steps = F.split(path, "/")
    steps = F.slice(steps, F.lit(1), F.size(steps) - 1)
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.concat(F.substring_index(step, "|", 1), node, F.substring_index(step, "|", -1)), 256))


def verified(rows: DataFrame) -> DataFrame:
    """rows of manifest with leaf and a column now (the leaf's digest as it is now): adds folded_root and verified."""
    return rows.withColumn("folded_root", folded(F.col("now"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; n_chars is one more when checked than when written
    in rows where 7 divides the crc32 of doc_id."""
    columns = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    n_chars = F.col("n_chars")
    leaf = leaf_digest(*columns(n_chars))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    later = F.when(tampered, leaf_digest(*columns(n_chars.cast("decimal(38,0)") + 1)))
    rows = manifest(docs, leaf, carry={"doc_id": F.col("doc_id"), "later": later})
    rows = verified(rows.withColumn("now", F.coalesce("later", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


#: tamper_check in DuckDB: nodes(tree, level, idx, digest), a tree for each lang and one, named null, over their roots.
SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    n_chars::HUGEINT AS n, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS (
  SELECT *, sha256(head || coalesce(strlen(n::VARCHAR) || ':' || n, '-') || tail) AS leaf, sha256(head || coalesce(strlen((n + 1)::VARCHAR) || ':' || (n + 1), '-') || tail) AS other FROM rows),
placed AS (SELECT doc_id, tree, leaf, other, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level, idx, sha256(string_agg(digest, '' ORDER BY place)) AS digest, (n + 1) // 2 FROM (SELECT tree, level + 1 AS level, idx // 2 AS idx, idx AS place, digest, n FROM nodes WHERE n > 1) GROUP BY tree, level, idx, n),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, idx, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level, idx, sha256(string_agg(digest, '' ORDER BY place)) AS digest, (n + 1) // 2 FROM (SELECT level + 1 AS level, idx // 2 AS idx, idx AS place, digest, n FROM upper WHERE n > 1) GROUP BY level, idx, n),
walk AS (
  SELECT p.doc_id, p.tree, p.leaf, p.idx AS leaf_idx, 0 AS top, 0 AS level, p.idx AS idx, (SELECT max(n) FROM nodes x WHERE x.tree = p.tree AND level = 0) AS n, '' AS proof, CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS node
  FROM (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) AS crc FROM placed) p
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf, w.leaf_idx, CASE WHEN w.n = 1 THEN 1 ELSE w.top END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN r.idx ELSE w.idx // 2 END, CASE WHEN w.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (w.n + 1) // 2 END,
    w.proof || CASE WHEN w.n = 1 THEN '' ELSE coalesce(s.digest, u.digest, '') END,
    CASE WHEN w.n = 1 THEN w.node WHEN w.idx % 2 = 1 THEN sha256(coalesce(s.digest, u.digest, '') || w.node) ELSE sha256(w.node || coalesce(s.digest, u.digest, '')) END
  FROM walk w JOIN subroots r ON r.tree = w.tree
  LEFT JOIN nodes s ON w.top = 0 AND w.n > 1 AND s.tree = w.tree AND s.level = w.level AND s.idx = xor(w.idx, 1)
  LEFT JOIN upper u ON w.top = 1 AND w.n > 1 AND u.level = w.level AND u.idx = xor(w.idx, 1)
  WHERE w.n > 1 OR w.top = 0)
SELECT w.doc_id, w.leaf, r.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = t.digest AS verified
FROM walk w JOIN subroots r ON r.tree = w.tree JOIN upper t ON t.n = 1
WHERE w.top = 1 AND w.n = 1
"""
