"""Merkle manifest of a dataset: a node store on disk, built level by level, and proofs read back from it.

The node store is Parquet partitioned by level (``level=k``), rows keyed by the coordinate (tree, position). Trees are the groups
(``lang``) and, above them, one tree over their roots. Leaves are written in sorted runs, which gives every leaf
its position without a task that sees all of a group; a level is written from the one below, each node from the run of
its consecutive children, which come together by the parent's coordinate, ``FANOUT`` at most. Proofs go the other way: each
level is joined by coordinate with the paths of the level above (sort-merge, one row a side for each key) and hands every
node the path to the root once; only the lowest level spreads it over its leaves. So what is shuffled for proofs is one
row for each node of level 1, not one for each leaf and level.

Defined results: a leaf is the digest of its columns, each ``-`` for null, else byte count, colon, value. Within a group
leaves ascend by doc_id (null first), then digest, so ties and fully repeated rows have one result; null groups
come first; text of any length is hashed whole; an empty table gives an empty result; columns besides the five named, of
any name, are ignored. Rows without doc_id are never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scans import indexed
from .common import Workspace

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A path's step: digests of the siblings left and right of the node, joined.
_STEP = "array<struct<l:string,r:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[_field(fields[c]) for c in COLUMNS]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _parents(nodes: DataFrame, ws: Workspace, name: str, keep: list[str]) -> DataFrame:
    """The level above ``nodes`` (tree, pos, n nodes of the tree, digest): each node with its children in order."""
    child = F.struct("pos", "digest", *keep)
    rows = nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("parent"), "n").agg(F.array_sort(F.collect_list(child)).alias("children"))
    digest = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
    return ws.keep(rows.select("tree", F.col("parent").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), digest.alias("digest"), "children"), name)


def _build(nodes: DataFrame, ws: Workspace, name: str, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """All levels above written ``nodes``, lowest first, and the root of each tree (tree, digest). A tree takes part in a level while
    it has several nodes below it."""
    levels, roots = [], nodes.where("n = 1").select("tree", "digest")
    while (most := nodes.agg(F.max("n")).first()[0]) is not None and most > 1:
        nodes = _parents(nodes.where("n > 1"), ws, f"{name}/level={len(levels) + 1}", keep if not levels else [])
        levels.append(nodes)
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest"))
    return levels, roots


def _spread(level: DataFrame, above: DataFrame | None, columns: list[str]) -> DataFrame:
    """The children of a level's nodes, each with its steps up to the tree's root; ``above`` has those of the nodes themselves."""
    if above is not None:
        level = level.join(above.hint("merge").select("tree", "pos", "steps"), ["tree", "pos"], "left")
        level = level.withColumn("steps", F.coalesce("steps", F.expr(f"cast(array() AS {_STEP})")))
    else:
        level = level.withColumn("steps", F.expr(f"cast(array() AS {_STEP})"))
    joined = lambda cs: F.array_join(F.transform(cs, lambda c: c["digest"]), "")
    own = lambda c, i: F.struct(c.alias("c"), joined(F.slice("children", F.lit(1), i)).alias("l"), joined(F.slice("children", i + 2, F.lit(FANOUT))).alias("r"))
    rows = level.select("tree", "steps", F.explode(F.transform("children", own)).alias("x"))
    steps = F.concat(F.array(F.struct("x.l", "x.r")), "steps").alias("steps")
    return rows.select("tree", "x.c.pos", "x.c.digest", *[f"x.c.{c}" for c in columns], steps)


def _paths(levels: list[DataFrame], ws: Workspace, name: str, columns: list[str]) -> DataFrame | None:
    """Every node below the lowest level with its steps up to its tree's root."""
    above = None
    for k in reversed(range(1, len(levels))):
        above = ws.keep(_spread(levels[k], above, []), f"{name}-paths-{k}")
    return _spread(levels[0], above, columns) if levels else None


def manifest(docs: DataFrame, ws: Workspace, tamper: Column | None = None) -> DataFrame:
    """One row per document: leaf, subroot of its group, root, digest of its proof, the root folded from the leaf as it is found
    now (with ``tamper``, a boolean column over ``doc_id``, texts of those rows are lower-cased first), and whether that is the root.

    Returned rows read tables of the workspace; the caller drops it when done."""
    docs = docs.select(*[F.col(f"`{c}`").cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in COLUMNS])
    own = {c: F.col(c) for c in COLUMNS}
    found = F.lit(None).cast("string") if tamper is None else F.when(tamper, leaf_digest(own | {"text": lower_ascii(own["text"])}))
    leaves = ws.keep(docs.select("lang", "doc_id", leaf_digest(own).alias("digest"), found.alias("found")), "leaf-digests")
    leaves = ws.keep(indexed(leaves, ["lang", "doc_id", "digest", "found"], ws, "leaf-runs"), "leaves-placed")
    groups = ws.keep(leaves.groupBy("lang").agg(F.min("index").alias("tree"), F.count("*").alias("n")), "groups")
    same = leaves["lang"].eqNullSafe(groups["lang"])
    nodes = leaves.join(groups, same).select("tree", (F.col("index") - F.col("tree")).alias("pos"), "n", "digest", "doc_id", "found")
    nodes = ws.keep(nodes, "group/level=0")
    ws.drop("leaf-digests", "leaf-runs", "leaves-placed")
    levels, roots = _build(nodes, ws, "group", ["doc_id", "found"])
    # A group's number rises with its place in the order of the groups; the trees' roots are leaves of the tree above.
    tops = ws.keep(roots, "subroots")
    top = indexed(tops, ["tree"], ws, "subroot-runs").select(F.lit(0).cast("long").alias("tree"), F.col("index").alias("pos"), F.lit(tops.count()).cast("long").alias("n"), "digest", F.col("tree").alias("group"))
    top = ws.keep(top, "top/level=0")
    top_levels, top_roots = _build(top, ws, "top", ["group"])
    lone = F.expr(f"cast(array() AS {_STEP})").alias("steps")
    above = top.where("n = 1").select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), lone)
    if (spread := _paths(top_levels, ws, "top", ["group"])) is not None:
        above = above.unionByName(spread.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "steps"))
    root = top_roots.first()
    above = ws.keep(above.withColumn("root", F.lit(root and root["digest"]).cast("string")), "above")
    rows = nodes.where("n = 1").select("tree", "doc_id", "digest", "found", lone)
    if (spread := _paths(levels, ws, "group", ["doc_id", "found"])) is not None:
        rows = rows.unionByName(spread.select("tree", "doc_id", "digest", "found", "steps"))
    rows = rows.join(above.withColumnRenamed("steps", "more"), "tree").withColumn("steps", F.concat("steps", "more"))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = F.aggregate("steps", F.coalesce("found", "digest"), lambda at, s: F.sha2(F.concat(s["l"], at, s["r"]), 256))
    out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def every_third(doc_id: str = "doc_id") -> Column:
    """Whether 3 divides the crc32 of the decimal id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))


#: Levels that the SQL spells out: enough for eight to the tenth leaves a tree.
_SQL_LEVELS = 10


def _sql_tree(prefix: str, key: str) -> str:
    """Common tables of one kind of tree from ``<prefix>0`` (key, pos, n, digest): each level's siblings and the level above."""
    same, out = ", ".join(key.split()), []
    for k in range(_SQL_LEVELS):
        run = f"PARTITION BY {same}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
        out.append(f"""{prefix}s{k} AS MATERIALIZED (SELECT {same}, pos, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {prefix}{k} WHERE n > 1),
{prefix}{k + 1} AS MATERIALIZED (SELECT {same}, pos // {FANOUT} AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {prefix}{k} WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT {same}, pos, n, digest FROM {prefix}{k} WHERE n = 1)""")
    return ",\n".join(out)


def _sql_climb(prefix: str, key: str, rows: str, first: int) -> str:
    """Rows (key, pos, fold, proof) taken up all levels of their trees, from ``<rows><first>``."""
    out = []
    for k in range(_SQL_LEVELS):
        out.append(f"""{rows}{first + k + 1} AS MATERIALIZED (SELECT d.* REPLACE (CASE WHEN s.pos IS NULL THEN d.pos ELSE d.pos // {FANOUT} END AS pos,
  CASE WHEN s.pos IS NULL THEN d.fold ELSE sha256(s.l || d.fold || s.r) END AS fold, d.proof || coalesce(s.l || s.r, '') AS proof)
  FROM {rows}{first + k} d LEFT JOIN {prefix}s{k} s ON d.{key} IS NOT DISTINCT FROM s.{key} AND d.pos = s.pos)""")
    return ",\n".join(out)


_SQL_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in COLUMNS) + ")"
_SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 bit by bit: every eighth step takes in a byte.
_SQL_IN = "xor(c, CASE WHEN k % 8 = 0 THEN ord(substr(doc_id::VARCHAR, k // 8 + 1, 1)) ELSE 0 END)"
_SQL_CRC = f"""xor(list_reduce(range(8 * strlen(doc_id::VARCHAR)), lambda c, k: xor({_SQL_IN} >> 1, CASE WHEN {_SQL_IN} & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295)"""

ORACLE = f"""WITH d AS (SELECT doc_id, source, lang, n_chars, text, {_SQL_LEAF} AS leaf, {_SQL_CRC} % 3 = 0 AS hit FROM documents),
l AS MATERIALIZED (SELECT lang, doc_id, leaf, CASE WHEN hit THEN {_SQL_LEAF.replace("text", _SQL_LOWER)} ELSE leaf END AS found FROM d),
r0 AS MATERIALIZED (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS digest, doc_id, found AS fold, '' AS proof FROM l),
g0 AS (SELECT lang, pos, n, digest FROM r0),
{_sql_tree("g", "lang")},
{_sql_climb("g", "lang", "r", 0)},
tops AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM g{_SQL_LEVELS}),
t0 AS (SELECT 0 AS tree, pos, n, subroot AS digest FROM tops),
{_sql_tree("t", "tree")},
u0 AS (SELECT 0 AS tree, t.pos, r.doc_id, r.digest AS leaf, t.subroot, r.fold, r.proof FROM r{_SQL_LEVELS} r JOIN tops t ON r.lang IS NOT DISTINCT FROM t.lang),
{_sql_climb("t", "tree", "u", 0)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = digest AS verified FROM u{_SQL_LEVELS}, t{_SQL_LEVELS}"""
