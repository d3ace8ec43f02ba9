"""Named queries over the driver's tables with their SQL twins.

The main graph joins parts that share an order (F1); the raw directed multigraph takes part and supplier
ids of order lines in one id space (F2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats, graph, jobs, partition, primitives, scans, sources, triangles
from .storage import Workspace

WIDTH = 256
QUAD_WIDTH = 2048
QUAD_LIMIT = 6000
DEPTH = 2
SLICE = 10_000
JOB_SLICE = 1000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

E_SQL = """e AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  WHERE a.l_partkey > b.l_partkey)"""
R_SQL = "r AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
DEG_SQL = R_SQL + """, d0 AS (SELECT v AS vid, count(*) AS degree FROM (SELECT src AS v FROM r WHERE src <> dst UNION ALL SELECT dst FROM r WHERE src <> dst) GROUP BY v),
  deg AS (SELECT g.vid, coalesce(d0.degree, 0) AS degree FROM (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) FROM r) + 1)) AS vid) g LEFT JOIN d0 ON d0.vid = g.vid)"""


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def co_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_occurrence(lineitem(spark, sf_dir), "l_orderkey", "l_partkey")


def pair_tasks(spark: SparkSession, sf_dir: str) -> int:
    return graph.pair_tasks(lineitem(spark, sf_dir))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(lineitem(spark, sf_dir), "l_partkey", "l_suppkey")


TRIANGLES_SQL = f"WITH {E_SQL} SELECT count(*) AS triangles FROM e g1 JOIN e g2 ON g1.src = g2.src JOIN e g0 ON g0.src = g2.dst AND g0.dst = g1.dst"


def _add_strategy(strategy: str, **options: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return triangles.count(co_parts(spark, sf_dir), strategy, simple=True, **options)

    QUERIES[f"triangle_count_{strategy}"] = run
    ORACLES[f"triangle_count_{strategy}"] = TRIANGLES_SQL


_add_strategy("hash")
_add_strategy("oriented")
_add_strategy("intersect")
_add_strategy("edge_iterator")
_add_strategy("bitmap")
_add_strategy("grid", width=WIDTH)
_add_strategy("sharded", width=QUAD_WIDTH, depth=DEPTH)


@query(f"WITH {E_SQL} SELECT src, dst FROM e")
def edges_normalized(spark, sf_dir):
    return co_parts(spark, sf_dir)


@query(f"""WITH {E_SQL} SELECT g2.dst // {WIDTH} AS i, g1.src // {WIDTH} AS grid_row, g1.dst // {WIDTH} AS grid_col, count(*) AS triangles
FROM e g1 JOIN e g2 ON g1.src = g2.src JOIN e g0 ON g0.src = g2.dst AND g0.dst = g1.dst GROUP BY 1, 2, 3""")
def triangles_per_grid_triple(spark, sf_dir):
    return triangles.per_grid_triple(co_parts(spark, sf_dir), WIDTH, simple=True)


@query(f"""WITH {E_SQL} SELECT g1.src // {QUAD_WIDTH >> DEPTH} AS v_shard, g2.dst // {QUAD_WIDTH >> DEPTH} AS u_shard, g1.dst // {QUAD_WIDTH >> DEPTH} AS w_shard, count(*) AS triangles
FROM e g1 JOIN e g2 ON g1.src = g2.src JOIN e g0 ON g0.src = g2.dst AND g0.dst = g1.dst GROUP BY 1, 2, 3""")
def triangles_per_shard_triple(spark, sf_dir):
    return triangles.per_shard_triple(co_parts(spark, sf_dir), DEPTH, QUAD_WIDTH, simple=True)


@query(f"WITH {E_SQL}, t AS (SELECT count(*) AS n FROM e g1 JOIN e g2 ON g1.src = g2.src JOIN e g0 ON g0.src = g2.dst AND g0.dst = g1.dst) SELECT n AS triangles FROM t")
def triangles_over_quadtree_jobs(spark, sf_dir):
    e = Workspace(spark).keep(co_parts(spark, sf_dir), "edges")
    return triangles.over_jobs(e, partition.quadtree(e, QUAD_LIMIT, QUAD_WIDTH), QUAD_WIDTH)


@query(f"WITH {DEG_SQL} SELECT vid, degree FROM deg")
def vertex_degree(spark, sf_dir):
    return graph.complete_degrees(raw_edges(spark, sf_dir))


@query(f"WITH {R_SQL} SELECT min(least(src, dst)) AS min_vid, max(greatest(src, dst)) AS max_vid FROM r")
def vid_min_max(spark, sf_dir):
    return graph.vertex_bounds(raw_edges(spark, sf_dir))


@query(f"WITH {E_SQL} SELECT max(src // {WIDTH}) AS max_gr, max(dst // {WIDTH}) AS max_gc, max(greatest(src, dst) // {WIDTH}) AS max_index FROM e")
def grid_extent(spark, sf_dir):
    return partition.grid_extent(co_parts(spark, sf_dir), WIDTH)


@query(f"WITH {DEG_SQL} SELECT vid, row_number() OVER (ORDER BY degree = 0, degree, vid) - 1 AS new_vid FROM deg")
def relabel_asc(spark, sf_dir):
    return graph.relabel_table(graph.complete_degrees(raw_edges(spark, sf_dir)), "asc")


@query(f"WITH {DEG_SQL} SELECT vid, row_number() OVER (ORDER BY degree DESC, vid DESC) - 1 AS new_vid FROM deg")
def relabel_desc(spark, sf_dir):
    return graph.relabel_table(graph.complete_degrees(raw_edges(spark, sf_dir)), "desc")


@query(f"""WITH {DEG_SQL}, m AS (SELECT vid, row_number() OVER (ORDER BY degree DESC, vid DESC) - 1 AS n FROM deg)
SELECT DISTINCT greatest(a.n, b.n) AS src, least(a.n, b.n) AS dst FROM r JOIN m a ON a.vid = r.src JOIN m b ON b.vid = r.dst WHERE r.src <> r.dst""")
def edges_relabelled_desc(spark, sf_dir):
    return graph.relabelled(raw_edges(spark, sf_dir), "desc")


@query(f"""WITH {DEG_SQL}, n AS (SELECT DISTINCT greatest(src, dst) AS a, least(src, dst) AS b FROM r WHERE src <> dst)
SELECT CASE WHEN (x.degree, a) < (y.degree, b) THEN a ELSE b END AS src, CASE WHEN (x.degree, a) < (y.degree, b) THEN b ELSE a END AS dst
FROM n JOIN deg x ON x.vid = a JOIN deg y ON y.vid = b""")
def edges_degree_oriented(spark, sf_dir):
    return graph.orient_by_degree(raw_edges(spark, sf_dir))


@query(f"WITH {R_SQL} SELECT src, dst FROM r WHERE src <> dst UNION SELECT dst, src FROM r WHERE src <> dst")
def edges_undirected(spark, sf_dir):
    return graph.undirected(raw_edges(spark, sf_dir))


@query(f"WITH {R_SQL} SELECT DISTINCT src, dst FROM r")
def edges_directed_asis(spark, sf_dir):
    return graph.directed_as_is(raw_edges(spark, sf_dir))


@query(f"WITH {E_SQL} SELECT src, dst, src // {WIDTH} AS gr, dst // {WIDTH} AS gc, src % {WIDTH} AS ls, dst % {WIDTH} AS ld FROM e")
def grid_edges(spark, sf_dir):
    return partition.with_grid(co_parts(spark, sf_dir), WIDTH)


@query(f"""WITH {E_SQL}, n AS (SELECT src // {WIDTH} AS gr, dst // {WIDTH} AS gc, src % {WIDTH} AS ls, count(*) AS n FROM e GROUP BY 1, 2, 3),
p AS (SELECT gr, gc, ls, n, sum(n) OVER (PARTITION BY gr, gc ORDER BY ls) AS t FROM n) SELECT gr, gc, ls, (t - n)::BIGINT AS ptr_start, t::BIGINT AS ptr_end FROM p""")
def csr_rows(spark, sf_dir):
    return partition.csr_rows(co_parts(spark, sf_dir), WIDTH, pair_tasks(spark, sf_dir))


@query(f"""WITH {E_SQL} SELECT src // {WIDTH} AS gr, dst // {WIDTH} AS gc, src % {WIDTH} AS ls, count(*) AS nbr_count, min(dst % {WIDTH}) AS nbr_min, max(dst % {WIDTH}) AS nbr_max
FROM e GROUP BY 1, 2, 3""")
def csr_adjacency(spark, sf_dir):
    adj = partition.adjacency(co_parts(spark, sf_dir), WIDTH, pair_tasks(spark, sf_dir))
    return adj.select("gr", "gc", "ls", F.size("nbrs").cast("long").alias("nbr_count"), F.array_min("nbrs").alias("nbr_min"), F.array_max("nbrs").alias("nbr_max"))


CATALOGUE_SQL = E_SQL + f""", s AS (SELECT src // {QUAD_WIDTH} AS gr, dst // {QUAD_WIDTH} AS gc, src % {QUAD_WIDTH} // {QUAD_WIDTH >> DEPTH} AS sr, dst % {QUAD_WIDTH} // {QUAD_WIDTH >> DEPTH} AS sc FROM e),
c AS (SELECT gr, gc, {DEPTH} AS depth, sr, sc, count(*) AS edges, gr * {QUAD_WIDTH} + sr * {QUAD_WIDTH >> DEPTH} AS row_from, gr * {QUAD_WIDTH} + (sr + 1) * {QUAD_WIDTH >> DEPTH} AS row_to,
gc * {QUAD_WIDTH} + sc * {QUAD_WIDTH >> DEPTH} AS col_from, gc * {QUAD_WIDTH} + (sc + 1) * {QUAD_WIDTH >> DEPTH} AS col_to FROM s GROUP BY gr, gc, sr, sc)"""


@query(f"WITH {CATALOGUE_SQL} SELECT * FROM c")
def shard_catalogue(spark, sf_dir):
    return partition.shard_catalogue(co_parts(spark, sf_dir), DEPTH, QUAD_WIDTH)


@query(f"WITH {E_SQL} SELECT src // {WIDTH} AS gr, dst // {WIDTH} AS gc, count(*) AS edges, min(src) AS row_min, max(src) AS row_max, min(dst) AS col_min, max(dst) AS col_max FROM e GROUP BY 1, 2")
def grid_catalogue(spark, sf_dir):
    g = partition.with_grid(co_parts(spark, sf_dir), WIDTH)
    return g.groupBy("gr", "gc").agg(F.count("*").alias("edges"), F.min("src").alias("row_min"), F.max("src").alias("row_max"), F.min("dst").alias("col_min"), F.max("dst").alias("col_max"))


@query(f"""WITH {E_SQL}, g AS (SELECT DISTINCT src // {WIDTH} AS gr, dst // {WIDTH} AS gc FROM e)
SELECT g2.gc AS i, g1.gr, g1.gc FROM g g1 JOIN g g2 ON g1.gr = g2.gr JOIN g g0 ON g0.gr = g2.gc AND g0.gc = g1.gc WHERE g1.gc <= g2.gc AND g2.gc <= g1.gr""")
def grid_jobs(spark, sf_dir):
    return partition.grid_jobs(partition.with_grid(co_parts(spark, sf_dir), WIDTH))


SHARD_JOBS_SQL = f"""SELECT g0.gr AS g0_gr, g0.gc AS g0_gc, g0.sr AS g0_sr, g0.sc AS g0_sc, g1.gr AS g1_gr, g1.gc AS g1_gc, g1.sr AS g1_sr, g1.sc AS g1_sc,
g2.gr AS g2_gr, g2.gc AS g2_gc, g2.sr AS g2_sr, g2.sc AS g2_sc
FROM c g1 JOIN c g2 ON g1.gr = g2.gr JOIN c g0 ON g0.gr = g2.gc AND g0.gc = g1.gc WHERE {partition.OVERLAP}"""


JOB_COLUMNS = [f"{g}.{c} AS {g}_{c}" for g in ("g0", "g1", "g2") for c in ("gr", "gc", "sr", "sc")]


@query(f"WITH {CATALOGUE_SQL} {SHARD_JOBS_SQL}")
def shard_jobs(spark, sf_dir):
    return partition.shard_jobs(partition.shard_catalogue(co_parts(spark, sf_dir), DEPTH, QUAD_WIDTH)).selectExpr(*JOB_COLUMNS)


_SIDE = QUAD_WIDTH >> DEPTH
_LABELS = ", ".join(
    f"{g}.src // {QUAD_WIDTH} AS {g}_gr, {g}.dst // {QUAD_WIDTH} AS {g}_gc, {g}.src % {QUAD_WIDTH} // {_SIDE} AS {g}_sr, {g}.dst % {QUAD_WIDTH} // {_SIDE} AS {g}_sc" for g in ("g0", "g1", "g2")
)


@query(f"""WITH {CATALOGUE_SQL}, jobs AS ({SHARD_JOBS_SQL}),
t AS (SELECT {_LABELS}, count(*) AS n FROM e g1 JOIN e g2 ON g1.src = g2.src JOIN e g0 ON g0.src = g2.dst AND g0.dst = g1.dst GROUP BY ALL)
SELECT jobs.*, 'FINISH' AS state, coalesce(n, 0) AS triangles FROM jobs LEFT JOIN t USING (g0_gr, g0_gc, g0_sr, g0_sc, g1_gr, g1_gc, g1_sr, g1_sc, g2_gr, g2_gc, g2_sr, g2_sc)""")
def job_results(spark, sf_dir):
    e = co_parts(spark, sf_dir)
    return jobs.finish(e, partition.shard_catalogue(e, DEPTH, QUAD_WIDTH), QUAD_WIDTH).selectExpr(*JOB_COLUMNS, "state", "triangles")


@query(f"WITH {CATALOGUE_SQL} {SHARD_JOBS_SQL}")
def shard_jobs_sql(spark, sf_dir):
    """From a view of the job table: joined as plain SQL, every pair of shards of a row would be shuffled."""
    jobs = partition.shard_jobs(partition.shard_catalogue(co_parts(spark, sf_dir), DEPTH, QUAD_WIDTH))
    parts = ", ".join(f"{g}.{c} AS {g}_{c}" for g in ("g0", "g1", "g2") for c in ("gr", "gc", "sr", "sc"))
    return spark.sql(f"SELECT {parts} FROM {{jobs}}", jobs=jobs)


@query(f"""WITH {E_SQL}, k AS (SELECT src // {WIDTH} AS gr, dst // {WIDTH} AS gc, row_number() OVER (PARTITION BY src // {WIDTH}, dst // {WIDTH} ORDER BY src, dst) - 1 AS k FROM e)
SELECT gr, gc, k // {SLICE} AS slice, count(*) AS edges FROM k GROUP BY 1, 2, 3""")
def linear_shards(spark, sf_dir):
    return partition.linear_slices(co_parts(spark, sf_dir), SLICE, WIDTH)


SLICED_SQL = E_SQL + f""", k AS MATERIALIZED (SELECT src, dst, src // {WIDTH} AS gr, dst // {WIDTH} AS gc,
(row_number() OVER (PARTITION BY src // {WIDTH}, dst // {WIDTH} ORDER BY src, dst) - 1) // {JOB_SLICE} AS slice FROM e)"""
SLICE_COLUMNS = [f"{g}.{c} AS {g}_{c}" for g in ("g0", "g1", "g2") for c in ("gr", "gc", "slice")]


@query(f"""WITH {SLICED_SQL}, s AS (SELECT DISTINCT gr, gc, slice FROM k) SELECT {', '.join(SLICE_COLUMNS)}
FROM s g1 JOIN s g2 ON g1.gr = g2.gr JOIN s g0 ON g0.gr = g2.gc AND g0.gc = g1.gc WHERE g1.gc <= g2.gc AND g2.gc <= g1.gr""")
def linear_shard_jobs(spark, sf_dir):
    return partition.slice_jobs(partition.linear_slices(co_parts(spark, sf_dir), JOB_SLICE, WIDTH)).selectExpr(*SLICE_COLUMNS)


@query(f"""WITH {SLICED_SQL} SELECT {', '.join(SLICE_COLUMNS)}, count(*) AS triangles
FROM k g1 JOIN k g2 ON g1.src = g2.src JOIN k g0 ON g0.src = g2.dst AND g0.dst = g1.dst GROUP BY ALL""")
def triangles_per_linear_shards(spark, sf_dir):
    return triangles.per_slice_triple(co_parts(spark, sf_dir), JOB_SLICE, WIDTH, simple=True).selectExpr(*SLICE_COLUMNS, "triangles")


@query(f"WITH {E_SQL}, k AS (SELECT src // {WIDTH} AS gr, dst // {WIDTH} AS gc, row_number() OVER (PARTITION BY src // {WIDTH}, dst // {WIDTH} ORDER BY src, dst) - 1 AS k FROM e) SELECT DISTINCT gr || '-' || gc || ',' || (k // {SLICE}) AS stem, gr, gc, k // {SLICE} AS slice FROM k")
def linear_shard_names(spark, sf_dir):
    return partition.parse_slice_name(partition.slice_name(partition.linear_slices(co_parts(spark, sf_dir), SLICE, WIDTH)).select("stem"))


QUAD_SQL = E_SQL + f""", n AS MATERIALIZED (SELECT src // {QUAD_WIDTH} AS gr, dst // {QUAD_WIDTH} AS gc, d AS depth, (src % {QUAD_WIDTH}) // ({QUAD_WIDTH} >> d) AS sr, (dst % {QUAD_WIDTH}) // ({QUAD_WIDTH} >> d) AS sc, count(*) AS edges
FROM e, (SELECT unnest(range(0, {QUAD_WIDTH.bit_length()}))::INTEGER AS d) GROUP BY ALL),
q AS MATERIALIZED (SELECT n.* FROM n LEFT JOIN n p ON p.gr = n.gr AND p.gc = n.gc AND p.depth = n.depth - 1 AND p.sr = n.sr // 2 AND p.sc = n.sc // 2
WHERE (n.edges <= {QUAD_LIMIT} OR n.depth = {QUAD_WIDTH.bit_length() - 1}) AND (n.depth = 0 OR p.edges > {QUAD_LIMIT}))"""


@query(f"WITH {QUAD_SQL} SELECT gr, gc, depth, sr, sc, edges FROM q")
def quadtree_depth(spark, sf_dir):
    return partition.quadtree(co_parts(spark, sf_dir), QUAD_LIMIT, QUAD_WIDTH)


@query(f"WITH {QUAD_SQL} SELECT gr, gc, depth, sr, sc, edges FROM q WHERE edges >= (SELECT quantile_disc(edges, 0.75) FROM q)")
def large_shards(spark, sf_dir):
    return partition.large_shards(partition.quadtree(co_parts(spark, sf_dir), QUAD_LIMIT, QUAD_WIDTH), 0.25)


@query(f"WITH {QUAD_SQL} SELECT CASE WHEN depth = 0 THEN gr || '-' || gc ELSE gr || '-' || gc || ',' || depth || ',' || sr || '-' || sc END AS stem, gr, gc, depth, sr, sc FROM q")
def shard_names(spark, sf_dir):
    named = partition.shard_name(partition.quadtree(co_parts(spark, sf_dir), QUAD_LIMIT, QUAD_WIDTH)).select("stem")
    return partition.parse_shard_name(named)


@query(f"WITH {E_SQL} SELECT src, dst FROM e")
def shard_files_read_back(spark, sf_dir):
    return formats.read_csr(formats.convert(co_parts(spark, sf_dir), QUAD_LIMIT, QUAD_WIDTH), QUAD_WIDTH)


@query(f"""WITH {QUAD_SQL}, l AS (SELECT q.*, {QUAD_WIDTH} >> depth AS w FROM q), c AS (SELECT gr, gc, depth, sr, sc, edges, gr * {QUAD_WIDTH} + sr * w AS row_from, gr * {QUAD_WIDTH} + (sr + 1) * w AS row_to,
gc * {QUAD_WIDTH} + sc * w AS col_from, gc * {QUAD_WIDTH} + (sc + 1) * w AS col_to FROM l)
SELECT c.*, count(DISTINCT src) AS n_rows FROM c JOIN e ON src >= row_from AND src < row_to AND dst >= col_from AND dst < col_to GROUP BY ALL""")
def shard_file_catalogue(spark, sf_dir):
    written = formats.convert(co_parts(spark, sf_dir), QUAD_LIMIT, QUAD_WIDTH)
    return formats.file_catalogue(written.select("name", F.length("content").cast("long").alias("length")), QUAD_WIDTH)


@query(f"WITH {E_SQL} SELECT src, dst FROM e")
def adj6_source_read_back(spark, sf_dir):
    """Written by the data source in bounded files and read by byte ranges far smaller than a file."""
    sources.register(spark)
    folder = Workspace(spark).path("adj6")
    e = co_parts(spark, sf_dir).repartitionByRange(pair_tasks(spark, sf_dir), "src", "dst").sortWithinPartitions("src", "dst")
    e.write.format("adj6").mode("append").option("file_edges", 50_000).save(folder)
    return spark.read.format("adj6").option("split_bytes", 30_000).load(folder)


@query(f"WITH {R_SQL} SELECT src, dst FROM r")
def adj6_files_read_back(spark, sf_dir):
    return formats.read_adj6(formats.write_adj6(raw_edges(spark, sf_dir)))


@query(f"WITH {E_SQL} SELECT src, dst FROM e")
def el32_files_read_back(spark, sf_dir):
    return formats.read_el32(formats.write_el32(co_parts(spark, sf_dir), WIDTH), WIDTH)


@query(f"WITH {E_SQL} SELECT src, dst FROM e")
def grid_files_read_back(spark, sf_dir):
    return formats.read_csr(formats.write_csr(co_parts(spark, sf_dir), WIDTH), WIDTH)


@query(f"WITH {DEG_SQL} SELECT vid, row_number() OVER (ORDER BY degree = 0, degree, vid) - 1 AS new_vid FROM deg")
def relabel_files_read_back(spark, sf_dir):
    return formats.read_relabel(formats.write_relabel(graph.relabel_table(graph.complete_degrees(raw_edges(spark, sf_dir)), "asc")))


@query(f"WITH {R_SQL} SELECT src, dst FROM r")
def tsv_read_back(spark, sf_dir):
    path = Workspace(spark).path("tsv")
    formats.write_tsv(raw_edges(spark, sf_dir), path)
    return formats.read_tsv(spark, path)


@query(f"""WITH {E_SQL}, g AS (SELECT DISTINCT src // {WIDTH} AS gr, dst // {WIDTH} AS gc FROM e), m AS (SELECT max(src) AS top FROM e)
SELECT 'parts' AS dataname, gr || '-' || gc AS name, gr, gc, top // {WIDTH} + 1 AS side, top AS max_vid FROM g, m""")
def metadata_read_back(spark, sf_dir):
    path = Workspace(spark).path("metadata")
    formats.write_metadata(formats.metadata(co_parts(spark, sf_dir), "parts", WIDTH), path)
    found = formats.read_metadata(spark, path).select("dataname", "info", F.explode("grid").alias("g"))
    return found.selectExpr("dataname", "g.name", "g.index.row AS gr", "g.index.col AS gc", "info.count.row AS side", "info.max_vid")


CHUNK_SQL = E_SQL + f""", k AS (SELECT src, dst, src // {WIDTH} AS gr, dst // {WIDTH} AS gc, row_number() OVER (PARTITION BY src // {WIDTH}, dst // {WIDTH} ORDER BY src, dst) - 1 AS pos FROM e)"""


@query(f"""WITH {CHUNK_SQL} SELECT gr, gc, pos // {JOB_SLICE} AS chunk, count(DISTINCT src) AS n_rows, min(src % {WIDTH}) AS first_row, min(pos) AS ptr_first, max(pos) + 1 AS ptr_last, count(*) AS n_cols, sum(dst % {WIDTH})::BIGINT AS col_sum
FROM k GROUP BY ALL""")
def csr_chunks(spark, sf_dir):
    c = partition.csr_chunks(co_parts(spark, sf_dir), JOB_SLICE, WIDTH, pair_tasks(spark, sf_dir))
    return c.select(
        "gr", "gc", "chunk", F.size("row").cast("long").alias("n_rows"), F.element_at("row", 1).alias("first_row"), F.element_at("ptr", 1).alias("ptr_first"),
        F.element_at("ptr", -1).alias("ptr_last"), F.size("col").cast("long").alias("n_cols"), F.aggregate("col", F.lit(0).cast("long"), lambda n, x: n + x).alias("col_sum"),
    )


@query(f"WITH {E_SQL} SELECT src, dst, dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM e")
def adjacent_diff(spark, sf_dir):
    return graph.adjacent_gaps(co_parts(spark, sf_dir), pair_tasks(spark, sf_dir))


@query(f"WITH {E_SQL} SELECT sum(d * (d - 1) // 2)::BIGINT AS wedges FROM (SELECT count(*) AS d FROM e GROUP BY src)")
def wedge_count(spark, sf_dir):
    return triangles.wedge_count(co_parts(spark, sf_dir))


@query(f"""WITH {R_SQL}, d AS (SELECT DISTINCT src, dst FROM r WHERE src <> dst)
SELECT count(*) AS triads FROM d g2 JOIN d g1 ON g1.src = g2.src JOIN d g0 ON g0.src = g2.dst AND g0.dst = g1.dst""")
def transitive_triads(spark, sf_dir):
    return triangles.transitive_triads(raw_edges(spark, sf_dir))


# Data-parallel primitives over ordered rows: order lines stand for the arrays.
L_SQL = "l AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS v, l_returnflag AS f FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("v"), F.col("l_returnflag").alias("f"))


@query(f"""WITH {L_SQL} SELECT k, i, v, coalesce(sum(v) OVER (PARTITION BY k ORDER BY i, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS exclusive,
(sum(v) OVER (PARTITION BY k ORDER BY i, v ROWS UNBOUNDED PRECEDING))::BIGINT AS inclusive FROM l""")
def segmented_scan(spark, sf_dir):
    return primitives.scan(_lines(spark, sf_dir), "v", ["i", "v"], ["k"]).select("k", "i", "v", "exclusive", "inclusive")


@query(f"""WITH {L_SQL} SELECT k, i, v, min(v) OVER p AS min_before, max(v) OVER p AS max_before, min(v) OVER u AS min_upto, max(v) OVER u AS max_upto FROM l
WINDOW p AS (PARTITION BY k ORDER BY i, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY k ORDER BY i, v ROWS UNBOUNDED PRECEDING)""")
def segmented_extreme_scan(spark, sf_dir):
    return primitives.extreme_scan(_lines(spark, sf_dir), "v", ["i", "v"], ["k"]).select("k", "i", "v", "min_before", "max_before", "min_upto", "max_upto")


@query(f"WITH {L_SQL} SELECT k, i, v, row_number() OVER (PARTITION BY k ORDER BY v, i) - 1 AS position FROM l")
def segmented_sort(spark, sf_dir):
    return primitives.segmented_sort(_lines(spark, sf_dir), ["v", "i"], ["k"]).select("k", "i", "v", "position")


@query(f"WITH {L_SQL} SELECT k, i, v, row_number() OVER (PARTITION BY k ORDER BY v DESC, i DESC) - 1 AS position FROM l")
def segmented_sort_descending(spark, sf_dir):
    return primitives.segmented_sort(_lines(spark, sf_dir), ["v", "i"], ["k"], descending=True).select("k", "i", "v", "position")


@query(f"""WITH {L_SQL}, m AS (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN lag(f) OVER w = f THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY k ORDER BY i, v, f)),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY pos) AS run FROM m) SELECT k, min(pos) AS start, count(*) AS length FROM g GROUP BY k, run HAVING count(*) > 1""")
def long_runs(spark, sf_dir):
    return primitives.long_runs(_lines(spark, sf_dir), "f", ["i", "v", "f"], ["k"])


@query(f"""WITH {L_SQL}, m AS (SELECT *, row_number() OVER w = 1 OR f IS DISTINCT FROM lag(f) OVER w AS new FROM l WINDOW w AS (PARTITION BY k ORDER BY i, v, f))
SELECT k, i, v, f FROM m WHERE new""")
def unique_consecutive(spark, sf_dir):
    return primitives.unique_consecutive(_lines(spark, sf_dir), "f", ["i", "v", "f"], ["k"]).select("k", "i", "v", "f")


@query(f"WITH {L_SQL} SELECT f = 'R' AS flagged, count(*) AS n, sum(v)::BIGINT AS total FROM l GROUP BY 1")
def partition_flagged(spark, sf_dir):
    yes, no = primitives.partition_flagged(_lines(spark, sf_dir), "f = 'R'")
    side = lambda df, flag: df.agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total")).select(F.lit(flag).alias("flagged"), "n", "total")
    return side(yes, True).union(side(no, False)).where("n > 0")


@query("""SELECT 'l_quantity' AS channel, least(floor(l_quantity / 5.0), 9)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY ALL
UNION ALL SELECT 'l_linenumber', least(floor((l_linenumber - 1) / 2.0), 2)::BIGINT, count(*) FROM lineitem WHERE l_linenumber >= 1 AND l_linenumber < 7 GROUP BY ALL""")
def multi_histogram_even(spark, sf_dir):
    return primitives.multi_histogram_even(lineitem(spark, sf_dir), {"l_quantity": (10, 0.0, 50.0), "l_linenumber": (3, 1.0, 7.0)})


@query("""SELECT 'l_quantity' AS channel, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 45 GROUP BY ALL
UNION ALL SELECT 'l_linenumber', CASE WHEN l_linenumber < 3 THEN 0 ELSE 1 END::BIGINT, count(*) FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 6 GROUP BY ALL""")
def multi_histogram_range(spark, sf_dir):
    return primitives.multi_histogram_range(lineitem(spark, sf_dir), {"l_quantity": [1, 10, 20, 45], "l_linenumber": [2, 3, 6]})


@query(f"WITH {L_SQL} SELECT k, sum(v)::BIGINT AS sum, min(v) AS min, max(v) AS max, arg_min(i, (v, i)) AS argmin, arg_max(i, (v, i)) AS argmax FROM l GROUP BY k")
def segmented_reduce(spark, sf_dir):
    return primitives.segmented_reduce(_lines(spark, sf_dir), "v", "i", ["k"])


@query(f"""WITH {L_SQL}, m AS (SELECT *, CASE WHEN lag(f) OVER w = f THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY k ORDER BY i, v, f)),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY i, v, f ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT k, run::BIGINT AS run, min(f) AS value, count(*) AS length, sum(v)::BIGINT AS total FROM g GROUP BY k, run""")
def run_length_encode(spark, sf_dir):
    return primitives.run_lengths(_lines(spark, sf_dir), "f", ["i", "v", "f"], ["k"], "v")


# The whole table as one array.
@query(f"""WITH {L_SQL} SELECT k, i, v, coalesce(sum(v) OVER (ORDER BY k, i, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS exclusive,
(sum(v) OVER (ORDER BY k, i, v ROWS UNBOUNDED PRECEDING))::BIGINT AS inclusive FROM l""")
def prefix_scan(spark, sf_dir):
    return primitives.scan(_lines(spark, sf_dir), "v", ["k", "i", "v"], []).select("k", "i", "v", "exclusive", "inclusive")


@query(f"""WITH {L_SQL} SELECT k, i, v, min(v) OVER p AS min_before, max(v) OVER p AS max_before, min(v) OVER u AS min_upto, max(v) OVER u AS max_upto FROM l
WINDOW p AS (ORDER BY k, i, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (ORDER BY k, i, v ROWS UNBOUNDED PRECEDING)""")
def extreme_scan(spark, sf_dir):
    return primitives.extreme_scan(_lines(spark, sf_dir), "v", ["k", "i", "v"], []).select("k", "i", "v", "min_before", "max_before", "min_upto", "max_upto")


@query(f"""WITH {L_SQL} SELECT f, k, i, v, coalesce(sum(v) OVER (PARTITION BY f ORDER BY k, i, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS exclusive,
min(v) OVER (PARTITION BY f ORDER BY k, i, v ROWS UNBOUNDED PRECEDING) AS min_upto FROM l""")
def large_segment_scan(spark, sf_dir):
    out = scans.prefix_scan(_lines(spark, sf_dir), "v", ["k", "i", "v"], Workspace(spark), "runs", segment=["f"])
    return out.select("f", "k", "i", "v", F.col("exclusive").cast("long").alias("exclusive"), "min_upto")


@query(f"""WITH {L_SQL} SELECT k, i, v, last_value(CASE WHEN f = 'R' THEN v END IGNORE NULLS) OVER (ORDER BY k, i, v, f ROWS UNBOUNDED PRECEDING) AS last_returned FROM l""")
def copy_scan(spark, sf_dir):
    marked = _lines(spark, sf_dir).withColumn("r", F.when(F.col("f") == "R", F.col("v")))
    return scans.carried(marked, "r", ["k", "i", "v", "f"], Workspace(spark), "runs", "last_returned").select("k", "i", "v", "last_returned")


@query(f"WITH {L_SQL} SELECT k, i, v, f, row_number() OVER (ORDER BY v DESC, k DESC, i DESC, f DESC) - 1 AS position FROM l")
def device_sort_descending(spark, sf_dir):
    return primitives.segmented_sort(_lines(spark, sf_dir), ["v", "k", "i", "f"], [], descending=True).select("k", "i", "v", "f", "position")


@query(f"""WITH {L_SQL}, m AS (SELECT *, CASE WHEN lag(f) OVER w = f THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (ORDER BY k, i, v, f)),
g AS (SELECT *, sum(new) OVER (ORDER BY k, i, v, f ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT run::BIGINT AS run, min(f) AS value, count(*) AS length, sum(v)::BIGINT AS total FROM g GROUP BY run""")
def run_length_encode_whole(spark, sf_dir):
    return primitives.run_lengths(_lines(spark, sf_dir), "f", ["k", "i", "v", "f"], [], "v")


@query(f"""WITH {L_SQL}, m AS (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN lag(f) OVER w = f THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (ORDER BY k, i, v, f)),
g AS (SELECT *, sum(new) OVER (ORDER BY pos) AS run FROM m) SELECT min(pos) AS start, count(*) AS length FROM g GROUP BY run HAVING count(*) > 1""")
def long_runs_whole(spark, sf_dir):
    return primitives.long_runs(_lines(spark, sf_dir), "f", ["k", "i", "v", "f"], [])


@query(f"""WITH {L_SQL}, m AS (SELECT *, row_number() OVER w = 1 OR f IS DISTINCT FROM lag(f) OVER w AS new FROM l WINDOW w AS (ORDER BY k, i, v, f))
SELECT k, i, v, f FROM m WHERE new""")
def unique_consecutive_whole(spark, sf_dir):
    return primitives.unique_consecutive(_lines(spark, sf_dir), "f", ["k", "i", "v", "f"], []).select("k", "i", "v", "f")


@query("SELECT least(greatest(floor((l_quantity - 0) / 5.0)::BIGINT, 0), 9) AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1")
def histogram_even(spark, sf_dir):
    return primitives.histogram_even(lineitem(spark, sf_dir), "l_quantity", 10, 0.0, 50.0)


@query("SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 45 THEN 2 END AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 45 GROUP BY 1")
def histogram_range(spark, sf_dir):
    return primitives.histogram_range(lineitem(spark, sf_dir), "l_quantity", [1, 10, 20, 45])


@query(f"WITH {E_SQL} SELECT src AS row, sum(dst % 7)::BIGINT AS y FROM e GROUP BY src")
def sparse_matrix_vector(spark, sf_dir):
    e = co_parts(spark, sf_dir).select("src", "dst", F.lit(1).cast("long").alias("x"))
    vector = e.select(F.col("dst").alias("i")).distinct().withColumn("v", F.col("i") % 7)
    return primitives.spmv(e, vector)
