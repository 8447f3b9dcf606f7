"""Queries by name, with equivalent SQL.

The driver's tables stand for a catalogue: documents are assets (language as modality,
source as topic), embeddings their vectors, parts and suppliers the ends of graph edges
with return flags as kinds, suppliers entities with parts as members, and part brands
their keywords.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import candidates, evaluation, graph, merge, search, sets, topics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "hybrid_search"
TERMS = ("the", "tion", "under")
DIMS = 64
#: A supplier's node is its number and this. From a million parts on, parts have the same numbers.
SUPPLIER = 1_000_000
#: The same where parts and suppliers must not be mixed up: no part's number is as high, so suppliers also sort behind parts.
APART = 1 << 62


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def assets(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), F.col("lang").alias("modality"), F.col("source").alias("topic"), F.col("lang").alias("subtopic"), F.col("n_chars").alias("file_size"), F.col("text").alias("summary"))


def edges(spark: SparkSession, sf: str, supplier: int = SUPPLIER) -> DataFrame:
    line = read(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "same_domain").when(F.col("l_returnflag") == "R", "references").otherwise("derived_from")
    return line.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("edge_id"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") + supplier).alias("dst"), kind.alias("kind"),
        F.when(F.col("l_linestatus") == "F", "active").otherwise("proposed").alias("status"), F.col("l_discount").alias("confidence"), F.col("l_shipdate").alias("created_at"),
    )


def numbered(supplier: str) -> Column:
    """The number that SQL gives a supplier's node of edges(.., APART)."""
    return F.col(supplier) - APART + SUPPLIER


def kinds(spark: SparkSession) -> DataFrame:
    rows = [("duplicate_near", True, True), ("same_domain", True, True), ("references", False, True), ("derived_from", False, True), ("same_series", True, True)]
    return spark.createDataFrame(rows, "kind string, is_symmetric boolean, active boolean")


EDGES = """edges AS (SELECT l_orderkey || '-' || l_linenumber AS edge_id, l_partkey AS src, l_suppkey + 1000000 AS dst,
  CASE l_returnflag WHEN 'A' THEN 'same_domain' WHEN 'R' THEN 'references' ELSE 'derived_from' END AS kind,
  CASE l_linestatus WHEN 'F' THEN 'active' ELSE 'proposed' END AS status, l_discount AS confidence, l_shipdate AS created_at FROM lineitem)"""
TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
BM25 = f"""toks AS (SELECT doc_id, {TOKENS} AS t FROM documents),
counts AS (SELECT doc_id, len(t) AS n, {", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS f{i}" for i, q in enumerate(TERMS))} FROM toks),
totals AS (SELECT count(*) AS docs, avg(n) AS mean, {", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(TERMS)))} FROM counts),
lexical AS (SELECT doc_id, {" + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(TERMS)))} AS score
  FROM counts, totals WHERE {" OR ".join(f"f{i} > 0" for i in range(len(TERMS)))})"""
QVEC = [((7 * i) % 11 - 5) / 10 for i in range(DIMS)]
DOT = lambda a, b: f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
NEAR = f"""q AS (SELECT {QVEC} AS q),
semantic AS (SELECT vec_id AS doc_id, {DOT("embedding", "q")} / (sqrt({DOT("embedding", "embedding")}) * sqrt({DOT("q", "q")})) AS cosine
  FROM embeddings, q WHERE {DOT("embedding", "embedding")} > 0 ORDER BY cosine DESC, doc_id LIMIT 50)"""


@query("bm25_search", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM lexical ORDER BY lexical.score DESC, doc_id LIMIT 100")
def bm25_search(spark, sf):
    hits = search.bm25(read(spark, sf, "documents"), "doc_id", F.col("text"), TERMS)
    return hits.orderBy(F.desc("score"), "doc_id").limit(100).select("doc_id", F.round("score", 6).alias("score"))


@query("knn_search", f"WITH {NEAR} SELECT doc_id, round(cosine, 6) AS cosine FROM semantic")
def knn_search(spark, sf):
    near = search.nearest(read(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", QVEC, k=50)
    return near.select("doc_id", F.round("cosine", 6).alias("cosine"))


@query(
    "hybrid_search",
    f"""WITH {BM25}, {NEAR},
a AS (SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS s FROM lexical),
b AS (SELECT doc_id, cosine, CASE WHEN max(cosine) OVER () > min(cosine) OVER () THEN (cosine - min(cosine) OVER ()) / (max(cosine) OVER () - min(cosine) OVER ()) ELSE 1.0 END AS v FROM semantic),
f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, 0.5 * coalesce(s, 0) + 0.5 * coalesce(v, 0) AS fused, cosine, a.doc_id IS NOT NULL AS bm25 FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id)
SELECT doc_id, round(fused, 6) AS fused, bm25 FROM f WHERE bm25 OR cosine >= 0.2 - 1e-9 ORDER BY f.fused DESC, doc_id LIMIT 100""",
)
def hybrid_search(spark, sf):
    lexical = search.bm25(read(spark, sf, "documents"), "doc_id", F.col("text"), TERMS)
    near = search.nearest(read(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", QVEC, k=50)
    rows = search.cut(search.fuse(lexical, near, "doc_id"), 0.2)
    return rows.orderBy(F.desc("fused"), "doc_id").limit(100).select("doc_id", F.round("fused", 6).alias("fused"), "bm25")


@query(
    "search_facets",
    """WITH s AS (SELECT *, CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS size FROM documents WHERE contains(lower(text), 'tion'))
SELECT axis, key, n FROM (SELECT 'modality' AS axis, lang AS key, count(DISTINCT doc_id) AS n, row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, lang) AS r FROM s WHERE source IN ('src0', 'src1', 'src2') AND size <> 'small' GROUP BY lang
UNION ALL SELECT 'topic', source, count(DISTINCT doc_id), row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, source) FROM s WHERE lang = 'en' AND size <> 'small' GROUP BY source
UNION ALL SELECT 'size', size, count(DISTINCT doc_id), row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, size) FROM s WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2') GROUP BY size) WHERE r <= 24""",
)
def search_facets(spark, sf):
    size = F.when(F.col("file_size") < 1000, "small").when(F.col("file_size") < 5000, "medium").otherwise("large")
    scope = assets(spark, sf).where(F.contains(F.lower("summary"), F.lit("tion")))
    axes = {"modality": F.col("modality"), "topic": F.col("topic"), "size": size}
    filters = {"modality": F.col("modality") == "en", "topic": F.col("topic").isin("src0", "src1", "src2"), "size": size != "small"}
    return search.facets(scope, axes, filters, "asset_id")


@query("keyset_page", "SELECT doc_id AS asset_id, n_chars AS file_size FROM documents WHERE n_chars < 2000 OR (n_chars = 2000 AND doc_id > 100) ORDER BY n_chars DESC, doc_id LIMIT 50")
def keyset_page(spark, sf):
    return search.page(assets(spark, sf).select("asset_id", "file_size"), [("file_size", False), ("asset_id", True)], 50, [2000, 100])


@query(
    "neighbours_folded",
    f"""WITH {EDGES}, e AS (SELECT * FROM edges WHERE status = 'active'),
n AS (SELECT src AS node, dst AS neighbour, kind, CASE kind WHEN 'same_domain' THEN 'undirected' ELSE 'outbound' END AS direction, confidence FROM e
  UNION ALL SELECT dst, src, kind, CASE kind WHEN 'same_domain' THEN 'undirected' ELSE 'inbound' END, confidence FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY node, neighbour ORDER BY kind <> 'same_domain', confidence DESC NULLS LAST, kind, direction) AS k,
  array_to_string(list_sort(list_distinct(list(kind) OVER (PARTITION BY node, neighbour))), ',') AS kinds FROM n)
SELECT node, neighbour, kind, direction, confidence, kinds FROM r WHERE k = 1""",
)
def neighbours_folded(spark, sf):
    return graph.fold(graph.neighbours(edges(spark, sf), kinds(spark))).withColumn("kinds", F.array_join("kinds", ","))


@query("exposed_entities", "SELECT l_suppkey AS entity, count(DISTINCT l_partkey) AS members FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 3")
def exposed_entities(spark, sf):
    return graph.exposed(read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), "l_partkey"), ["entity"], "l_partkey")


@query("entities_with_all_labels", "SELECT l_suppkey AS entity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1 HAVING count(DISTINCT p_brand) = 3")
def entities_with_all_labels(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("entity"), "p_brand")
    return graph.having_all(rows, "entity", "p_brand", ["Brand#11", "Brand#12", "Brand#13"])


@query(
    "top_entity_keywords",
    """WITH c AS (SELECT l_suppkey AS entity, p_brand AS keyword, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT entity, keyword, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY n DESC, keyword) AS INTEGER) AS rank FROM c) WHERE rank <= 5""",
)
def top_entity_keywords(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("keyword"))
    return graph.top_values(rows, "entity", "keyword", 5)


@query(
    "review_queue",
    f"""WITH {EDGES}, k AS (SELECT * FROM edges WHERE status = 'proposed' AND kind <> 'same_domain' AND confidence >= 0.05)
SELECT edge_id, confidence, (SELECT count(*) FROM k) AS total FROM k ORDER BY confidence DESC NULLS LAST, edge_id LIMIT 50 OFFSET 50""",
)
def review_queue(spark, sf):
    keep = (F.col("status") == "proposed") & (F.col("kind") != "same_domain") & (F.col("confidence") >= 0.05)
    return graph.review_page(edges(spark, sf), keep, 50, 50).select("edge_id", "confidence", "total")


@query(
    "graph_violations",
    f"""WITH {EDGES}, nodes AS (SELECT p_partkey AS node FROM part UNION ALL SELECT s_suppkey + 1000000 FROM supplier)
SELECT 'self_edge' AS "check", count(*) AS n FROM edges WHERE src = dst
UNION ALL SELECT 'status', count(*) FROM edges WHERE status NOT IN ('proposed', 'active', 'rejected')
UNION ALL SELECT 'kind', 0
UNION ALL SELECT 'source', count(*) FROM edges WHERE src NOT IN (SELECT node FROM nodes)
UNION ALL SELECT 'target', count(*) FROM edges WHERE dst NOT IN (SELECT node FROM nodes)
UNION ALL SELECT 'order', count(*) FROM edges WHERE kind = 'same_domain' AND src > dst
UNION ALL SELECT 'twice', count(*) FROM (SELECT 1 FROM edges WHERE kind = 'same_domain' GROUP BY least(src, dst), greatest(src, dst) HAVING count(*) > 1)""",
)
def graph_violations(spark, sf):
    nodes = read(spark, sf, "part").select(F.col("p_partkey").alias("node")).union(read(spark, sf, "supplier").select(F.col("s_suppkey") + 1_000_000))
    return graph.violations(edges(spark, sf), kinds(spark), nodes)


@query("topic_counts", "SELECT source AS topic, nullif(lang, '') AS subtopic, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS topic_total FROM documents GROUP BY 1, 2")
def topic_counts(spark, sf):
    return topics.topic_counts(assets(spark, sf))


@query(
    "same_topic_groups",
    """SELECT subtopic, asset_id, rank, size, total FROM (SELECT lang AS subtopic, doc_id AS asset_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY lang) AS size, count(*) OVER () AS total FROM documents WHERE source = 'src3') WHERE rank <= 8""",
)
def same_topic_groups(spark, sf):
    return topics.same_topic(assets(spark, sf), "src3", 8)


@query("unclassified_assets", "SELECT doc_id AS asset_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unclassified_assets(spark, sf):
    return topics.unclassified(assets(spark, sf), read(spark, sf, "labels").withColumnRenamed("doc_id", "asset_id")).select("asset_id")


@query(
    "vector_candidates",
    f"""WITH p AS (SELECT a.vec_id AS source, b.vec_id // 2 AS asset_id, {DOT("a.embedding", "b.embedding")} / (sqrt({DOT("a.embedding", "a.embedding")}) * sqrt({DOT("b.embedding", "b.embedding")})) AS sim
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0 AND b.vec_id // 2 <> a.vec_id),
m AS (SELECT source, asset_id, max(sim) AS sim FROM p GROUP BY 1, 2 HAVING max(sim) >= 0.2)
SELECT source, asset_id, round(sim, 6) AS sim, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY sim DESC, asset_id) AS INTEGER) AS rank FROM m) WHERE rank <= 10""",
)
def vector_candidates(spark, sf):
    vectors = read(spark, sf, "embeddings")
    chunks = vectors.select(F.floor(F.col("vec_id") / 2).alias("asset_id"), F.col("label").alias("channel"), F.col("embedding").alias("vector"))
    sources = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("source"), F.col("label").alias("channel"), F.col("embedding").alias("vector"))
    return candidates.by_vector(sources, chunks, least=0.2, k=10).withColumn("sim", F.round("sim", 6))


@query("mean_vectors", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS x FROM embeddings, range(64) r(i) GROUP BY 1, 2")
def mean_vectors(spark, sf):
    means = candidates.mean_vectors(read(spark, sf, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    "upserted_edges",
    f"""WITH {EDGES}, o AS (SELECT src, dst, kind, max(confidence) AS confidence, 'old' AS reason, 'active' AS status, 0 AS age FROM edges WHERE status = 'active' GROUP BY 1, 2, 3),
f AS (SELECT src, dst, kind, confidence, 'new' AS reason, 'proposed' AS status, 1 AS age FROM edges WHERE status = 'proposed' AND (kind <> 'same_domain' OR coalesce(confidence, 0) >= 0.03)),
b AS (SELECT * FROM o UNION ALL SELECT * FROM f)
SELECT src, dst, kind, max(coalesce(confidence, 0)) AS confidence, arg_max(reason, coalesce(confidence, 0) * 10 - age) AS reason, arg_min(status, age) AS status FROM b GROUP BY 1, 2, 3""",
)
def upserted_edges(spark, sf):
    e = edges(spark, sf, APART)
    old = e.where(F.col("status") == "active").groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.lit("old").alias("reason"), F.lit("active").alias("status"))
    nodes = read(spark, sf, "supplier").select((F.col("s_suppkey") + APART).alias("node"))
    new = e.where(F.col("status") == "proposed").select("src", "dst", "kind", "confidence", F.lit("new").alias("reason"))
    return merge.upsert_edges(old, new, kinds(spark), nodes, least_similarity=0.03).withColumn("dst", numbered("dst"))


SQL["upserted_edges"] = SQL["upserted_edges"].replace("arg_max(reason, coalesce(confidence, 0) * 10 - age)", "CASE WHEN max(CASE age WHEN 1 THEN coalesce(confidence, 0) END) > coalesce(max(CASE age WHEN 0 THEN coalesce(confidence, 0) END), -1) THEN 'new' ELSE 'old' END")


@query(
    "stale_entities",
    """WITH n AS (SELECT c_custkey AS entity, c_mktsegment AS material, CASE WHEN c_nationkey < 20 THEN 1 ELSE 2 END AS version FROM customer),
s AS (SELECT entity, CASE WHEN entity % 7 = 0 THEN NULL WHEN entity % 5 = 0 THEN 'other' ELSE material END AS material, 1 AS version FROM n WHERE entity % 11 <> 0)
SELECT n.entity, CASE WHEN s.entity IS NULL THEN 'new' WHEN s.material IS NULL THEN 'no_hash' WHEN s.material <> n.material THEN 'changed' ELSE 'version' END AS reason
FROM n LEFT JOIN s ON n.entity = s.entity WHERE s.entity IS NULL OR s.material IS NULL OR s.material <> n.material OR s.version IS DISTINCT FROM n.version""",
)
def stale_entities(spark, sf):
    now = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("material"), F.when(F.col("c_nationkey") < 20, 1).otherwise(2).alias("version"))
    changed = F.when(F.col("entity") % 7 == 0, None).when(F.col("entity") % 5 == 0, "other").otherwise(F.col("material"))
    state = now.where(F.col("entity") % 11 != 0).select("entity", changed.alias("material"), F.lit(1).alias("version"))
    return merge.stale(now, state, ["entity"], material="material", version="version").select("entity", "reason")


RANKED = "ranked AS (SELECT o_custkey AS query, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), gold AS (SELECT o_custkey AS query, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')"


@query(
    "ranking_quality",
    f"""WITH {RANKED}, w AS (SELECT query, count(*) AS wanted FROM gold GROUP BY 1),
h AS (SELECT r.query, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM ranked r JOIN gold g ON r.query = g.query AND r.id = g.id WHERE rank <= 5 GROUP BY 1)
SELECT w.query, round(coalesce(hits, 0) / wanted, 6) AS recall, round(coalesce(hits, 0) / 5, 6) AS precision, round(coalesce(1 / first, 0), 6) AS rr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(wanted, 5) + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg FROM w LEFT JOIN h ON w.query = h.query""",
)
def ranking_quality(spark, sf):
    orders = read(spark, sf, "orders")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("o_totalprice"), "id"))
    ranked = orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), "o_totalprice").withColumn("rank", rank)
    gold = orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"))
    out = evaluation.ranking(ranked, gold, 5)
    return out.select("query", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "ndcg")])


@query(
    "wilson_by_source",
    """WITH g AS (SELECT source, sum(toxic) AS hits, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, n, round(greatest(((hits / n + 1.9208 / n) - 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 0), 6) AS low,
  round(least(((hits / n + 1.9208 / n) + 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 1), 6) AS high FROM g""",
)
def wilson_by_source(spark, sf):
    g = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"))
    g = g.withColumn("w", evaluation.wilson(F.col("hits"), F.col("n")))
    return g.select("source", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(
    "label_agreement",
    """WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), o AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM p),
c AS (SELECT sum(na * nb) AS s FROM (SELECT a AS v, count(*) AS na FROM p GROUP BY 1) x JOIN (SELECT b AS v, count(*) AS nb FROM p GROUP BY 1) y USING (v))
SELECT n, round(CASE WHEN n = 0 THEN 0.0 WHEN s / (n * n) >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END ELSE (po - s / (n * n)) / (1 - s / (n * n)) END, 6) AS kappa FROM o, c""",
)
def label_agreement(spark, sf):
    pairs = read(spark, sf, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return evaluation.kappa(pairs).select("n", F.round("kappa", 6).alias("kappa"))


@query("tag_facets", "SELECT lower(regexp_replace(p_type, '\\s+', '', 'g')) AS tag, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 2")
def tag_facets(spark, sf):
    return read(spark, sf, "part").groupBy(C.text_key(F.col("p_type")).alias("tag")).agg(F.count("*").alias("n")).where(F.col("n") >= 2)


@query("entity_modalities", "SELECT l_suppkey AS entity, p_size % 4 AS modality, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def entity_modalities(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_suppkey").alias("entity"), (F.col("p_size") % 4).alias("modality")).agg(F.count_distinct("l_partkey").alias("n"))


@query("isolated_parts", "SELECT p_partkey AS asset_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)")
def isolated_parts(spark, sf):
    linked = read(spark, sf, "lineitem").where("l_returnflag = 'A' and l_linenumber = 1").select(F.col("l_partkey").alias("asset_id"))
    return sets.isolated(read(spark, sf, "part").select(F.col("p_partkey").alias("asset_id")), linked, "asset_id")


@query("differing_candidates", """WITH l AS (SELECT DISTINCT l_partkey AS asset_id, l_suppkey AS entity FROM lineitem WHERE l_returnflag = 'A'),
  r AS (SELECT DISTINCT l_partkey AS asset_id, l_suppkey AS entity FROM lineitem WHERE l_returnflag = 'R')
SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def differing_candidates(spark, sf):
    line = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("asset_id"), F.col("l_suppkey").alias("entity"), "l_returnflag")
    return sets.differing(line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'R'"), ["asset_id", "entity"])


@query("merged_names", "SELECT p_partkey AS asset_id, array_to_string(CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END, '|') AS names FROM part")
def merged_names(spark, sf):
    names = sets.merged_names(F.array("p_brand"), F.array("p_type", "p_brand"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), F.array_join(names, "|").alias("names"))


@query("best_of_buckets", "SELECT l_partkey AS asset_id, max(l_discount) AS similarity FROM lineitem GROUP BY 1")
def best_of_buckets(spark, sf):
    line = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("asset_id"), F.col("l_discount").alias("similarity"), "l_returnflag")
    return sets.best_of_buckets([line.where(F.col("l_returnflag") == f) for f in ("A", "N", "R")], "asset_id", "similarity")
