"""Queries of result buckets, pages, entity search, registries and index documents, with equivalent SQL.

Parts are assets here (name as file name, brand and type as keywords), suppliers entities
with the brands of their parts as keywords, customers the rows of registries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import policy, registry
from .catalogue import query, read

WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
OF = lambda c: WORDS.format(c)
CLAUSES = f"""clauses AS (SELECT p_partkey, list_filter([
  CASE WHEN list_has_any({OF("p_brand || ' ' || p_type")}, ['cold', 'brand', '13']) THEN 'hit_keywords' END,
  CASE WHEN lower(p_brand) = 'cold brand#13' THEN 'hit_labels' END,
  CASE WHEN list_has_any({OF("p_name")}, ['cold', 'brand', '13']) THEN 'hit_file_name' END,
  CASE WHEN list_has_any({OF("p_type || ' ' || p_size")}, ['cold', 'brand', '13']) THEN 'hit_summary' END,
  CASE WHEN list_has_any({OF("p_brand || ' ' || p_type || ' ' || p_size")}, ['cold', 'brand', '13']) THEN 'hit_cross_meta' END], lambda x: x IS NOT NULL) AS m FROM part)"""
WORTH = """(CASE WHEN list_contains(m, 'hit_keywords') THEN 3.0 ELSE 0 END + CASE WHEN list_contains(m, 'hit_labels') THEN 2.0 ELSE 0 END + CASE WHEN list_contains(m, 'hit_file_name') THEN 1.5 ELSE 0 END
  + CASE WHEN list_contains(m, 'hit_summary') THEN 0.7 ELSE 0 END + CASE WHEN list_contains(m, 'hit_cross_meta') AND NOT list_has_any(m, ['hit_keywords', 'hit_labels', 'hit_file_name']) THEN 0.3 ELSE 0 END)"""


def clauses(part, text, operator="or"):
    return policy.word_clauses(text, keywords=F.array("p_brand", "p_type"), labels=F.array("p_brand"), file_name=F.col("p_name"), summary=F.concat_ws(" ", "p_type", F.col("p_size").cast("string")), operator=operator)


@query("evidence_ranked", f"WITH {CLAUSES} SELECT p_partkey AS asset_id, array_to_string(m, ',') AS matched, round(CAST({WORTH} AS DOUBLE), 6) AS evidence, {WORTH} >= 1.5 AS kept FROM clauses WHERE len(m) > 0")
def evidence_ranked(spark, sf):
    part = read(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("asset_id"), clauses(part, "cold Brand#13").alias("m")).where(policy.in_scope("cold", F.col("m"), F.lit(False), F.array().cast("array<string>"), F.lit(True)))
    return rows.select("asset_id", F.array_join("m", ",").alias("matched"), F.round(policy.evidence(F.col("m")), 6).alias("evidence"), policy.rescued(F.col("m")).alias("kept"))


@query(
    "about_filtered",
    """WITH r AS (SELECT p_partkey, p_brand AS bucket, p_type || ' ' || p_name AS words, lower(p_type) AS about FROM part),
n AS (SELECT bucket, count(*) AS n, count(*) FILTER (WHERE contains(words, 'cold')) AS a, count(*) FILTER (WHERE contains(words, 'widget')) AS b FROM r GROUP BY 1),
k AS (SELECT r.*, (about = 'eco' OR contains(about, 'eco') OR contains('eco', about) OR about = 'cold' OR contains(about, 'cold') OR contains(about, 'widget'))
  OR (contains(words, 'cold') AND a / n.n <= 0.25) OR (contains(words, 'widget') AND b / n.n <= 0.25) AS keep FROM r JOIN n ON r.bucket = n.bucket)
SELECT p_partkey AS asset_id FROM (SELECT *, bool_or(keep) OVER (PARTITION BY bucket) AS has_kept FROM k) WHERE keep OR NOT has_kept""",
)
def about_filtered(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("bucket"), F.concat_ws(" ", "p_type", "p_name").alias("words"), F.array(F.lower("p_type")).alias("about"))
    return policy.with_evidence(rows, "eco cold widget", bucket=["bucket"], about="about", words="words", most=0.25).select("asset_id")


FUSED = """fused AS (SELECT l_shipmode AS bucket, id AS asset_id, f AS fused, c AS cosine, id % 3 = 0 AS bm25, CASE id % 4 WHEN 0 THEN ['hit_keywords'] WHEN 1 THEN ['hit_summary', 'hit_cross_meta'] WHEN 2 THEN [] END AS m
  FROM (SELECT 'b' || (p_size % 7) AS l_shipmode, p_partkey AS id, (p_partkey * 37 % 101) / 100.0 AS f, (p_partkey * 53 % 97) / 96.0 * (0.2 + (p_size % 7) / 7.0) AS c FROM part)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY cosine) AS i, count(*) OVER (PARTITION BY bucket) AS n FROM fused),
gate AS (SELECT bucket, max(cosine) - coalesce(avg(cosine) FILTER (WHERE i <= n // 2), 0) >= 0.3 - 1e-9 AND max(cosine) >= 0.6 - 1e-9 AS passed FROM ordered GROUP BY 1)"""


def fused(spark, sf):
    part, key = read(spark, sf, "part"), F.col("p_partkey")
    matched = F.when(key % 4 == 0, F.array(F.lit("hit_keywords"))).when(key % 4 == 1, F.array(F.lit("hit_summary"), F.lit("hit_cross_meta"))).when(key % 4 == 2, F.array().cast("array<string>"))
    cosine = (key * 53 % 97) / F.lit(96.0) * (0.2 + (F.col("p_size") % 7) / F.lit(7.0))
    return part.select(F.concat(F.lit("b"), (F.col("p_size") % 7).cast("string")).alias("bucket"), key.alias("asset_id"), ((key * 37 % 101) / F.lit(100.0)).alias("fused"), cosine.alias("cosine"), (key % 3 == 0).alias("bm25"), matched.alias("matched"), (key * 29 % 89).cast("double").alias("score"))


@query(
    "bucketed_search",
    f"""WITH {FUSED}, kept AS (SELECT f.*, passed FROM fused f JOIN gate g ON f.bucket = g.bucket
  WHERE CASE WHEN passed THEN bm25 OR cosine >= 0.2 - 1e-9 ELSE bm25 AND (m IS NULL OR m = ['hit_keywords']) END)
SELECT bucket, asset_id, CAST(rank AS INTEGER) AS rank, CASE WHEN passed THEN 'gate_passed' ELSE 'evidence' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY fused DESC, asset_id) AS rank FROM kept) WHERE rank <= 20""",
)
def bucketed_search(spark, sf):
    rows = fused(spark, sf)
    found = policy.bucket_policy(rows, rows.select("bucket", "cosine"), bucket=["bucket"], key="asset_id", k=20, tuning=policy.Tuning(eps=0.3, floor=0.6))
    return found.select("bucket", "asset_id", "rank", "reason")


@query(
    "reranked_buckets",
    f"""WITH {FUSED}, placed AS (SELECT *, asset_id * 29 % 89 AS s, row_number() OVER (PARTITION BY bucket ORDER BY fused DESC, asset_id) AS place FROM fused),
head AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY s DESC, asset_id) AS a, row_number() OVER (PARTITION BY bucket ORDER BY fused DESC, asset_id) AS b FROM placed WHERE place <= 10 AND s >= 10)
SELECT h.bucket, h.asset_id, round(v.fused, 6) AS fused, CAST(h.a AS INTEGER) AS place FROM head h JOIN head v ON h.bucket = v.bucket AND h.a = v.b""",
)
def reranked_buckets(spark, sf):
    rows = fused(spark, sf).select("bucket", "asset_id", "fused", "score")
    found = policy.reranked(rows, bucket=["bucket"], key="asset_id", similarity="fused", score="score", most=10, tau=10.0)
    head = rows.groupBy("bucket").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("fused")).alias("f"), "asset_id", "score"))), 1, 10).alias("x"))
    first = head.select("bucket", F.explode("x").alias("x")).where("x.score >= 10").select("bucket", F.col("x.asset_id").alias("asset_id"))
    return found.join(first, ["bucket", "asset_id"]).select("bucket", "asset_id", F.round("fused", 6).alias("fused"), "place")


@query("file_page", "SELECT o_orderkey AS asset_id, strftime(o_orderdate, '%Y-%m-%d') AS day, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, (SELECT count(*) >= 10000 FROM orders WHERE o_orderstatus = 'F') AS total_capped FROM orders WHERE o_orderstatus = 'F' ORDER BY CAST(o_orderdate AS DATE) DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def file_page(spark, sf):
    rows = read(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("asset_id"), F.to_date("o_orderdate").alias("created_at"))
    return policy.file_page(rows, "created_desc", key="asset_id", start=100, size=50).select("asset_id", F.col("created_at").cast("string").alias("day"), "total", "total_capped")


ITEMS = """brands AS (SELECT l_suppkey, list_sort(list(DISTINCT p_brand)) AS k, count(DISTINCT l_partkey) AS members FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 4 GROUP BY 1),
items AS (SELECT s_suppkey AS entity, s_name AS name, coalesce(k, []) AS keywords, 'nation ' || s_nationkey AS description, coalesce(members, 0) AS members FROM supplier LEFT JOIN brands ON s_suppkey = l_suppkey)"""


def items(spark, sf):
    part = read(spark, sf, "part").where("p_size < 4").select("p_partkey", "p_brand")
    brands = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_brand")).alias("k"), F.count_distinct("l_partkey").alias("members"))
    none = F.array().cast("array<string>")
    rows = read(spark, sf, "supplier").join(brands, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.coalesce("k", none).alias("keywords"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("description"), F.coalesce("members", F.lit(0)).alias("members"))


NARROWED = f"""{ITEMS}, flags AS (SELECT *, contains(lower(name), '7') AS a0, len(list_filter(keywords, lambda x: contains(lower(x), '7'))) > 0 AS a1, contains(replace(lower(description), ' ', ''), '7') AS a2,
  len(list_filter(keywords, lambda x: contains(lower(x), 'brand#2'))) > 0 AS b1, contains(replace(lower(description), ' ', ''), 'nation1') AS c2 FROM items),
narrowed AS (SELECT entity, CAST((a0 OR a1 OR a2) AS INTEGER) + CAST(b1 AS INTEGER) + CAST(c2 AS INTEGER) AS hits, CASE WHEN a0 THEN 'name' WHEN a1 OR b1 THEN 'keyword' ELSE 'description' END AS reason,
  CASE WHEN a0 THEN NULL WHEN a1 THEN '7' WHEN b1 THEN 'brand#2' WHEN a2 THEN '7' ELSE 'nation1' END AS word, members, name FROM flags WHERE a0 OR a1 OR a2 OR b1 OR c2)"""


@query("narrowed_entities", f"WITH {NARROWED} SELECT entity, hits, reason, word FROM narrowed")
def narrowed_entities(spark, sf):
    return policy.narrowed_entities(items(spark, sf), "7 Brand#2 nation1").select("entity", "hits", "reason", "word")


@query(
    "fused_entities",
    f"""WITH {NARROWED}, t AS (SELECT entity, row_number() OVER (ORDER BY hits DESC, members DESC, name) AS rank FROM narrowed WHERE hits >= 2),
m AS (SELECT s_suppkey AS entity, round(s_acctbal / 10000.0, 2) AS similarity FROM supplier WHERE s_acctbal > 0),
x AS (SELECT * FROM m ANTI JOIN t ON m.entity = t.entity ORDER BY similarity DESC, entity LIMIT 10)
SELECT entity, similarity, CAST(row_number() OVER (ORDER BY tier, o, entity) AS INTEGER) AS place FROM (SELECT entity, NULL AS similarity, 0 AS tier, rank AS o FROM t UNION ALL SELECT entity, similarity, 1, -similarity FROM x)""",
)
def fused_entities(spark, sf):
    from pyspark.sql import Window as W

    rows = items(spark, sf)
    hits = policy.narrowed_entities(rows, "7 Brand#2 nation1").where("hits >= 2").withColumn("rank", F.row_number().over(W.orderBy(F.desc("hits"), F.desc("members"), "name")))
    meaning = read(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"), F.round(F.col("s_acctbal") / 10000.0, 2).alias("similarity"))
    return policy.fused_entities(rows, hits, meaning, ["entity"], most=10)


@query(
    "labelled_facets",
    """WITH r AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_name ELSE p_name END AS label FROM part),
k AS (SELECT p_partkey, trim(label) AS label, replace(lower(label), ' ', '') AS key FROM r),
n AS (SELECT key, label, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, label) AS i FROM k GROUP BY 1, 2), u AS (SELECT key, count(DISTINCT p_partkey) AS units FROM k GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2)
SELECT u.key, n.label, units, (SELECT count(*) > 12 FROM u) AS has_more FROM u JOIN n ON u.key = n.key AND i = 1 ORDER BY units DESC, label, u.key LIMIT 12""",
)
def labelled_facets(spark, sf):
    label = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    return policy.labelled_facets(read(spark, sf, "part").withColumn("x", label), "p_partkey", F.col("x"), F.replace(F.lower("x"), F.lit(" "), F.lit("")), n=12, least=2)


@query("spread_sample", "WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () / 40.0 AS step FROM customer) SELECT c_custkey FROM s SEMI JOIN (SELECT CAST(floor(j * (SELECT count(*) FROM customer) / 40.0) AS BIGINT) AS i FROM range(40) t(j)) p ON s.i = p.i")
def spread_sample(spark, sf):
    return policy.spread_sample(read(spark, sf, "customer"), "c_custkey", 40)


CUSTOMERS = "c AS (SELECT c_custkey AS owner, c_mktsegment AS label, c_nationkey AS n FROM customer)"


@query(
    "replaced_labels",
    f"""WITH {CUSTOMERS}, old AS (SELECT owner, 'segment' AS skill, label, 1 AS version FROM c WHERE n < 20)
SELECT * FROM old WHERE NOT (owner % 4 = 0 AND owner % 8 <> 0) UNION ALL SELECT owner, 'segment', unnest(CASE WHEN n < 10 THEN ['new', 'other'] ELSE ['unassigned'] END), 2 FROM c WHERE owner % 4 = 0 AND owner % 8 <> 0""",
)
def replaced_labels(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("n"))
    old = c.where("n < 20").select("owner", F.lit("segment").alias("skill"), "label", F.lit(1).alias("version"))
    labels = F.when(F.col("n") < 10, F.array(F.lit("new"), F.lit("other"))).otherwise(F.array(F.lit("unassigned")))
    judged = c.where("owner % 4 = 0").select("owner", F.lit("segment").alias("skill"), (F.col("owner") % 8 != 0).alias("ok"), labels.alias("labels"), F.lit(2).alias("version"))
    return registry.replaced_labels(old, judged, ["owner"])


@query(
    "versioned_definitions",
    f"""WITH {CUSTOMERS}, old AS (SELECT owner, label, n, 1 + n % 3 AS version FROM c WHERE owner % 3 <> 0), new AS (SELECT owner, CASE WHEN owner % 5 = 0 THEN 'CHANGED' ELSE label END AS label, n FROM c WHERE owner % 2 = 0)
SELECT n.owner, n.label, n.n, CAST(CASE WHEN o.owner IS NULL THEN 1 WHEN o.label <> n.label THEN o.version + 1 ELSE o.version END AS INTEGER) AS version, CASE WHEN o.owner IS NULL THEN 'registered' WHEN o.label <> n.label THEN 'updated' ELSE 'unchanged' END AS done
FROM new n LEFT JOIN old o ON n.owner = o.owner UNION ALL SELECT owner, label, n, CAST(version AS INTEGER), 'kept' FROM old WHERE owner % 2 <> 0""",
)
def versioned_definitions(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("n"))
    new = c.where("owner % 2 = 0").withColumn("label", F.when(F.col("owner") % 5 == 0, "CHANGED").otherwise(F.col("label")))
    return registry.versioned(c.where("owner % 3 <> 0").withColumn("version", 1 + F.col("n") % 3), new, ["owner"], ["label", "n"])


@query(
    "decided_reviews",
    """WITH e AS (SELECT o_orderkey AS edge_id, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'proposed' ELSE 'rejected' END AS status, o_custkey % 5 = 0 AS asked, o_custkey AS c FROM orders)
SELECT edge_id, CASE WHEN asked AND status = 'proposed' THEN CASE WHEN c % 10 = 0 THEN 'active' ELSE 'rejected' END ELSE status END AS status, CASE WHEN asked AND status = 'proposed' THEN 'rev' || c END AS reviewed_by, asked AND status = 'proposed' AS done FROM e""",
)
def decided_reviews(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "proposed").otherwise("rejected")
    e = read(spark, sf, "orders").select(F.col("o_orderkey").alias("edge_id"), status.alias("status"), F.col("o_custkey").alias("c"))
    to = e.where("c % 5 = 0").select("edge_id", F.concat(F.lit("rev"), F.col("c").cast("string")).alias("reviewer"), F.when(F.col("c") % 10 == 0, "active").otherwise("rejected").alias("status"))
    return registry.decided(e.select("edge_id", "status", F.lit(None).cast("string").alias("reviewed_by")), to)


@query("new_kinds", "SELECT DISTINCT k AS kind FROM (SELECT lower(trim(replace(event_type, ' ', '_'))) AS k FROM events UNION ALL SELECT 'mm_member' UNION ALL SELECT lower(p_brand) FROM part) WHERE regexp_full_match(k, '[a-z][a-z0-9_]{0,99}') AND k NOT IN ('mm_member', 'click', 'error')")
def new_kinds(spark, sf):
    raw = read(spark, sf, "events").select(F.upper(F.replace("event_type", F.lit(" "), F.lit("_"))).alias("k")).unionByName(read(spark, sf, "part").select(F.col("p_brand").alias("k"))).unionByName(spark.range(1).select(F.lit("mm_member").alias("k")))
    known = spark.range(1).select(F.explode(F.array(F.lit("click"), F.lit("error"))).alias("kind"))
    return registry.new_kinds(raw, "k", known)


@query(
    "refreshed_vectors",
    f"""WITH {CUSTOMERS} SELECT owner, CASE WHEN owner % 7 = 0 THEN 'created' WHEN owner % 5 = 0 OR owner % 3 = 0 THEN 'updated' ELSE 'reused' END AS done FROM c""",
)
def refreshed_vectors(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), texts.material_hash(F.col("c_mktsegment")).alias("material_hash"), F.lit("m").alias("model"), F.lit("1").alias("version"))
    old = c.where("owner % 7 <> 0").withColumns({"material_hash": F.when(F.col("owner") % 5 == 0, "x").otherwise(F.col("material_hash")), "version": F.when(F.col("owner") % 3 == 0, "0").otherwise("1")})
    return registry.refreshed_vectors(old, c, ["owner"]).select("owner", "done")


@query(
    "merged_aliases",
    """WITH x AS (SELECT p_brand AS b, list_sort(list(DISTINCT p_type)) AS t FROM part WHERE p_size < 20 GROUP BY 1), y AS (SELECT p_brand AS b, list_sort(list(DISTINCT lower(p_type))) || ['Extra', ' extra'] AS t FROM part WHERE p_size > 10 AND p_brand > 'Brand#2' GROUP BY 1)
SELECT coalesce(x.b, y.b) AS entity, array_to_string(coalesce(x.t, []) || CASE WHEN y.b IS NULL THEN [] ELSE list_filter(list_transform(y.t, lambda v: trim(v)), lambda v, i: NOT list_contains(list_transform(coalesce(x.t, []), lambda w: lower(w)), lower(v)) AND NOT list_contains(list_transform(y.t[:i - 1], lambda w: lower(trim(w))), lower(v))) END, '|') AS aliases,
  CASE WHEN x.b IS NULL THEN 'registered' WHEN y.b IS NULL THEN 'unchanged' ELSE 'updated' END AS done FROM x FULL OUTER JOIN y ON x.b = y.b""",
)
def merged_aliases(spark, sf):
    part = read(spark, sf, "part").withColumnRenamed("p_brand", "entity")
    old = part.where("p_size < 20").groupBy("entity").agg(F.array_sort(F.collect_set("p_type")).alias("aliases"))
    new = part.where("p_size > 10 AND entity > 'Brand#2'").groupBy("entity").agg(F.concat(F.array_sort(F.collect_set(F.lower("p_type"))), F.array(F.lit("Extra"), F.lit(" extra"))).alias("aliases"))
    return registry.merged_aliases(old, new, ["entity"]).withColumn("aliases", F.array_join("aliases", "|"))


@query(
    "entity_materials",
    f"""WITH {ITEMS}, t AS (SELECT entity, trim(name) || ' / supplier' || chr(10) || description || CASE WHEN len(keywords) > 0 THEN chr(10) || '{texts.KEYWORDS}' || array_to_string(keywords[:12], ', ') ELSE '' END AS m, trim(name) || '(supplier). ' || description AS j FROM items)
SELECT entity, sha256(m) AS material_hash, sha256(j) AS judged_hash FROM t""",
)
def entity_materials(spark, sf):
    none, name, kind, about = F.array().cast("array<string>"), F.col("name"), F.lit("supplier"), F.col("description")
    rows = items(spark, sf)
    return rows.select("entity", texts.material_hash(texts.search_material(name, kind, about, F.col("keywords"), none)).alias("material_hash"), texts.material_hash(texts.entity_material(name, kind, about, none)).alias("judged_hash"))


@query(
    "index_documents",
    """WITH l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'quality/good' ELSE NULL END AS q, CASE WHEN toxic = 1 THEN 'toxic/yes' ELSE NULL END AS t FROM labels)
SELECT d.doc_id AS asset_id, source || CASE WHEN lang <> '' THEN '>' || lang ELSE '' END AS pair, array_to_string(list_filter([q, t], lambda x: x IS NOT NULL), ',') AS label_keys, embedding IS NOT NULL AS has_vector FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
)
def index_documents(spark, sf):
    from ..operators import documents

    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    rows = docs.select(F.col("doc_id").alias("asset_id"), F.col("source").alias("path"), F.col("text").alias("summary"), F.array("lang").alias("keywords"), F.array(F.struct(F.col("source").alias("topic"), F.col("lang").alias("subtopic"))).alias("topics"))
    marks = F.array(F.struct(F.lit("quality").alias("skill"), F.when(F.col("quality") == 1, "good").otherwise("unassigned").alias("label")), F.struct(F.lit("toxic").alias("skill"), F.when(F.col("toxic") == 1, "yes").otherwise("").alias("label")))
    found = documents.asset_documents(rows, labels.select(F.col("doc_id").alias("asset_id"), marks.alias("labels")), read(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("embedding").alias("vector")))
    return found.select("asset_id", F.array_join("topic_pairs", ",").alias("pair"), F.array_join("label_keys", ",").alias("label_keys"), F.col("embedding").isNotNull().alias("has_vector"))


@query("label_targets", "SELECT l_suppkey AS entity, count(DISTINCT l_partkey) AS members, array_to_string(list_sort(list(DISTINCT l_shipmode) FILTER (WHERE l_shipmode IS NOT NULL)), ',') AS keywords FROM (SELECT *, CASE WHEN l_linenumber < 3 THEN l_returnflag END AS l_shipmode FROM lineitem) GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 20")
def label_targets(spark, sf):
    from ..operators import documents

    line = read(spark, sf, "lineitem")
    reason = F.when(F.col("l_linenumber") < 3, F.concat(F.lit("kw="), "l_returnflag", F.lit("|pv=1|rv=3")))
    return documents.embedding_targets(line.select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("asset"), reason.alias("reason")), ["entity"], least=20).withColumn("keywords", F.array_join("keywords", ","))


@query(
    "topic_assets",
    """WITH t AS (SELECT DISTINCT doc_id, lang FROM documents WHERE source = 'src1') SELECT doc_id AS asset_id, lang AS modality, (SELECT count(*) FROM t WHERE lang = 'en') AS total FROM t WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 5""",
)
def topic_assets(spark, sf):
    from ..operators import documents

    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), F.col("source").alias("topic"), F.col("lang").alias("modality"))
    return documents.topic_assets(rows, "src1", modality="en", limit=20, offset=5)[0]


@query("verdict_rates", "WITH v AS (SELECT CASE WHEN quality = 0 THEN 'wrong' WHEN toxic = 1 THEN 'unsure' WHEN doc_id % 3 = 0 THEN '' ELSE 'right' END AS verdict FROM labels) SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM v WHERE verdict <> ''), 6) AS share FROM v WHERE verdict <> '' GROUP BY 1")
def verdict_rates(spark, sf):
    from ..operators import documents

    verdict = F.when(F.col("quality") == 0, "wrong").when(F.col("toxic") == 1, "unsure").when(F.col("doc_id") % 3 == 0, "").otherwise("right")
    return documents.verdict_rates(read(spark, sf, "labels").select(verdict.alias("verdict"))).withColumn("share", F.round("share", 6))
