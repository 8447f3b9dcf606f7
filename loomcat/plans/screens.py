"""Queries of screens, queues and measures, with equivalent SQL.

Entities are parts (type and key) with orders as member assets, whose priority is the
modality; brands and size bands are their labels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters, scalars
from ..operators import candidates, entities, evaluation, search, work
from ..sources import files
from .catalogue import DOT, NEAR, QVEC, edges, query, read

BLANK = "' \t\n\r\x0b\x0c'"
LEAST = 30
CODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MEMBERS = """members AS (SELECT p_type AS entity_type, CAST(p_partkey AS VARCHAR) AS entity_uid, l_orderkey AS asset, o_orderpriority AS modality, CASE l_linestatus WHEN 'F' THEN 'active' ELSE 'proposed' END AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
shown AS (SELECT entity_type, entity_uid, count(DISTINCT asset) AS members FROM members GROUP BY 1, 2 HAVING count(DISTINCT asset) >= 30)"""
TAGGED = """tagged AS (SELECT p_type AS entity_type, CAST(p_partkey AS VARCHAR) AS entity_uid, 'brand' AS skill, p_brand AS label FROM part
  UNION ALL SELECT p_type, CAST(p_partkey AS VARCHAR), 'size', CASE WHEN p_size < 17 THEN 'small' WHEN p_size < 34 THEN 'medium' ELSE 'large' END FROM part),
labels_ AS (SELECT DISTINCT skill, label FROM tagged UNION ALL SELECT 'size', 'huge')"""


def members(spark, sf):
    part, orders = read(spark, sf, "part").select("p_partkey", "p_type"), read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    line = read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linestatus")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("l_linestatus") == "F", "active").otherwise("proposed")
    return rows.select(F.col("p_type").alias("entity_type"), F.col("p_partkey").cast("string").alias("entity_uid"), F.col("l_orderkey").alias("asset"), F.col("o_orderpriority").alias("modality"), status.alias("status"))


def tagged(spark, sf):
    part = read(spark, sf, "part")
    own = part.select(F.col("p_type").alias("entity_type"), F.col("p_partkey").cast("string").alias("entity_uid"), "p_brand", "p_size")
    band = F.when(F.col("p_size") < 17, "small").when(F.col("p_size") < 34, "medium").otherwise("large")
    both = F.array(F.struct(F.lit("brand").alias("skill"), F.col("p_brand").alias("label")), F.struct(F.lit("size").alias("skill"), band.alias("label")))
    return own.select(*entities.KEY, F.explode(both).alias("x")).select(*entities.KEY, "x.skill", "x.label")


def labels(spark, sf):
    return tagged(spark, sf).select("skill", "label").distinct().unionByName(spark.createDataFrame([("size", "huge")], "skill string, label string"))


@query("entity_page", f"WITH {MEMBERS}, t AS (SELECT *, CASE WHEN entity_uid LIKE '%7' THEN 2 WHEN entity_uid LIKE '%3' THEN 1 ELSE 0 END AS tier FROM shown) SELECT * FROM t WHERE tier < 2 OR (tier = 2 AND (members < 33 OR (members = 33 AND entity_uid > '5'))) ORDER BY tier DESC, members DESC, entity_uid, entity_type LIMIT 100")
def entity_page(spark, sf):
    found = entities.shown(members(spark, sf), LEAST)
    named = read(spark, sf, "part").select(F.col("p_type").alias("entity_type"), F.col("p_partkey").cast("string").alias("entity_uid"))
    rows = entities.tiered(found, named.where(F.col("entity_uid").endswith("7")), named.where(F.col("entity_uid").endswith("3")))
    return entities.entity_page(rows, 100, [2, 33, "5", ""])


@query("entity_type_counts", f"WITH {MEMBERS} SELECT entity_type, count(*) AS n FROM shown GROUP BY 1")
def entity_type_counts(spark, sf):
    return entities.shown(members(spark, sf), LEAST).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("entity_label_counts", f"WITH {MEMBERS}, {TAGGED} SELECT l.skill, l.label, count(s.entity_uid) AS n FROM labels_ l LEFT JOIN (SELECT t.* FROM tagged t SEMI JOIN shown s ON t.entity_type = s.entity_type AND t.entity_uid = s.entity_uid) s ON l.skill = s.skill AND l.label = s.label GROUP BY 1, 2")
def entity_label_counts(spark, sf):
    return entities.label_counts(labels(spark, sf), tagged(spark, sf), entities.shown(members(spark, sf), LEAST))


@query(
    "entity_facets",
    f"""WITH {MEMBERS}, {TAGGED}, scoped AS (SELECT s.* FROM shown s SEMI JOIN (SELECT entity_type, entity_uid FROM tagged WHERE label = 'small') t ON s.entity_type = t.entity_type AND s.entity_uid = t.entity_uid),
have AS (SELECT s.entity_type, s.entity_uid, list(DISTINCT m.modality) AS mods FROM scoped s JOIN members m ON s.entity_type = m.entity_type AND s.entity_uid = m.entity_uid GROUP BY 1, 2),
chosen AS (SELECT entity_type, entity_uid FROM have WHERE list_contains(mods, '1-URGENT'))
SELECT 'type' AS axis, entity_type AS name, count(*) AS n FROM chosen GROUP BY 2
UNION ALL SELECT 'area', l.label, count(s.entity_uid) FROM labels_ l LEFT JOIN (SELECT t.* FROM tagged t SEMI JOIN chosen s ON t.entity_type = s.entity_type AND t.entity_uid = s.entity_uid) s ON l.skill = s.skill AND l.label = s.label GROUP BY l.skill, l.label
UNION ALL SELECT 'modality', c.code, count(have.entity_uid) FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS code) c LEFT JOIN have ON list_contains(mods, '1-URGENT') AND list_contains(mods, c.code) GROUP BY 2""",
)
def entity_facets(spark, sf):
    return entities.entity_facets(members(spark, sf), labels(spark, sf), tagged(spark, sf), CODES, least=LEAST, areas=["small"], picked=["1-URGENT"])


@query("entity_bundle", f"WITH {MEMBERS}, o AS (SELECT DISTINCT modality, asset FROM members WHERE entity_uid = '7') SELECT * FROM (SELECT modality, asset, CAST(row_number() OVER (PARTITION BY modality ORDER BY asset) AS INTEGER) AS rank, count(*) OVER (PARTITION BY modality) AS n FROM o) WHERE rank <= 5")
def entity_bundle(spark, sf):
    kind = read(spark, sf, "part").where(F.col("p_partkey") == 7).select("p_type").first()
    return entities.bundle(members(spark, sf), kind.p_type if kind else "", "7", 5)


@query("entity_assets", f"WITH {MEMBERS} SELECT DISTINCT asset FROM members m SEMI JOIN shown s ON m.entity_type = s.entity_type AND m.entity_uid = s.entity_uid WHERE modality <> '5-LOW'")
def entity_assets(spark, sf):
    rows = members(spark, sf)
    return entities.member_assets(rows, entities.shown(rows, LEAST), without="5-LOW")


@query(
    "label_state",
    """WITH r AS (SELECT c_mktsegment AS entity_type, CAST(c_nationkey AS VARCHAR) AS entity_uid, 'skill' AS skill, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE CAST(c_custkey % 2 AS VARCHAR) END AS h, CAST(c_nationkey % 3 AS INTEGER) AS v, 'p1' AS p FROM customer)
SELECT entity_type, entity_uid, skill, bool_or(h IS NULL) AS no_hash, max(h) AS material_hash, max(v) AS skill_version, max(p) AS prompt_version, count(DISTINCT coalesce(h, '')) > 1 OR count(DISTINCT v) > 1 AS mixed FROM r GROUP BY 1, 2, 3""",
)
def label_state(spark, sf):
    own = read(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("entity_type"), F.col("c_nationkey").cast("string").alias("entity_uid"), F.lit("skill").alias("skill"),
        F.when(F.col("c_custkey") % 97 != 0, (F.col("c_custkey") % 2).cast("string")).alias("material_hash"), (F.col("c_nationkey") % 3).cast("int").alias("skill_version"), F.lit("p1").alias("prompt_version"),
    )
    return entities.label_state(own)


@query("description_targets", f"""WITH {MEMBERS}, s AS (SELECT *, CASE WHEN CAST(entity_uid AS BIGINT) % 5 <> 0 THEN 30 END AS stored, CASE WHEN CAST(entity_uid AS BIGINT) % 4 <> 0 THEN 'p' || CAST(CAST(entity_uid AS BIGINT) % 2 AS VARCHAR) END AS prompt FROM shown),
r AS (SELECT entity_type, entity_uid, members, CASE WHEN prompt IS NULL THEN 'missing' WHEN stored IS NULL OR abs(members - stored) / stored >= 0.2 THEN 'member_count' WHEN prompt <> 'p1' THEN 'prompt_version' END AS reason FROM s) SELECT * FROM r WHERE reason IS NOT NULL""")
def description_targets(spark, sf):
    n = F.col("entity_uid").cast("long")
    reason = entities.description_reason(F.when(n % 5 != 0, 30), F.when(n % 4 != 0, F.concat(F.lit("p"), (n % 2).cast("string"))), F.col("members"), "p1")
    return entities.shown(members(spark, sf), LEAST).withColumn("reason", reason).where(F.col("reason").isNotNull())


@query("pending_assets", "SELECT doc_id AS asset_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality >= 1)")
def pending_assets(spark, sf):
    state = read(spark, sf, "labels").select(F.col("doc_id").alias("asset_id"), F.lit("s").alias("skill"), F.col("quality").alias("skill_version"))
    return work.pending(read(spark, sf, "documents").select(F.col("doc_id").alias("asset_id")), state, "s", 1)


@query("unresolved_assets", "SELECT doc_id AS asset_id, coalesce(toxic, -1) AS attempts FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id IN (SELECT vec_id FROM embeddings) AND (quality = 0 OR quality IS NULL)")
def unresolved_assets(spark, sf):
    state = read(spark, sf, "labels").select(F.col("doc_id").alias("asset_id"), F.when(F.col("quality") == 0, "pending").otherwise("resolved").alias("status"), F.col("toxic").alias("attempts"))
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"))
    return work.unresolved(read(spark, sf, "documents").select(F.col("doc_id").alias("asset_id")), vectors, state).na.fill(-1, ["attempts"])


@query("hollow_assets", "SELECT lang AS modality, count(*) AS n, count(*) FILTER (WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS hollow FROM documents GROUP BY 1")
def hollow_assets(spark, sf):
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), F.col("lang").alias("modality"))
    return work.hollow(rows, read(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id")))


@query(
    "place_candidates",
    """WITH p AS (SELECT doc_id AS id, 'd' || (doc_id // 50) AS dir, 'doc' || (doc_id // 20) AS norm, CASE doc_id % 3 WHEN 0 THEN 'doc' || (doc_id // 20) ELSE 'doc' || (doc_id // 20) || '_v' || (doc_id % 3) END AS raw FROM documents)
SELECT * FROM (SELECT a.id AS source, b.id AS asset_id, CAST(CASE WHEN a.raw = b.raw THEN 2 ELSE 1 END AS INTEGER) AS proximity, CAST(row_number() OVER (PARTITION BY a.id ORDER BY a.raw = b.raw DESC, b.id) AS INTEGER) AS rank
  FROM p a JOIN p b ON a.dir = b.dir AND a.norm = b.norm AND a.id <> b.id) WHERE rank <= 10""",
)
def place_candidates(spark, sf):
    stem = F.concat(F.lit("Doc"), F.floor(F.col("doc_id") / 20).cast("string"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("_v"), (F.col("doc_id") % 3).cast("string"))))
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit("/"), stem, F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".PDF")).alias("path"))
    return work.by_place(rows, rows, 10)


@query("candidate_union", """WITH a AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, 'vector' AS origin FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, 'place' AS origin FROM lineitem WHERE l_returnflag = 'R')
SELECT * FROM a UNION ALL SELECT * FROM r ANTI JOIN a ON r.a = a.a AND r.b = a.b""")
def candidate_union(spark, sf):
    line = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    side = lambda flag, origin: line.where(F.col("l_returnflag") == flag).select("a", "b").distinct().withColumn("origin", F.lit(origin))
    return candidates.prefer_first(side("A", "vector"), side("R", "place"), ["a", "b"])


@query("hash_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def hash_dedup(spark, sf):
    return files.first_of_hash(read(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash")), "file_hash", "doc_id")


@query(
    "chunked_texts",
    f"""WITH t AS (SELECT doc_id, trim(coalesce(text, ''), {BLANK}) AS t FROM documents),
c AS (SELECT doc_id, i, substr(t, i * 512 + 1, 512) AS c, CASE WHEN i > 0 THEN substr(t, i * 512 + 1 - 64, 64) END AS before FROM (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 512) AS BIGINT))) AS i FROM t WHERE t <> ''))
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, sha256(CASE WHEN i > 0 THEN trim(before || chr(10) || c, {BLANK}) ELSE c END) AS chunk_hash FROM c""",
)
def chunked_texts(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode(files.chunks(F.col("text"), 512, overlap=64)).alias("chunk_index", "chunk"))
    return rows.select("doc_id", "chunk_index", F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_hash"))


@query("filtered_assets", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3') AND ((n_chars >= 100 AND n_chars < 900) OR n_chars >= 5000)")
def filtered_assets(spark, sf):
    wanted = filters.parse_filters(topic=["src1", "src2", " src3 ", "src1"], modality=["en", "de"], file_size_ranges=[(5000, None), (100, 900)])
    rows = read(spark, sf, "documents")
    return rows.where(wanted.condition({"topics": F.array("source"), "modality": F.col("lang"), "file_size": F.col("n_chars")})).select("doc_id")


@query("filtered_by_day", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'")
def filtered_by_day(spark, sf):
    wanted = filters.parse_filters(created_from="1995-03-01", created_to="1996-02-29T13:30:00Z")
    return read(spark, sf, "orders").where(wanted.condition({"created": F.col("o_orderdate")})).select("o_orderkey")


@query("narrowed_parts", "WITH k AS (SELECT *, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS a, lower(regexp_replace(p_brand, '\\s+', '', 'g')) AS b, lower(regexp_replace(p_type, '\\s+', '', 'g')) AS c FROM part) SELECT p_partkey FROM k WHERE (contains(a, 'brand#1') OR contains(b, 'brand#1') OR contains(c, 'brand#1')) AND (contains(a, '1') OR contains(b, '1') OR contains(c, '1'))")
def narrowed_parts(spark, sf):
    return read(spark, sf, "part").where(filters.narrowed(" BRAND#1  １ ", [F.col("p_name"), F.col("p_brand"), F.col("p_type")])).select("p_partkey")


@query("exposed_edges", "SELECT l_orderkey || '-' || l_linenumber AS edge_id, CASE WHEN l_linestatus = 'F' THEN 'strong' WHEN l_returnflag <> 'A' OR l_discount >= 0.04 THEN 'weak' END AS tier, CAST(CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_returnflag <> 'A' OR l_discount >= 0.04 THEN 1 ELSE 2 END AS INTEGER) AS tier_rank FROM lineitem")
def exposed_edges(spark, sf):
    tier = filters.exposure(F.col("status"), F.col("kind"), F.col("confidence"), 0.04)
    return edges(spark, sf).select("edge_id", tier.alias("tier"), filters.tier_rank(tier).alias("tier_rank"))


@query("decided_edges", "SELECT CASE WHEN l_discount >= 0.05 AND l_returnflag <> 'A' AND l_tax >= 0.02 THEN 'active' ELSE 'proposed' END AS status, count(*) AS n FROM lineitem GROUP BY 1")
def decided_edges(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "same_domain").otherwise("references")
    status = filters.decided(kind, F.col("l_discount"), F.col("l_tax"), least=0.05, least_similarity=0.02, never=["same_domain"])
    return read(spark, sf, "lineitem").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("visible_fields", """SELECT c_custkey, concat_ws(',', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'account' END, 'free', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'name' END) AS fields FROM customer""")
def visible_fields(spark, sf):
    meta = F.create_map(F.lit("name"), F.col("c_name"), F.lit("account"), F.col("c_acctbal").cast("string"), F.lit("secret"), F.col("c_mktsegment"), F.lit("free"), F.lit("x"))
    domain = F.when(F.col("c_mktsegment") == "BUILDING", "medical").otherwise("review")
    seen = filters.visible(meta, {"name": "public", "account": "authorized", "secret": "regulated"}, domain, "authorized")
    return read(spark, sf, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(seen)), ",").alias("fields"))


@query("clamped_events", "SELECT event_id, least(greatest(value / 50, 0), 1) AS confidence, regexp_matches(event_type, '^[a-z][a-z0-9_]{0,99}$') AND event_type <> 'error' AS known FROM events")
def clamped_events(spark, sf):
    code = filters.kind_code(F.upper("event_type"), ["error"])
    return read(spark, sf, "events").select("event_id", filters.clamped(F.col("value") / 50).alias("confidence"), code.isNotNull().alias("known"))


@query("gate_signal", f"WITH s AS (SELECT label, {DOT('embedding', 'q')} / (sqrt({DOT('embedding', 'embedding')}) * sqrt({DOT('q', 'q')})) AS c FROM embeddings, (SELECT {QVEC} AS q)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c) AS r, count(*) OVER (PARTITION BY label) AS n FROM s) SELECT label, round(max(c), 6) AS top, round(coalesce(avg(c) FILTER (WHERE r <= n // 2), 0), 6) AS baseline FROM r GROUP BY 1")
def gate_signal(spark, sf):
    near = read(spark, sf, "embeddings").select("label", scalars.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in QVEC])).alias("c"))
    return evaluation.gate_signal(near, ["label"], "c").select("label", F.round("top", 6).alias("top"), F.round("baseline", 6).alias("baseline"))


@query("radial_search", f"WITH {NEAR.replace('LIMIT 50', '')} SELECT doc_id, round((cosine + 1) / 2, 6) AS score FROM semantic WHERE cosine >= 0.05 ORDER BY cosine DESC, doc_id LIMIT 500")
def radial_search(spark, sf):
    near = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), scalars.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in QVEC])).alias("cosine"))
    return search.radial(near, "doc_id", "cosine", 0.05, 500).select("doc_id", F.round("score", 6).alias("score"))


THRESHOLDS = (0.0, 0.02, 0.05, 0.08, 0.2)


@query(
    "relation_sweep",
    """WITH e AS (SELECT l_partkey AS s, l_suppkey + 1000000 AS t, l_returnflag AS kind, l_discount AS c FROM lineitem),
g AS (SELECT l_partkey AS s, l_suppkey + 1000000 AS t, max(l_returnflag) AS kind FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2), i AS (SELECT p_partkey AS p FROM part WHERE p_size < 5),
x AS (SELECT unnest([0.0, 0.02, 0.05, 0.08, 0.2]::DOUBLE[]) AS threshold),
j AS (SELECT e.*, g.kind AS gold FROM e LEFT JOIN g ON e.s = g.s AND e.t = g.t),
a AS (SELECT threshold, count(j.s) AS accepted, count(gold) AS hits, count(*) FILTER (WHERE gold = kind) AS kinds, count(DISTINCT CASE WHEN gold IS NOT NULL THEN j.s * 10000000 + j.t END) AS covered FROM x LEFT JOIN j ON c >= threshold GROUP BY 1),
b AS (SELECT threshold, count(*) AS isolated, count(*) FILTER (WHERE best IS NULL OR best < threshold) AS clean FROM x, i LEFT JOIN (SELECT s, max(c) AS best FROM e GROUP BY 1) m ON i.p = m.s GROUP BY 1)
SELECT threshold, round(CASE WHEN accepted > 0 THEN hits / accepted ELSE 0 END, 9) AS precision, round(covered / (SELECT count(*) FROM g), 9) AS recall, round(CASE WHEN hits > 0 THEN kinds / hits ELSE 0 END, 9) AS kind_accuracy, round(clean / isolated, 9) AS isolation_accuracy, accepted FROM a JOIN b USING (threshold)""",
)
def relation_sweep(spark, sf):
    line = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1_000_000).alias("target"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("confidence"), "l_quantity")
    gold = line.where(F.col("l_quantity") > 40).select(F.col("target").alias("a"), F.col("source").alias("b"), "kind")
    alone = read(spark, sf, "part").where(F.col("p_size") < 5).select(F.col("p_partkey").alias("asset_id"))
    out = evaluation.relation_sweep(line.drop("l_quantity"), gold, alone, THRESHOLDS)
    return out.select("threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "kind_accuracy", "isolation_accuracy")], "accepted")
