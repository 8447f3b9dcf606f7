"""Rules of buckets, entities, registries and texts on odd rows."""

import pytest
from pyspark.sql import functions as F

from loomcat.functions import texts
from loomcat.operators import documents, policy, registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*values):
    return F.array(*map(F.lit, values)).cast("array<string>")


def test_evidence(spark):
    assert one(spark, policy.evidence(arr("hit_summary", "hit_cross_meta", "other"))) == 1.0
    assert one(spark, policy.evidence(arr("hit_keywords", "hit_cross_meta"))) == 3.0
    assert one(spark, policy.evidence(F.lit(None).cast("array<string>"))) == 0.0
    assert one(spark, policy.evidence(arr("hit_keywords", "hit_summary"), only=policy.STRONG)) == 3.0
    keep = lambda m, mode="auto": one(spark, policy.rescued(m, mode))
    assert keep(F.lit(None).cast("array<string>")) and not keep(arr())
    assert not keep(arr("hit_summary")) and keep(arr("hit_summary"), "keyword")
    assert policy.has_semantics("a?") and not policy.has_semantics(" ?!") and not policy.has_semantics(None)
    with pytest.raises(ValueError):
        policy.Tuning(mode="other")


def test_word_clauses(spark):
    fields = {"keywords": arr("Red apple"), "labels": arr("Fruit"), "file_name": F.lit("apple.jpg"), "summary": F.lit("a tree")}
    clauses = lambda q, how: one(spark, policy.word_clauses(q, operator=how, **fields))
    assert clauses("apple tree", "or") == ["hit_keywords", "hit_file_name", "hit_summary", "hit_cross_meta"]
    assert clauses("apple tree", "and") == ["hit_cross_meta"]
    assert clauses(" FRUIT ", "and") == ["hit_labels"]
    assert clauses("?!", "or") == []


def test_about_filter_keeps_a_bucket_that_would_be_empty(spark):
    rows = spark.createDataFrame([(1, "x", ["cat"], "cat toy"), (2, "x", ["dog"], "dog toy"), (3, "x", None, None), (4, "y", ["fish"], "toy")], "id int, b string, about array<string>, words string")
    kept = lambda q: sorted(r.id for r in policy.with_evidence(rows, q, bucket=["b"], about="about", words="words").collect())
    assert kept("cats") == [1, 4] and kept("toy") == [1, 2, 3, 4] and kept("dog toy") == [2, 4] and kept(" ") == [1, 2, 3, 4]


def test_bucket_policy(spark):
    rows = spark.createDataFrame([("p", 1, 0.9, 0.8, False, None, 1.0), ("p", 2, 0.8, 0.1, True, ["hit_summary"], 5.0), ("p", 3, 0.7, 0.1, False, None, 9.0), ("f", 4, 0.9, 0.3, False, None, 1.0), ("f", 5, 0.5, 0.3, True, ["hit_keywords"], 1.0), ("f", 6, 0.4, 0.3, True, [], 2.0)], "b string, id int, fused double, cosine double, bm25 boolean, matched array<string>, score double")
    run = lambda **t: [(r.b, r.id, r["rank"], round(r.fused, 3)) for r in policy.bucket_policy(rows, rows, bucket=["b"], key="id", k=5, tuning=policy.Tuning(**t)).orderBy("b", "rank").collect()]
    assert run() == [("f", 5, 1, 0.5), ("p", 1, 1, 0.9), ("p", 2, 2, 0.8)]
    assert run(operator="or") == [("p", 1, 1, 0.9), ("p", 2, 2, 0.8)]
    assert run(rescue=False)[:2] == [("f", 5, 1, 0.5), ("f", 6, 2, 0.4)]
    assert run(rerank=2)[1:] == [("p", 2, 1, 0.9), ("p", 1, 2, 0.8)]
    assert len(run(cutoff=False)) == 6


def test_pages_and_samples(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(6)], "id int, file_size int")
    page = policy.file_page(rows, "size_desc", key="id", start=4, size=5).collect()
    assert [(r.id, r.total) for r in sorted(page, key=lambda r: r.id)] == [(3, 6), (4, 6)]
    with pytest.raises(ValueError):
        policy.file_page(rows, "relevance", key="id", start=990, size=50)
    ids = sorted(r.id for r in policy.spread_sample(rows.select("id"), "id", 4).collect())
    assert ids == [0, 1, 3, 4] and policy.spread_sample(rows, "id", 9).count() == 6
    assert policy.gated_meaning(spark.createDataFrame([(1, 0.9), (2, 0.1)], "id int, similarity double")).count() == 2
    assert policy.gated_meaning(spark.createDataFrame([(1, 0.5), (2, 0.45)], "id int, similarity double")).count() == 0


def test_registries(spark):
    old = spark.createDataFrame([("a", None, "1")], "kind string, name string, id string")
    made = {(r.kind, r.name): r.id for r in registry.ensured(old, spark.createDataFrame([("a", None), ("b", None), ("b", None)], "kind string, name string"), ["kind", "name"], "id").collect()}
    assert made["a", None] == "1" and len(made) == 2
    labels = spark.createDataFrame([(1, "s", "x", 1)], "id int, skill string, label string, version int")
    for bad in (["a", "a"], ["a", "unassigned"]):
        with pytest.raises(ValueError):
            registry.replaced_labels(labels, spark.createDataFrame([(1, "s", True, bad, 2)], "id int, skill string, ok boolean, labels array<string>, version int"), ["id"])
    kinds = spark.createDataFrame([("k", "name", "text", "active")], "kind string, name string, description string, status string")
    new = spark.createDataFrame([("k", " ", "more"), ("n", "new", None)], "kind string, name string, description string")
    assert sorted(map(tuple, registry.upserted_kinds(kinds, new).collect())) == [("k", "name", "more", "active"), ("n", "new", None, "inactive")]
    assert registry.promoted(kinds, ["k"]).first().status == "active"
    done = registry.decided(spark.createDataFrame([(1, "active", None)], "edge_id int, status string, reviewed_by string"), spark.createDataFrame([(1, "me", "rejected")], "edge_id int, reviewer string, status string"), revise=True).first()
    assert (done.status, done.reviewed_by, done.done) == ("rejected", "me", True)


def test_texts(spark):
    assert one(spark, texts.for_embedding(F.lit(" ａ​b\t\tc \r\n\n\n\n d\x01 "))) == "ab c\n\nd"
    assert one(spark, texts.search_material(F.lit(" n "), F.lit("t"), F.lit(" "), arr("b10", " a ", "b10", ""), arr("z"))) == f"n / t\n{texts.KEYWORDS}a, b10\n{texts.MEMBERS}z"
    assert one(spark, texts.search_material(F.lit(" "), F.lit("t"), F.lit("d"), arr(), arr())) is None
    assert one(spark, texts.entity_material(F.lit("n"), F.lit("t"), F.lit("d"), arr("s10", " "), 2)) == f"n(t). d {texts.EXCERPTS}s10"
    assert tuple(one(spark, texts.key_parts(F.lit("place/a/b")))) == ("place", "a/b")
    assert one(spark, texts.after_prefix(F.lit("x__a__b.txt"))) == "a__b.txt" and one(spark, texts.after_prefix(F.lit("plain"))) == "plain"
    assert one(spark, texts.type_label(F.lit("same_series"))) == "same series" and one(spark, texts.title_match(F.lit(" YES "))) == "yes" and one(spark, texts.title_match(F.lit(None).cast("string"))) == "unsure"
    assert one(spark, texts.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000"))) and not one(spark, texts.is_uuid(F.lit("x")))
    assert [x.label for x in one(spark, texts.by_score(F.array(*[F.struct(F.lit(s).alias("score"), F.lit(n).alias("label")) for s, n in ((0.1, "c"), (0.9, "b"), (0.9, "a"))])))] == ["a", "b", "c"]
    assert texts.like_escaped("a%_\\") == "a\\%\\_\\\\" and texts.kind_set("A, b,") == {"a", "b"} and texts.kind_set("") == set() and texts.kind_set(None, ["x"]) == {"x"}
    assert texts.modalities(" ") is None and texts.modalities("Text, image") == ["text", "image"]
    with pytest.raises(ValueError):
        texts.modalities("smell")


def test_entity_documents(spark):
    entities = spark.createDataFrame([("place", "p1", "Paris", ["x"], None)], "entity_type string, entity_uid string, name string, keywords array<string>, description string")
    members = spark.createDataFrame([("place", "p1", "b", ["k2"]), ("place", "p1", "a", ["k1", "k2"])], "entity_type string, entity_uid string, summary string, keywords array<string>")
    vectors = spark.createDataFrame([("place", "p1", [0.0, 0.0])], "entity_type string, entity_uid string, vector array<double>")
    row = documents.entity_documents(entities, members, vectors).first()
    assert (row.doc_id, row.member, row.embedding) == ("place/p1", "a b k1 k2", None)
