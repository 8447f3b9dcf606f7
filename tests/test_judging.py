"""Name resolution, skills, reports and the word index on odd rows."""

import pytest
from pyspark.sql import functions as F

from loomcat.functions import judged, names
from loomcat.operators import canon, postings, reports

ENTITY = "entity_type string, uid string, name string, aliases array<string>"
FOUND = "owner int, position int, entity_type string, name string, keyword string"


def test_alias_index_prefers_names(spark):
    rows = [("p", "1", "Ａ b", ["c"]), ("p", "2", "C", None), ("p", "0", " ", ["ab", ""])]
    got = {(r.key, r.name) for r in canon.alias_index(spark.createDataFrame(rows, ENTITY)).collect()}
    assert got == {("ab", "Ａ b"), ("c", "C"), ("0", "0")}


def test_contained_takes_long_runs_first(spark):
    index = canon.alias_index(spark.createDataFrame([("place", "abc def", "abc def", None), ("place", "def", "def", None), ("thing", "ghi", "ghi", None), ("place", "x1y", "x1y", None), ("thing", "x1y", "x1y", None), (canon.PERSON, "kl", "kl", None)], ENTITY))
    found = [(1, 0, "work", "abc def ghi x1y", "k"), (1, 1, "work", "kl abc def", "k"), (1, 2, "thing", "ghi", "k"), (2, 0, "work", "a kl", "k"), (2, 1, "place", "abc def", "k"), (3, 0, "work", "", "k"), (3, 1, "work", None, "k")]
    rows = canon.resolved(spark.createDataFrame(found, FOUND), index, ["owner"])
    got = canon.contained(rows, index, ["owner"], ["place", "thing", canon.PERSON]).collect()
    assert {(r.owner, r.entity_type, r.name) for r in got} == {(1, "place", "abc def"), (1, canon.PERSON, "kl")}


def test_official_end(spark):
    rows = spark.createDataFrame([("제주특별자치도",), ("독도",), ("도",), ("서울시",), ("abc",)], "key string")
    assert [r[0] for r in rows.select(canon.official_end(F.col("key"))).collect()] == ["특별자치도", None, None, "시", None]


def test_topics_pass_through_without_a_registry(spark):
    raws = spark.createDataFrame([("a", None), (None, "b")], "raw string, raw_en string")
    empty = spark.createDataFrame([], "topic_ko string, topic_en string, parent string")
    aliases = spark.createDataFrame([], "raw string, parent string, canonical string")
    got = {tuple(r) for r in canon.topics(raws, empty, aliases, lambda rows: []).collect()}
    assert got == {("a", None, "a", "general", "passthrough"), (None, "b", None, "b", "passthrough")}


def test_subtopics_without_a_candidate_are_new(spark):
    rows = spark.createDataFrame([("t", "a b"), ("t", "a c"), ("t", None), ("t", "image")], "topic string, raw string")
    aliases = spark.createDataFrame([], "raw string, parent string, canonical string")
    none = lambda labels: labels.where("false").withColumns({"rank": F.lit(1), "topic_ko": F.lit("x")})
    decided = canon.subtopics(rows, aliases, none, lambda asked: list(asked["raw"]))
    assert {(r.raw, r.canonical, r.decided_by) for r in decided.collect()} == {("a b", "a", "new"), ("a c", "a", "new"), (None, None, "none"), ("image", None, "none")}
    new, learned = canon.learned_subtopics(decided)
    assert [tuple(r) for r in new.collect()] == [("t", "a")] and [tuple(r) for r in learned.collect()] == [("a", "t", "a")]


def skill(**policy):
    label = lambda c: {"code": c, "name": c.upper(), "definition": "d", "not": "n"}
    return {"code": "s", "name": "S", "policy": {"unassigned": "none", **policy}, "labels": [label("a"), label("b")]}


def test_skills_are_read_strictly():
    good = judged.read_skill(skill())
    assert judged.read_skill(good.declared()) == good and len(good.confirmation()) == 12
    same = skill()
    same["labels"][1]["name"] = "A"
    reserved = skill()
    reserved["labels"][0]["code"] = "unassigned"
    for bad in ([], {**skill(), "more": 1}, skill(selection="some"), skill(max_labels=1), skill(max_labels=True), skill(unassigned="A"), {**skill(), "code": "A"}, {**skill(), "labels": []}, same, reserved):
        with pytest.raises(ValueError):
            judged.read_skill(bad)


def test_answers_on_odd_texts(spark):
    s = judged.read_skill(skill())
    rows = spark.createDataFrame([(None,), ("",), ("[1]",), ("null",), ('{"labels": null}',), ('{"labels": ["B", "A", "B"]}',), ('{"labels": [null]}',)], "x string")
    got = [(r.y.failure, r.y.codes) for r in rows.select(judged.label_answer(F.col("x"), s).alias("y")).collect()]
    shape = ("response_shape", None)
    assert got == [shape, shape, shape, shape, ("labels_not_list", None), (None, ["a", "b"]), ("element_not_text", None)]
    words = F.array(F.lit("한 국"), F.lit(None), F.lit("b"))
    rows = spark.createDataFrame([(None,), ('{"판정": {"한국": {"entity": "한국", "type": "t"}, "b": {"entity": 1, "type": "t"}}}',), ('{"판정": null}',)], "x string")
    got = [(r.y.failure, r.y.entities and [tuple(e) for e in r.y.entities]) for r in rows.select(judged.entity_answer(words, F.col("x"), ["t"]).alias("y")).collect()]
    assert got == [("response_shape", None), (None, [("한 국", "한국", "t")]), ("judgement_not_mapping", None)]
    assert spark.range(1).select(judged.description_answer(F.lit(None).cast("array<struct<modality:string,summary:string>>"), F.lit(None).cast("string")).alias("y")).first().y.failure == "no_members"


def test_prompts(spark):
    s = judged.read_skill(skill(selection="single"))
    text = spark.range(1).select(judged.label_prompt(s, F.lit("x" * 300), F.array(F.lit(" k "))).alias("p")).first().p
    assert "x" * 250 in text and "x" * 251 not in text and '["k"]' in text
    assert judged.prompt_version("1", {"a": "b"}) != judged.prompt_version("1", {"a": "c"})


def test_index_reads_only_its_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b"), (2, "A"), (3, None), (4, "c")], "id int, text string")
    path = str(tmp_path / "index")
    postings.build(docs, "id", {"text": F.col("text")}, path, buckets=4, spread=2)
    hits = postings.search(spark, path, "id", ["a"], {"text": 1.0})
    plan = hits._jdf.queryExecution().toString()
    assert {r.id for r in hits.collect()} == {1, 2}
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(" in plan or "EqualTo(term,a)" in plan
    assert [r.id for r in postings.search(spark, path, "id", ["a", "b"], {"text": 1.0}, every=True).collect()] == [1]
    assert postings.search(spark, path, "id", ["z"], {"text": 1.0}).isEmpty()
    assert postings.search(spark, path, "id", [], {"text": 1.0}).isEmpty()


def test_names_and_ids(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.meaningful(F.lit("IMG_1234"))) is None and one(names.meaningful(F.lit(" IMG_홍길동 "))) == "IMG_홍길동"
    assert one(names.topic_of_file(F.lit("manifest.json"))) == "manifest" and one(names.topic_of_file(F.lit(""))) == ""
    assert one(names.topic_of_file(F.lit("wikipedia_고려청자_x.txt"))) == "고려청자"
    assert one(names.candidates(F.lit(None).cast("string"))) == []
    assert one(names.inserted(F.lit("ab:c"), ":", F.lit("X"))) == "abX:c" and one(names.inserted(F.lit("ab"), ":", F.lit("X"))) == "abX"
    ids = [r.x for r in spark.range(3).select(names.timed_id(F.col("id") + 1_700_000_000_000).alias("x")).collect()]
    assert ids == sorted(ids) and len(set(ids)) == 3
    assert one(F.lit(ids[0]).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))


def test_reports_on_nothing(spark):
    pairs = spark.createDataFrame([], "source int, target int")
    assert tuple(reports.gate_stats(pairs, pairs).first()) == (0, 0, 0, 0)
    assert tuple(reports.unclassified(spark.createDataFrame([], "topic string, subtopic string")).first()) == (0, 0, 0.0, True)
    gold = spark.createDataFrame([("k1", "k2", "x"), ("k1", "k9", "x")], "a string, b string, kind string")
    keys = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "key string, asset_id int")
    proposed = spark.createDataFrame([(2, 1, "x", 0.9)], "source int, target int, kind string, confidence double")
    sweep, unknown = reports.quality_report(proposed, gold, spark.createDataFrame([("k3",)], "key string"), keys, [0.5])
    assert sweep.first().recall == 1.0 and [r.key for r in unknown.collect()] == ["k9"]
