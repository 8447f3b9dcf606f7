import pytest
from pyspark.sql import functions as F

from loomcat.functions import scalars as C
from loomcat.operators import evaluation, merge, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_key(spark):
    assert one(spark, C.text_key(F.lit(" Ｆoo Ba\tR "))) == "foobar"
    assert one(spark, C.text_key(F.lit("A b"))) == "ab"
    assert one(spark, C.text_key(F.lit(None).cast("string"))) is None


def test_names(spark):
    assert one(spark, C.basename(F.lit("s3://x/y/a.txt?v=1#z"))) == "a.txt"
    assert one(spark, C.display_name(F.lit("/a/01234567-89ab-cdef-0123-456789abcdef__b.pdf"))) == "b.pdf"
    assert one(spark, C.file_ext(F.lit("/a/b."))) is None
    assert one(spark, C.file_ext(F.lit("/a.d/b.PDF"))) == "pdf"


def test_numbers(spark):
    assert one(spark, C.safe_float(F.lit("nan"))) == 0.0
    assert one(spark, C.safe_float(F.lit("x"), 2.0)) == 2.0
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, C.distinct_in_order(F.array(F.lit("b"), F.lit(" a "), F.lit(""), F.lit("b")))) == ["b", "a"]
    stamp = one(spark, C.parsed_reason(C.member_reason(F.lit("a|b"), F.lit("p"), F.lit(3))))
    assert (stamp.keyword, stamp.prompt_version, stamp.rule_version) == ("a|b", "p", 3)


def test_cursor():
    cursor = search.encode_cursor([3, "a"], "size", {"q": "x"})
    assert search.decode_cursor(cursor, "size", {"q": "x"}, 2) == [3, "a"]
    for bad in (("name", {"q": "x"}, 2), ("size", {"q": "y"}, 2), ("size", {"q": "x"}, 1)):
        with pytest.raises(ValueError):
            search.decode_cursor(cursor, *bad)
    with pytest.raises(ValueError):
        search.decode_cursor("?", "size", {}, 1)


def test_pages_are_complete(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(20)], "a long, b long")
    order, seen, mark = [("a", False), ("b", True)], [], None
    while rows := search.page(df, order, 7, mark).collect():
        seen += [(r.a, r.b) for r in rows]
        mark = [rows[-1].a, rows[-1].b]
    assert seen == sorted(((i % 3, i) for i in range(20)), key=lambda r: (-r[0], r[1]))


def test_stratified_and_resolved(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(10)], "cell long, id long")
    picked = evaluation.stratified(df, "cell", "id", 2, 7)
    assert picked.count() == 4
    state = spark.createDataFrame([(2, True, 0), (0, False, 0), (None, False, 3)], "attempts int, error boolean, edges int")
    assert [r.status for r in merge.resolved(state).collect()] == ["failed", "isolated", "resolved"]
