from pyspark.sql import functions as F

from loomcat.functions import names


def each(spark, make, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_labels(spark):
    assert each(spark, names.topic, [" 여행 사진 모음 ", "a\tb", None, "x" * 300]) == ["여행", "a\tb", "", "x" * 200]
    assert each(spark, names.topic_en, ["Machine  Learning", "A b c", " "]) == ["machine learning", "a", ""]
    assert each(spark, names.subtopic, [" ., 산행, 기록 。", "?!", "a b"]) == ["산행,", "", "a"]
    assert each(spark, names.subtopic_en, ["·Deep Dive·"]) == ["deep"]


def test_keywords(spark):
    df = spark.createDataFrame([([" A", "a", "영상", "", "Straße"], ["STRASSE", "b", "c"])], "k array<string>, o array<string>")
    assert df.select(names.keywords(F.col("k")).alias("x")).first().x == ["A", "Straße"]
    assert df.select(names.keywords(F.col("k"), F.col("o"), limit=3).alias("x")).first().x == ["A", "Straße", "b"]
    assert df.select(names.keywords(F.lit(None).cast("array<string>")).alias("x")).first().x == []


def test_cleaned_names(spark):
    given = ["HAi1OZD1OMM_Maintenance guide.v2.pdf", "blacksmith_QWXZBKLMN.mp4", "강의_abcdef12 .x", "SAMSUNG galaxy", None, "Qi2_take1.mov", "abcd-efgh", "aero-nautic"]
    assert each(spark, names.cleaned_name, given) == ["Maintenance guide.v2", "blacksmith", "강의", "SAMSUNG galaxy", "", "Qi2 take1", "", "aero-nautic"]
    assert each(spark, lambda c: names.cleaned_name(c, ["^take"]), ["Qi2_take1.mov"]) == ["Qi2"]
