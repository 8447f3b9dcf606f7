import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from loomcat.functions import filters
from loomcat.operators import work
from loomcat.sources import files, tables
from loomcat.streaming import index


def brute_chunks(segments, size):
    out, held = [], []
    for s in filter(None, (x.strip() for x in segments)):
        if len(s) > size:
            if held:
                out.append("\n".join(held))
            out, held = out + [s[i : i + size] for i in range(0, len(s), size)], []
        elif held and len("\n".join([*held, s])) <= size:
            held.append(s)
        else:
            if held:
                out.append("\n".join(held))
            held = [s]
    return out + (["\n".join(held)] if held else [])


def test_packed_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, ["".join(r.choice("ab 　é") for _ in range(r.randrange(25))) for _ in range(r.randrange(9))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    found = {x.id: x.c for x in df.select("id", files.packed(F.col("s"), 10).alias("c")).collect()}
    assert found == {i: brute_chunks(s, 10) for i, s in rows}


def test_chunks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(files.chunks(F.lit(" abcdefghij "), 4, overlap=2)) == ["abcd", "cd\nefgh", "gh\nij"]
    assert one(files.chunks(F.lit("abcdef"), 4, most=3)) == ["abc"]
    assert one(files.chunks(F.lit(" \n"), 4)) == one(files.chunks(F.lit(None).cast("string"), 4)) == []
    with pytest.raises(ValueError):
        files.chunks(F.lit("a"), 4, overlap=4)


def test_kinds(spark, tmp_path):
    samples = {
        "a.pdf": (b"%PDF-1.7\n%\xe2", "pdf"), "a.png": (b"\x89PNG\r\n\x1a\n", "image"), "a.wav": (b"RIFF\x00\x00\x00\x00WAVEfmt ", "audio"), "a.mp4": (b"\x00\x00\x00\x18ftypmp42", "video"),
        "a.docx": (b"PK\x03\x04" + b"\x00" * 30 + b"word/document.xml", "word"), "a.json": (b'{"a": 1}\n', "json"), "a.txt": (b"words\n", "text"), "a.bin": (b"\x00\x01\x02", "unknown"),
    }
    (tmp_path / "sub").mkdir()
    for name, (data, _) in samples.items():
        (tmp_path / "sub" / name).write_bytes(data)
    rows = files.listed(spark, str(tmp_path)).withColumn("kind", files.kind(F.col("content")))
    rows = files.hashed(rows.withColumn("modality", files.modality(F.col("kind")))).collect()
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in rows} == {k: v for k, (_, v) in samples.items()}
    assert {r.modality for r in rows if r.kind in ("pdf", "word", "json", "text")} == {"text"}
    assert files.listed(spark, str(tmp_path), recursive=False).count() == 0


def test_filter_parameters():
    parse = filters.parse_filters
    assert parse() is None and parse(topic=" ", file_ext=[""]) is None
    assert parse(file_ext=[".JPG", "jpg", "Pdf"]).values == {"file_ext": ["jpg", "pdf"]}
    assert parse(file_size_ranges=[(5, 9), (None, 3), (5, 9)]).values == {"file_size_ranges": [(-float("inf"), 3), (5, 9)]}
    assert parse(created_to="2024-02-04T23:30:00-05:00", created_from="2024-02-03T00:30:00+09:00").bounds() == ("2024-02-03", "2024-02-04")
    assert parse(created_from="2024-02-03", created_to="2024-02-04T23:30:00Z").bounds() == (date(2024, 2, 3).isoformat(), "2024-02-04")
    for bad in ([(None, None)], [(3, 3)], [(True, 4)], [(-1, 4)], [5], [(1, 2, 3)], [(1, 2**63)]):
        with pytest.raises(ValueError):
            parse(file_size_ranges=bad)
    with pytest.raises(ValueError):
        parse(created_from="soon")


def test_conditions(spark):
    df = spark.createDataFrame([(1, ["A b", "x"], None), (2, None, 0.5), (3, ["ab"], float("nan"))], "id long, tags array<string>, c double")
    keep = filters.parse_filters(tag=["a B"]).condition({"tags": F.col("tags")})
    assert [r.id for r in df.where(keep).orderBy("id").collect()] == [1, 3]
    assert [r.x for r in df.orderBy("id").select(filters.clamped(F.col("c")).alias("x")).collect()] == [0.0, 0.5, 0.0]
    assert df.where(filters.narrowed("  ", [F.col("c")])).count() == 3
    seen = filters.visible(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), {"a": "authorized"}, F.lit("general"), "public")
    assert spark.range(1).select(seen.alias("x")).first().x == {"b": "2"}


def test_stems(spark):
    paths = ["d/Report_V1.pdf", "report_summary_copy.txt", ".hidden", "/a", "x/강의_2부.mp4"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select(work.folder(F.col("p")).alias("d"), work.raw_stem(F.col("p")).alias("s"), F.regexp_replace(work.raw_stem(F.col("p")), work.SUFFIX, "").alias("n")).collect()
    assert [tuple(r) for r in rows] == [("d", "report_v1", "report"), ("", "report_summary_copy", "report_summary"), ("", ".hidden", ".hidden"), ("/", "a", "a"), ("x", "강의_2부", "강의")]


def test_versions_and_stream(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    source = tmp_path / "in"
    for part in ([(1, "a", 1), (2, "b", 1), (1, "c", 2)], [(2, "d", 3), (3, "e", 1)]):
        spark.createDataFrame(part, "id long, v string, n long").coalesce(1).write.mode("append").parquet(str(source))
        changes = spark.readStream.schema("id long, v string, n long").parquet(str(source))
        index.maintain(changes, table, ["id"], "n", str(tmp_path / "cp")).awaitTermination(60)
    assert {r.id: r.v for r in table.read().collect()} == {1: "c", 2: "d", 3: "e"}
    (tmp_path / "t" / "version=9").mkdir()  # an unfinished write doesn't count
    assert table.read().count() == 3
    new = spark.createDataFrame([(1, "z", 0), (7, "y", 0)], "id long, v string, n long")
    assert sorted((r.id, r.v, r.n) for r in tables.patched(table.read(), new, ["id"], ["v"]).collect()) == [(1, "z", 2), (2, "d", 3), (3, "e", 1)]


def test_stored_reports(spark, tmp_path):
    snap = {"config": {"k": "1"}, "sources": {"s": {"candidates": [{"id": "a"}, {"id": "b", "score": 0.5}], "proposed": [{"target": "a", "kind": "references", "confidence": 0.9}]}}}
    (tmp_path / "s.json").write_text(json.dumps(snap))
    found, proposed = tables.read_snapshot(spark, str(tmp_path / "s.json"))
    assert sorted((r.id, r.score) for r in found.collect()) == [("a", 0.0), ("b", 0.5)]
    assert proposed.first().confidence == 0.9
    (tmp_path / "g.json").write_text(json.dumps({"version": 1, "key_type": "path", "pairs": [{"a": "x", "b": "y", "kind": "references"}], "isolated": ["z"]}))
    pairs, alone = tables.read_golden(spark, str(tmp_path / "g.json"))
    assert pairs.count() == alone.count() == 1
    (tmp_path / "g.json").write_text(json.dumps({"version": 1, "pairs": [{"a": "x", "b": "x"}]}))
    with pytest.raises(ValueError):
        tables.read_golden(spark, str(tmp_path / "g.json"))
    tables.record(spark, str(tmp_path / "l"), alone.select(F.lit("q").alias("asset_id")), activity="a", agent="b")
