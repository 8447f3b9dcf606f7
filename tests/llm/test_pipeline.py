"""Every stage and the whole pipeline on odd rows."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from loomcat.llm import _shared as S

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, target string, whole long, below int, source_size double, spans string, `a.b` string, kept boolean, row string, label int, tags map<string,int>"
NAMES = [name for name, _ in P.STAGES]


def rows():
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 10**5)}"
    texts = [" ".join(word() for _ in range(rng.choice([60, 90, 200]))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1].upper(), " ".join([*texts[2].split()[:-1], "end"])]
    texts += [None, None, "", "  \n", "few words", " ".join(word() for _ in range(30_000)), "x" * 50_000, texts[3] + " mail a.b@c.org"]
    ids = [*range(len(texts) - 2), 7, None]
    return [(i, t, ("en", None)[k % 2], ("a", "b", None)[k % 3], 1, "t", 2, 3, 4.0, "s", "dot", False, "r", k, {"k": k}) for k, (i, t) in enumerate(zip(ids, texts, strict=True))] * 1 + [(None, None, None, None, None, *[None] * 10)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, docs, k):
    name, stage = P.STAGES[k]
    out = stage(spark, docs, "")
    found = out.collect()
    if k < 4:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {r.label for r in found} <= {r[13] for r in rows()}
        assert all(r["a.b"] in ("dot", None) and r.target in ("t", None) for r in found)
    else:
        assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(r[0] for r in rows())
    kept = Counter(r.label for r in found) if k < 4 else None
    if name == "quality rules":
        assert kept[0] == 1 and not any(kept[k] for k in (64, 65, 66, 67, 68))
    if name == "near duplicates":
        assert sum(kept[k] for k in (0, 60, 61)) == 1 and kept[1] + kept[62] == 1 and kept[2] + kept[63] == 1
        assert sum(kept.values()) >= 60
    if name == "personal data":
        assert sum(kept.values()) == len(rows()) and not any("@" in (r.text or "") for r in found)
        assert all(r.n_chars == len(r.text or "") for r in found)
    if name == "source mix":
        words = lambda t: len((t or "").split())
        assert sum(words(r.text) for r in found) == pytest.approx(1.5 * sum(words(r[1]) for r in rows()), rel=0.5)
        assert max(kept[k] for k in kept if k is not None) <= 2
    none = stage(spark, docs.limit(0), "")
    assert none.columns == out.columns and none.count() == 0


def test_run_keeps_one_folder(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = S.mark()
    out = P.run(spark, str(tmp_path))
    assert S.mark() == before + 1
    at = Counter()
    for r in sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert at and max(at.values()) <= 2048


def test_stored_tables_leave_no_freed_memory_in_the_driver(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        with open(f"/proc/{pid}/status") as f:
            return next(int(x.split()[1]) / 1024 for x in f if x.startswith("VmRSS"))

    S.stored(spark.range(10), "warm")
    held = [jvm.java.util.zip.Deflater() for _ in range(1600)]  # outside the heap
    for i, x in enumerate(held):
        if i % 50:
            x.end()
    before = resident()
    S.stored(spark.range(10), "after")
    after = resident()
    for x in held[::50]:
        x.end()
    assert before - after > 50
