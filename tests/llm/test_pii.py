"""Personal data from end to end: what the classifier adds and refuses, and what redaction leaves."""

import random

import pytest

from loomcat.llm import pii as P

COLUMNS = "doc_id long, text string, spans string, base int, row string, _all long, kind int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, "r", 2, 3) for i, t in enumerate(texts)], COLUMNS).repartition(2)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    out = [f"mail me at user{i}@site{i}.org or call my phone +49 30 {digits(7)} today" for i in range(60)]
    out += [f"please call my phone ({digits(3)}) {digits(3)}-{digits(4)} or the fax" for _ in range(40)]
    out += [f"the account login has password: Ab{digits(6)}x" for _ in range(40)]
    out += [f"see order version chapter {digits(3)}.{digits(3)}.{digits(4)} of the invoice" for _ in range(10)]
    return [*out, None, "", "no data here", "x" * 100_000, "secret: " + "aB3" * 100]


def test_the_classifier_adds_and_refuses_spans(spark, texts):
    rows = {r.doc_id: r for r in P.detect(table(spark, texts)).collect()}
    kinds = lambda r: [P.ALL[s.kind] for s in r.spans]
    assert all(kinds(rows[i]) == ["email", "phone"] for i in range(60))
    assert all(kinds(rows[i]) == ["call"] and not rows[i].base for i in range(60, 100))
    assert all(kinds(rows[i]) == ["secret"] for i in range(100, 140))
    assert all(not kinds(rows[i]) for i in range(140, 154))
    # what is refused was a candidate
    assert all(r.spans for r in P.candidates(table(spark, texts)).where("doc_id between 140 and 149").collect())


def test_redaction_keeps_everything_else(spark, texts):
    docs = table(spark, texts)
    out = {r.doc_id: r for r in P.redact(docs).collect()}
    assert P.redact(docs).columns == docs.columns and len(out) == len(texts)
    assert out[0].text == "mail me at [EMAIL] or call my phone [PHONE] today"
    assert out[154].text == "secret: [SECRET]" or out[154].text == "[SECRET]"
    assert (out[150].text, out[151].text, out[152].text, out[153].text) == (None, "", texts[152], texts[153])
    assert {(r.spans, r.base, r.row, r._all, r.kind) for r in out.values()} == {("s", 1, "r", 2, 3)}
    assert P.redact(docs.limit(0)).count() == 0
