"""Host reputation against a plain version with the beta distribution integrated numerically."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcat.llm import url_filter as U

PAGES, LABELS = "page_id long, url string, html string, host string, path string, bad int", "doc_id long, quality int, toxic int, host string"


def above(a, b, limit=U.LIMIT):
    x = (np.arange(400_000) + 0.5) / 400_000
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    p = np.exp(log - log.max())
    return p[x > limit].sum() / p.sum()


def names(host):
    bare = re.sub(r"\.+$", "", re.sub(r":\d*$", "", host.rsplit("@", 1)[-1]))
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", bare) or re.fullmatch(r"\[.*\]", bare):
        return "", "#", bare
    parts = bare.split(".")
    n = 2 if len(parts) > 1 and len(parts[-1]) == 2 and parts[-2] in U.GENERAL else 1
    return "", ".".join(parts[-n:]), ".".join(parts[-n - 1 :])


def posteriors(outcomes):
    """host: (a, b), by moments from the top down."""
    level = {("", *names(h)[1:], h): (n, bad) for h, (n, bad) in outcomes.items()}
    tables = [level]
    for depth in (3, 2, 1):
        up = defaultdict(list)
        for key, (n, bad, *_) in tables[0].items():
            up[key[:depth]].append((n, bad))
        tables.insert(0, {k: (sum(n for n, _ in v), sum(b for _, b in v), v) for k, v in up.items()})
    priors = {(): (U.TOP_RATE * U.TOP_STRENGTH, (1 - U.TOP_RATE) * U.TOP_STRENGTH)}
    for table in tables[:3]:
        new = {}
        for key, (n, bad, below) in table.items():
            a, b = priors[key[:-1]]
            rate = (a + bad) / (a + b + n)
            chance = rate * (1 - rate)
            k = sum(m > 0 for m, _ in below)
            spread = sum(x * x / max(m, 1) for m, x in below) - 2 * rate * bad + rate * rate * n - k * chance
            between = spread / max(n - sum(m * m for m, _ in below) / max(n, 1), 1e-9)
            strength = U.STRENGTH[1] if k < 2 or between <= 0 else min(max(chance / between - 1, U.STRENGTH[0]), U.STRENGTH[1])
            new[key] = (rate * strength, (1 - rate) * strength)
        priors = new
    return {k[3]: (priors[k[:3]][0] + bad, priors[k[:3]][1] + n - bad) for k, (n, bad) in level.items()}


def test_reputation(spark):
    rng = random.Random(4)
    hosts = [f"{s}.{d}.{t}" for t in ("com", "co.uk", "uk", "net") for d in ("alpha", "beta") for s in ("www", "a", "b")]
    hosts += ["10.0.0.1", "10.0.0.1:8080", "[::1]:80", "u:p@www.alpha.com:443", "single", "co.uk", "alpha.com.", "..", "x..uk", ""]
    bad_share = {h: rng.choice([0.0, 0.02, 0.3, 0.6, 0.95]) for h in hosts}
    pages, labels, outcomes = [], [], {h: [0, 0] for h in hosts}
    for i in range(4000):
        h = rng.choice(hosts)
        pages.append((i, f"http://{h}/p" if h else None, "x", "y", "z", 1))
        if rng.random() < 0.4:
            bad = rng.random() < bad_share[h]
            labels += [(i, 1 - int(bad), 0, "q")] * rng.choice([1, 2])
            outcomes[h][0] += 1
            outcomes[h][1] += bad
    pages += [(None, "http://www.alpha.com/", None, None, None, None)] * 2
    labels += [(None, 0, 1, "q"), (1, None, None, "q")]
    ours = U.judge(spark.createDataFrame(pages, PAGES).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert len(ours) == len(pages)
    known = {h: above(*ab) for h, ab in posteriors(outcomes).items()}
    assert min(abs(x - U.CERTAINTY) for x in known.values()) > 1e-4
    got = {r.host: r.verdict for r in ours if r.rule is None}
    assert got == {h: "block" if known[h] >= U.CERTAINTY else "allow" for h in got}
    assert {"block", "allow"} == set(got.values()) and len(got) > 15
    empty = U.judge(spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS))
    assert empty.count() == 0


@pytest.mark.parametrize(("a", "b"), [(1.0, 0.5), (30.0, 20.0), (3.3, 2.1), (260.0, 230.0), (6000.0, 5800.0), (12000.0, 11800.0), (0.5, 0.5)])
def test_certainty(spark, a, b):
    got = spark.range(1).select(U.certainty(F.lit(a), F.lit(b))).first()[0]
    want = above(a, b)
    assert got == pytest.approx(want, abs=2e-3)
