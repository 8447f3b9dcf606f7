"""The covariance estimates against a NumPy version, and odd rows."""

import random
from collections import defaultdict

import numpy as np

from loomcat.llm import quality as Q

COLUMNS = "doc_id long, text string, lang string, source string, kept boolean, n long, e string, x0 double, _salt int"


def table(spark, rows):
    return spark.createDataFrame([(*r, False, 1, "e", 0.5, 3) for r in rows], COLUMNS).repartition(4)


def roots(groups):
    """m and l of {(lang, source): (n, mean, covariance)}, drawn to the languages."""
    out, by = {}, defaultdict(list)
    for (lang, _), v in groups.items():
        by[lang].append(v)
    for (lang, source), (n, m, c) in groups.items():
        total = sum(v[0] for v in by[lang])
        wm = sum(v[0] * v[1] for v in by[lang]) / total
        wc = sum(v[0] * (v[2] + np.outer(v[1], v[1])) for v in by[lang]) / total - np.outer(wm, wm)
        own = n / (n + Q.PRIOR)
        cov = Q.CONSISTENCY * (own * c + (1 - own) * wc) + np.diag(np.square(Q.FLOOR))
        root = np.zeros((4, 4))
        for j in range(4):
            root[j, j] = np.sqrt(max(cov[j, j] - (root[j, :j] ** 2).sum(), Q.FLOOR[j] ** 2))
            for i in range(j + 1, 4):
                root[i, j] = (cov[i, j] - root[i, :j] @ root[j, :j]) / root[j, j]
        out[lang, source] = own * m + (1 - own) * wm, root
    return out


def squared(x, estimate):
    z = np.linalg.solve(estimate[1], (x - estimate[0]).T)
    return (z**2).sum(0)


def robust(groups):
    """Estimates of {key: rows} by concentration from three starts, and the chosen start."""
    moments = lambda x: (len(x), x.mean(0), np.cov(x.T, bias=True))
    rank = lambda x, q: np.sort(x, axis=0)[max(int(np.ceil(q * len(x))) - 1, 0)]
    starts = [
        {k: (rank(x, 0.5), np.diag(Q.FLOOR)) for k, x in groups.items()},
        {k: (rank(x, 0.5), np.diag(np.maximum((rank(x, 0.75) - rank(x, 0.25)) / 1.349, Q.FLOOR))) for k, x in groups.items()},
        roots({k: moments(x) for k, x in groups.items()}),
    ]
    size = lambda e: np.log(np.diag(e[1])).sum()
    was = None
    for _ in range(Q.STEPS):
        for s, now in enumerate(starts):
            half = {}
            for k, x in groups.items():
                b = np.floor(np.log2(1 + squared(x, now[k])) * Q.FINE)
                half[k] = moments(x[b <= np.sort(b)[int(np.ceil(Q.SUPPORT * len(b))) - 1]])
            starts[s] = roots(half)
        now = np.array([[size(s[k]) for k in sorted(groups)] for s in starts])
        if was is not None and np.abs(now - was).max() < Q.SETTLED:
            break
        was = now
    return {k: starts[min(range(3), key=lambda s: (round(size(starts[s][k]), 6), s))][k] for k in groups}


def test_kept_is_that_of_the_least_determinant(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(900):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None])
        junk = rng.random() < (0.4 if source == "b" else 0.1)
        words = [word(rng.choice([9, 14]) if junk else rng.choice([3, 4, 5])) + rng.choice(["", "", " |", " #"] if junk else [""] * 30 + [" %"]) for _ in range(rng.randint(60, 200))]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        rows.append((i, "\n".join(lines + lines[: rng.choice([0, 0, 1, 4 if junk else 0])]), lang, source))
    found = Q.judge(table(spark, rows))
    spark_rows = {r.doc_id: r for r in found.collect()}
    vectors = Q.statistics(table(spark, rows)).select("doc_id", "lang", "source", "base_failed", *[x.alias(f"v{i}") for i, x in enumerate(Q.vector())]).collect()
    groups = defaultdict(list)
    for r in sorted(vectors):
        if not r.base_failed:
            groups[r.lang or "", r.source or ""].append((r.doc_id, [r.v0, r.v1, r.v2, r.v3]))
    best = robust({k: np.array([x for _, x in v]) for k, v in groups.items()})
    rejected = 0
    for k, v in groups.items():
        d = squared(np.array([x for _, x in v]), best[k])
        for (i, _), want in zip(v, d, strict=True):
            assert abs(spark_rows[i].distance - want) < 1e-6 * (1 + want)
            assert spark_rows[i].kept == (want <= Q.BOUND)
            rejected += want > Q.BOUND
    assert 20 < rejected < 300 and len(groups) == 9


def test_ties_and_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a")] * 40 + [(None, text, None, None)] * 3 + [(2, None, "en", "a"), (3, "", None, "b"), (4, " ".join(f"w{i}" for i in range(200_000)), "de", "c")]
    found = Q.judge(table(spark, rows)).collect()
    assert len(found) == len(rows)
    assert all(r.kept for r in found if r.n_words) and not any(r.kept for r in found if not r.n_words)
    assert Q.judge(table(spark, rows).limit(0)).count() == 0
    assert Q.judge(table(spark, [(1, "short", "en", "a")])).collect()[0].kept is False
