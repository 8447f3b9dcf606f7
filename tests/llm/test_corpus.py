"""The corpus operators against brute force, on rows with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomcat.llm import chat_format, mixing, packing, pii, quality, simhash, suffix_dedup, token_files, topk, url_filter
from loomcat.llm import _shared as S
from loomcat.llm.tokens import BYTE_BPE, WORD_BPE, encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, n long, row string"


def texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "δ", "it's", "x@y.org", "10.1.2.3", "+1 (415) 555-2671", "4111 1111 1111 1111", "\n", "###", "12"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    passage = "".join(rng.choice("abcdefg \n") for _ in range(400))
    out += [f"left{i} {passage[i:]} right{i}" for i in range(0, 60, 7)]
    return [*out, None, "", "   ", out[3], out[3], "a" * 3000, "word " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "c")[i % 4], 1, "p", "k", 2, "r") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain():
    return {i: t or "" for i, t in enumerate(texts())}


def ids_of(name, text):
    return encoder(name).tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, empty):
    found = packing.pack(packing.cut(docs)).collect()
    ends = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
        ids = [*ids_of(WORD_BPE, plain()[r.doc_id]), 0][r.start : r.start + 2048]
        assert (r.length, r.ids_crc32, r.start) == (len(ids), crc(ids), 2048 * r.piece)
    assert max(ends.values()) <= 2048
    assert packing.pack(packing.cut(empty)).count() == 0


def test_plan_fills_every_sequence():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 2048) for _ in range(20000))
    segments = packing.plan(dict(counts))
    used, places = Counter(), Counter()
    for length, first, n, sequence, _ in segments:
        assert first == used[length]
        used[length] += n
        for i in range(n):
            places[sequence + i] += length
    assert used == counts and max(places.values()) <= 2048
    least = max(sum(k * v for k, v in counts.items()) / 2048, sum(v for k, v in counts.items() if k > 1024))
    assert len(places) <= 1.02 * least


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes = {i: len(WORD.findall(t)) for i, t in plain().items()}
    assert all(r.size == sizes[r.doc_id] and r.taken <= 2 * r.size for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(rows) == sorted(mixing.mix(docs).collect())
    assert mixing.repeated(docs).count() == sum(r.repeats for r in rows)
    assert mixing.mix(empty).count() == 0


def test_water_fill():
    target = mixing.water_fill([10, 100, 1000], [3, 1, 2], mixing.Fraction(1665))
    assert [float(t) for t in target] == [20, 200, 1445]


def test_suffix_dedup(docs, empty, monkeypatch):
    seen = Counter(t.encode()[k : k + 200] for t in plain().values() for k in range(len(t.encode()) - 199))
    for hot, most, batch in ((suffix_dedup.HOT, suffix_dedup.MOST, suffix_dedup.BATCH), (2, 4000, 500), (2, 2, 3), (4000, 3, 1)):
        for name, value in (("HOT", hot), ("MOST", most), ("BATCH", batch)):
            monkeypatch.setattr(suffix_dedup, name, value)
        for r in suffix_dedup.remove(docs).collect():
            data = plain()[r.doc_id].encode()
            cover = np.zeros(len(data), bool)
            for k in range(len(data) - 199):
                if seen[data[k : k + 200]] > 1:
                    cover[k : k + 200] = True
            assert bytes(r.kept) == bytes(np.frombuffer(data, np.uint8)[~cover])
            assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), cover.sum(), (np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
    assert suffix_dedup.remove(empty).count() == 0


def test_suffix_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 20))) for _ in range(40)]
    string, length = suffix_dedup.suffix_order(strings)
    got = [strings[i][len(strings[i]) - n :] for i, n in zip(string, length, strict=True)]
    assert got == sorted(got) and len(got) == sum(map(len, strings)) + 40


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            double = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits[::-1]))
            ok = {"email": True, "ip": all(int(p) < 256 for p in m.group().split(".") if kind == "ip"), "card": 12 <= len(digits) <= 19 and double % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def test_personal_data(docs, empty):
    for r in pii.detect(docs).collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(plain()[r.doc_id])
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert not any(re.search(BASE[0][1], t or "") for t in redacted.values())
    assert pii.detect(empty).count() == 0


def test_labelers_that_agree_are_trusted():
    post, good = pii.reliabilities([(0, (1, 1, -1), 90), (0, (0, 0, -1), 10), (0, (1, 0, -1), 3)])
    assert post[0, (1, 1, -1)] > 0.9 > 0.1 > post[0, (0, 0, -1)]
    assert all(a > 0.5 for a, _ in good)


def test_chat(spark):
    rows = [(1, 0, "system", "be <s> kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<&s>[&/BOT]"), (1, 3, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, None, "tool", "x\ny")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn{i} " * 200) for i in range(9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_format.windows(table)
    for r in chat_format.read_back(formatted).collect():
        own = sorted([(t if t is not None else -1, role or "", x or "") for c, t, role, x in rows if c == r.conv_id])
        said = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert all(len(r.windows) > 1 for r in formatted.where("conv_id = 4").collect())
    assert chat_format.windows(table.limit(0)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(0, 0.2, (700, 9))
    data[5:9] = data[4]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, None), (1000, [float("nan")] * 9), (1100, [None] * 9)]
    q = S.stored(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "t")
    ints = np.floor(1024 * data).astype(np.int64)
    found = topk.search(topk.build_index(q, 200), q.where("vec_id % 100 = 0"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    for i in range(0, 700, 100):
        scores = ints @ ints[i]
        order = [j for j in np.lexsort((np.arange(700), -scores)) if j != i][:10]
        assert [got[i, k + 1] for k in range(10)] == [(j, scores[j]) for j in order]
    assert len(got) == 70


def test_token_files(spark, docs, empty):
    path = token_files.write_token_files(docs, S.work_folder(spark, "t"))
    at = 0
    for r in sorted(token_files.read_token_files(spark, path).collect()):
        assert list(r.ids) == [*ids_of(BYTE_BPE, plain()[r.doc_id]), 2] and (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert [r.doc_id for r in token_files.read_token_files(spark, path, [3]).collect()] == [3]
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, S.work_folder(spark, "t"))).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.com/en/x?q", "https://www.example.com/en/", "ftp://x.net/fr/1#a", "no host", None, "http://x.com", "http://x.net/esp", "http://bad.org/1"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/1", "h") for i in range(60)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(60)] + [(0, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2] == ("x.net", "/fr/1", "net/fr/", "block")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None)
    assert got[5] == ("x.com", "", None, "allow") and got[6][2] is None
    assert got[7][3] == "block"


def test_quality(docs, empty):
    for r in quality.judge(docs).collect():
        text = plain()[r.doc_id]
        words = WORD.findall(text)
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(three)
        twice = {k for i, w in enumerate(three) if often[w] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(words) < 50 or 100 * len(twice) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_simhash(docs, empty):
    found = simhash.groups(simhash.fingerprints(docs)).collect()
    prints = {}
    for i, t in plain().items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            group[i] = min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
    assert {r.doc_id: (r.fp & simhash.MASK, r.component_id) for r in found} == {i: (prints[i], group[i]) for i in prints}
    assert simhash.groups(simhash.fingerprints(empty)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    near = [[*base[:k], "changed", *base[k + 1 :]] for k in range(20, 280, 13)]
    far = [[f"v{rng.randint(0, 10**6)}" for _ in range(300)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, *near, *far, far[0]])] + [(None, "no id"), (None, "no id")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, 0), *[(False, 1 + len(near) + i) for i in range(20)], (True, 0), (True, 0)])


def jaccard(x, y):
    one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("n", [12, 60])
def test_near_duplicates_in_a_template(spark, n):
    rng = random.Random(n)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    template = [word() for _ in range(260)]
    texts = []
    for _ in range(n):
        own = [word() for _ in range(65)]
        copy = [word() if i in (9, 20, 31, 42) else w for i, w in enumerate(own)]
        texts += [[*template, *own], [*template, *copy]]
    rng.shuffle(texts)
    label = list(range(len(texts)))
    pairs = [(i, j, jaccard(texts[i], texts[j])) for i in range(len(texts)) for j in range(i)]
    assert {0.8 <= s for *_, s in pairs} == {True, False} and min(s for *_, s in pairs) > 0.6
    for _ in texts:
        for i, j, s in pairs:
            if s >= 0.8:
                label[i] = label[j] = min(label[i], label[j])
    found = simhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id: r.keeper for r in found.collect()} == dict(enumerate(label))


@pytest.mark.parametrize("short,long", [(8, 9), (44, 54)])
def test_near_duplicates_at_the_similarity_are_all_found(spark, short, long):
    """Texts at exactly 0.8, of which fingerprints miss some: 4 of 5 and 40 of 50 shingles in common."""
    rng = random.Random(long)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(long)]
        texts += [words[:short], words]
    assert {jaccard(x, y) for x, y in zip(texts[::2], texts[1::2], strict=True)} == {0.8}
    found = simhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id: r.keeper for r in found.collect()} == {i: i - i % 2 for i in range(len(texts))}


def test_first_shingles_that_are_frequent_come_last(spark, monkeypatch):
    """With every shingle of the template late, fingerprints switched off: the exact way alone finds all groups."""
    monkeypatch.setattr(simhash, "OFTEN", 2)
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    template = [word() for _ in range(60)]
    texts = [[*template, *(word() for _ in range(rng.randint(0, 40)))] for _ in range(40)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    label = list(range(40))
    for i in range(40):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    none = spark.createDataFrame([], "node long, label long")
    found = {r.node: r.label for r in simhash._completed(rows, rows.select(F.col("doc_id").alias("node")), none, 0.8, 5).collect()}
    assert 1 < len(set(label)) < 40 and [found.get(i, i) for i in range(40)] == label


def test_texts_that_share_shingles_are_no_rows_for_each_pair(spark, monkeypatch):
    """400 texts of one template below the similarity and 20 pairs above it, fingerprints switched off: rows follow the first shingles."""
    monkeypatch.setattr(simhash, "OFTEN", 1000)  # the template doesn't come last
    made, kind = [], type(spark.range(0))
    plain = kind.mapInArrow

    def counting(self, function, schema, *more, **named):
        n = spark.sparkContext.accumulator(0)
        made.append(n)

        def run(batches):
            for batch in function(batches):
                n.add(batch.num_rows)
                yield batch

        return plain(self, run, schema, *more, **named)

    monkeypatch.setattr(kind, "mapInArrow", counting)
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    template = [word() for _ in range(64)]
    texts = [[*template, *(word() for _ in range(20))] for _ in range(400)]
    for k in range(20):  # sizes on both sides of a width of parities
        own = [word() for _ in range(64)]
        texts += [own, [*own, *(word() for _ in range(1 + k % 11))]]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    none = spark.createDataFrame([], "node long, label long")
    found = {r.node: r.label for r in simhash._completed(rows, rows.select(F.col("doc_id").alias("node")), none, 0.8, 5).collect()}
    assert {jaccard(x, y) >= 0.8 for x, y in zip(texts[:20], texts[1:21], strict=True)} == {False}
    assert {i: x for i, x in found.items() if i != x} == {401 + 2 * k: 400 + 2 * k for k in range(20)}
    first = sum(n - int(np.ceil(0.8 * n)) + 1 for n in (len(t) - 4 for t in texts))
    assert 0 < max(n.value for n in made) <= first


def test_parities_fold():
    every = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 500).astype(np.uint64))
    for w in (64, 128, 1024):
        assert (np.bitwise_xor.reduce(simhash.parity(every, 4 * w).reshape(4, -1), axis=0) == simhash.parity(every, w)).all()


def family(rows, least=0.68, sure=0.92, label=None, tried=None):
    fps = np.packbits(rows, axis=1, bitorder="little").view("<u8")
    n = len(rows)
    return simhash.Family(np.arange(n), fps, np.full(n, 300.0), np.arange(n) if label is None else label, tried or [None] * n, least, sure)


def grouped(n, pairs):
    group = np.arange(n)
    for _ in range(n):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return group.tolist()


def test_trees_connect_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    heads = rng.integers(0, 2, (6, 1024))
    rows = np.concatenate([heads[rng.integers(0, 3, 90)], heads[3:], heads[:3]])
    rows ^= rng.random(rows.shape) < rng.choice([0.01, 0.06], (len(rows), 1))
    own = family(rows)
    n, tree = len(rows), own.tree()
    every = lambda f: [(i, int(j)) for i in range(n) for j in f.open(i)]
    value = lambda i, j: simhash._estimates(own.fps[i], 300.0, own.fps[j], 300.0)
    exact = {(i, j) for i in range(n) for j in range(i + 1, n) if value(i, j) >= 0.68}
    assert set(every(own)) == exact and len(tree) < n
    for least in (0.68, 0.92):
        assert grouped(n, [(i, j) for i, j, v in tree if v >= least]) == grouped(n, [(i, j) for i, j in exact if value(i, j) >= least])
    # what was compared or is connected already isn't proposed again
    gone = {(min(i, j), max(i, j)) for i, j, _ in tree}
    label = np.array(grouped(n, list(gone)[::2]))
    rest = family(rows, label=label, tried=[[j for e in gone for j in e if i in e and j != i] for i in range(n)])
    assert set(every(rest)) == {(i, j) for i, j in exact - gone if label[i] != label[j]}
    assert not {(min(i, j), max(i, j)) for i, j, _ in rest.tree()} & gone


def test_a_middle_row_takes_no_link_away():
    # p is within the first word's bound of x and y but differs from both elsewhere; x and y differ in one bit
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, 1024)
    y = x.copy()
    y[700] ^= 1
    p = np.concatenate([x[:64], rng.integers(0, 2, 960)])
    p[rng.choice(64, 18, replace=False)] ^= 1
    for order in ([p, x, y], [x, p, y], [x, y, p]):
        for more in (0, 60):
            rows = np.stack([*order, *(np.concatenate([x[:64], rng.integers(0, 2, 960)]) for _ in range(more))])
            at = [i for i, r in enumerate(order) if r is not p]
            assert tuple(at) in {tuple(sorted((i, j))) for i, j, _ in family(rows).tree()}


def test_quality_rejects_symbols_between_words(spark):
    rng = random.Random(9)
    good = [" ".join("x" * rng.randint(3, 7) + str(rng.randint(0, 10**6)) for _ in range(120)) for _ in range(200)]
    junk = [" | ".join("x" * rng.randint(5, 9) + str(rng.randint(0, 10**6)) for _ in range(120)) for _ in range(5)]
    rows = [(i, t, "en", "a") for i, t in enumerate([*good, *junk])]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in range(205)] == [True] * 200 + [False] * 5


def test_long_secrets_and_hidden_addresses_are_one_span(spark):
    texts = ["password: " + "aB3" * 200, "x" * 80 + " [at] " + ".".join(["label" * 20] + ["sub"] * 12) + ".org", "me (at) a (dot) b (dot) com"]
    table = spark.createDataFrame([(i, f"see {t} end") for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.candidates(table).collect():
        assert (4, 4 + len(texts[r.doc_id])) in [(s.start, s.end) for s in r.spans]


def test_mixing_deals_rows_with_one_id(spark):
    rows = [(None, " ".join(f"w{i}" for i in range(k, k + 50)), "a") for k in range(200)] + [(7, "same text " * 25, "b")] * 200 + [(i, "word " * 50, "c") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix(table).collect()
    for source in "abc":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(table).collect()))
    assert mixing.repeated(table).count() == sum(r.repeats for r in found)


def test_mixing_threshold_above_all_hashes(spark):
    table = spark.createDataFrame([(i, f"w{i}", "a") for i in range(500)], "doc_id long, text string, source string")
    top = mixing._hashed(table, mixing.SEED).agg(F.max("hash")).first()[0]
    assert ((top >> 56) + 1) << 56 < 1 << 63


def test_near_duplicates_deal_wide_rows_and_sets_once(spark, monkeypatch):
    """Links that no bucket's tree has are found without a set of shingles for each bucket and row; labels reach rows where they are."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(40):  # at 0.6 to 0.9 of the template, so that trees rest on pairs that are no links
        own = list(base)
        for k in rng.sample(range(200), rng.randint(2, 12)):
            own[k] = f"x{rng.random()}"
        texts.append(own)
    sets = [{tuple(t[i : i + 5]) for i in range(196)} for t in texts]
    group = list(range(40))
    for i in range(40):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    stored, names = S.stored, []
    monkeypatch.setattr(S, "stored", lambda df, name: stored(names.append(name) or df, name))
    found = simhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(40, " ".join(texts[0]).upper())], "doc_id long, text string"))
    assert {r.doc_id: r.keeper for r in found.collect()} == {**dict(enumerate(group)), 40: group[0]}
    assert "near-counted" not in names and "near-other" in names


def test_sample_of_wide_fingerprints_is_small_in_the_driver(spark):
    rng = np.random.default_rng(5)
    rows = [(i, bytearray(rng.bytes(128))) for i in range(simhash.SAMPLE)]
    fps = spark.createDataFrame(rows, "id long, fp binary")
    sample = simhash.sampled(fps, "fp")
    assert sample.shape == (simhash.SAMPLE, 1024) and sample.nbytes < 5e6
    tracemalloc.start()
    found = simhash.grouped_bits(sample, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [list(range(1024))] and peak < 80e6
