"""Personal data: base patterns, and weak supervision for what they miss.

Base spans come from four patterns with checks. A wide pattern proposes further
candidates. Three labelers vote on every candidate or abstain: the strict pattern, a
gazetteer of values (top-level names, area codes, issuer prefixes) and cue words in
front of it. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, and with its posteriors a logistic span classifier is
trained. Its spans are added where no base span lies.

Only DataFrame functions run on the texts. The driver sees counts of vote patterns and
length classes, whose number is fixed by the kinds and labelers.

Patterns are written with possessive loops that start at run borders: the matches are
those of the plain patterns, in time linear in the text, without deep recursion.

Cases: a null or empty text has no spans; equal rows get equal spans; long runs of digits
or letters are one match at most; without candidates nothing is trained and nothing added;
an empty table gives no rows; other columns, whatever their names, are kept by `redact` and
ignored by `detect`.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

KINDS = ("email", "ip", "card", "phone")
#: Plain: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on, as the module says.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
GATES = {"email": F.contains, "ip": F.rlike, "card": F.rlike, "phone": F.contains}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}
#: Kinds of candidates beyond the base ones, by the wide pattern's alternatives.
WIDE = {
    "secret": r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]\x20?[^\x20\x09-\x0D]{6,}+)",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "call": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "hidden": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?)[A-Za-z0-9-]++)++",
}
WIDE_HINT = r"(?i:[=:]\x20?[^\x20]|[0-9]{3}-[0-9]|[0-9][\x20.-][0-9]{4}|[\[(]at[\])])"
ALL = KINDS + tuple(WIDE)
#: Fixed values of the gazetteer: top-level names, and leading digits of card issuers.
TOP_LEVEL = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|mx|ar|br|jp|cn|in|au"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6(?:011|4|5))"
CUES = {
    "email": "mail|correo|courriel|contact|write|schreib",
    "ip": "ip|host|server|serveur|servidor|address|adresse",
    "card": "card|karte|carte|tarjeta|visa|mastercard|credit|pay",
    "phone": "phone|tel|call|mobile|fax|telefon|anruf|appel|llam",
    "secret": "login|user|account|konto|compte|cuenta",
    "id": "ssn|social|security|ident|ausweis|dni",
    "call": "phone|tel|call|mobile|fax|telefon|anruf|appel|llam",
    "hidden": "mail|correo|courriel|contact|write|schreib",
}
AGAINST = "version|isbn|order|invoice|section|chapter|build|figure"
CONTEXT = 40
LENGTHS = (8, 12, 16, 24, 48)
ROUNDS, EPOCHS, RATE = 40, 150, 2.0


def _spans(text: Column, kind: int, matches: Column, between: Column) -> Column:
    """(start, kind, end, value) of matches, from the lengths of matches and of the text between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out"))

    def step(a: Column, z: Column) -> Column:
        begin = a["at"] + F.char_length(z["b"])
        end = begin + F.char_length(z["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), z["m"].alias("value")))).alias("out"))

    both = F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b"))
    return F.aggregate(both, start, step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, at most 19, pass Luhn's check."""
    back = F.split(F.reverse(digits), "")
    doubled = F.transform(back, lambda d, i: F.when(d == "", 0).otherwise(F.when(i % 2 == 0, d.try_cast("int")).otherwise((d.try_cast("int") * 2) - F.when(d.try_cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.try_cast("double") <= 255)
    if kind == "card":
        return F.when(F.char_length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind in ("email", "hidden"):
        return F.rlike(F.lower(value), F.lit(rf"(?:\.|dot[\])]?\x20?)(?:{TOP_LEVEL})$"))
    if kind == "ip":
        return ~F.rlike(value, F.lit(r"^(?:0|127|255)\."))
    if kind == "card":
        return F.rlike(digits, F.lit(ISSUERS))
    if kind in ("phone", "call"):
        return F.rlike(digits, F.lit(r"^1?[2-9]" if kind == "call" else r"^[1-9]"))
    if kind == "id":
        return ~F.rlike(value, F.lit(r"^(?:000|666|9..)|-00-|-0000$"))
    return F.rlike(value, F.lit(r"[=:].*[0-9]")) & F.rlike(value, F.lit(r"[=:].*[A-Za-z]"))


def _by_kind(kind: Column, make) -> Column:
    out = F.lit(None)
    for i, name in enumerate(ALL):
        out = F.when(kind == i, make(name)).otherwise(out)
    return out


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, and spans: base matches and wide ones, each with base, votes and a length class."""
    text = F.col("_text")
    out = docs.select("doc_id", *keep, S.text_of().alias("_text"))
    nothing = F.array().cast("array<string>")
    found = {k: F.when(GATES[k](text, F.lit(HINTS[k])), F.regexp_extract_all(text, F.lit(PATTERNS[k]), 0)).otherwise(nothing) for k in KINDS}
    wide = "|".join(WIDE.values())
    found["wide"] = F.when(F.rlike(text, F.lit(WIDE_HINT)), F.regexp_extract_all(text, F.lit(wide), 0)).otherwise(nothing)
    out = out.withColumns({f"_m_{k}": m for k, m in found.items()})
    between = lambda k, p: F.when(F.size(f"_m_{k}") > 0, F.split(text, p, -1)).otherwise(nothing)
    out = out.withColumns({f"_b_{k}": between(k, PATTERNS.get(k, wide)) for k in found})
    # card and ip matches of ordinary numbers are many: those that fail are dropped before they are handled further
    spans = {k: _spans(text, ALL.index(k) if k in ALL else -1, F.col(f"_m_{k}"), F.col(f"_b_{k}")) for k in found}
    spans["card"] = F.filter(spans["card"], lambda s: F.char_length(_digits(s["value"])).between(12, 19))
    out = out.withColumns({f"_s_{k}": s for k, s in spans.items()})
    sort = lambda s: F.coalesce(_wide_kind(s["value"]), s["kind"])
    joined = F.concat(*[F.col(f"_s_{k}") for k in KINDS], F.transform("_s_wide", lambda s: F.struct(s["start"].alias("start"), sort(s).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    out = out.withColumn("_all", F.array_sort(joined))
    before = lambda s: F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
    vote = lambda c: F.when(c, 1).otherwise(0)

    def labelled(s: Column) -> Column:
        kind, value = s["kind"], s["value"]
        base = F.coalesce(_by_kind(kind, lambda k: _valid(k, value) if k in KINDS else F.lit(False)), F.lit(False))
        context = F.when(F.coalesce(_by_kind(kind, lambda k: F.rlike(before(s), F.lit(CUES[k]))), F.lit(False)), 1).when(F.rlike(before(s), F.lit(AGAINST)), 0).otherwise(-1)
        size = sum((F.when(F.char_length(value) >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
        return F.struct(
            s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"), base.alias("base"),
            F.when(kind < len(KINDS), vote(base)).otherwise(-1).alias("v0"),
            vote(F.coalesce(_by_kind(kind, lambda k: _gazetteer(k, value)), F.lit(False))).alias("v1"),
            context.alias("v2"), size.alias("size"),
        )

    return out.select("doc_id", *keep, F.transform("_all", labelled).alias("spans"))


def _wide_kind(value: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (_, p) in reversed(list(enumerate(WIDE.items()))):
        out = F.when(F.rlike(value, F.lit(f"^(?:{p})$")), len(KINDS) + i).otherwise(out)
    return out


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[dict, list[tuple[float, float]]]:
    """Expectation-maximisation over (kind, votes, count): posterior of each (kind, votes), and each labeler's two accuracies."""
    labelers = len(patterns[0][1]) if patterns else 0
    good = [(0.8, 0.8)] * labelers
    prior: dict[int, float] = defaultdict(lambda: 0.5)
    post: dict = {}
    for _ in range(rounds):
        for kind, votes, _n in patterns:
            yes, no = prior[kind], 1 - prior[kind]
            for v, (a, b) in zip(votes, good, strict=True):
                if v >= 0:
                    yes, no = yes * (a if v else 1 - a), no * (1 - b if v else b)
            post[kind, votes] = yes / (yes + no)
        mass: dict[int, list[float]] = defaultdict(lambda: [1.0, 2.0])
        for kind, votes, n in patterns:
            mass[kind][0] += n * post[kind, votes]
            mass[kind][1] += n
        prior = {k: a / b for k, (a, b) in mass.items()}
        new = []
        for j in range(labelers):
            hit, yes, miss, no = 8.0, 10.0, 8.0, 10.0
            for kind, votes, n in patterns:
                if votes[j] >= 0:
                    p = post[kind, votes]
                    yes, no = yes + n * p, no + n * (1 - p)
                    hit, miss = hit + n * p * votes[j], miss + n * (1 - p) * (1 - votes[j])
            new.append((min(0.999, hit / yes), min(0.999, miss / no)))
        good = new
    return post, good


def _features(kind: int, votes: tuple[int, ...], size: int) -> list[int]:
    """Positions of the features that are 1: kind, each labeler's vote, length class, bias."""
    at = [kind]
    for j, v in enumerate(votes):
        at.append(len(ALL) + 3 * j + v + 1)
    return [*at, len(ALL) + 3 * len(votes) + size, len(ALL) + 3 * len(votes) + len(LENGTHS) + 1]


def train(counts: list[tuple[int, tuple[int, ...], int, int]]) -> tuple[list[float], list[tuple[float, float]]]:
    """Weights of the span classifier and the labelers' accuracies, from counts of (kind, votes, size)."""
    sums: dict = defaultdict(int)
    for kind, votes, _, n in counts:
        sums[kind, votes] += n
    post, good = reliabilities([(k, v, n) for (k, v), n in sorted(sums.items())])
    weights = [0.0] * (len(ALL) + 3 * 3 + len(LENGTHS) + 2)
    total = float(sum(n for *_, n in counts)) or 1.0
    rows = [(_features(k, v, s), math.sqrt(n / total), post[k, v]) for k, v, s, n in counts]
    norm = sum(n for _, n, _ in rows) or 1.0
    for _ in range(EPOCHS):
        slope = [0.0] * len(weights)
        for at, n, target in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[i] for i in at)))))
            for i in at:
                slope[i] += n / norm * (p - target)
        weights = [w - RATE * (d + 1e-3 * w) for w, d in zip(weights, slope, strict=True)]
    return weights, good


def fit(found: DataFrame) -> list[float]:
    """Weights from the candidates of all documents."""
    flat = found.select(F.explode("spans").alias("s")).select("s.kind", "s.v0", "s.v1", "s.v2", "s.size")
    counts = flat.groupBy("kind", "v0", "v1", "v2", "size").agg(F.count("*").alias("n")).collect()  # kinds x votes x length classes
    return train(sorted((r.kind, (r.v0, r.v1, r.v2), r.size, r.n) for r in counts))[0]


def accepted(spans: Column, weights: list[float]) -> Column:
    """Base spans, and what the classifier takes outside them, in order."""
    base = F.filter(spans, lambda s: s["base"])

    def score(s: Column) -> Column:
        one = lambda values, at: F.get(F.array(*[F.lit(w) for w in values]), at)
        k = len(ALL)
        out = one(weights[:k], s["kind"]) + one(weights[k + 9 : k + 9 + len(LENGTHS) + 1], s["size"]) + weights[-1]
        for j in range(3):
            out = out + one(weights[k + 3 * j : k + 3 * j + 3], s[f"v{j}"] + 1)
        return out

    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(spans, lambda s: s["base"] | ((s["kind"] >= len(KINDS)) & (score(s) > 0) & free(s)))


def _names(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans of every row of docs (doc_id, text)."""
    found = S.stored(candidates(docs), "pii")
    weights = fit(found)
    return found.select("doc_id", F.filter("spans", lambda s: s["base"]).alias("base"), accepted(F.col("spans"), weights).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans are replaced together.

    Texts are searched once: the rows are stored with their spans, which are then read for the training by themselves.
    """
    everything = F.struct(*S.columns(docs))
    rows = S.stored(candidates(docs.select(F.col("doc_id"), everything.alias("row"), "text"), ("row",)), "pii-rows")
    weights = fit(rows)
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL])
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(new, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(kinds, s["kind"]))).otherwise(a["out"]).alias("out"),
        )

    found = rows.select("row", accepted(F.col("spans"), weights).alias("spans"))
    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    safe = F.when(F.size("spans") > 0, done).otherwise(F.col("row.text"))
    return found.select(*[safe.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched."""
    found = detect(S.table(spark, sf_dir, "documents"))
    n = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_names(F.col("base")).cast("binary"), 256).alias("base_sha256"), _names(F.col("spans")).alias("spans"))
