"""URL rules, then host reputation by empirical Bayes.

A page's label is that of the document of its id. Outcomes are counted per host;
a suffix's rate of bad pages is drawn to the corpus's, a registered domain's to
its suffix's and a host's to its domain's, each by a beta prior whose strength is
estimated from the spread of the rates below it (method of moments, in
bounds). A host is blocked when its rate lies above the limit with the given
certainty under its posterior beta distribution: the distribution function by its continued
fraction, or the normal approximation beyond LARGE pages.

A suffix is the last name of a host, or the last two where the last is a country's and the
one before a general one (co.uk); the registered domain is one name more. User, port and a
last dot don't count, and an address is a domain of its own.

Only DataFrame functions run. Counts are summed before they are shuffled; hosts are
joined back, not collected.

Cases: a null url or one without `://` has an empty host and path, which form one host
like any other; a page without a label judges nobody; equal pages get equal
verdicts, and rows with one page_id or none count each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A host is blocked if its rate of bad pages lies above LIMIT with this certainty.
LIMIT, CERTAINTY = 0.5, 0.95
#: Terms of the continued fraction, enough up to a posterior of LARGE pages.
TERMS, LARGE = 300, 20_000.0
#: Names that form a suffix together with a country's.
GENERAL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Bounds of a prior's strength in pages.
STRENGTH = (2.0, 1000.0)
#: Rate and strength above the suffixes, for a corpus without labels.
TOP_RATE, TOP_STRENGTH = 0.05, 20.0
LEVELS = ("top", "suffix", "domain", "host")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, ASCII letters in lower case, and path of an url; empty without `://`."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.char_length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return S.ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path together, and its verdict; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _levels(host: Column) -> dict[str, Column]:
    """Suffix, registered domain and host."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    address = bare.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$")
    last, before = F.substring_index(bare, ".", -1), F.substring_index(F.substring_index(bare, ".", -2), ".", 1)
    names = F.when((F.char_length(last) == 2) & before.isin(*GENERAL) & bare.contains("."), 2).otherwise(1)
    tail = lambda n: F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(bare, r"\.")), F.lit(1), n)), 1, 1 << 20), ".")
    return {"top": F.lit(""), "suffix": F.when(address, "#").otherwise(tail(names)), "domain": F.when(address, bare).otherwise(tail(names + 1)), "host": host}


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function, by Stirling's series from x + 8 on."""
    z, product = x + 8, x
    for i in range(1, 8):
        product = product * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(product)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's steps."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    first = 1 / tiny(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def term(s: Column, numerator: Column) -> Column:
        d, c = 1 / tiny(1 + numerator * s["d"]), tiny(1 + numerator / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return term(s, F.when(k % 2 == 0, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(2), F.lit(TERMS)), start, step)["h"]


def certainty(a: Column, b: Column, limit: float = LIMIT) -> Column:
    """Probability that a rate with the distribution beta(a, b) lies above the limit."""
    x = F.lit(limit)
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    below = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    mean = a / (a + b)
    variance = mean * (1 - mean) / (a + b + 1)
    # the logistic form of the normal distribution function is within 0.0002
    z = (mean - x) / F.sqrt(variance)
    normal = 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))
    # Cantelli's bound spares most hosts the fraction
    never = (mean < x) & (variance / (variance + (mean - x) * (mean - x)) < CERTAINTY)
    return F.when(never, 0.0).when(a + b > LARGE, normal).otherwise(1 - below)


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, bad, its posterior's a and b, and rate, from outcomes (host, bad 0 or 1 or null)."""
    sums = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = S.stored(sums.select("n", "bad", *[c.alias(k) for k, c in _levels(F.col("host")).items()]), "hosts")
    tables = {"host": hosts}
    for level, below in (("domain", "host"), ("suffix", "domain"), ("top", "suffix")):
        up = [k for k in LEVELS if LEVELS.index(k) <= LEVELS.index(level)]
        # spread of the rates one level below: squares weighed by pages, less what chance adds
        tables[level] = tables[below].groupBy(*up).agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"),
            F.sum(F.col("bad") * F.col("bad") / F.greatest(F.col("n"), F.lit(1.0))).alias("squares"),
            F.sum(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("k"),
            F.sum(F.col("n") * F.col("n")).alias("nn"),
        )
    a, b = F.col("a"), F.col("b")
    above = None
    for level in LEVELS[:-1]:
        own = tables[level]
        own = own.withColumns({"a": F.lit(TOP_RATE * TOP_STRENGTH), "b": F.lit((1 - TOP_RATE) * TOP_STRENGTH)}) if above is None else own.join(above, [k for k in LEVELS if LEVELS.index(k) < LEVELS.index(level)])
        rate = (a + F.col("bad")) / (a + b + F.col("n"))
        n, k = F.col("n"), F.col("k")
        chance = rate * (1 - rate)
        between = (F.col("squares") - 2 * rate * F.col("bad") + rate * rate * n - k * chance) / F.greatest(n - F.col("nn") / F.greatest(n, F.lit(1.0)), F.lit(1e-9))
        strength = F.when((k < 2) | (between <= 0), F.lit(STRENGTH[1])).otherwise(F.least(F.greatest(chance / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])))
        up = [x for x in LEVELS if LEVELS.index(x) <= LEVELS.index(level)]
        above = own.select(*up, (rate * strength).alias("a"), ((1 - rate) * strength).alias("b"))
    out = hosts.join(above, list(LEVELS[:-1])).withColumns({"a": a + F.col("bad"), "b": b + F.col("n") - F.col("bad")})
    return out.select("host", "n", "bad", "a", "b", (a / (a + b)).alias("rate"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, the host's rate and the certainty that it is above the limit (0 where far from CERTAINTY); pages (page_id, url), labels (doc_id, quality, toxic)."""
    host, path = parts(F.col("url"))
    split = S.stored(pages.select("page_id", host.alias("host"), path.alias("path")), "pages")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)
    # a page counts once however many labels its document has: bad if any says so
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    known = reputation(split.join(marks, "page_id", "left").select("host", "bad"))
    known = S.stored(known.select("host", "rate", certainty(F.col("a"), F.col("b")).alias("certainty")), "reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = split.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "rate", "certainty")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("certainty") >= CERTAINTY, "block").otherwise("allow")).alias("verdict"), "rate", "certainty")


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged."""
    return judge(S.table(spark, sf_dir, "pages"), S.table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")
