"""Soft-membership mixing, in DataFrame operations alone.

A naive Bayes classifier learnt from a labelled table gives each document a posterior over domains.
Nonnegative rates then scale the documents so that the expected tokens of each domain meet target
weights: least squares over rates, solved by projected gradient steps. A step needs one vector with an
entry for each domain, summed over all documents; documents never leave the executors.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stored, table, text_print

#: Labelled rows of each domain that the classifier is fitted on at most (those of the least hash).
DOMAIN_ROWS = 3000
#: Hash buckets of the classifier's vocabulary, which bounds the model that is broadcast.
BUCKETS = 1 << 16
#: A bucket is kept if some domain's count is this many standard deviations from independence.
LEAST_Z = 4.0
#: Weights are summed as whole millionths, so that sums don't depend on the order of rows.
SCALE = 1_000_000
STEPS, TOLERANCE = 40, 1e-6
#: Further than this from the targets, a warning tells which shares were reached.
WARN_AT = 1e-3
SPACE = r"[\x20\x09-\x0D]+"
DOMAINS = ("clean", "junk", "toxic")
TARGETS = {"clean": 0.9, "junk": 0.03, "toxic": 0.07}


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, print (a hash of the text), words. Null texts have no words."""
    split = F.array_remove(F.split("text", SPACE), "")
    return docs.select("doc_id", text_print().alias("print"), F.coalesce(split, F.array().cast("array<string>")).alias("words"))


def _bucket(word) -> F.Column:
    """Words count in lower case; of words that end in a mark, the last two characters count, as marks tell more."""
    end = F.right(word, F.lit(1))
    shape = F.when(F.lower(end) == F.upper(end), F.right(word, F.lit(2))).otherwise(F.lower(word))
    return F.pmod(F.xxhash64(shape), F.lit(BUCKETS))


def fit(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], rows: int = DOMAIN_ROWS) -> tuple[DataFrame, list[int], list[float]]:
    """The classifier from ``labelled`` (doc_id, domain): (bucket, w0, w1, ...), the weights of any other word, and the log priors.

    At most ``rows`` rows of each domain are used, those of the least hash of doc_id; priors come from
    all labelled rows, each domain with one row more. Null ids and other domains are ignored; a doc_id
    of two domains counts in the first by name.
    """
    usable = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["count"] for r in usable.groupBy("domain").count().collect()}
    total = sum(counts.values()) + len(domains)
    priors = [math.log((counts.get(k, 0) + 1) / total) for k in domains]
    picked = reduce(DataFrame.union, [usable.where(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in domains])
    texts = _identified(docs).select("doc_id", "words").join(F.broadcast(picked), "doc_id")
    tokens = texts.select("domain", F.explode("words").alias("word")).groupBy("domain", _bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n"))
    n = [F.sum(F.when(F.col("domain") == k, F.col("n")).otherwise(0)) for k in domains]
    held = stored(tokens.groupBy("bucket").agg(*[c.alias(f"n{i}") for i, c in enumerate(n)]), "bucket-counts")
    sums = [x or 0 for x in held.agg(*[F.sum(f"n{i}") for i in range(len(domains))]).first()]
    every = max(1, sum(sums))
    of_bucket = sum(F.col(f"n{i}") for i in range(len(domains)))
    expected = [of_bucket * F.lit(s / every) for s in sums]
    z = F.greatest(*[F.abs(F.col(f"n{i}") - e) / F.sqrt(e + 1) for i, e in enumerate(expected)])
    weights = [F.round(F.log((F.col(f"n{i}") + 1) / (e + 1)) * SCALE).cast("long").alias(f"w{i}") for i, e in enumerate(expected)]
    told = z >= LEAST_Z
    kept = [x or 0 for x in held.where(told).agg(*[F.sum(f"n{i}") for i in range(len(domains))]).first()]
    rest = [(1 + s - k) / (1 + s) for s, k in zip(sums, kept, strict=True)]
    usual = (1 + sum(sums) - sum(kept)) / (1 + sum(sums))
    return stored(held.where(told).select("bucket", *weights), "domain-model"), [round(SCALE * math.log(r / usual)) for r in rest], priors


def posteriors(docs: DataFrame, model: DataFrame, other: list[int], priors: list[float]) -> DataFrame:
    """doc_id, print, copies (rows of ``docs`` alike), n_tokens, p0, p1, ...: a row for each (doc_id, text).

    The evidence of a document's words is divided by the fourth root of their number, which keeps the
    memberships of long documents soft. A document without words has the prior.
    """
    # A null word closes each document, so that the left join keeps every document.
    closed = _identified(docs).select("doc_id", "print", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    keyed = closed.select("doc_id", "print", "pos", F.col("word").isNull().alias("close"), F.when(F.col("word").isNotNull(), _bucket(F.col("word"))).alias("key"))
    known = keyed.join(F.broadcast(model), F.col("key") == F.col("bucket"), "left").where(F.col("close") | F.col("bucket").isNotNull())
    w = [F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"s{i}") for i in range(len(priors))]
    summed = known.groupBy("doc_id", "print").agg(F.count_if("close").alias("copies"), F.max(F.when(F.col("close"), F.col("pos"))).cast("long").alias("n_tokens"), F.count_if(~F.col("close")).alias("n_known"), *w)
    unknown, root = F.col("n_tokens") - F.col("n_known") / F.col("copies"), F.pow(F.greatest(F.col("n_tokens"), F.lit(1)), F.lit(0.25))
    z = [F.lit(p) + (F.col(f"s{i}") / F.col("copies") + unknown * F.lit(o)) / SCALE / root for i, (o, p) in enumerate(zip(other, priors, strict=True))]
    exps = summed.select("doc_id", "print", "copies", "n_tokens", F.greatest(*z).alias("top"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
    e = [F.exp(F.col(f"z{i}") - F.col("top")) for i in range(len(priors))]
    return exps.select("doc_id", "print", "copies", "n_tokens", *[F.round(x / sum(e), 6).alias(f"p{i}") for i, x in enumerate(e)])


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with pivoting, for a matrix with a side for each domain."""
    n, m = len(b), [[*row, y] for row, y in zip(a, b, strict=True)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(m[r][c]))
        m[c], m[p] = m[p], m[c]
        for r in range(n):
            if r != c:
                f = m[r][c] / m[c][c]
                m[r] = [x - f * y for x, y in zip(m[r], m[c], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def rates(members: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[F.Column, list[float]]:
    """The rate of each document of ``posteriors()`` as a column, and the shares that it reaches.

    Minimises |A'r - t|^2 over r >= 0, where A'r are the expected tokens of each domain as shares of all
    tokens and t the ``targets``. From r = 1, a step subtracts p.y from each rate and projects to r >= 0;
    y is the residual in the metric of the documents whose rate is above zero, the gradient of each
    document being divided by its tokens. A step that doesn't lower the residual is halved.
    """
    k = len(targets)
    p = [F.col(f"p{i}") for i in range(k)]
    total = members.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
    rate = F.lit(1.0)
    if not total:
        return rate, [0.0] * k
    mass = F.col("n_tokens") * F.col("copies") / F.lit(float(total))

    def measured(r: F.Column) -> tuple[list[float], list[list[float]]]:
        live = F.when(r > 0, mass).otherwise(0.0)
        got = members.agg(*[F.sum(mass * r * x) for x in p], *[F.sum(live * p[i] * p[j]) for i in range(k) for j in range(i + 1)]).first()
        got, h = [round(x or 0.0, 10) for x in got], [[0.0] * k for _ in range(k)]
        rest = iter(got[k:])
        for i in range(k):
            for j in range(i + 1):
                h[i][j] = h[j][i] = next(rest) + (1e-6 if i == j else 0)
        return got[:k], h

    shares, h = measured(rate)
    gap = lambda s: math.dist(s, targets)
    scale, left = 1.0, steps
    while left and gap(shares) > tolerance and scale > 1e-3:
        left -= 1
        y = [round(scale * v, 9) for v in solve(h, [s - t for s, t in zip(shares, targets, strict=True)])]
        tried = F.greatest(F.lit(0.0), rate - sum(x * F.lit(v) for x, v in zip(p, y, strict=True)))
        new_shares, new_h = measured(tried)
        if gap(new_shares) < gap(shares):
            better = gap(shares) - gap(new_shares)
            rate, shares, h, scale = tried, new_shares, new_h, 1.0
            if better < tolerance * 0.01:
                break
        else:
            scale /= 2
    return rate, shares


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rows: int = DOMAIN_ROWS) -> DataFrame:
    """doc_id, print, alike, n_tokens, p_<domain>..., rate, copies: a row for each (doc_id, text) of ``docs``.

    ``rate`` is how often a document should occur for the expected tokens of the domains to have the
    shares of ``targets`` (weights above zero; they are divided by their sum) with as many tokens
    altogether as there are. ``copies`` is the rate rounded down, or up where a hash of the document
    says so, so that its mean is the rate. ``alike`` counts equal rows. Null and empty texts have no tokens
    and the prior's membership; very long texts count whole; other columns are ignored. An empty table gives an empty
    result. A warning tells the shares reached where they are off the targets (a domain may have no documents).
    """
    names = tuple(sorted(targets))
    members = stored(posteriors(docs, *fit(docs, labelled, names, rows)), "memberships")
    whole = sum(targets.values())
    wanted = [targets[k] / whole for k in names]
    rate, reached = rates(members, wanted)
    if any(reached) and math.dist(reached, wanted) > WARN_AT:
        warnings.warn(f"the shares reached are {dict(zip(names, (round(x, 4) for x in reached), strict=True))}", stacklevel=2)
    draw = F.pmod(F.xxhash64("doc_id", "print", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    rated = members.withColumn("rate", F.round(rate, 6))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")
    return rated.select("doc_id", "print", F.col("copies").alias("alike"), "n_tokens", *[F.col(f"p{i}").alias(f"p_{k}") for i, k in enumerate(names)], "rate", copies)


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from labels: junk where quality is 0, else toxic where toxic is 1, else clean."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its rate; domains from labels."""
    mixed = mix(documents(spark, sf_dir), label_domains(table(spark, sf_dir, "labels")), TARGETS)
    return mixed.select("doc_id", F.explode(F.array_repeat(F.lit(0), F.col("alike").cast("int"))).alias("row"), "n_tokens", *[f"p_{k}" for k in DOMAINS], "rate", "copies").drop("row")
