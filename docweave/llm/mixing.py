"""Mixing by soft membership: domain posteriors of every document, then non-negative rates that meet the targets.

1. A classifier learns the domains from labelled documents (at most ``max_labelled`` label rows, which bounds the
   broadcast): smoothed document counts of hashed words per domain (naive Bayes, ``buckets`` buckets, so the model has a
   proven size); the log ratios of a whole text's different words, of buckets with an evidence of at least ``evidence``, add up
   to the posteriors p(domain | document).  Domains without a labelled document in the table are left out.
2. Rates r >= 0 solve a least squares problem whose residuals are, over domains d, the expected tokens (sum over
   documents of r * tokens * p_d) less the target's, with a weight of 1 / ``ease`` against that of moving a rate away
   from 1, so that the solution is one and no few documents carry a domain.  Each round goes along the gradient and
   projects the rate of every document onto its bounds: rate = 1 - (a price of each domain) * posterior, cut to the
   bounds.  The prices move by the residuals, scaled by the second moments of the posteriors over the documents inside
   their bounds, with the length among ``LENGTHS`` that gains most.  A round is two aggregations to a few numbers;
   nothing about a document is written, as its rate is an expression of the prices.  Rounds end when the gradient is
   zero up to ``tolerance`` (or no length gains any more); the last report says whether each domain is within ``tolerance`` of its
   target (state 'met') or whether these rates, which come nearest, miss some (state 'nearest', with the residuals).

Only DataFrame functions are used; what is collected are one row per domain and round.

Defined results: null and empty texts have no tokens, the prior as posterior and a rate like any other; rows that
share a doc_id (null included) count as one document; texts of any length are read whole; labels of unknown documents
or with null columns are ignored; without labels every document belongs to the one domain 'unlabelled'; documents with
equal posteriors have equal rates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, SMOOTHING, EVIDENCE, MAX_LABELLED = 1 << 18, 5.0, 0.9, 20_000
EASE, TOLERANCE, LENGTHS = 1e-3, 1e-3, [4.0**-i for i in range(9)]
#: Domains of the labels table and their share of the mix's tokens.
TARGETS = {"good": 0.92, "low": 0.06, "toxic": 0.02}


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxicity labels: toxic before low before good."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return known.select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "low").otherwise("good").alias("domain"))


def _seen(docs: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """Each different word of each text as a bucket, with the columns of ``keep``; ``tokens`` (all words of the text)
    stands in the first of a text's rows only.  A text without words keeps one row, of no bucket."""
    words = docs.select(*keep, F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), "").alias("words"))
    each = words.select(*keep, F.size("words").alias("n_"), F.posexplode_outer(F.array_distinct("words")).alias("at_", "w_"))
    return each.select(*keep, F.when(F.coalesce("at_", F.lit(0)) == 0, F.col("n_")).alias("tokens"), F.when(F.col("w_").isNotNull(), F.pmod(F.hash("w_"), F.lit(buckets))).alias("bucket"))


def fit(docs: DataFrame, domains: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, evidence: float = EVIDENCE, max_labelled: int = MAX_LABELLED, text_col: str = "text") -> tuple[list[str], list[float], DataFrame]:
    """Domain names, log priors, and the model: bucket -> log ratios w0, w1, ... of each domain to all labelled."""
    sample = domains.select(F.col("doc_id").alias("id_"), F.col("domain").alias("domain_")).orderBy(F.xxhash64("id_"), "id_").limit(max_labelled)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("id_"))
    prior = {r["domain_"]: r["n"] for r in own.groupBy("domain_").agg(F.count("*").alias("n")).collect()}
    names = sorted(prior) or ["unlabelled"]
    seen = _seen(own.withColumnRenamed("domain_", "domain"), buckets, "domain").filter("bucket is not null")
    counts = seen.groupBy("bucket").agg(*[F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(f"c{i}") for i, d in enumerate(names)])
    counts = common.materialize(counts, "mixing-counts")
    sums = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(len(names))]).first()
    whole = max(1.0, sum(sums))
    every = sum((F.col(f"c{i}") for i in range(len(names))), F.lit(0.0))
    weights = [F.log((F.col(f"c{i}") + smoothing) / (every * (sums[i] / whole) + smoothing)).alias(f"w{i}") for i in range(len(names))]
    total = max(1, sum(prior.values()))
    model = counts.select("bucket", *weights).filter(F.greatest(F.lit(0.0), *[F.abs(F.col(f"w{i}")) for i in range(len(names))]) >= evidence)
    return names, [math.log(prior.get(d, 1) / total) if prior else 0.0 for d in names], model


def posteriors(docs: DataFrame, domains: DataFrame, text_col: str = "text", **options) -> tuple[list[str], DataFrame]:
    """Domain names and (doc_id, tokens, p0, p1, ...) of every document."""
    buckets = options.get("buckets", BUCKETS)
    names, prior, model = fit(docs, domains, text_col=text_col, **options)
    k = range(len(names))
    # at most one row for each bucket: far below the size that a broadcast may have
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = _seen(rows, buckets, "doc_id").join(F.broadcast(model), "bucket", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    filled = scored.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), *[F.sum(f"w{i}").alias(f"s{i}") for i in k])
    logits = [F.lit(prior[i]) + F.coalesce(f"s{i}", F.lit(0.0)) for i in k]
    shifted = filled.select("doc_id", tokens.cast("long").alias("tokens"), *[x.alias(f"l{i}") for i, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"l{i}") for i in k]) if len(names) > 1 else F.col("l0")
    raised = shifted.select("doc_id", "tokens", *[F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in k])
    bottom = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return names, raised.select("doc_id", "tokens", *[(F.col(f"e{i}") / bottom).alias(f"p{i}") for i in k])


def rates(posterior: DataFrame, names: list[str], targets: dict[str, float], budget: float | None = None, ceiling: float | None = None, tolerance: float = TOLERANCE, ease: float = EASE) -> tuple[DataFrame, list[dict]]:
    """(doc_id, tokens, p..., rate) and, by round, a report: ``share`` and ``residual`` (expected less target) of each
    domain, as parts of all tokens there are, and ``state``, which in the last one is 'met' or 'nearest'.

    ``budget``: tokens of the mix (default: as many as there are); ``ceiling``: an upper bound of the rates.
    """
    k = range(len(names))
    wanted = [targets.get(d, 0.0) for d in names]
    now = common.materialize(posterior, "mixing-posteriors")
    total = float(now.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    goal = np.array([w / (sum(wanted) or 1.0) for w in wanted]) * ((budget or total) / total)
    over = F.col("tokens") / total
    pairs = [(i, j) for i in k for j in k if i <= j]

    def look(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals, and second moments of the posteriors over the documents inside their bounds."""
        rate = F.col("rate")
        inside = (rate > 0) if ceiling is None else (rate > 0) & (rate < float(ceiling))
        row = now.withColumn("rate", _rate(prices, ceiling)).agg(
            *[F.coalesce(F.sum(rate * over * F.col(f"p{i}")), F.lit(0.0)).alias(f"t{i}") for i in k],
            *[F.coalesce(F.sum(F.when(inside, over * F.col(f"p{i}") * F.col(f"p{j}"))), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in pairs],
        ).first()
        return np.array([row[f"t{i}"] for i in k]) - goal, _square(row, pairs, len(names))

    def values(choices: list[np.ndarray]) -> list[float]:
        """How good each choice of prices is (the dual of the least squares problem, which is largest at the solution)."""
        parts = []
        for n, prices in enumerate(choices):
            rate, price = _rate(prices, ceiling), _price(prices)
            parts.append(F.coalesce(F.sum(over * ((rate - 1) * (rate - 1) / 2 + price * rate)), F.lit(0.0)).alias(f"v{n}"))
        row = now.agg(*parts).first()
        return [row[f"v{n}"] - float(x @ goal) - ease / 2 * float(x @ every @ x) for n, x in enumerate(choices)]

    free = now.agg(*[F.coalesce(F.sum(over * F.col(f"p{i}") * F.col(f"p{j}")), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in pairs]).first()
    every = _square(free, pairs, len(names))
    scale = np.linalg.pinv(every, rcond=1e-9, hermitian=True)
    prices, log = np.zeros(len(names)), []
    best = values([prices])[0]
    while True:
        rest, inside = look(prices)
        log.append({"share": {d: float(rest[i] + goal[i]) for i, d in enumerate(names)}, "residual": {d: float(rest[i]) for i, d in enumerate(names)}, "state": "under way"})
        gradient = rest - ease * every @ prices
        if gradient @ scale @ gradient <= (tolerance / 10) ** 2:
            break
        way = np.linalg.pinv(inside + ease * every, rcond=1e-9, hermitian=True) @ gradient
        tried = values([prices + x * way for x in LENGTHS])
        n = int(np.argmax(tried))
        if not tried[n] > best + 1e-12:
            break
        best, prices = tried[n], prices + LENGTHS[n] * way
    log[-1]["state"] = "met" if max(map(abs, log[-1]["residual"].values())) <= tolerance else "nearest"
    return now.withColumn("rate", _rate(prices, ceiling)), log


def _square(row, pairs: list[tuple[int, int]], n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"m{i}_{j}"]
    return out


def _price(prices: np.ndarray) -> Column:
    return sum((F.col(f"p{i}") * F.lit(float(x)) for i, x in enumerate(prices)), F.lit(0.0))


def _rate(prices: np.ndarray, ceiling: float | None) -> Column:
    """The rate at these prices of a token of every domain, paid by posterior, cut to its bounds."""
    r = F.greatest(F.lit(0.0), F.lit(1.0) - _price(prices))
    return r if ceiling is None else F.least(F.lit(float(ceiling)), r)


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], budget: float | None = None, ceiling: float | None = None, tolerance: float = TOLERANCE, **options) -> tuple[list[str], DataFrame, list[dict]]:
    """Domain names, (doc_id, tokens, p0, ..., rate) of every document, and the reports of the rounds."""
    names, posterior = posteriors(docs, domains, **options)
    found, log = rates(posterior, names, targets, budget, ceiling, tolerance)
    return names, found, log


def sample(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as its rate: the whole part, and once more with the odds of the rest,
    decided by a hash of the id, so that the expected copies equal the rate."""
    odds = (F.pmod(F.xxhash64("id_", F.lit(17)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    copies = rated.select(F.col("doc_id").alias("id_"), "rate").select("id_", (F.floor("rate") + (odds < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies_")).filter("copies_ > 0")
    # the rows travel in one column, so that no name of theirs can meet one of ours
    rows = docs.select(F.col("doc_id").cast("long").alias("own_"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row_"))
    joined = rows.join(copies, F.col("own_").eqNullSafe(F.col("id_")))
    each = joined.select("row_", F.explode(F.sequence(F.lit(1), "copies_")).alias("copy_"))
    return each.select(*[F.col("row_")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    """op1: tokens, domain posteriors and rate of every document, for the target mix, and how the rounds ended."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    names, found, log = mix(docs, domains_of(labels), TARGETS)
    return found.select("doc_id", "tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(names)], "rate", F.lit(log[-1]["state"]).alias("state"))
