"""Mixing documents to target weights of domains, with soft membership and fitted rates, all in built-in functions.

A naive Bayes classifier over words learns from a table of labelled documents which words speak for which domain. Every
document gets a posterior over the domains; as single words are far from independent, the evidence is tempered: it
counts as EVIDENCE words at most. With tokens t and posterior p of a document, rate x contributes x * t * p to the
domains' totals, and projected-gradient steps fit rates between two bounds so that these totals match the targets:

    minimise  1/2 |sum(x t p) / T - target|^2   over  least <= x <= most,  starting from x = 1

A step is x <- min(most, max(least, x - <p, M^-1 r>)) with the current residual r and the fixed K x K matrix M = sum(t p p') / T as its
metric. Each step is one distributed sum of K numbers; only those, and M, come to the driver (K domains, at most MOST_DOMAINS;
more raise an error before anything is fitted). The step that came closest is kept. Every repeated row counts with its tokens.

The vocabulary is bounded (VOCABULARY words, most frequent first), so it is broadcast; words are counted within the
row's task before anything is shuffled, and documents are keyed by their own id, so a hot source or domain is no key of any shuffle.

With rates of at least 1, as a pipeline that drops nothing asks for, scarce domains are repeated until the shares fit, but no document
more than ``most`` times: of a domain that is nearly absent the target is then missed, and the shares that were reached are what they are.

Defined cases: null and empty texts have no tokens, the prior as posterior, and the rate that this gives; labelled rows with a null domain
teach nothing; without any labelled row all rates are 1; a domain of no target weight has target 0; equal rows get equal rates; other
columns pass through, whatever their names (but for the three that are added, which are replaced); an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import checkpoint, free_names

#: Documented bounds: labelled documents that are learned from, words of the vocabulary, and domains.
SAMPLE = 2000
VOCABULARY = 2000
MOST_DOMAINS = 64
#: Words that a text's evidence counts as at most.
EVIDENCE = 1.0
STEPS = 25
TOLERANCE = 1e-6
#: Rate that no document exceeds, and so the bound of its repeats.
MOST = 8.0

_SPLIT = r"[\x00-\x20]+"


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SPLIT), lambda w: w != "")


def learn(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", sample: int = SAMPLE) -> tuple[DataFrame, list[str], list[float]]:
    """(word, weights) per word of the vocabulary, the domains, and the logarithms of their shares in the sample.

    labelled: key and domain. The sample is chosen by the hash of the key; only its documents' texts are looked up.
    """
    known = labelled.filter(F.col(domain).isNotNull() & F.col(key).isNotNull()).select(key, F.col(domain).cast("string").alias("d")).distinct()
    keys = checkpoint(known.orderBy(F.xxhash64(key), key, "d").limit(sample))
    # keys has SAMPLE rows at most
    chosen = checkpoint(docs.select(key, F.col(text).alias("text")).join(F.broadcast(keys), key).select("d", "text"))
    shares = {r["d"]: r["n"] for r in chosen.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy("d").limit(MOST_DOMAINS + 1).collect()}
    if len(shares) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    domains, total = list(shares), sum(shares.values())
    counts = chosen.select("d", F.explode(words_of("text")).alias("word")).groupBy("word").agg(*(F.count_if(F.col("d") == d).alias(f"n{k}") for k, d in enumerate(domains)), F.count(F.lit(1)).alias("n"))
    top = checkpoint(counts.orderBy(F.desc("n"), "word").limit(VOCABULARY))
    sums = top.agg(*(F.sum(f"n{k}").alias(f"s{k}") for k in range(len(domains)))).first() if domains else None
    weights = F.array(*(F.log((F.col(f"n{k}") + 0.5) / F.lit(float((sums[k] or 0) + 0.5 * VOCABULARY))) for k in range(len(domains)))) if domains else F.array().cast("array<double>")
    return top.select("word", weights.alias("weights")), domains, [float(np.log(shares[d] / total)) for d in domains]


def posteriors(docs: DataFrame, vocabulary: DataFrame, prior: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, tokens, copies, p): one row per distinct id and text, with the number of its rows and the tokens of one of them."""
    k = len(prior)
    keyed = docs.select(_key(key, text).alias("_key"), words_of(text).alias("words"))
    tokens = keyed.select("_key", F.size("words").cast("bigint").alias("n"), F.posexplode_outer("words").alias("pos", "word"))
    # the vocabulary has VOCABULARY rows at most
    scored = tokens.join(F.broadcast(vocabulary), "word", "left")
    # each row has one first word, or one row without any
    rows = F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0)
    sums = scored.groupBy("_key", "n").agg(rows.alias("copies"), F.count("weights").alias("known"), *(F.sum(F.get("weights", F.lit(i))).alias(f"l{i}") for i in range(k)))
    # words and their weights were summed over all rows of the key; their mean is the same for one of them
    scale = F.lit(EVIDENCE) / F.greatest(F.col("known") / F.col("copies"), F.lit(EVIDENCE)) / F.col("copies")
    logs = [F.lit(prior[i]) + F.coalesce(F.col(f"l{i}") * scale, F.lit(0.0)) for i in range(k)]
    top = F.greatest(*logs) if k > 1 else logs[0]
    exps = sums.select("_key", F.col("n").alias("tokens"), "copies", F.array(*(F.exp(x - top) for x in logs)).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return exps.select("_key", "tokens", "copies", F.transform("e", lambda x: x / total).alias("p"))


def fit_rates(rows: DataFrame, target: np.ndarray, least: float = 0.0, most: float = MOST, steps: int = STEPS) -> tuple[Column, np.ndarray]:
    """The rate of each row of (tokens, copies, p) as an expression, and the shares that the rates give."""
    k = len(target)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    t = (F.col("tokens") * F.col("copies")).cast("double")
    first = rows.agg(F.sum(t).alias("t"), *(F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    total = first["t"] or 0.0
    bounded = lambda x: F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), x))
    rate = bounded(F.lit(1.0))
    if not total or not k:
        return rate, target * 0
    metric = np.array([[first[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    inverse = np.linalg.pinv(metric, rcond=1e-9, hermitian=True)
    best, best_rate, best_shares = np.inf, rate, target
    for _ in range(steps):
        sums = rows.agg(*(F.sum(rate * t * p[i]).alias(f"s{i}") for i in range(k))).first()
        shares = np.array([sums[f"s{i}"] for i in range(k)]) / total
        residual = shares - target
        error = float(residual @ residual)
        gained = best - error
        if error < best:
            best, best_rate, best_shares = error, rate, shares
        if error < TOLERANCE**2 or gained < 1e-4 * error and best < np.inf and gained < TOLERANCE**2:
            break
        step = inverse @ residual
        rate = bounded(rate - sum((p[i] * float(step[i]) for i in range(k)), F.lit(0.0)))
    return best_rate, best_shares


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", least: float = 0.0, most: float = MOST) -> DataFrame:
    """(_key, n_tokens, domain_posteriors, rate) per distinct id and text; _key holds the id and the hash of the text.

    labelled: key and domain of documents whose domain is known.
    No rate is below least or over most. targets gives weights of domains. With least > 0 the totals grow as far as the domain that is scarcest needs, so that the
    weights can be matched without any rate below least.
    """
    vocabulary, domains, prior = learn(docs, labelled, key, text, domain)
    if not domains:
        none = F.create_map().cast("map<string,double>")
        return docs.select(_key(key, text).alias("_key"), F.size(words_of(text)).cast("bigint").alias("n_tokens")).distinct().select("_key", "n_tokens", none.alias("domain_posteriors"), F.lit(float(max(1.0, least))).alias("rate"))
    weights = np.array([max(targets.get(d, 0.0), 0.0) for d in domains])
    rows = checkpoint(posteriors(docs, vocabulary, prior, key, text))
    weights = weights / weights.sum() if weights.sum() else np.exp(prior)
    if least > 0:
        tokens = F.col("tokens") * F.col("copies")
        sums = rows.agg(F.sum(tokens).alias("t"), *(F.sum(tokens * F.get("p", F.lit(i))).alias(f"s{i}") for i in range(len(domains)))).first()
        now = np.array([sums[f"s{i}"] or 0.0 for i in range(len(domains))]) / max(sums["t"] or 1, 1)
        weights = weights * max([1.0, *(least * n / w for n, w in zip(now, weights) if w > 0)])
    rate, _ = fit_rates(rows, weights, least, most)
    named = F.map_from_arrays(F.array(*(F.lit(d) for d in domains)), F.col("p"))
    return rows.select("_key", F.col("tokens").alias("n_tokens"), named.alias("domain_posteriors"), rate.alias("rate"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", least: float = 0.0, most: float = MOST) -> DataFrame:
    """docs without the text, with n_tokens, domain_posteriors (domain to share) and rate."""
    added = ("n_tokens", "domain_posteriors", "rate")
    kept = [c for c in docs.columns if c != text and c not in added]
    own, other = free_names(docs, "own_key", "rated_key")
    rated = rates(docs, labelled, targets, key, text, domain, least, most).withColumnRenamed("_key", other)
    keyed = docs.select(*kept, _key(key, text).alias(own))
    return keyed.join(rated, F.col(own).eqNullSafe(F.col(other)), "left").select(*kept, *added)


def apply_rates(docs: DataFrame, rated: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, each row as many times as its rate says; the hash of its id and text decides the fraction."""
    own, other, rate, copy = free_names(docs, "own_key", "rated_key", "rate", "copy")
    share = F.pmod(F.xxhash64(key, text, F.lit(6)), F.lit(1 << 20)) / float(1 << 20)
    found = rated.select(F.col("_key").alias(other), F.col("rate").alias(rate))
    keyed = docs.select("*", _key(key, text).alias(own)).join(found, F.col(own).eqNullSafe(F.col(other)), "left")
    copies = F.floor(F.coalesce(F.col(rate), F.lit(1.0)) + share).cast("int")
    return keyed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def _key(key: str, text: str) -> Column:
    return F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("text"))
