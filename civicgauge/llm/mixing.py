"""Operator 6: mixing sources to target weights with soft domain membership. DataFrame functions only.

A naive Bayes classifier over hashed words, learnt from a labelled table, gives each document a posterior for each domain.
A document's expected tokens in a domain are its tokens times that posterior. Nonnegative rates of the documents are then
fitted by projected-gradient least squares, starting from 1, until the expected token totals of the domains match their
targets: each step takes the domains' misses (a handful of sums over all documents), turns them into a step by the
domains' own overlap, moves each document's rate along its posteriors and cuts it at 0. In the metric of the overlap over all
documents the step length 1 is safe; the overlap over the documents that are not cut gives longer steps, and is used as long
as they help.

A rate is a function of the posteriors and of the misses so far, so no rates are stored between the steps: a step is one
aggregate over the table of posteriors, which is narrow and written once.

Rates become copies: the whole part, and one more where the hash of the id falls under the fraction. The total follows the
target weights and is at least the input's; it is raised until no domain named in ``keep`` is cut. ``least`` bounds the rates
from below: 0, or 1 where no document may go and only repeats make the mixture.

Training rows are labelled rows, at most ``train_rows`` (smallest id hashes). The classifier's table has at most
``buckets`` rows. Word evidence is tempered to ``evidence`` words a document, so that long texts do not become certain
by chance alone.

Defined results: a null or empty text has no tokens, the prior's posteriors and a rate like any other; without training
rows all posteriors are equal; a label that is null is none, and of several labels of one id the smallest counts; a domain
without any mass is left out of the fit; repeated rows each get their rate and the same copies if they share id and text;
an empty table gives an empty table. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgauge.llm.grams import BUCKETS, bounded_labels, gram_buckets, labelled_once, with_word_hashes
from civicgauge.session import durable

TRAIN_ROWS = 50_000
EVIDENCE = 200.0
SHRINK = 20.0
STEPS, CLOSE = 40, 1e-4
#: Domains of ``labels`` and the shares of tokens they are to have.
TARGETS = {"clean": 0.96, "toxic": 0.02, "low": 0.02}


def domain_of_labels() -> Column:
    """Domain of a row of ``labels``: ``low`` for quality 0, else ``toxic`` or ``clean``."""
    return F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")


def learn_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = BUCKETS, train_rows: int = TRAIN_ROWS,
                  text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Classifier table: ``bucket`` (-1 for the prior) and an array: each domain's log odds against the words of all domains."""
    chosen = bounded_labels(labelled, train_rows, id_column).select(F.col(id_column).alias("label_id"), "domain")
    chosen_rows = docs.select(F.col(id_column).alias("row_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("row_id") == F.col("label_id"))
    grams = with_word_hashes(chosen_rows).select("domain", F.explode(F.concat(
        F.array(F.lit(-1)), gram_buckets(F.col("word_hashes"), buckets, pairs=False))).alias("bucket"))
    counts = durable(grams.groupBy("bucket").agg(*(F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains))), "domain-counts")
    words = [counts.agg(F.coalesce(F.sum(F.when(F.col("bucket") >= 0, F.col(f"n{i}"))), F.lit(0))).scalar() for i in range(len(domains))]
    rows = [counts.agg(F.coalesce(F.sum(F.when(F.col("bucket") < 0, F.col(f"n{i}"))), F.lit(0))).scalar() for i in range(len(domains))]
    # Observed over expected words, both raised by SHRINK: what is rare in the labelled rows speaks for no domain.
    every = sum(F.col(f"n{i}") for i in range(len(domains)))
    all_words, all_docs = sum(words), sum(rows)
    rates = F.array(*(F.log((F.col(f"n{i}") + SHRINK) / (every * words[i] / F.greatest(all_words, F.lit(1)) + SHRINK)) for i in range(len(domains))))
    prior = F.array(*(F.log((rows[i] + 1) / (all_docs + len(domains))) for i in range(len(domains))))
    return counts.select("bucket", F.when(F.col("bucket") < 0, prior).otherwise(rates).alias("logs"))


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str], buckets: int = BUCKETS, evidence: float = EVIDENCE,
               text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``row_number``, id, ``text_hash``, ``n_tokens`` (words) and an array ``p`` of the domains' posteriors for each row."""
    rows = with_word_hashes(docs.select(F.monotonically_increasing_id().alias("row_number"), F.col(id_column), F.col(text).alias("text")))
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    words = rows.select("row_number", id_column, "text_hash", F.size("word_hashes").cast("long").alias("n_tokens"), F.explode(
        F.concat(F.array(F.lit(-1)), gram_buckets(F.col("word_hashes"), buckets, pairs=False))).alias("bucket"))
    met = words.join(F.broadcast(model), "bucket", "left")
    log = [F.col("logs")[i] for i in range(len(domains))]
    sums = met.groupBy("row_number", id_column, "text_hash", "n_tokens").agg(
        *(F.sum(F.when(F.col("bucket") >= 0, x)).alias(f"w{i}") for i, x in enumerate(log)),
        *(F.sum(F.when(F.col("bucket") < 0, x)).alias(f"b{i}") for i, x in enumerate(log)))
    tempered = F.least(F.lit(1.0), F.lit(evidence) / F.greatest(F.col("n_tokens"), F.lit(1)))
    logs = [F.coalesce(F.col(f"b{i}"), F.lit(0.0)) + tempered * F.coalesce(F.col(f"w{i}"), F.lit(0.0)) for i in range(len(domains))]
    best = F.greatest(*logs) if len(logs) > 1 else logs[0]
    powers = sums.select("row_number", id_column, "text_hash", "n_tokens", F.array(*(F.exp(x - best) for x in logs)).alias("e"))
    total = sum(F.col("e")[i] for i in range(len(domains)))
    return powers.select("row_number", id_column, "text_hash", "n_tokens", F.array(*(F.col("e")[i] / total for i in range(len(domains)))).alias("p"))


def rate_of(steps: list[list[float]], least: float = 0.0) -> Column:
    """Rate of a row after the steps so far, cut at ``least`` after each."""
    if not steps:
        return F.lit(1.0)
    n = len(steps[0])
    taken = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in steps))
    return F.aggregate(taken, F.lit(1.0), lambda rate, step: F.greatest(F.lit(float(least)), rate - sum(F.col("p")[i] * step[i] for i in range(n))))


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gauss elimination for as many unknowns as there are domains; a domain without mass gets 0."""
    n = len(right)
    rows = [[*row, value] for row, value in zip(matrix, right)]
    size = max((abs(x) for row in matrix for x in row), default=0.0) or 1.0
    done: dict[int, int] = {}
    for column in range(n):
        free = [i for i in range(n) if i not in done.values()]
        pivot = max(free, key=lambda i: abs(rows[i][column]))
        if abs(rows[pivot][column]) <= 1e-12 * size:
            continue
        done[column] = pivot
        for i in range(n):
            if i != pivot and rows[i][column]:
                factor = rows[i][column] / rows[pivot][column]
                rows[i] = [x - factor * y for x, y in zip(rows[i], rows[pivot])]
    return [rows[done[c]][n] / rows[done[c]][c] if c in done else 0.0 for c in range(n)]


def fit_rates(members: DataFrame, domains: list[str], targets: Mapping[str, float], keep: Sequence[str] = (), least: float = 0.0,
              steps: int = STEPS, close: float = CLOSE) -> list[list[float]]:
    """Steps whose ``rate_of`` brings the domains' expected tokens to their targets. ``members``: posteriors, read once a step."""
    n, tokens = len(domains), F.col("n_tokens")
    masses = [tokens * F.col("p")[i] for i in range(n)]

    def totals(rate: Column) -> tuple[list[float], list[list[float]]]:
        """Expected tokens of the domains, and their overlap on rows whose rate is free to move down."""
        weight = tokens * (F.col("rate") > least).cast("int")
        row = members.select("n_tokens", "p", rate.alias("rate")).agg(
            *(F.sum(m * F.col("rate")).alias(f"m{i}") for i, m in enumerate(masses)),
            *(F.sum(weight * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i + 1))).first()
        return ([float(row[f"m{i}"] or 0.0) for i in range(n)],
                [[float(row[f"g{max(i, j)}_{min(i, j)}"] or 0.0) for j in range(n)] for i in range(n)])

    mass, _ = now, overlap = totals(F.lit(1.0))
    if least >= 1.0:  # all rows start at their bound
        whole = members.agg(*(F.sum(masses[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i + 1))).first()
        overlap = [[float(whole[f"g{max(i, j)}_{min(i, j)}"] or 0.0) for j in range(n)] for i in range(n)]
    whole_overlap, miss = overlap, None
    weights = [targets[d] / sum(targets[x] for x in domains) for d in domains]
    total = sum(mass)
    total = max([total, *(mass[i] / weights[i] for i, d in enumerate(domains) if d in keep and weights[i] > 0)])
    aims = [w * total if mass[i] > 1e-9 * total else 0.0 for i, w in enumerate(weights)]
    taken: list[list[float]] = []
    while total and len(taken) < steps:
        before, miss = miss, max(abs(a - b) for a, b in zip(now, aims))
        if miss <= close * total:
            break
        # The overlap of the free rows gives long steps; where one did not help, that of all rows gives a safe one.
        metric = overlap if before is None or miss < 0.9 * before else whole_overlap
        taken.append(solve(metric, [a - b for a, b in zip(now, aims)]))
        now, overlap = totals(rate_of(taken, least))
    return taken


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, keep: Sequence[str] = ("clean",), least: float = 0.0, buckets: int = BUCKETS,
        train_rows: int = TRAIN_ROWS, evidence: float = EVIDENCE, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``row_number``, id, ``text_hash``, ``n_tokens``, ``p_<domain>``, ``rate`` and ``copies`` of each row.

    ``labelled`` has the id and ``domain``; ``targets`` names the domains and their shares of tokens.
    """
    domains = list(targets)
    known = labelled_once(labelled.filter(F.col("domain").isin(domains)), {"domain": F.col("domain")}, id_column)
    model = learn_domains(docs, known, domains, buckets, train_rows, text, id_column)
    members = durable(posteriors(docs, model, domains, buckets, evidence, text, id_column), "domain-members")
    rate = rate_of(fit_rates(members, domains, targets, keep, least), least)
    # The hash of id and row takes one of a million values.
    draw = (F.pmod(F.xxhash64(F.col(id_column), F.lit("copies")), F.lit(1_000_000)) + 0.5) / 1_000_000
    return members.select("row_number", id_column, "text_hash", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), rate.alias("rate")).withColumn(
        "copies", F.floor(F.col("rate")) + (draw < F.col("rate") - F.floor(F.col("rate"))).cast("long"))


def repeat(docs: DataFrame, mixed: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` as often as ``copies`` says, with all its columns."""
    copies = mixed.select(F.col(id_column).alias("mixed_id"), F.col("text_hash").alias("mixed_hash"), "copies").dropDuplicates(["mixed_id", "mixed_hash"])
    same = F.col(id_column).eqNullSafe(F.col("mixed_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("mixed_hash"))
    met = docs.join(copies, same).select(*(docs[c] for c in docs.columns), F.col("copies").alias("copies of a row"))
    return met.withColumn("copy of a row", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies of a row"), F.lit(1))))).filter(
        F.col("copies of a row") > 0).select(*docs.columns)
