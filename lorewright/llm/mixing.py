"""Operator 3, mixing to target weights with soft domain membership.

A classifier fitted on a labelled table (id, domain) predicts each document's domain posteriors. Then nonnegative
document rates are fitted by projected gradient least squares, such that the domain token totals expected under the
posteriors match the targets. A rate depends on a document's own tokens and posteriors and on the gradients of the
steps so far, which are as many numbers as there are domains; so each step is one map over the documents and a sum of
a few numbers, and no rate is stored between steps.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, chunks, map_text, read_table, text_bytes, written
from .linear import fit, margins
from .words import scan

#: Labelled documents of each domain that the classifier is fitted on at most.
PER_DOMAIN = 800
#: Exponent that flattens the corpus's own domain shares where no targets are given.
FLATTEN = 0.7
STEPS, TOLERANCE = 200, 1e-6
#: A fit ends where its residual has fallen by less than this share over ``PATIENCE`` steps: no rates come nearer.
PROGRESS, PATIENCE = 2e-3, 5
#: A domain whose total misses its target by more than this share is reported.
MISS = 0.01
#: Domains at most: each has a weight vector of a megabyte.
MOST_DOMAINS = 64


@dataclass
class Mix:
    """Rated rows, and for each domain its target, the total that the rates reach, and the miss as a share of the target
    (of all tokens of the corpus, where the target is zero)."""

    rows: DataFrame
    domains: list[str]
    targets: np.ndarray
    reached: np.ndarray
    miss: np.ndarray


def train_domains(docs: DataFrame, labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", domain: str = "domain", per_domain: int = PER_DOMAIN) -> tuple[list[str], np.ndarray | None]:
    """The domains in order and the weights of a classifier, from ``docs`` whose ids ``labelled`` gives a domain.

    Null ids and null domains of the labelled table are passed over; without labels there is one domain, ``all``, and no
    weights. More than ``MOST_DOMAINS`` domains are an error.
    """
    marks = labelled.where(F.col(doc_id).isNotNull() & F.col(domain).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(domain).cast("string").alias("label")).distinct()
    rank = F.xxhash64(F.col("__id").cast("string"))
    keep = F.lit(False)
    counts = marks.groupBy("label").count().limit(MOST_DOMAINS + 1).collect()
    if len(counts) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains; each has a weight vector of its own")
    for row in counts:
        share = min(1.0, 2 * (per_domain + 6 * per_domain**0.5 + 10) / row["count"])
        keep = keep | ((F.col("label") == row.label) & (rank <= int(-(2**63) + min(share * 2**64, 2**64 - 1))))
    few = F.broadcast(marks.where(keep))  # about 4 * per_domain ids of each domain at any corpus size
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("text")).join(few, "__id").select("label", "text", rank.alias("rank"))
    domains, weights = fit(texts, per_class=per_domain)
    return (["all"], None) if weights is None else (domains, weights)


def posteriors(docs: DataFrame, weights: np.ndarray | None, *, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` (words of the whole text) and ``posteriors`` (one per domain, sum 1; without weights one)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value

        def work(said: pa.Array) -> list[pa.Array]:
            data, offs = text_bytes(said)
            words = [np.bincount(scan(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]).row, minlength=b - a) for a, b in chunks(offs)]
            if w is None:
                p = np.ones((len(said), 1))
            else:
                p = 1.0 / (1.0 + np.exp(-np.clip(margins(said, w), -30, 30)))
                p /= p.sum(axis=1, keepdims=True)
            p = np.round(p, 9)
            return [pa.array(np.concatenate(words) if words else np.zeros(0), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))]

        return work

    return map_text(docs, text, make, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))]), carry_text)


def _rates(n: np.ndarray, p: np.ndarray, path: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps of ``path``: each is a vector over domains, in units of a rate per token share."""
    w = np.ones(len(n))
    for step in path:
        w = np.maximum(0.0, w - n * (p @ step))
    return w


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
    return n, np.asarray(batch.column(1).flatten()).reshape(len(n), -1)


def scales(targets: np.ndarray, corpus: float) -> np.ndarray:
    """What a domain's miss is measured by: its target, or the tokens of the corpus where that is zero."""
    return np.where(targets > 0, targets, max(corpus, 1.0)).astype(float)


def fit_rates(table: DataFrame, targets: np.ndarray, *, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of the projected gradient on the squared relative miss of the targets, from rates of one; the totals reached.

    ``table`` has ``n_tokens`` and ``posteriors``. The miss of a domain is taken relative to :func:`scales`. Each step tries
    several lengths in one pass and takes the best: shares of the step in the metric of the domains' Gram matrix over
    the documents whose rate is not zero (exact while no further rate meets zero), and the plain gradient with the inverse
    of the first matrix's largest eigenvalue as its length, which never makes things worse. The fit ends within
    ``tolerance``, or where a step gains little: then nonnegative rates that meet the targets do not exist, and the very
    best ones would put all weight on the few documents that are purest.
    """
    table = table.select("n_tokens", "posteriors")
    k = len(targets)

    def reduced(f, width: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                total += f(*_arrays(batch)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["i", "v"])

        sums = table.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for row in sums:
            out[row.i] = row.v
        return out

    corpus = float(reduced(lambda n, p: np.array([n.sum()]), 1)[0])
    weight = 1.0 / scales(targets, corpus)

    def states(path: list[np.ndarray], tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each step behind ``path``: totals reached, and the Gram matrix of the documents whose rate is not held at zero."""

        def sums(n, p, path=tuple(path), tried=tuple(tried)):
            before = _rates(n, p, path)
            out = []
            for step in tried:
                w = before if step is None else np.maximum(0.0, before - n * (p @ step))
                a = p * n[:, None] * weight
                a = a[w > 0]
                out += [(p * (n * w)[:, None]).sum(axis=0), (a.T @ a).ravel()]
            return np.concatenate(out)

        got = reduced(sums, len(tried) * (k + k * k)).reshape(len(tried), k + k * k)
        return [(row[:k], row[k:].reshape(k, k)) for row in got]

    def residual(totals: np.ndarray) -> float:
        return float(np.linalg.norm((totals - targets) * weight))

    path: list[np.ndarray] = []
    ((reached, gram),) = states(path, [None])
    plain = np.eye(k) / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-30)
    before = [residual(reached)]
    for _ in range(steps):
        miss = (reached - targets) * weight
        if float(np.abs(miss).max(initial=0.0)) <= tolerance:
            break
        newton = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
        tried = [weight * (metric @ miss) for metric in (newton, newton / 2, newton / 8, 8 * plain, plain)]
        made = states(path, tried)
        best = min(range(len(tried)), key=lambda i: residual(made[i][0]))
        if residual(made[best][0]) >= before[-1]:
            break
        path, (reached, gram) = [*path, tried[best]], made[best]
        before.append(residual(reached))
        if len(before) > PATIENCE and before[-1] > (1 - PROGRESS) * before[-1 - PATIENCE]:
            break
    return path, reached


def flattened(totals: np.ndarray, power: float = FLATTEN) -> np.ndarray:
    """Targets with shares proportional to the totals' shares to ``power``, of the smallest sum that takes from no domain."""
    if not totals.sum() > 0:
        return totals
    share = (totals / totals.sum()) ** power
    share /= share.sum()
    there = totals > 0
    return share * (totals[there] / share[there]).max()


def fit_mix(docs: DataFrame, labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", domain: str = "domain", targets: dict[str, float] | None = None, power: float = FLATTEN, carry_text: bool = True, steps: int = STEPS) -> Mix:
    """``docs`` with ``n_tokens``, ``posteriors``, ``rate`` (nonnegative) and ``copies``, and what the rates reach.

    ``targets`` are token totals by domain, zero for those not named; without them they are the corpus's own totals,
    flattened. ``copies`` is the rate rounded up or down by a hash of the id and the text, such that it is the rate in
    expectation. A text without words (null, empty) adds to no total and keeps the rate one. Equal texts have equal rates;
    repeated rows are rated one by one, and those with a null id by their text alone. Of domains at the same posterior none
    is preferred. Other columns are carried; those four of the input are replaced. Targets that nonnegative rates cannot
    meet (a total from a domain that no document belongs to, two that contradict each other) are approached as the least
    squares say; a miss above ``MISS`` is in ``miss`` and raises a warning. A target that is not among the domains, or is
    negative, is an error.
    """
    made = ["n_tokens", "posteriors", "rate", "copies"]
    domains, weights = train_domains(docs, labelled, doc_id=doc_id, text=text, domain=domain)
    unknown = sorted(set(targets or {}) - set(domains))
    if unknown or any(v < 0 for v in (targets or {}).values()):
        raise ValueError(f"targets must be nonnegative and of known domains; not known: {unknown}, known: {domains}")
    rated = table = written(posteriors(docs, weights, text=text, carry_text=carry_text))
    k = len(domains)
    now = table.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("posteriors")[i]), F.lit(0.0)).alias(f"d{i}") for i in range(k)]).first()
    totals = np.array([float(x) for x in now])
    wanted = flattened(totals, power) if targets is None else np.array([float(targets.get(d, 0.0)) for d in domains])
    path, reached = fit_rates(table, wanted, steps=steps)
    miss = np.abs(reached - wanted) / scales(wanted, float(totals.sum()))
    if (miss > MISS).any():
        missed = {d: round(float(m), 4) for d, m in zip(domains, miss, strict=True) if m > MISS}
        warnings.warn(f"no nonnegative rates meet these targets; the totals miss them by these shares: {missed}", stacklevel=2)
    taken = F.lit([[float(x) for x in step] for step in path]) if path else F.array().cast("array<array<double>>")

    def moved(w, step):
        along = F.aggregate(F.zip_with("posteriors", step, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        return F.greatest(F.lit(0.0), w - F.col("n_tokens") * along)

    rate = F.aggregate(taken, F.lit(1.0), moved)
    keep = [c for c in carried(docs, made) if carry_text or c != text]
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "n_tokens", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    out = rated.select(*[f"`{c}`" for c in keep], "n_tokens", "posteriors", F.round(rate, 9).alias("rate"))
    return Mix(out.withColumn("copies", F.floor(F.col("rate") + draw).cast("int")), domains, wanted, reached, miss)


def mix_to_targets(docs: DataFrame, labelled: DataFrame, **asked) -> DataFrame:
    """The rows of :func:`fit_mix`, with the same parameters."""
    return fit_mix(docs, labelled, **asked).rows


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table is each document's language; all languages are domains, their shares flattened."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return mix_to_targets(docs.select("doc_id", "text"), docs.select("doc_id", F.col("lang").alias("domain")), carry_text=False)
