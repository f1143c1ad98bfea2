"""Mixing to target weights with soft membership of domains.

A naive Bayes classifier, counted on a labelled table, gives every document a posterior over
domains. Rates are document multipliers: the expected tokens of a domain are the sum of
rate x tokens x posterior. Projected gradient descent fits rates, not below a floor of zero
or more, so that these totals meet their targets in relative least squares, and ends when all
do or no step helps. Steps are walked in the driver on the totals that one number for every
two domains foretells; a pass over the corpus then gives the true totals. A document's rate
follows from its posterior and the walks so far, so rates are never stored between passes and
nothing is gathered. What a domain still lacks is returned with the rates.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import cut_lineage, spare

BUCKETS = 1 << 15
#: Steps of one walk at most, after which the corpus is read again, and the relative error of every domain at which all ends.
STEPS = 100_000
CLOSE = 0.002
#: A walk ends when a step moves no total by this share of its target, the descent when no step lowers the loss by that share.
STILL = 1e-9
LEAST_GAIN = 1e-3
#: Parts of a token that totals are counted in, and of a posterior in the curvature, as whole numbers, so that their order does not matter.
PARTS = 1024
POSTERIOR_PARTS = 8192
CACHED_WORDS = 400_000

#: Last word of the names of domains that are not to grow.
POOR = "poor"

LOG = logging.getLogger(__name__)

PIECES = regex.compile(r"\p{L}+|[^\p{L}\s]+")


class Buckets(dict):
    """Hash bucket of each piece of text."""

    def __missing__(self, piece: str) -> int:
        value = zlib.crc32(piece.encode()) % BUCKETS
        if len(self) < CACHED_WORDS:
            self[piece] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        pieces = PIECES.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of each domain and bucket in the task's labelled texts; bucket -1 counts the texts."""
    buckets = Buckets()
    sums: dict[str, np.ndarray] = {}
    texts: Counter = Counter()
    for frame in frames:
        for text, domain in zip(frame["text"], frame["domain"], strict=True):
            texts[domain] += 1
            sums[domain] = sums.get(domain, 0) + np.bincount(buckets.of(text), minlength=BUCKETS)
    for domain, of in sums.items():
        some = np.flatnonzero(of)
        yield pd.DataFrame({"domain": domain, "bucket": np.append(-1, some), "n": np.append(texts[domain], of[some])})


class Classifier:
    """Domains in order, log weight of each bucket in each, log prior."""

    def __init__(self, domains: list[str], weights: np.ndarray, prior: np.ndarray) -> None:
        self.domains, self.weights, self.prior = domains, weights, prior

    def posterior(self, found: np.ndarray) -> np.ndarray:
        """Softmax of prior and evidence, the evidence divided by the root of the text's length.

        Pieces of a text hang together; counted as independent they would make every posterior 0 or 1.
        """
        z = self.prior + self.weights[found].sum(axis=0) / max(1.0, len(found)) ** 0.5
        e = np.exp(z - z.max())
        return e / e.sum()


def train(docs: DataFrame, labelled: DataFrame) -> Classifier:
    """Count the classifier on ``labelled`` (doc_id, domain), all its rows and domains; it takes 256 KB a domain."""
    usable = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").select("doc_id", F.col("domain").cast("string").alias("domain"))
    texts = docs.select("doc_id", "text").join(usable, "doc_id").select("text", "domain")
    counts = texts.mapInPandas(_count, "domain string, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts, "counts")
    sizes = counts.where("bucket = -1").collect()
    domains = sorted(r.domain for r in sizes)
    if not domains:
        return Classifier(["all"], np.zeros((BUCKETS, 1)), np.zeros(1))
    frame = counts.toPandas()
    at = {d: i for i, d in enumerate(domains)}
    table = np.zeros((BUCKETS, len(domains)))
    words = frame[frame["bucket"] >= 0]
    table[words["bucket"].to_numpy(), words["domain"].map(at).to_numpy(int)] = words["n"]
    share = np.log(table + 0.5) - np.log(table.sum(axis=0) + 0.5 * BUCKETS)
    number = np.zeros(len(domains))
    number[[at[r.domain] for r in sizes]] = [r.n for r in sizes]
    return Classifier(domains, share, np.log(number / number.sum()))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """Rows (doc_id, body, n_tokens, posterior) for every row; ``body`` is a hash of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for frame in frames:
            found = [buckets.of(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"], "body": frame["body"], "n_tokens": [len(f) for f in found],
                    "posterior": [sent.value.posterior(f).tolist() for f in found],
                }
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, body long, n_tokens long, posterior array<double>")


def rates(posterior: np.ndarray, history: list[np.ndarray], step: float, least: float) -> np.ndarray:
    """Rates after the walks of ``history``: each goes down the summed slopes of the totals' errors and back above the floor."""
    out = np.ones(len(posterior))
    for slope in history:
        out = np.maximum(least, out - step * (posterior @ slope))
    return out


def _totals(table: DataFrame, domains: int, history: list[np.ndarray], step: float, least: float) -> np.ndarray:
    """Expected tokens of each domain under the rates so far."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(domains, np.int64)
        for frame in frames:
            p = np.array(frame["posterior"].tolist()).reshape(-1, domains)
            weight = frame["n_tokens"].to_numpy(float) * rates(p, history, step, least)
            sums += np.rint(p * weight[:, None] * PARTS).astype(np.int64).sum(axis=0)
        yield pd.DataFrame({"domain": np.arange(domains, dtype=np.int32), "total": sums})

    rows = table.select("n_tokens", "posterior").mapInPandas(run, "domain int, total long")
    out = np.zeros(domains)
    for r in rows.groupBy("domain").agg(F.sum("total").alias("total")).collect():
        out[r.domain] = r.total / PARTS
    return out


def _curvature(table: DataFrame, domains: int, history: list[np.ndarray], step: float, least: float, slope: np.ndarray) -> np.ndarray:
    """Tokens x posterior x posterior of every two domains, without documents that the floor keeps from going down ``slope``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((domains, domains))
        for frame in frames:
            p = np.array(frame["posterior"].tolist()).reshape(-1, domains)
            free = (rates(p, history, step, least) > least) | (p @ slope < 0)
            parts = np.rint(p[free] * POSTERIOR_PARTS)
            sums += (parts * frame["n_tokens"].to_numpy(float)[free, None]).T @ parts
        a, b = np.nonzero(sums)
        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "total": sums[a, b].astype(np.int64)})

    rows = table.select("n_tokens", "posterior").mapInPandas(run, "a int, b int, total long")
    out = np.zeros((domains, domains))
    for r in rows.groupBy("a", "b").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
        out[r.a, r.b] = float(r.total) / POSTERIOR_PARTS**2
    return out


def _walk(totals: np.ndarray, wanted: np.ndarray, curvature: np.ndarray, step: float) -> np.ndarray:
    """Sum of the slopes of all steps from ``totals`` until every foretold error is small or nothing moves."""
    slope, now = np.zeros(len(totals)), totals.copy()
    for _ in range(STEPS):
        error = (now - wanted) / wanted
        if np.abs(error).max() <= CLOSE:
            break
        move = step * (curvature @ error)
        slope += error
        now -= move
        if (np.abs(move) / wanted).max() <= STILL:
            break
    return slope


class Fit(NamedTuple):
    """Walks, length of their steps, and of each domain the natural, the wanted and the reached tokens."""

    history: list[np.ndarray]
    step: float
    natural: np.ndarray
    wanted: np.ndarray
    totals: np.ndarray

    @property
    def residual(self) -> np.ndarray:
        """Error of each domain as a share of its target; more than CLOSE only where the floor or mixed posteriors bar the way."""
        return (self.totals - self.wanted) / self.wanted


def fit(table: DataFrame, names: list[str], target, least: float = 0.0) -> Fit:
    """Descend until every domain is close to its target or no step lowers the loss. ``target`` maps natural totals to wanted ones.

    The step is one over the largest eigenvalue of the totals' normal matrix, bounded by
    the largest ratio of natural to wanted tokens, since posteriors sum to one. A walk that
    overshoots, because documents reach the floor on the way, is shortened; at last one step
    is taken, which never overshoots.
    """
    domains = len(names)
    natural = _totals(table, domains, [], 1.0, least)
    wanted = np.maximum(target(natural, names), 1.0)
    step = 1.0 / max(float((natural / wanted).max()), 1e-9)
    loss = lambda totals: float(((totals - wanted) ** 2 / wanted).sum())
    history: list[np.ndarray] = []
    totals, moved = natural, True
    while moved and np.abs((totals - wanted) / wanted).max() > CLOSE:
        error = (totals - wanted) / wanted
        slope = _walk(totals, wanted, _curvature(table, domains, history, step, least, error), step)
        for tried in (slope, slope / 4, slope / 16, error):
            after = _totals(table, domains, [*history, tried], step, least)
            moved = loss(after) < (1 - LEAST_GAIN) * loss(totals)
            if moved:
                history.append(tried)
                totals = after
                break
    found = Fit(history, step, natural, wanted, totals)
    for name, residual in zip(names, found.residual, strict=True):
        if abs(residual) > CLOSE:
            LOG.warning("domain %s ends %+.2f %% from its target", name, 100 * residual)
    return found


def tempered(exponent: float, poor: float, grow: bool = False):
    """Wanted totals from natural ones: domains named poor get ``poor`` times their own, the others a power of theirs.

    The powers are scaled to the others' natural sum, or with ``grow`` to the least sum that lowers none.
    """

    def target(natural: np.ndarray, domains: list[str]) -> np.ndarray:
        bad = np.array([d.endswith(POOR) for d in domains])
        share = np.where(bad, 0.0, np.maximum(natural, 1.0) ** exponent)
        share /= max(share.sum(), 1e-9)
        total = (natural / np.where(share > 0, share, np.inf)).max() if grow else natural[~bad].sum()
        return np.where(bad, poor * natural, share * total)

    return target


def document_rates(docs: DataFrame, labelled: DataFrame, target, least: float = 0.0) -> DataFrame:
    """Rows (doc_id, body, n_tokens, domain, share, rate, residual, copies) for every row.

    ``domain`` is the likeliest one, ``share`` its posterior and ``residual`` the error of its
    total as a share of its target; ``copies`` rounds the rate up or down by a hash of the id,
    so that on average it is the rate. Cases: null and
    empty texts have no tokens and the prior as posterior; without labelled rows all is one
    domain; equal posteriors go to the domain that sorts first; repeated rows have equal
    rates; a null doc_id rounds like id 0; an empty table gives no rows; extra columns are
    ignored.
    """
    model = train(docs, labelled)
    table = cut_lineage(posteriors(docs, model), "posteriors")
    k = len(model.domains)
    found = fit(table, model.domains, target, least)
    history, step, residual = found.history, found.step, found.residual
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = model.domains

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = np.array(frame["posterior"].tolist()).reshape(-1, k)
            best = p.argmax(axis=1)
            out = frame[["doc_id", "body", "n_tokens"]].copy()
            out["domain"] = [names[i] for i in best]
            out["share"] = p[np.arange(len(p)), best]
            out["rate"] = rates(p, history, step, least)
            out["residual"] = residual[best]
            yield out

    rows = table.mapInPandas(run, f"doc_id {kind}, body long, n_tokens long, domain string, share double, rate double, residual double")
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def domain_report(docs: DataFrame, labelled: DataFrame, target, least: float = 0.0) -> DataFrame:
    """Rows (domain, natural, wanted, total, residual), one a domain, also for domains that are likeliest in no document."""
    model = train(docs, labelled)
    found = fit(cut_lineage(posteriors(docs, model), "posteriors"), model.domains, target, least)
    columns = (x.tolist() for x in (found.natural, found.wanted, found.totals, found.residual))
    schema = "domain string, natural double, wanted double, total double, residual double"
    return docs.sparkSession.createDataFrame(list(zip(model.domains, *columns, strict=True)), schema)


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, domain) of the labelled documents: the language and whether the text was found good or poor."""
    picked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality")
    named = F.concat_ws(" ", "lang", F.when(F.col("quality") == 1, "good").otherwise(POOR))
    return docs.where("lang IS NOT NULL").select("doc_id", "lang").join(picked, "doc_id").select("doc_id", named.alias("domain"))


def mix(docs: DataFrame, labelled: DataFrame, target, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its copies say; cases as in ``document_rates``."""
    found = document_rates(docs, labelled, target, least).groupBy("doc_id", "body").agg(F.max("copies").alias("copies"))
    names = {c: spare(docs, c) for c in ("mix_id", "mix_body", "mix_copies")}
    found = found.toDF(*names.values())
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[names["mix_id"]]) & (F.xxhash64(docs["text"]) == found[names["mix_body"]]))
    times = F.explode(F.sequence(F.lit(1), F.col(names["mix_copies"]))).alias(names["mix_copies"])
    return joined.where(F.col(names["mix_copies"]) > 0).select(*[docs[c] for c in docs.columns], times).drop(names["mix_copies"])
