"""Mixing sources to target weights with soft memberships.

A classifier fitted on a labelled table gives each document a posterior over the domains.  A document's rate is how
many times it is to be read; the rates are fitted by projected-gradient least squares so that the expected tokens of
each domain, sum of rate * tokens * posterior, match the targets.  The gradient lives in the domains' few dimensions,
and it is scaled by the inverse of their second-moment matrix over documents above the lower bound, with which a step
that projects nothing more is exact.

A document's rate follows from the steps so far (one number a domain each), so nothing is kept per document and
each round is one aggregation over a narrow table.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import WordCache, mapped, sliced, small_batches, texts, unused, written

BINS = 1 << 15
SAMPLE_ROWS = 4000  # labelled rows that the classifier reads at most
ROUNDS = 25
TOLERANCE = 1e-4


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


@dataclass
class Domains:
    """Naive Bayes over hashed words; its log odds are softened by a factor fitted on held-back rows."""

    names: list[str]
    prior: np.ndarray
    table: np.ndarray  # BINS x domains
    soft: float = 1.0

    def __post_init__(self):
        self.words = WordCache(lambda w: zlib.crc32(w) % BINS)

    def __getstate__(self):
        return {"names": self.names, "prior": self.prior, "table": self.table, "soft": self.soft}

    def __setstate__(self, state):
        self.__init__(**state)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        return self.prior + (self.table[bins].sum(0) / np.sqrt(len(bins)) if len(bins) else 0.0)

    def posterior(self, words: list[bytes]) -> np.ndarray:
        """Over the domains; a text without words gets the prior."""
        z = self.soft * self.logits(np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words)))
        e = np.exp(z - z.max())
        return e / e.sum()


def train(bags: list[np.ndarray], marks: list[str], names: list[str]) -> Domains:
    """A fifth of the rows only fits the softness.  Without labelled rows all domains are equally likely."""
    of = {n: i for i, n in enumerate(names)}
    order = np.random.default_rng(13).permutation(len(bags)).tolist()
    fit, held = order[len(order) // 5 :], order[: len(order) // 5]
    counts, prior = np.full((BINS, len(names)), 0.1), np.ones(len(names))
    for i in fit:
        np.add.at(counts[:, of[marks[i]]], bags[i], 1)
        prior[of[marks[i]]] += 1
    table = np.log(counts / counts.sum(0))
    model = Domains(names, np.log(prior / prior.sum()), table - table.mean(1, keepdims=True))
    if held:
        z, y = np.stack([model.logits(bags[i]) for i in held]), np.array([of[marks[i]] for i in held])
        loss = {}
        for soft in 2.0 ** np.arange(-6, 3):
            s = soft * z
            top = s.max(1)
            loss[soft] = float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(y)), y]).mean())
        model.soft = float(min(loss, key=loss.get))
    return model


def fit(labelled: DataFrame, names: list[str], rows: int = SAMPLE_ROWS) -> Domains:
    """Fits on at most `rows` rows of labelled (doc_id, text, domain); domains that are not named are left out."""
    picked = labelled.where(F.col("domain").isin(names) & F.col("doc_id").isNotNull()).select("doc_id", "domain").orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(rows)
    sample = labelled.select("doc_id", "text").join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id")  # bounded by rows

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "domain": batch.column("domain"), "bins": [[zlib.crc32(w) % BINS for w in words_of(t)] for t in texts(batch)]}

    got = mapped(sample, run, "doc_id long, domain string, bins array<int>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    bins, marks = got.column("bins"), got.column("domain").to_pylist()
    return train([np.asarray(bins[int(i)].values.to_numpy(), dtype=np.int64) for i in order], [marks[i] for i in order], names)


def with_posteriors(rows: DataFrame, model: Domains, key: str, tokens: str, posterior: str) -> DataFrame:
    """key, tokens (words of the whole text) and posterior of each row; rows has key and text."""
    schema = StructType([rows.schema[key], StructField(tokens, LongType()), StructField(posterior, ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            for piece in sliced(batch):
                split = [words_of(t) for t in texts(piece)]
                columns = [piece.column(key), pa.array([len(w) for w in split], pa.int64()), pa.array([model.posterior(w) for w in split], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, tokens, posterior])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def rate(steps: list[list[float]], least: float, posterior: str = "posterior") -> Column:
    """The rate that a document has after the steps, from its posterior: projected after each of them."""
    if not steps:
        return F.lit(1.0)
    all_steps = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda s: F.aggregate(F.zip_with(posterior, s, lambda q, x: q * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(all_steps, F.lit(1.0), lambda r, s: F.greatest(F.lit(float(least)), r - dot(s)))


def fit_rates(features: DataFrame, weights: list[float], least: float = 0.0, total: float | None = None) -> tuple[list[list[float]], list[float]]:
    """The steps that give each document its rate, and the token targets.

    features has tokens and posterior.  Without a total, the targets add up to the smallest number of tokens at which no
    domain has to be thinned.  Rounds end when every domain is within TOLERANCE of all tokens, or when
    no step comes nearer, as the lower bound holds; if after ROUNDS neither is so, a warning says how near the steps came."""
    k = len(weights)
    share = np.array(weights, dtype=float) / sum(weights)
    q = [F.col("posterior")[i] for i in range(k)]
    n = F.col("tokens").cast("double")
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    h = np.zeros((k, k))
    for (i, j), x in zip(upper, features.agg(*[F.sum(n * q[i] * q[j]) for i, j in upper]).first()):
        h[i, j] = h[j, i] = float(x or 0)
    start = h.sum(1)  # expected tokens at rate 1, as posteriors add up to 1
    goal = share * (total if total is not None else float((start / np.maximum(share, 1e-12)).max()))
    steps: list[list[float]] = []
    if start.sum() == 0:
        return steps, goal.tolist()
    solve = lambda m, v: np.linalg.lstsq(m + 1e-9 * np.trace(h) * np.eye(k), v, rcond=None)[0]
    damped = lambda m, part: m + part * np.trace(h) * np.eye(k)
    now, free = start, h
    for _ in range(ROUNDS):
        rest = now - goal
        if np.abs(rest).max() <= TOLERANCE * goal.sum():
            break
        # scaled by the documents that can still move, without and with damping; by all documents; and the gradient as it is
        plain = rest * (rest @ rest) / max(rest @ h @ rest, 1e-300)
        tries = [solve(free, rest), 2 * solve(damped(free, 1e-3), rest), 2 * solve(damped(free, 1e-2), rest), solve(h, rest), plain, 16 * plain]
        tries = [[float(x) for x in np.round(t, 10)] for t in tries]
        got = outcomes(features.select(n.alias("n"), *[q[i].alias(f"q{i}") for i in range(k)], rate(steps, least).alias("r")), tries, k, least, upper)
        best = min(range(len(tries)), key=lambda i: float(((got[i][0] - goal) ** 2).sum()))
        if ((got[best][0] - goal) ** 2).sum() >= (1 - 1e-3) * (rest**2).sum():
            break  # as near as the bound lets rates come
        steps.append(tries[best])
        now, free = got[best]
    else:
        warnings.warn(f"mixing: after {ROUNDS} rounds a domain's tokens miss their target by {np.abs(now - goal).max() / goal.sum():.2%} of all", stacklevel=2)
    return steps, goal.tolist()


def outcomes(rows: DataFrame, tries: list[list[float]], k: int, least: float, upper: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step that might be next: the domains' expected tokens, and the second moments of the documents above the
    bound.  One aggregation for all; rows has n, q0.. and r, the rate so far."""
    after = lambda t: F.greatest(F.lit(float(least)), F.col("r") - sum((F.col(f"q{i}") * F.lit(x) for i, x in enumerate(t)), F.lit(0.0)))
    moved = rows.select("*", *[after(t).alias(f"r{c}") for c, t in enumerate(tries)])
    sums = []
    for c in range(len(tries)):
        sums += [F.sum(F.expr(f"r{c} * n * q{i}")) for i in range(k)]
        sums += [F.sum(F.expr(f"if(r{c} > {least!r}D, n * q{i} * q{j}, 0D)")) for i, j in upper]
    flat = [float(x or 0) for x in moved.agg(*sums).first()]
    out, size = [], k + len(upper)
    for c in range(len(tries)):
        own, second = flat[c * size : (c + 1) * size], np.zeros((k, k))
        for (i, j), x in zip(upper, own[k:]):
            second[i, j] = second[j, i] = x
        out.append((np.array(own[:k]), second))
    return out


def rates(docs: DataFrame, model: Domains, weights: dict[str, float], least: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain, rate.

    A null or empty text has no tokens and the prior as posterior; its rate follows the same rule.  Repeated rows and
    null ids are rows like any other; an empty table gives an empty one."""
    features = written(with_posteriors(docs.select("doc_id", "text"), model, "doc_id", "tokens", "posterior"), "mix-features")
    steps, _ = fit_rates(features, [weights[n] for n in model.names], least)
    return features.select("doc_id", F.col("tokens").alias("n_tokens"), *[F.col("posterior")[i].alias(f"p_{n}") for i, n in enumerate(model.names)], rate(steps, least).alias("rate"))


def mixed(docs: DataFrame, model: Domains, weights: dict[str, float], least: float = 1.0) -> DataFrame:
    """The rows of docs, all columns, each as often as its rate says; what lies between two whole numbers is settled by a
    hash of id and text.  With least = 1 no document is lost.

    The classifier reads each text once: rows are written with their posterior before the rates are fitted.  A null or
    empty text has no tokens and the prior as posterior; repeated rows and null ids are rows like any other; an empty table
    gives an empty one; columns of any name go through."""
    row, posterior, tokens, times = (unused(docs, n) for n in ("_row", "_posterior", "_tokens", "_times"))
    read = written(with_posteriors(docs.select(F.struct("*").alias(row), "text"), model, row, tokens, posterior), "mix-rows")
    steps, _ = fit_rates(read.select(F.col(tokens).alias("tokens"), F.col(posterior).alias("posterior")), [weights[n] for n in model.names], least)
    r = rate(steps, least, posterior)
    chance = F.pmod(F.xxhash64(F.col(row)["doc_id"], F.col(row)["text"], F.lit(41)), F.lit(1_000_000)) / 1_000_000
    copies = (F.floor(r) + (chance < r - F.floor(r)).cast("int")).cast("int")
    return read.select(row, F.explode(F.array_repeat(F.lit(0), copies)).alias(times)).select(f"{row}.*")
