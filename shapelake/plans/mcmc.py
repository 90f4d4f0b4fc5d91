"""Markov-chain sampling: proposals and evaluators as NumPy functions, many chains as a grouped table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

State = np.ndarray
Evaluator = Callable[[State], float]


@dataclass(frozen=True)
class Proposal:
    """propose(state, rng) -> (state, label); log_ratio(from, to): log probability of the step."""

    propose: Callable[[State, np.random.Generator], tuple[State, str]]
    log_transition: Callable[[State, State], float]
    symmetric: bool = True

    def relabel(self, label: str) -> Proposal:
        return Proposal(lambda s, rng: (self.propose(s, rng)[0], label), self.log_transition, self.symmetric)

    def log_ratio(self, a: State, b: State) -> float:
        """log q(a to b) - log q(b to a)."""
        return 0.0 if self.symmetric else self.log_transition(a, b) - self.log_transition(b, a)


def identity() -> Proposal:
    return Proposal(lambda s, rng: (s, "Identity"), lambda a, b: 0.0 if np.array_equal(a, b) else -math.inf)


def random_walk(sd: float, label: str = "", at: Sequence[int] | None = None) -> Proposal:
    """Gaussian random walk on all components, or on those listed."""

    def propose(s: State, rng: np.random.Generator) -> tuple[State, str]:
        out = np.array(s, float)
        k = slice(None) if at is None else list(at)
        out[k] += rng.standard_normal(out[k].shape) * sd
        return out, label or f"RandomWalk({sd})"

    def log_transition(a: State, b: State) -> float:
        d = np.asarray(b) - np.asarray(a)
        if at is not None:
            rest = np.ones(len(d), bool)
            rest[list(at)] = False
            if d[rest].any():
                return -math.inf
            d = d[list(at)]
        return float(-0.5 * (d @ d) / sd**2 - len(d) * math.log(sd * math.sqrt(2 * math.pi)))

    return Proposal(propose, log_transition)


def mixture(*parts: tuple[float, Proposal]) -> Proposal:
    """Draws one of the proposals by weight; the transition probability is the weighted sum."""
    weights = np.array([w for w, _ in parts]) / sum(w for w, _ in parts)
    proposals = [p for _, p in parts]

    def propose(s: State, rng: np.random.Generator) -> tuple[State, str]:
        k = min(int(np.searchsorted(np.cumsum(weights), rng.random(), side="right")), len(proposals) - 1)
        return proposals[k].propose(s, rng)

    def log_transition(a: State, b: State) -> float:
        logs = np.array([p.log_transition(a, b) for p in proposals])
        if np.isnan(logs).any():
            raise ValueError("a transition probability is not a number")
        top = logs.max()
        return -math.inf if top == -math.inf else float(top + np.log(np.sum(weights * np.exp(logs - top))))

    return Proposal(propose, log_transition, all(p.symmetric for p in proposals))


def combined(first: Proposal, second: Proposal) -> Proposal:
    """One after the other; transition terms of the same pair are added."""

    def propose(s: State, rng: np.random.Generator) -> tuple[State, str]:
        a, x = first.propose(s, rng)
        b, y = second.propose(a, rng)
        return b, f"Combined({x},{y})"

    return Proposal(propose, lambda a, b: first.log_transition(a, b) + second.log_transition(a, b), first.symmetric and second.symmetric)


def product(*parts: tuple[slice, Proposal]) -> Proposal:
    """Independent proposals for parts of the state."""

    def propose(s: State, rng: np.random.Generator) -> tuple[State, str]:
        out, labels = np.array(s, float), []
        for at, p in parts:
            out[at], label = p.propose(out[at], rng)
            labels.append(label)
        return out, f"Product({','.join(labels)})"

    return Proposal(propose, lambda a, b: sum(p.log_transition(a[at], b[at]) for at, p in parts), all(p.symmetric for _, p in parts))


def filtered(inner: Proposal, evaluator: Evaluator) -> Proposal:
    """Metropolis filter: a proposal that an inner evaluator rejects becomes the current state."""

    def propose(s: State, rng: np.random.Generator) -> tuple[State, str]:
        new, label = inner.propose(s, rng)
        delta = evaluator(new) - evaluator(s) - inner.log_ratio(s, new)
        return (new, label) if delta > 0 or rng.random() < math.exp(delta) else (s, f"Filtered({label})")

    def log_transition(a: State, b: State) -> float:
        return inner.log_transition(a, b) + min(0.0, evaluator(b) - evaluator(a) - inner.log_ratio(a, b))

    return Proposal(propose, log_transition, False)


def product_evaluator(*parts: Evaluator) -> Evaluator:
    return lambda s: sum(f(s) for f in parts)


def gaussian_evaluator(mean: float, sd: float) -> Evaluator:
    return lambda s: float(-0.5 * np.sum(((np.asarray(s) - mean) / sd) ** 2) - np.size(s) * math.log(sd * math.sqrt(2 * math.pi)))


def cached(evaluator: Evaluator, size: int = 10) -> Evaluator:
    """Keeps the last values."""
    known: dict[bytes, float] = {}

    def value(s: State) -> float:
        key = np.asarray(s).tobytes()
        if key not in known:
            if len(known) >= size:
                known.pop(next(iter(known)))
            known[key] = evaluator(s)
        return known[key]

    return value


def metropolis_hastings(proposal: Proposal, evaluator: Evaluator, start: State, rng: np.random.Generator) -> Iterator[tuple[State, bool, str, float]]:
    """(state, accepted, label, log value), for ever. Accepts if the gain is over 0 or a uniform draw is under its exponential."""
    current, p = np.asarray(start, float), evaluator(start)
    while True:
        new, label = proposal.propose(current, rng)
        q = evaluator(new)
        gain = q - p - proposal.log_ratio(current, new)
        accepted = gain > 0 or rng.random() < math.exp(gain)
        if accepted:
            current, p = new, q
        yield current, accepted, label, p


def with_prefetching(proposal: Proposal, evaluator: Evaluator, start: State, rng: np.random.Generator, batch: int = 8) -> Iterator[tuple[State, bool, str, float]]:
    """As metropolis_hastings, with proposals from the same state evaluated together, in `batch` threads; after an acceptance the rest of a batch goes.

    It pays where an evaluator waits or lets go of the interpreter (NumPy on large arrays, a Spark job), and few proposals are accepted.
    """
    current, p = np.asarray(start, float), evaluator(start)
    pool = ThreadPoolExecutor(batch)
    while True:
        drawn = [proposal.propose(current, rng) for _ in range(batch)]
        values = list(pool.map(evaluator, [s for s, _ in drawn]))
        for (new, label), q in zip(drawn, values):
            gain = q - p - proposal.log_ratio(current, new)
            accepted = gain > 0 or rng.random() < math.exp(gain)
            if accepted:
                current, p = new, q
            yield current, accepted, label, p
            if accepted:
                break


def forward_chain(proposal: Proposal, start: State, rng: np.random.Generator) -> Iterator[tuple[State, bool, str, float]]:
    return metropolis_hastings(Proposal(proposal.propose, lambda a, b: 0.0), lambda s: 0.0, start, rng)


def chains(spark: SparkSession, proposal: Proposal, evaluator: Evaluator, start: Sequence[float], n_chains: int, burn_in: int, steps: int, every: int = 1, seed: int = 0) -> DataFrame:
    """chain_id, step, state, accepted, generated_by, logp: independent chains, one seed each, in parallel tasks.

    Each chain is a row of its own until a task turns it into its samples, so a lost executor repeats its chains with
    the same result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chain in pdf["id"]:
                rng = np.random.default_rng([seed, int(chain)])
                rows = []
                for k, (s, ok, label, p) in enumerate(metropolis_hastings(proposal, evaluator, np.array(start, float), rng)):
                    if k >= burn_in + steps:
                        break
                    if k >= burn_in and (k - burn_in) % every == 0:
                        rows.append((int(chain), k - burn_in, s.tolist(), bool(ok), label, p))
                yield pd.DataFrame(rows, columns=["chain_id", "step", "state", "accepted", "generated_by", "logp"])

    ids = spark.range(0, n_chains, 1, max(1, min(n_chains, spark.sparkContext.defaultParallelism)))
    return ids.mapInPandas(run, "chain_id long, step long, state array<double>, accepted boolean, generated_by string, logp double")


# --- loggers as queries over a chain table


def acceptance_ratios(chain: DataFrame) -> DataFrame:
    return chain.groupBy("generated_by").agg(F.avg(F.col("accepted").cast("int")).alias("ratio"), F.count(F.lit(1)).alias("n"))


def best_sample(chain: DataFrame) -> DataFrame:
    return chain.agg(F.max_by(F.struct("chain_id", "step", "state"), F.struct("logp", -F.col("chain_id"), -F.col("step"))).alias("b"), F.max("logp").alias("logp")).select("b.*", "logp")


def accepted_only(chain: DataFrame) -> DataFrame:
    return chain.filter("accepted")


def stepped(chain: DataFrame, every: int) -> DataFrame:
    return chain.filter(F.col("step") % every == 0)
