"""Parameters of a fit as one flat state: shape, rotation, translation and scale, views of them, and their evaluators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np

from shapelake.functions.transform import Transformation, similarity
from shapelake.plans.mcmc import Evaluator, Proposal, State


@dataclass(frozen=True)
class Parameters:
    """What a fit changes. A flat state holds translation (3), angles (3), scale (1) and the shape's coefficients, in this order."""

    shape: tuple[float, ...] = ()
    translation: tuple[float, float, float] = (0.0, 0.0, 0.0)
    angles: tuple[float, float, float] = (0.0, 0.0, 0.0)
    scale: float = 1.0

    def flat(self) -> State:
        return np.array([*self.translation, *self.angles, self.scale, *self.shape], float)

    @staticmethod
    def of(state: State) -> Parameters:
        s = [float(x) for x in state]
        if len(s) < 7:
            raise ValueError("a state has seven numbers and the shape's coefficients")
        return Parameters(tuple(s[7:]), tuple(s[:3]), tuple(s[3:6]), s[6])

    def pose(self, center: Sequence[float] = (0.0, 0.0, 0.0)) -> Transformation:
        """Translation after scaling after rotation about the centre, which is no parameter."""
        return similarity(self.translation, self.scale, self.angles, center)


@dataclass(frozen=True)
class Lens:
    """A part of a state: get(whole) -> part, put(whole, part) -> whole."""

    get: Callable[[Any], Any]
    put: Callable[[Any, Any], Any]

    def then(self, inner: Lens) -> Lens:
        return Lens(lambda s: inner.get(self.get(s)), lambda s, x: self.put(s, inner.put(self.get(s), x)))

    @staticmethod
    def at(part: slice | Sequence[int]) -> Lens:
        """Of positions of a flat state."""

        def put(s: State, x: State) -> State:
            out = np.array(s, float)
            out[part] = x
            return out

        return Lens(lambda s: np.asarray(s, float)[part], put)

    @staticmethod
    def field(name: str) -> Lens:
        """Of a field of a dataclass."""
        return Lens(lambda s: getattr(s, name), lambda s, x: replace(s, **{name: x}))


TRANSLATION, ANGLES, SCALE, SHAPE = Lens.at(slice(0, 3)), Lens.at(slice(3, 6)), Lens.at(slice(6, 7)), Lens.at(slice(7, None))


def partial(inner: Proposal, lens: Lens) -> Proposal:
    """A proposal for a part as one for the whole; what differs elsewhere can't be proposed."""

    def propose(s: State, rng: np.random.Generator) -> tuple[State, str]:
        new, label = inner.propose(lens.get(s), rng)
        return lens.put(s, new), label

    def log_transition(a: State, b: State) -> float:
        if not np.array_equal(lens.put(a, lens.get(b)), b):
            return float("-inf")
        return inner.log_transition(lens.get(a), lens.get(b))

    return Proposal(propose, log_transition, inner.symmetric)


def converted(inner: Proposal, to: Callable[[Any], State], back: Callable[[State], Any]) -> Proposal:
    """A proposal for one form of the parameters as one for another."""

    def propose(s: Any, rng: np.random.Generator) -> tuple[Any, str]:
        new, label = inner.propose(to(s), rng)
        return back(new), label

    return Proposal(propose, lambda a, b: inner.log_transition(to(a), to(b)), inner.symmetric)


def pair_evaluator(first: Evaluator, second: Evaluator, split: int) -> Evaluator:
    """Sum of the log values of two independent parts of a flat state, the first of `split` numbers."""
    return lambda s: first(s[:split]) + second(s[split:])


def corrected(inner: Proposal, evaluator: Evaluator) -> Proposal:
    """A proposal whose transition ratio is taken as that of the evaluator, for generators that already sample from it."""
    return Proposal(inner.propose, lambda a, b: evaluator(b), False)
