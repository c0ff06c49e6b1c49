"""Portfolio optimisation, dense or with uncorrelated names: quadratic objectives under linear and tracking-error constraints.

One problem is one date's (or one portfolio's) names, held by one task; many problems are solved in
parallel as groups of a DataFrame (:func:`solve_groups`). The solver is a splitting method (ADMM)
that needs one matrix factorisation and projections: every constraint is a block ``A w`` with a set
to project on - a box, a point, an l1 ball, an ellipsoid - so constraints compose freely. No solver
library is used.

A diagonal matrix is held as its diagonal. With uncorrelated names every matrix of a problem is
either diagonal or has few rows, and memory and work of a round grow in proportion to the names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PERIODS = 252.0


@dataclass(frozen=True)
class Problem:
    """Aligned arrays of one problem: names, benchmark and present weights, covariance per period (or the variances alone, if names are uncorrelated), expected returns, attributes by name (numbers or groups)."""

    names: Sequence[str]
    benchmark: np.ndarray
    covariance: np.ndarray
    present: np.ndarray | None = None
    expected: np.ndarray | None = None
    attributes: Mapping[str, np.ndarray] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.names)

    def start(self) -> np.ndarray:
        return self.benchmark if self.present is None else self.present


@dataclass(frozen=True)
class Block:
    """A matrix (or its diagonal), the projection of ``matrix @ w`` on its set, and how far it is outside; ``by_row`` if the set is a bound for every row."""

    matrix: np.ndarray
    project: Callable[[np.ndarray], np.ndarray]
    far: Callable[[np.ndarray], float]
    by_row: bool = False


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return a * x if a.ndim == 1 else a @ x


def _back(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The transposed matrix times ``x``."""
    return a * x if a.ndim == 1 else a.T @ x


def _box(a: np.ndarray, low: np.ndarray | float, high: np.ndarray | float) -> Block:
    return Block(a, lambda z: np.clip(z, low, high), lambda z: float(np.max(np.maximum(low - z, z - high), initial=0.0)), True)


def l1_ball(z: np.ndarray, radius: float) -> np.ndarray:
    """Nearest point whose absolute values sum to at most ``radius``."""
    a = np.abs(z)
    if a.sum() <= radius:
        return z
    s = np.sort(a)[::-1]
    k = np.arange(1, len(s) + 1)
    over = (np.cumsum(s) - radius) / k
    return np.sign(z) * np.maximum(a - over[np.flatnonzero(s > over)[-1]], 0)


@dataclass(frozen=True)
class Constraint:
    """A named constraint; ``blocks`` makes its blocks for a problem, ``slack`` loosens its bound for relaxation."""

    name: str
    blocks: Callable[[Problem, float], list[Block]]


def full_investment(total: float = 1.0) -> Constraint:
    return Constraint("full_investment", lambda p, _: [_box(np.ones((1, len(p))), total, total)])


def long_only() -> Constraint:
    return Constraint("long_only", lambda p, _: [_box(np.ones(len(p)), 0.0, np.inf)])


def weight_bounds(highest: float = 1.0, lowest: float = 0.0) -> Constraint:
    return Constraint("weight_bounds", lambda p, s: [_box(np.ones(len(p)), lowest - s, highest + s)])


def tracking_error(most: float, yearly: bool = True) -> Constraint:
    """Deviation of the difference to the benchmark, per year, at most ``most``."""

    def blocks(p: Problem, slack: float) -> list[Block]:
        root, limit = _root(p.covariance), (most + slack) / (PERIODS**0.5 if yearly else 1.0)
        centre = _times(root, p.benchmark)

        def project(z: np.ndarray) -> np.ndarray:
            d = np.linalg.norm(z - centre)
            return z if d <= limit else centre + (z - centre) * limit / d

        return [Block(root, project, lambda z: max(0.0, float(np.linalg.norm(z - centre)) - limit))]

    return Constraint("tracking_error", blocks)


def turnover(most: float) -> Constraint:
    """Half the sum of absolute changes at most ``most``."""

    def blocks(p: Problem, slack: float) -> list[Block]:
        start, radius = p.start(), 2 * (most + slack)
        return [Block(np.ones(len(p)), lambda z: start + l1_ball(z - start, radius), lambda z: max(0.0, float(np.abs(z - start).sum()) - radius))]

    return Constraint("turnover", blocks)


def group_deviation(attribute: str, most: float) -> Constraint:
    """Every group's weight within ``most`` of its benchmark weight."""

    def blocks(p: Problem, slack: float) -> list[Block]:
        groups = p.attributes[attribute]
        a = np.array([groups == g for g in sorted(set(groups.tolist()))], float)
        return [_box(a, a @ p.benchmark - most - slack, a @ p.benchmark + most + slack)]

    return Constraint(f"group_deviation:{attribute}", blocks)


def exposure(attribute: str, lowest: float = -np.inf, highest: float = np.inf, relative: bool = True) -> Constraint:
    """Weighted attribute, relative to the benchmark's or as it is, between two bounds."""

    def blocks(p: Problem, slack: float) -> list[Block]:
        a = np.asarray(p.attributes[attribute], float)[None]
        base = a @ p.benchmark if relative else 0.0
        return [_box(a, base + lowest - slack, base + highest + slack)]

    return Constraint(f"exposure:{attribute}", blocks)


def intensity_reduction(attribute: str, reduction: float) -> Constraint:
    """Weighted attribute at most (1 - reduction) times the benchmark's."""

    def blocks(p: Problem, slack: float) -> list[Block]:
        a = np.asarray(p.attributes[attribute], float)[None]
        return [_box(a, -np.inf, (1 - reduction + slack) * (a @ p.benchmark))]

    return Constraint(f"intensity:{attribute}", blocks)


def liquidity_cap(attribute: str, multiple: float) -> Constraint:
    """A weight at most ``multiple`` times the name's share of all traded value."""

    def blocks(p: Problem, slack: float) -> list[Block]:
        adv = np.asarray(p.attributes[attribute], float)
        return [_box(np.ones(len(p)), -np.inf, (multiple + slack) * adv / max(adv.sum(), 1e-300))]

    return Constraint(f"liquidity:{attribute}", blocks)


@dataclass(frozen=True)
class Objective:
    """Minimises ``w' Q w / 2 - c' w`` plus ``linear * sum |w - start|`` plus ``impact * sum |w - start|^1.5``."""

    name: str
    quadratic: Callable[[Problem], np.ndarray]
    gain: Callable[[Problem], np.ndarray]
    linear: float = 0.0
    impact: float = 0.0


def minimise_variance() -> Objective:
    return Objective("variance", lambda p: p.covariance, lambda p: np.zeros(len(p)))


def minimise_tracking_error() -> Objective:
    return Objective("tracking_error", lambda p: p.covariance, lambda p: _times(p.covariance, p.benchmark))


def maximise_exposure(attribute: str) -> Objective:
    return Objective(f"exposure:{attribute}", lambda p: np.zeros_like(p.covariance), lambda p: np.asarray(p.attributes[attribute], float))


def mean_variance(aversion: float) -> Objective:
    return Objective("utility", lambda p: aversion * p.covariance, lambda p: p.expected if p.expected is not None else np.zeros(len(p)))


def with_costs(objective: Objective, linear_bps: float = 0.0, impact: float = 0.0, weight: float = 1.0) -> Objective:
    """The objective with costs of trading away from the present weights: proportional, and growing with the power 1.5."""
    return Objective(objective.name, objective.quadratic, objective.gain, weight * linear_bps / 1e4, weight * impact)


@dataclass(frozen=True)
class Solution:
    weights: np.ndarray
    feasible: bool
    violation: float
    value: float
    rounds: int


def _root(c: np.ndarray) -> np.ndarray:
    if c.ndim == 1:
        return np.sqrt(np.maximum(c, 0))
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    keep = values > max(values.max(initial=0) * 1e-12, 1e-18)
    return (vectors[:, keep] * np.sqrt(values[keep])).T


def _inverse(normal: np.ndarray, mats: Sequence[np.ndarray], rho: float) -> Callable[[np.ndarray], np.ndarray]:
    """What solves ``(normal + rho A'A) w = b`` for the stacked ``mats``: a dense inverse, or for diagonal matrices and few rows the diagonal and a matrix of those rows (Woodbury), refined once."""
    n = len(normal)
    rows = np.vstack([np.zeros((0, n)), *[m for m in mats if m.ndim == 2]])
    own = rho * sum((m * m for m in mats if m.ndim == 1), np.zeros(n))
    if normal.ndim == 2 or len(rows) >= n:
        inverse = np.linalg.inv((np.diag(normal) if normal.ndim == 1 else normal) + np.diag(own) + rho * (rows.T @ rows))
        return lambda b: inverse @ b
    d = normal + own
    small = np.linalg.inv(np.eye(len(rows)) / rho + (rows / d) @ rows.T)
    once = lambda b: (b - rows.T @ (small @ (rows @ (b / d)))) / d

    def solved(b: np.ndarray) -> np.ndarray:
        w = once(b)
        return w + once(b - d * w - rho * (rows.T @ (rows @ w)))

    return solved


def _cost_step(start: np.ndarray, linear: float, impact: float, rho: float) -> Callable[[np.ndarray], np.ndarray]:
    """Proximal step of the trading costs, name by name: |d| solves r = d + (linear + 1.5 impact sqrt d) / rho."""

    def step(z: np.ndarray) -> np.ndarray:
        d = z - start
        left = np.maximum(np.abs(d) - linear / rho, 0)
        b = 1.5 * impact / rho
        return start + np.sign(d) * ((-b + np.sqrt(b * b + 4 * left)) / 2) ** 2

    return step


def value_of(p: Problem, o: Objective, w: np.ndarray) -> float:
    d = np.abs(w - p.start())
    return float(w @ _times(o.quadratic(p), w) / 2 - o.gain(p) @ w + o.linear * d.sum() + o.impact * (d**1.5).sum())


def solve(p: Problem, objective: Objective, constraints: Sequence[Constraint], slack: Mapping[str, float] | None = None, rounds: int = 20_000, tolerance: float = 1e-9, allowed: float = 1e-6) -> Solution:
    """Weights that minimise the objective under the constraints.

    ``feasible`` is whether no constraint is violated by more than ``allowed`` in its own measure;
    if constraints contradict each other the weights are a compromise and ``feasible`` is false.
    ``slack`` loosens constraints by name. An empty problem has no weights and is feasible.
    """
    n = len(p)
    if not n:
        return Solution(np.zeros(0), True, 0.0, 0.0, 0)
    q, c = objective.quadratic(p), objective.gain(p)
    own = q if q.ndim == 1 else np.diag(q)
    scale = max(np.median(own), np.abs(c).max(initial=0.0), objective.linear, objective.impact, 1e-12)
    q, c, linear, impact = q / scale, c / scale, objective.linear / scale, objective.impact / scale
    blocks: list[Block] = [b for k in constraints for b in k.blocks(p, (slack or {}).get(k.name, 0.0))]
    # names in units of their own risk, and bounds with rows of length 1, so that very different variances converge alike
    own = own / scale
    unit = 1 / np.sqrt(np.maximum(own, own.max() * 1e-8)) if own.max() > 0 else np.ones(n)
    unit = unit / np.median(unit)
    q, c = q * (unit * unit if q.ndim == 1 else np.outer(unit, unit)), c * unit
    mats = [k.matrix * unit for k in blocks]
    lengths = [np.abs(m) if m.ndim == 1 else np.linalg.norm(m, axis=1) if k.by_row else np.linalg.norm(m, 2) for k, m in zip(blocks, mats, strict=True)]
    norms = [np.maximum(s if k.by_row else np.max(s), 1e-12) for k, s in zip(blocks, lengths, strict=True)]
    mats = [m / (s[:, None] if k.by_row and m.ndim == 2 else s) for k, m, s in zip(blocks, mats, norms, strict=True)]
    steps: list[Callable[[np.ndarray], np.ndarray]] = [lambda z, k=k, s=s: k.project(z * s) / s for k, s in zip(blocks, norms, strict=True)]
    rho = 1.0
    costs = linear > 0 or impact > 0
    if costs:
        mats.append(unit)
    at = np.cumsum([0, *[len(m) for m in mats]])
    ahead = lambda w: np.concatenate([np.zeros(0), *[_times(m, w) for m in mats]])
    back = lambda z: sum((_back(m, z[a:b]) for m, a, b in zip(mats, at, at[1:], strict=False)), np.zeros(n))
    w = p.start() / unit
    z = ahead(w)
    u = np.zeros(len(z))
    # a solution is found by bounds in their own measure and forces in proportion to the largest, or many small weights would end early
    height = np.concatenate([np.zeros(0), *[np.broadcast_to(s, b - a) for s, a, b in zip([*norms, 1.0], at, at[1:], strict=False)]])
    force = lambda w: np.clip(np.abs(_times(q, w)).max(initial=np.abs(c).max(initial=0.0)), 1e-8, 1.0)
    normal = q + 1e-9 * (1 if q.ndim == 1 else np.eye(n))
    inverse = _inverse(normal, mats, rho)
    done = 0
    for done in range(1, rounds + 1):
        w = inverse(c + 1e-9 * w + rho * back(z - u))
        x = ahead(w)
        old, mixed = z, 1.6 * x - 0.6 * z
        target = mixed + u
        z = np.concatenate([*[f(target[a:b]) for f, a, b in zip(steps, at, at[1:], strict=False)], *([_cost_step(p.start(), linear, impact, rho)(target[at[-2] :])] if costs else [])]) if len(z) else z
        u = target - z
        gap, drift = np.abs(x - z).max(initial=0.0), rho * np.abs(back(z - old)).max(initial=0.0)
        if (np.abs(x - z) * height).max(initial=0.0) < tolerance and drift < tolerance and drift < tolerance * force(w):
            break
        if done % 200 == 0 and done < rounds // 2 and (gap > 10 * drift or drift > 10 * gap):
            factor = 2.0 if gap > drift else 0.5
            rho, u = rho * factor, u / factor
            inverse = _inverse(normal, mats, rho)
    w = w * unit
    worst = max((k.far(_times(k.matrix, w)) for k in blocks), default=0.0)
    return Solution(w, worst <= allowed, worst, value_of(p, objective, w), done)


def diagnose(p: Problem, objective: Objective, constraints: Sequence[Constraint], most: float = 1.0, keep: Sequence[str] = ("full_investment",)) -> pd.DataFrame:
    """Why a problem has no solution: the single constraints, or else the pairs, whose loss makes it feasible, and the least slack of each that does (null above ``most``)."""
    soft = [k for k in constraints if k.name not in keep]
    ok = lambda drop: solve(p, objective, [k for k in constraints if k not in drop]).feasible
    found = [(k,) for k in soft if ok((k,))] or [pair for pair in combinations(soft, 2) if ok(pair)]
    rows = []
    for drop in found:
        low, high = 0.0, most
        if not solve(p, objective, constraints, {k.name: high for k in drop}).feasible:
            rows.append(("+".join(k.name for k in drop), None))
            continue
        for _ in range(20):
            mid = (low + high) / 2
            low, high = (low, mid) if solve(p, objective, constraints, {k.name: mid for k in drop}).feasible else (mid, high)
        rows.append(("+".join(k.name for k in drop), high))
    return pd.DataFrame(rows, columns=["constraint", "slack"])


def price_constraints(p: Problem, objective: Objective, constraints: Sequence[Constraint], relaxation: float, keep: Sequence[str] = ("full_investment", "long_only")) -> pd.DataFrame:
    """What each constraint costs: the objective saved and the yearly tracking error saved if it is loosened by ``relaxation``."""
    te = lambda w: float(np.sqrt(max((w - p.benchmark) @ _times(p.covariance, w - p.benchmark), 0.0) * PERIODS))
    base = solve(p, objective, constraints)
    rows = []
    for k in constraints:
        if k.name not in keep:
            s = solve(p, objective, constraints, {k.name: relaxation})
            rows.append((k.name, base.value - s.value, te(base.weights) - te(s.weights)))
    return pd.DataFrame(rows, columns=["constraint", "objective_saved", "tracking_error_saved"])


def select_top(p: Problem, objective: Objective, constraints: Sequence[Constraint], holdings: int, most_rounds: int = 20) -> Solution:
    """A solution with at most ``holdings`` names: the smallest weights are forced out in steps of half the excess and the rest solved again."""
    out = np.zeros(len(p), bool)
    s = solve(p, objective, constraints)
    for _ in range(most_rounds):
        held = np.flatnonzero(np.abs(s.weights) > 1e-6)
        excess = len(held) - holdings
        if excess <= 0:
            break
        drop = held[np.argsort(np.abs(s.weights[held]), kind="stable")][: max(1, excess // 2)]
        out[drop] = True
        gone = np.eye(len(p))[out]
        s = solve(p, objective, [*constraints, Constraint("out", lambda _, __, g=gone: [_box(g, 0.0, 0.0)])])
    return s


def solve_groups(df: DataFrame, group: str, name: str, benchmark: str, attributes: Sequence[str], objective: Objective, constraints: Sequence[Constraint], variance: str, present: str | None = None) -> DataFrame:
    """One problem per group with names' own variances: group, name, ``weight``, ``feasible``. Each group is solved in one task; groups in parallel."""
    g, k = df.schema[group].dataType.simpleString(), df.schema[name].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name)
        p = Problem(pdf[name].astype(str).tolist(), pdf[benchmark].to_numpy(float), pdf[variance].to_numpy(float), pdf[present].to_numpy(float) if present else None, None, {a: pdf[a].to_numpy() for a in attributes})
        s = solve(p, objective, constraints, rounds=5000, tolerance=1e-8)
        return pd.DataFrame({group: pdf[group], name: pdf[name], "weight": s.weights, "feasible": s.feasible})

    cols = list(dict.fromkeys([group, name, benchmark, variance, *([present] if present else []), *attributes]))
    return df.select(*cols).groupBy(group).applyInPandas(run, f"{group} {g}, {name} {k}, weight double, feasible boolean")
