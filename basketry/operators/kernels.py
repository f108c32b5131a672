"""Small numeric kernels of the fitting jobs.

All quadratic fits share one form,

    min  1/2 |X'w - b|^2 + ridge/2 |w|^2   s.t.  sum w = 1, 0 <= w <= upper, f.w >= target, |w - q|_1 <= budget

with names in rows of ``X`` and days in columns. Its dual lives on the days plus three
multipliers, so its size does not depend on how many names there are: at a dual point
each name's weight is a closed form, and all the solver needs back are sums over names.
``solve`` is a generator that yields dual points and receives those sums. One task can
add them up for a modest universe, or a Spark job for any other; see ``fits``.

References: Li, Sun & Toh (2018) for the dual Newton proximal method; Efron, Hastie,
Johnstone & Tibshirani (2004) for the lasso path.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np

MAX_OUTER, MAX_INNER, MAX_TRIALS = 60, 100, 40
TOL = 1e-10
STILL = 1e-12  # squared move of the weights in the last proximal step
SIGMA_FIRST, SIGMA_FALL, SIGMA_LAST = 1.0, 0.3, 1e-4  # proximal weights, falling from step to step
LASSO_TIE = 1e-9  # relative speeds of two correlations that differ by less are equal
SIGMA_LEAST = 1e-8  # where they go on falling to while the weights drift along a nearly flat direction


@dataclass
class Spec:
    """One fit: right-hand side and limits. ``proximal`` steps are needed unless the ridge is substantial."""

    b: np.ndarray
    n_names: int
    ridge: float = 0.0
    proximal: bool = True
    upper: float = 1.0
    target: float | None = None
    budget: float | None = None


@dataclass
class Point:
    """A dual point on top of the proximal steps already taken."""

    v: np.ndarray
    sigma: float
    taken: list[tuple[np.ndarray, float]] = field(default_factory=list)


def name_weights(x, f, q, point: Point, spec: Spec):
    """Weights at a dual point: ``(w, previous w, free mask, trade sign, reduced cost)``."""
    w = q.copy()
    days = len(spec.b)
    for v, sigma in [*point.taken, (point.v, point.sigma)]:
        before = w
        rho = spec.ridge + sigma
        cost = x @ v[:days] - v[days] - v[days + 1] * f
        move = sigma / rho * before - cost / rho - q
        band = v[days + 2] / rho
        shifted = q + np.sign(move) * np.maximum(np.abs(move) - band, 0.0)
        w = np.clip(shifted, 0.0, spec.upper)
    free = (np.abs(move) >= band) & (shifted > 0) & (shifted < spec.upper)
    return w, before, free, np.sign(move), cost


def name_sums(x, f, q, point: Point, spec: Spec) -> np.ndarray:
    """Everything the solver needs from a set of names, additive over sets."""
    rho = spec.ridge + point.sigma
    w, before, free, sign, cost = name_weights(x, f, q, point, spec)
    centre = point.sigma / rho * before
    value = (0.5 * rho * (w - centre) ** 2 + cost * w + point.v[-1] * np.abs(w - q)).sum()
    g = np.column_stack([x[free], -np.ones(free.sum()), -f[free], sign[free]])
    head = [x.T @ w, [w.sum(), f @ w, np.abs(w - q).sum(), value, ((w - before) ** 2).sum()]]
    return np.concatenate([*head, (g.T @ g / rho).ravel()])


def solve(spec: Spec, start: np.ndarray | None = None) -> Generator[Point, np.ndarray, tuple[Point, bool]]:
    """Dual Newton steps inside proximal steps. Returns the final point and whether it is feasible.

    A feasible problem that still moves when the steps run out is an error, never an answer. ``start`` are the multipliers
    of the first step of a neighbouring problem; every step has one solution in the weights, so they save work and change none.
    """
    days = len(spec.b)
    size = days + 3
    target = spec.target if spec.target is not None else -np.inf
    budget = spec.budget if spec.budget is not None else np.inf
    live = np.ones(size, bool)
    live[days + 1], live[days + 2] = np.isfinite(target), np.isfinite(budget)

    def read(s, v):
        gap = np.array([1.0 - s[days], target - s[days + 1] if live[days + 1] else 0.0, s[days + 2] - budget if live[days + 2] else 0.0])
        grad = np.concatenate([s[:days] - v[:days] - spec.b, gap])
        dual = -0.5 * v[:days] @ v[:days] - spec.b @ v[:days] + v[days] + s[days + 3]
        dual += (v[days + 1] * target if live[days + 1] else 0.0) - (v[days + 2] * budget if live[days + 2] else 0.0)
        return grad, dual, s[days + 4], s[days + 5:].reshape(size, size)

    def violation(grad):
        return max(abs(grad[days]), max(grad[days + 1], 0.0), max(grad[days + 2], 0.0))

    def clamp(v):
        v = v.copy()
        v[days + 1:] = np.maximum(v[days + 1:], 0.0)
        return v

    point = Point(np.zeros(size), SIGMA_FIRST if spec.proximal else 0.0)
    point.v[days] = (spec.ridge + point.sigma) / spec.n_names  # every name starts free
    if start is not None:
        point.v = np.where(live, start, 0.0)
    feasible, moved = False, np.inf
    for _ in range(MAX_OUTER):
        before, tolerance = moved, max(TOL, 1e-17 * spec.n_names / (spec.ridge + point.sigma))
        grad, dual, moved, curve = read((yield point), point.v)
        damp = 1e-8
        for _ in range(MAX_INNER):
            pinned = np.zeros(size, bool)
            pinned[days + 1:] = (point.v[days + 1:] <= 0) & (grad[days + 1:] <= 0)
            work = live & ~pinned
            if np.abs(grad[work]).max() < tolerance or damp > 1e3:
                break
            # Days carry unit curvature; the multipliers have none when every name sits on a bound.
            extra = np.where(np.arange(size) < days, 1.0, damp * spec.n_names / (spec.ridge + point.sigma))
            step = np.zeros(size)
            step[work] = np.linalg.solve(curve[np.ix_(work, work)] + np.diag(extra[work]), grad[work])
            t, low, high = 1.0, (0.0, grad @ step), None
            for _ in range(MAX_TRIALS):
                trial = Point(clamp(point.v + t * step), point.sigma, point.taken)
                grad2, dual2, moved2, curve2 = read((yield trial), trial.v)
                gain = grad @ (trial.v - point.v)
                if dual2 >= dual + 1e-4 * gain - 1e-13 * abs(dual) - 1e-16:
                    point, grad, dual, moved, curve = trial, grad2, dual2, moved2, curve2
                    damp = max(damp / 10, 1e-12) if t == 1.0 else damp
                    break
                # The dual bends sharply where equal names leave a bound together: go where its slope along the step is zero.
                t, low, high = _between(t, grad2 @ step, low, high)
            else:
                damp *= 100
        feasible = violation(grad) < 1e-6
        if feasible and np.abs(grad[:days]).max() > 1e-6:
            raise ArithmeticError(f"fit of {spec.n_names} names has not settled: its gradient is {np.abs(grad[:days]).max():.1e}")
        if not feasible or not spec.proximal or moved < 1e-16:
            break
        least = SIGMA_LEAST if moved > 0.5 * before else SIGMA_LAST
        point = Point(point.v.copy(), min(point.sigma, max(least, point.sigma * SIGMA_FALL)), [*point.taken, (point.v, point.sigma)])
    else:
        if moved > STILL:
            raise ArithmeticError(f"fit of {spec.n_names} names has not settled: the last step moved it by {moved ** 0.5:.1e}")
    return point, feasible


def _between(t: float, slope: float, low: tuple[float, float], high: tuple[float, float] | None):
    """The next length to try of a step that was too long, with the lengths and slopes that hold the zero between them."""
    if slope < 0 or high is None:
        high = (t, min(slope, 0.0))
    else:
        low = (t, slope)
    share = low[1] / (low[1] - high[1]) if low[1] > high[1] else 0.5
    return low[0] + min(max(share, 0.01), 0.9) * (high[0] - low[0]), low, high


def fit_in_task(x, f, q, spec: Spec, proven: bool = False) -> np.ndarray | None:
    """Weights of one problem whose names all sit in this task; None when infeasible."""
    found = fit_with_multipliers(x, f, q, spec, proven)
    return None if found is None else found[0]


def fit_with_multipliers(x, f, q, spec: Spec, proven: bool = False, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Weights; the multipliers of the sum, of the exposure floor and of the turnover budget; and a start for a neighbour.

    ``proven`` says that the problem has a solution, so not reaching one is an error.
    """
    if len(x) * spec.upper < 1.0:
        return None
    steps = solve(spec, start)
    point = next(steps)
    while True:
        try:
            point = steps.send(name_sums(x, f, q, point, spec))
        except StopIteration as done:
            point, feasible = done.value
            if not feasible:
                if proven:
                    raise unsettled(spec)
                return None
            first = point.taken[0][0] if point.taken else point.v
            return normalised(name_weights(x, f, q, point, spec)[0]), multipliers(point, spec), first


def multipliers(point: Point, spec: Spec) -> np.ndarray:
    return point.v[len(spec.b):].copy()


def unsettled(spec: Spec) -> ArithmeticError:
    return ArithmeticError(f"a fit of {spec.n_names} names has a solution, but its limits were not met when the steps ran out")


def normalised(w: np.ndarray) -> np.ndarray:
    return w / w.sum()


def _equal_fall(x: np.ndarray, days: int) -> np.ndarray:
    """The direction along which the correlations of all names of ``x`` fall by one; by QR, which near copies harm least."""
    r = np.linalg.qr(x.T, mode="r")
    size = np.abs(np.diag(r))
    if len(size) == len(x) and size.min() > 1e-12 * size.max():
        return days * np.linalg.solve(r, np.linalg.solve(r.T, np.ones(len(x))))
    return np.linalg.lstsq(x @ x.T / days, np.ones(len(x)), rcond=1e-12)[0]


def lasso_path(x: np.ndarray, y: np.ndarray, n_alphas: int, eps: float, alpha_max: float) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative lasso coefficients at ``n_alphas`` geometric penalties below ``alpha_max``.

    ``x`` is names x days. Follows the piecewise-linear path: between two events the
    active coefficients move along one direction, so every penalty in between is exact.
    Of equal names the first takes what all of them would share; a name whose correlation falls as fast as that of the
    active ones, to LASSO_TIE, goes along with them and does not join.
    """
    first = np.sort(np.unique(x, axis=0, return_index=True)[1])
    if len(first) < len(x):
        alphas, part = lasso_path(x[first], y, n_alphas, eps, alpha_max)
        out = np.zeros((n_alphas, len(x)))
        out[:, first] = part
        return alphas, out
    days = x.shape[1]
    alphas = np.geomspace(alpha_max, alpha_max * eps, n_alphas)
    out = np.zeros((n_alphas, len(x)))
    w = np.zeros(len(x))
    corr = x @ y / days
    alpha = corr.max() if len(x) else 0.0
    if alpha <= 0:
        return alphas, out
    active = [int(corr.argmax())]
    blocked: list[int] = []  # dropped since the penalty last fell; near copies would else take turns at one penalty
    for _ in range(20 * days + 20):
        direction = _equal_fall(x[active], days)
        slope = x @ (direction @ x[active]) / days
        with np.errstate(all="ignore"):
            join = np.where(1 - slope > LASSO_TIE, (alpha - corr) / (1 - slope), np.inf)
            drop = np.where(direction < 0, -w[active] / direction, np.inf)
        join[active] = np.inf
        join[blocked] = np.inf
        join = np.where(join < 0, 0.0, join)
        stay = min(join.min(), drop.min(), alpha)
        here = (alphas <= alpha) & (alphas > alpha - stay) if stay < alpha else alphas <= alpha
        for k in np.flatnonzero(here):
            out[k, active] = np.maximum(w[active] + (alpha - alphas[k]) * direction, 0.0)
        w[active] = np.maximum(w[active] + stay * direction, 0.0)
        alpha -= stay
        if alpha <= alphas[-1]:
            break
        corr = x @ (y - w @ x) / days
        if drop.min() <= join.min():
            gone = active.pop(int(drop.argmin()))
            w[gone] = 0.0
            blocked = [gone] if stay > LASSO_TIE * alpha_max else [*blocked, gone]
            if not active:
                active = [int(np.where(np.isin(np.arange(len(x)), blocked), -np.inf, corr).argmax())]
        else:
            active.append(int(join.argmin()))
            blocked = [] if stay > LASSO_TIE * alpha_max else blocked
    else:
        raise ArithmeticError(f"lasso path over {len(x)} names has not reached its last penalty")
    return alphas, out
