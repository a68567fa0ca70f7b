"""L-BFGS with a strong Wolfe line search, for several functions in lock step.

The steps are those of the optimiser behind MLlib's regressions (breeze's
``LBFGS`` and ``StrongWolfeLineSearch``), so the point after ``e`` steps is what
a fit with ``maxIter=e`` ends at. A minimiser is a generator: it gives a point
and is sent the value and the gradient there, so the next points of all
functions can be evaluated by one pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MEMORY, TOLERANCE, VALUES = 10, 1e-6, 20
TRIALS = 10           # of a line search, and of narrowing its bracket
FALL, BEND = 1e-4, 0.9  # of the strong Wolfe conditions


class _Failed(Exception):
    """A step that cannot be made from this history."""


def _direction(grad: np.ndarray, history: list) -> np.ndarray:
    d, kept = grad.copy(), []
    for step, change in history:
        rho = step @ change
        a = (step @ d) / rho if rho else np.nan
        if np.isnan(a):
            raise _Failed
        d -= a * change
        kept.append((a, rho))
    if history:
        step, change = history[0]
        if not step @ change >= 0:
            raise _Failed
        d *= (step @ change) / (change @ change)
    for (step, change), (a, rho) in zip(reversed(history), reversed(kept)):
        d += (a - (change @ d) / rho) * step
    return -d


def _between(left, right) -> float:
    """The minimum of the cubic through two (t, value, slope), kept off the ends."""
    (s, f, df), (t, g, dg) = left[:3], right[:3]
    d1 = df + dg - 3 * (f - g) / (s - t)
    with np.errstate(invalid="ignore", divide="ignore"):
        d2 = np.sqrt(np.float64(d1 * d1 - df * dg))
        at = t - (t - s) * (dg + d2 - d1) / (dg - df + 2 * d2)
    low, high = s + 0.1 * (t - s), s + 0.9 * (t - s)
    return low if at < low else high if at > high else float(at)


def _search(x, value, grad, d, t):
    """(t, value, slope, gradient) of an accepted step along ``d``."""
    slope = float(grad @ d)
    if slope > 0:
        raise _Failed

    def phi(t):
        f, g = yield x + d * t
        return t, f, float(g @ d), g

    def zoom(low, high):
        for _ in range(TRIALS):
            c = yield from phi(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + FALL * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= BEND * abs(slope):
                    return c
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    low = 0.0, value, slope, grad
    for i in range(TRIALS):
        c = yield from phi(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + FALL * t * slope or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= BEND * abs(slope):
            return c
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise _Failed


def minimise(x: np.ndarray, steps: int):
    """The points after 0, 1, ... steps, at most ``steps`` of them; fewer where
    the minimum, or a point no step leads on from, comes before."""
    value, grad = yield x
    path, history, failed, first, values = [x], [], False, abs(value), [np.inf]
    while len(path) <= steps:
        if np.linalg.norm(grad) <= max(TOLERANCE * abs(value), 1e-8) or (len(values) > 1 and abs(value - max(values)) <= TOLERANCE * first):
            break
        try:
            d = _direction(grad, history)
            t, new_value, _, new_grad = yield from _search(x, value, grad, d, 1.0 / np.linalg.norm(d) if len(path) == 1 else 1.0)
            if t * np.linalg.norm(grad) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, history = True, []
            continue
        new = x + d * t
        history = [(new - x, new_grad - grad), *history[:MEMORY - 1]]
        x, value, grad, failed = new, new_value, new_grad, False
        values = [*values, value][-VALUES:]
        path.append(x)
    return path


def together(starts: dict, steps: int, evaluate: Callable[[dict], dict]) -> dict:
    """The paths of ``minimise`` from several starts; ``evaluate`` takes a point
    of each function that is not done, and gives their values and gradients."""
    runs = {k: minimise(x, steps) for k, x in starts.items()}
    asked, paths = {k: next(r) for k, r in runs.items()}, {}
    while asked:
        got, asked = evaluate(asked), {}
        for k, answer in got.items():
            try:
                asked[k] = runs[k].send(answer)
            except StopIteration as done:
                paths[k] = done.value
    return paths
