"""Small numeric kernels for the driver: matrices of a few states, one-dimensional roots, the normal distribution."""

from __future__ import annotations

from collections.abc import Callable
from math import erfc, exp, log, pi, sqrt
from statistics import NormalDist
from typing import NamedTuple

import numpy as np

_NORMAL = NormalDist()


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential: scaling, a Taylor polynomial, squaring."""
    a = np.asarray(a, float)
    squarings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 4)
    x = a / 2.0**squarings
    out = term = np.eye(len(a))
    for k in range(1, 15):
        term = term @ x / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def logm(a: np.ndarray) -> np.ndarray:
    """Real matrix logarithm: by eigenvectors, or by square roots where they are ill-conditioned."""
    a = np.asarray(a, float)
    values, vectors = np.linalg.eig(a)
    if np.linalg.cond(vectors) < 1e10 and not np.any((values.real <= 0) & (np.abs(values.imag) < 1e-14)):
        return (vectors @ np.diag(np.log(values.astype(complex))) @ np.linalg.inv(vectors)).real
    roots, x = 0, a
    while np.abs(x - np.eye(len(a))).max() > 0.1 and roots < 60:
        y, z = x, np.eye(len(a))
        for _ in range(50):  # Denman-Beavers
            y, z = (y + np.linalg.inv(z)) / 2, (z + np.linalg.inv(y)) / 2
        x, roots = y, roots + 1
    e = x - np.eye(len(a))
    out, term = np.zeros_like(e), np.eye(len(a))
    for k in range(1, 40):
        term = term @ e
        out += (-1) ** (k + 1) * term / k
    return out * 2.0**roots


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, *, step: float = 0.5, x_tol: float = 1e-8, f_tol: float = 1e-10, most: int = 20_000) -> np.ndarray:
    """Minimum by the downhill simplex of Nelder and Mead, restarted until a restart gains nothing."""

    def once(x0: np.ndarray) -> tuple[np.ndarray, float]:
        n = len(x0)
        points = [np.array(x0, float)] + [x0 + step * np.eye(n)[i] for i in range(n)]
        values = [f(p) for p in points]
        for _ in range(most):
            order = np.argsort(values, kind="stable")
            points, values = [points[i] for i in order], [values[i] for i in order]
            if max(np.abs(p - points[0]).max() for p in points) <= x_tol and values[-1] - values[0] <= f_tol:
                break
            middle = np.mean(points[:-1], axis=0)
            at = lambda t: middle + t * (middle - points[-1])  # noqa: B023, E731
            tried = at(1.0)
            value = f(tried)
            if value < values[0]:
                further = at(2.0)
                if (v := f(further)) < value:
                    tried, value = further, v
            elif value >= values[-2]:
                tried = at(0.5) if value < values[-1] else at(-0.5)
                value = f(tried)
                if value >= values[-1]:
                    points = [points[0]] + [points[0] + (p - points[0]) / 2 for p in points[1:]]
                    values = [values[0]] + [f(p) for p in points[1:]]
                    continue
            points[-1], values[-1] = tried, value
        i = int(np.argmin(values))
        return points[i], values[i]

    x, best = once(np.asarray(start, float))
    while True:
        y, value = once(x)
        if value >= best - max(f_tol, 1e-12 * abs(best)):
            return x if best <= value else y
        x, best = y, value


def bisect(f: Callable[[float], float], low: float, high: float, tol: float = 1e-10) -> float | None:
    """A root of f between two ends of different sign; None if they are not."""
    a, b = f(low), f(high)
    if a == 0:
        return low
    if a * b > 0:
        return None
    while high - low > tol * max(1.0, abs(low)):
        mid = (low + high) / 2
        if (f(mid) > 0) == (a > 0):
            low = mid
        else:
            high = mid
    return (low + high) / 2


def density(z: float) -> float:
    return exp(-z * z / 2) / sqrt(2 * pi)


def upper_tail(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def upper_quantile(p: float) -> float:
    return -_NORMAL.inv_cdf(p)


def mills(z: float) -> float:
    """density / upper tail, by its continued fraction far out."""
    if z < 30:
        return density(z) / upper_tail(z)
    tail = z
    for k in range(60, 0, -1):
        tail = z + k / tail
    return tail


def truncation_point(mean_above: float, mu: float, sigma: float) -> float | None:
    """t with E[X | X >= t] = mean_above for X normal; None if the mean is below mu or out of reach."""
    if mean_above < mu:
        return None
    return bisect(lambda t: mu + sigma * mills((t - mu) / sigma) - mean_above, mu - 10 * sigma, mu + 10 * sigma)


class Offers(NamedTuple):
    """Log-normal offers, of which those whose standardised log is above ``cut`` are taken."""

    mu: float
    sigma: float
    cut: float

    def reservation(self) -> float:
        """The least offer that is taken."""
        return exp(self.mu + self.cut * self.sigma)

    def mean(self) -> float:
        return exp(self.mu + self.sigma**2 / 2)

    def taken_mean(self) -> float:
        """Mean of the offers taken: weighting by the offer moves the normal up by sigma."""
        return self.mean() * upper_tail(self.cut - self.sigma) / upper_tail(self.cut)


def above(cut: float) -> tuple[float, float]:
    """Mean and variance of a standard normal given that it is above ``cut``."""
    mean = mills(cut)
    return mean, 1.0 - mean * (mean - cut)


def offers_from_taken(mean_log: float, var_log: float, share: float) -> Offers:
    """The offers of which the upper ``share`` has this mean and variance of logs.

    A normal above its cut is the standard one above its cut, stretched by sigma and shifted by mu, so the two moments
    are matched one after the other. Raises ``ValueError``, saying what to change, where no such offers exist.
    """
    if share <= 0 or share >= 1:
        raise ValueError(f"a share of {share:.4f} of offers cannot be taken: choose an offer rate above the flow and a positive one")
    if not var_log > 0:
        raise ValueError("accepted wages do not vary: pool more of them")
    cut = upper_quantile(share)
    unit_mean, unit_var = above(cut)
    # far out the variance is a difference of nearly equal numbers
    if unit_var < 1e-12 * unit_mean**2:
        raise ValueError(f"a share of {share:.4g} leaves no measurable spread above the cut: choose a lower offer rate")
    sigma = sqrt(var_log / unit_var)
    return Offers(mean_log - unit_mean * sigma, sigma, cut)


def grouped_exponential(counts: list[float], edges: list[float]) -> float:
    """Rate of an exponential from counts between edges (the last bin is open)."""

    def loss(x: np.ndarray) -> float:
        rate = exp(min(float(x[0]), 50.0))
        total = 0.0
        for n, a, b in zip(counts, edges, [*edges[1:], None]):
            share = exp(-rate * a) - (exp(-rate * b) if b is not None else 0.0)
            total -= n * log(max(share, 1e-300))
        return total / max(sum(counts), 1)

    return exp(float(simplex(loss, np.array([-1.0]))[0]))
