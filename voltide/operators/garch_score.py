"""Likelihood, gradient and expected curvature of GARCH(1,1) for a set of parameters, at every end of an expanding window.

The state of the recurrence is the variance and its three derivatives. A run of rows maps it affinely, so rows are laid out as a matrix
of short runs, all of which take a step at once; what enters each run is then added in closed form. The likelihood of a window is a
running sum over its rows, so one pass scores all windows of a series. No parameters in bounds let the variance fall to its floor.

Twice the negative likelihood, less a constant, is what is summed; curvature is its expected second derivative.
"""

from __future__ import annotations

import numpy as np

OMEGA_MIN, ALPHA_MIN, ALPHA_MAX, BETA_MIN, BETA_MAX, PERSISTENCE_MAX = 1e-8, 1e-6, 0.45, 1e-6, 0.9999, 0.9999
#: First guesses as (share of the variance, alpha, beta), fixed values; and the lattice around them.
STARTS = ((0.05, 0.10, 0.85), (0.10, 0.15, 0.80), (0.02, 0.05, 0.93))
LATTICE = tuple((max(1 - a - p, 0.002), a, p) for a in (0.001, 0.03, 0.1, 0.25) for p in (0.02, 0.4, 0.7, 0.88) if a + p < 0.999)
#: Windows that propose parameters in a pass, damping of their steps; gain of the likelihood below which a window is done.
PROPOSERS, DAMPING, TOLERANCE = 8, (0.0, 0.03, 1.0, 30.0), 1e-6
#: Sums of a window: likelihood, gradient, curvature (upper triangle).
TERMS = 10
_I, _J = np.triu_indices(3)


def bounded(theta: np.ndarray) -> np.ndarray:
    """(omega, alpha, beta) rows within the bounds."""
    omega, alpha = np.maximum(theta[:, 0], OMEGA_MIN), np.clip(theta[:, 1], ALPHA_MIN, ALPHA_MAX)
    beta = np.clip(theta[:, 2], BETA_MIN, BETA_MAX)
    return np.column_stack([omega, alpha, np.minimum(beta, PERSISTENCE_MAX - 1e-6 - alpha)])


def entering(theta: np.ndarray) -> np.ndarray:
    """Variance of the first row and its derivatives, (4, candidates)."""
    omega, rest = theta[:, 0], np.maximum(1 - theta[:, 1] - theta[:, 2], 1e-6)
    return np.stack([omega / rest, 1 / rest, omega / rest**2, omega / rest**2])


def passed(state: np.ndarray, theta: np.ndarray, steps: np.ndarray | int) -> np.ndarray:
    """What is left after ``steps`` rows of a state that entered, as an addition to the answer of the rows themselves."""
    beta = theta[:, 2]
    out = beta**steps * state
    out[..., 3, :] += steps * beta ** (steps - 1) * state[..., 0, :]
    return out


def answered(previous: np.ndarray, theta: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States after each of the rows, (rows, 4, candidates), from squared previous returns and the state before the first."""
    n, (omega, alpha, beta) = len(previous), theta.T
    length = max(1, int(np.sqrt(n)))
    runs = -(-n // length)
    table = np.zeros(runs * length)
    table[:n] = previous
    table = table.reshape(runs, length)
    out = np.empty((length, runs, 4, len(theta)))
    h, d_omega, d_alpha, d_beta = np.zeros((4, runs, len(theta)))
    for j in range(length):
        x = table[:, j, None]
        d_beta = h + beta * d_beta
        h, d_omega, d_alpha = omega + alpha * x + beta * h, 1 + beta * d_omega, x + beta * d_alpha
        for k, value in enumerate((h, d_omega, d_alpha, d_beta)):
            out[j, :, k] = value
    steps = np.arange(1, length + 1)[:, None, None, None]
    # The first run whole, then the end of each run from that of the one before it, then all that is inside those.
    out[:, :1] += beta**steps * state
    out[:, 0, 3] += (steps * beta ** (steps - 1) * state[:1])[:, 0, 0]
    for run in range(1, runs):
        out[-1, run] += passed(out[-1, run - 1], theta, length)
    before, inner = out[-1, :-1], steps[:-1]
    out[:-1, 1:] += beta**inner * before
    out[:-1, 1:, 3] += inner[..., 0] * beta ** (inner[..., 0] - 1) * before[:, 0]
    return out.swapaxes(0, 1).reshape(runs * length, 4, len(theta))[:n]


def block_end(previous: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Answer of a block's rows alone, (4, candidates); the first row of a series (NaN) keeps what enters."""
    inner = previous[1:] if len(previous) and np.isnan(previous[0]) else previous
    none = np.zeros((4, len(theta)))
    return answered(inner, theta, none)[-1] if len(inner) else none


def block_steps(previous: np.ndarray) -> int:
    return len(previous) - int(len(previous) > 0 and np.isnan(previous[0]))


def block_sums(squares: np.ndarray, previous: np.ndarray, theta: np.ndarray, state: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over the parts of a block that begin at ``starts``, (parts, TERMS, candidates)."""
    first = int(np.isnan(previous[0]))
    sums = np.empty((len(starts), TERMS, len(theta)))
    for c in range(0, len(theta), 8):
        some = slice(c, c + 8)
        states = answered(previous[first:], theta[some], state[:, some]) if first < len(previous) else np.empty((0, 4, len(theta[some])))
        if first:
            states = np.concatenate([state[None, :, some], states])
        h, slope = states[:, 0], states[:, 1:] / states[:, :1]
        ratio = squares[:, None] / h
        terms = np.concatenate([(np.log(h) + ratio)[:, None], (1 - ratio)[:, None] * slope, slope[:, _I] * slope[:, _J]], axis=1)
        sums[:, :, some] = np.add.reduceat(terms, starts, axis=0)
    return sums


def first_candidates(variances: np.ndarray) -> np.ndarray:
    """Starts and lattice for the smallest and the largest variance of the windows."""
    shares = np.array([*STARTS, *LATTICE])
    spread = np.unique([variances.min(), variances.max()])
    return bounded(np.concatenate([np.column_stack([shares[:, 0] * v, shares[:, 1:]]) for v in spread]))


def free_directions(theta: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Directions in (log omega, alpha, beta) that no bound forbids, as columns."""
    omega, alpha, beta = theta
    full = alpha + beta >= PERSISTENCE_MAX - 1e-6 - 1e-12 and slope[2] < 0
    out = []
    if not (omega <= OMEGA_MIN and slope[0] > 0):
        out.append((1.0, 0.0, 0.0))
    along = slope[1] - slope[2] if full else slope[1]
    if not (alpha <= ALPHA_MIN and along > 0 or alpha >= ALPHA_MAX and along < 0):
        out.append((0.0, 1.0, -1.0 if full else 0.0))
    if not full and not (beta <= BETA_MIN and slope[2] > 0 or beta >= BETA_MAX and slope[2] < 0):
        out.append((0.0, 0.0, 1.0))
    return np.array(out).T.reshape(3, len(out))


def scoring_steps(theta: np.ndarray, sums: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Gain of the log-likelihood that the quadratic model promises, and proposals for each damping times ``scale``."""
    by = np.array([theta[0], 1.0, 1.0])
    slope = sums[1:4] * by
    curve = np.zeros((3, 3))
    curve[_I, _J] = curve[_J, _I] = sums[4:] * by[_I] * by[_J]
    basis = free_directions(theta, slope)
    if not basis.shape[1]:
        return 0.0, np.empty((0, 3))
    g, m = basis.T @ slope, basis.T @ curve @ basis
    size = np.maximum(np.diag(m), 1e-12)
    gain = 0.25 * g @ np.linalg.solve(m + 1e-9 * np.diag(size), g)
    out = []
    for damping in DAMPING:
        step = basis @ np.linalg.solve(m + (damping * scale + 1e-9) * np.diag(size), -g)
        out.append([theta[0] * np.exp(np.clip(step[0], -3, 3)), *(theta[1:] + step[1:])])
    return float(gain), bounded(np.array(out))


class Search:
    """Best scored candidate of each window of a series, shared candidates for the next pass, and which windows are done."""

    def __init__(self, best: np.ndarray, stalled: np.ndarray):
        self.best, self.stalled = best, stalled  # (windows, 3 + TERMS): parameters and sums; passes without a better candidate
        self.theta = np.empty((0, 3))
        self.gains = np.full(len(best), np.inf)

    @classmethod
    def of(cls, windows: int) -> Search:
        return cls(np.full((windows, 3 + TERMS), np.inf), np.zeros(windows, int))

    def take(self, theta: np.ndarray, sums: np.ndarray) -> None:
        """Takes the sums (windows, TERMS, candidates) of a pass and proposes the next candidates; none if all windows are done."""
        value = np.where(np.isfinite(sums[:, 0]), sums[:, 0], np.inf)
        pick = value.argmin(1)
        rows = np.arange(len(pick))
        better = value[rows, pick] < self.best[:, 3]
        self.best[better] = np.concatenate([theta[pick], sums[rows, :, pick]], axis=1)[better]
        self.stalled = np.where(better, 0, self.stalled + 1)
        steps = [scoring_steps(b[:3], b[3:], 10.0**s) if np.isfinite(b).all() else (0.0, None) for b, s in zip(self.best, self.stalled)]
        self.gains = np.array([gain for gain, _ in steps])
        open_ = np.flatnonzero((self.gains > TOLERANCE) & (self.stalled < 6))
        asked = open_[np.unique(np.linspace(0, len(open_) - 1, min(PROPOSERS, len(open_))).astype(int))] if len(open_) else open_
        self.theta = np.unique(np.concatenate([steps[k][1] for k in asked]), axis=0) if len(asked) else np.empty((0, 3))
