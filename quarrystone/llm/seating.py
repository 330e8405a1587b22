"""Tables of Chinese restaurants with a discount, drawn from their full conditionals.

The state of a dish in a restaurant is its number of tables t for c customers. Given all other dishes, and the
parent's tables, that number has the weight

    S(c, t) * (theta + d T)(theta + d (T + 1)) ... (theta + d (T + t - 1)) * parent(t)

where S are the generalised Stirling numbers of the discount d, T the other dishes' tables (its own are left
out), and parent(t) is what t more customers of this dish do to the parent's seating: S(C + t, tables above) over the
rising product of the parent's strength and customers, or a fixed base probability to the power t. Drawing from
these weights in turn is a Gibbs sampler of the seating with the seats of customers summed out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Up to so many customers the Stirling numbers come from their recursion; beyond, from their saddle point.
EXACT = 512
_known: dict[float, np.ndarray] = {}
_grown: dict[float, np.ndarray] = {}
#: Weights that are held at once.
ENTRIES = 1 << 16


def log_stirling(d: float) -> np.ndarray:
    """Logarithms of S(c, t) of discount ``d`` for c and t up to ``EXACT``: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    if d not in _known:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[0, 0] = 0.0
        t = np.arange(1, EXACT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(EXACT):
                more = np.log(np.where(t <= c, c - d * t, 1.0)) + out[c, 1:]
                out[c + 1, 1:] = np.logaddexp(out[c, :-1], more)
        _known[d] = out
    return _known[d]


def _growth(d: float) -> np.ndarray:
    """S(c + 1, t) / S(c, t), a row of t after another; large where the customer is needed and 1 where it is not enough."""
    if d not in _grown:
        s = log_stirling(d)
        with np.errstate(invalid="ignore", over="ignore"):
            _grown[d] = np.nan_to_num(np.exp(s[1:] - s[:-1]), nan=1.0, posinf=1e300).ravel()
    return _grown[d]


def _running(x: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums in each row, in place."""
    before = -x[start]
    np.cumsum(x, out=x)
    before += x[start]
    x -= before[row]
    return x


@dataclass
class Parent:
    """The parent's cells of the dishes, without the customers that the dishes' own tables are."""

    customers: np.ndarray
    tables: np.ndarray
    discount: float
    fresh: np.ndarray  # weight of a new table: (theta + d T) times the grandparent's probability
    total: np.ndarray  # theta and all customers of the parent

    def take(self, rows: np.ndarray) -> Parent:
        return Parent(self.customers[rows], self.tables[rows], self.discount, self.fresh[rows], self.total[rows])

    def second(self) -> np.ndarray:
        """What a second customer more adds to the weight of the first."""
        c = self.customers + 1
        out = _growth(self.discount)[np.minimum(c, EXACT - 1) * (EXACT + 1) + np.minimum(self.tables, EXACT)]
        many = np.flatnonzero(c >= EXACT)
        if len(many):
            out[many] = np.maximum(c[many] - self.discount * np.minimum(self.tables[many], c[many]) + self.fresh[many], 1e-300)
        return out / (self.total + 1)

    def log_weights(self, row: np.ndarray, j: np.ndarray, start: np.ndarray, rising: np.ndarray) -> np.ndarray:
        """Of j + 1 more customers of each row's dish, times the running products of ``rising``."""
        c = self.customers[row] + j
        rising /= self.total[row] + j
        far = self.customers + np.diff(start, append=len(row)) > EXACT  # beyond the recursion
        if far.any():
            at = np.flatnonzero(far[row])
            r, more = row[at], c[at]
            rising[at] *= np.maximum(more - self.discount * np.minimum(self.tables[r], more) + self.fresh[r], 1e-300)
        out = _running(np.log(rising, out=rising), row, start)
        base = EXACT + 1 + np.minimum(self.tables, EXACT)
        known = log_stirling(self.discount).ravel()
        if far.any():
            at = np.flatnonzero(~far[row])
            out[at] += known[c[at] * (EXACT + 1) + base[row[at]]]
        else:
            out += known[c * (EXACT + 1) + base[row]]
        return out


def draw(count: np.ndarray, others: np.ndarray, d: float, theta: float, parent: Parent | float, rng: np.random.Generator) -> np.ndarray:
    """A number of tables for each dish with ``count`` customers, where ``others`` is T; a number as ``parent`` is a fixed base."""
    out = np.minimum(count, 1)
    two = np.flatnonzero(count == 2)
    if len(two):
        up = parent.take(two).second() if isinstance(parent, Parent) else parent
        odds = (theta + d * (others[two] + 1)) * up / (1 - d)
        out[two] += rng.random(len(two)) * (1 + odds) < odds
    some = np.flatnonzero((count > 2) & (count <= EXACT))
    for r in np.split(some, np.flatnonzero(np.diff(np.cumsum(count[some]) // ENTRIES)) + 1):
        if len(r):
            out[r] = _draw_some(count[r], others[r], d, theta, parent.take(r) if isinstance(parent, Parent) else parent, rng)
    many = np.flatnonzero(count > EXACT)
    for x in range(0, len(many), 2048):
        r = many[x : x + 2048]
        out[r] = _draw_many(count[r].astype(np.float64), others[r], d, theta, parent.take(r) if isinstance(parent, Parent) else parent, rng)
    return out


def _draw_some(count: np.ndarray, others: np.ndarray, d: float, theta: float, parent: Parent | float, rng: np.random.Generator) -> np.ndarray:
    """Draws by the weights of every possible number of tables, one dish's after another's."""
    start = np.cumsum(count) - count
    row = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(row)) - start[row]
    w = d * (others[row] + j)
    w += theta
    if isinstance(parent, Parent):
        w = parent.log_weights(row, j, start, w)
    else:
        w *= parent
        w = _running(np.log(w, out=w), row, start)
    w += log_stirling(d).ravel()[(count * (EXACT + 1) + 1)[row] + j]
    top = np.maximum.reduceat(w, start)
    never = np.isneginf(top)  # the parent's tables, as they last were, need more customers: one table
    w[start[never]] = top[never] = 0.0
    w -= top[row]
    below = np.cumsum(np.exp(w, out=w), out=w)
    before = np.append(0.0, below)[start]
    at = np.searchsorted(below, before + rng.random(len(count)) * (below[start + count - 1] - before), side="right")
    return np.clip(at - start, 0, count - 1) + 1


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series, after four steps up for its accuracy."""
    shift = np.log(z * (z + 1) * (z + 2) * (z + 3))
    z = z + 4
    more = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + more * (1 / 12 - more * more / 360) - shift


def _draw_many(c: np.ndarray, others: np.ndarray, d: float, theta: float, parent: Parent | float, rng: np.random.Generator) -> np.ndarray:
    """Draws from the same weights, with S(c, t) by the saddle point of its generating function ((1 - (1 - x)**d) / d)**t / t!.

    At the saddle point y = 1 - x stands for t = c (1 - y**d) y**(1 - d) / (d (1 - y)). A grid of y is narrowed to where the weights lie.
    """
    c, others = c[:, None], others[:, None]

    def weights(log_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.exp(log_y)
        x, f = -np.expm1(log_y), -np.expm1(d * log_y)
        t = c * f * y ** (1 - d) / (d * x)
        g = d * y ** (d - 1) / f
        spread = x * (g + x * (1 - d) * g / y - x * g * g)
        w = t * np.log(f) - c * np.log(x) - 0.5 * np.log(t * spread) - _log_gamma(t + 1) + _log_gamma(theta / d + others + t)
        if isinstance(parent, Parent):
            rest = np.maximum(parent.customers - d_up * np.minimum(parent.tables, parent.customers) + parent.fresh, 1e-6)[:, None]
            return t, w + _log_gamma(rest + t) - _log_gamma(parent.total[:, None] + t)
        return t, w + t * np.log(parent)

    d_up = parent.discount if isinstance(parent, Parent) else 0.0
    low, high = np.log(0.5 * d / c) / (1 - d), np.full_like(c, -1e-6)
    rows = np.arange(len(c))
    for _ in range(3):
        grid = low + (high - low) * np.linspace(0, 1, 200)[None, :]
        t, w = weights(grid)
        near = w > w.max(axis=1, keepdims=True) - 25
        first, last = near.argmax(axis=1), 199 - near[:, ::-1].argmax(axis=1)
        low, high = grid[rows, np.maximum(first - 1, 0)][:, None], grid[rows, np.minimum(last + 1, 199)][:, None]
    wide = np.gradient(t, axis=1)
    at = np.argmax(w + np.log(np.maximum(wide, 1e-300)) - np.log(-np.log(rng.random(w.shape))), axis=1)
    found = t[rows, at] + (rng.random(len(c)) - 0.5) * wide[rows, at]
    return np.clip(np.round(found), 1, c[:, 0]).astype(np.int64)


def turns(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, most: int = 12, rest: int = 8) -> list[np.ndarray]:
    """Rows in turns so that, but for the last ones, no two of a turn share their restaurant ``a`` or their cell above ``b``.

    What ``most`` turns leave, dishes of restaurants with many of them, is drawn in ``rest`` turns at once.
    """
    left, out = np.arange(len(a)), []
    best_a, best_b = (np.empty(int(x.max()) + 1 if len(x) else 0, np.int64) for x in (a, b))
    for _ in range(most):
        if not len(left):
            return out
        first = rng.permutation(len(left))
        at_a, at_b = a[left], b[left]
        best_a[at_a] = best_b[at_b] = len(a)
        np.minimum.at(best_a, at_a, first)
        np.minimum.at(best_b, at_b, first)
        won = (first == best_a[at_a]) & (first == best_b[at_b])
        out.append(left[won])
        left = left[~won]
    return out + [x for x in np.array_split(rng.permutation(left), rest) if len(x)]
