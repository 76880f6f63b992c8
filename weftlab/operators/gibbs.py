"""A part of a network in one task of the sampler: edges, the modules they can see, and their moves.

Edges are drawn in levels. Within a part they have an order by hash; an edge's level is one more than the highest level of the earlier edges
at its two genes. Edges of a level share no gene, so none of them offers a module to another one, and a level is drawn at once;
edges that share a gene are drawn one after the other, each from the counts that the moves before it have left.
"""

from __future__ import annotations

import math

import numpy as np


def hashed(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random 64-bit numbers of whole numbers."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(seed & (1 << 63) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def levels(g1: np.ndarray, g2: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The level of each edge for genes numbered from 0; order: the edges, first to last."""
    free, out = [0] * (int(max(g1.max(), g2.max())) + 1), np.zeros(len(g1), np.int64)
    a, b = g1.tolist(), g2.tolist()
    for e in order.tolist():
        level = max(free[a[e]], free[b[e]])
        out[e] = level
        free[a[e]] = free[b[e]] = level + 1
    return out


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the runs, place) for runs of n places from `first` on."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def laid(eid: np.ndarray, g1: np.ndarray, g2: np.ndarray, samples: list[np.ndarray]) -> dict[str, np.ndarray]:
    """What stays of a part while it is drawn, as arrays: edges by ascending id, their genes by number, edges by gene and by level, samples of each edge."""
    order = np.argsort(eid)
    eid, samples = eid[order], [np.asarray(samples[i], np.int64) for i in order]
    genes, at = np.unique(np.concatenate([g1[order], g2[order]]), return_inverse=True)
    a, b = at[: len(eid)], at[len(eid) :]
    level = levels(a, b, np.argsort(hashed(eid, 0)))
    return {
        "eid": eid, "genes": genes, "g1": a, "g2": b, "incident": np.argsort(at, kind="stable") % len(eid), "degree": np.bincount(at, minlength=len(genes)),
        "sample": np.concatenate([np.zeros(0, np.int64), *samples]), "n_samples": np.array([len(s) for s in samples], np.int64), "by_level": np.argsort(level, kind="stable"), "in_level": np.bincount(level),
    }


class Part:
    """Edges (eid, genes, samples as numbers below n) with the module of each.

    held: (module, sample, ones) of all modules that the part can see, edges of other parts included, with their sizes at sample -1; by default
    the counts of the part's own edges. offered: (gene, module) that edges of other parts offer at the part's genes."""

    def __init__(self, eid: np.ndarray, g1: np.ndarray, g2: np.ndarray, samples: list[np.ndarray], module: np.ndarray, n: int, alpha: float, beta: float, seed: int, held: tuple[np.ndarray, ...] | None = None, offered: tuple[np.ndarray, np.ndarray] | None = None):
        fixed, module = laid(eid, g1, g2, samples), module[np.argsort(eid)]
        seen = [fixed["eid"], module, *([held[0]] if held else []), *([offered[1]] if offered else [])]
        modules, counts, far = np.unique(np.concatenate(seen)), None, None
        if held:
            k, size = np.searchsorted(modules, held[0]), held[1] < 0
            counts = np.zeros((len(modules), n), np.int32), np.zeros(len(modules), np.int64)
            counts[1][k[size]] = held[2][size]
            counts[0][k[~size], held[1][~size]] = held[2][~size]
        if offered:
            genes = fixed["genes"]
            g = np.searchsorted(genes, offered[0])
            known = np.flatnonzero((g < len(genes)) & (genes[np.minimum(g, len(genes) - 1)] == offered[0]))
            known = known[np.argsort(g[known], kind="stable")]
            far = np.bincount(g[known], minlength=len(genes)), [np.searchsorted(modules, offered[1][known])]
        self._start(fixed, modules, np.searchsorted(modules, module), np.searchsorted(modules, fixed["eid"]), n, alpha, beta, seed, counts, far)

    @classmethod
    def of(cls, *what) -> Part:
        """A part from its fixed arrays and what `_start` takes besides."""
        part = cls.__new__(cls)
        part._start(*what)
        return part

    def _start(self, fixed: dict[str, np.ndarray], modules: np.ndarray, label: np.ndarray, founding: np.ndarray, n: int, alpha: float, beta: float, seed: int, counts: tuple[np.ndarray, np.ndarray] | None = None, far: tuple[np.ndarray, list[np.ndarray]] | None = None) -> None:
        """label, founding: places in modules (ascending) of each edge's module and id. counts: (ones, sizes) of modules; by default of the part's own
        edges. far: number of offers of other parts' edges per gene, and places of what they offer, by gene; each list has one module per offer."""
        self.eid, self.g1, self.g2, self.incident, self.degree = (fixed[c] for c in ("eid", "g1", "g2", "incident", "degree"))
        self.n, self.alpha, self.beta, self.seed = n, alpha, beta, seed
        self.modules, self.label, self.founding = modules, label, founding
        self.sample, self.n_samples = fixed["sample"], fixed["n_samples"]
        self.first_sample = np.cumsum(self.n_samples) - self.n_samples
        self.first = np.cumsum(self.degree) - self.degree
        self.n_offers, self.offers = far if far else (np.zeros(len(self.degree), np.int64), [])
        self.first_offer = np.cumsum(self.n_offers) - self.n_offers
        self.levels = np.split(fixed["by_level"], np.cumsum(fixed["in_level"])[:-1])
        if counts is None:
            which, s = self._samples(np.arange(len(self.eid)))
            counts = np.bincount(label[which] * n + s, minlength=len(modules) * n).astype(np.int32).reshape(len(modules), n), np.bincount(label, minlength=len(modules))
        self.ones, self.m = counts
        self.touched = np.zeros(len(modules), bool)
        self.log = np.log(np.arange(len(self.eid) + int(self.m.max(initial=0)) + 2) + alpha / 2)
        self.base, self.base_own = np.zeros(len(self.m)), np.zeros(len(self.m))
        self._refresh(np.flatnonzero(self.m > 1))

    def _samples(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the edges, sample) of all their samples."""
        which, place = spread(self.first_sample[edges], self.n_samples[edges])
        return which, self.sample[place]

    def _refresh(self, k: np.ndarray) -> None:
        """What modules of more than one edge add whatever the edge, as they are and with one edge less; samples that an edge has are put right in loglik."""
        k = k[self.m[k] > 1]
        for at in range(0, len(k), 4096):
            some = k[at : at + 4096]
            m = self.m[some]
            rest = m[:, None] - self.ones[some]
            self.base[some] = self.log[rest].sum(axis=1) - self.n * np.log(m + self.alpha) + np.log(m + self.beta)
            self.base_own[some] = self.log[np.maximum(rest - 1, 0)].sum(axis=1) - self.n * np.log(m - 1 + self.alpha) + np.log(m - 1 + self.beta)

    def candidates(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, module) of the modules with edges that are offered to each of the edges, owners ascending, and of the empty ones: modules and
        founding ids of all edges at their genes, themselves included."""
        owner = np.concatenate([np.arange(len(edges))] * 2)
        gene = np.concatenate([self.g1[edges], self.g2[edges]])
        which, place = spread(self.first[gene], self.degree[gene])
        near, who = self.incident[place], owner[which]
        again = (near == edges[who]) & (which >= len(edges))  # the edge itself, at its second gene
        found, at = self.founding[near[~again]], who[~again]
        which, place = spread(self.first_offer[gene], self.n_offers[gene])
        by = owner[which]
        k, at = np.concatenate([self.label[near], found, *[o[place] for o in self.offers]]), np.concatenate([who, at, *[by for _ in self.offers]])
        some = self.m[k] > 0
        key = np.sort(at[some] * len(self.m) + k[some])
        key = key[np.append(True, key[1:] != key[:-1])]
        return key // len(self.m), key % len(self.m), at[~some], k[~some]

    def loglik(self, edges: np.ndarray, owner: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The log-probability of each pair of an edge and a module with edges, the edge itself removed first. Only the samples of an edge are looked at."""
        own = k == self.label[edges[owner]]
        m = self.m[k] - own
        which, s = self._samples(edges[owner])
        one, some = m == 1, m > 1
        ones = self.ones.ravel()[k[which] * self.n + s] - own[which]
        half, a = self.alpha / 2, self.alpha
        rest = np.maximum(self.m[k][which] - ones - 2 * own[which], 0)  # of an own module what base_own has counted: an edge less, and the edge's samples still
        gain = np.bincount(which, self.log[ones] - self.log[rest], minlength=len(k))
        out = np.full(len(k), self.alone())
        out[some] = gain[some] + np.where(own, self.base_own[k], self.base[k])[some]
        match = np.bincount(which, ones, minlength=len(k))[one]
        out[one] = match * math.log((half + 1) / a) + (self.n - match) * math.log(half / a) + math.log(1 + self.beta)
        return out

    def alone(self) -> float:
        return self.n * math.log(0.5) + math.log(self.beta)

    def sweep(self, step: int, orders: float = 7.0) -> float:
        """Draw every edge once; the sum of the log-probabilities of what was drawn."""
        u, total = (hashed(self.eid, hash((self.seed, step)) & 0xFFFFFFFFFFFF) >> np.uint64(11)).astype(np.float64) / float(1 << 53), 0.0
        for edges in self.levels:
            owner, k, empty_owner, empty = self.candidates(edges)
            lp = self.loglik(edges, owner, k)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))  # every edge is offered its own module
            n_empty = np.bincount(empty_owner, minlength=len(edges))
            top = np.maximum(np.maximum.reduceat(lp, first), np.where(n_empty > 0, self.alone(), -np.inf))
            w = np.where(lp - top[owner] < -orders, 0.0, np.exp(lp - top[owner]))
            each = np.where(self.alone() - top < -orders, 0.0, np.exp(self.alone() - top))
            held = np.add.reduceat(w, first)
            target = u[edges] * (held + n_empty * each)
            run = np.cumsum(w)
            run -= np.repeat((run - w)[first], np.diff(np.append(first, len(w))))
            hit = (run > target[owner]) & (w > 0)
            place = np.where(hit, np.arange(len(w)), len(w))
            chosen = np.minimum.reduceat(place, first)
            new, got = np.zeros(len(edges), np.int64), np.zeros(len(edges))
            inside = chosen < len(w)
            new[inside], got[inside] = k[chosen[inside]], lp[chosen[inside]]
            rest = np.flatnonzero(~inside)
            if len(rest):
                by = np.argsort(empty_owner, kind="stable")
                start = np.cumsum(n_empty) - n_empty
                can = (n_empty[rest] > 0) & (each[rest] > 0)
                e = rest[can]
                new[e], got[e] = empty[by[start[e] + np.minimum(((target[e] - held[e]) / each[e]).astype(np.int64), n_empty[e] - 1)]], self.alone()
                for e in rest[~can]:  # rounding: the last that counts
                    last = first[e] + np.flatnonzero(w[owner == e])[-1]
                    new[e], got[e] = k[last], lp[last]
            self._move(edges, new)
            total += float(got.sum())
        return total

    def _move(self, edges: np.ndarray, new: np.ndarray) -> None:
        old = self.label[edges]
        some = new != old
        if some.any():
            edges, old, new = edges[some], old[some], new[some]
            which, s = self._samples(edges)
            ones = self.ones.ravel()
            np.subtract.at(ones, old[which] * self.n + s, 1)
            np.add.at(ones, new[which] * self.n + s, 1)
            np.subtract.at(self.m, old, 1)
            np.add.at(self.m, new, 1)
            self.label[edges] = new
            self.touched[old] = self.touched[new] = True
            self._refresh(np.unique(np.concatenate([old, new])))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(module, sample, ones) as in `held`."""
        k, s = np.nonzero(self.ones)
        size = np.flatnonzero(self.m)
        return np.append(self.modules[k], self.modules[size]), np.append(s, np.full(len(size), -1)), np.append(self.ones[k, s], self.m[size])


def window_change(history: np.ndarray) -> tuple[float, int]:
    """(sum of squares, number of terms) of the difference between the transition tables of the first and the last w of w + 1 steps, over the edges
    (rows) that have more than one state in both. Both tables share all but one step on either side, so only the rows of two states differ: of the state
    that the first table leaves in its first step, and of the one that the second leaves in its last."""
    total, terms = 0.0, 0
    for at in range(0, len(history), 8192):
        squares, n = _window_change(np.ascontiguousarray(history[at : at + 8192].T))
        total, terms = total + squares, terms + n
    return total, terms


def _window_change(h: np.ndarray) -> tuple[float, int]:
    w = len(h) - 1
    if w < 2:
        return 0.0, 0
    h = h[:, (h[1:w] != h[0]).any(axis=0) & (h[2:] != h[1]).any(axis=0)]
    rows = h.shape[1]
    first, last = h == h[0], h == h[w - 1]
    states = np.zeros((3, rows), np.int32)  # of the first table, the second, either
    pairs = np.zeros((2, rows), np.int32)  # of shared moves from the state to the same one
    for t in range(w + 1):
        seen, seen_two = np.zeros(rows, bool), np.zeros(rows, bool)
        for u in range(t):
            same = h[u] == h[t]
            seen |= same
            if u:
                seen_two |= same
            if u > 1 and t < w:  # the moves into steps u and t
                pairs[0] += same & first[u - 1] & first[t - 1]
                pairs[1] += same & last[u - 1] & last[t - 1]
        states += np.stack([~seen & (t < w), ~seen_two & (t > 0), ~seen])
    total, alike = 0.0, first[w - 1]
    for here, to, n in ((first, h[1], pairs[0]), (last, h[w], pairs[1])):
        d = here[1 : w - 1].sum(axis=0)
        c = (here[1 : w - 1] & (h[2:w] == to)).sum(axis=0)
        squares = np.where(d > 0, (d + 2 * n - 2 * d * c + d * d) / np.maximum(d * (d + 1), 1) ** 2, 1.0)  # whole numbers above, so equal shares give 0
        total += float(squares[~alike].sum())
    d = first[1 : w - 1].sum(axis=0)[alike]
    total += float((2.0 / (d + 1) ** 2)[(h[1] != h[w])[alike]].sum())
    one, two, either = states.astype(np.int64)
    return total, int((one * one + two * two - (one + two - either) ** 2).sum())
