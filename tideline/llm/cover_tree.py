"""A cover tree over vectors whose inner products are asked for.

Each vector gets one more component, sqrt(M^2 - |x|^2) for the largest length M, so all have
length M and the inner product with a query (and 0) falls with the angle. A node covers a run of
rows within its radius (an angle) of a center; its children are centers at least half that radius
apart, found farthest first, each with the rows nearest to it. When half the radius would need more
than FANOUT centers, the nodes below go on at the same radius. Radii are those of the rows that
are covered, so a query at angle t from a center of radius r has inner products between
|q| M cos(t + r) and |q| M cos(t - r) with all of them.
"""

from __future__ import annotations

import heapq

import numpy as np

FANOUT, LEAF = 8, 512
SLACK = 1e-6  # of |q| M: angles are rounded, bounds must not be
EXACT = float(1 << 53)  # doubles add integers exactly below this


def augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors with the added component; all zero if there is no length."""
    vectors = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1) / (longest or 1.0)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def farthest_first(units: np.ndarray, limit: int, within: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centers picked farthest first from row 0 on, until all rows are ``within`` an angle of one or ``limit`` are picked.

    Returns the centers, and each row's nearest center and angle to it.
    """
    centers, nearest = [0], np.zeros(len(units), np.int64)
    cosine = units @ units[0]
    while len(centers) < limit:
        far = int(cosine.argmin())
        if angles(cosine[far]) <= within or cosine[far] >= 1 - 1e-12:
            break
        new = units @ units[far]
        closer = new > cosine
        nearest[closer], cosine[closer] = len(centers), new[closer]
        centers.append(far)
    return centers, nearest, angles(cosine)


def bounds(query_length: float, longest: float, theta: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of a query at angle theta from centers with what they cover."""
    scale = query_length * longest
    high = scale * np.cos(np.maximum(theta - radius, 0)) + SLACK * scale
    low = scale * np.cos(np.minimum(theta + radius, np.pi)) - SLACK * scale
    return low, high


class CoverTree:
    """Rows (id, label, vector of integers) of one block; ids are unique."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max()))
        units = augmented(vectors[order], self.longest)
        start, stop, first, count, center, radius = [0], [len(ids)], [0], [0], [], []
        whole = angles(units @ units[0]) if self.longest else np.zeros(len(ids))
        center.append(units[0, :-1].copy())
        radius.append(float(whole.max()))
        node = 0
        while node < len(start):  # children are appended side by side
            a, b = start[node], stop[node]
            if b - a > leaf and radius[node] > 1e-6:
                own = units[a:b]
                picked, nearest, angle = farthest_first(own, fanout, radius[node] / 2)
                if len(picked) > 1:
                    inner = np.argsort(nearest, kind="stable")
                    sizes = np.bincount(nearest, minlength=len(picked))
                    first[node], count[node] = len(start), len(picked)
                    edges = a + np.concatenate([[0], np.cumsum(sizes)])
                    reach = np.zeros(len(picked))
                    np.maximum.at(reach, nearest, angle)
                    for k, row in enumerate(picked):
                        start.append(int(edges[k]))
                        stop.append(int(edges[k + 1]))
                        first.append(0)
                        count.append(0)
                        center.append(own[row, :-1].copy())
                        radius.append(float(reach[k]))
                    units[a:b], order[a:b] = own[inner], order[a:b][inner]
            if not count[node]:  # a leaf's rows of one label lie side by side
                inner = np.lexsort((order[a:b], labels[order[a:b]]))
                order[a:b] = order[a:b][inner]
            node += 1
        self.ids, self.labels = ids[order], labels[order]
        self.largest = float(np.abs(vectors).max(initial=0))
        self.whole_numbers = vectors[order].astype(np.int64)
        self.vectors = self.whole_numbers.astype(np.float64)
        self.start, self.stop, self.first, self.count = start, stop, first, count
        self.center, self.radius = np.stack(center), np.array(radius)
        edges = np.array([start, stop]).T
        self.low_label = np.array([self.labels[a:b].min() for a, b in edges])
        self.high_label = np.array([self.labels[a:b].max() for a, b in edges])

    def fitted(self, query: np.ndarray) -> np.ndarray:
        """The query in as many dimensions as the rows, missing components zero; as doubles if they add its products exactly."""
        width = self.vectors.shape[1]
        if len(query) != width:
            query = np.concatenate([query, np.zeros(max(width - len(query), 0), query.dtype)])[:width]
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(width, 1) < EXACT
        return query.astype(np.float64) if exact else query

    def _scores(self, query: np.ndarray, a: int, b: int) -> np.ndarray:
        if query.dtype == np.float64:
            return (self.vectors[a:b] @ query).astype(np.int64)
        return self.whole_numbers[a:b] @ query

    def _descend(self, query: np.ndarray, spans: list[list[float]], may: np.ndarray):
        """Leaves (start, stop) by falling upper bound, of the nodes that ``may`` matter and whose bounds cross a span (low, high).

        The spans may be narrowed between leaves.
        """
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        # lengths of 0 leave one node or no angle: the root's bounds are 0 then, which is right
        queue = [(-np.inf, -np.inf, 0)] if may[0] else []
        unit = query / length if length else query.astype(np.float64)
        while queue:
            high, low, node = heapq.heappop(queue)
            if not any(-high >= bar and low <= top for bar, top in spans):
                continue
            if not self.count[node]:
                yield self.start[node], self.stop[node]
                continue
            first = self.first[node]
            inside = slice(first, first + self.count[node])
            lows, highs = bounds(length, self.longest, angles(self.center[inside] @ unit), self.radius[inside])
            for k, (low, high, ok) in enumerate(zip(lows.tolist(), highs.tolist(), may[inside].tolist())):
                if ok and any(high >= bar and low <= top for bar, top in spans):
                    heapq.heappush(queue, (-high, low, first + k))

    @staticmethod
    def _merged(best: list, scores: np.ndarray, ids: np.ndarray, k: int) -> list:
        """The first k of what is known and what is new, by falling score, then id."""
        take = np.lexsort((ids, -scores))[:k]
        return sorted([*best, *zip((-scores[take]).tolist(), ids[take].tolist())])[:k]

    def nearest_of_label(self, query: np.ndarray, label: int, but: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of the first k rows of the label, without the row ``but`` and those below ``floor``."""
        best: list = []
        query = self.fitted(query)
        span = [floor, np.inf]
        for a, b in self._descend(query, [span], (self.low_label <= label) & (label <= self.high_label)):
            low, high = np.searchsorted(self.labels[a:b], (label, label + 1))
            if low == high:
                continue
            a, b = a + int(low), a + int(high)
            scores = self._scores(query, a, b)
            hit = np.flatnonzero(scores >= span[0])
            hit = hit[self.ids[a:b][hit] != but]
            if len(hit):
                best = self._merged(best, scores[hit], self.ids[a:b][hit], k)
                if len(best) == k:
                    span[0] = max(floor, -best[-1][0])
        return [(-s, i) for s, i in best]

    def windows_of_other_labels(self, query: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores, (score, id) of its first k rows of other labels."""
        best: list[list] = [[] for _ in windows]
        query = self.fitted(query)
        spans = [list(w) for w in windows]
        top = max((w[1] for w in windows), default=0)
        met: list[tuple] = []

        def settle() -> None:
            """Take what was met into each window's first rows, and narrow the window."""
            found, ids = (np.concatenate(x) for x in zip(*met))
            order = np.lexsort((ids, -found))
            found, ids = found[order], ids[order]
            for w, span in enumerate(spans):
                low, high = np.searchsorted(-found, (-span[1], -span[0]), "left")
                high += int((found[high:] == span[0]).sum())
                if low < high:
                    best[w] = sorted([*best[w], *zip((-found[low:high][:k]).tolist(), ids[low:high][:k].tolist())])[:k]
                    if len(best[w]) == k:
                        span[0] = max(span[0], -best[w][-1][0])
            met.clear()

        for a, b in self._descend(query, spans, (self.low_label != label) | (self.high_label != label)):
            scores = self._scores(query, a, b)
            hit = np.flatnonzero((scores >= min(s[0] for s in spans)) & (scores <= top))
            hit = hit[self.labels[a:b][hit] != label]
            if len(hit):
                met.append((scores[hit], self.ids[a:b][hit]))
                if sum(len(m[0]) for m in met) >= 16 * k:
                    settle()
        if met:
            settle()
        return [[(-s, i) for s, i in w] for w in best]
