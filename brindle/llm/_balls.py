"""Metric trees over the parts of a chunk of vectors, built from anchors, and the walk that assigns their points."""

from __future__ import annotations

import math

import numpy as np

#: Points of a leaf at most, and pairs of a point and an entry that are compared at once.
LEAF, AT_ONCE = 64, 1 << 18


def node_kind(width: int) -> np.dtype:
    """A ball: its part, its points in tree order, its children (-1: a leaf), centre and radius, and the cached sum of its points."""
    return np.dtype([("part", "<i4"), ("start", "<i4"), ("end", "<i4"), ("left", "<i4"), ("right", "<i4"), ("radius", "<f8"), ("centre", "<f8", (width,)), ("sum", "<i8", (width,))])


def anchors(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of each anchor's points: every point belongs to its nearest anchor.

    A new anchor is the point that is farthest from its own, and takes over what is nearer to it; points that are nearer to
    their anchor than half of the way between both anchors can't be, and aren't looked at.
    """
    pivots = x[:1]
    owner, away = np.zeros(len(x), np.int64), np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(pivots) < most:
        far = int(away.argmax())
        if away[far] == 0:
            break
        new = x[far]
        between = np.sqrt(((pivots - new) ** 2).sum(axis=1))
        open_ = np.flatnonzero(away > between[owner] / 2)
        distance = np.sqrt(((x[open_] - new) ** 2).sum(axis=1))
        nearer = distance < away[open_]
        owner[open_[nearer]], away[open_[nearer]] = len(pivots), distance[nearer]
        pivots = np.concatenate([pivots, new[None]])
    order = np.argsort(owner, kind="stable")
    return [a for a in np.split(order, np.cumsum(np.bincount(owner, minlength=len(pivots)))[:-1]) if len(a)]


def grown(x: np.ndarray, rows: np.ndarray) -> tuple:
    """(rows, left, right): a tree of the rows, from the middle out.

    About sqrt(n) anchors are the middle.  What lies under each grows in the same way; above them the two balls whose common ball is
    smallest are joined until one is left.
    """
    own = x[rows]
    if len(rows) <= LEAF or (own == own[0]).all():
        return rows, None, None
    parts = anchors(own, max(2, math.isqrt(len(rows))))
    nodes = [grown(x, rows[a]) for a in parts]
    sizes = np.array([len(a) for a in parts], np.float64)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes.astype(np.int64)
    inside = own[np.concatenate(parts)]
    centres = np.add.reduceat(inside, starts) / sizes[:, None]
    radii = np.sqrt(np.maximum.reduceat(((inside - np.repeat(centres, sizes.astype(np.int64), axis=0)) ** 2).sum(axis=1), starts))
    common = (np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + radii[:, None] + radii[None]) / 2
    np.fill_diagonal(common, np.inf)
    gone = np.zeros(len(parts), bool)
    for _ in range(len(parts) - 1):
        i, j = divmod(int(common.argmin()), len(common))
        nodes[i] = (np.concatenate([nodes[i][0], nodes[j][0]]), nodes[i], nodes[j])
        centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / (sizes[i] + sizes[j])
        radii[i], sizes[i] = common[i, j], sizes[i] + sizes[j]
        gone[j] = True
        common[j] = common[:, j] = np.inf
        off = centres - centres[i]
        to = (np.sqrt(np.einsum("ij,ij->i", off, off)) + radii + radii[i]) / 2
        to[gone] = to[i] = np.inf
        common[i] = common[:, i] = to
    return nodes[i]


class Trees:
    """The trees of all parts of a chunk of vectors."""

    def __init__(self, nodes: np.ndarray, roots: np.ndarray, points: np.ndarray, order: np.ndarray):
        #: points are in tree order, part after part; ``order`` holds the row of the chunk that each is of
        self.nodes, self.roots, self.points, self.order = nodes, roots, points, order

    @classmethod
    def of(cls, vectors: np.ndarray, parts: int) -> Trees:
        n, width = len(vectors), vectors.shape[1] // parts
        found, roots, points, orders = [], [], [], []

        def put(part: int, tree: tuple, start: int) -> int:
            rows, left, right = tree
            at = len(found)
            found.append(None)
            below = (-1, -1) if left is None else (put(part, left, start), put(part, right, start + len(left[0])))
            found[at] = (part, start, start + len(rows), *below)
            return at

        for part in range(parts):
            x = np.ascontiguousarray(vectors[:, part * width : (part + 1) * width])
            tree = grown(x, np.arange(n))
            roots.append(put(part, tree, part * n))
            points.append(x[tree[0]])
            orders.append(tree[0])
        every = np.concatenate(points)
        nodes = np.zeros(len(found), node_kind(width))
        for name, values in zip(("part", "start", "end", "left", "right"), np.array(found).T, strict=True):
            nodes[name] = values
        until = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(every, axis=0)])
        nodes["sum"] = until[nodes["end"]] - until[nodes["start"]]
        nodes["centre"] = nodes["sum"] / (nodes["end"] - nodes["start"])[:, None]
        sizes = nodes["end"] - nodes["start"]
        for some in np.array_split(np.arange(len(nodes)), max(1, int(sizes.sum()) // AT_ONCE)):
            count = sizes[some].astype(np.int64)
            first = np.cumsum(count) - count
            off = every[np.arange(count.sum()) + np.repeat(nodes["start"][some] - first, count)] - np.repeat(nodes["centre"][some], count, axis=0)
            nodes["radius"][some] = np.sqrt(np.maximum.reduceat((off * off).sum(axis=1), first))
        return cls(nodes, np.array(roots), every, np.concatenate(orders))

    def walk(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(balls, entries that own them wholly, open points, key of each point, comparisons).

        A ball inherits from its parent the list of entries that may be nearest to some point in it.  Of these one is nearest
        to its centre; another one goes if even the point of the ball that is farthest on its side is still strictly nearer to that one.
        One entry left owns the ball.  In a leaf the points are compared with the entries left; a point's key is its squared
        distance times the number of entries, plus the entry.
        """
        n_entries, nodes = books.shape[1], self.nodes
        floats = books.astype(np.float64)
        node, entry = np.repeat(self.roots, n_entries), np.tile(np.arange(n_entries), len(self.roots))
        owned_nodes, owned_by, open_pairs, compared = [], [], [], 0
        while len(node):
            compared += len(node)
            part = nodes["part"][node]
            at = floats[part, entry]
            square = ((nodes["centre"][node] - at) ** 2).sum(axis=1)
            new = np.ones(len(node), bool)
            new[1:] = node[1:] != node[:-1]
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            least = np.minimum.reduceat(square, starts)
            hits = np.flatnonzero(square == least[group])
            nearest = hits[np.searchsorted(group[hits], np.arange(len(starts)))]
            gap = np.sqrt(((at - at[nearest][group]) ** 2).sum(axis=1))
            lead, reach = square - least[group], 2 * nodes["radius"][node] * gap
            keep = lead - reach <= 1e-9 * (square + least[group] + reach)
            node, entry, group = node[keep], entry[keep], group[keep]
            left = np.bincount(group, minlength=len(starts))[group]
            alone, leaf = left == 1, nodes["left"][node] < 0
            owned_nodes.append(node[alone])
            owned_by.append(entry[alone])
            rest = ~alone & leaf
            open_pairs.append((node[rest], entry[rest]))
            down = ~alone & ~leaf
            node, entry = np.concatenate([nodes["left"][node[down]], nodes["right"][node[down]]]), np.concatenate([entry[down], entry[down]])
            order = np.argsort(node, kind="stable")
            node, entry = node[order], entry[order]
        keys = np.full(len(self.points), np.iinfo(np.int64).max)
        pairs, entries = (np.concatenate(x) for x in zip(*open_pairs, strict=True))
        sizes = (nodes["end"] - nodes["start"])[pairs]
        compared += int(sizes.sum())
        for some in np.split(np.arange(len(pairs)), np.searchsorted(np.cumsum(sizes), np.arange(AT_ONCE, sizes.sum(), AT_ONCE))):
            if len(some):
                count = sizes[some]
                point = np.arange(count.sum()) + np.repeat(nodes["start"][pairs[some]] - (np.cumsum(count) - count), count)
                by = np.repeat(entries[some], count)
                off = self.points[point] - books[np.repeat(nodes["part"][pairs[some]], count), by]
                np.minimum.at(keys, point, (off * off).sum(axis=1) * n_entries + by)
        return np.concatenate(owned_nodes), np.concatenate(owned_by), np.flatnonzero(keys < np.iinfo(np.int64).max), keys, compared

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums (parts, entries, width) and counts (parts, entries) of the points that each entry is nearest to."""
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        balls, entries, open_, keys, _ = self.walk(books)
        np.add.at(sums, (self.nodes["part"][balls], entries), self.nodes["sum"][balls])
        np.add.at(counts, (self.nodes["part"][balls], entries), (self.nodes["end"] - self.nodes["start"])[balls])
        part, entry = open_ // (len(self.points) // len(books)), keys[open_] % books.shape[1]
        np.add.at(sums, (part, entry), self.points[open_])
        np.add.at(counts, (part, entry), 1)
        return sums, counts

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of the chunk the entries of its parts and the sum of their squared distances."""
        balls, entries, _, keys, _ = self.walk(books)
        n, k = len(self.points) // len(books), books.shape[1]
        count = (self.nodes["end"] - self.nodes["start"])[balls]
        point = np.arange(count.sum()) + np.repeat(self.nodes["start"][balls] - (np.cumsum(count) - count), count)
        by = np.repeat(entries, count)
        off = self.points[point] - books[point // n, by]
        keys[point] = (off * off).sum(axis=1) * k + by
        codes, errors = np.zeros((n, len(books)), np.int64), np.zeros(n, np.int64)
        codes[self.order, np.arange(len(keys)) // n] = keys % k
        np.add.at(errors, self.order, keys // k)
        return codes, errors
