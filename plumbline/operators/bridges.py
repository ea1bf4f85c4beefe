"""What the removal of each edge of a strongly connected graph leaves, for all edges in nearly linear time.

An edge (u, v) whose removal splits the graph is one that all paths from a start s to v pass (u is v's dominator and
every other edge into v comes from below v in the dominator tree D), or the same in the reversed graph. Without it,
nothing enters D(v), the nodes below v, and nothing leaves D'(u), those below u in the reversed graph's tree; what lies
in neither stays one component. Inside D(v) the components are the loops w of a loop nesting forest with w below v and the
loop around w not below v; so a loop counts for the tree nodes on the way from w up to where w and its outer loop
meet, which sums over subtrees give. Nodes in both D(v) and D'(u) count once: they are counted in rectangles of the two trees' orders.
"""

from __future__ import annotations

import numpy as np


def preorder(n: int, targets: list[list[int]], root: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth-first numbers of the nodes that ``root`` reaches, and by number each node's parent's number."""
    number, parent = [-1] * n, [0] * n
    number[root] = 0
    count, work = 1, [(root, iter(targets[root]))]
    while work:
        v, rest = work[-1]
        for w in rest:
            if number[w] < 0:
                number[w] = count
                parent[count] = number[v]
                count += 1
                work.append((w, iter(targets[w])))
                break
        else:
            work.pop()
    return np.array(number, np.int64), np.array(parent[:count], np.int64)


class Tree:
    """A rooted tree over 0..n-1 whose parents have smaller numbers; the root is its own parent."""

    def __init__(self, parent: np.ndarray):
        n = len(parent)
        self.parent, depth, size = parent, [0] * n, [1] * n
        up = parent.tolist()
        for v in range(1, n):
            depth[v] = depth[up[v]] + 1
        for v in range(n - 1, 0, -1):
            size[up[v]] += size[v]
        free, at = [1] * n, [0] * n
        for v in range(1, n):
            at[v] = at[up[v]] + free[up[v]]
            free[up[v]] += size[v]
        self.depth, self.begin = np.array(depth), np.array(at)
        self.end = self.begin + np.array(size)
        self.lifts = [parent]
        while len(self.lifts) < max(1, int(self.depth.max()).bit_length()):
            self.lifts.append(self.lifts[-1][self.lifts[-1]])

    def below(self, v: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Whether each v is its ``top`` or below it."""
        return (self.begin[v] >= self.begin[top]) & (self.begin[v] < self.end[top])

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The nearest node that each pair is below."""
        out = a.copy()
        for lift in reversed(self.lifts):
            higher = lift[out]
            out = np.where(self.below(b, out) | self.below(b, higher), out, higher)
        return np.where(self.below(b, out), out, self.parent[out])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each node the sum of ``values`` below it."""
        total = np.zeros(len(values) + 1, np.int64)
        ordered = np.zeros(len(values), np.int64)
        np.add.at(ordered, self.begin, values)
        total[1:] = np.cumsum(ordered)
        return total[self.end] - total[self.begin]


def dominators(parent: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The immediate dominator of each node, all in depth-first numbers; by semidominators with path compression."""
    n = len(parent)
    up = parent.tolist()
    order = np.argsort(dst, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(dst, minlength=n))]).tolist()
    sources = src[order].tolist()
    semi, label, above, dom = list(range(n)), list(range(n)), [-1] * n, [0] * n
    bucket: list[list[int]] = [[] for _ in range(n)]

    def best(v: int) -> int:
        if above[v] < 0:
            return v
        path = []
        while above[above[v]] >= 0:
            path.append(v)
            v = above[v]
        for x in reversed(path):
            if semi[label[above[x]]] < semi[label[x]]:
                label[x] = label[above[x]]
            above[x] = above[v] if above[v] >= 0 else above[x]
        return label[path[0]] if path else label[v]

    for w in range(n - 1, 0, -1):
        for i in range(cuts[w], cuts[w + 1]):
            s = semi[best(sources[i])]
            if s < semi[w]:
                semi[w] = s
        bucket[semi[w]].append(w)
        above[w] = up[w]
        for v in bucket[up[w]]:
            u = best(v)
            dom[v] = u if semi[u] < semi[v] else up[w]
        bucket[up[w]] = []
    for w in range(1, n):
        if dom[w] != semi[w]:
            dom[w] = dom[dom[w]]
    return np.array(dom, np.int64)


def loops(tree: Tree, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The loop around each node (its header's number), the root's own for the root, in a strongly connected graph; numbers are depth-first."""
    n = len(tree.parent)
    meets = tree.meet(src, dst)
    order = np.argsort(meets, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(meets, minlength=n))]).tolist()
    tails, heads = src[order].tolist(), dst[order].tolist()
    held, header, into = list(range(n)), [0] * n, [[] for _ in range(n)]
    marked = [-1] * n

    def rep(v: int) -> int:
        top = v
        while held[top] != top:
            top = held[top]
        while held[v] != top:
            held[v], v = top, held[v]
        return top

    for v in range(n - 1, -1, -1):
        body = []
        for i in range(cuts[v], cuts[v + 1]):
            y, x = tails[i], heads[i]
            if x != v:
                into[rep(x)].append(y)
            else:
                r = rep(y)
                if r != v and marked[r] != v:
                    marked[r] = v
                    body.append(r)
        while body:
            x = body.pop()
            held[x] = v
            header[x] = v
            for y in into[x]:
                r = rep(y)
                if r != v and marked[r] != v:
                    marked[r] = v
                    body.append(r)
            into[x] = []
    return np.array(header, np.int64)


def in_rectangles(x: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """How many points (x, y) lie in each half-open rectangle: by a wavelet matrix over y in the order of x."""
    order = np.argsort(x, kind="stable")
    xs, values = x[order], y[order]
    lo, hi = np.searchsorted(xs, x0), np.searchsorted(xs, x1)
    bits = max(1, int(max(y.max(initial=0), y1.max(initial=0))).bit_length())

    levels = []
    for bit in range(bits - 1, -1, -1):
        zero = (values >> bit) & 1 == 0
        levels.append((bit, np.concatenate([[0], np.cumsum(zero)]), int(zero.sum())))
        values = np.concatenate([values[zero], values[~zero]])

    def under(limit: np.ndarray) -> np.ndarray:
        a, b, count = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for bit, zeros, n_zeros in levels:
            one = (limit >> bit) & 1 == 1
            za, zb = zeros[a], zeros[b]
            count += np.where(one, zb - za, 0)
            a, b = np.where(one, n_zeros + a - za, za), np.where(one, n_zeros + b - zb, zb)
        return count

    return under(y1) - under(y0)


class Side:
    """The dominator tree of one direction, which of its nodes end a bridge, and what is cyclic below them without it."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, own: np.ndarray):
        order = np.lexsort([dst, src])
        cuts = np.cumsum(np.bincount(src, minlength=n))[:-1]
        targets = [t.tolist() for t in np.split(dst[order], cuts)]
        self.number, parent = preorder(n, targets, 0)
        a, b = self.number[src], self.number[dst]
        self.dom = dominators(parent, a, b)
        self.tree = Tree(self.dom)
        fine = (a == self.dom[b]) | self.tree.below(a, b)
        self.bridge = np.bincount(b[~fine], minlength=n) == 0
        self.bridge[0] = False
        direct = np.zeros(n, bool)
        direct[b[(a == self.dom[b]) & (a != b)]] = True
        self.bridge &= direct
        header = loops(Tree(parent), a, b)
        size = [1] * n
        up = header.tolist()
        for v in range(n - 1, 0, -1):
            size[up[v]] += size[v]
        size = np.array(size, np.int64)
        nodes = np.arange(n)
        self.meet = self.tree.meet(nodes, header)
        looped = np.zeros(n, bool)
        looped[self.number[own]] = True
        #: Nodes that are on no cycle while neither their outer loop nor a self-loop is.
        self.bare = (size == 1) & ~looped
        self.bare[0] = False
        acyclic = np.zeros(n, np.int64)
        acyclic[self.bare] = 1
        lifted = np.zeros(n, np.int64)
        np.add.at(lifted, self.meet[self.bare], 1)
        self.acyclic = self.tree.sums(acyclic - lifted)
        # The largest loop of each way up from a loop to where it meets its outer one: larger loops first, each tree node once.
        self.largest = np.zeros(n, np.int64)
        skip = list(range(n))
        dom, depth, meet = self.dom.tolist(), self.tree.depth.tolist(), self.meet.tolist()

        def free(v: int) -> int:
            top = v
            while skip[top] != top:
                top = skip[top]
            while skip[v] != top:
                skip[v], v = top, skip[v]
            return top

        cyclic = nodes[~self.bare & (nodes > 0)]
        for w in cyclic[np.argsort(-size[cyclic], kind="stable")].tolist():
            v = free(w)
            while depth[v] > depth[meet[w]]:
                self.largest[v] = size[w]
                skip[v] = dom[v]
                v = free(v)


def removals(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each edge of a strongly connected graph (nodes 0 to n - 1, edges distinct) without it: the largest cyclic component, and the nodes on no cycle."""
    src, dst = np.asarray(src, np.int64), np.asarray(dst, np.int64)
    loop = src == dst
    own = src[loop]
    if n == 1:
        return np.zeros(len(src), np.int64), np.ones(len(src), np.int64)
    largest, acyclic = np.full(len(src), n, np.int64), np.zeros(len(src), np.int64)
    real = np.flatnonzero(~loop)
    a, b = src[real], dst[real]
    there, back = Side(n, a, b, own), Side(n, b, a, own)
    v, u = there.number[b], back.number[a]
    forward = there.bridge[v] & (there.dom[v] == there.number[a])
    reverse = back.bridge[u] & (back.dom[u] == back.number[b])
    n_below = lambda side, x: side.tree.end[x] - side.tree.begin[x]
    outside = np.full(len(real), n, np.int64) - np.where(forward, n_below(there, v), 0) - np.where(reverse, n_below(back, u), 0)
    both = np.flatnonzero(forward & reverse)
    twice = np.zeros(len(real), np.int64)
    if len(both):
        x0, x1, y0, y1 = there.tree.begin[v[both]], there.tree.end[v[both]], back.tree.begin[u[both]], back.tree.end[u[both]]
        x, y = there.tree.begin[there.number], back.tree.begin[back.number]
        outside[both] += in_rectangles(x, y, x0, x1, y0, y1)
        bare = there.bare[there.number]
        twice[both] = in_rectangles(x[bare], y[bare], x0, x1, y0, y1) - in_rectangles(there.tree.begin[there.meet[there.number]][bare], y[bare], x0, x1, y0, y1)
    alone = (outside == 1) & ~np.isin(0, own)
    rest = np.where(alone, 0, outside)
    most = np.maximum(rest, np.maximum(np.where(forward, there.largest[v], 0), np.where(reverse, back.largest[u], 0)))
    largest[real] = np.where(forward | reverse, most, n)
    acyclic[real] = np.where(forward, there.acyclic[v], 0) + np.where(reverse, back.acyclic[u], 0) - twice + np.where((forward | reverse) & alone, 1, 0)
    return largest, acyclic
