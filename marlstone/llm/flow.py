"""Min-cost flow from membership patterns to sources, on the driver: its size is that of the mix, not of the corpus.

Costs are convex: the first use of a text is free, whichever source takes it; each further use costs one more than the one
before. The flow is found level by level: all patterns may send their words once, then twice, and so on, and each level is a
maximum flow on top of the one before. A pattern that cannot send all that its level allows can never send more, and what it
has sent is never taken back, so levels in order make the cheapest flow. Levels that all patterns fill are passed many at a time.

Nulls do not occur. Patterns without words and sources without quota get nothing; no patterns give no flow. Ties between
patterns at one level cost the same; the order of the patterns decides, so equal input gives equal output.
"""

from __future__ import annotations

from collections import deque


class Network:
    """Integer rooms of arcs; ``push`` sends all that fits from node 0 to node 1, on top of what is sent (Dinic)."""

    def __init__(self):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[], []]

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int) -> int:
        for u, v, r in ((a, b, room), (b, a, 0)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
        return len(self.to) - 2

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def push(self) -> None:
        while True:
            level, todo = {0: 0}, deque([0])
            while todo:
                u = todo.popleft()
                for e in self.out[u]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[u] + 1
                        todo.append(self.to[e])
            if 1 not in level:
                return
            at = [0] * len(self.out)
            path: list[int] = []
            while True:
                u = self.to[path[-1]] if path else 0
                if u == 1:
                    take = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= take
                        self.room[e ^ 1] += take
                    path = path[: next(i for i, e in enumerate(path) if not self.room[e])]
                    continue
                while at[u] < len(self.out[u]):
                    e = self.out[u][at[u]]
                    if self.room[e] and level.get(self.to[e]) == level[u] + 1:
                        path.append(e)
                        break
                    at[u] += 1
                else:
                    if not path:
                        break
                    at[self.to[path.pop() ^ 1]] += 1


def route(patterns: list[tuple[int, dict[str, int]]], quotas: dict[str, int], passes: int = 2) -> list[dict[str, int]]:
    """``patterns``: words of the distinct texts, and the words that each member source has of them, once for each of its copies.

    Returns the words that each source takes of each pattern, at most ``passes`` times what it has, at the least cost.
    """
    net = Network()
    sink = {s: net.node() for s in sorted(quotas)}
    for s, node in sink.items():
        net.arc(node, 1, quotas[s])
    into, arcs, most = [], [], []
    for _, members in patterns:
        p = net.node()
        into.append(net.arc(0, p, 0))
        arcs.append({s: net.arc(p, sink[s], passes * has) for s, has in sorted(members.items())})
        most.append(passes * sum(members.values()))

    open_, step = [i for i, (unit, _) in enumerate(patterns) if unit and most[i]], 1
    while open_:
        before = net.room[:]
        for i in open_:
            net.room[into[i]] = min(step * patterns[i][0], most[i] - net.sent(into[i]))
        net.push()
        full = [i for i in open_ if not net.room[into[i]]]
        if len(full) < len(open_) and step > 1:  # too many levels at a time
            net.room, step = before, step // 2
            continue
        step = 2 * step if len(full) == len(open_) else 1
        for i in open_:
            net.room[into[i]] = 0
        open_ = [i for i in full if net.sent(into[i]) < most[i]]
    return [{s: net.sent(e) for s, e in of.items()} for of in arcs]
