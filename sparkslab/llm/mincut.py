"""Binary labelling by minimum cut.

Node i pays ``keep[i]`` if it is labelled content and ``drop[i]`` if it is
boilerplate; an edge (i, j, w) costs w if its ends differ.  The cheapest
labelling is a minimum s-t cut.  A node whose own cost outweighs all its edges
has that label in some minimum cut, so it is settled first and its edges become
costs of its neighbours; what is left open is cut by maximum flow (Dinic's:
phases of shortest paths, in each of which every edge is used up at most once).
"""

from __future__ import annotations

_EPS = 1e-9


def _settle(left: list[float], near: list[dict[int, float]]) -> list[bool | None]:
    """Labels that follow from single nodes, with their edges moved into the other ends' costs."""
    label: list[bool | None] = [None] * len(left)
    ties = [sum(x.values()) for x in near]
    todo = list(range(len(left)))
    while todo:
        i = todo.pop()
        if label[i] is not None or abs(left[i]) < ties[i] - _EPS:
            continue
        if left[i] > 0 and left[i] <= ties[i] + _EPS and ties[i] > _EPS:
            continue  # as cheap either way: the flow decides
        label[i] = left[i] > _EPS
        for j, w in near[i].items():
            if label[j] is None:
                left[j] += w if label[i] else -w
                ties[j] -= w
                del near[j][i]
                todo.append(j)
        near[i] = {}
    return label


def labels(keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where content; of equally cheap labellings the one with the least content, near enough."""
    n = len(keep)
    left = [d - k for d, k in zip(drop, keep, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label = _settle(left, near)
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        for i, x in zip(open_, _flow([left[i] for i in open_], [near[i] for i in open_], {i: k for k, i in enumerate(open_)}), strict=True):
            label[i] = x
    return [bool(x) for x in label]


def _flow(left: list[float], near: list[dict[int, float]], place: dict[int, int]) -> list[bool]:
    """Nodes on the source's side of a minimum cut; ``left`` is what can come from the source, or go to the sink."""
    n = len(left)
    to: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    room: list[float] = []
    for i in range(n):
        for far, w in near[i].items():
            j = place[far]
            if i < j:
                to[i].append(len(head))
                to[j].append(len(head) + 1)
                head += (j, i)
                room += (w, w)
    while True:
        level = [-1] * n
        front = [i for i in range(n) if left[i] > _EPS]
        for i in front:
            level[i] = 0
        found = False
        depth = 0
        while front and not found:
            depth += 1
            ahead = []
            for i in front:
                for e in to[i]:
                    j = head[e]
                    if room[e] > _EPS and level[j] < 0:
                        level[j] = depth
                        found |= left[j] < -_EPS
                        ahead.append(j)
            front = ahead
        if not found:
            return [x >= 0 for x in level]
        following = [0] * n
        for source in [i for i in range(n) if level[i] == 0]:
            path: list[int] = []
            i = source
            while left[source] > _EPS:
                if left[i] < -_EPS:
                    flow = min([left[source], -left[i], *(room[e] for e in path)])
                    left[source] -= flow
                    left[i] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    # back to the first edge that is used up
                    k = next((k for k, e in enumerate(path) if room[e] <= _EPS), len(path))
                    i = head[path[k] ^ 1] if k < len(path) else i
                    del path[k:]
                    continue
                arcs = to[i]
                while following[i] < len(arcs):
                    e = arcs[following[i]]
                    if room[e] > _EPS and level[head[e]] == level[i] + 1:
                        break
                    following[i] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    i = head[e ^ 1]
                    following[i] += 1
                    continue
                path.append(e)
                i = head[e]
