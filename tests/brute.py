"""Small brute-force references used by the tests (plain Python/numpy)."""

import numpy as np


def greedy_linkage(X, strategy):
    """One merge per step, closest pair under (d, rep_a, rep_b), clusters named
    by their smallest leaf while running; single linkage breaks ties by the
    smallest pair of leaves at that distance instead
    -> [(cluster, p1, p2, height, size)]."""
    X = np.asarray(X, dtype=float)
    n = len(X)
    members = {i + 1: [i + 1] for i in range(n)}
    cid = {i + 1: i + 1 for i in range(n)}
    height = {i + 1: 0.0 for i in range(n)}
    D, leaves = {}, {}
    for i in range(1, n + 1):
        for j in range(i + 1, n + 1):
            D[(i, j)] = float(np.sqrt(((X[i - 1] - X[j - 1]) ** 2).sum()))
            leaves[(i, j)] = (i, j)
    out = []
    for step in range(n - 1):
        tie = leaves if strategy == "min" else {k: k for k in D}
        (a, b), d = min(D.items(), key=lambda kv: (kv[1], tie[kv[0]]))
        new = n + 1 + step
        ca, cb = cid[a], cid[b]
        if ca <= n and cb <= n:
            p1, p2 = min(ca, cb), max(ca, cb)
        else:
            p1, p2 = max(ca, cb), min(ca, cb)
        h = max(d, height[a], height[b])
        sa, sb = len(members[a]), len(members[b])
        out.append((new, p1, p2, h, sa + sb))
        others = [k for k in members if k not in (a, b)]
        for o in others:
            ao, bo = (min(a, o), max(a, o)), (min(b, o), max(b, o))
            dao, dbo = D.pop(ao), D.pop(bo)
            leaves[ao] = min((dao, leaves[ao]), (dbo, leaves[bo]))[1]
            if strategy == "min":
                v = min(dao, dbo)
            elif strategy == "max":
                v = max(dao, dbo)
            elif strategy == "avg":
                v = (sa * dao + sb * dbo) / (sa + sb)
            else:
                v = (dao + dbo) / 2
            D[(min(a, o), max(a, o))] = v
        D.pop((a, b))
        members[a] = members[a] + members.pop(b)
        cid[a] = new
        height[a] = h
        del cid[b], height[b]
    return out
