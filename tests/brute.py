"""Slow, plain numpy versions the operators are tested against."""

import numpy as np


def nan_distances(x):
    n, d = x.shape
    out = np.full((n, n), np.nan)
    for i in range(n):
        shared = ~np.isnan(x[i]) & ~np.isnan(x)
        gap = np.where(shared, x[i] - x, 0.0) ** 2
        k = shared.sum(axis=1)
        ok = k > 0
        out[i, ok] = np.sqrt(gap.sum(axis=1)[ok] * d / k[ok])
    return out


def knn(x, k):
    dist = nan_distances(x)
    out = {}
    for i in range(len(x)):
        order = sorted((dist[i, j], j) for j in range(len(x)) if j != i)
        out[i] = [j for _d, j in order[:k]]
    return out


def knn_impute(x, k):
    dist, out = nan_distances(x), x.copy()
    for i, j in zip(*np.where(np.isnan(x))):
        donors = sorted((dist[i, r], r) for r in range(len(x))
                        if not np.isnan(x[r, j]) and not np.isnan(dist[i, r]))[:k]
        out[i, j] = np.mean([x[r, j] for _d, r in donors]) if donors else np.nanmean(x[:, j])
    return out


def dbscan(x, eps, min_samples):
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = dist <= eps
    core = near.sum(axis=1) >= min_samples
    label = np.full(len(x), -1)
    cluster = 0
    for i in range(len(x)):
        if not core[i] or label[i] != -1:
            continue
        todo = [i]
        while todo:
            a = todo.pop()
            if label[a] != -1:
                continue
            label[a] = cluster
            if core[a]:
                todo += [b for b in np.flatnonzero(near[a]) if label[b] == -1]
        cluster += 1
    # border rows: lowest cluster among core neighbours
    for i in np.flatnonzero(~core):
        own = [label[j] for j in np.flatnonzero(near[i]) if core[j]]
        label[i] = min(own) if own else -1
    return label, core


def silhouette(x, label):
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = np.zeros(len(x))
    for i in range(len(x)):
        same = (label == label[i])
        if same.sum() == 1:
            continue
        a = dist[i, same].sum() / (same.sum() - 1)
        b = min(dist[i, label == c].mean() for c in set(label) if c != label[i])
        out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


def ward(x, clusters):
    groups = [[i] for i in range(len(x))]
    while len(groups) > clusters:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[groups[i]], x[groups[j]]
                gap = ((a.mean(0) - b.mean(0)) ** 2).sum() * len(a) * len(b) / (len(a) + len(b))
                if best is None or gap < best[0] - 1e-12:
                    best = (gap, i, j)
        _g, i, j = best
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def partition(labels):
    out = {}
    for i, c in labels.items():
        out.setdefault(c, set()).add(i)
    return {frozenset(v) for v in out.values()}
