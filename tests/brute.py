"""Density clusters and similarities by comparing all pairs of full vectors."""

from __future__ import annotations

import numpy as np


def vectors(rows):
    """Rows of (path, numbers, extension, size class), standardised with one-hot categories."""
    numbers = np.array([r["numbers"] for r in rows], dtype=float)
    columns = [numbers]
    for key in ("extension", "size_class"):
        names = sorted({r[key] for r in rows})
        columns.append(np.array([[float(r[key] == name) for name in names] for r in rows]))
    x = np.hstack(columns)
    sigma = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sigma == 0, 1, sigma)


def dbscan(x, eps, min_samples):
    """Labels in row order, clusters numbered by their first core row; -1 for noise."""
    squared = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    near = squared <= eps * eps
    core = near.sum(axis=1) >= min_samples
    labels = np.full(len(x), -1)
    cluster = 0
    for start in range(len(x)):
        if labels[start] != -1 or not core[start]:
            continue
        labels[start] = cluster
        stack = [start]
        while stack:
            i = stack.pop()
            if not core[i]:
                continue
            for j in np.flatnonzero(near[i] & (labels == -1)):
                labels[j] = cluster
                stack.append(j)
        cluster += 1
    return labels


def similarities(x, labels):
    norms = np.linalg.norm(x, axis=1)
    unit = np.divide(x, norms[:, None], out=np.zeros_like(x), where=norms[:, None] > 0)
    cosine = unit @ unit.T
    out = []
    for i, label in enumerate(labels):
        others = [j for j in np.flatnonzero(labels == label) if j != i]
        out.append(None if label == -1 or not others else float(cosine[i, others].mean()))
    return out
