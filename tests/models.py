"""Small sequential models that the Spark operators are compared with."""

import math

import numpy as np


def arc(lat1, lon1, lat2, lon2, radius=6371009.0):
    a, b, c, d = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(h))


def stays(lat, lon, t, window, distance, seconds):
    """Stays of one device as lists of member indexes."""
    n = len(t)
    near = [
        {j for j in range(max(0, i - window), min(n - 1, i + window) + 1)
         if j != i and arc(lat[i], lon[i], lat[j], lon[j]) <= distance}
        for i in range(n)
    ]
    groups, seen_end = [], None
    for i in range(n - window):
        span = [t[k] for k in near[i] | {i}]
        if max(span) - min(span) < seconds:
            continue
        if seen_end is None or min(span) > seen_end:
            groups.append(set())
            seen_end = max(span)
        groups[-1] |= near[i]
        seen_end = max(seen_end, max(span))
    return [sorted(g) for g in groups]


def dbscan(points, weight, eps, min_points):
    """Cluster label (lowest core point) or None for each point."""
    lat, lon = np.radians(points[:, 0]), np.radians(points[:, 1])
    h = (np.sin((lat[:, None] - lat) / 2) ** 2
         + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2)
    close = h <= math.sin(eps / 2) ** 2
    core = (close * weight).sum(1) >= min_points
    root = [None] * len(points)
    for start in range(len(points)):
        if core[start] and root[start] is None:
            stack, root[start] = [start], start
            while stack:
                for v in np.where(close[stack.pop()])[0]:
                    if core[v] and root[v] is None:
                        root[v] = start
                        stack.append(v)
    lowest = {}
    for i, label in enumerate(root):
        if label is not None:
            p = tuple(points[i])
            lowest[label] = min(lowest.get(label, p), p)
    out = []
    for i in range(len(points)):
        labels = [lowest[root[j]] for j in ([i] if core[i] else np.where(close[i])[0]) if core[j]]
        out.append(min(labels) if labels else None)
    return out


def even_odd(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd
