"""Optimal and greedy one-to-one matching inside a chart, in numpy per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, min(rows, columns) of them: shortest augmenting paths with potentials."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j] = True
            free = np.flatnonzero(~used)
            reduced = c[match[j] - 1, free - 1] - u[match[j]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j
            nearest = free[np.argmin(least[free])]
            step = least[nearest]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = int(nearest)
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = int(way[j])
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    side = lambda i, j: np.maximum(np.minimum(a[:, None, j], b[None, :, j]) - np.maximum(a[:, None, i], b[None, :, i]), 0)
    shared = side(0, 2) * side(1, 3)
    size = lambda x: np.maximum(x[:, 2] - x[:, 0], 0) * np.maximum(x[:, 3] - x[:, 1], 0)
    union = size(a)[:, None] + size(b)[None] - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)


def greedy(iou: np.ndarray, least: float) -> list[tuple[int, int]]:
    """In row order, each row's best column that is still free."""
    free, out = np.ones(iou.shape[1], dtype=bool), []
    for i, row in enumerate(iou):
        open_row = np.where(free, row, -1.0)
        if len(row) and open_row.max() > least:
            j = int(open_row.argmax())
            free[j] = False
            out.append((i, j))
    return out


def nms(boxes: np.ndarray, scores: np.ndarray, limit: float) -> list[int]:
    """Boxes kept, best first, dropping those that overlap a kept one by more than ``limit``."""
    order, kept = np.lexsort((np.arange(len(scores)), -scores)), []
    overlaps = iou_matrix(boxes, boxes)
    for i in order:
        if all(overlaps[i, k] <= limit for k in kept):
            kept.append(int(i))
    return kept


BOX = ["x1", "y1", "x2", "y2"]


#: Rows that a bucket of charts holds, about.
BUCKET_ROWS = 50_000


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Charts dealt to buckets, some per partition and more for more rows: a call per bucket costs far less than one per chart, and holds a bounded number of rows."""
    n = buckets_for(rows)
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)))


def buckets_for(*sides: DataFrame) -> int:
    counted = max(rows.count() for rows in sides)
    return max(8 * int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted // BUCKET_ROWS))


def _charts(pdf: pd.DataFrame, key: str, columns: list[str]) -> dict:
    """Chart to (idx, numbers) of its rows, by ascending idx."""
    if not len(pdf):  # an empty side of a group may come without columns
        return {}
    pdf = pdf.sort_values([key, "idx"], kind="stable")
    keys, idx, numbers = pdf[key].to_numpy(), pdf["idx"].to_numpy(), pdf[columns].to_numpy(float)
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    return {keys[a]: (idx[a:b], numbers[a:b]) for a, b in zip(edges, [*edges[1:], len(keys)])}


def _matched(truth: DataFrame, found: DataFrame, key: str, columns: list[str], measure: str, pairs) -> DataFrame:
    names = [key, "gt_idx", "det_idx", measure]

    def per_bucket(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = _charts(a, key, columns), _charts(b, key, columns)
        rows = []
        for chart in left.keys() & right.keys():
            (gi, g), (di, d) = left[chart], right[chart]
            rows += [(chart, gi[i], di[j], float(m)) for i, j, m in pairs(g, d)]
        return pd.DataFrame(rows, columns=names)

    kind = dict(truth.dtypes)[key]
    n = buckets_for(truth, found)  # both sides alike
    bucket = F.pmod(F.xxhash64(key), F.lit(n)).alias("_bucket")
    # new names for columns that both sides may have from one table
    sides = [x.where(F.col(key).isNotNull()).select(*[F.col(c).alias(c) for c in (key, "idx", *columns)], bucket).groupBy("_bucket") for x in (truth, found)]
    return sides[0].cogroup(sides[1]).applyInPandas(per_bucket, f"{key} {kind}, gt_idx long, det_idx long, {measure} double")


def match_boxes(truth: DataFrame, found: DataFrame, key: str, least: float = 0.5, optimal: bool = True) -> DataFrame:
    """Per chart the matched pairs (``gt_idx, det_idx, iou``) with an IoU above ``least``. Both sides: key, ``idx``, box."""

    def pairs(g: np.ndarray, d: np.ndarray) -> list[tuple[int, int, float]]:
        iou = iou_matrix(g, d)
        chosen = hungarian(1 - iou) if optimal else [(j, i) for i, j in greedy(iou.T, least)]
        return [(i, j, iou[i, j]) for i, j in chosen if iou[i, j] > least]

    return _matched(truth, found, key, BOX, "iou", pairs)


def threshold_counts(truth: DataFrame, found: DataFrame, key: str, thresholds: list[float], least: float = 0.5) -> DataFrame:
    """``key, threshold, tp, n_det, n_gt``: each chart's detections (key, ``idx``, box, ``conf``) from a threshold on, matched anew in their order to the best free truth."""
    n = buckets_for(truth, found)
    bucket = F.pmod(F.xxhash64(key), F.lit(n)).alias("_bucket")
    # new names for columns that both sides may have from one table
    sides = [x.where(F.col(key).isNotNull()).select(*[F.col(n).alias(n) for n in (key, "idx", *c)], bucket).groupBy("_bucket") for x, c in ((truth, BOX), (found, [*BOX, "conf"]))]

    def per_bucket(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = _charts(a, key, BOX), _charts(b, key, [*BOX, "conf"])
        out = []
        for chart in dict.fromkeys([*left, *right]):
            g = left[chart][1] if chart in left else np.zeros((0, 4))
            d = right[chart][1] if chart in right else np.zeros((0, 5))
            iou = iou_matrix(d[:, :4], g) if len(d) and len(g) else np.zeros((len(d), len(g)))
            for t in thresholds:
                kept = d[:, 4] >= t
                out.append((chart, t, len(greedy(iou[kept], least)) if len(g) else 0, int(kept.sum()), len(g)))
        return pd.DataFrame(out, columns=[key, "threshold", "tp", "n_det", "n_gt"])

    kind = dict(truth.dtypes)[key]
    return sides[0].cogroup(sides[1]).applyInPandas(per_bucket, f"{key} {kind}, threshold double, tp long, n_det long, n_gt long")


def match_bands(labels: DataFrame, lines: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """Per chart the labels (``gt_idx``) and grid lines (``det_idx``) of most shared extent, above ``least``. Labels: ``low, high``; lines: both their centre.

    A line's band is the mean spacing of the chart's lines wide, 50 pixels with one line.
    """

    def pairs(g: np.ndarray, d: np.ndarray) -> list[tuple[int, int, float]]:
        centers = d[:, 0]
        half = (np.diff(centers).mean() if len(centers) > 1 else 50.0) / 2
        shared = np.maximum(np.minimum(g[:, None, 1], centers[None] + half) - np.maximum(g[:, None, 0], centers[None] - half), 0)
        iou = shared / np.maximum((g[:, 1] - g[:, 0])[:, None] + 2 * half - shared, 1e-6)
        return [(i, j, iou[i, j]) for i, j in hungarian(-iou) if iou[i, j] > least]

    return _matched(labels, lines, key, ["low", "high"], "iou", pairs)


def match_points(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Per chart the pairs of points of least total distance. Both sides: key, ``idx, x, y``."""

    def pairs(g: np.ndarray, d: np.ndarray) -> list[tuple[int, int, float]]:
        cost = np.sqrt(((g[:, None] - d[None]) ** 2).sum(axis=2))
        return [(i, j, cost[i, j]) for i, j in hungarian(cost)]

    return _matched(truth, found, key, ["x", "y"], "distance", pairs)


def suppressed(rows: DataFrame, key: str, limit: float = 0.45) -> DataFrame:
    """Rows (key, ``idx``, box, ``conf``) left by non-maximum suppression per chart."""
    columns = [*BOX, "conf"]

    def per_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chart, (idx, numbers) in _charts(pdf, key, columns).items():
            out += [(chart, idx[i], *numbers[i]) for i in sorted(nms(numbers[:, :4], numbers[:, 4], limit))]
        return pd.DataFrame(out, columns=[key, "idx", *columns])

    kind = dict(rows.dtypes)[key]
    fields = ", ".join(f"{c} double" for c in columns)
    return _dealt(rows.select(key, "idx", *columns).where(F.col(key).isNotNull()), key).groupBy("_bucket").applyInPandas(per_bucket, f"{key} {kind}, idx long, {fields}")
