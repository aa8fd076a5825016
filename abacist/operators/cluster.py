"""Clustering in one dimension as window functions; small multi-dimensional groups in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abacist.operators.assign import buckets_for


def gap_sessions(rows: DataFrame, key: list[str], order: list[str], position: Column, gap: float) -> DataFrame:
    """``session`` number per key: a new one where the position is more than ``gap`` from the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    opens = F.coalesce((position - F.lag(position).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def tick_merge(rows: DataFrame, key: list[str], coordinate: str, value: str, tie: str, gap: float = 5.0) -> DataFrame:
    """Labels closer than ``gap`` as one: mean coordinate, median value."""
    sessions = gap_sessions(rows, key, [coordinate, tie], F.col(coordinate), gap)
    return sessions.groupBy(*key, "session").agg(F.avg(coordinate).alias("coordinate"), F.median(value).alias("value"), F.count(F.lit(1)).alias("n"))


def two_means(rows: DataFrame, key: list[str], x: str, tie: str) -> DataFrame:
    """Exact one-dimensional 2-means: the split of the sorted values with the least squared error, by prefix sums."""
    w = Window.partitionBy(*key).orderBy(x, tie)
    up, all_of = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    centered = rows.where(F.col(x).isNotNull()).withColumn("_c", F.col(x).cast("double") - F.avg(x).over(all_of))
    sums = centered.select(
        *key, F.col(x).alias("_x"), F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(all_of).alias("n"),
        F.sum("_c").over(up).alias("s"), F.sum("_c").over(all_of).alias("st"), F.avg(x).over(all_of).alias("mean"),
    )
    between = F.col("s") * F.col("s") / F.col("k") + (F.col("st") - F.col("s")) * (F.col("st") - F.col("s")) / (F.col("n") - F.col("k"))
    splits = sums.where("k < n").withColumn("gain", F.round(between, 6))
    best = splits.groupBy(*key).agg(F.max_by(F.struct("k", "n", "s", "st", "mean"), F.struct("gain", -F.col("k"))).alias("b"))
    low = F.col("b.mean") + F.col("b.s") / F.col("b.k")
    high = F.col("b.mean") + (F.col("b.st") - F.col("b.s")) / (F.col("b.n") - F.col("b.k"))
    return best.select(*key, F.col("b.k").alias("n_low"), (F.col("b.n") - F.col("b.k")).alias("n_high"), low.alias("low_center"),
                       high.alias("high_center"), ((low + high) / 2).alias("threshold"))


def dbscan(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels of density clusters, -1 for noise."""
    near = [np.flatnonzero(((points - p) ** 2).sum(axis=1) <= eps * eps) for p in points]
    labels, cluster = np.full(len(points), -1), -1
    for i in range(len(points)):
        if labels[i] != -1 or len(near[i]) < least:
            continue
        cluster += 1
        front = [i]
        labels[i] = cluster
        while front:
            for j in near[front.pop()]:
                if labels[j] == -1:
                    labels[j] = cluster
                    if len(near[j]) >= least:
                        front.append(j)
    return labels


def dbscan_2d(rows: DataFrame, key: str, order: str, x: str, y: str, eps: float, least: int) -> DataFrame:
    """``key, order, cluster`` per point; a key's points are those of one chart."""

    def per_chart(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pdf["cluster"] = dbscan(pdf[[x, y]].to_numpy(float), eps, least)
        return pdf[[key, order, "cluster"]]

    kinds = dict(rows.dtypes)
    return rows.select(key, order, x, y).groupBy(key).applyInPandas(per_chart, f"{key} {kinds[key]}, {order} {kinds[order]}, cluster long")


def gmm_bic(values: np.ndarray, steps: int = 100) -> tuple[int, float, float]:
    """Whether one or two Gaussians fit (two if its BIC is lower by over 3); their means."""
    n, v = len(values), np.sort(values.astype(float))
    spread = max(v.std(), 1e-6)
    one = -2 * (-0.5 * n * np.log(2 * np.pi * spread**2) - ((v - v.mean()) ** 2).sum() / (2 * spread**2)) + 2 * np.log(n)
    if n < 4:
        return 1, float(v.mean()), float(v.mean())
    mean, sd, share = np.percentile(v, [25, 75]), np.array([spread, spread]), np.array([0.5, 0.5])
    for _ in range(steps):
        density = share * np.exp(-0.5 * ((v[:, None] - mean) / sd) ** 2) / (sd * np.sqrt(2 * np.pi)) + 1e-300
        own = density / density.sum(axis=1, keepdims=True)
        held = own.sum(axis=0) + 1e-12
        mean = (own * v[:, None]).sum(axis=0) / held
        sd = np.maximum(np.sqrt((own * (v[:, None] - mean) ** 2).sum(axis=0) / held), 1e-3 * spread)
        share = held / n
    two = -2 * np.log(density.sum(axis=1)).sum() + 5 * np.log(n)
    return (2, *map(float, sorted(mean))) if two + 3 < one else (1, float(v.mean()), float(v.mean()))


def gmm_1d(rows: DataFrame, key: str, value: str) -> DataFrame:
    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        k, low, high = gmm_bic(pdf[value].to_numpy())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "components": [k], "low_mean": [low], "high_mean": [high]})

    kind = dict(rows.dtypes)[key]
    return rows.where(F.col(value).isNotNull()).select(key, value).groupBy(key).applyInPandas(per_group, f"{key} {kind}, components int, low_mean double, high_mean double")


def kmeans_choice(points: np.ndarray, most: int = 6, seed: int = 42) -> tuple[int, np.ndarray]:
    """Number of clusters by 0.7 silhouette + 0.3 log(Calinski-Harabasz + 1), and the labels."""
    n, best = len(points), (-np.inf, 1, np.zeros(len(points), dtype=int))
    pair = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for k in range(2, min(most, n - 1) + 1):
        rng = np.random.default_rng(seed)
        centers = points[rng.choice(n, 1)]
        while len(centers) < k:  # far points first
            centers = np.vstack([centers, points[np.argmax(((points[:, None] - centers) ** 2).sum(axis=2).min(axis=1))]])
        for _ in range(50):
            labels = np.argmin(((points[:, None] - centers) ** 2).sum(axis=2), axis=1)
            after = np.array([points[labels == c].mean(axis=0) if (labels == c).any() else centers[c] for c in range(k)])
            if np.allclose(after, centers):
                break
            centers = after
        inside, nearest = np.zeros(n), np.full(n, np.inf)
        for c in range(k):
            mine = labels == c
            if not mine.any():
                continue
            mean = pair[:, mine].sum(axis=1)
            inside[mine] = mean[mine] / max(mine.sum() - 1, 1)
            nearest[~mine] = np.minimum(nearest[~mine], mean[~mine] / mine.sum())
        silhouette = np.nan_to_num((nearest - inside) / np.maximum(nearest, inside)).mean()
        within = sum(((points[labels == c] - centers[c]) ** 2).sum() for c in range(k))
        between = sum((labels == c).sum() * ((centers[c] - points.mean(axis=0)) ** 2).sum() for c in range(k))
        score = 0.7 * silhouette + 0.3 * np.log(between / (k - 1) / max(within / max(n - k, 1), 1e-12) + 1)
        if score > best[0]:
            best = (score, k, labels)
    return best[1], best[2]


def chosen_clusters(rows: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """``k`` and ``cluster`` of each point of a chart, by ``kmeans_choice`` over its points in ``order``. Charts are dealt to buckets; charts hold few points."""
    dealt = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    buckets = buckets_for(rows)

    def per_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chart, part in pdf.sort_values([key, order], kind="stable").groupby(key, sort=False):
            k, labels = kmeans_choice(part[["x", "y"]].to_numpy())
            out += [(chart, o, k, int(c)) for o, c in zip(part[order], labels)]
        return pd.DataFrame(out, columns=[key, order, "k", "cluster"])

    kinds = dict(rows.dtypes)
    fields = f"{key} {kinds[key]}, {order} {kinds[order]}, k int, cluster int"
    return dealt.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("_b").applyInPandas(lambda pdf: per_bucket(pdf.drop(columns="_b")), fields)


def point_features(points: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """``n, mean_distance, std_distance, density_variance, outlier_ratio, aspect_ratio`` of a chart's points, over all its pairs; charts under two points go.

    Density: of the five nearest others. Outliers: points without another within twice the mean distance, that distance included up to the last bits of
    the mean's sum (three equal points and a fourth: its distance is exactly twice the mean). A chart's points are gathered.
    """
    gathered = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    p, n = F.col("p"), F.size("p")
    away = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    rows = gathered.where(n >= 2).withColumn("rows", F.transform(p, lambda a: F.array_sort(F.transform(p, lambda b: away(a, b)))))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    vary = lambda c, m: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(c))
    # a row's first distance is the point's own; every pair is in two rows
    rows = rows.withColumn("d", F.flatten(F.transform("rows", lambda r: F.slice(r, 2, n - 1)))).withColumn("mean_distance", mean(F.col("d")))
    density = F.transform("rows", lambda r: 1 / (mean(F.slice(r, 2, F.least(n - 1, F.lit(5)))) + 1e-6))
    rows = rows.withColumn("density", density).withColumn("_m", mean(F.col("density")))
    alone = F.size(F.filter("rows", lambda r: F.get(r, F.lit(1)) > 2 * (1 + 1e-12) * F.col("mean_distance")))
    span = lambda axis: F.array_max(F.transform(p, lambda a: a[axis])) - F.array_min(F.transform(p, lambda a: a[axis]))
    return rows.select(
        *key, n.alias("n"), "mean_distance", vary(F.col("d"), F.col("mean_distance")).alias("std_distance"), (vary(F.col("density"), F.col("_m")) / (F.col("_m") + 1e-6)).alias("density_variance"),
        (alone / n).alias("outlier_ratio"), (span("x") / (span("y") + 1e-6)).alias("aspect_ratio"),
    )


def recommendation(features: DataFrame, kind: str, extent: Column) -> DataFrame:
    """``algorithm, eps, min_size, confidence``: the clustering to use per chart, from ``n, mean_distance, density_variance``, its type, and the image's
    ``extent`` along the category axis.
    """
    k, mean = F.col(kind), F.col("mean_distance")
    choice = lambda name, sure, eps=None, least=None: F.struct(
        F.lit(name).alias("algorithm"), (eps if eps is not None else F.lit(None)).cast("double").alias("eps"), (least if least is not None else F.lit(None)).cast("int").alias("min_size"), F.lit(sure).alias("confidence")
    )
    rule = (
        F.when(k == "box", choice("intersection_alignment", 0.95))
        .when(F.col("density_variance") > 0.5, choice("hdbscan", 0.85, least=F.when(k == "scatter", 3).otherwise(2)))
        .when(k.isin("scatter", "line"), choice("hdbscan", 0.80, least=F.lit(3)))
        .when(k.isin("bar", "histogram"), choice("dbscan", 0.90, 0.04 * extent, F.lit(2)))
        .when(F.col("n") < 10, choice("kmeans", 0.75))
        .otherwise(choice("dbscan", 0.70, 0.5 * mean, F.lit(2)))
    )
    return features.withColumn("_r", rule).select("*", "_r.*").drop("_r")
