"""Order-dependent associations against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from abacist.operators import assign, labels, link


def test_stacks_are_those_of_loops(spark):
    rng = np.random.default_rng(0)
    rows = [(c, i, float(rng.integers(0, 12)) * 4 + float(rng.integers(0, 3)), float(rng.integers(4, 9)), float(rng.integers(0, 99))) for c in range(30) for i in range(int(rng.integers(1, 12)))]
    got = link.stacks(spark.createDataFrame(rows, "c int, bar int, at double, w double, y double"), ["c"], "bar", "at", "w", -F.col("y")).collect()
    found = {(r["c"], r["bar"]): (r["stack"], r["stack_at"], r["place"]) for r in got}
    for c in range(30):
        mine = [r for r in rows if r[0] == c]
        near, done, number = 0.3 * np.median([r[3] for r in mine]), set(), 0
        for r in mine:
            if r[1] in done:
                continue
            members = [s for s in mine if s[1] not in done and (s[1] == r[1] or abs(s[2] - r[2]) < near)]
            done |= {s[1] for s in members}
            for place, s in enumerate(sorted(members, key=lambda s: (-s[4], s[1]))):
                assert found[c, s[1]] == (number, r[2], place)
            number += 1


def test_slices_take_free_labels_in_order(spark):
    rng = np.random.default_rng(1)
    slices = [(c, i, float(x), float(y)) for c in range(20) for i, (x, y) in enumerate(rng.integers(0, 9, (5, 2)))]
    marks = [(c, i, float(x), float(y)) for c in range(20) for i, (x, y) in enumerate(rng.integers(0, 9, (3 + c % 4, 2)))]
    got = link.slice_labels(spark.createDataFrame(slices, "c int, slice int, x double, y double"), spark.createDataFrame(marks, "c int, label int, x double, y double"), ["c"])
    wanted = set()
    for c in range(20):
        used: set[int] = set()
        for _, i, x, y in (s for s in slices if s[0] == c):
            free = [((x - m[2]) ** 2 + (y - m[3]) ** 2, m[1]) for m in marks if m[0] == c and m[1] not in used]
            if free:
                used.add(min(free)[1])
                wanted.add((c, i, min(free)[1]))
    assert {tuple(r) for r in got.collect()} == wanted


def test_bands_and_dispatch(spark):
    bands = spark.createDataFrame([(1, 0, 0.0, 9.0), (1, 1, 11.0, 19.0), (1, 2, 40.0, 41.0)], "c int, idx long, low double, high double")
    lines = spark.createDataFrame([(1, 0, 5.0, 5.0), (1, 1, 15.0, 15.0), (1, 2, 25.0, 25.0)], "c int, idx long, low double, high double")
    assert {(r["gt_idx"], r["det_idx"]): round(r["iou"], 3) for r in assign.match_bands(bands, lines, "c").collect()} == {(0, 0): 0.9, (1, 1): 0.8}
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.random(4).round(3)), bool(i % 2), bool(i % 3), k, c) for i, (k, c) in enumerate((k, c) for k in ("bar", "box", "line", "scatter", "pie") for c in (0.9, 0.6) for _ in range(20))]
    table = spark.createDataFrame(rows, "i int, nx double, ny double, w double, h double, numeric boolean, vertical boolean, kind string, confidence double")
    got = {r["i"]: (r["scorer"], r["role"]) for r in labels.dispatched(table, "kind", "confidence").collect()}
    for k in ("bar", "box", "line", "scatter"):
        for r in labels.roles(table, k).collect():
            if got[r["i"]][0] == k:
                assert got[r["i"]][1] == r["role"]
    assert all(got[r[0]][0] == (r[7] if r[8] >= 0.7 and r[7] != "pie" else "bar") for r in rows)


def test_threshold_tuning_matches_anew(spark):
    from abacist.operators import evaluate

    rng = np.random.default_rng(3)
    side = lambda n: [(c, i, float(x), 0.0, float(x) + 8, 8.0) for c in range(12) for i, x in enumerate(rng.integers(0, 40, n))]
    truth, found = side(4), [(*r, float(rng.integers(1, 20)) / 20) for r in side(6)]
    steps = [round(0.1 + 0.05 * i, 2) for i in range(18)]
    fields = "c int, idx long, x1 double, y1 double, x2 double, y2 double"
    counts = assign.threshold_counts(spark.createDataFrame(truth, fields), spark.createDataFrame(found, fields + ", conf double"), "c", steps)
    got = {r["threshold"]: r for r in evaluate.best_threshold(counts).collect()}
    best = []
    for t in steps:
        tp = 0
        for c in range(12):
            free = [r for r in truth if r[0] == c]
            for r in (r for r in found if r[0] == c and r[6] >= t):
                iou = [max(min(r[4], g[4]) - max(r[2], g[2]), 0) / (16 - max(min(r[4], g[4]) - max(r[2], g[2]), 0)) for g in free]
                if iou and max(iou) > 0.5:
                    free.pop(iou.index(max(iou)))
                    tp += 1
        n = sum(r[6] >= t for r in found)
        assert (got[t]["tp"], got[t]["n_det"], got[t]["n_gt"]) == (tp, n, 48)
        best.append(round(2 * tp / (n + 48), 9))
    assert [t for t in steps if got[t]["best"]] == [steps[best.index(max(best))]]
