import numpy as np
import pyarrow as pa

from scarp.operators import boosting as B
from scarp.operators import models as ML


def test_pairs_of_features_sum_like_single_ones(monkeypatch):
    rng = np.random.default_rng(5)
    n, n_f, bins = 500, 5, 9
    parts = (rng.integers(0, bins, (n_f, n)).astype(np.uint8), (rng.random(n) < 0.2).astype("<f8"), (rng.random(n) < 0.1).astype(np.uint8),
             rng.integers(0, 1 << 32, n).astype("<u8"), np.full((1, n), -1.0))
    batch = pa.record_batch([pa.array([p.tobytes()], pa.binary()) for p in parts], ["bins", "y", "val", "key", "margin"])
    tree = B.Tree()
    nodes = list(tree.split(0, 2, 4, 0.5, True, (0.1, -0.1)))

    def sums(cells):
        monkeypatch.setattr(B, "MOST_CELLS", cells)
        run = B._histograms({0: ([], tree.arrays(), nodes)}, {0: [0, 1, 2, 4]}, n_f, 1, bins, 0.8, 7)
        return [r for b in run(iter([batch])) for r in b.to_pylist()]

    assert B._together([0, 1, 2], 1 << 10) == [[0, 1], [2]]
    assert sums(1 << 15) == sums(0)


def test_scored_rows_are_written_once(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        x = float(rng.normal())
        rows.append((f"{'WE'[i % 2]}-{i % 20}", f"2020-0{1 + i % 6}-01", ["train", "val", "test"][i % 3], "WE"[i % 2], float(i % 20) * 100, x, x,
                     int(x + rng.normal() > 1), 0))
    df = spark.createDataFrame(rows, "transect_id string, d string, split string, bank string, chainage_m double, ret_84_m double, ret_365_m double, y int, major int")
    df = df.selectExpr("*", "CAST(d AS DATE) AS forecast_date").drop("d")
    out = ML.spatial_holdout(df, ["ret_84_m", "ret_365_m"], 2, 3, {"depth": [2], "min_rows": [5], "rate": [0.1]})
    assert out.inputFiles() and out.count() == df.where("split = 'test' AND chainage_m > 900").count()
