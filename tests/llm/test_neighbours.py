"""Rows that repeat an id leave room for the other neighbours."""

import numpy as np

from docketry.llm import lshforest


def test_rows_of_one_id_do_not_crowd_out_others(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    ids = np.arange(3000)
    ids[1:1500] = 1
    x[1:1500] = x[0] + rng.standard_normal((1499, 16)) * 0.01
    df = spark.createDataFrame([(int(k), [float(a) for a in v]) for k, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in lshforest.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u[0]
    best = {int(k): score[ids == k].max() for k in np.unique(ids) if k}
    assert len(got) == 5 and got[0] == 1
    assert len(set(got) & set(sorted(best, key=best.get, reverse=True)[:5])) >= 4
