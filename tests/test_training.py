"""Training on executors against numpy in one process."""

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import rank


def test_weights_are_those_of_one_process(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) * [3.0, 0.2, 50] + [1, 2, 300]
    y = (x[:, 0] + rng.normal(size=500) > 1).astype(int)
    rows = [(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)]
    examples = spark.createDataFrame(rows, "bm25 double, dense double, doc_len double, label int").repartition(3)
    scaler, net = rank.train(examples, seed=2, epochs=8)
    z = (x - x.mean(0)) / x.std(0)
    want = rank.Mlp(seed=2).fit(z, y.astype(float), epochs=8)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(net.p, want.p, strict=True))
    assert np.allclose([scaler[f] for f in rank.FEATURES], np.stack([x.mean(0), x.std(0)], 1))
    none = rank.train(examples.where(F.lit(False)), epochs=2)[1]
    assert all((a == b).all() for a, b in zip(none.p, rank.Mlp().p, strict=True))
