"""Tile pairs in rounds find what all of them at once find."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import binarycodes


def test_rounds_of_tile_pairs(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 8))
    x = np.concatenate([base + r.normal(size=base.shape) * 0.15 for _ in range(10)])
    df = spark.createDataFrame([(n, n, 1 + n % 3, v.tolist(), 8) for n, v in enumerate(x)], "vec_id long, node long, n long, vector array<double>, dim int").drop("vec_id")
    parts, compare = [], binarycodes.written_parts
    monkeypatch.setattr(binarycodes, "written_parts", lambda dfs: compare([parts.append(1) or d for d in dfs]))

    def found(**of):
        links = binarycodes.cosine_links(df, tile_rows=40, pivots=3, **of)
        counts = {tuple(x) for x in links.where("other IS NULL").groupBy("node").agg(F.sum("n")).collect()}
        return counts, links.where("n IS NULL").select(F.greatest("node", "other")).distinct().count()

    whole = found()
    assert not parts and len(whole[0]) > 100
    assert found(round_bytes=1) == whole and len(parts) > 2
