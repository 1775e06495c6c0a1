"""Recall of the five nearest neighbours against brute force: ``python -m tests.llm.measure_recall FOLDER [QUERIES]``.

Every item of FOLDER/results.parquet is indexed; QUERIES of them (2,000), drawn
at random, are compared with all others. Not collected by pytest.
"""

import sys

import numpy as np

from sidloom.llm.neighbors import plan, similar_items
from sidloom.llm.queries import _vectors
from sidloom.session import local_session


def main(folder: str, queries: int = 2000) -> None:
    spark = local_session(8, "12g", 32)
    spark.sparkContext.setLogLevel("ERROR")
    latest = _vectors(spark, folder).persist()
    rows = latest.toPandas()
    x = np.array(rows["vec"].tolist(), dtype=np.float64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    names = rows["cid"].to_numpy()
    got = similar_items(latest, 5).toPandas().groupby("content_id")["neighbor_id"].agg(set).to_dict()
    pick = np.random.default_rng(0).permutation(len(x))[:queries]
    hits = near_hits = near = total = 0
    for s in range(0, len(pick), 200):
        sims = x[pick[s : s + 200]] @ x.T
        for i, row in zip(pick[s : s + 200], sims):
            row[i] = -2
            best = np.argpartition(-row, 5)[:5]
            found = got.get(names[i], set())
            for j in best:
                hit = names[j] in found
                hits += hit
                total += 1
                if row[j] >= 0.7:
                    near += 1
                    near_hits += hit
    print(f"{len(x)} vectors, plan (hashes, tables, probes) {plan(len(x))}: recall {hits / total:.4f}; of neighbours with a cosine of 0.7 or more {near_hits / max(near, 1):.4f} ({near / total:.2f} of all)")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 2000)
