"""SMOTE (M8): exact output size, synthetic rows inside the minority's
bounding box, and the neighbours equal to brute force on a small fixture."""

import numpy as np
from pyspark.sql import functions as F

from fairlane.catalog.q_models import model_table
from fairlane.operators import balance

from conftest import SMALL

FEATS = ["loan_amount", "interest_rate", "loan_to_value_ratio"]


def test_smote_size_box_and_recall(spark):
    t = model_table(spark, SMALL).select("application_id", "label", *FEATS).cache()
    counts = {r["label"]: r["count"] for r in t.groupBy("label").count().collect()}
    minority = min(counts, key=counts.get)
    syn = balance.smote(t, FEATS, "label", minority=minority, k=5)
    assert syn.count() == max(counts.values()) - counts[minority]
    box = t.where(F.col("label") == minority).agg(*[F.min(c).alias(f"lo_{c}") for c in FEATS],
                                                  *[F.max(c).alias(f"hi_{c}") for c in FEATS]).first()
    outside = syn.where(" OR ".join(f"{c} < {box['lo_' + c]} - 1e-9 OR {c} > {box['hi_' + c]} + 1e-9" for c in FEATS))
    assert outside.count() == 0
    # Recall of the neighbours against exact 5-NN (standardised space).
    mino = t.where(F.col("label") == minority).select("application_id", *FEATS).toPandas()
    x = mino[FEATS].to_numpy(float)
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    d = ((z[:, None, :] - z[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    ids = mino["application_id"].to_numpy()
    exact = {ids[i]: set(ids[np.argsort(d[i], kind="stable")[:5]]) for i in range(len(ids))}
    got = {}
    for r in balance.neighbours(t.where(F.col("label") == minority).select("application_id", *FEATS), FEATS,
                                "application_id", k=5).collect():
        got.setdefault(r["application_id"], set()).add(r["nb"])
    recall = sum(len(got.get(i, set()) & exact[i]) for i in exact) / (5 * len(exact))
    print("neighbour recall", recall)
    assert recall == 1.0
