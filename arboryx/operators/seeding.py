"""Seeds of a query: diversity by maximal marginal relevance, weight classes and their seats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mmr_order(relevance: np.ndarray, unit: np.ndarray, lam: float = 0.6) -> list[int]:
    """Order of candidates: the most relevant, then the best of lam * relevance - (1 - lam) * closest similarity."""
    left, order = list(range(len(relevance))), []
    closest = np.zeros(len(relevance))
    while left:
        score = [lam * relevance[i] - (1 - lam) * closest[i] if order else relevance[i] for i in left]
        pick = left.pop(int(np.argmax(score)))
        order.append(pick)
        similar = unit @ unit[pick]
        closest = similar if len(order) == 1 else np.maximum(closest, similar)
    return order


def weight_classes(nodes: DataFrame, value: str = "potential") -> DataFrame:
    """Adds ``weight_class`` 0 to 3 by the exact 25th, 75th and 95th percentile of all values, right-closed."""
    cuts = nodes.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75), F.lit(0.95))).alias("_p"))
    ladder = F.when(F.col(value) <= F.col("_p")[0], 0).when(F.col(value) <= F.col("_p")[1], 1).when(F.col(value) <= F.col("_p")[2], 2).otherwise(3)
    return nodes.crossJoin(F.broadcast(cuts)).withColumn("weight_class", ladder).drop("_p")  # one row


def seats(order: list[int], classes: list[int], k: int, hub: int = 3, hub_share: float = 0.5, per_class: int = 1) -> list[int]:
    """Members of a committee of k: the best, then ``per_class`` of each class present but the hubs', then in
    order with at most max(1, round(share * k)) hubs; the cap is lifted if seats stay empty."""
    most_hubs, taken = max(1, round(hub_share * k)), []

    def hubs() -> int:
        return sum(classes[i] == hub for i in taken)

    if order and k:
        taken.append(order[0])
    for c in sorted(set(classes) - {hub}):
        for i in order:
            if len(taken) >= k or sum(classes[j] == c for j in taken) >= per_class:
                break
            if classes[i] == c and i not in taken:
                taken.append(i)
    for capped in (True, False):
        for i in order:
            if len(taken) < k and i not in taken and not (capped and classes[i] == hub and hubs() >= most_hubs):
                taken.append(i)
    return [i for i in order if i in taken]


def diversified(candidates: DataFrame, k: int = 8, lam: float = 0.6, most: int = 64) -> DataFrame:
    """(query_id, id, seat, weight) from (query_id, id, cosine, v, weight_class).

    The choice is sequential, so a query's candidates meet in one task; only the ``most`` most similar
    of each query get there. A seed's weight is its cosine, at least 0.001.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    few = candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r").reset_index(drop=True)
        ranked = mmr_order(pdf["cosine"].to_numpy(), np.stack(pdf["v"].to_numpy()), lam)
        chosen = seats(ranked, pdf["weight_class"].tolist(), k)
        out = pdf.loc[chosen, ["query_id", "id"]]
        return out.assign(seat=range(1, len(chosen) + 1), weight=np.maximum(pdf.loc[chosen, "cosine"], 1e-3))

    kinds = dict(candidates.dtypes)
    return few.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, id {kinds['id']}, seat int, weight double")
