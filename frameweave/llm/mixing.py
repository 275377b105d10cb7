"""Mixing sources to target shares of all tokens.

Every document gets a hash-random key; documents are range-sorted by source and
key, token counts are summed along that order across all chunks, and each source
is cut where its budget is used up.  A budget beyond one pass over a source takes
whole further passes (epochs), never more than its cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ordered_chunks

SEED = 20_240_601


def budgets(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens to take of each source.

    Sources without tokens, without a positive share or without repeats give
    nothing; the other shares are scaled to add up to 1.  Without ``total`` the
    mix is the largest in which every source reaches its share under its cap.
    With ``total`` sources that can't fill their share give all their cap allows
    and the rest is divided among the others in proportion, as far as it goes.
    """
    cap = {s: totals.get(s, 0) * r for s, (w, r) in targets.items() if w > 0 and r > 0 and totals.get(s, 0) > 0}
    share = {s: targets[s][0] for s in cap}
    if not cap:
        return {}
    if total is None:
        whole = sum(share.values())
        total_f = min(cap[s] * whole / share[s] for s in cap)
        return {s: total_f * share[s] / whole for s in cap}
    out, left, open_ = {}, float(min(total, sum(cap.values()))), dict(share)
    while open_:
        whole = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / whole >= cap[s]]
        if not full:
            out |= {s: left * w / whole for s, w in open_.items()}
            break
        for s in full:
            out[s] = float(cap[s])
            del open_[s]
        left = total - sum(out.values()) if total < sum(cap.values()) else sum(cap[s] for s in open_)
    return out


def plan_mix(counted: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> tuple[DataFrame, dict[str, float], dict[str, int]]:
    """``doc_id, source, n_tokens, uses`` of every document in the mix, with budgets and totals by source.

    ``counted``: ``doc_id, source, n_tokens``; ``targets``: ``source,
    target_share, max_repeats`` (few rows).  A document is used ``epochs`` times,
    and once more if it lies before the cut of the last, partial epoch: the cut
    falls where the source comes nearest to its budget.  Documents without tokens
    or of no wanted source are in no mix.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"] or 0)) for r in targets.where("source is not null and target_share is not null").collect()}
    usable = counted.where(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0))
    keyed = usable.withColumn("key", F.xxhash64(F.lit(seed), F.col("doc_id")))
    chunks = ordered_chunks(keyed.select("source", "key", "doc_id", "n_tokens"), "source", "key", "doc_id")
    # One row for each source in each chunk: at most chunks + sources rows.
    parts = chunks.groupBy("source", "chunk").agg(F.sum("n_tokens").alias("n")).collect()
    totals: dict[str, int] = {}
    before: dict[tuple[str, int], int] = {}
    for r in sorted(parts, key=lambda r: (r["source"], r["chunk"])):
        before[r["source"], r["chunk"]] = totals.get(r["source"], 0)
        totals[r["source"]] = totals.get(r["source"], 0) + r["n"]
    budget = budgets(totals, wanted, total)
    plan = {}
    for s, b in budget.items():
        epochs = int(b // totals[s])
        plan[s] = (epochs, b - epochs * totals[s]) if epochs < wanted[s][1] else (wanted[s][1], 0.0)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[str, int] = {}
        for pdf in batches:
            for source, part in pdf.groupby("source", sort=False):
                if source not in plan:
                    continue
                epochs, rest = plan[source]
                n = part["n_tokens"].to_numpy()
                start = at.get(source, before[source, int(part["chunk"].iloc[0])])
                upto = start + np.cumsum(n)
                at[source] = int(upto[-1])
                uses = epochs + ((upto - n / 2) <= rest).astype("int32")
                got = part.assign(uses=uses.astype("int32"))[["doc_id", "source", "n_tokens", "uses"]]
                yield got[got["uses"] > 0]

    return chunks.mapInPandas(take, "doc_id bigint, source string, n_tokens bigint, uses int"), budget, totals


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per wanted source: documents, tokens with repeats, largest repeat, share reached and the target."""
    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.max("uses").alias("most_uses"))
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["n_docs", "n_tokens", "most_uses"])
    whole = rows.agg(F.sum("n_tokens").alias("all_tokens"))
    share = F.when(F.col("all_tokens") > 0, F.col("n_tokens") / F.col("all_tokens")).otherwise(0.0)
    # ``whole`` is one row.
    return rows.join(F.broadcast(whole), F.lit(True)).withColumn("share", share).drop("all_tokens")
