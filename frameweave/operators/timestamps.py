"""Mixed timestamp formats to one UTC instant each.

Every value becomes the array of its valid interpretations.  The record order of its
source decides by Viterbi: the path through the interpretations of all records with
the least cost, a format switch and a backward jump in time each costing a penalty.
Every result is a step of that path.  A record with one interpretation splits the
path exactly, so only runs of ambiguous records and the records beside them are
searched; of the others the path has the only step there is.  Sources are cut into range-sorted
chunks whatever their size; a chunk is summed up by the cost from each of its first
to each of its last interpretations, these small matrices are combined per source
(one row per chunk), and the chunks then fill in their path between fixed ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.captime import interpretations
from ..session import cut, partitions

_INTERP = "array<struct<utc_us: bigint, format: string>>"
SWITCH, BACKWARD = 1.0, 2.0  # penalties of a format switch and of a jump back in time


def with_interpretations(df: DataFrame, value: str, zone: str, slash_orders: tuple[str, ...] = ("mdy",)) -> DataFrame:
    """``df`` with the array column ``interpretations`` (empty for unusable values, never null)."""

    @F.pandas_udf(_INTERP)
    def read(v: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([[{"utc_us": u, "format": f} for u, f in interpretations(a, b, slash_orders)] for a, b in zip(v.tolist(), z.tolist())], dtype=object)

    # Else a filter on the result would be pushed below and read every value twice.
    return df.withColumn("interpretations", read.asNondeterministic()(F.col(value), F.col(zone)))


def _step(a: tuple[int, str], b: tuple[int, str]) -> float:
    return (SWITCH if a[1] != b[1] else 0.0) + (BACKWARD if b[0] < a[0] else 0.0)


def viterbi(run: list[list[tuple[int, str]]], first: int | None = None, last: int | None = None) -> tuple[float, list[int]]:
    """Least cost and its path through a run of interpretation lists, with fixed ends where given.

    Equal costs go to the earlier interpretation, so the path is unique.
    """
    cost = [0.0 if first is None or first == i else float("inf") for i in range(len(run[0]))]
    back: list[list[int]] = []
    for prev, here in zip(run, run[1:]):
        best = [min((cost[i] + _step(p, h), i) for i, p in enumerate(prev)) for h in here]
        back.append([i for _, i in best])
        cost = [c for c, _ in best]
    at = last if last is not None else min(range(len(cost)), key=lambda i: (cost[i], i))
    total, path = cost[at], [at]
    for links in reversed(back):
        path.append(links[path[-1]])
    return total, path[::-1]


def _counts(us: pd.Series) -> np.ndarray:
    return np.fromiter(map(len, us), dtype=np.int64, count=len(us))


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bool, list[tuple], list[list[tuple[int, str]]]] | None]:
    """The stretches of one source each, as they lie in a sorted chunk: source, whether first, keys, interpretations; None after each batch.

    Only ambiguous records and their anchors are kept: the middle of a stretch of
    anchors cannot change a choice.
    """
    source, first, keys, runs = None, True, [], []
    for pdf in batches:
        unclear = _counts(pdf["us"]) > 1
        names = pdf["source"].to_numpy(object)
        edge = np.ones(len(pdf), dtype=bool)
        edge[1:-1] = (names[1:-1] != names[:-2]) | (names[1:-1] != names[2:])
        near = unclear | edge
        near[1:] |= unclear[:-1]
        near[:-1] |= unclear[1:]
        for s, k, i, us, fm in pdf.loc[near, ["source", "kind", "record_id", "us", "formats"]].itertuples(index=False, name=None):
            if s != source:
                if runs:
                    yield source, first, keys, runs
                    first = False
                source, keys, runs = s, [], []
            one = len(us) == 1
            if one and len(runs) > 2 and len(runs[-1]) == 1 and len(runs[-2]) == 1:
                keys[-1], runs[-1] = (k, i), [(int(us[0]), fm[0])]  # an anchor between anchors is passed over
                continue
            keys.append((k, i))
            runs.append([(int(u), f) for u, f in zip(us, fm)])
        yield None
    if runs:
        yield source, first, keys, runs


_ENDS = "source string, chunk int, n_first int, n_last int, firsts string, lasts string, costs string"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    chunk: list[int] = []

    def watched():
        for pdf in batches:
            if len(pdf):
                chunk[:] = [int(pdf["chunk"].iloc[0])]
            yield pdf

    rows, part = [], None
    parts = _parts(watched())
    ends: list[tuple] = []
    for part in parts:
        if part is None:
            continue
        if not ends or len(ends) == 1:
            ends.append(part)
        else:
            ends[1] = part
    for source, _, _, runs in ends:
        costs = [[viterbi(runs, a, b)[0] for b in range(len(runs[-1]))] for a in range(len(runs[0]))]
        rows.append((source, chunk[0], len(runs[0]), len(runs[-1]), json.dumps(runs[0]), json.dumps(runs[-1]), json.dumps(costs)))
    yield pd.DataFrame(rows, columns=["source", "chunk", "n_first", "n_last", "firsts", "lasts", "costs"])


def _fix_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per source, one row a chunk: the first and last interpretation each chunk must take."""
    import json

    pdf = pdf.sort_values("chunk")
    run: list[list[tuple[int, str]]] = []
    inner: list[list[list[float]]] = []
    for f, la, c in zip(pdf["firsts"], pdf["lasts"], pdf["costs"]):
        run += [[tuple(x) for x in json.loads(f)], [tuple(x) for x in json.loads(la)]]
        inner.append(json.loads(c))
    cost, back = [0.0] * len(run[0]), []
    for k in range(1, len(run)):
        best = []
        for j, h in enumerate(run[k]):
            steps = [(cost[i] + (inner[k // 2][i][j] if k % 2 else _step(p, h)), i) for i, p in enumerate(run[k - 1])]
            best.append(min(steps))
        back.append([i for _, i in best])
        cost = [c for c, _ in best]
    path = [min(range(len(cost)), key=lambda i: (cost[i], i))]
    for links in reversed(back):
        path.append(links[path[-1]])
    path = path[::-1]
    return pd.DataFrame({"source": pdf["source"], "chunk": pdf["chunk"], "first_at": path[0::2], "last_at": path[1::2]})


def choose_by_order(records: DataFrame, *, read: Callable[[DataFrame], DataFrame] | None = None, chunks: int | None = None) -> DataFrame:
    """One instant for each record with interpretations.

    ``records``: ``kind, record_id, source, seq`` (one row per ``kind,
    record_id``) and ``interpretations``, or what ``read`` makes them from; it
    then runs once, behind the range partitioning, whose sampling would otherwise
    repeat it.  Result: ``kind, record_id, utc_us, format, n_valid``;
    ``n_valid`` 1 means the path has no other way, as the value itself determines
    the instant, more that the order of its source chose.  Records without a valid interpretation get none.
    Null sources are one source; null sequence values come first.
    """
    spark = records.sparkSession
    n = chunks or partitions(spark)
    by = ["source", "seq", "kind", "record_id"]
    ordered = records.withColumn("source", F.coalesce("source", F.lit(""))).repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("chunk", F.spark_partition_id())
    usable = (read(ordered) if read else ordered).where(F.size("interpretations") > 0)
    placed = cut(usable.select("kind", "record_id", "source", "chunk", F.col("interpretations.utc_us").alias("us"), F.col("interpretations.format").alias("formats")))
    ends = placed.select("source", "kind", "record_id", "us", "formats", "chunk").mapInPandas(_summaries, _ENDS)
    fixed = ends.groupBy("source").applyInPandas(_fix_ends, "source string, chunk int, first_at int, last_at int")
    # At most two rows a chunk, whatever the data: they go to every task.
    pinned = {(r["source"], r["chunk"]): (r["first_at"], r["last_at"]) for r in fixed.collect()}

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk: list[int] = []
        steps: list[pd.DataFrame] = []

        def watched():
            for pdf in batches:
                if len(pdf):
                    chunk[:] = [int(pdf["chunk"].iloc[0])]
                    only = pdf[_counts(pdf["us"]) == 1].to_dict("list")
                    rows = [(k, i, int(u[0]), f[0], 1) for k, i, u, f in zip(only["kind"], only["record_id"], only["us"], only["formats"])]
                    steps.append(pd.DataFrame(rows, columns=["kind", "record_id", "utc_us", "format", "n_valid"]))
                yield pdf

        for part in _parts(watched()):
            if part is None:
                yield from steps
                steps.clear()
                continue
            source, _, keys, runs = part
            first, last = pinned.get((source, chunk[0]), (None, None))
            _, path = viterbi(runs, first, last)
            rows = [(*k, r[p][0], r[p][1], len(r)) for k, r, p in zip(keys, runs, path) if len(r) > 1]
            if rows:
                yield pd.DataFrame(rows, columns=["kind", "record_id", "utc_us", "format", "n_valid"])

    return placed.select("source", "kind", "record_id", "us", "formats", "chunk").mapInPandas(fill, "kind string, record_id bigint, utc_us bigint, format string, n_valid int")
