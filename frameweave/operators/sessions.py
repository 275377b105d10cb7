"""Sessions by inactivity gap, from a Cartesian tree over the gaps of each entity.

The events of an entity in time order leave a sequence of gaps.  The Cartesian
(max) tree over those gaps has one subtree for every run of events that stays
together as long as the allowed pause is at least the largest gap inside the run
(``height``) and below the smaller gap around it (``parent_gap``).  The table of
subtrees therefore answers *every* gap setting with one filter::

    height <= pause AND (parent_gap IS NULL OR parent_gap > pause)

Trees are built per chunk of range-sorted events, so that an entity with any
share of the rows is spread over many tasks.  A chunk finishes every subtree that
lies inside it and hands on only its two spines: the blocks between strictly
growing record gaps from either end.  Strictly growing whole-millisecond gaps
``g1 < g2 < ...`` sum to at least ``k*(k+1)/2``, so a spine has at most
``sqrt(2 * span)`` blocks (in practice a few dozen); the merge of an entity's
spines is the same tree builder over blocks instead of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ordered_chunks

_NODE = "entity string, start bigint, end bigint, n bigint, height bigint, parent_gap bigint, open boolean"
_COLS = ["entity", "start", "end", "n", "height", "parent_gap", "open"]
_INF = 1 << 62


class _Tree:
    """Stack of blocks ``[start, end, n, height, left_gap]`` with falling left gaps."""

    def __init__(self, entity: str, left_open: bool, low: int, high: int):
        self.entity, self.left_open, self.low, self.high = entity, left_open, low, high
        self.stack: list[list[int]] = []
        self.prefix: list[list[int]] = []

    def _node(self, block: list[int], parent: int, out: list[tuple]) -> None:
        if block[3] < parent and block[3] <= self.high and parent > self.low:
            out.append((self.entity, block[0], block[1], block[2], block[3], None if parent >= _INF else parent, False))

    def _fold(self, gap: int, out: list[tuple]) -> None:
        """Close what cannot grow past a gap of this length on the right."""
        stack = self.stack
        while len(stack) > 1 and stack[-1][4] <= gap:
            right = stack.pop()
            left, by = stack[-1], right[4]
            if len(stack) == 1 and self.left_open and (not self.prefix or left[4] < by):
                self.prefix.append(left)  # what is left of it is in another chunk: its parent isn't known here
                stack[-1] = right
                continue
            self._node(left, by, out)
            self._node(right, by, out)
            stack[-1] = [left[0], right[1], left[2] + right[2], by, left[4]]

    def add(self, start: int, end: int, n: int, height: int, out: list[tuple]) -> None:
        if not self.stack:
            self.stack.append([start, end, n, height, _INF])
            return
        gap = start - self.stack[-1][1]
        self._fold(gap, out)
        self.stack.append([start, end, n, height, gap])

    def close(self, right_open: bool, out: list[tuple]) -> None:
        if not right_open:
            self._fold(_INF - 1, out)
        if self.left_open or right_open:
            for b in (*self.prefix, *self.stack):
                out.append((self.entity, b[0], b[1], b[2], b[3], None, True))
        elif self.stack:
            self._node(self.stack[0], _INF, out)


def _chunk_trees(low: int, high: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree: _Tree | None = None
        first = True
        for pdf in batches:
            out: list[tuple] = []
            for entity, ts, n in zip(pdf["entity"].tolist(), pdf["ts"].tolist(), pdf["n"].tolist()):
                if tree is None or entity != tree.entity:
                    if tree is not None:
                        tree.close(False, out)
                        first = False
                    tree = _Tree(entity, first, low, high)
                tree.add(ts, ts, n, -1, out)
            yield pd.DataFrame(out, columns=_COLS).astype({"parent_gap": "Int64"})
        if tree is not None:
            out = []
            tree.close(True, out)
            yield pd.DataFrame(out, columns=_COLS).astype({"parent_gap": "Int64"})

    return run


def _merge(low: int, high: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        tree = _Tree(pdf["entity"].iloc[0], False, low, high)
        out: list[tuple] = []
        for row in zip(pdf["start"].tolist(), pdf["end"].tolist(), pdf["n"].tolist(), pdf["height"].tolist()):
            tree.add(*row, out)
        tree.close(False, out)
        return pd.DataFrame(out, columns=_COLS).astype({"parent_gap": "Int64"})

    return run


def gap_tree(
    events: DataFrame, entity: str | Column, ts: str | Column, *, pauses: tuple[int, int] = (0, _INF - 2), chunks: int | None = None
) -> DataFrame:
    """All runs of events that form a session for some pause within ``pauses`` (low, high).

    Result: ``entity, start, end, n, height, parent_gap`` (``height`` -1 for
    events of one instant; ``parent_gap`` null where nothing lies around the run).
    Events without an entity or without a time belong to no run.  Events of one
    instant are one leaf with their count; an empty table gives no rows.  Other
    columns of ``events`` are ignored, whatever their names.
    """
    low, high = pauses
    named = events.select(F.col(entity).cast("string").alias("entity") if isinstance(entity, str) else entity.cast("string").alias("entity"),
                          F.col(ts).cast("bigint").alias("ts") if isinstance(ts, str) else ts.cast("bigint").alias("ts"))
    leaves = named.where("entity is not null and ts is not null").groupBy("entity", "ts").agg(F.count(F.lit(1)).alias("n"))
    # The range-sorted leaves aren't needed twice, so only the nodes are written.
    from ..session import partitions

    n = chunks or partitions(events.sparkSession)
    nodes = cut(leaves.repartitionByRange(n, "entity", "ts").sortWithinPartitions("entity", "ts").mapInPandas(_chunk_trees(low, high), _NODE))
    merged = nodes.where("open").groupBy("entity").applyInPandas(_merge(low, high), _NODE)
    return nodes.where("not open").unionByName(merged).drop("open")


def cut_sessions(tree: DataFrame, pause: int) -> DataFrame:
    """The sessions of one pause: neighbours further apart than ``pause`` are separated."""
    return tree.where((F.col("height") <= pause) & (F.col("parent_gap").isNull() | (F.col("parent_gap") > pause))).select(
        "entity", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "n"
    )


def latest_per_key(df: DataFrame, key: str, version: str, keep: list[str]) -> DataFrame:
    """Of each key the values of the row with the greatest version.

    Null keys are left out; a null version is the oldest; equal versions are
    settled by the greatest values in column order, so that the choice does not
    depend on row order.  Combines before the shuffle, whatever a key's share.
    """
    top = F.max(F.struct(F.col(version), *[F.col(c) for c in keep])).alias("top")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, *[F.col(f"top.{c}").alias(c) for c in keep])


__all__ = ["gap_tree", "cut_sessions", "latest_per_key", "ordered_chunks"]
