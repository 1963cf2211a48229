"""Upload batches: changes packed greedily in order, a vault of any size over many tasks.

A vault's sequence is cut into blocks. What a block does to the batch that is open at its start
depends on one number, the bytes used so far: up to some of its changes still fit, at the next one a
batch begins, and from there all is settled. So each block is summed up, for every first break that
matters, by the batches begun and the bytes used at its end; breaks that lead to the same end are one
piece. Only these sums are chained in a vault's order, and then every block numbers its own changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ids import placed

#: Changes in a block, about.
BLOCK = 8192
SUMS = "vault_id long, block long, total long, upto array<long>, begun array<long>, used array<long>"


def _breaks(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(running sums from 0 of sizes and commas, for each change that opens a batch the next that does)."""
    sums = np.append(0, np.cumsum(sizes + 1))
    return sums, np.searchsorted(sums, sums[:-1] + room + 1, side="right") - 1


def summed_up(sizes: np.ndarray, overhead: int, limit: int) -> tuple[int, list[int], list[int], list[int]]:
    """(total, upto, begun, used): with u bytes used before, no batch begins if u + total <= limit;
    else the piece of the greatest ``upto`` below u says how many begin and what is used in the end."""
    sums, after = _breaks(sizes, limit - overhead)
    m = len(sizes)
    begun, last = np.ones(m, dtype=np.int64), np.arange(m)
    for k in range(m - 1, -1, -1):
        if after[k] < m:
            begun[k], last[k] = begun[after[k]] + 1, last[after[k]]
    used = overhead + sums[m] - sums[last] - 1
    # The first break is at k for limit - sums[k + 1] < u <= limit - sums[k].
    piece = np.append((begun[1:] != begun[:-1]) | (used[1:] != used[:-1]), True)  # the last k of each
    at = np.flatnonzero(piece)[::-1]
    return int(sums[m]), (limit - sums[at + 1]).tolist(), begun[at].tolist(), used[at].tolist()


def numbered(sizes: np.ndarray, entry: int, batch: int, overhead: int, limit: int) -> np.ndarray:
    """The batch of each change of a block that is entered with ``entry`` bytes used in ``batch``."""
    sums, after = _breaks(sizes, limit - overhead)
    k = int(np.searchsorted(sums, limit - entry, side="right")) - 1
    starts = np.zeros(len(sizes), dtype=np.int64)
    while k < len(sizes):
        starts[k] = 1
        k = int(after[k])
    return batch + np.cumsum(starts)


def upload_batches(changes: DataFrame, overhead: int, limit: int) -> DataFrame:
    """(vault_id, seq, bytes, batch): a batch's size is ``overhead`` plus its changes and the commas between them.

    A change that is too large alone is an error. (vault_id, seq) are single.
    """
    limit = max(limit, 1)
    rows = placed(changes.select("vault_id", "seq", "bytes"), ["vault_id"], ["seq"]).withColumn("block", F.floor(F.col("place") / BLOCK))
    blocks = stored(rows.drop("place"), "pack-blocks")

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group.sort_values("seq")["bytes"].to_numpy(dtype=np.int64)
        if len(sizes) and overhead + sizes.max() > limit:
            raise ValueError(f"a change of {sizes.max()} bytes exceeds the upload limit of {limit}")
        total, upto, begun, used = summed_up(sizes, overhead, limit)
        return pd.DataFrame({"vault_id": group["vault_id"].iloc[0], "block": group["block"].iloc[0], "total": [total], "upto": [upto], "begun": [begun], "used": [used]})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vault, used, batch = None, 0, 0
        for b in batches:
            entries = []
            for r in b.itertuples():
                if r.vault_id != vault:
                    vault, used, batch = r.vault_id, limit, -1  # full, so that the first change opens batch 0
                entries.append((used, batch))
                if used + r.total <= limit:
                    used += r.total
                else:
                    k = int(np.searchsorted(r.upto, used, side="left")) - 1
                    used, batch = int(r.used[k]), batch + int(r.begun[k])
            yield pd.DataFrame({"vault_id": b["vault_id"], "block": b["block"], "entry": [e for e, _ in entries], "first": [n for _, n in entries]})

    def number(group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        if not len(group):
            return pd.DataFrame({"vault_id": [], "seq": [], "bytes": [], "batch": []})
        found = numbered(group["bytes"].to_numpy(dtype=np.int64), int(state["entry"].iloc[0]), int(state["first"].iloc[0]), overhead, limit)
        return pd.DataFrame({"vault_id": group["vault_id"], "seq": group["seq"], "bytes": group["bytes"], "batch": found})

    sums = blocks.groupBy("vault_id", "block").applyInPandas(sum_up, SUMS)
    sums = sums.repartition("vault_id").sortWithinPartitions("vault_id", "block")  # a few numbers a block
    entries = sums.mapInPandas(chain, "vault_id long, block long, entry long, first long")
    both = blocks.groupBy("vault_id", "block").cogroup(entries.groupBy("vault_id", "block"))
    return both.applyInPandas(number, "vault_id long, seq long, bytes long, batch int")
