"""Distributed weighted cuts: where, in key order, the weight of a node's items reaches a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys lie in 0 .. 2**KEY_BITS - 1.
KEY_BITS = 60
#: Rows of histograms that come to the driver at once, about; each node has 16 at least.
HISTOGRAM_ROWS = 1 << 17


def weighted_cuts(items: DataFrame, targets: dict[int, int], tolerance: int = 0) -> dict[int, int]:
    """For each node the cut, so that its items with smaller keys weigh at most the target, and with the next key more.

    ``items``: node, key, weight, all long. Each pass adds up the weights of the key ranges around the cuts
    and narrows every node to the range that holds its cut, so no item leaves its task. A node is done when
    the range is one key or weighs at most ``tolerance``; with a tolerance the cut is at the end of the range
    that comes closer to the target.
    """
    spark = items.sparkSession
    bits = max(4, min(12, (HISTOGRAM_ROWS // max(1, len(targets))).bit_length() - 1))
    state = {n: (0, KEY_BITS, t) for n, t in targets.items()}
    cuts: dict[int, int] = {}
    while state:
        rows = [(n, low, max(0, width - bits), low + (1 << width)) for n, (low, width, _) in state.items()]
        now = spark.createDataFrame(rows, "node long, low long, step int, high long")
        # one row for each open node: their number is the caller's bound
        found = (
            items.join(F.broadcast(now), "node")
            .filter("key >= low AND key < high")
            .groupBy("node", F.expr("shiftright(key - low, step)").alias("range"))
            .agg(F.sum("weight").alias("weight"))
            .collect()
        )
        by_node: dict[int, list] = {n: [] for n in state}
        for r in found:
            by_node[r.node].append((r.range, r.weight))
        for n, ranges in by_node.items():
            low, width, left = state.pop(n)
            step = max(0, width - bits)
            for at, weight in sorted(ranges):
                if weight > left:
                    break
                left -= weight
            else:
                cuts[n] = low + (1 << width)
                continue
            start = low + (at << step)
            if step == 0 and not tolerance:
                cuts[n] = start
            elif step == 0 or weight <= tolerance:
                cuts[n] = start if left <= weight - left else start + (1 << step)
            else:
                state[n] = (start, step, left)
    return cuts
