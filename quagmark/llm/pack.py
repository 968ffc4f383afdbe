"""Filling containers of fixed capacity by harmonic classes, independently on every worker.

Class k holds the items of which exactly k fit side by side: sizes in (capacity/(k+1), capacity/k]. Per worker a container gets
k items of its class; the space left is topped up from the finer classes, each time from the coarsest class whose every item
fits. Containers that stay too empty, of which a worker has few, are unpacked and their items dealt to fewer workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quagmark.session import checkpointed

CLASSES = 256


def packed(sizes: list[int], capacity: int, classes: int = CLASSES) -> list[list[int]]:
    """Containers, as lists of positions in ``sizes``; sizes must not exceed the capacity."""
    pools: list[list[int]] = [[] for _ in range(classes + 1)]
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        pools[min(classes, capacity // sizes[i]) if sizes[i] else classes].append(i)  # the largest of a class is taken first
    open_classes = sum(1 << k for k in range(1, classes + 1) if pools[k])
    bins = []
    while open_classes:
        k = (open_classes & -open_classes).bit_length() - 1
        own, room = [], capacity
        for _ in range(k):
            if not pools[k] or sizes[pools[k][-1]] > room:
                break
            own.append(i := pools[k].pop())
            room -= sizes[i]
        if not pools[k]:
            open_classes &= ~(1 << k)
        while room > 0:
            least = min(classes, -(-capacity // room))
            # the class just coarser may hold some that fit
            near = least - 1
            if near >= 1 and pools[near] and sizes[pools[near][0]] <= room:
                low, high = 0, len(pools[near])
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if sizes[pools[near][middle]] <= room else (low, middle)
                j, i = near, pools[near].pop(low)
            else:
                finer = open_classes >> least
                if not finer:
                    break
                j = least + (finer & -finer).bit_length() - 1
                if sizes[pools[j][-1]] > room:
                    break
                i = pools[j].pop()
            own.append(i)
            room -= sizes[i]
            if not pools[j]:
                open_classes &= ~(1 << j)
        bins.append(own)
    return bins


SCHEMA = "lane string, capacity int, doc_id {id}, part int, n_tokens int, container string, settled boolean"


def _worker(full: float, number: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for b in batches:
                yield from b.itertuples(index=False, name=None)

        for (lane, capacity, worker), own in groupby(rows(), key=lambda r: (r[0], r[1], r[5])):
            items = list(own)
            sizes = [r[4] for r in items]
            out = []
            for seq, positions in enumerate(packed(sizes, capacity)):
                done = sum(sizes[i] for i in positions) >= full * capacity
                name = f"{lane}-{number}-{worker}-{seq}"
                out += [(lane, capacity, items[i][2], items[i][3], sizes[i], name, done) for i in positions]
            yield pd.DataFrame(out, columns=["lane", "capacity", "doc_id", "part", "n_tokens", "container", "settled"])

    return work


def containers(sizes: DataFrame, lanes: list[tuple[str, int]], items_per_worker: int = 20_000, full: float = 0.98, rounds: int = 3) -> DataFrame:
    """(lane, capacity, container, doc_id, part, n_tokens): for every lane every item of ``sizes`` (doc_id, n_tokens) in a container.

    An item longer than a lane's capacity is split into parts of the capacity and a rest (part counts from 0); no other is
    split. Null sizes count as 0, and items of size 0 are put in like any other. Items are dealt to workers by a hash, and a worker
    sorts its own, so that a repeated task packs alike; repeated rows are packed as often as they occur. A container filled by less than
    ``full`` is unpacked and its items dealt again, for ``rounds`` rounds, the last of which keeps all. Parts are counted
    and dealt like items, so that a worker holds about ``items_per_worker`` of a lane. An empty table gives an empty result.
    """
    kind = sizes.schema["doc_id"].dataType.simpleString()
    lane_array = F.array(*(F.struct(F.lit(n).alias("lane"), F.lit(int(c)).cast("int").alias("capacity")) for n, c in lanes))
    each = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("size"), F.explode(lane_array).alias("l")).select("l.*", "doc_id", "size")
    parts = F.greatest(F.ceil(F.col("size") / F.col("capacity")).cast("int"), F.lit(1))
    items = each.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    items = items.select("lane", "capacity", "doc_id", "part", F.least("capacity", F.col("size") - F.col("part") * F.col("capacity")).cast("int").alias("n_tokens"))
    done = None
    most = lambda df: max((r["n"] for r in df.groupBy("lane").agg(F.count("*").alias("n")).collect()), default=0)
    left, n = items, most(items)
    for number in range(rounds):
        workers = max(1, -(-n // items_per_worker))
        last = number == rounds - 1 or workers == 1
        dealt = left.withColumn("worker", F.pmod(F.xxhash64("doc_id", "part", F.lit(number)), F.lit(workers)).cast("int"))
        dealt = dealt.repartition(workers * len(lanes), "lane", "worker").sortWithinPartitions("lane", "worker", "n_tokens", "doc_id", "part")
        out = dealt.mapInPandas(_worker(0.0 if last else full, number), SCHEMA.format(id=kind))
        if last:
            done = out if done is None else done.unionByName(out)
            break
        out = checkpointed(out)
        settled = out.where("settled")
        done = settled if done is None else done.unionByName(settled)
        left = out.where("NOT settled").select("lane", "capacity", "doc_id", "part", "n_tokens")
        n = most(left)
        if n == 0:
            break
    return done.select("lane", "capacity", "container", "doc_id", "part", "n_tokens")
