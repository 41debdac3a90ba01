"""Operator 4, mixing sources to target weights by Pfair scheduling.

Each source is a stream of blocks of documents. With target weight w, a share of
all slots, its block j is released at slot floor(j/w) and due before slot
ceil((j+1)/w). Earliest deadline first then fills every slot and meets every
deadline, so that after any number t of slots each source has had fewer than one
block more or less than w*t, from the first slot to the last of the whole mix.

Weights are whole numbers of 2**-32 parts, so what rounding them adds to that is
less than a thousandth of a block. The driver schedules blocks, not documents:
a block has ``block_docs`` documents, or as many as it takes to keep the
schedule at about ``max_slots`` slots, whatever the size of the data. Documents
are ranked within their source by the hash of their id: hash-prefix buckets are
counted, their counts summed up, and only within a bucket are rows sorted, so a
hot source is no single task.

A source that is used up starts over (its next *epoch*). The mix ends with the
slot in which the last document of the last source has been given out once; so
no document is lost, and the sources that have less than their weight asks for
repeat. The epochs of a document are made in ranges of ``_EPOCHS``; where a source
has more than one of these, they are spread over the cluster before they are.

Defined results
  * Documents without a source form a source of their own. Weights are for
    sources by name, null for these; sources without a weight are left out, and
    weights of sources that don't occur are spread over the others.
  * Ties and repeated rows, null ids and null texts are ranked by all columns'
    hash; rows equal in every column are interchangeable. Of equal deadlines, the
    source that is first by name (null last) goes first. Text isn't read.
  * An empty table gives an empty mix. Columns of the input named like ``slot``
    are kept; the mix's own get other names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .near_dedup import _free

#: Documents that a bucket holds on average, at most.
_BUCKET_ROWS = 4096
#: Sources whose table is broadcast; beyond, Spark chooses the join.
_BROADCAST_SOURCES = 100_000
#: Epochs of a document that are made in one place.
_EPOCHS = 1024
_PARTS = 1 << 32


@dataclass(frozen=True)
class Settings:
    block_docs: int = 8
    max_slots: int = 1 << 20
    #: Target weights are (share of documents) ** temperature, normalised, unless given.
    temperature: float = 0.7


def parts(weights: dict) -> dict:
    """Whole numbers in proportion to the weights, about _PARTS in all, at least one each."""
    total = sum(weights.values())
    return {k: max(1, round(w / total * _PARTS)) for k, w in weights.items()}


def schedule(part: dict, blocks: dict) -> dict[object, list[int]]:
    """Slots by source, earliest deadline first, until each has had so many blocks."""
    order = sorted(part, key=lambda k: (k is None, str(k)))
    share, total = [part[k] for k in order], sum(part.values())
    left, waiting = [blocks[k] for k in order], sum(blocks[k] > 0 for k in order)
    out: list[list[int]] = [[] for _ in order]
    later = [(0, n) for n in range(len(order))]  # (release, source) of each source's next block
    ready: list[tuple[int, int]] = []  # (deadline, source)
    slot = 0
    while waiting:
        while later and later[0][0] <= slot:
            n = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(len(out[n]) + 1) * total // share[n]), n))
        due, n = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("deadline missed")
        out[n].append(slot)
        left[n] -= 1
        waiting -= left[n] == 0
        heapq.heappush(later, (len(out[n]) * total // share[n], n))
        slot += 1
    return dict(zip(order, out))


def _plan(counts: dict, s: Settings, weights: dict | None) -> tuple[int, list[tuple]]:
    """Documents of a block, and (source, documents, slots) of each source."""
    if weights is None:
        weights = {k: n**s.temperature for k, n in counts.items()}
    weights = {k: w for k, w in weights.items() if counts.get(k) and w > 0}
    if not weights:
        return 0, []
    part = parts(weights)
    longest = max(-(-counts[k] * sum(part.values()) // x) for k, x in part.items())  # the mix in documents
    block = max(s.block_docs, -(-longest // s.max_slots))
    slots = schedule(part, {k: -(-counts[k] // block) for k in part})
    return block, [(k, counts[k], own) for k, own in slots.items()]


def _digest(docs: DataFrame, doc_id: str) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def mixed(docs: DataFrame, s: Settings = Settings(), weights: dict | None = None, doc_id: str = "doc_id", source: str = "source", names: tuple[str, str, str] = ("slot", "block", "epoch")) -> DataFrame:
    """docs' columns with the slot, the block of the source and the epoch of each
    place of the mix. Where docs has columns of these names, an underscore is added."""
    return _mixed(docs, s, weights, doc_id, source, names)[0]


def _mixed(docs: DataFrame, s: Settings, weights: dict | None, doc_id: str, source: str, names: tuple[str, str, str] = ("slot", "block", "epoch")) -> tuple[DataFrame, int]:
    """The mix, and the number of its slots."""
    spark = docs.sparkSession
    columns = docs.columns
    names = tuple(_free(docs, x) for x in names)
    key, digest, tie, bucket, rank, before, size, of, e, code, at = (_free(docs, x) for x in ("mix_key", "mix_digest", "mix_tie", "mix_bucket", "mix_rank", "mix_before", "mix_n", "mix_plan", "mix_e", "mix_code", "mix_slot"))
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source).alias("k")).count().collect()}
    block_docs, plan = _plan(counts, s, weights)
    if not plan:
        empty = docs.limit(0)
        return empty.select(*[F.col(f"`{c}`") for c in columns], *[F.lit(0).cast("long").alias(x) for x in names]), 0
    # maps have no hash; the other columns decide between rows of one id
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    digits = 0
    while 16**digits * _BUCKET_ROWS < sum(counts.values()):
        digits += 1
    keyed = docs.withColumns({key: F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")), digest: _digest(docs, doc_id), tie: F.xxhash64(*hashed)}).withColumn(bucket, F.substring(digest, 1, digits))
    sizes = keyed.groupBy(key, bucket).agg(F.count(F.lit(1)).alias(size))
    earlier = sizes.withColumn(before, F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(size)
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(key, bucket).orderBy(digest, tie)))
    placed = ranked.join(earlier, [key, bucket])
    table = spark.createDataFrame([("" if k is None else f"s{k}", i, n, len(own) * block_docs) for i, (k, n, own) in enumerate(plan)], f"{key} string, i long, n long, docs long")
    table = table.select(key, F.struct("i", "n", "docs").alias(of))
    placed = placed.join(F.broadcast(table) if len(plan) <= _BROADCAST_SOURCES else table, key)
    p = lambda x: F.col(f"{of}.{x}")
    placed = placed.withColumn(e, F.col(before) + F.col(rank) - 1).where(F.col(e) < p("docs"))
    if any(len(own) * block_docs > n * _EPOCHS for _, n, own in plan):
        placed = placed.withColumn(e, F.explode(F.expr(f"sequence({e}, {of}.docs - 1, {of}.n * {_EPOCHS})"))).repartition(key, digest, e)
        last = f"least({of}.docs - 1, {e} + {of}.n * {_EPOCHS - 1})"
    else:
        last = f"{of}.docs - 1"
    placed = placed.withColumn(e, F.explode(F.expr(f"sequence({e}, {last}, {of}.n)")))
    block = F.floor(F.col(e) / block_docs)
    # a row for each slot, of which there are about max_slots at most
    codes = pa.table({code: np.concatenate([(i << 32) + np.arange(len(own)) for i, (_, _, own) in enumerate(plan)]), at: np.concatenate([np.array(own, np.int64) for _, _, own in plan])})
    placed = placed.withColumn(code, F.shiftleft(p("i"), 32) + block).join(F.broadcast(spark.createDataFrame(codes)), code)
    out = placed.select(*[F.col(f"`{c}`") for c in columns], F.col(at).alias(names[0]), block.cast("long").alias(names[1]), F.floor(F.col(e) / p("n")).cast("long").alias(names[2]))
    return out, sum(len(own) for _, _, own in plan)


def in_order(docs: DataFrame, s: Settings = Settings(), weights: dict | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs mixed, in the order of slots: rows lie one after the other in the
    partitions and within them, and so in the files that are written from it."""
    out, slots = _mixed(docs, s, weights, doc_id, source)
    if not slots:
        return docs.limit(0)
    slot = _free(docs, "slot")
    # slots are all equally long, so that their number says where each belongs: no sample is taken
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = out.repartitionById(parts, F.floor(F.col(slot) * parts / slots).cast("int"))
    return placed.sortWithinPartitions(slot, F.xxhash64(F.col(doc_id))).select(*[F.col(f"`{c}`") for c in docs.columns])
