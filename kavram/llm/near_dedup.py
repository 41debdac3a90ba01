"""Operator 6, near-duplicates by b-bit MinHash.

A document is the set of its ``shingle``-word shingles. Minima under
``perms`` hash functions give the bands (from whole minima) and a packed
signature of only their low ``bits`` bits. Documents that share a band's bucket
are candidates; the similarity of a pair is estimated from the number of equal
b-bit values in the packed signatures, corrected for chance collisions:
``(equal/perms - 2**-bits) / (1 - 2**-bits)``. Pairs of at least ``threshold``
by this estimate are linked, and linked documents form groups. The estimate's
standard error is 0.05 at most, so half of the pairs whose similarity is the
threshold are linked, and of those that are 0.07 above it nine tenths at least
(the bands lose 2 % at the threshold).

A bucket isn't compared pair by pair: a search that takes a document, compares it
with all that aren't reached yet and goes on from those it links gives the same
groups with a tree of links. A bucket of thousands of copies needs little more
comparisons than it has documents. One of over ``_BUCKET`` documents is cut into
chunks by hash, and every two chunks are searched together, by a task of their
own. There is no cap.

Defined results
  * The unit is a distinct (doc_id, text), known by 128 bits of hash; repeated
    rows are one unit, of which one row stays. The one that stays of a group has the
    smallest doc_id (null last, then the smallest hash of id and text).
  * Null texts and texts without words are in no group and always stay, repeated
    or not. A text of fewer words than a shingle is one shingle.
  * A text may be of any length; extra columns are carried along, whatever
    their names. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K
from .storage import removed, written

#: Documents of a bucket, or of two chunks of one, that are searched together, about.
_BUCKET = 8192
#: Documents of one bucket that are compared at a time.
_BLOCK = 4096


@dataclass(frozen=True)
class Settings:
    shingle: int = 3
    bands: int = 40
    rows: int = 3
    bits: int = 4
    threshold: float = 0.45

    @property
    def perms(self) -> int:
        return self.bands * self.rows


def _multipliers(n: int) -> np.ndarray:
    return K.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def minima(hashes: np.ndarray, bounds: np.ndarray, perms: int) -> np.ndarray:
    """(texts, perms) minima of each text's shingle hashes. No text may be empty."""
    out = np.empty((len(bounds) - 1, perms), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, a in enumerate(_multipliers(perms)):
            out[:, k] = np.minimum.reduceat(hashes * a, bounds[:-1])
    return out


def packed(least: np.ndarray, bits: int) -> np.ndarray:
    """(texts, bits, perms/8) bit planes of the minima's low bits. The low bits of
    a multiplied hash depend on few bits, so the minima are mixed first."""
    low = K.mix64(least)
    return np.stack([np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(bool), axis=1) for b in range(bits)], axis=1)


def similarity(one: np.ndarray, others: np.ndarray, perms: int, bits: int) -> np.ndarray:
    """Estimated Jaccard similarity of one packed signature with each of others."""
    differ = np.bitwise_or.reduce(others ^ one[None], axis=1)
    equal = 1 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / perms
    chance = 2.0**-bits
    return (equal - chance) / (1 - chance)


def _signatures(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.byte_chunks(batches, 1):
            w = K.words(batch.column(1))
            hashes, bounds = K.grams(w.hashes, w.bounds, s.shingle)
            rows = np.flatnonzero(np.diff(bounds))
            if len(rows) == 0:
                continue
            least = minima(hashes, np.append(bounds[rows], bounds[-1]), s.perms)
            with np.errstate(over="ignore"):
                band = np.zeros((len(rows), s.bands), dtype=np.uint64)
                for r in range(s.rows):
                    band = K.mix64(band * np.uint64(31) + least[:, r :: s.rows])
                band = K.mix64(band + np.arange(s.bands, dtype=np.uint64)[None])
            bits = np.ascontiguousarray(packed(least, s.bits)).reshape(len(rows), -1)
            width = bits.shape[1]
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    kept.column(0),
                    kept.column(2),
                    pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * s.bands, pa.int32()), pa.array(band.view(np.int64).ravel())),
                ],
                ["doc_id", "rid", "sig", "bands"],
            )

    return run


def _links_of_bucket(ids: np.ndarray, sigs: np.ndarray, s: Settings) -> list[tuple[int, int, float]]:
    """A spanning forest of the pairs in one bucket that are similar enough."""
    left = np.arange(len(ids))
    out = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            like = np.concatenate([similarity(sigs[at], sigs[left[i : i + _BLOCK]], s.perms, s.bits) for i in range(0, len(left), _BLOCK)])
            hit = like >= s.threshold
            for x, v in zip(left[hit], like[hit]):
                out.append((int(ids[at]), int(ids[x]), float(v)))
            queue += left[hit].tolist()
            left = left[~hit]
    return out


def _links(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by band; a bucket may go on in the next batch."""

        def buckets(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            band = table["band"].to_numpy()
            ids = table["node"].to_numpy()
            raw = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(ids), s.bits, -1)
            cuts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
            size = np.diff(cuts)
            out = []
            pairs = cuts[:-1][size == 2]  # most buckets: all at once
            if len(pairs):
                differ = np.bitwise_or.reduce(raw[pairs] ^ raw[pairs + 1], axis=1)
                chance = 2.0**-s.bits
                like = (1 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / s.perms - chance) / (1 - chance)
                out += [(int(ids[p]), int(ids[p + 1]), float(v)) for p, v in zip(pairs, like) if v >= s.threshold]
            for a, n in zip(cuts[:-1][size > 2], size[size > 2]):
                out += _links_of_bucket(ids[a : a + n], raw[a : a + n], s)
            columns = list(zip(*out)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

        held: list[pa.RecordBatch] = []
        last = None  # the band of what is held
        for batch in batches:
            if batch.num_rows == 0:
                continue
            band = batch.column(batch.schema.get_field_index("band")).to_numpy()
            cut = int(np.searchsorted(band, band[-1]))
            if cut or band[0] != last:
                before = [*held, batch.slice(0, cut)] if cut else held
                if before:
                    yield buckets(before)
                held, last = [], band[-1]
            held.append(batch.slice(cut))
        if held:
            yield buckets(held)

    return run


def components(links: DataFrame, prefix: str) -> DataFrame:
    """(id, root): the smallest id that each id of links (a, b) is connected with.

    Every round sends each node's smallest neighbour to all its neighbours, then
    points it at its parent's parent, so the number of rounds grows with the
    logarithm of a group's diameter. Each round is written to the shared folder,
    and the one before it deleted."""

    def both_ways(pairs: DataFrame) -> DataFrame:
        return written(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), prefix + "-edges")

    edges = both_ways(links.select("a", "b").where("a <> b"))
    while True:
        least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star and small star in one: every neighbour, and the node itself, is linked with the smallest
        joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        later = both_ways(joined.union(least.select("a", F.col("m").alias("b"))).where("a <> b"))
        removed(edges)
        edges = later
        # done when every node has one smaller neighbour at most, and that has none smaller
        up = edges.where("b < a")
        many = up.groupBy("a").count().where("count > 1").limit(1).count()
        if not many and not up.alias("u").join(up.alias("v"), F.col("u.b") == F.col("v.a")).limit(1).count():
            return up.select(F.col("a").alias("id"), F.col("b").alias("root")).union(up.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def groups(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, copies, keep_rid, keep_id, similarity): every unit that is
    in a group of two or more units, or whose row is repeated, and the unit that
    stays of its group. similarity: with that one, from the signatures."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _rid(doc_id, text).alias("rid"))
    kind = docs.schema[doc_id].dataType.simpleString()
    raw = slim.mapInArrow(_signatures(s), f"doc_id {kind}, rid binary, sig binary, bands array<long>")
    once = raw.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    # numbers that no two units share; they are written, so they are given once
    units = written(once.withColumn("unit", F.monotonically_increasing_id()), "near-units")
    # units of one and the same signature are one node; the bands see one of them
    node = units.groupBy("sig").agg(F.min("unit").alias("node"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    exploded = node.select("node", F.explode("bands").alias("band"))
    shared = exploded.join(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band")
    chunk = f"cast(pmod(xxhash64(node, band), ceil(n / {max(1, _BUCKET // 2)})) as int)"
    others = f"filter(sequence(0, cast(ceil(n / {max(1, _BUCKET // 2)}) as int) - 1), c -> c <> {chunk})"
    bands = f"if(n > {_BUCKET}, transform({others}, c -> xxhash64(band, least(c, {chunk}), greatest(c, {chunk}))), array(band))"
    searched = shared.select("node", F.explode(F.expr(bands)).alias("band")).join(node.select("node", "sig"), "node")
    links = searched.select("band", "node", "sig").repartition("band").sortWithinPartitions("band").mapInArrow(_links(s), "a long, b long, similarity double")
    links = written(links.select("a", "b"), "near-links")
    same = units.join(node.where("n > 1").select("sig", "node"), "sig").where("unit <> node").select(F.col("unit").alias("a"), F.col("node").alias("b"))
    roots = components(links.union(same), "near")
    removed(links)
    found = units.select("unit", "rid", "doc_id", "sig", "copies").join(roots.withColumnRenamed("id", "unit"), "unit", "left").where("root is not null or copies > 1")
    found = found.withColumn("root", F.coalesce("root", "unit"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid", "sig")).alias("k"))
    joined = found.join(first, "root")
    return joined.select("rid", "doc_id", "copies", F.col("k.rid").alias("keep_rid"), F.col("k.doc_id").alias("keep_id"), _estimate(s)("sig", "k.sig").alias("similarity"))


def _rid(doc_id: str, text: str) -> Column:
    """128 bits of id and text, which tell nulls from empty ones."""
    name = F.col(doc_id).cast("string")
    parts = (F.coalesce(F.length(name), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(name, F.lit("")), F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(F.col(text), F.lit("")))
    return F.unhex(F.md5(F.concat(*parts)))


def _estimate(s: Settings):
    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), s.bits, -1) for v in (a, b))
        differ = np.bitwise_or.reduce(x ^ y, axis=1)
        chance = 2.0**-s.bits
        return pd.Series((1 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / s.perms - chance) / (1 - chance))

    return estimate


def duplicates(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, duplicate_of, similarity): a row for each unit that goes, and the
    one of its group that stays. Repeats of a row that stays aren't listed."""
    found = groups(docs, s, doc_id, text).where("rid <> keep_rid")
    return found.select("doc_id", F.col("keep_id").alias("duplicate_of"), F.round("similarity", 6).alias("similarity"))


def deduplicated(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that go, all columns as they are."""
    found = written(groups(docs, s, doc_id, text).where("rid <> keep_rid").select("rid"), "near-found")
    rid = _free(docs, "rid")
    # a row without words is a unit of its own; the others' repeats go before they are moved
    lone = F.concat(F.lit(b"row").cast("binary"), F.monotonically_increasing_id().cast("string").cast("binary"))
    keyed = docs.withColumn(rid, F.when(F.col(text).rlike(_SOME_WORD), _rid(doc_id, text)).otherwise(lone))
    kept = keyed.dropDuplicates([rid]).join(found.withColumnRenamed("rid", rid), rid, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


#: What the kernel takes for a word.
_SOME_WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"


def _free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name
