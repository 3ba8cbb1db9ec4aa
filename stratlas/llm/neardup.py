"""Near-duplicate classes: MinHash banding, exact verification, connected components.

1. Each document's set of word shingles gives ``bands * rows`` minima of
   universal hash functions and a 128-bit fingerprint of the whole set.
2. Documents with equal sets are one class; only its smallest id goes on, so a
   group of copies is one row from here, however large.
3. Classes that share a band key meet in a bucket.  Each member is paired with
   the bucket's smallest id (a star, not all pairs), pairs are confirmed on the
   full sets, and components are formed.
4. Only pairs of one bucket whose ends are still in different components remain.
   All of them are looked at, in blocks: members of a bucket meet in groups of
   about ``2 * BLOCK`` at most, where one matrix product gives all intersections of
   their whole sets in 32-bit values.  What two shingles of one set may have lost
   to an equal value is added to the intersection, so the bound is exact and no
   link found by the bands is lost.  Only pairs that pass leave the group, to be
   confirmed like the others, so no list of pairs is made.
5. Components are contracted by alternating large-star and small-star.

A bucket or pivot with more than ``HOT`` rows is dealt over several tasks: the
hash slots of hot keys (a table of at most ``SLOTS`` rows, broadcast) say how many
copies of the small side are made, and each row of the large side picks one.

With 42 bands of 7 rows a pair at exactly 0.8 similarity meets in a bucket with
probability 1 - 5e-5, at 0.85 with 1 - 6e-8.

Defined cases: a null or empty text has an empty set, links with nothing and is
kept; a null id has no component and is kept; rows that share an id are one node
of the graph and stay or go together; ids that aren't integers are refused; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratlas.llm.textops import SPACE_WORD, Words, cut, for_python, fresh, mix, slices, windows

BANDS, ROWS = 42, 7
#: Up to so many ids (16 bytes each) are sent to all executors; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket, and their shingles together, that are compared with as many others at once.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Rows of one join key in one task, and hash slots that tell hot keys from others.
HOT, SLOTS = 256, 1 << 16
_U = np.uint64


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, n, dtype=np.uint64) | _U(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: their hashes, sorted by row, and each row's first index."""
    words = Words(data, at, SPACE_WORD)
    h = words.hashes()
    grams, first = windows(h, words, k)
    row = words.row[first]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        whole = words.count[short].astype(np.uint64)
        for j in range(k - 1):
            more = words.count[short] > j
            whole[more] = mix(whole[more] * _U(0x9E3779B97F4A7C15) + h[words.first[short[more]] + j])
        grams, row = np.concatenate([grams, whole]), np.concatenate([row, short])
    n = len(at) - 1
    order = np.argsort((row.astype(np.uint64) << _U(40)) | (grams >> _U(24))) if n < 1 << 24 else np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(n + 1))


def _signer(k: int, bands: int, rows: int):
    a, b = _coefficients(bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                grams, first = shingle_sets(data, at, k)
                size = np.diff(first)
                full = np.flatnonzero(size)
                keys = np.zeros((len(full), bands), np.uint64)
                d1, d2 = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
                if len(full):
                    begin = first[full]
                    d1[full] = np.add.reduceat(mix(grams + _U(1)), begin).view(np.int64)
                    d2[full] = np.add.reduceat(mix(grams ^ _U(0xA5A5A5A5A5A5A5A5)), begin).view(np.int64)
                    for i in range(bands):
                        key = np.full(len(full), i, np.uint64)
                        for j in range(i * rows, (i + 1) * rows):
                            least = np.minimum.reduceat((grams * a[j] + b[j]) >> _U(32), begin)
                            key = mix(key * _U(0x9E3779B97F4A7C15) + least)
                        keys[:, i] = key
                ends = np.zeros(len(size) + 1, np.int32)
                np.cumsum(np.where(size > 0, bands, 0), out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size.astype(np.int64)), pa.array(d1), pa.array(d2), lists], ["id", "n", "d1", "d2", "keys"])

    return sign


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                grams, first = shingle_sets(data, at, k)
                raw = [grams[s:e].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(raw, pa.binary())], ["id", "grams"])

    return sets


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ga"), batch.column("gb"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * same >= percent * (len(p) + len(q) - same)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return confirm


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set in different 32-bit values."""
    for batch in batches:
        raw = [np.unique(mix(np.frombuffer(x.as_buffer(), np.uint64) ^ _U(0x5BD1E995)).astype(np.uint32)).tobytes() for x in batch.column("grams")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["rep", "sketch"])


def _alike(n: np.ndarray, parts: list[np.ndarray], allowed: np.ndarray, percent: int) -> np.ndarray:
    """Which allowed pairs of a group may be similar enough; none that is gets lost. n: sizes of the sets, parts: their values."""
    some = np.flatnonzero(allowed.any(0) | allowed.any(1))
    size = np.array([len(parts[i]) for i in some])
    lost = n[some] - size
    values, row = np.concatenate([parts[i] for i in some]), np.repeat(np.arange(len(some)), size)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    # A value that one set has alone is in no intersection.
    shared = np.bincount(column) > 1
    column = (np.cumsum(shared) - 1)[column[keep := shared[column]]]
    row = row[keep]
    both = np.zeros((len(some), len(some)), np.float32)
    for c in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(column, [c, c + 2048])
        m = np.zeros((len(some), min(2048, int(shared.sum()) - c)), np.float32)
        m[row[lo:hi], column[lo:hi] - c] = 1
        both += m @ m.T
    most = np.minimum(both + np.minimum.outer(lost, lost), np.minimum.outer(n[some], n[some]))
    good = np.zeros(allowed.shape, bool)
    good[np.ix_(some, some)] = 100 * most >= percent * (n[some][:, None] + n[some][None, :] - most) - 1e-3
    return good & allowed


def _blocks(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, group in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("m"), strict=True):
                v = group.values
                rep, n, c, block = (v.field(k).to_numpy(zero_copy_only=False) for k in ("rep", "n", "c", "block"))
                allowed = (c[:, None] != c[None, :]) & (rep[:, None] < rep[None, :])
                allowed &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
                if i != j:
                    allowed &= block[:, None] != block[None, :]
                if allowed.any():
                    x, y = np.nonzero(_alike(n, [np.frombuffer(s.as_buffer(), np.uint32) for s in v.field("sketch")], allowed, percent))
                    a.extend(rep[x].tolist())
                    b.extend(rep[y].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def hot_slots(counts: DataFrame, key: str) -> DataFrame:
    """(slot, parts) of the hash slots of keys that have more than ``HOT`` rows, by (key, rows): at most ``SLOTS`` rows."""
    hot = counts.filter(F.col("rows") > HOT).groupBy(F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("slot"))
    return F.broadcast(cut(hot.agg(F.ceil(F.max("rows") / HOT).cast("int").alias("parts"))))


def _slotted(df: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    return df.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(SLOTS))).join(slots, "slot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def dealt(df: DataFrame, slots: DataFrame, key: str, by: str) -> DataFrame:
    """Rows of the large side with ``salt``, by the hash of a column."""
    return _slotted(df, slots, key).withColumn("salt", F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).drop("slot", "parts")


def copied(df: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """Rows of the small side, once for each ``salt``."""
    return _slotted(df, slots, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("slot", "parts")


def alike_across(members: DataFrame, sets: DataFrame, percent: int, slots: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket (key, rep, n, c) but different components c that may be similar enough."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("key").agg(blocks.alias("blocks"))
    x = dealt(members, slots, "key", "rep").join(copied(sizes, slots, "key"), ["key", "salt"]).join(sets.mapInArrow(_sketcher, "rep long, sketch binary"), "rep")
    x = x.withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = x.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("rep", "n", "c", "block", "sketch")).alias("m"))
    return groups.filter(F.size("m") > 1).select("i", "j", "m").mapInArrow(_blocks(percent), "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; an id that stands in very many pairs is dealt over several tasks."""
    ends = (("a", "b"), ("b", "a"))
    slots = [hot_slots(pairs.groupBy(end).agg(F.count("*").alias("rows")), end) for end, _ in ends]
    for (end, other), hot in zip(ends, slots, strict=True):
        right = copied(sets.select(F.col("id").alias(end), F.col("grams").alias("g" + end)), hot, end)
        pairs = dealt(pairs, hot, end, other).join(right, [end, "salt"]).drop("salt")
    return pairs.select("a", "b", "ga", "gb").mapInArrow(_confirmer(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b); component is the smallest id reachable.

    Large-star links all larger neighbours of a node to the smallest node it
    sees, small-star does so for the smaller neighbours; both only aggregate
    minima and join, so a node with very many neighbours is no single group.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) per row of ``docs``."""
    if not isinstance(docs.schema[id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id} is {docs.schema[id].dataType.simpleString()}; ids are integers")
    raw = for_python(docs).select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = cut(raw.mapInArrow(_signer(shingle, bands, rows), "id long, n long, d1 long, d2 long, keys array<long>"))
    classes = signed.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min_by("keys", "id").alias("keys"), F.min("id").alias("rep"))
    classes = cut(classes)
    banded = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count("*").alias("rows"), F.min("rep").alias("pivot")).filter("rows > 1"))
    slots = hot_slots(shared, "key")
    members = cut(dealt(banded, slots, "key", "rep").join(copied(shared.select("key", "pivot"), slots, "key"), ["key", "salt"]).drop("salt"))
    ids = cut(members.select(F.col("rep").alias("id")).distinct())
    found = ids.count()
    wanted = F.broadcast(ids) if found <= BROADCAST_IDS else ids
    sets = cut(raw.join(wanted, "id", "left_semi").mapInArrow(_setter(shingle), "id long, grams binary").distinct())

    near = "100 * least(n, n2) >= {0} * greatest(n, n2)".format(percent)
    size = classes.select(F.col("rep").alias("pivot"), F.col("n").alias("n2"))
    stars = members.filter("rep <> pivot").select("rep", "pivot", "n").distinct().join(size, "pivot").filter(near)
    stars = cut(stars.select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    edges = cut(confirmed(stars, sets, percent))
    label = components(edges)

    placed = members.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    open_ = cut(dealt(placed, slots, "key", "rep").join(copied(mixed, slots, "key"), ["key", "salt"]).drop("salt"))
    more = cut(confirmed(cut(alike_across(open_, sets, percent, slots)), sets, percent))
    if not more.isEmpty():
        label = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    classes = classes.select("d1", "d2", "n", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` but those of near-duplicates whose class keeps a smaller id."""
    (name,) = fresh(docs.columns, "gone")
    gone = near_duplicates(docs, id=id, **how).filter("not kept").select(F.col(id).alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id}`") == F.col(name), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
