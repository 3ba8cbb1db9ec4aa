"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test item becomes its windows of ``window`` consecutive words (a shorter item
is one window).  Windows of one length form a group with a shift table indexed
by the hash of a two-word block: it says how far the search may move on when
that block ends at the present position.  Where the shift is zero, the windows
in the bucket of that suffix are compared word by word, and then byte by byte.
The text moves through the tables in lanes, all lanes of a slice at once.

The windows travel to the tasks in blocks of about ``BLOCK_WINDOWS``.  A larger
test set is searched in more passes over the rows: the next block is only made
when the pass before has been written to the shared checkpoint folder, so driver
and tasks hold one block at a time.  No pass shuffles.

Defined cases: a null or empty text has no words and is not hit; an item with no
words is ignored, a null item id is written as an empty string; equal windows of
several items count for each of them; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratlas.llm.textops import ALNUM_WORD, Words, cut, for_python, fresh, mix, slices

WINDOW = 13
#: About 25 MB of word hashes, shift tables and texts.
BLOCK_WINDOWS = 100_000
_LANE = 64
#: Larger slices than elsewhere: each step of the lanes has a fixed cost, and a slice needs little memory here.
_SLICE = 1 << 20
_C = np.uint64(0xD6E8FEB86659FD93)

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])


class Group:
    """Windows of one length with their shift table and suffix buckets."""

    def __init__(self, length: int, hashes: np.ndarray, texts: list[bytes], owners: list[list[str]]):
        self.length, self.block = length, min(2, length)
        most = length - self.block + 1
        self.bits = max(12, min(22, int(len(hashes) * most).bit_length() + 3))
        shift = np.full(1 << self.bits, most, np.int16)
        for end in range(self.block - 1, length):
            slot = self._suffix(hashes, end) >> np.uint64(64 - self.bits)
            np.minimum.at(shift, slot, length - 1 - end)
        self.shift = shift
        suffix = self._suffix(hashes, length - 1)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.hashes = suffix[order], hashes[order]
        self.texts, self.owners = [texts[i] for i in order], [owners[i] for i in order]

    def _suffix(self, h: np.ndarray, end: int) -> np.ndarray:
        return mix(h[:, end - 1] * _C + h[:, end]) if self.block == 2 else mix(h[:, end])

    def search(self, h: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences, and which window each is."""
        length, n = self.length, len(h)
        pos = np.arange(length - 1, n, _LANE)
        stop = np.minimum(pos + _LANE, n)
        starts, which = [], []
        while len(pos):
            key = mix(h[pos - 1] * _C + h[pos]) if self.block == 2 else mix(h[pos])
            move = self.shift[key >> np.uint64(64 - self.bits)]
            zero = move == 0
            if zero.any():
                at, key = pos[zero], key[zero]
                lo, hi = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
                there = (hi > lo) & (words.row[at - length + 1] == words.row[at])
                at, lo, hi = at[there], lo[there], hi[there]
                for depth in range(int((hi - lo).max(initial=0))):
                    some = lo + depth < hi
                    first, pattern = at[some] - length + 1, lo[some] + depth
                    for j in range(length):
                        same = h[first + j] == self.hashes[pattern, j]
                        first, pattern = first[same], pattern[same]
                    starts.append(first)
                    which.append(pattern)
            pos = pos + np.maximum(move, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, pattern = np.concatenate(starts), np.concatenate(which)
        sure = [self.texts[p] == _joined(words, f, f + length) for f, p in zip(first.tolist(), pattern.tolist(), strict=True)]
        return first[sure], pattern[sure]


def _joined(words: Words, first: int, end: int) -> bytes:
    data, s, e = words.data, words.start, words.end
    return b" ".join(data[s[i] : e[i]].tobytes() for i in range(first, end))


def blocks(items: Iterator[tuple[str | None, str | None]], window: int = WINDOW, limit: int = BLOCK_WINDOWS) -> Iterator[list[Group]]:
    """Search tables for the items, in blocks of at most about ``limit`` different windows."""
    found: dict[bytes, tuple[np.ndarray, list[str]]] = {}

    def tables() -> list[Group]:
        by = defaultdict(list)
        for text, (h, owners) in found.items():
            by[len(h)].append((text, h, owners))
        return [Group(n, np.stack([x[1] for x in v]), [x[0] for x in v], [x[2] for x in v]) for n, v in sorted(by.items())]

    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = Words(data, np.array([0, len(data)]), ALNUM_WORD)
        h = words.hashes()
        n = min(window, len(h))
        for i in range(len(h) - n + 1 if n else 0):
            owners = found.setdefault(_joined(words, i, i + n), (h[i : i + n], []))[1]
            if not owners or owners[-1] != (item or ""):
                owners.append(item or "")
        if len(found) >= limit:
            yield tables()
            found = {}
    if found:
        yield tables()


def _scanner(groups: list[Group], text: str, keep: list[str], result: str, before: str | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, text, _SLICE):
                words = Words(data, at, ALNUM_WORD)
                h = words.hashes()
                delta = np.zeros(len(h) + 1, np.int64)
                owners: dict[int, set[str]] = defaultdict(set)
                for g in groups:
                    first, pattern = g.search(h, words)
                    np.add.at(delta, first, 1)
                    np.add.at(delta, first + g.length, -1)
                    for r, p in zip(words.row[first].tolist(), pattern.tolist(), strict=True):
                        owners[r].update(g.owners[p])
                if before:
                    for r, old in enumerate(part.column(before).to_pylist()):
                        for s in old["spans"]:
                            delta[words.first[r] + s["first"]] += 1
                            delta[words.first[r] + s["last"] + 1] -= 1
                            owners[r].update(old["items"])
                hit = np.cumsum(delta)[:-1] > 0
                opens = hit.copy()
                opens[1:] &= ~(hit[:-1] & (words.row[1:] == words.row[:-1]))
                closes = hit.copy()
                closes[:-1] &= ~(hit[1:] & (words.row[1:] == words.row[:-1]))
                spans: dict[int, list[dict[str, int]]] = defaultdict(list)
                for s, e in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(closes).tolist(), strict=True):
                    r = int(words.row[s])
                    spans[r].append({"first": s - int(words.first[r]), "last": e - int(words.first[r])})
                out = [{"n_words": n, "spans": spans.get(r, []), "items": sorted(owners[r]) if r in owners else []} for r, n in enumerate(words.count.tolist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out, _ARROW)], [*keep, result])

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, str]:
    """The columns ``keep`` of every document and a struct (name returned) of its word count, hit word spans and items.

    The test set is read in one stream by the driver, which never holds more than a block of it.
    """
    keep = list(docs.columns) if keep is None else keep
    (result,) = fresh(docs.columns, "contamination")
    keep = list(dict.fromkeys(keep))
    carried = keep if text in keep else [*keep, text]
    out = for_python(docs).select(*[F.col(f"`{c}`") for c in carried])
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).distinct()
    found = blocks(((r["i"], r["t"]) for r in rows.sort("i", "t").toLocalIterator()), window)
    schema = T.StructType([*[out.schema[c] for c in carried], T.StructField(result, RESULT)])
    out = out.mapInArrow(_scanner(next(found, []), text, carried, result, None), schema)
    for groups in found:
        out = cut(out).mapInArrow(_scanner(groups, text, carried, result, result), schema)
    return out.select(*[F.col(f"`{c}`") for c in keep], result), result


def n_hit(result: str):
    return F.aggregate(F.col(f"`{result}`.spans"), F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def is_contaminated(result: str):
    """At least one hit word, and at least a twentieth of all words."""
    return (n_hit(result) > 0) & (20 * n_hit(result) >= F.col(f"`{result}`.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns they came with."""
    out, result = find_contamination(docs, benchmark)
    return out.filter(~is_contaminated(result)).select(*[F.col(f"`{c}`") for c in docs.columns])
