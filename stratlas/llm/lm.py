"""Language-model scoring: prediction by partial matching over bytes, and a word unigram beside it.

The trie of byte contexts is kept as counts of byte windows: the count of a
context of k bytes and its next byte is the sum of longer windows with that end,
so one table of ``DEPTH + 1`` byte windows, counted by a shuffle over the whole
training corpus, holds all orders.  Escape probabilities follow method C (the
number of different successors); symbol exclusion takes a context's successors
out of the next shorter context, whose successors are a superset, so the
remaining total is one number per context and every code length is a lookup.

The model never leaves the executors.  It is dealt into parts of about
``PART_ROWS`` windows by the last three bytes of the context, so a part holds all
windows of each of its contexts of three bytes or more; shorter ones come from
the table of three-byte windows, which is broadcast (at most 2^24 rows, some
hundred thousand in text).  Texts are dealt into groups of about ``GROUP_BYTES``.
A group asks each part once for its different windows, the parts answer with
code lengths, and the group adds them up by text; word counts travel the same
way.  So a task holds one part with the windows asked of it, or one group with
its answers (or the longest single text).  With very many groups a part is
copied for every few thousand of them, so a common context is no hot key.

Defined cases: a null text is empty (one end token); a null id counts as the
empty id text, which trains; rows that repeat score alike; without training rows
the unigram's counts are 0 and every byte has probability 1/256; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlas.llm.textops import _LOWER, SPACE_WORD, Words, cut, for_python, slices

DEPTH = 5
#: Windows (or words) of the model in one part, and windows asked of one copy of a part.
PART_ROWS, ASKED_ROWS = 1 << 17, 1 << 22
#: Bytes of text in one group, and the fewest groups.
GROUP_BYTES, LEAST_GROUPS = 16 << 20, 32
#: Texts are counted in slices of so many bytes.
_COUNT_BYTES = 4 << 20
END, START = 0xFF, 0xFE
_END_TOKEN = np.uint64(0x6A09E667F3BCC909)
_U = np.uint64


class Index:
    """Exact lookup of 64-bit keys for whole arrays: entries in order of a hash, and each hash's first entry."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, len(keys).bit_length() + 1)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys = np.append(keys[order], _U(0))
        self.first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.order: np.ndarray | None = order
        self.longest = int(np.diff(self.first).max(initial=0))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys + _U(1)) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry in the order of ``keys`` as given to the constructor's sorted form, or -1."""
        slot = self._slot(keys)
        at, end = self.first[slot], self.first[slot + _U(1)]
        out = np.where((at < end) & (self.keys[at] == keys), at, -1)
        left = np.flatnonzero((out < 0) & (end - at > 1))
        for j in range(1, self.longest):
            if not len(left):
                break
            here = at[left] + j
            same = (here < end[left]) & (self.keys[here] == keys[left])
            out[left[same]] = here[same]
            left = left[~same & (here + 1 < end[left])]
        return out


class PPM:
    """Log10 probabilities of bytes after contexts of up to ``depth`` bytes; of a part, for its windows only.

    ``low`` has the counts of all windows of as many bytes as deal the parts.
    """

    def __init__(self, windows: np.ndarray, counts: np.ndarray, depth: int, low: tuple[np.ndarray, np.ndarray]):
        self.depth = depth
        self.grams, self.n, self.contexts, self.total, self.kinds, self.rest, self.rest_kinds = [], [], [], [], [], [], []
        below: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(depth + 1):
            source, weight = (windows, counts) if k >= _shared(depth) else low
            key = source & _U((1 << 8 * (k + 1)) - 1)
            gram, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse, weight, len(gram))
            context, first = np.unique(gram >> _U(8), return_index=True)
            total = np.add.reduceat(n, first) if len(n) else np.zeros(0)
            kinds = np.diff(np.append(first, len(gram))).astype(float)
            rest = rest_kinds = np.zeros(len(context))
            if k and len(n):
                suffix = gram & _U((1 << 8 * k) - 1)
                lower = below[1][np.searchsorted(below[0], suffix)]
                inner = np.searchsorted(self._plain[k - 1][0], context & _U((1 << 8 * (k - 1)) - 1))
                rest = self._plain[k - 1][1][inner] - np.add.reduceat(lower, first)
                rest_kinds = self._plain[k - 1][2][inner] - kinds
            if k == 0:
                self._plain = []
            self._plain.append((context, total, kinds))
            below = (gram, n)
            gi, ci = Index(gram), Index(context)
            self.grams.append(gi)
            self.n.append(n[gi.order].astype(np.float32))
            self.contexts.append(ci)
            for kept, x in ((self.total, total), (self.kinds, kinds), (self.rest, rest), (self.rest_kinds, rest_kinds)):
                kept.append(x[ci.order].astype(np.float32))
            gi.order = ci.order = None  # only needed to arrange the values
        del self._plain
        #: The common case, a byte seen after its whole context, is one lookup.
        if len(self.n[depth]):
            c = self.contexts[depth].find(self.grams[depth].keys[:-1] >> _U(8))
            self.seen = np.log10(self.n[depth] / (self.total[depth][c] + self.kinds[depth][c])).astype(np.float32)
        else:
            self.seen = np.zeros(0, np.float32)

    def log10(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows))
        at = self.grams[self.depth].find(windows)
        hit = at >= 0
        out[hit] = self.seen[at[hit]]
        todo = np.flatnonzero(~hit)
        t, d = np.full(len(todo), -1.0), np.zeros(len(todo))
        for k in range(self.depth, -1, -1):
            if not len(todo):
                return out
            key = windows[todo] & _U((1 << 8 * (k + 1)) - 1)
            c = self.contexts[k].find(key >> _U(8))
            known = c >= 0
            fresh = known & (t < 0)
            t[fresh], d[fresh] = self.total[k][c[fresh]], self.kinds[k][c[fresh]]
            g = self.grams[k].find(key)
            hit = known & (g >= 0)
            out[todo[hit]] += np.log10(self.n[k][g[hit]] / (t[hit] + d[hit]))
            miss = known & ~hit & (t > 0)
            out[todo[miss]] += np.log10(d[miss] / (t[miss] + d[miss]))
            t[known], d[known] = self.rest[k][c[known]], self.rest_kinds[k][c[known]]
            todo, t, d = todo[~hit], t[~hit], d[~hit]
        left = 256 - (self.kinds[0][0] if len(self.kinds[0]) else 0)
        out[todo] -= np.log10(max(left, 1))
        return out


def byte_windows(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The window that ends at each byte of each text and at its end; offsets by row."""
    rows = len(at) - 1
    gap = depth + 1
    stream = np.full(len(data) + gap * rows, START, np.uint8)
    length = np.diff(at)
    row = np.repeat(np.arange(rows), length)
    stream[np.arange(len(data)) + gap * row + depth] = _LOWER[data]
    ends = at[1:] + gap * np.arange(rows) + depth
    stream[ends] = END
    key = np.zeros(len(stream), np.uint64)
    for j in range(depth + 1):
        key[j:] |= stream[: len(stream) - j].astype(np.uint64) << _U(8 * j)
    real = np.ones(len(stream), bool)
    real[(np.arange(rows) * gap + at[:-1])[:, None] + np.arange(depth)] = False
    return key[real], at + np.arange(rows + 1)


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each row followed by its end token; offsets by row."""
    words = Words(data, at, SPACE_WORD)
    rows = len(at) - 1
    first = words.first + np.arange(rows + 1)
    out = np.full(len(words.start) + rows, _END_TOKEN, np.uint64)
    out[np.arange(len(words.start)) + words.row] = words.hashes()
    return out, first


def _counter(depth: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in slices(batch, "text", _COUNT_BYTES):
                for kind, keys in ((0, _tokens(data, at)[0]), (1, byte_windows(data, at, depth)[0])):
                    keys.sort()
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    key, n = keys[first], np.diff(np.append(first, len(keys)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    return count


def corpus_counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): how often each word (0) and each byte window (1) occurs in all texts."""
    return cut(texts.select("text").mapInArrow(_counter(depth), "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _shared(depth: int) -> int:
    """How many bytes of a context say which part it is in."""
    return min(3, depth)


def _part_of(kind: int, keys: np.ndarray, depth: int, parts: tuple[int, int]) -> np.ndarray:
    """The part that holds a word (kind 0) or a byte window (1); parts: how many of each."""
    if kind == 0:
        return ((keys >> _U(40)) * _U(parts[0])) >> _U(24)
    context = (keys >> _U(8)) & _U((1 << 8 * _shared(depth)) - 1)
    return _U(parts[0]) + (((context * _U(10368889)) & _U(0xFFFFFF)) * _U(parts[1]) >> _U(24))


def _part_column(depth: int, parts: tuple[int, int]) -> Column:
    """``_part_of`` for the rows of the counts."""
    word = F.shiftrightunsigned(F.shiftrightunsigned("key", 40) * parts[0], 24)
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * _shared(depth)) - 1))
    window = parts[0] + F.shiftrightunsigned((context * 10368889).bitwiseAND(F.lit(0xFFFFFF)) * parts[1], 24)
    return F.when(F.col("kind") == 0, word).otherwise(window)


def _distinct(arrays: list[np.ndarray]) -> np.ndarray:
    """The different values of sorted arrays, sorted."""
    x = np.concatenate([np.zeros(0, np.uint64), *arrays])
    x.sort(kind="stable")
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _pack(x: np.ndarray) -> bytes:
    """Numbers of eight or four bytes, compressed byte by byte; sorted keys as differences."""
    if x.dtype == np.uint64:
        x = np.diff(x, prepend=_U(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: pa.Buffer, dtype) -> np.ndarray:
    n, width = int.from_bytes(raw[:8].to_pybytes(), "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, codec="zstd"), np.uint8).reshape(width, n)
    x = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(x, dtype=np.uint64) if dtype == np.uint64 else x


def _unpacked(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.zeros(0, dtype), *[_unpack(x.as_buffer(), dtype) for x in column]]


def _asker(depth: int, parts: tuple[int, int], copies: int):
    def ask(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        group = key[0].as_py()
        seen: tuple[list, list] = [], []
        for batch in texts.to_batches():
            for _, data, at in slices(batch, "text"):
                for found, keys in zip(seen, (_tokens(data, at)[0], byte_windows(data, at, depth)[0]), strict=True):
                    keys.sort()
                    found.append(_distinct([keys]))
        part_of, packed = [], []
        for kind, found in enumerate(seen):
            keys = _distinct(found)
            part = _part_of(kind, keys, depth, parts)
            order = np.argsort(part, kind="stable")
            names, first = np.unique(part[order], return_index=True)
            part_of.extend(names.tolist())
            packed.extend(map(_pack, np.split(keys[order], first[1:])))
        n = len(part_of)
        return pa.table({"part": pa.array(part_of, pa.int64()), "copy": pa.array([group % copies] * n, pa.int64()), "group": pa.array([group] * n, pa.int64()), "keys": pa.array(packed, pa.binary())})

    return ask


def _answerer(depth: int, parts: tuple[int, int], low: tuple[np.ndarray, np.ndarray]):
    def answer(key: tuple[pa.Scalar, ...], model: pa.Table, asked: pa.Table) -> pa.Table:
        words = key[0].as_py() < parts[0]
        known, n = model.column("key").to_numpy().view(np.uint64), model.column("n").to_numpy()
        order = np.argsort(known)
        known, n = known[order], n[order]
        asked_keys = _unpacked(asked.column("keys"), np.uint64)
        keys = np.concatenate(asked_keys)
        if words:
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            values = np.log10(np.where(known[at] == keys, n[at], 0) + 1.0) if len(known) else np.zeros(len(keys))
        else:
            values = PPM(known, n, depth, low).log10(keys).astype(np.float32)
        ends = np.cumsum([len(x) for x in asked_keys])
        answers = [_pack(x) for x in np.split(values, ends[:-1])[1:]]
        return pa.table({"group": asked.column("group"), "words": pa.array([words] * len(answers), pa.bool_()), "keys": asked.column("keys"), "values": pa.array(answers, pa.binary())})

    return answer


def _scorer(depth: int):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for words, dtype in ((True, np.float64), (False, np.float32)):
            own = answers.filter(pa.compute.equal(answers.column("words"), words))
            index = Index(np.concatenate(_unpacked(own.column("keys"), np.uint64)))
            tables.append((index, np.concatenate(_unpacked(own.column("values"), dtype))[index.order]))
        (word_index, word_values), (window_index, window_values) = tables
        out = []
        for batch in texts.to_batches():
            for rows, data, at in slices(batch, "text"):
                window, first = byte_windows(data, at, depth)
                token, start = _tokens(data, at)
                logs = word_values[word_index.find(token)]
                out.append(
                    pa.table(
                        {
                            "id": rows.column("id"),
                            "n_tokens": pa.array(np.diff(start)),
                            "n_known": pa.array(np.add.reduceat((logs > 0).astype(np.int64), start[:-1])),
                            "log": pa.array(np.add.reduceat(logs, start[:-1])),
                            "score": pa.array(np.add.reduceat(window_values[window_index.find(window)].astype(np.float64), first[:-1])),
                        }
                    )
                )
        if not out:
            return pa.table({"id": texts.column("id"), **{c: pa.array([], t) for c, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log", pa.float64()), ("score", pa.float64()))}})
        return pa.concat_tables(out)

    return score


def held_out(id: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def score_documents(docs: DataFrame, train: DataFrame, id: str = "doc_id", text: str = "text", depth: int = DEPTH, part_rows: int = PART_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row of ``docs``: tokens, known tokens, unigram score and the byte model's score (both log10), learnt from ``train``."""
    counts = corpus_counts(for_python(train).select(F.col(f"`{text}`").alias("text")), depth)
    found = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    total, kinds = (found[0]["n"], found[0]["rows"]) if 0 in found else (0, 0)
    parts = tuple(max(1, -(-(found[k]["rows"] if k in found else 0) // part_rows)) for k in (0, 1))
    ends = counts.filter("kind = 1").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * _shared(depth)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low = ends.column("key").to_numpy().view(np.uint64), ends.column("n").to_numpy()

    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`")) + 1), F.lit(0))).first()[0]
    groups = max(LEAST_GROUPS, -(-size // group_bytes))
    copies = max(1, -(-size // (16 * ASKED_ROWS * sum(parts))))
    raw = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    texts = raw.select(F.pmod(F.xxhash64("id", "text"), F.lit(groups)).alias("group"), "id", "text")
    asked = texts.groupBy("group").applyInArrow(_asker(depth, parts, copies), "part long, copy long, group long, keys binary")
    model = counts.select(_part_column(depth, parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), "key", "n")
    answers = model.groupBy("part", "copy").cogroup(asked.groupBy("part", "copy")).applyInArrow(_answerer(depth, parts, low), "group long, words boolean, keys binary, values binary")
    kind = raw.schema["id"].dataType.simpleString()
    out = texts.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(_scorer(depth), f"id {kind}, n_tokens long, n_known long, log double, score double")
    base = F.col("log") - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))
    return out.select(F.col("id").alias(id), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
