"""Phrase collocations: frequent phrases by hierarchical pair naming, scored by their weakest cut.

1. Texts become chunks: the words of one language in one Arrow batch, as codes of
   the chunk's own vocabulary, with a mark where a piece ends.
2. Words are counted over all chunks; frequent ones get an id.  A phrase of k
   words is the pair of the ids of its first and its last k - 1 words: both are
   frequent if it is.  In every chunk adjacent ids are replaced by the id of their
   pair, level by level; infrequent places become marks and runs of marks one.
3. Up to ``NAMES`` frequent words or pairs are sent to all executors with their
   ids.  Beyond that chunks ask for ids: each different pair of a chunk is one
   request, which is joined with the frequent pairs.  A table of hash slots of
   frequent pairs (``SLOTS`` rows at most, broadcast) drops most others first.
4. The ids of a pair are its parents.  Counts of all first and last parts come
   down these pointers, so every cut is there without looking at texts again; a
   phrase stands in a longer one with as many places exactly if it is a parent of
   such a phrase one word longer.

A chunk is at most a batch (``BATCH_BYTES`` of text, or one text); no step gathers
the places of a phrase.

Defined cases: null texts are empty and null languages ``und``; repeated rows
count as often as they stand there; ties of scores are ordered by places and
phrase; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratlas.llm.textops import _LOWER, cut, for_python, strings

#: So many names of one level are sent to all executors (24 bytes each, words their length more).
NAMES = 1_000_000
#: Hash slots that tell frequent pairs from most others.
SLOTS = 1 << 20
#: Parts of a language that find their own first phrases before all are ranked.
PARTS = 256
#: So many languages' totals are sent to all executors; more are joined by shuffle.
BROADCAST_LANGS = 100_000

STATE = "chunk long, seq binary, ids binary"
_END, _SPACE = 2, 1
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END


def _packed(a: np.ndarray) -> bytes:
    """Codes from -1 up in as few bytes as they take, compressed."""
    small = (a + 1).astype(np.uint16 if len(a) == 0 or a.max() < 0xFFFF else np.uint32)
    raw = small.tobytes()
    return bytes([small.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    data = pa.decompress(raw[9:], int.from_bytes(raw[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(data, np.uint16 if raw[0] == 2 else np.uint32).astype(np.int64) - 1


def _collapsed(seq: np.ndarray) -> np.ndarray:
    """Runs of marks as one."""
    keep = seq >= 0
    keep[1:] |= seq[:-1] >= 0
    return seq[keep] if len(seq) else seq


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of texts as codes (-1 where a piece ends), the words by code, and how often each stands there."""
    data, at = strings(texts)
    data = _LOWER[data]
    inside = _KIND[data] == 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    opens[firsts] = inside[firsts]
    start = np.flatnonzero(opens)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    ends = np.zeros(len(data) + 1, bool)
    ends[:-1] = _KIND[data] == _END
    ends[at[1:]] = True  # the end of a row stands before the next one's first byte
    ends[at[0]] = False
    piece = np.cumsum(ends)[start]
    offsets = np.append(np.cumsum(inside)[start] - 1, inside.sum()).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    words = words.dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.append(False, piece[1:] != piece[:-1])
    seq = np.full(len(code) + int(new.sum()), -1)
    seq[np.arange(len(code)) + np.cumsum(new)] = code
    return seq, words.dictionary, np.bincount(code, minlength=len(words.dictionary))


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        which = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            seq, words, count = coded(batch.column("text").take(pa.array(np.flatnonzero(which == k))))
            raw = "\n".join(words.to_pylist()).encode()  # no word has the end of a line
            blob = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([(part << 32) + n]), "lang": [lang], "seq": pa.array([_packed(seq)], pa.binary()), "words": pa.array([blob], pa.binary()), "counts": pa.array([_packed(count)], pa.binary())})
            n += 1


def _words(blob: bytes) -> pa.Array:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True).decode()
    return pa.array(raw.split("\n") if raw else [], pa.string())


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, code, lang, word, n) of every different word of a chunk."""
    for batch in batches:
        for chunk, lang, blob, counts in zip(*[batch.column(c).to_pylist() for c in ("chunk", "lang", "words", "counts")], strict=True):
            n = _unpacked(counts)
            yield pa.RecordBatch.from_pydict({"chunk": np.full(len(n), chunk), "code": np.arange(len(n)), "lang": pa.array([lang] * len(n), pa.string()), "word": _words(blob), "n": n})


def _paired(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the pairs of adjacent ids (-1 where one is none), and of each pair its ids and places."""
    different, code = np.unique(ids[seq], return_inverse=True)
    none = int(len(different) > 0 and different[0] < 0)  # at most one value stands for none
    a, b = code[:-1], code[1:]
    good = (a >= none) & (b >= none)
    pairs, name, n = np.unique(a[good] * len(different) + b[good], return_inverse=True, return_counts=True)
    out = np.full(len(good), -1)
    out[good] = name
    return out, different[pairs // max(1, len(different))], different[pairs % max(1, len(different))], n


def _state(seq: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(seq), np.append(np.frombuffer(ids, np.int64), -1)  # code -1 is the last: none


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, code, first, last, n) of every different pair of a chunk."""
    for batch in batches:
        for chunk, seq, ids in zip(*[batch.column(c).to_pylist() for c in ("chunk", "seq", "ids")], strict=True):
            _, first, last, n = _paired(*_state(seq, ids))
            yield pa.RecordBatch.from_pydict({"chunk": np.full(len(n), chunk), "code": np.arange(len(n)), "first": first, "last": last, "n": n})


def _renamed(chunk: int, code: np.ndarray, found: np.ndarray, id: np.ndarray) -> pa.RecordBatch:
    """A chunk's codes (of its words, or of its pairs) as those of the codes found, with their ids; the others are marks."""
    new = np.full(int(code.max(initial=-1)) + 2, -1)
    new[found] = np.arange(len(found))
    return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk]), "seq": pa.array([_packed(_collapsed(new[code]))], pa.binary()), "ids": pa.array([id.tobytes()], pa.binary())})


def _renamer(paired: bool):
    """Chunks with the names that they asked for."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, seq, ids, names in zip(batch.column("chunk").to_pylist(), batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), batch.column("names"), strict=True):
                code = _paired(*_state(seq, ids))[0] if paired else _unpacked(seq)
                yield _renamed(chunk, code, *(names.values.field(c).to_numpy() for c in ("code", "id")))

    return rename


def _word_namer(words: dict[str, tuple[pa.Array, np.ndarray]]):
    """Chunks with the ids of frequent words, by language."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, seq, blob in zip(*[batch.column(c).to_pylist() for c in ("chunk", "lang", "seq", "words")], strict=True):
                if lang in words:
                    at = pc.index_in(_words(blob), words[lang][0]).fill_null(-1).to_numpy(zero_copy_only=False)
                    found = np.flatnonzero(at >= 0)
                    yield _renamed(chunk, _unpacked(seq), found, words[lang][1][at[found]])

    return rename


def _pair_namer(below: np.ndarray, first: np.ndarray, last: np.ndarray, id: np.ndarray):
    """Chunks with the ids of frequent pairs of the sorted ids ``below``."""
    key = np.searchsorted(below, first) * len(below) + np.searchsorted(below, last)
    order = np.argsort(key)
    key, id = key[order], id[order]

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, seq, ids in zip(*[batch.column(c).to_pylist() for c in ("chunk", "seq", "ids")], strict=True):
                code, a, b, _ = _paired(*_state(seq, ids))
                own = np.searchsorted(below, a) * len(below) + np.searchsorted(below, b)
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                found = np.flatnonzero(key[at] == own)
                if len(found):
                    yield _renamed(chunk, code, found, id[at[found]])

    return rename


def _named(chunks: DataFrame, requests: DataFrame, paired: bool) -> DataFrame:
    """(chunk, seq, ids) of the next level; chunks without a frequent phrase go."""
    names = requests.groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("names"))
    ids = F.col("ids") if paired else F.lit(None).cast("binary").alias("ids")
    return cut(chunks.select("chunk", "seq", ids).join(names, "chunk").mapInArrow(_renamer(paired), STATE))


def _word_table(words: DataFrame) -> dict[str, tuple[pa.Array, np.ndarray]]:
    t = words.select("lang", "phrase", "id").toArrow()
    lang = t.column("lang").combine_chunks().dictionary_encode()
    which = lang.indices.to_numpy(zero_copy_only=False)
    rows = [(name, t.filter(pa.array(which == k))) for k, name in enumerate(lang.dictionary.to_pylist())]
    return {name: (x.column("phrase").combine_chunks().cast(pa.string()), x.column("id").to_numpy()) for name, x in rows}


def _numbered(names: DataFrame, few: bool, *by: str) -> tuple[DataFrame, bool]:
    """``names`` with an id, and whether they (and those below) are few: then ids count from 1, which makes small shuffles, else they only differ."""
    names = cut(names)
    few = few and names.limit(NAMES + 1).count() <= NAMES
    id = F.row_number().over(Window.orderBy(*by)).cast("long") if few else F.monotonically_increasing_id()
    return cut(names.withColumn("id", id)), few


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length from 1, and the number of words n of each language.

    Rows are (id, lang, phrase, f, firsts, lasts); firsts and lasts hold the places
    of the phrase's first and last 1, 2, ... words; from two words on, first and
    last are the ids of the parents.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    chunks = cut(for_python(rows).mapInArrow(_chunker, "chunk long, lang string, seq binary, words binary, counts binary"))
    vocabulary = chunks.mapInArrow(_vocabulary, "chunk long, code long, lang string, word string, n long")
    counts = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    totals = cut(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    none = F.array().cast("array<long>")
    words, few = _numbered(counts.filter(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f"), True, "lang", "phrase")
    grams = [words.select("id", "lang", "phrase", "f", none.alias("firsts"), none.alias("lasts"))]
    if few:
        chunks = cut(chunks.mapInArrow(_word_namer(_word_table(grams[0])), STATE))
    else:
        asked = vocabulary.select("chunk", "code", "lang", F.col("word").alias("phrase")).join(grams[0].select("lang", "phrase", "id"), ["lang", "phrase"])
        chunks = _named(chunks, asked, False)
    for _ in range(longest - 1):
        pairs = chunks.mapInArrow(_pairs, "chunk long, code long, first long, last long, n long")
        often = pairs.groupBy("first", "last").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        often, few = _numbered(often, few, "first", "last")
        below = grams[-1]
        first = below.select(F.col("id").alias("first"), "lang", "phrase", F.concat("firsts", F.array("f")).alias("firsts"))
        last = below.select(F.col("id").alias("last"), F.substring_index("phrase", " ", -1).alias("word"), F.concat("lasts", F.array("f")).alias("lasts"))
        named = often.join(first, "first").join(last, "last")
        grams.append(cut(named.select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "f", "firsts", "lasts", "first", "last")))
        if len(grams) == longest or often.isEmpty():
            break
        if few:
            ids = np.sort(below.select("id").toArrow().column("id").to_numpy())
            t = often.select("first", "last", "id").toArrow()
            chunks = cut(chunks.mapInArrow(_pair_namer(ids, *[t.column(c).to_numpy() for c in ("first", "last", "id")]), STATE))
            continue
        slot = F.pmod(F.xxhash64("first", "last"), F.lit(SLOTS)).alias("slot")
        slots = F.broadcast(cut(often.select(slot).distinct()))
        asked = pairs.select("chunk", "code", "first", "last", slot).join(slots, "slot", "left_semi").join(often.select("first", "last", "id"), ["first", "last"])
        chunks = _named(chunks, asked, True)
    return grams, totals


def collocations(docs: DataFrame, top: int = 2000, longest: int = 5, least: int = 100, percent: int = 100, **columns: str) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by the score of their weakest cut.

    Phrases inside a longer frequent one that has ``percent`` of their places are left out.
    """
    grams, totals = frequent_phrases(docs, longest, least, **columns)
    few = totals.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    totals = F.broadcast(totals) if few else totals
    found = []
    for k, g in enumerate(grams[1:], 2):
        x = g.join(totals, "lang")
        cuts = [(F.get("firsts", F.lit(j - 1)), F.get("lasts", F.lit(k - j - 1))) for j in range(1, k)]
        x = x.withColumns({f"l{j}": l for j, (l, _) in enumerate(cuts, 1)} | {f"r{j}": r for j, (_, r) in enumerate(cuts, 1)})
        x = x.withColumns({f"s{j}": F.expr(f"(1000 * cast(f as decimal(38,0)) * n) div (cast(l{j} as decimal(38,0)) * r{j})") for j in range(1, k)})
        weakest = F.array_min(F.array(*[F.struct(F.col(f"s{j}").alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in range(1, k)]))
        x = x.select("id", "lang", "phrase", F.col("f").alias("a"), "n", weakest.alias("w"))
        if k < len(grams):
            longer = grams[k].select(F.col("first").alias("id"), "f").union(grams[k].select("last", "f")).groupBy("id").agg(F.max("f").alias("most"))
            x = x.join(longer, "id", "left").filter(F.coalesce(100 * F.col("most") < percent * F.col("a"), F.lit(True)))
        found.append(x.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").cast("long").alias("score")))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
