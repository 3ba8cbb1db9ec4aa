"""License scan: ordered signature rules behind a keyword gate, overlaps resolved by priority.

The words of a slice of texts are hashed at once; texts without any gate word are
done.  On the others only rules whose gate word is there run, on the words joined
by spaces.  Detections are taken by priority, then length, then rule order, and
one that lies within a taken one is suppressed; a tree of running maxima over
first words answers that in logarithmic time.  The base phrases are counted
apart, wherever they stand.

A word here is a run of ASCII letters, digits and any character over U+007F, so a
phrase ends where its last word ends, also beside letters outside ASCII.

Defined cases: a null or empty text has no words and no detections; repeated rows
are scanned one by one; an empty table gives an empty result; other columns are
carried if asked for and never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratlas.llm.license_rules import Signature, signatures
from stratlas.llm.textops import ALNUM_WORD, Words, for_python, fresh, slices

_SPAN = pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("priority", pa.int32())])
_ARROW = pa.struct([("n_words", pa.int64()), ("base", pa.list_(_SPAN)), ("found", pa.list_(_SPAN))])
_RESULT = "struct<n_words:bigint,base:array<struct<label:string,first:int,last:int,priority:int>>,found:array<struct<label:string,first:int,last:int,priority:int>>>"


def _hash_words(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM_WORD).hashes()


class Furthest:
    """The furthest last word of all spans added so far that begin at or before a word (a binary indexed tree)."""

    def __init__(self, firsts: set[int]):
        self.firsts = sorted(firsts)
        self.most = [-1] * (len(self.firsts) + 1)

    def add(self, first: int, last: int) -> None:
        i = bisect_right(self.firsts, first)
        while i < len(self.most):
            self.most[i] = max(self.most[i], last)
            i += i & -i

    def until(self, first: int) -> int:
        i, most = bisect_right(self.firsts, first), -1
        while i:
            most = max(most, self.most[i])
            i -= i & -i
        return most


def suppress(found: list[tuple[tuple[int, int, int, int], tuple]]) -> list[tuple]:
    """Of (rank, span) the spans that lie within no span of a lower rank, in text order; spans are (label, first, last, priority)."""
    taken, reach = [], Furthest({span[1] for _, span in found})
    for _, span in sorted(found, key=lambda x: x[0]):
        if reach.until(span[1]) < span[2]:
            taken.append(span)
            reach.add(span[1], span[2])
    return sorted(taken, key=lambda s: (s[1], s[2], s[0]))


def detect(text: str, starts: list[int], gates: set[str], by_gate: dict[str, list[tuple[int, Signature]]]) -> tuple[list, list]:
    """Base places and unsuppressed detections of one normalised text; starts: where each word begins."""
    base, found = [], []
    for order, rule in sorted((x for g in gates for x in by_gate[g]), key=lambda x: x[0]):
        at = 0
        while m := rule.pattern.search(text, at):
            at = m.start() + 1
            first = bisect_right(starts, m.start()) - 1
            last = bisect_right(starts, m.end() - 1) - 1
            # An expression's word boundary may fall inside a word with letters outside ASCII.
            end = starts[last + 1] - 1 if last + 1 < len(starts) else len(text)
            if starts[first] != m.start() or end != m.end():
                continue
            version = next((g for g in m.groups() if g), "") if m.re.groups else ""
            version = re.sub("(?<=[a-z]) ", "-", version).replace(" ", ".")
            label = rule.label.replace("-{v}", f"-{version}" if version else "")
            span = (label, first, last, rule.priority)
            if rule.base:
                base.append(span)
            else:
                found.append(((-rule.priority, first - last, order, first), span))
    return base, suppress(found)


def _scanner(text: str, keep: list[str], result: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = signatures()
        gates = sorted({r.gate for r in rules})
        by_gate = {g: [(i, r) for i, r in enumerate(rules) if r.gate == g] for g in gates}
        hashes = _hash_words(gates)
        order = np.argsort(hashes)
        for batch in batches:
            for part, data, at in slices(batch, text):
                words = Words(data, at, ALNUM_WORD)
                h = words.hashes()
                slot = np.minimum(np.searchsorted(hashes[order], h), len(order) - 1)
                held = np.flatnonzero(hashes[order][slot] == h)
                out: list[tuple] = [(n, (), ()) for n in words.count.tolist()]
                there: dict[int, set[str]] = {}
                for r, g in zip(words.row[held].tolist(), order[slot[held]].tolist(), strict=True):
                    there.setdefault(r, set()).add(gates[g])
                for r, names in there.items():
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    tokens = [words.data[s:e].tobytes().decode() for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
                    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])[:-1]]).astype(int).tolist()
                    out[r] = (b - a, *detect(" ".join(tokens), starts, names, by_gate))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out, _ARROW)], [*keep, result])

    return scan


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, str]:
    """The columns ``keep`` of each document and a struct (name returned): n_words, base places, detections."""
    keep = list(dict.fromkeys(keep))
    (result,) = fresh(docs.columns, "licenses")
    (body,) = fresh([*docs.columns, result], "license_text")
    rows = for_python(docs).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(body))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(result, T._parse_datatype_string(_RESULT))])
    return rows.mapInArrow(_scanner(body, keep, result), schema), result
