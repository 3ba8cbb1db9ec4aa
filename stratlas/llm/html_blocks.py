"""Web pages as sequences of leaf blocks: tag path, text, and their feature vectors.

A block's tag path is kept as the vector of its hashed names, which is carried
along as elements open and close, so neither time nor memory follows the depth.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

PATH_DIMS, WORD_DIMS, NUMBERS = 96, 96, 10
DIMS = PATH_DIMS + WORD_DIMS + NUMBERS

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"[\s ]+")
_NAME = re.compile(r"[a-z]+")
#: Elements whose content is never text of the page: up to the first end tag, or up to their own one.
_CODE = frozenset(("script", "style", "textarea", "title", "xmp"))
_RAW = frozenset(("iframe", "noembed", "noframes", "template", "svg", "math", "object", "canvas", "select", "datalist", "noscript"))
_CODE_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _CODE}
_DRAWN = frozenset(("svg", "math"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NO_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
_SCOPE = frozenset("table td th ul ol dl div article section main aside body html nav form header footer".split())


@dataclass
class Block:
    #: How many open elements have a name in each bucket.
    path: bytes
    depth: int
    text: str
    linked: int


class Stack:
    """The open elements of a page, with the places of each tag among them and the vector of their names."""

    def __init__(self) -> None:
        self.open: list[tuple[str, tuple[int, ...]]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []
        self.count = [0] * PATH_DIMS
        self._path: bytes | None = None

    def push(self, tag: str, slots: tuple[int, ...]) -> None:
        self.at[tag].append(len(self.open))
        if tag in _SCOPE:
            self.scopes.append(len(self.open))
        self.open.append((tag, slots))
        for i in slots:
            self.count[i] += 1
        self._path = None

    def close(self, tag: str) -> None:
        """End the innermost element of a tag and all that are open in it."""
        while self.open:
            t, slots = self.open.pop()
            self.at[t].pop()
            if t in _SCOPE:
                self.scopes.pop()
            for i in slots:
                self.count[i] -= 1
            if t == tag:
                break
        self._path = None

    def has(self, tag: str) -> bool:
        return bool(self.at[tag])

    def in_scope(self, tag: str) -> bool:
        """An element of the tag is open inside the innermost element that bounds implied ends, or is that element."""
        return bool(self.at[tag]) and self.at[tag][-1] >= (self.scopes[-1] if self.scopes else 0)

    def path(self) -> bytes:
        if self._path is None:
            self._path = bytes(c > 0 for c in self.count)
        return self._path


def _named(m: re.Match) -> tuple[str, bool, bool]:
    """A tag's name, whether it is an end tag and whether it closes itself."""
    return (m.group(2) or m.group(5) or "").lower(), (m.group(1) or m.group(4)) == "/", (m.group(3) or m.group(6) or "").endswith("/")


def _code_end(page: str, tag: str, at: int, endless: set[str]) -> int:
    """Where to read on behind the start tag of code; without an end tag, only a script takes the rest of the page."""
    e = None if tag in endless else _CODE_END[tag].search(page, at)
    if e:
        return e.end()
    endless.add(tag)
    if tag == "script":
        return len(page)
    return max(page.find("<", at), at) if tag == "style" else at


def _raw_ends(page: str) -> dict[int, int]:
    """Of each raw element that has an end tag of its own, the start tag's place and the content's end."""
    opened: dict[str, list[int]] = {t: [] for t in _RAW}
    ends: dict[int, int] = {}
    endless: set[str] = set()
    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        tag, end, closed = _named(m)
        if tag in _CODE and not end and not (closed and (opened["svg"] or opened["math"])):
            at = _code_end(page, tag, at, endless)
        elif tag in _RAW and end:
            if opened[tag]:
                ends[opened[tag].pop()] = at
        elif tag in _RAW and not (closed and tag in _DRAWN):
            opened[tag].append(m.start())
    return ends


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with character references decoded and white space squeezed."""
    out: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    linked = 0
    page = page or ""
    raw_ends: dict[int, int] | None = None
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(stack.path(), len(stack.open), text, linked))
            parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not stack.has("option"):
            parts.append(text)
            linked += len(text) if stack.has("a") else 0
        if not m:
            break
        at = m.end()
        tag, ends, closed = _named(m)
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if ends:
            if stack.has(tag):
                stack.close(tag)
            continue
        if tag in _CODE:
            at = _code_end(page, tag, at, endless)
            continue
        if tag in _RAW:
            if not (closed and tag in _DRAWN):
                raw_ends = _raw_ends(page) if raw_ends is None else raw_ends
                at = raw_ends.get(m.start(), at)
            continue
        if tag in _VOID:
            continue
        for other in ("option", "p") if tag in _NO_P else _CLOSES.get(tag, ()):
            if stack.in_scope(other):
                stack.close(other)
        stack.push(tag, _slots(tag, m.group(3) or m.group(6) or ""))
    flush()
    return out


_words: dict[str, int] = {}
_known: dict[tuple[str, str], tuple[int, ...]] = {}


def _bucket(word: str, dims: int) -> int:
    return zlib.crc32(word.encode()) % dims


def _slots(tag: str, attributes: str) -> tuple[int, ...]:
    """The buckets of an element's tag and of the words of its class, id and role."""
    got = _known.get((tag, attributes))
    if got is None:
        names = {tag}
        for a in _ATTRIBUTE.finditer(attributes):
            names.update(_NAME.findall((a.group(2) or a.group(3) or a.group(4) or "").lower()))
        got = tuple(_bucket("/" + n, PATH_DIMS) for n in names)
        if len(_known) > 50_000:
            _known.clear()
        if len(attributes) < 200:
            _known[tag, attributes] = got
    return got


def features(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all pages: hashed tag path, hashed words, and a few numbers."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), DIMS), np.float32)
    rows: list[int] = []
    slots: list[int] = []
    count = np.zeros(len(flat), np.float32)
    if len(_words) > 500_000:
        _words.clear()
    for i, b in enumerate(flat):
        x[i, :PATH_DIMS] = np.frombuffer(b.path, np.uint8)
        words = b.text.lower().split(" ")
        count[i] = len(words)
        for w in words:
            s = _words.get(w)
            if s is None:
                s = _words[w] = _bucket(w.strip(".,;:!?()\"'"), WORD_DIMS)
            slots.append(s)
        rows.append(len(words))
    if flat:
        at = np.repeat(np.arange(len(flat)), rows) * WORD_DIMS + np.array(slots)
        bag = np.bincount(at, minlength=len(flat) * WORD_DIMS).reshape(len(flat), WORD_DIMS)
        x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.minimum(bag, 2) * 0.25
        k = PATH_DIMS + WORD_DIMS
        chars = np.array([len(b.text) for b in flat], np.float32)
        x[:, k] = np.log1p(count) / 4
        x[:, k + 1] = np.minimum(np.array([b.linked for b in flat]) / chars, 1)
        x[:, k + 2] = np.array([b.text[-1] in ".!?…" for b in flat])
        x[:, k + 3] = np.minimum(np.array([b.depth for b in flat]), 64) / 16
        x[:, k + 4] = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages])
        x[:, k + 5] = count < 4
        x[:, k + 6] = np.array(["©" in b.text for b in flat])
        x[:, k + 7] = np.array([b.text.count(",") + b.text.count(".") for b in flat]) / (count + 1)
        x[:, k + 8] = np.array([b.text[:1].isupper() for b in flat])
        x[:, k + 9] = 1
    return x
