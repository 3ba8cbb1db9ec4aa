"""Main text of web pages: a recurrent labeller over the leaf blocks of a page.

Each block is a vector of its tag path (element names, classes, ids), its hashed
words and a few numbers.  A bidirectional LSTM in numpy reads the page's sequence
both ways, so a block is judged by all that stands before and after it, and the
blocks labelled as main text are joined in order.

The labeller is fitted when it is first used, on ``TRAIN_PAGES`` pages written by
a generator with varied layouts and known labels; nothing of the corpus is
sampled.  A part of the pages has telling element and class names, the others have
grid classes, made-up ones or none, so that words, links and neighbours have to
tell.  Its weights (some 100 kB) travel with the tasks.

Defined cases: a null or empty page has no blocks and its text is empty; broken
and cut-off mark-up is read as far as it goes, in linear time however many
elements stay open; pages with any number of blocks are read whole; repeated rows
are read one by one; other columns are carried if asked for and never read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratlas.llm.html_blocks import DIMS, Block, blocks, features
from stratlas.llm.textops import for_python, fresh

HIDDEN = 20
TRAIN_PAGES = 1600
#: Blocks (rows of features) that are labelled at once.
_BATCH_BLOCKS = 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for each step."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["w" + d] = (rng.standard_normal((DIMS, 4 * h)) / np.sqrt(DIMS)).astype(np.float32)
            self.p["u" + d] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
            self.p["o" + d] = (rng.standard_normal(h) / np.sqrt(h)).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, z: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, pages, hidden) of one direction; z: the inputs' part of the gates."""
        h, u = HIDDEN, self.p["u" + d]
        state, cell = np.zeros((z.shape[1], h), np.float32), np.zeros((z.shape[1], h), np.float32)
        out = np.empty((*z.shape[:2], h), np.float32)
        for t in range(len(z)):
            g = z[t] + state @ u
            s = _sigmoid(g[:, : 3 * h])
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            c = np.tanh(g[:, 3 * h :])
            old, cell = cell, f * cell + i * c
            tc = np.tanh(cell)
            if keep is not None:
                keep.append((i, f, o, c, old, tc, state))
            state = o * tc
            out[t] = state
        return out

    @staticmethod
    def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each step of each page stands in the flat rows (one past the end for none), forwards and backwards."""
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        step = np.arange(lengths.max())[:, None]
        inside = step < lengths
        return np.where(inside, first + step, lengths.sum()), np.where(inside, first + lengths - 1 - step, lengths.sum())

    def logits(self, x: np.ndarray, lengths: np.ndarray, tape: dict | None = None) -> np.ndarray:
        total = np.full(len(x) + 1, self.p["bias"][0], np.float32)
        for d, at in zip("fb", self._layout(lengths), strict=True):
            z = np.vstack([x @ self.p["w" + d] + self.p["c" + d], np.zeros((1, 4 * HIDDEN), np.float32)])[at]
            keep = [] if tape is not None else None
            states = self._run(z, d, keep)
            total[at] += states @ self.p["o" + d]  # each row once; the padding row gathers what nobody reads
            if tape is not None:
                tape[d] = (at, keep, states)
        return total[:-1]

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        todo = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while todo:
            width = len(pages[todo[0]])
            n = 0
            while n < len(todo) and (n == 0 or (n + 1) * len(pages[todo[n]]) <= _BATCH_BLOCKS and len(pages[todo[n]]) <= 2 * width + 8):
                n += 1
            some, todo = todo[:n], todo[n:]
            got = self.logits(features([pages[i] for i in some]), np.array([len(pages[i]) for i in some])) > 0
            at = 0
            for i in some:
                out[i] = got[at : at + len(pages[i])]
                at += len(pages[i])
        return out

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        tape: dict = {}
        prob = _sigmoid(self.logits(x, lengths, tape))
        error = np.append((prob - y) / len(y), 0).astype(np.float32)
        grads = {"bias": np.array([error.sum()], np.float32)}
        h = HIDDEN
        for d in "fb":
            at, keep, states = tape[d]
            e = error[at]
            grads["o" + d] = np.einsum("tb,tbh->h", e, states)
            dz = np.zeros((*at.shape, 4 * h), np.float32)
            gu = np.zeros_like(self.p["u" + d])
            down, carry = np.zeros((at.shape[1], h), np.float32), np.zeros((at.shape[1], h), np.float32)
            for t in range(len(at) - 1, -1, -1):
                i, f, o, c, old, tc, before = keep[t]
                down = down + e[t][:, None] * self.p["o" + d]
                carry = carry + down * o * (1 - tc * tc)
                g = np.hstack([carry * c * i * (1 - i), carry * old * f * (1 - f), down * tc * o * (1 - o), carry * i * (1 - c * c)])
                dz[t] = g
                gu += before.T @ g
                down, carry = g @ self.p["u" + d].T, carry * f
            flat = np.zeros((len(x) + 1, 4 * h), np.float32)
            flat[at] = dz
            grads["u" + d], grads["w" + d], grads["c" + d] = gu, x.T @ flat[:-1], flat[:-1].sum(0)
        loss = -np.mean(np.where(y > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9)))
        return grads, float(loss)


#: Words that mark what isn't the article; the rest of a generated page is made of invented words.
_BOILER = {
    "nav": "home about contact news sports products services blog archive login register search menu help faq".split(),
    "ad": "sponsored advertisement buy now sale offer discount shop deal free trial limited click here promo".split(),
    "notice": "we use cookies accept privacy policy consent settings this site by continuing you agree".split(),
    "comment": "reply posted by comment says said ago like report thanks great agree user guest".split(),
    "footer": "copyright © all rights reserved terms privacy imprint powered by contact sitemap".split(),
    "side": "related popular posts recent tags categories trending more stories follow us newsletter".split(),
    "form": "name email message submit subscribe password send your address required field".split(),
}
_SYLLABLES = "th er on an re he in ed nd ha at en es of or ti hi as to is ar le se ou la ment que ción ung ver ich eau ó ü é".split()
#: Words that running text of four languages is full of.
_COMMON = {
    "en": "the of and to in a is that for it was on with as his they be at by this had not are but from or have an which you one we all were when there their what so up out if about who get".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son comme on ou mais cette aux leur nous".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split(),
}
#: Class names that say nothing of a block's part in the page.
_GRID = "row col col-md-8 col-md-4 col-md-12 col-sm-6 col-lg-9 col-lg-3 container container-fluid wrapper inner outer box card card-body block section d-flex mt-4 px-2 w-100 clearfix left right column span9 span3 grid cell".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))


def _prose(r: random.Random, low: int, high: int, tongue: str | None = None) -> str:
    style = r.random()
    end = r.choice(("!!", "***", "###", "%%%", "&amp;", " |")) if style < 0.15 else ""
    if tongue and r.random() < 0.9:
        words = [r.choice(_COMMON[tongue]) if r.random() < 0.45 else _word(r) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
    else:
        words = [_word(r) + end for _ in range(r.randint(low, high))] if r.random() < 0.94 else [_word(r)] * r.randint(low, high)
    text = " ".join(w.capitalize() if i == 0 or r.random() < 0.1 else w for i, w in enumerate(words))
    return (text.upper() if style > 0.95 else text) + (" &copy;" if r.random() < 0.06 else "") + ("." if r.random() < 0.8 else "")


def _boiler(r: random.Random, kind: str, low: int, high: int, mixed: float | None = None) -> str:
    mixed = r.random() if mixed is None else mixed
    return " ".join(w.capitalize() if r.random() < 0.2 else w for w in (r.choice(_BOILER[kind]) if r.random() > mixed else _word(r) for _ in range(r.randint(low, high))))


def write_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout and its main text blocks in order."""
    main: list[str] = []
    # How elements are named: tellingly, or by their tag, a grid, made-up classes or nothing.
    naming = r.choice(("telling",) * 6 + ("tag", "grid", "grid", "made up", "none", "none", "none"))
    telling = naming == "telling"
    tongue = r.choice((*_COMMON, "en", None, None)) if telling else r.choice((*_COMMON, "en", "en"))
    mixed = None if telling else 0.25
    cells = naming == "none" and r.random() < 0.5

    def named(*forms: str) -> tuple[str, str]:
        tag, _, rest = r.choice(forms).partition(" ")
        if telling:
            return f"<{tag}{' ' + rest if rest else ''}>", f"</{tag}>"
        if naming == "tag" and tag not in ("div", "ins"):
            return f"<{tag}>", f"</{tag}>"
        if tag in ("ul", "ol"):
            return f"<{tag}>", f"</{tag}>"
        tag = "td" if cells else "div" if r.random() < 0.85 else r.choice(("section", "td", "center"))
        if naming == "grid":
            some = " ".join(r.choice(_GRID) for _ in range(r.randint(1, 3)))
            return f'<{tag} class="{some}">', f"</{tag}>"
        if naming == "made up":
            return f"<{tag} class='{r.choice(('css', 'sc', 'x', 'jss'))}-{r.randrange(16**5):x} {_word(r)}'>", f"</{tag}>"
        return f"<{tag}>", f"</{tag}>"

    def nav() -> str:
        a, b = named("nav", "div class='menu'", "div id='navbar'", "ul class='nav'", "div class='top-menu navigation'", "nav class='breadcrumb'")
        items = "".join(f"<li><a href='/{_word(r)}'>{_boiler(r, 'nav', 1, 2)}</a></li>" for _ in range(r.randint(2, 9)))
        bare = items.replace("<li>", "").replace("</li>", r.choice((" ", " | ", " &raquo; ")))
        return f"{a}{'<ul>' + items + '</ul>' if r.random() < 0.7 else bare}{b}"

    def header() -> str:
        a, b = named("header", "div class='header'", "div id='masthead'", "div class='site-header'", "header class='banner'")
        return f"{a}{r.choice(('<h1>', '<p>', '<div>'))}{_boiler(r, 'nav', 1, 4, mixed)}{nav() if r.random() < 0.5 else ''}{b}"

    def ad() -> str:
        a, b = named("div class='ad'", "div class='ads'", "div class='advert'", "aside class='sponsored'", "div id='banner-ad'", "ins class='promo'", "div class='ad'", "section class='advertisement'")
        return f"{a}{_boiler(r, 'ad', 2, 9, mixed) if not telling or r.random() < 0.4 else _prose(r, 2, 14, tongue)}{b}"

    def notice() -> str:
        a, b = named("div id='cookie-notice'", "div class='consent'", "div class='gdpr notice'", "div role='alert'", "div class='cookie-banner'", "dialog class='notice'")
        return f"{a}<p>{_boiler(r, 'notice', 5, 25, mixed)}</p><button>{_word(r)}</button>{b}"

    def form() -> str:
        a, b = named(f"form class='{_word(r)}'") if telling else ("<form>", "</form>")
        return f"{a}<label>{_boiler(r, 'form', 1, 3)}</label><input><p>{_boiler(r, 'form', 2, 9)}</p><button>{_word(r)}</button>{b}"

    def side() -> str:
        a, b = named("aside", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "aside class='related'", "section class='related-posts'", "div class='share social'")
        items = "".join(f"<li><a href='#'>{_prose(r, 2, 8, tongue)}</a></li>" for _ in range(r.randint(1, 6)))
        return f"{a}<h3>{_boiler(r, 'side', 1, 3, mixed)}</h3><ul>{items}</ul>{'<p>' + _prose(r, 5, 20, tongue) + '</p>' if telling and r.random() < 0.4 else ''}{b}"

    def comments() -> str:
        a, b = named("section id='comments'", "div class='comments'", "div id='disqus-thread'", "section class='comment-list'", "ol class='commentlist'")

        def one() -> str:
            c, d = named("div class='comment'", "div class='reply'", "div class='comment-body'")
            return f"{c}<b>{_word(r)}</b> {_boiler(r, 'comment', 1, 3, mixed)}<p>{_prose(r, 4, 40, tongue) if telling else _boiler(r, 'comment', 2, 9, 0.4)}</p>{d}"

        return f"{a}<h3>{_boiler(r, 'comment', 1, 3, mixed)}</h3>{''.join(one() for _ in range(r.randint(1, 6)))}{b}"

    def footer() -> str:
        a, b = named("footer", "div class='footer'", "div id='footer'", "footer class='site-footer'", "div class='bottom-bar'")
        return f"{a}&copy; {_word(r)}.example.com &middot; {_boiler(r, 'footer', 1, 8, mixed) if not telling or r.random() < 0.5 else _prose(r, 3, 14, tongue)}{b}"

    def say(text: str) -> str:
        main.append(text)
        return text

    def article() -> str:
        a, b = named("article", "article", "article", "main", "div class='content'", "div id='content'", "div class='post entry-content'", "div class='article-body'", "section class='story'", "div class='main'")
        out = [a]
        if r.random() < 0.85:
            title = _prose(r, 1, 10, tongue) if r.random() < 0.6 else _prose(r, 8, 30, tongue)[: r.randint(30, 80)].strip(" &").partition("&")[0] or "x"
            out.append(f"<h1>{say(title)}</h1>")
        # Some articles say the same few lines over and over.
        pool = [_prose(r, 1, 8, tongue) for _ in range(r.randint(1, 3))] if telling and r.random() < 0.2 else []
        low = 1 if telling else 6
        for k in range(r.choice((1, 1, 2, 3, 5, 8, 14, 40)) if not pool else r.randint(4, 130)):
            kind = 0 if pool else r.random()
            if kind < 0.72:
                start = r.choice(("<p>", "<p><b>", "<p>", "<p><em>", "<div>"))
                stop = "</div>" if start == "<div>" else "" if "<b>" in start or r.random() < 0.2 else "</p>"
                text = r.choice(pool) if pool and r.random() < 0.95 else _prose(r, low, 80, tongue)
                if not pool and r.random() < 0.1:
                    words = text.split(" ")
                    i = r.randrange(len(words))
                    main.append(text)
                    text = " ".join([*words[:i], f"<a href='/x'>{words[i]}</a>", *words[i + 1 :]])
                else:
                    say(text)
                out.append(f"{start}{text}{stop}")
            elif kind < 0.78:
                out.append(f"<h2>{say(_prose(r, 1, 6, tongue))}</h2>")
            elif kind < 0.83:
                out.append("<ul>" + "".join(f"<li>{say(_prose(r, low, 14, tongue))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{say(_prose(r, 4, 30, tongue))}</blockquote>")
            elif kind < 0.89:
                out.append("<table><tr>" + "".join(f"<td>{say(_prose(r, 1, 4, tongue))}</td>" for _ in range(r.randint(2, 6))) + "</tr></table>")
            elif k and (telling or r.random() < 0.5):
                out.append(r.choice((ad, side, form))())
        return "".join(out) + b

    before = [f for f in (header, nav, notice, ad, side) if r.random() < 0.5]
    after = [f for f in (side, comments, form, ad, notice) if r.random() < 0.45]
    r.shuffle(before)
    r.shuffle(after)
    a, b = named("div class='page'", "div id='wrapper'") if r.random() < 0.4 else ("", "")
    body = a + "".join(f() for f in (nav, *before) if f is not nav or r.random() < 0.8) + article() + "".join(f() for f in after) + b + (footer() if r.random() < 0.9 else "")
    page = f"<!DOCTYPE html><html><head><title>{_word(r)}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>{body}"
    return page + ("</body></html>" if r.random() < 0.9 else ""), main


def labelled(n: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Generated pages as blocks, each with whether it is main text."""
    r = random.Random(seed)
    pages, truth = [], []
    for _ in range(n):
        page, main = write_page(r)
        got = blocks(page)
        rest = [" ".join(b.text for b in blocks(f"<p>{m}</p>")) for m in main]
        y, k = np.zeros(len(got), np.float32), 0
        for i, b in enumerate(got):
            if k < len(rest) and b.text == rest[k]:
                y[i], k = 1, k + 1
        pages.append(got)
        truth.append(y)
    return pages, truth


@lru_cache(maxsize=2)
def fitted(n: int = TRAIN_PAGES, seed: int = 11, epochs: int = 16) -> Labeller:
    """The labeller fitted by Adam on ``n`` generated pages, its weights the mean over the last quarter; the same for the same arguments."""
    pages, truth = labelled(n, seed)
    vectors = [features([p]) for p in pages]
    model = Labeller()
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros(v.shape) for k, v in model.p.items()}
    step, taken = 0, 0
    for epoch in range(epochs):
        # Pages of like length run together, in a new order each time.
        order = sorted(rng.permutation(n), key=lambda i: min(len(pages[i]) // 24, 3))
        starts = rng.permutation(range(0, n, 24))
        for at in starts:
            some = [i for i in order[at : at + 24] if pages[i]]
            grads, _ = model.gradients(np.concatenate([vectors[i] for i in some]), np.array([len(pages[i]) for i in some]), np.concatenate([truth[i] for i in some]))
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.p[k] = (model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if 4 * epoch >= 3 * epochs:
                taken += 1
                for k, v in model.p.items():
                    mean[k] += v
    model.p = {k: (v / max(taken, 1)).astype(np.float32) for k, v in mean.items()} if taken else model.p
    return model


def main_text(model: Labeller, pages: list[str | None], chunk: int = 256) -> list[tuple[str, int, int]]:
    """Text, number of blocks and number of main blocks of each page."""
    out = []
    for at in range(0, len(pages), chunk):
        cut = [blocks(p) for p in pages[at : at + chunk]]
        for page, is_main in zip(cut, model.label(cut), strict=True):
            out.append((" ".join(b.text for b, m in zip(page, is_main.tolist(), strict=True) if m), len(page), int(is_main.sum())))
    return out


def _extractor(model: Labeller, html: str, keep: list[str], result: str):
    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                got = main_text(model, [h if isinstance(h, str) else None for h in part[html]])
                yield part[keep].assign(**{result: pd.Series([{"text": t, "n_blocks": n, "n_main": m} for t, n, m in got], part.index, dtype=object)})

    return extract


def extract_pages(pages: DataFrame, keep: list[str], html: str = "html") -> tuple[DataFrame, str]:
    """The columns ``keep`` of each page and a struct (name returned): text, n_blocks, n_main."""
    keep = list(dict.fromkeys(keep))
    (result,) = fresh(pages.columns, "main")
    (body,) = fresh([*pages.columns, result], "page_html")
    rows = for_python(pages).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias(body))
    value = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_main", T.LongType())])
    return rows.mapInPandas(_extractor(fitted(), body, keep, result), T.StructType([*[rows.schema[c] for c in keep], T.StructField(result, value)])), result
