r"""URL filters: pattern rules indexed by their rarest literal token.

A rule (``url_rules``) is a regular expression over ``host + path`` with the
literal tokens that every match must hold as whole tokens; ``a|b`` stands for
either of two.  Of those, the one that the fewest URLs of the table hold is the
rule's index entry (entries, if it has alternatives).  A URL is cut into tokens,
its tokens fetch candidate rules, and only those run their expression.

Rules are configuration: at most ``MAX_RULES`` of them travel with the task.
Token frequencies are counted over all URLs by a join with the rules' tokens (a
broadcast table bounded by ``MAX_RULES``), summed before the shuffle.

Defined cases: a null url, or one without ``://``, has empty host and path and
is allowed; repeated rows are judged one by one; an empty table gives an empty
result; very long urls are read whole; other columns of the input are carried if
asked for and never read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratlas.llm.textops import for_python, fresh
from stratlas.llm.url_rules import _LOWER, PATTERNS, SITES, TOKEN, Rule, pattern_rule, site_rule

__all__ = ["PATTERNS", "SITES", "Rule", "filter_urls", "index_rules", "pattern_rule", "site_rule", "split_url"]

MAX_RULES = 200_000


def split_url(url: str):
    """Columns host and path of a url column."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def index_rules(urls: DataFrame, rules: list[Rule], host: str, path: str) -> list[tuple[Rule, tuple[str, ...]]]:
    """Each rule with the literal token (or its alternatives) that the fewest of the urls hold."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} travel with a task")
    wanted = sorted({(a,) for r in rules for t in r.tokens for a in t.split("|")})
    tokens = F.array_distinct(F.split(F.translate(F.concat(F.col(host), F.col(path)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"))
    held = urls.select(F.explode(tokens).alias("t")).join(F.broadcast(urls.sparkSession.createDataFrame(wanted, "t string")), "t")
    often = {r["t"]: r["count"] for r in held.groupBy("t").count().collect()}
    return [(r, min((tuple(t.split("|")) for t in r.tokens), key=lambda t: (sum(often.get(a, 0) for a in t), t))) for r in rules]


def _judge(rules: list[tuple[Rule, tuple[str, ...]]], keep: list[str], names: list[str], host: str, path: str):
    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = defaultdict(list)
        for i, (_, index) in enumerate(rules):
            for t in index:
                by[t].append(i)
        compiled: dict[int, re.Pattern] = {}
        token = re.compile(TOKEN)
        for f in frames:
            found, verdicts, tested, fits = [], [], [], []
            for h, p in zip(f[host], f[path], strict=True):
                url = h + p
                candidates = sorted({i for t in set(token.findall(url.translate(_LOWER))) if t in by for i in by[t]})
                hits = []
                for i in candidates:
                    if i not in compiled:
                        compiled[i] = re.compile(rules[i][0].pattern)
                    if compiled[i].search(url):
                        hits.append(rules[i][0])
                sites = [r for r in hits if r.site]
                best = max(sites, key=lambda r: (len(r.name), r.name)) if sites else None
                found.append(best.name if best else None)
                verdicts.append(best.verdict if best else "block" if hits else "allow")
                tested.append(len(candidates))
                fits.append([r.name for r in hits if not r.site])
            yield f[keep].assign(**dict(zip(names, (f[host], f[path], pd.Series(found, f.index, dtype=object), verdicts, tested, pd.Series(fits, f.index, dtype=object)), strict=True)))

    return judge


def filter_urls(pages: DataFrame, keep: list[str], url: str = "url", rules: list[Rule] | None = None) -> tuple[DataFrame, list[str]]:
    """The columns ``keep`` of each page, and host, path, rule, verdict, n_tested, patterns (names returned); patterns: the pattern rules that fit."""
    rules = [*SITES, *PATTERNS] if rules is None else rules
    keep = list(dict.fromkeys(keep))
    names = fresh(keep, "host", "path", "rule", "verdict", "n_tested", "patterns")
    h, p = fresh([*pages.columns, *names], "url_host", "url_path")
    host, path = split_url(url)
    rows = for_python(pages).select(*[F.col(f"`{c}`") for c in keep], host.alias(h), path.alias(p))
    kinds = [*[T.StringType()] * 4, T.LongType(), T.ArrayType(T.StringType())]
    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    return rows.mapInPandas(_judge(index_rules(rows, rules, h, p), keep, names, h, p), T.StructType([*[rows.schema[c] for c in keep], *fields])), names
