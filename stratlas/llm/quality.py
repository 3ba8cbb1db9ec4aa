"""Quality rules: a ledger of rule failures as bits, policies as bit masks.

Every rule is evaluated once per document and leaves one bit in ``fail_mask``
beside the measurements it read.  A policy is a versioned mask of the bits it
enforces, so trying another policy, or leaving one rule out, reads the ledger
and never the texts again.

Defined cases: a null text has no words (every count 0); nulls in other columns
do not matter; repeated rows are judged one by one; an empty table gives an
empty ledger; other columns of the input are carried and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlas.llm.textops import fresh

SPACE = r"[\x20\x09-\x0D]"
_TRIM = " \t\n\u000b\f\r"

#: name -> failing condition over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 6 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines and n_lines >= 4",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
    "shouting": "n_upper > 9 * n_lower and n_upper >= 40",
    "exclamations": "2 * n_exclaim > n_words and n_exclaim >= 20",
    "few_different_words": "n_distinct * n_distinct < 4 * n_words",
    "bare_symbols": "10 * n_bare > 3 * n_words",
    "digits": "2 * n_digits > word_chars",
    "few_letters": "10 * n_letters < 6 * word_chars",
    "no_common_words": "n_words >= 100 and n_stop < 2 and 2 * n_foreign < word_chars",
    "bullets": "10 * n_bullets > 9 * n_lines and n_lines >= 4",
    "ellipses": "10 * n_ellipses > 3 * n_lines and n_lines >= 4",
    "links": "10 * n_links > n_words",
    "braces": "10 * n_braces > n_words",
    "placeholder": "n_lorem > 0",
    "broken_characters": "100 * n_broken > word_chars",
    "long_words": "20 * n_long > n_words",
    "short_lines": "n_words < 3 * n_lines and n_lines >= 10",
    "controls": "100 * n_controls > word_chars",
}
BIT = {name: i for i, name in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


BASE = mask_of("short", "repeated_windows")
#: Versioned policies; a new version is a new entry, old ledgers stay comparable.
POLICIES: dict[str, int] = {
    "v1": BASE,
    "v2": BASE | mask_of("symbols", "repeated_lines"),
    "v3": BASE | mask_of("symbols", "repeated_lines", "word_length", "shouting", "exclamations"),
    "v4": mask_of(*RULES),
}
NEWEST = "v4"

#: What the rules read, in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_exclaim", "n_distinct", "n_bare", "n_digits", "n_letters", "n_foreign", "n_stop", "n_bullets", "n_ellipses", "n_links", "n_braces", "n_lorem", "n_broken", "n_long", "n_controls")
#: Words that running text in four languages can't do without.
COMMON = sorted(set("the of and to in is that it was for on are with as by de la le les et des en un une que est pour dans der die das und zu den von mit ist nicht ein eine auf el los las y del se por con una su para".split()))
PUNCTUATION = r"[\x00-\x08\x0E-\x1F!-/:-@\[-\x60{-\x7F]"
BULLET = r"[ \t]*(?:[-*\u2022\u00B7\u25AA\u25BA\u2013]|[0-9]+[.)])[ \t]"
ELLIPSIS = r"(?:\u2026|\.\.\.)[ \t\r]*"


def _deleted(text: Column, chars: str) -> Column:
    """How many characters of a class the text has; runs of them go at once, which is much faster than one by one."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, chars + "+", ""))


def _without(text: Column, part: str) -> Column:
    """How often a string occurs in the text."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part)))) / len(part)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with one column for each measurement; returns their names too.

    A word of a window that occurs twice is found without any pairwise look: where two window hashes (64 bits, compared
    within one text only) are equal, they are sorted with their positions, neighbours of equal hash mark their positions,
    and the marked positions, sorted, are summed as intervals.  Characters other than small letters and spaces are counted
    in what is left when those are taken out.
    """
    t, w, n, h, s, p, lines, few, rest = fresh(docs.columns, "q_t", "q_w", "q_n", "q_h", "q_s", "q_p", "q_l", "q_f", "q_r")
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(w, F.split(F.btrim(F.col(t), F.lit(_TRIM)), SPACE + "+"))
    out = out.withColumn(n, F.when(F.get(F.col(w), F.lit(0)) == "", F.lit(0)).otherwise(F.size(w)))
    out = out.withColumn(h, F.when(F.col(n) >= 3, F.transform(F.sequence(F.lit(0), F.col(n) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    twice = F.size(F.array_distinct(h)) < F.size(h)
    out = out.withColumn(s, F.when(twice, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    out = out.withColumn(
        p,
        F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))), lambda x: x["i"])),
    )
    out = out.withColumn(few, F.regexp_replace(t, "[a-z]+", "")).withColumn(rest, F.replace(few, F.lit(" ")))
    out = out.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    covered = F.aggregate(
        p,
        F.struct(F.lit(-3).alias("prev"), F.lit(0).alias("sum")),
        lambda a, x: F.struct(x.alias("prev"), (a["sum"] + F.least(F.lit(3), x - a["prev"])).alias("sum")),
        lambda a: a["sum"],
    )
    lower = F.char_length(t) - F.char_length(few)
    upper, foreign, digits = (_deleted(F.col(rest), x) for x in ("[A-Z]", r"[\x{80}-\x{10FFFF}]", "[0-9]"))
    spaced = F.concat(F.lit(" "), t)
    values = [
        F.col(n),
        F.char_length(F.regexp_replace(rest, SPACE + "+", "")) + lower,
        _deleted(F.col(rest), "[#*$%&|<>]"),
        F.size(lines),
        F.size(lines) - F.size(F.array_distinct(lines)),
        F.coalesce(covered, F.lit(0)),
        upper,
        lower,
        _without(F.col(rest), "!"),
        F.when(F.col(n) > 0, F.size(F.array_distinct(w))).otherwise(0),
        F.regexp_count(spaced, F.lit(rf"{SPACE}{PUNCTUATION}++(?={SPACE}|\z)")),
        digits,
        upper + lower + foreign,
        foreign,
        F.size(F.array_intersect(w, F.array(*[F.lit(c) for c in COMMON]))),
        F.when(F.col(rest).rlike(r"[-*\u2022\u00B7\u25AA\u25BA\u20130-9]"), F.regexp_count(t, F.lit(rf"(?:^|\n){BULLET}"))).otherwise(0),
        F.when(F.col(rest).rlike(r"\.\.|\u2026"), F.regexp_count(t, F.lit(rf"{ELLIPSIS}(?=\n|\z)"))).otherwise(0),
        _without(F.col(t), "://"),
        _without(F.col(rest), "{") + _without(F.col(rest), "}"),
        F.when(F.contains(t, F.lit("orem ipsum dolor")), 1).otherwise(0),
        _without(F.col(rest), "\ufffd"),
        F.regexp_count(spaced, F.lit(rf"{SPACE}[^\x20\x09-\x0D]{{40,}}+")),
        _deleted(F.col(rest), r"[\x00-\x08\x0E-\x1F\x7F]"),
    ]
    # The added zero isn't a constant to the optimizer, so no filter moves below the measurements, where it would repeat them.
    zero = F.monotonically_increasing_id() * 0
    own = fresh(docs.columns, *MEASURES)
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], *[(v.cast("long") + zero).alias(a) for v, a in zip(values, own, strict=True)])
    return out, own


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``ledger`` (renamed if taken): all measurements and ``fail_mask``."""
    measured, own = measure(docs, text)
    (name,) = fresh(docs.columns, "ledger")
    out = measured.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*[F.col(a).alias(b) for a, b in zip(own, MEASURES, strict=True)]).alias(name))

    def bound(rule: str) -> Column:
        expr = rule
        for b in sorted(MEASURES, key=len, reverse=True):
            expr = expr.replace(b, f"`{name}`.`{b}`")
        return F.expr(expr)

    bits = [F.when(bound(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return out.withColumn(name, F.col(name).withField("fail_mask", mask.cast("long")))


def passes(fail_mask: Column, policy: str = NEWEST) -> Column:
    return fail_mask.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(ledgers: DataFrame, fail_mask: Column, policy: str = NEWEST) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that no other rule of the policy rejects.

    The ledger is first counted by mask (at most 2^rules rows, summed before the
    shuffle); the rest is bit arithmetic on that.
    """
    masks = ledgers.groupBy(fail_mask.bitwiseAND(F.lit(POLICIES[policy])).alias("mask")).agg(F.count("*").alias("docs"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for k, b in BIT.items() if POLICIES[policy] >> b & 1]))
    x = masks.select("mask", "docs", rules.alias("r"))
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("docs")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("docs")).otherwise(0)).alias("failed_alone"),
    )


def quality_rules(docs: DataFrame, text: str = "text", policy: str = NEWEST) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns they came with."""
    out = ledger(docs, text)
    name = out.columns[-1]
    return out.filter(passes(F.col(name)["fail_mask"], policy)).select(*[F.col(f"`{c}`") for c in docs.columns])
