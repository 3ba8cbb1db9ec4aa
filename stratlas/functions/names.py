"""Names, keys and matching as column expressions.

Nulls stay null in string functions; a predicate on a null is null, which a
filter drops.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the name cleaning removes and replaces, in this order.
REMOVED = ("hemisphere", " -", "-brain", "both", "Both")
REPLACED = (("ctx-lh-", "left "), ("ctx-rh-", "right "))

#: Characters that separate the words of a region name.
WORD_GAP = r"[^a-zA-Z0-9.\-]"


def create_key(name: Column) -> Column:
    """Upper-case identifier of letters, digits and underscores."""
    return F.regexp_replace(F.trim(F.upper(F.regexp_replace(name, r"[^\p{L}\p{N}]", " "))), " +", "_")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, " +", " "))


def clear_name(name: Column) -> Column:
    """A name without hemisphere words and prefixes, single-spaced."""
    for gone in REMOVED:
        name = F.replace(name, F.lit(gone), F.lit(""))
    for old, new in REPLACED:
        name = F.replace(name, F.lit(old), F.lit(new))
    return squeeze(name)


def snake_to_camel(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def readable_class_name(x: Column) -> Column:
    """``ReceptorDensityProfile`` as ``Receptor Density Profile``."""
    return F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")


def uuid_of(x: Column) -> Column:
    """The MD5 of a string in the form of a UUID."""
    return F.regexp_replace(F.md5(x.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def trailing_uuid(x: Column) -> Column:
    return F.regexp_extract(x, "([a-f0-9-]+)$", 1)


def species_key(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, r"\s+", "_"))


def species_name(key: Column) -> Column:
    """``HOMO_SAPIENS`` as ``Homo sapiens``."""
    plain = F.replace(F.lower(key), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2)))


def rgb(hex_colour: Column) -> Column:
    """``#rrggbb`` as a struct of three ints; null where it isn't of that form."""
    part = lambda at: F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("int")
    return F.when(hex_colour.rlike("^#[0-9a-fA-F]{6}$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def words(x: Column, gap: str = WORD_GAP) -> Column:
    return F.filter(F.split(x, gap), lambda w: w != "")


def contains_all(text: Column, spec: Column, gap: str = "[ -]") -> Column:
    """Every word of ``spec`` is somewhere in ``text``, letters' case aside."""
    return F.forall(F.split(spec, gap), lambda w: F.contains(F.lower(text), F.lower(w)))


def concept_matches(spec: Column, key: Column, id: Column, name: Column) -> Column:
    """Key or id equal; or all words, or the squeezed spec, in the squeezed name."""
    squeezed = F.replace(clear_name(F.lower(name)), F.lit(" "), F.lit(""))
    return (spec == key) | (spec == id) | contains_all(squeezed, spec) | F.contains(squeezed, F.replace(spec, F.lit(" "), F.lit("")))


def region_matches(spec: Column, key: Column, id: Column, name: Column) -> Column:
    """Key, id or name equal, case and outer spaces aside; or every word of the spec, also after a ``v``, is a word of the name."""
    q = F.lower(F.trim(spec))
    have = words(clear_name(F.lower(name)))
    want = words(F.lower(clear_name(spec)))
    by_word = F.forall(want, lambda w: F.array_contains(have, w) | F.array_contains(have, F.concat(F.lit("v"), w)))
    return (q == F.lower(F.trim(key))) | (q == F.lower(F.trim(id))) | (q == F.lower(F.trim(name))) | by_word


def regex_matches(pattern: str, name: Column, key: Column, flags: str = "") -> Column:
    """A ``/pattern/flags`` spec on name or key; the flags a and L say what Java does anyway, u is its Unicode mode."""
    unknown = set(flags) - set("aiLmsux")
    if unknown:
        raise ValueError(f"unknown flags {sorted(unknown)}")
    java = "".join({"i": "i", "m": "m", "s": "s", "u": "u", "x": "x"}.get(f, "") for f in dict.fromkeys(flags))
    full = f"(?{java}){pattern}" if java else pattern
    return name.rlike(full) | key.rlike(full)


def parse_point(x: Column) -> Column:
    """``'1mm, 2mm, 3mm'`` as an array of three doubles; null unless there are three."""
    got = F.transform(F.regexp_extract_all(x, F.lit(r"([-\d.]+) *mm"), F.lit(1)), lambda v: v.try_cast("double"))
    return F.when(F.size(got) == 3, got)


def group_members(spec: Column) -> Column:
    """The specs of a ``Group: a, b (c, d)`` spec; commas in brackets don't part."""
    bare = F.regexp_replace(spec, "Group: *", "")
    return F.split(bare, r", *(?![^()]*\))")


def duplicate_suffix(x: Column, occurrence: Column) -> Column:
    """A label that occurred ``occurrence - 1`` times before gets as many asterisks."""
    return F.concat(x, F.repeat(F.lit("*"), (occurrence - 1).cast("int")))
