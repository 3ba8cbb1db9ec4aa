"""Identifiers: features, live queries, compounds, and the compact numbers of viewer links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits, the sign after a negative number, the separator, and the view's orientation.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-"
NEGATIVE = "~"
SEPARATOR = "."
ORIENTATION = "0.0.0.-W000.._eCwg.2-FUe3._-s_W.2_evlu.."


def point_id(space: Column, x: Column, y: Column, z: Column) -> Column:
    return F.md5(F.concat_ws(",", space, x.cast("string"), y.cast("string"), z.cast("string")).cast("binary"))


def feature_id(dataset: Column, name: Column, anchor: Column) -> Column:
    """MD5 of name and anchor, after the dataset's id if there is one."""
    digest = F.md5(F.concat(name, anchor).cast("binary"))
    return F.when(dataset.isNull(), digest).otherwise(F.concat_ws("--", dataset, digest))


def compound_id(cls: Column, concept: Column, datasets: Column, content: Column) -> Column:
    return F.concat_ws("::", F.lit("cf0"), cls, concept, datasets, F.md5(content.cast("binary")))


def encode_concept(space: Column, parcellation: Column, region: Column) -> Column:
    """``s:`` space, or ``p:`` parcellation with an optional ``r:`` region."""
    return F.when(space.isNotNull(), F.concat(F.lit("s:"), space)).otherwise(
        F.concat_ws("::", F.concat(F.lit("p:"), parcellation), F.when(region.isNotNull(), F.concat(F.lit("r:"), region)))
    )


def encode_query_context(cls: Column, concept: Column, id: Column) -> Column:
    return F.concat_ws("::", F.lit("lq0"), cls, concept, id)


def decode_query_context(x: Column) -> Column:
    """Struct cls, space, parcellation, region, id, and the error that makes an id invalid (else null)."""
    parts = F.split(x, "::")
    n = F.size(parts)
    inner = F.slice(parts, 3, F.greatest(n - 3, F.lit(0)))
    pick = lambda p: F.filter(inner, lambda c: c.startswith(p))
    value = lambda p: F.substr(F.get(pick(p), F.lit(0)), F.lit(len(p) + 1))
    spaces, parcellations, regions = pick("s:"), pick("p:"), pick("r:")
    error = (
        F.when(F.get(parts, F.lit(0)) != "lq0", "version")
        .when(n < 3, "no id")
        .when(F.size(spaces) + F.size(parcellations) > 1, "conflicting")
        .when((F.size(regions) > 0) & (F.size(parcellations) == 0), "region without parcellation")
        .when((F.size(regions) > 0) & (F.array_position(inner, F.get(regions, F.lit(0))) < F.array_position(inner, F.get(parcellations, F.lit(0)))), "region without parcellation")
        .when(F.size(spaces) + F.size(parcellations) == 0, "no concept")
    )
    return F.struct(
        F.get(parts, F.lit(1)).alias("cls"), value("s:").alias("space"), value("p:").alias("parcellation"), value("r:").alias("region"), F.element_at(parts, -1).alias("id"), error.alias("error")
    )


def encode_number(x: Column) -> Column:
    """An integer in base 64, the sign behind; plain expressions, eleven digits hold any long."""
    size = F.abs(x)
    digits = F.transform(F.sequence(F.lit(10), F.lit(0)), lambda k: F.substr(F.lit(DIGITS), (F.call_function("shiftright", size, (6 * k).cast("int")) % 64 + 1).cast("int"), F.lit(1)))
    return F.concat(F.regexp_replace(F.array_join(digits, ""), "^0+(?=.)", ""), F.when(x < 0, NEGATIVE).otherwise(""))


def decode_number(x: Column) -> Column:
    """The integer of a base 64 string; null if a character is no digit."""
    bare = F.regexp_replace(x, f"{NEGATIVE}$", "")
    value = F.aggregate(F.split(bare, ""), F.lit(0).cast("long"), lambda a, c: a * 64 + F.position(c, F.lit(DIGITS)) - 1)
    return F.when(bare.rlike(r"^[0-9A-Za-z_\-]+$"), F.when(x.endswith(NEGATIVE), -value).otherwise(value))


def decode_view(url: Column, width: int = 1000) -> Column:
    """A viewer link as a box: struct space, x0 to z1 (mm); null where the link isn't of the form."""
    view = F.regexp_extract(url, "/@:([^/]+)", 1)
    parts = F.split(view, r"\.\.")
    at = F.transform(F.split(F.get(parts, F.lit(3)), r"\."), decode_number)
    zoom = decode_number(F.get(parts, F.lit(4)))
    side = lambda i, sign: (F.get(at, F.lit(i)) + sign * zoom * width / 2) / 1e6
    space = F.replace(F.regexp_extract(url, "/t:([^/]+)", 1), F.lit(":"), F.lit("/"))
    good = (F.size(parts) == 5) & (F.size(at) == 3) & zoom.isNotNull() & (space != "") & ~F.exists(at, lambda v: v.isNull())
    return F.when(good, F.struct(space.alias("space"), *[side(i, s).alias(f"{c}{n}") for n, s in ((0, -1), (1, 1)) for i, c in enumerate("xyz")]))


def encode_view(root: str, atlas: Column, space: Column, parcellation: Column, x: Column, y: Column, z: Column, zoom: Column, perspective: Column) -> Column:
    """A viewer link that shows a position (mm)."""
    safe = lambda c: F.replace(c, F.lit("/"), F.lit(":"))
    nav = F.concat_ws(SEPARATOR, *[encode_number(F.floor(v * 1e6)) for v in (x, y, z)])
    return F.concat(
        F.lit(f"{root}#/a:"), safe(atlas), F.lit("/t:"), safe(space), F.lit("/p:"), safe(parcellation), F.lit("/@:" + ORIENTATION), encode_number(perspective), F.lit(".."), nav, F.lit(".."), encode_number(zoom)
    )


def name_hash(name: Column) -> Column:
    """Hex tail of a 32-bit rolling hash with overflow, as viewer links use it for region names."""
    codes = F.transform(F.regexp_extract_all(name, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c + (1 << 31), F.lit(1 << 32)) - (1 << 31))
    digits = F.lower(F.hex(F.abs(h)))
    # The first two characters are dropped after a sign, and one digit with them where there is none.
    return F.when(h < 0, digits).otherwise(F.substr(digits, F.lit(2)))
