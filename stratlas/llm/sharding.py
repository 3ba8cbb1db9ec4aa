"""K-d tree partitioning of documents into shards of near equal bytes.

A node holds a range of shards.  It is split along its widest metadata dimension
at the weighted quantile that gives each side the bytes of its shards, until a
node is one shard.  The quantile is found on a 36-bit key (12 bits of coordinate,
12 of the text's hash, 12 of the row's), 12 bits at a time: sums over 4096 cells
per node, pre-aggregated before the shuffle, then the cells of the one crossing
cell, then theirs.  So a coordinate, source or text that holds most of a node is
cut within itself.  The metadata are by default such that copies of one text share
them; a cut goes round a cell of few texts, and only through one that holds over
1/128 of the side's bytes, so copies stay together unless they are that many.

Bounds: the driver runs a few jobs per tree level and knows only how many levels
there are; tables of a level have a row per node and are broadcast while they
number at most ``BROADCAST_NODES``.  While the tree is built, each level's keys
are written with their node, so a level reads the one before and not the path
from the root.  A shard's bytes differ from an even share by 1/128 of it for each
level at most, or by half of the largest document if that is more.

Defined cases: a null text has no bytes; nulls in metadata are a coordinate of
their own; rows that repeat get different slots; an empty table gives an empty
result; other columns are carried and not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratlas.llm.textops import cut, fresh

BROADCAST_NODES = 100_000
#: A cell of text hashes is cut within only if it holds more than this part of what a cut has to reach.
WHOLE = 128
_CELL = 12


def coordinates(docs: DataFrame, columns: list[str]) -> list:
    """One 12-bit coordinate per metadata column: numbers on a logarithmic scale, anything else by hash."""
    out = []
    for c in columns:
        if docs.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            out.append(F.least(F.lit(4095), F.floor(F.log2(F.greatest(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) + 1) * 96)).cast("long"))
        else:
            out.append(F.shiftrightunsigned(F.xxhash64(F.col(f"`{c}`").cast("string")), 64 - _CELL))
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def _root():
    """The root's number, 0, for each row; not a literal, which would turn the first level's join into one without a key."""
    return F.least(F.lit(0), F.col("size")).cast("int")


def _descend(rows: DataFrame, level: DataFrame) -> DataFrame:
    """Rows (lo, shards, k: the keys of all dimensions) one level further down: ``lo`` is a node's first shard, ``shards`` how many it has."""
    rows = rows.join(level.select("lo", "dim", "at"), "lo", "left")
    half = F.shiftright("shards", 1)
    goes = F.get("k", F.col("dim")) > F.col("at")
    lo = F.when(goes, F.col("lo") + half).otherwise(F.col("lo"))
    return rows.withColumns({"lo": lo, "shards": F.when(F.col("shards") < 2, F.col("shards")).when(goes, F.col("shards") - half).otherwise(half)}).drop("dim", "at")


def _crossing(cells: DataFrame) -> DataFrame:
    """Of (lo, cell, b, need): the cell in which the running sum reaches need, and what it still needs there."""
    order = Window.partitionBy("lo").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("sum", F.sum("b").over(order)).filter("sum >= need and sum - b < need").select("lo", "cell", (F.col("need") - F.col("sum") + F.col("b")).alias("need"), "b")


def build(rows: DataFrame, dims: int, shards: int) -> list[DataFrame]:
    """The levels of the tree over (size, k): tables (lo, dim, at); a key over ``at`` in dimension ``dim`` goes right."""
    levels: list[DataFrame] = []
    here = rows.select("size", "k", _root().alias("lo"), (_root() + shards).alias("shards"))
    coordinate = [F.shiftright(F.get("k", F.lit(i)), 2 * _CELL) for i in range(dims)]
    wide = [f"w{i}" for i in range(dims)]
    spread = None
    for _ in range((shards - 1).bit_length()):
        stats = here.filter("shards > 1").groupBy("lo").agg(F.sum("size").cast("double").alias("bytes"), F.max("shards").alias("shards"), *[(F.max(c) - F.min(c)).alias(w) for c, w in zip(coordinate, wide, strict=True)])
        stats = cut(stats)
        if spread is None:
            top = stats.first()
            spread = [max(1, top[w] or 0) if top else 1 for w in wide]
        best = F.greatest(*[F.struct((F.col(w) / s).alias("w"), F.lit(-i).alias("i")) for i, (w, s) in enumerate(zip(wide, spread, strict=True))]) if dims > 1 else F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("i"))
        nodes = cut(stats.select("lo", (-best["i"]).alias("dim"), (F.col("bytes") * F.shiftright("shards", 1) / F.col("shards")).alias("need")))
        keyed = here.join(_small(nodes.select("lo", "dim")), "lo").select("lo", "size", F.get("k", F.col("dim")).alias("key"))
        found, steps = nodes.select("lo", "need", F.lit(0).cast("long").alias("at")), []
        for shift in (2 * _CELL, _CELL, 0):
            inside = keyed.join(_small(found), "lo")
            if shift < 2 * _CELL:
                inside = inside.filter(F.shiftright("key", shift + _CELL) == F.col("at"))
            cells = inside.groupBy("lo", F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("b"), F.first("need").alias("need"))
            found = cut(_crossing(cells).select("lo", "need", F.col("cell").alias("at"), "b"))
            end = F.col("at") + F.when(2 * F.col("need") < F.col("b"), 0).otherwise(1)
            steps.append(found.select("lo", (end * (1 << shift) - 1).alias(f"at{shift}"), F.col("b").alias(f"b{shift}")))
        ends = nodes.join(steps[1], "lo").join(steps[2], "lo")
        whole = F.when(F.col(f"b{_CELL}") * WHOLE <= F.col("need"), F.col(f"at{_CELL}")).otherwise(F.col("at0"))
        levels.append(_small(cut(ends.select("lo", "dim", whole.alias("at")))))
        here = cut(_descend(here, levels[-1]))
    return levels


def file_order(docs: DataFrame) -> tuple[Column, Column] | None:
    """Where each row of a table of Parquet files stands: its file and its place there; None if the rows don't come from files."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return None
    return F.col("_metadata.file_path"), F.col("_metadata.row_index")


def keys(docs: DataFrame, metadata: list[str], id: str, text: str) -> Column:
    """An array of one 36-bit key per metadata column: its coordinate, then the text's hash, then the row's."""
    tail = (F.shiftrightunsigned(F.xxhash64(F.col(f"`{text}`")), 64 - _CELL) * (1 << _CELL)) + F.shiftrightunsigned(F.xxhash64(F.col(f"`{id}`").cast("string"), F.lit(1)), 64 - _CELL)
    return F.array(*[c * (1 << 2 * _CELL) + tail for c in coordinates(docs, metadata)])


def shard(docs: DataFrame, carry: list[str], shards: int | None = 8, target_bytes: int | None = None, metadata: tuple[str, ...] = ("lang", "n_chars"), id: str = "doc_id", text: str = "text", order: tuple[Column, Column] | None = None) -> tuple[DataFrame, str]:
    """The columns ``carry`` of each document and a struct (name returned): size, text_crc32, shard, slot (gapless in the shard).

    Without ``shards``, as many as ``target_bytes`` asks for.  Slots follow
    ``order``, (a part of the table, a row's place in the part), or else a hash.
    """
    carry = list(dict.fromkeys(carry))
    (name,) = fresh(docs.columns, "placed")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h = F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`"))
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        keys(docs, list(metadata), id, text).alias("k"),
        *[c.alias(a) for c, a in zip(order or (F.shiftrightunsigned(h, 64 - _CELL), h), ("bucket", "h"), strict=True)],
    )
    rows = cut(wide.select("size", "k", "bucket"))
    if shards is None:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = max(1, -(-total // target_bytes))
    levels = build(rows, len(metadata), shards)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumns({"lo": _root(), "shards": _root() + shards})
        for level in levels:
            df = _descend(df, level)
        return df

    counts = placed(rows).groupBy("lo", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lo").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("lo", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("lo", "bucket").orderBy("h", "size")
    out = placed(wide).withColumn("i", F.row_number().over(within) - 1).join(offsets, ["lo", "bucket"])
    value = F.struct("size", F.col("crc").alias("text_crc32"), F.col("lo").alias("shard"), (F.col("offset") + F.col("i")).cast("long").alias("slot"))
    return out.select(*[F.col("row")[c].alias(c) for c in carry], value.alias(name)), name
