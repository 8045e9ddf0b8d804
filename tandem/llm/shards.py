"""Shards of near equal bytes by k-d tree partitioning.

Documents are points in the space of their metadata: source and language (a category stands at a fixed pseudo-random
place), length (piecewise linear logarithm of the bytes) and id (its place between the smallest and the largest).  A
cell that still has to hold several shards is split along its widest dimension, measured against the whole table's
extent, at the weighted median: at the key up to which the cell's bytes come nearest to the share of the shards on that
side.  This goes on until every leaf has its share of the bytes (or the target, from which the number of leaves follows).

Equal texts are one point, the metadata those of the smallest id, so copies stay together.  A group that is larger than
a sixteenth of a shard (in bytes, and than the largest document; or in rows, and than 1000) is taken apart: each of its
rows is a point of its own.  There are at most 32 such groups a shard, so their list is bounded.

Only DataFrame functions.  A weighted median is found by radix selection: a pass adds up the bytes of the cells in
``BINS`` bins, a running sum inside each cell picks the bin of the median, and the next pass refines it; a 62-bit key
takes six passes at most, and all cells of a level share them.  The driver sees a row for each open cell (fewer than
shards).  Keys carry a hash of the text under the value, so that equal values can be split.

Defined cases: null text counts as empty (16 bytes, checksum 0) and equals it; a null id, source or language has the
place 0 in its dimension; rows that repeat id and text are equal points; with fewer points than shards some shards stay
empty; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.llm.storage import parts_for, stored

#: Bits of a dimension's value and of the hash under it; the last 8 bits tell equal rows of a large group apart.
VALUE_BITS, HASH_BITS, SALT_BITS = 23, 31, 8
BINS = 4096
#: Bytes a row counts besides its text; part of a shard and number of rows from which a group is taken apart; rows of a slice.
ROW_BYTES = 16
GROUP_SHARE = 16
GROUP_ROWS = 1000
SLICE_ROWS = 50_000


def category(c: Column) -> Column:
    """Place of a category: 23 bits of its checksum, 0 for null."""
    return F.coalesce(F.shiftright(F.crc32(c.cast("string").cast("binary")), 32 - VALUE_BITS), F.lit(0)).cast("long")


def magnitude(name: str) -> Column:
    """Place of a positive integer column: number of binary digits, then the digits after the first."""
    shift = VALUE_BITS - 6
    return F.expr(f"(length(bin({name})) - 1) * {1 << shift}L + (shiftright(shiftleft({name}, {shift}), length(bin({name})) - 1) - {1 << shift}L)").cast("long")


def place(c: Column, low: int, high: int) -> Column:
    """Place of a number between the smallest and the largest, 0 for null."""
    span = float(max(1, high - low))
    return F.coalesce(F.floor((c - F.lit(low)).cast("double") * F.lit(float((1 << VALUE_BITS) - 1)) / F.lit(span)), F.lit(0)).cast("long")


def key(value: Column, tie: Column, salt: Column) -> Column:
    return F.shiftleft(value, HASH_BITS + SALT_BITS) + F.shiftleft(tie, SALT_BITS) + salt


def hash31(*c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*c), 64 - HASH_BITS)


@dataclass
class Cell:
    """A cell that holds ``shards`` shards from ``first`` on; once split, points up to ``at`` along ``dim`` are on the left."""

    shards: int
    first: int
    dim: int | None = None
    at: int = 0
    left: Cell | None = None
    right: Cell | None = None

    def split(self, dim: int, at: int) -> None:
        half = self.shards // 2
        self.dim, self.at = dim, at
        self.left, self.right = Cell(half, self.first), Cell(self.shards - half, self.first + half)

    def leaves(self) -> list[Cell]:
        return [self] if self.dim is None else self.left.leaves() + self.right.leaves()

    def column(self, dims: list[str]) -> Column:
        """First shard of the leaf in which a row lies."""
        if self.dim is None:
            return F.lit(self.first)
        return F.when(F.col(dims[self.dim]) <= F.lit(self.at), self.left.column(dims)).otherwise(self.right.column(dims))


@dataclass
class Search:
    """Radix selection of one cell's weighted median: keys from ``low`` to ``high`` are still open, ``before`` bytes lie below."""

    cell: Cell
    dim: int
    low: int
    high: int
    total: int
    before: int = 0
    done: bool = False

    def narrow(self, before: int, weight: int, low: int, high: int) -> None:
        self.before, self.low, self.high = before, low, high
        if low == high:  # one key is left: cut behind it or before it, whichever is nearer to the wanted share
            want = self.total * (self.cell.shards // 2)
            over = (before + weight) * self.cell.shards - want
            self.cell.split(self.dim, high if over <= want - before * self.cell.shards else low - 1)
            self.done = True


def _pick(choices: dict[int, int], kind: str = "long") -> Column:
    return F.element_at(F.create_map(*[F.lit(x).cast(k) for a, b in choices.items() for x, k in ((a, "int"), (b, kind))]), F.col("cell"))


def grow(points: DataFrame, dims: list[str], shards: int) -> Cell:
    """The k-d tree over ``points`` (a 62-bit key for each dimension in ``dims``, weight ``w``)."""
    root = Cell(shards, 0)
    span = None
    while True:
        split = {c.first: c for c in root.leaves() if c.shards > 1}
        placed = points.withColumn("cell", root.column(dims)).where(F.col("cell").isin(list(split)))
        found = placed.groupBy("cell").agg(F.sum("w").alias("w"), *[f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))])
        rows = [r.asDict() for r in found.collect()] if split else []  # one for each open cell
        if not rows:
            return root
        extents = {r["cell"]: [(r[f"hi{i}"] >> HASH_BITS + SALT_BITS) - (r[f"lo{i}"] >> HASH_BITS + SALT_BITS) for i in range(len(dims))] for r in rows}
        span = span or [max(1, e) for e in extents[0]]
        open_cells: dict[int, Search] = {}
        for r in rows:
            width = [e / s for e, s in zip(extents[r["cell"]], span)]
            d = width.index(max(width))
            open_cells[r["cell"]] = Search(split[r["cell"]], d, r[f"lo{d}"], r[f"hi{d}"], r["w"])
        while open_cells:
            for s in list(open_cells.values()):
                if s.low == s.high:
                    s.narrow(s.before, s.total - s.before, s.low, s.high)
            open_cells = {c: s for c, s in open_cells.items() if not s.done}
            if open_cells:
                _pass(placed, dims, open_cells)


def _pass(placed: DataFrame, dims: list[str], cells: dict[int, Search]) -> None:
    """One round of refinement for all open cells of a level."""
    on = _pick({c: s.dim for c, s in cells.items()}, "int")
    k = F.when(F.lit(False), F.lit(None).cast("long"))
    for i, d in enumerate(dims):
        k = k.when(on == i, F.col(d))
    open_rows = placed.where(F.col("cell").isin(list(cells))).select(
        "cell", "w", k.alias("k"), _pick({c: s.low for c, s in cells.items()}).alias("low"), _pick({c: s.high for c, s in cells.items()}).alias("high"),
        _pick({c: (s.high - s.low) // BINS + 1 for c, s in cells.items()}).alias("step")).where("k between low and high")
    bins = open_rows.groupBy("cell", F.expr("(k - low) div step").alias("bin")).agg(F.sum("w").alias("w"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    order = Window.partitionBy("cell").orderBy("bin")
    upto = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) + _pick({c: s.before for c, s in cells.items()})
    reached = bins.withColumn("upto", upto).where(F.col("upto") * _pick({c: s.cell.shards for c, s in cells.items()}) >= _pick({c: s.total * (s.cell.shards // 2) for c, s in cells.items()}))
    # one row for each open cell: the first bin that reaches the wanted share
    for r in reached.groupBy("cell").agg(F.min(F.struct("bin", "upto", "w", "lo", "hi")).alias("b")).select("cell", "b.*").collect():
        cells[r["cell"]].narrow(r["upto"] - r["w"], r["w"], r["lo"], r["hi"])
    for c in [c for c, s in cells.items() if s.done]:
        del cells[c]


DIMS = ["source", "lang", "length", "age"]


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
              categories: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """(id, size, text_crc32, shard, slot): ``shards`` shards, or as many as ``target_bytes`` asks for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first, second = (F.col(c) for c in categories)
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("g"), category(first).alias("v_source"), category(second).alias("v_lang"),
        (F.monotonically_increasing_id() % (1 << SALT_BITS)).alias("salt")), "shard-rows").df
    whole = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("size").alias("most")).first()
    total, n = whole.bytes or 0, whole.n
    shards = shards or parts_for(total, target_bytes, 1)
    most_bytes, most_rows = max(total // (GROUP_SHARE * shards), whole.most or 0), max(n // (GROUP_SHARE * shards), GROUP_ROWS)
    groups = stored(rows.groupBy("g").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("rows"), F.min("size").alias("size"),
                                          F.min(F.struct("id", "v_source", "v_lang")).alias("head")), "shard-groups").df
    large = (F.col("w") > most_bytes) | (F.col("rows") > most_rows)
    hot = [r.g for r in groups.where(large & (F.col("rows") > 1)).select("g").collect()]  # at most 2 * GROUP_SHARE * shards
    apart = F.col("g").isin(hot) if hot else F.lit(False)
    source, lang, low, high = F.col("v_source"), F.col("v_lang"), whole.lo or 0, whole.hi or 0
    tie_group, tie_row = F.shiftrightunsigned(F.col("g"), 64 - HASH_BITS), hash31(F.col("id"))

    def keys(tie: Column, salt: Column) -> dict[str, Column]:
        return {"k_source": key(source, tie, salt), "k_lang": key(lang, tie, salt), "k_length": key(magnitude("size"), tie, salt),
                "k_age": key(place(F.col("id"), low, high), tie, salt)}
    together = (groups.where(~apart).select("g", "w", "size", "head.*").withColumns(keys(tie_group, F.lit(0))))
    alone = rows.where(apart).withColumn("w", F.col("size")).withColumns(keys(tie_row, F.col("salt")))
    names = [f"k_{d}" for d in DIMS]
    points = stored(together.select("g", "w", *names).unionByName(alone.select("g", "w", *names)), "shard-points").df
    shard = grow(points, names, shards).column(names)
    own = ["id", "size", "crc", "g", "shard"]
    dealt = (rows.where(~apart).join(together.select("g", shard.alias("shard")), "g").select(*own)
             .unionByName(alone.withColumn("shard", shard).select(*own)))
    dealt = stored(dealt.withColumn("slice", F.pmod(F.xxhash64("id", "g"), F.lit(parts_for(n / shards, SLICE_ROWS, 1)))), "shard-slices").df
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    inside = Window.partitionBy("shard", "slice").orderBy("id", "g", "size")
    return (dealt.withColumn("nth", F.row_number().over(inside)).join(starts, ["shard", "slice"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("nth") - 1).alias("slot")))


def op13(documents: DataFrame) -> DataFrame:
    """Forty shards of near equal bytes."""
    return (kd_shards(documents, shards=40)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
