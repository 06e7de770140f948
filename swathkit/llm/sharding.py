"""Sharding by bytes: minimax contiguous partition of ordered atomic groups, in DataFrame functions only.

Documents with equal texts must share a shard. Texts are ordered by their MD5; the leading 16 bits of the digest
name the *atom* a text belongs to, so atoms are ordered, keep equal texts together and number at most 65,536 however
many documents there are. The smallest shard capacity for which a greedy left-to-right filling needs at most
``n_shards`` shards is found by binary search over the ordered atom sizes, and the atoms are cut where that filling
cuts. The search runs as one SQL expression over a single row that holds the (bounded) list of atom sizes.

Only the atom table is ever broadcast (at most 65,536 rows of five numbers, under 4 MB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATOM_BITS = 16
ROW_OVERHEAD = 16
ROWS_PER_SALT = 16384

_NEEDED = "aggregate(list, struct(0L AS fill, 1L AS shards), (a, x) -> if(a.fill + x.s > {cap}, struct(x.s AS fill, a.shards + 1L AS shards), struct(a.fill + x.s AS fill, a.shards AS shards))).shards"


def atom_of(text: Column) -> Column:
    """The atom of a text; a null text counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, ATOM_BITS // 4), 16, 10).cast("int")


def minimax_cuts(atoms: DataFrame, n_shards: int, atom: str = "atom", size: str = "size") -> list[int]:
    """The first atom of every shard but the first, for the smallest feasible capacity.

    ``atoms`` has one row for each atom (bounded); an empty table has no cuts. With capacity ``ceil(total / n) +
    largest`` greedy filling always succeeds, which bounds the search from above.
    """
    # Each repartition keeps Catalyst from repeating the expression below it inside the lambdas above it.
    one = atoms.agg(F.sort_array(F.collect_list(F.struct(F.col(atom).alias("a"), F.col(size).alias("s")))).alias("list")).repartition(1)
    one = one.selectExpr("list", "aggregate(list, 0L, (a, x) -> a + x.s) AS total", "aggregate(list, 0L, (a, x) -> greatest(a, x.s)) AS largest").repartition(1)
    one = one.selectExpr("list", f"greatest(largest, (total + {n_shards - 1}L) div {n_shards}L) AS low", f"(total + {n_shards - 1}L) div {n_shards}L + largest AS high").repartition(1)
    step = f"if({_NEEDED.format(cap='((b.lo + b.hi) div 2L)')} <= {n_shards}L, struct(b.lo AS lo, (b.lo + b.hi) div 2L AS hi), struct((b.lo + b.hi) div 2L + 1L AS lo, b.hi AS hi))"
    one = one.selectExpr("list", f"aggregate(sequence(1, 62), struct(low AS lo, high AS hi), (b, i) -> if(b.lo >= b.hi, b, {step})).lo AS capacity").repartition(1)
    cut = one.selectExpr("aggregate(list, struct(0L AS fill, cast(array() AS array<int>) AS cuts), (a, x) -> if(a.fill + x.s > capacity, struct(x.s AS fill, concat(a.cuts, array(x.a)) AS cuts), struct(a.fill + x.s AS fill, a.cuts AS cuts))).cuts AS cuts")
    return list(cut.first()["cuts"])


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text plus 16; a null text has no bytes and CRC 0 and goes with the empty texts.
    Empty tables give no rows; repeated rows keep a slot each; further columns of ``docs`` are ignored. Slots run
    from 0 without a gap in every shard. Hot atoms are split by a hash of the id before rows are numbered, so that
    no window holds much more than ``ROWS_PER_SALT`` rows of different ids.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        atom_of(text).alias("atom"),
    )
    atoms = rows.groupBy("atom").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    shard = F.lit(0)
    for cut in minimax_cuts(atoms, n_shards):
        shard = shard + (F.col("atom") >= cut).cast("int")
    layout = atoms.select("atom", shard.alias("shard"), F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts"))
    rows = rows.join(F.broadcast(layout), "atom").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    before = Window.partitionBy("shard").orderBy("atom", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "atom", "salt").agg(F.count(F.lit(1)).alias("n")).select("atom", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("atom", "salt").orderBy("doc_id", "size")
    return (
        rows.withColumn("rank", F.row_number().over(inside)).join(offsets, ["atom", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
