"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line is what line feeds part, without outer spaces. Lines of at least ``MIN_CHARS`` characters are deduplicated. Of
equal lines the first stays: that of the smallest document id, and in it of the first place. Then a line goes if an
earlier one (by first document, place, text) is near: within one edit if the shorter line has fewer than ``LONG``
characters, else within two. Lines are told apart by 128 bits of hashes, near ones by their texts.

The edit join: a line is split into as many segments as its edits and one more, of nearly equal length; within so few
edits of another line, one of its segments occurs there unchanged, in one of a few places that the two lengths allow.
So each distinct line puts its own segments into an index by segment number, length and content, and probes the index
with the substrings of itself at those places, for each length of up to two characters less. What meets there is
verified by a banded bit-parallel edit distance (Hyyro, 2003) over the characters between the common prefix and the
common suffix.

Keys of up to ``HEAVY`` indexed lines give all their pairs. In a larger key the earliest line decides the others first
(``PIVOT_ROUNDS`` times, each over the lines still undecided): a line near an earlier one goes and needs no more
partners. The undecided rest meets all earlier lines of the key whose parities of character pairs differ in at most
four bits an edit, as an edit changes four pairs at most. So no pair is lost, and a group of near copies costs one pair
a line and round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 10
LONG = 40
HEAVY = 16
PIVOT_ROUNDS = 2
BROADCAST_ROWS = 200_000


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of the whole text), pos, line for every line of rows with an id; a null text has none."""
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    return rows.select("doc_id", "row", "pos", F.trim("raw").alias("line"))


def _identity(line: Column) -> list[Column]:
    """Two hashes with different seeds."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment ``i`` (from 0) of a line of this length; the last segments are the longer ones."""
    k = edits + 1
    longer = k - (length % k)
    size = F.floor(length / k)
    return (size * i + F.greatest(F.lit(0), F.lit(i) - longer) + 1).cast("int"), (size + (F.lit(i) >= longer).cast("int")).cast("int")


def _key(length: Column, i: int, edits: int, shift: int) -> Column:
    start, size = _segment(length, i, edits)
    return F.xxhash64(F.lit(i), length, F.col("line").substr((start + shift).cast("int"), size))


def own_keys() -> list[Column]:
    """The index keys of a ``line`` of ``n`` characters, null where its length has fewer."""
    long, n = F.col("n") >= LONG, F.col("n")
    return [F.when(long, _key(n, i, 2, 0)) for i in range(3)] + [F.when(~long, _key(n, i, 1, 0)) for i in range(2)]


def other_keys() -> list[Column]:
    """The keys under which lines as long as this one, or shorter, may be found, without its own."""
    keys = []
    for edits in (2, 1):
        for less in range(edits + 1):
            length = (F.col("n") - less).cast("int")
            fits = length >= LONG if edits == 2 else (length < LONG) & (length >= MIN_CHARS)
            for i in range(edits + 1):
                for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                    if less or shift:
                        keys.append(F.when(fits, _key(length, i, edits, shift)))
    return keys


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is told once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _shared(p: str, q: str) -> str:
    """SQL: the length of the common prefix, by halving steps."""
    halves = "transform(sequence(cast(floor(log2(n + 1)) AS int), 0, -1), e -> shiftleft(1, e))"
    return _let("n", f"least(length({p}), length({q}))", f"aggregate({halves}, 0, (lo, h) -> if(lo + h <= n AND substr({p}, lo + 1, h) = substr({q}, lo + 1, h), lo + h, lo))")


def middle(p: str, q: str) -> str:
    """SQL: a struct of ``p`` and ``q`` (as x and y) without their common prefix and then without their common suffix."""
    cut = "struct(left(t.x, length(t.x) - post) AS x, left(t.y, length(t.y) - post) AS y)"
    ends = _let("r", "struct(reverse(t.x) AS x, reverse(t.y) AS y)", _let("post", _shared("r.x", "r.y"), cut))
    return _let("m", f"struct({p} AS x, {q} AS y)", _let("pre", _shared("m.x", "m.y"), _let("t", "struct(substr(m.x, pre + 1) AS x, substr(m.y, pre + 1) AS y)", ends)))


def within_edits(a: str, b: str, edits: int) -> str:
    """SQL: whether columns ``a`` and ``b`` are within so many edits, ``b`` being as long as ``a`` or longer by up to ``edits``.

    Of column j of the distance matrix (character j of ``b``) only rows j - edits to j + edits are kept, a bit each: vp
    and vn say where the distance rises or falls by one from row to row. The distance is followed down the lowest
    diagonal of the band to the last row, and from there along it. Along a diagonal it never falls and along the last
    row by at most twice the edits: beyond three times the edits it is followed no more.
    """
    k = edits
    mask, top = (1 << (2 * k + 1)) - 1, 2 * k
    match = " | ".join(f"if(coalesce(get(q.x, j - {k + 1 - t}) = q.y[j - 1], false), {1 << t}L, 0L)" for t in range(2 * k + 1))
    step = f"""element_at(transform(array({match}), e ->
        element_at(transform(array(((((((e & s.vp) + s.vp) ^ s.vp) | e | s.vn)) & {mask}L)), d ->
        element_at(transform(array(struct(d AS d, (s.vn | ~(d | s.vp)) & {mask}L AS hp, d & s.vp AS hn)), h ->
            struct((h.hn | ~(shiftright(h.d, 1) | h.hp)) & {mask}L AS vp,
                   shiftright(h.d, 1) & h.hp AS vn,
                   CASE WHEN j <= size(q.x) - {k} THEN s.score + if((h.d & {1 << top}L) = 0L, 1L, 0L)
                        ELSE s.score + if((h.hp & shiftleft(1L, size(q.x) - j + {k})) = 0L, 0L, 1L) - if((h.hn & shiftleft(1L, size(q.x) - j + {k})) = 0L, 0L, 1L) END AS score)), 1)), 1)), 1)"""
    start = f"struct({((1 << (k + 1)) - 1) << k}L AS vp, 0L AS vn, cast(least({k}, size(q.x)) AS bigint) AS score)"
    run = f"element_at(transform(array(struct(split({a}, '') AS x, split({b}, '') AS y)), q -> aggregate(sequence(1, size(q.y)), {start}, (s, j) -> if(s.score > {3 * k}L, s, {step})).score), 1) <= {k}"
    return f"if(length({a}) = 0, length({b}) <= {k}, {run})"


def pair_parities(line: str) -> str:
    """SQL: the parities, a bit each, of how often the character pairs of 64 classes occur in a line."""
    return f"element_at(transform(array(split({line}, '')), c -> aggregate(zip_with(c, slice(c, 2, size(c)), (x, y) -> shiftleft(1L, cast(pmod(xxhash64(x, y), 64) AS int))), 0L, (s, b) -> s ^ b)), 1)"


def distinct_lines(lines: DataFrame) -> DataFrame:
    """line, n, first (document), place (in it), copies, h1, h2 and lid, a number of its own, for each distinct line of ``lines``."""
    found = lines.groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("o"), F.count(F.lit(1)).alias("copies"))
    return common.materialize(found.select("line", F.length("line").alias("n"), F.col("o.doc_id").alias("first"), F.col("o.pos").alias("place"), "copies", *_identity(F.col("line")), F.monotonically_increasing_id().alias("lid")))


def later_of(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """lid of every line that is the later of a near pair (a, b) among ``pairs``."""
    spark = pairs.sparkSession
    asked = pairs.select(F.col("a").alias("lid")).union(pairs.select(F.col("b").alias("lid"))).distinct()
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # at most twice as many ids, of 8 bytes
    texts = common.materialize(distinct.select("lid", "line", "first", "place").join(F.broadcast(asked) if few else asked, "lid", "left_semi"))
    side = lambda name, line: texts.select(F.col("lid").alias(name), F.struct("first", "place", "line").alias(line))
    wide = pairs.join(side("a", "l"), "a").repartition(common.partitions(spark), "b").join(side("b", "r"), "b")
    wide = wide.select(F.when(F.col("l") < F.col("r"), F.col("b")).otherwise(F.col("a")).alias("lid"), F.expr("if(length(l.line) <= length(r.line), l.line, r.line)").alias("p"), F.expr("if(length(l.line) <= length(r.line), r.line, l.line)").alias("q"))
    wide = wide.where(f"length(q) - length(p) <= if(length(p) < {LONG}, 1, 2)")
    near = _let("c", middle("p", "q"), f"if(length(p) < {LONG}, {within_edits('c.x', 'c.y', 1)}, {within_edits('c.x', 'c.y', 2)})")
    found = common.materialize(wide.where(F.expr(near)).select("lid").distinct())
    common.discard(texts)
    return found


def near_later(distinct: DataFrame) -> DataFrame:
    """lid of every line of ``distinct`` that is near an earlier one."""
    n_own = len(own_keys())
    index = distinct.select(F.explode(F.array(*own_keys())).alias("key"), F.col("lid").alias("a")).where("key IS NOT NULL")
    probes = distinct.select(F.posexplode(F.array(*own_keys(), *other_keys())).alias("k", "key"), F.col("lid").alias("b")).where("key IS NOT NULL").select("key", "b", (F.col("k") < n_own).alias("own"))
    heavy = common.materialize(index.groupBy("key").count().where(F.col("count") > HEAVY).select("key"))
    none = heavy.isEmpty()
    if not none:  # such a key stands in the index once, to find its lines
        index = index.join(heavy, "key", "left_anti").union(heavy.select("key", F.lit(None).cast("long")))
    met = index.join(probes, "key").where("a IS NULL OR if(own, a < b, a <> b)")
    met = common.materialize(met.select(F.expr("if(a IS NULL, key, NULL)").alias("key"), "a", "b", "own"))
    pairs = common.materialize(met.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    late = later_of(pairs, distinct)
    common.discard(pairs)
    if not none:
        late = late.union(_heavy_later(met.where("a IS NULL").groupBy("key", F.col("b").alias("lid")).agg(F.max("own").alias("own")), distinct)).distinct()
    common.discard(met, heavy)
    return late


def _heavy_later(members: DataFrame, distinct: DataFrame) -> DataFrame:
    """As ``near_later``, for the lines that meet in heavy keys: ``members`` (key, lid, own: whether the key is in the index for this line)."""
    members = common.materialize(members)
    lines = common.materialize(distinct.join(members.select("lid").distinct(), "lid", "left_semi").withColumn("bits", F.expr(pair_parities("line"))))
    placed = common.materialize(members.join(lines.select("lid", "n", "bits", F.struct("first", "place", "lid").alias("o")), "lid"))
    rounds, undecided = [], placed
    for _ in range(PIVOT_ROUNDS):
        pivots = undecided.where("own").groupBy("key").agg(F.min("o").alias("p")).select("key", F.col("p.lid").alias("pivot"))
        pairs = undecided.join(pivots, "key").where("lid <> pivot").select(F.least("lid", "pivot").alias("a"), F.greatest("lid", "pivot").alias("b")).distinct()
        pairs = common.materialize(pairs)
        rounds.append(later_of(pairs, lines))
        undecided = undecided.join(rounds[-1], "lid", "left_anti")
        common.discard(pairs)
    x, y = undecided.alias("x"), placed.alias("y")
    rest = x.join(y, "key").where("y.o < x.o AND (x.own OR y.own) AND abs(x.n - y.n) <= 2 AND bit_count(x.bits ^ y.bits) <= 8")
    rest = common.materialize(rest.select(F.least("x.lid", "y.lid").alias("a"), F.greatest("x.lid", "y.lid").alias("b")).distinct())
    rounds.append(later_of(rest, lines))
    common.discard(rest, placed, lines, members)
    out = rounds[0]
    for found in rounds[1:]:
        out = out.union(found)
    return out


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, pos, near (boolean: for a near copy, not an equal line) of every line that goes.

    Rows that share an id count as one document, and their equal lines at one place as one. Null ids, null texts and
    empty tables give no rows; a line of any length is compared whole.
    """
    lines = lines_of(docs, id_col, text_col).where(F.length("line") >= MIN_CHARS)
    distinct = distinct_lines(lines.select("doc_id", "pos", "line"))
    late = near_later(distinct).withColumn("late", F.lit(True))
    cases = distinct.select("h1", "h2", "lid", "first", "place", "copies").join(late, "lid", "left").where("copies > 1 OR late")
    cases = common.materialize(cases.select("h1", "h2", "first", "place", F.coalesce("late", F.lit(False)).alias("late")))
    common.discard(distinct)
    placed = lines.select("doc_id", "row", "pos", *_identity(F.col("line"))).join(cases, ["h1", "h2"])
    stays = (F.col("doc_id") == F.col("first")) & (F.col("pos") == F.col("place"))
    return placed.where(F.col("late") | ~stays).select("doc_id", "row", "pos", stays.alias("near")).distinct()


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_lines, n_kept, n_equal (lines dropped as repeats), n_near (as near copies).

    A null text has no lines, an empty one has one, empty, line; neither loses any. Rows with a null id are left out, rows
    that share an id give one row. Ties are told by place and text. Other columns are ignored; empty tables give no rows.
    """
    parts = F.size(F.split(F.col(text_col).cast("string"), "\n"))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).isNull(), 0).otherwise(parts).alias("n")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n").alias("n_lines"))
    lost = dropped_lines(docs, id_col, text_col).groupBy("doc_id", "pos").agg(F.min("near").alias("near")).groupBy("doc_id").agg(F.count_if(~F.col("near")).alias("n_equal"), F.count_if(F.col("near")).alias("n_near"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    both = lines.join(lost, "doc_id", "left")
    return both.select("doc_id", zero("n_lines").alias("n_lines"), (zero("n_lines") - zero("n_equal") - zero("n_near")).alias("n_kept"), zero("n_equal").alias("n_equal"), zero("n_near").alias("n_near"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that go; a document that loses its last line goes too, all others stay.

    Rows with a null id, null or empty texts stay as they are; other columns go along, whatever their names.
    """
    columns = docs.columns
    lost = dropped_lines(docs, id_col, text_col).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("__lines_lost"))
    lost = common.materialize(lost.select(F.col("doc_id").alias("__lines_id"), F.col("row").alias("__lines_row"), "__lines_lost"))
    few = (lost.agg(F.sum(F.size("__lines_lost") + 4)).first()[0] or 0) <= 2_000_000  # numbers in all
    text = F.col(text_col).cast("string")
    marked = docs.join(F.broadcast(lost) if few else lost, (F.col(id_col) == F.col("__lines_id")) & (F.xxhash64(text) == F.col("__lines_row")), "left")
    marked = marked.withColumn("__lines_parts", F.when(F.col("__lines_lost").isNotNull(), F.split(text, "\n")))
    before = "if(i = 0, -1, get(__lines_lost, i - 1))"
    kept = F.expr(f"flatten(transform(sequence(0, size(__lines_lost)), i -> slice(__lines_parts, {before} + 2, if(i = size(__lines_lost), size(__lines_parts), get(__lines_lost, i)) - {before} - 1)))")
    marked = marked.withColumn(text_col, F.when(F.col("__lines_lost").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    return marked.where(F.col("__lines_lost").isNull() | F.col(text_col).rlike(r"\S")).select(columns)
