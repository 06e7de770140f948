"""Similarity join of documents on the Jaccard similarity of their word 5-grams, by banded MinHash.

Documents with equal sets of n-grams are one class and go on as one representative. Bands and rows are chosen for the
recall wanted at the threshold; representatives meet in the buckets of their bands. In each bucket all are verified
against its pivot, the one that most others meet, on their full n-gram sets. Buckets that this leaves in several
components are compared block by block; what the distances to the pivot rule out by the triangle inequality (Jaccard
distance is a metric) is left out. So every pair that shares a bucket is in one component, verified, or known to be
below the threshold.

Last, links are counted inside each component, over all its pairs, whatever buckets they share. A component beyond one
block is dealt into rings by the distance to its centre: pairs of rings that are surely linked are counted without
being compared, those surely not linked are left out, and only the rest is compared, block against block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 192
CHUNK_NGRAMS = 1 << 15
BLOCK_DOCS = 1024
BLOCK_NGRAMS = 1 << 17
RARE = 16
RINGS = 50  # in the whole range of distances
WORD_CACHE = 200_000
BROADCAST_ROWS = 200_000

_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Codes(dict):
    """The hash of each word, with a bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_codes = _Codes()


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false candidates) whose bands for the recall fit in ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct 48-bit hashes of the word n-grams of a text, words being what white space parts, in lower
    case. A text of fewer words has one n-gram, all its words; one without words has none."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ codes[k : len(words) - size + 1 + k]) * _MIX
        h ^= h >> np.uint64(32)
    return np.unique(h >> np.uint64(16))


def packed(grams: np.ndarray) -> bytes:
    """Six bytes for each hash."""
    return grams.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(grams: pa.Scalar) -> np.ndarray:
    out = np.zeros((len(grams.as_buffer()) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(grams.as_buffer(), np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def band_keys(sets: list[np.ndarray], bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """A row of band hashes for each set of n-grams (none empty): minima under multiplications by odd numbers modulo 2**32.
    Bands have different hashes of equal minima."""
    times = np.random.default_rng(seed).integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    flat = np.concatenate(sets).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.stack([np.minimum.reduceat(flat * t, starts) for t in times])
    h = np.repeat(np.arange(1, bands + 1, dtype=np.uint64), len(sets)).reshape(bands, -1)
    for r in range(rows):
        h = (h ^ least[r::rows]) * _MIX
        h ^= h >> np.uint64(32)
    return np.ascontiguousarray(h.T).view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int, seed: int = 5) -> DataFrame:
    """doc_id, row (as it comes), n (of n-grams), set_hash (binary; of the whole set) and bands (array of long; none of a text without words)."""

    def told(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(x) for x in sets], np.int32)
        full = [x for x in sets if len(x)]
        flat = band_keys(full, bands, rows, seed).ravel() if full else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), lists], names=["doc_id", "row", "n", "set_hash", "bands"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in it:
            sets, start, size = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                sets.append(shingles(text.as_py()))
                size += len(sets[-1])
                if size >= CHUNK_NGRAMS or k == len(batch) - 1:
                    yield told(batch.slice(start, k + 1 - start), sets)
                    sets, start, size = [], k + 1, 0
        _codes.clear()  # the worker goes on to other stages
        common.give_back()

    common.by_bytes(docs.sparkSession)
    return docs.select("doc_id", "text", "row").mapInArrow(batches, "doc_id long, row long, n int, set_hash binary, bands array<long>")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def gram_sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """rep, grams (the packed n-gram set) of the representatives ``asked`` (rep, set_hash), a written table; repeated rows may repeat."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, sets, size = [], [], 0
            for k, (i, text, known) in enumerate(zip(*batch.columns)):
                grams = shingles(text.as_py())
                if xxhash.xxh128_digest(grams.tobytes()) == known.as_py():  # an id may have other texts too
                    ids.append(i.as_py())
                    sets.append(packed(grams))
                    size += len(grams)
                if ids and (size >= 32 * CHUNK_NGRAMS or k == len(batch) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "grams"])
                    ids, sets, size = [], [], 0
        _codes.clear()
        common.give_back()

    return docs.join(_small(asked.withColumnRenamed("rep", "doc_id")), "doc_id").select("doc_id", "text", "set_hash").mapInArrow(batches, "rep long, grams binary")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (rep, pivot; a written table) with the similarity of their n-gram sets.

    The set of ``rep`` is shipped to its pivot; a pivot of many is split by the join like any skewed key.
    """

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = np.empty(len(batch))
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = unpacked(x), unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out[k] = both / (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["rep", "pivot", "similarity"])
        common.give_back()

    pivots = sets.join(_small(common.materialize(pairs.select(F.col("pivot").alias("rep")).distinct())), "rep", "left_semi")
    wide = sets.withColumnRenamed("grams", "x").join(_small(pairs), "rep").join(pivots.select(F.col("rep").alias("pivot"), F.col("grams").alias("y")), "pivot")
    return wide.select("rep", "pivot", "x", "y").mapInArrow(compare, "rep long, pivot long, similarity double").dropDuplicates(["rep", "pivot"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``left`` (rows) shares with each set of ``right``; sets are without repeats."""
    n, m = len(left), len(right)
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
    order = np.argsort(flat, kind="stable")  # so the owners of an n-gram ascend, those of the left first
    flat, owner = flat[order], owner[order]
    gram = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    often = np.bincount(gram) > RARE
    out = np.zeros(n * m, np.int64)
    at = often[gram]
    g, o = gram[~at], owner[~at]
    for step in range(1, RARE):  # n-grams of few sets, pair by pair
        k = np.flatnonzero(g[step:] == g[:-step])
        a, b = o[k], o[k + step]
        cross = (a < n) & (b >= n)
        out += np.bincount(a[cross] * m + b[cross] - n, minlength=n * m)
    out = out.reshape(n, m)
    g, o = (np.cumsum(often) - 1)[gram[at]], owner[at]
    for start in range(0, int(often.sum()), 2048):  # the others by products of matrices, exact in these numbers
        low, high = np.searchsorted(g, [start, start + 2048])
        has = np.zeros((n + m, 2048), np.float32)
        has[o[low:high], g[low:high] - start] = 1
        out += (has[:n] @ has[n:].T).astype(np.int64)
    return out


def _dealt(members: DataFrame, sets: DataFrame, label: str):
    """``members`` (of, i, j, root, rep, own) with their sets, grouped by the pair of blocks that they are compared in.

    A member's block is ``own``; it is compared in every pair (i, j) of blocks of ``of`` that has it. ``label`` is the
    key that tells apart what shares a group.
    """
    wide = sets.join(members.groupBy("rep").agg(F.collect_list(F.struct("of", "i", "j", "root", "own", F.col(label).alias("label"))).alias("places")), "rep")
    return wide.select("rep", "grams", F.explode("places").alias("p")).select("rep", "grams", "p.*").groupBy("of", "i", "j")


def _pieces(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids and roots of rows and of columns, whether they are the same, which pairs are links and the similarities, for each label."""
    labels, at_first = np.unique(np.stack([table.column("label").to_numpy(), table.column("rep").to_numpy()]), axis=1, return_index=True)
    roots, own = table.column("root").to_numpy()[at_first], table.column("own").to_numpy()[at_first]
    grams = table.column("grams").combine_chunks()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    for at in np.split(np.arange(labels.shape[1]), np.flatnonzero(np.diff(labels[0])) + 1):
        x, y = at[own[at] == i], at[own[at] == j]
        if not len(x) or not len(y) or i == j and len(x) < 2:
            continue
        left = [unpacked(grams[int(k)]) for k in at_first[x]]
        right = left if i == j else [unpacked(grams[int(k)]) for k in at_first[y]]
        both = shared_counts(left, right)
        similar = both / (np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right]) - both)
        fine = similar >= threshold - 1e-12
        if i == j:
            np.fill_diagonal(fine, False)
        yield labels[1][x], labels[1][y], roots[x], roots[y], i == j, fine, similar


def bridges(open_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between members of different components in each bucket of ``open_`` (key, rep, n, root), of which each
    pair of blocks tells as many as connect its components; its links are verified on the full sets."""
    sizes = open_.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_NGRAMS)).cast("int").alias("parts"), F.sum("n").alias("grams"))
    bins = 1 + int((open_.agg(F.sum("n")).first()[0] or 0) // BLOCK_NGRAMS)
    cut = F.col("parts") > 1
    members = open_.join(sizes, "key").withColumn("own", F.expr("pmod(xxhash64(rep), parts)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select(F.when(cut, F.col("key")).otherwise(F.expr(f"pmod(xxhash64(key), {bins})")).alias("of"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "root", "rep", "own", "key")

    def link(table: pa.Table) -> pa.Table:
        out = []
        for ids, others, roots, other_roots, _, fine, _ in _pieces(table, threshold):
            above: dict[int, int] = {}

            def top(i: int) -> int:
                while above.get(i, i) != i:
                    above[i] = i = above.get(above[i], above[i])
                return i

            for p, q in zip(*np.nonzero(fine & (roots[:, None] != other_roots))):
                u, v = top(int(roots[p])), top(int(other_roots[q]))
                if u != v:
                    above[u] = v
                    out.append((int(ids[p]), int(others[q])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(members, sets, "key").applyInArrow(link, "a long, b long")


def compared(nodes: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links: a < b, similarity; degrees: rep, degree, the number of its links) over all pairs of each component.

    ``nodes`` (rep, n, root, apart: the distance to the centre of its component, null if not known) is dealt by rings of
    distances and by hash into blocks of about ``BLOCK_DOCS`` representatives and ``BLOCK_NGRAMS`` n-grams; each pair of
    blocks is a group of its own. Components of one block share groups.
    """
    far = 1 - threshold
    nodes = nodes.withColumn("ring", F.coalesce(F.ceil(F.col("apart") * RINGS - 1e-9), F.lit(2 * RINGS)).cast("long"))  # at most ring / RINGS apart
    many = lambda docs, grams: F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(grams / BLOCK_NGRAMS)).cast("long")
    rings = nodes.groupBy("root", "ring").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams"))
    whole = rings.groupBy("root").agg(many(F.sum("docs"), F.sum("grams")).alias("blocks"))
    rings = common.materialize(rings.join(whole, "root").select("root", "ring", "docs", "blocks", F.when(F.col("blocks") > 1, many(F.col("docs"), F.col("grams"))).otherwise(1).alias("parts")))
    nodes = common.materialize(nodes.join(rings, ["root", "ring"]).select("rep", "n", "root", "ring", "blocks", F.when(F.col("blocks") > 1, F.col("ring") * 1_000_000_000 + F.expr("pmod(xxhash64(rep), parts)")).otherwise(0).alias("own")))
    bins = 1 + int((nodes.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // BLOCK_NGRAMS)
    single = nodes.where("blocks = 1").select(F.expr(f"-1 - pmod(xxhash64(root), {bins})").alias("of"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "root", "rep", "own")
    known = f"l.ring <= {RINGS} AND r.ring <= {RINGS}"
    sure = f"({known} AND l.ring + r.ring <= {far * RINGS + 1e-9})"
    never = f"({known} AND abs(l.ring - r.ring) - 1 > {far * RINGS + 1e-9})"
    blocks = rings.where("blocks > 1").select("root", "ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).withColumn("own", F.col("ring") * 1_000_000_000 + F.col("part"))
    pairs = blocks.alias("l").join(blocks.alias("r"), "root").where(f"NOT {never}").select("root", F.col("l.own").alias("own"), F.least("l.own", "r.own").alias("i"), F.greatest("l.own", "r.own").alias("j"), F.expr(sure).alias("sure"))
    cut = nodes.where("blocks > 1").join(pairs, ["root", "own"])
    placed = lambda rows: single.union(rows.select(F.col("root").alias("of"), "i", "j", "root", "rep", "own"))

    def link(table: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for x, y, _, _, same, fine, similar in _pieces(table, threshold):
            p, q = np.nonzero(np.triu(fine) if same else fine)
            out.append((np.minimum(x[p], y[q]), np.maximum(x[p], y[q]), similar[p, q]))
        return pa.table(dict(zip(("a", "b", "similarity"), map(np.concatenate, zip(*out)))))

    def count(table: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for x, y, _, _, same, fine, _ in _pieces(table, threshold):
            out.append((x, fine.sum(axis=1)))
            if not same:
                out.append((y, fine.sum(axis=0)))
        return pa.table(dict(zip(("rep", "degree"), map(np.concatenate, zip(*out)))))

    counted = rings.where("blocks > 1").alias("l").join(rings.alias("r"), "root").where(sure).groupBy("root", "l.ring").agg(F.sum("r.docs").alias("docs")).select("root", "ring", "docs")
    counted = nodes.join(counted, ["root", "ring"]).select("rep", (F.col("docs") - (2 * F.col("ring") <= far * RINGS + 1e-9).cast("int")).alias("degree"))
    degrees = _dealt(placed(cut.where("NOT sure")), sets, "root").applyInArrow(count, "rep long, degree long").union(counted)
    links = _dealt(placed(cut), sets, "root").applyInArrow(link, "a long, b long, similarity double")
    return links, degrees.groupBy("rep").agg(F.sum("degree").alias("degree"))


def _connected(docs: DataFrame, threshold: float, recall: float) -> dict[str, DataFrame]:
    """Of documents (doc_id, text, row): sketch; members (doc_id, set_hash, rep, copies); nodes (rep, n, root, apart) of
    linked representatives; sets (rep, grams) of those that share a bucket."""
    bands, rows = choose_bands(threshold, recall)
    sketch = common.materialize(sketches(docs, bands, rows))
    with_words = sketch.where("n > 0").groupBy("doc_id").agg(F.min(F.struct("set_hash", "n", "bands")).alias("s")).select("doc_id", "s.*")
    reps = with_words.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = common.materialize(reps)
    members = with_words.select("doc_id", "set_hash").join(reps.select("set_hash", "rep", "copies"), "set_hash")

    keys = reps.select("rep", "n", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = common.materialize(keys.join(sizes, "key"))
    central = common.materialize(placed.groupBy("rep").agg(F.sum("size").alias("met")))
    asked = common.materialize(reps.join(central, "rep", "left_semi").select("rep", "set_hash"))
    sets = common.materialize(gram_sets(docs, asked))
    pivots = placed.join(central, "rep").groupBy("key").agg(F.max(F.struct("met", "rep", "n")).alias("p")).select("key", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n"))
    spokes = common.materialize(placed.join(pivots, "key").where("rep <> pivot"))
    fits = f"least(n, pivot_n) >= {threshold - 1e-9} * greatest(n, pivot_n)"
    pairs = common.materialize(spokes.where(fits).select("rep", "pivot").distinct())
    near = common.materialize(similarities(pairs, sets))
    links = near.where(F.col("similarity") >= threshold - 1e-12)
    edges = links.select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    roots = connected_components(edges)

    # Buckets that hold several components besides the pivot, whose own pairs are known. Of the component with most members
    # there only those stay whose distance to the pivot lets them be near a member of another; so many n-grams apart at least
    # is one whose number of n-grams alone rules out a link to the pivot.
    least = F.lit(1.0) - F.least("n", "pivot_n") / F.greatest("n", "pivot_n")
    rooted = spokes.where("size > 2").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("part"))
    main = parts.groupBy("key").agg(F.max(F.struct("part", "root")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("m.root").alias("main"))
    open_ = rooted.join(main, "key").join(near, ["rep", "pivot"], "left").select("key", "rep", "n", "root", "main", F.when(F.col("similarity").isNull(), least).otherwise(1 - F.col("similarity")).alias("low"), F.when(F.col("similarity").isNull(), 1.0).otherwise(1 - F.col("similarity")).alias("high"))
    open_ = common.materialize(open_)
    reach = open_.where("root <> main").groupBy("key").agg((F.min("low") - (1 - threshold)).alias("from"), (F.max("high") + (1 - threshold)).alias("to"))
    open_ = common.materialize(open_.join(reach, "key").where("root <> main OR high >= from - 1e-9 AND low <= to + 1e-9").select("key", "rep", "n", "root"))
    found = common.materialize(bridges(open_, sets, threshold))
    if not found.isEmpty():
        roots = connected_components(edges.union(found))
    roots = common.materialize(roots)
    met = links.join(roots.withColumnRenamed("node", "pivot"), "pivot")
    centre = met.groupBy("root", "pivot").agg(F.count(F.lit(1)).alias("met")).groupBy("root").agg(F.max(F.struct("met", "pivot")).alias("c")).select("root", F.col("c.pivot").alias("pivot"))
    apart = near.join(centre, "pivot").select("root", "rep", (1 - F.col("similarity")).alias("apart")).union(centre.select("root", "pivot", F.lit(0.0)))
    nodes = roots.withColumnRenamed("node", "rep").join(reps.select("rep", "n"), "rep").join(apart, ["root", "rep"], "left")
    nodes = common.materialize(nodes.select("rep", "n", "root", "apart"))
    common.discard(placed, central, asked, spokes, pairs, near, open_, found, roots)
    return {"sketch": sketch, "members": members, "nodes": nodes, "sets": sets}


def _whole(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row")).where("doc_id IS NOT NULL")


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, classes) of the join.

    members: doc_id, rep (the smallest id with the same n-gram set). links: a < b (representatives), similarity. classes:
    doc_id, class_id (the smallest id of all that links connect), n_links (the links of its representative, plus the
    other documents of its set). Documents without words stay alone and rows without an id are left out; rows that share
    an id count as one document, with the set that comes first by its hash. Inside a component every pair is verified or known from the triangle
    inequality; links are compared anew each time they are read. Texts of any length are taken whole, other columns are
    ignored, empty tables give no rows.
    """
    docs = _whole(docs, id_col, text_col)
    made = _connected(docs, threshold, recall)
    members, nodes = made["members"], made["nodes"]
    links, degrees = compared(nodes, made["sets"], threshold)
    by_rep = nodes.select("rep", "root").join(degrees, "rep", "left")
    classes = members.join(by_rep, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = made["sketch"].groupBy("doc_id").agg(F.max("n").alias("n")).where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return members.select("doc_id", "rep"), links, classes.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those of a class but the one with the smallest id.

    Rows without an id or without words stay, as do other texts of an id that are not the one compared; rows that repeat
    an id and its text go or stay together. Other columns go along, whatever their names.
    """
    made = _connected(_whole(docs, id_col, text_col), THRESHOLD, RECALL)
    classes = made["members"].join(made["nodes"].select("rep", "root"), "rep", "left").where(F.coalesce("root", "rep") != F.col("doc_id"))
    gone = classes.select("doc_id", "set_hash").join(made["sketch"].select("doc_id", "row", "set_hash"), ["doc_id", "set_hash"]).select(F.col("doc_id").alias("__join_id"), F.col("row").alias("__join_row")).distinct()
    gone = common.materialize(gone)
    common.discard(made["sets"])
    same = (docs[id_col].cast("long") == F.col("__join_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__join_row"))
    return docs.join(_small(gone), same, "left_anti")
