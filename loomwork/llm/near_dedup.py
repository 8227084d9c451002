"""Near-duplicates by bottom-k sketches.

One hash function orders the shingles of a document; its sketch is the k smallest hashes.

1. Documents with equal shingle sets form a class; only its smallest doc_id goes on.
2. Inverted lists: neighbouring pairs of the first retained values are the keys (a single value of a
   passage that many documents share would tie all of them together; a pair of neighbours does so
   only where the documents agree around it).  For a similarity of 0.8 the chance that two sketches
   of 32 have no such pair in common is about 1e-9.
3. Lists of up to SMALL documents generate the pairs in them with their overlap, the number of
   lists in common.  Longer lists matter only to *heavy* documents, those with fewer than LIGHT keys in
   short lists or of their own: what is similar to a document with LIGHT such keys shares two of
   them but for a chance of about 5e-5, even if all that differs lies outside the passages that made the other
   lists long.  The heavy documents of a long list make a list that is treated by its new length.
4. In a list that is still long the most central document of each of PIVOTS shares of it is a pivot; every document is paired
   once with each distinct pivot of its lists.
5. The union sketch (the k smallest of both) estimates the similarity and drops clear misses.
6. Exact Jaccard on full shingle sets verifies, first the best partners of each document, then what
   still lies between different components.
7. Exact way for long lists: where documents of such a list are still in different components, those
   outside its largest component are compared with all of the list, block by block.  Sketches say which documents
   have a possible partner; sets verify, and a document is done with a component at the first link.
   Pairs never become rows, and a pair is judged in one list only.

No list is cut and no group meets in one task.  Results for special cases: a null or empty text (or
one of white space only) has an empty set and links with nothing; with fewer words than a shingle the
whole sequence is the shingle; repeated rows of a doc_id are rows of one document each; null
doc_ids link with nothing; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, drop_scratch, materialize, release, rows_of, ship, spread
from .components import components
from .rolling import mix
from .shingles import overlap, shingle_sets

SKETCH, INDEXED = 64, 32
NO_VALUE = np.uint64((1 << 64) - 1)
SMALL, LIGHT, PIVOTS = 64, 24, 8
#: Documents and shingles of one side of a block in the exact pass.
BLOCK, BLOCK_SHINGLES = 768, 1 << 21


def bottom(own: np.ndarray, k: int = SKETCH) -> np.ndarray:
    h = mix(own)
    return np.sort(h if len(h) <= k else np.partition(h, k - 1)[:k])


def estimate(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Jaccard similarity from the union sketch: of the k smallest values of both, the share that both hold."""
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    distinct = both[np.append(True, ~twice)]
    if len(distinct) > k:
        twice &= both[1:] <= distinct[k - 1]
        return int(twice.sum()) / k
    return int(twice.sum()) / max(len(distinct), 1)


def estimates(a: np.ndarray, many: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """estimate() of a with each row of many, whose sketches are filled up to k values with NO_VALUE."""
    both = np.concatenate([many, np.broadcast_to(a, (len(many), len(a)))], axis=1)
    both.sort(axis=1)
    value = both[:, 1:] != NO_VALUE
    twice = (both[:, 1:] == both[:, :-1]) & value
    distinct = 1 + np.cumsum(~twice & value, axis=1)
    return (twice & (distinct <= k)).sum(axis=1) / np.maximum(np.minimum(distinct[:, -1], k), 1)


def least_estimate(threshold: float, k: int = SKETCH) -> float:
    """Below it lies the estimate of a pair at the threshold with a chance of about 3e-5 (four standard deviations)."""
    return threshold - 4 * (threshold * (1 - threshold) / k) ** 0.5


def keys_of(sketch: np.ndarray) -> np.ndarray:
    v = sketch[:INDEXED]
    return mix(v[:-1] + mix(v[1:])) if len(v) > 1 else np.zeros(0, np.uint64)


def _signatures(batches, width: int):
    release()

    def rows():
        for doc_id, own in shingle_sets(rows_of(batches), width):
            yield doc_id, len(own), xxhash.xxh3_128_digest(own.tobytes()), bottom(own).tobytes()

    yield from batched(rows(), pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary())]), lambda r: len(r[3]))


def _postings(batches):
    for batch in batches:
        keys = [keys_of(np.frombuffer(s, np.uint64)) for s in batch.column(2).to_pylist()]
        times = [len(k) for k in keys]
        flat = pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([flat, *(pa.array(np.repeat(batch.column(k).to_numpy(), times)) for k in (0, 1))], names=["key", "rep", "n"])


def _estimated(batches, least: float):
    def rows():
        for a, b, x, y in rows_of(batches):
            e = estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
            if e >= least:
                yield a, b, e

    yield from batched(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("e", pa.float64())]))


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if num * max(len(x), len(y)) > den * min(len(x), len(y)):
        return False
    both = overlap(x, y)
    return den * both >= num * (len(x) + len(y) - both) and both > 0


def _verified(batches, width: int, num: int, den: int):
    """Rows by group, the pivot first: b, salt, role, a, text."""
    release()

    def rows():
        pivot, held = None, None
        for (b, salt, role, a), own in shingle_sets(((r[:4], r[4]) for r in rows_of(batches)), width):
            if role == 0:
                pivot, held = (b, salt), own
            elif pivot == (b, salt) and similar(own, held, num, den):
                yield a, b

    yield from batched(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _groups(rows, width: int):
    for key, own in itertools.groupby(rows, key=lambda r: r[:width]):
        yield key, list(own)


def _possible(batches, least: float):
    """Which documents of a pair of blocks have a partner that the sketches allow: rows (key, i, j, role, rep, comp, own, sketch)."""
    release()

    def rows():
        for (key, i, j), group in _groups(rows_of(batches), 3):
            left, right = ([r for r in group if r[3] == role] for role in (0, 1))
            if not left or not right:
                continue
            size = [len(r[7]) // 8 for r in right]
            flat = np.frombuffer(b"".join(r[7] for r in right), np.uint64)
            owner = np.repeat(np.arange(len(right)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            comps = np.array([r[5] for r in right])
            sketches = np.full((len(right), SKETCH), NO_VALUE)
            for k, r in enumerate(right):
                sketches[k, : size[k]] = np.frombuffer(r[7], np.uint64)
            used: set[int] = set()
            for r in left:
                own = np.frombuffer(r[7], np.uint64)
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                hits = np.concatenate([owner[a:b] for a, b in zip(lo, hi) if b > a] or [np.zeros(0, np.int64)])
                n = np.bincount(hits, minlength=len(right))
                some = np.flatnonzero((n >= 0.5 * least * len(own)) & (comps != r[5]))
                hit = False
                for k in some[estimates(own, sketches[some]) >= least].tolist():
                    if not (hit and k in used) and judged_here(key, r[6], right[k][6]):
                        used.add(k)
                        hit = True
                if hit:
                    yield key, i, j, 0, r[4], r[5], r[6], r[7]
            for k in sorted(used):
                yield (key, i, j, 1, *right[k][4:8])

    schema = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("role", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64()), ("own", pa.list_(pa.int64())), ("sketch", pa.binary())])
    yield from batched(rows(), schema, lambda r: 600)


def judged_here(key: int, a: list[int], b: list[int]) -> bool:
    """Pairs meet in each long list they share; the one with the smallest key judges them."""
    return min(set(a).intersection(b)) == key


def _block_links(batches, width: int, num: int, den: int, least: float):
    """Rows (key, i, j, role, rep, comp, own, sketch, text) by block to verified links."""
    release()

    def rows():
        for (key, _, _), group in _groups(rows_of(batches), 3):
            sets = dict(shingle_sets(((r[4], r[8]) for r in group), width))
            sketch = {r[4]: np.frombuffer(r[7], np.uint64) for r in group}
            by_comp = defaultdict(list)
            for r in group:
                if r[3] == 1:
                    by_comp[r[5]].append(r)
            joined: set[tuple[int, int]] = set()
            for r in (r for r in group if r[3] == 0):
                for comp, others in by_comp.items():
                    pair = min(comp, r[5]), max(comp, r[5])
                    if comp == r[5] or pair in joined:
                        continue
                    for o in others:
                        if judged_here(key, r[6], o[6]) and estimate(sketch[r[4]], sketch[o[4]]) >= least and similar(sets[r[4]], sets[o[4]], num, den):
                            yield r[4], o[4]
                            joined.add(pair)
                            break

    yield from batched(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def near_classes(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Documents link when den * intersection >= num * union of their sets of width-word shingles;
    component_id is the smallest doc_id that is reached by links; kept: doc_id is component_id.
    """
    spark = docs.sparkSession
    ship(spark)
    least = least_estimate(num / den)
    # a given number of partitions, which isn't lowered where few bytes make much work
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sig = materialize(spread(source).mapInArrow(lambda b: _signatures(b, width), "doc_id long, n long, set_key binary, sketch binary"), "signatures")
    filled = sig.where("n > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    postings = materialize(classes.select("rep", "n", "sketch").mapInArrow(_postings, "key long, rep long, n long"), "postings")
    sizes = materialize(postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    lists = materialize(postings.join(sizes, "key"), "lists")
    long_ = lists.where(F.col("size") > small)
    by_rep = long_.groupBy("rep").agg(F.first("n").alias("n"), F.collect_list(F.struct("key", "size")).alias("own"))
    heavy = by_rep.where(f"least(n, {INDEXED}) - 1 - size(own) < {LIGHT}")
    left_over = heavy.select("rep", "n", F.expr("aggregate(own, 0D, (a, x) -> a + log2(x.size))").alias("central"), F.explode("own.key").alias("key"))
    dense = materialize(left_over.join(left_over.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "dense")
    long_ = dense.where(F.col("size") > small)

    # overlaps from short lists, pivots from long ones
    alike = f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)"
    short = lists.unionByName(dense.select(*lists.columns)).where(F.col("size") <= small)
    short = short.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("r"))
    pairs = (
        short.select(F.posexplode("r").alias("k", "y"), "r").where(F.expr("k + 1 < size(r)"))
        .select("y", F.explode(F.expr(f"filter(slice(r, k + 2, size(r)), x -> {alike})")).alias("x"))
        .groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("x.n", "y.n")).alias("n"))
        .where(f"shared >= greatest(1, least(n, {INDEXED}) div 16)").select("a", "b")
    )
    share = F.expr(f"pmod(hash(rep), {PIVOTS})").alias("share")
    pivots = long_.groupBy("key", share).agg(F.max_by(F.struct("rep", "n"), F.struct("central", -F.col("rep"))).alias("pivot"))
    pivots = materialize(pivots.groupBy("key").agg(F.collect_list("pivot").alias("pivots")), "pivots")
    stars = long_.join(pivots, "key").groupBy("rep").agg(F.first("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("pivots"))).alias("pivots"))
    stars = stars.select(F.struct("rep", "n").alias("x"), F.explode("pivots").alias("y")).where(f"x.rep <> y.rep and {alike}")
    stars = stars.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b"))
    sketch = classes.select("rep", "sketch")
    judged = (
        pairs.unionByName(stars).distinct()
        .join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(lambda b: _estimated(b, least), "a long, b long, e double")
    )
    judged = materialize(judged, "candidates")

    # whole texts of all documents that can take part from here on
    needed = judged.select(F.col("a").alias("doc_id")).unionByName(judged.select(F.col("b").alias("doc_id"))).unionByName(long_.select(F.col("rep").alias("doc_id"))).distinct()
    # joins with texts are merge joins at every size
    texts = materialize(source.join(needed.hint("merge"), "doc_id", "left_semi"), "texts")

    def verify(edges: DataFrame, name: str) -> DataFrame:
        salts = edges.groupBy("b").agg(F.ceil(F.count("*") / 256).cast("int").alias("s"))
        salted = edges.join(salts, "b").select("a", "b", F.expr("cast(pmod(hash(a), s) as int)").alias("salt"))
        members = salted.select("b", "salt", F.lit(1).alias("role"), "a")
        heads = salted.select("b", "salt").distinct().select("b", "salt", F.lit(0).alias("role"), F.col("b").alias("a"))
        placed = members.unionByName(heads).join(texts.withColumnRenamed("doc_id", "a").hint("merge"), "a").select("b", "salt", "role", "a", "text")
        placed = placed.repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "role")
        return materialize(placed.mapInArrow(lambda x: _verified(x, width, num, den), "a long, b long"), name)

    def across(edges: DataFrame, found: DataFrame) -> DataFrame:
        """The edges between different components."""
        c = found.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        d = found.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        return edges.join(c, "a", "left").join(d, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")

    best = judged.groupBy("a").agg(F.max_by("b", F.struct("e", -F.col("b"))).alias("b")).unionByName(
        judged.groupBy("b").agg(F.max_by("a", F.struct("e", -F.col("a"))).alias("a")).select("a", "b")
    )
    first = verify(best.distinct(), "links")
    found = materialize(components(first), "components")
    second = verify(across(judged, found).select("a", "b"), "links")
    links = first.unionByName(second)
    drop_scratch(found)
    found = materialize(components(links), "components")

    # long lists that still hold several components: those outside the largest against the whole list, in blocks
    comp = long_.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    by_comp = comp.groupBy("key", "comp").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    blocks_of = lambda count, n: F.ceil(F.greatest(count / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    tops = by_comp.groupBy("key").agg(F.max_by(F.struct("comp", "count", "n"), F.struct("count", -F.col("comp"))).alias("top"), F.count("*").alias("comps"), F.sum("count").alias("count"), F.sum("n").alias("n")).where("comps > 1")
    tops = tops.select("key", F.col("top.comp").alias("top"), blocks_of(F.col("count") - F.col("top.count"), F.col("n") - F.col("top.n")).alias("outer"), blocks_of(F.col("count"), F.col("n")).alias("blocks"))
    mixed = materialize(comp.join(tops, "key"), "mixed")
    rows = mixed.groupBy("rep").agg(F.first("comp").alias("comp"), F.collect_list(F.struct("key", "top", "outer", "blocks")).alias("lists")).join(sketch, "rep")
    rows = rows.select("rep", "comp", "sketch", F.expr("lists.key").alias("own"), F.inline("lists"))
    dealt = lambda blocks: F.expr(f"cast(pmod(hash(rep), {blocks}) as int)")
    every = lambda blocks: F.explode(F.expr(f"sequence(0, {blocks} - 1)"))
    left = rows.where("comp <> top").select("key", dealt("outer").alias("i"), every("blocks").alias("j"), F.lit(0).alias("role"), "rep", "comp", "own", "sketch")
    right = rows.select("key", every("outer").alias("i"), dealt("blocks").alias("j"), F.lit(1).alias("role"), "rep", "comp", "own", "sketch")
    blocks = "key long, i int, j int, role int, rep long, comp long, own array<long>, sketch binary"
    order = ("key", "i", "j")
    possible = left.unionByName(right).repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(lambda b: _possible(b, least), blocks)
    possible = materialize(possible, "possible")
    filled_blocks = possible.join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep").select(*possible.columns, "text").repartition(parts, *order).sortWithinPartitions(*order)
    more = materialize(filled_blocks.mapInArrow(lambda b: _block_links(b, width, num, den, least), "a long, b long"), "links")
    drop_scratch(found)
    found = materialize(components(links.unionByName(more)), "components")

    reached = materialize(classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component")), "reached")
    drop_scratch(classes, postings, sizes, lists, dense, pivots, judged, texts, first, second, mixed, possible, more, found)
    return (
        sig.select("doc_id", "n", F.when(F.expr("n > 0 and doc_id is not null"), F.col("set_key")).alias("set_key")).join(reached, "set_key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.expr("doc_id <=> component_id"))
    )
