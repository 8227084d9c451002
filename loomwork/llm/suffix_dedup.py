"""Removal of repeated passages by a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of a
smaller id, or before in the same one.  Strings are judged on the input.

Suffixes are dealt to tasks so that equal strings of ``length`` bytes meet: each such string has one
anchor, its k-byte stretch of least hash (the leftmost of equals), and consecutive strings with the
same anchor form a segment, so a document of n bytes has about 2n/(length-k+2) segments.

1. Each input partition cuts its documents into segments.  Of segments with the same content it sends
   on the earliest only; the others are repeats.  What travels is the anchor's hash, the
   segment's whole 64-bit hash and its place.  Content is equal when both hashes are; bytes aren't compared.
2. By anchor: one that occurs once holds no repeat.  Of segments with the same content all but the
   earliest are repeats.  Those left, where an anchor has segments of different content, are
   *open*: only parts of them can match.
3. Open segments get their bytes from the documents and go to tasks by anchor.  There each batch of
   segments becomes a suffix array over all strings in it, in the order of their bytes (cut at ``length`` bytes,
   which is all that a match of that length can see).  It is merge-scanned against the existing levels, where bytes
   decide what is equal, and what is new becomes a level; levels of the same size class merge, so there are O(log n) of them.
   The segments of an anchor with more than HOT open segments are dealt out further: by the distance between a
   string's start and its anchor, in steps of STEP, and by a hash of the bytes that all strings of a step
   have in common.  Both are the same in equal strings.
4. Repeats are joined with the documents by id and cut out.

Results for special cases: null texts count as empty; texts shorter than ``length`` lose nothing; a
null doc_id sorts before all others; rows that repeat a doc_id share its places, so they don't
make repeats of each other; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialize, release, rows_of, ship, spread
from .rolling import Rolling, mix, sliding_min

NONE = -(1 << 63)
#: Bytes of an anchor.
ANCHOR = 32
#: A long text is cut into blocks of so many string starts.
BLOCK = 1 << 20
#: Bytes of text whose segments an input partition folds at a time.
FOLD_BYTES = 24 << 20
#: Open segments of one anchor above which they are dealt out by distance.
HOT, STEP = 2000, 8
#: Segments whose strings make one batch of suffixes.
BATCH_STRINGS = 1 << 19

WIRE = np.dtype([("h", "<u8"), ("s", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("n", "u1"), ("off", "u1")])


# ---------------------------------------------------------------- segments


def segments(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, number of strings, distance to the anchor, anchor hash and content hash of each segment.

    valid: which starts of strings count (those that don't cross the end of a document).
    """
    roll = Rolling(data)
    anchors = roll.all(ANCHOR)
    where = np.arange(len(anchors), dtype=np.uint64)
    least = sliding_min((anchors & np.uint64(0xFFFFFFFF00000000)) | where, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)
    least = least.astype(np.int64)[: len(valid)]
    start = np.flatnonzero(valid)
    own = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    at, anchor = start[first], own[first]
    content = mix(roll.of(at, n + (length - 1)) + n.astype(np.uint64))
    return at, n, anchor - at, anchors[anchor], content


def _blocks(docs: Iterator[tuple[int, bytes]], length: int):
    """Lists of (id, place, bytes): whole documents, or blocks of long ones with what their last strings need."""
    held, total = [], 0
    for doc_id, text in docs:
        for at in range(0, max(len(text) - length + 1, 0), BLOCK):
            part = text[at : at + BLOCK + length - 1]
            held.append((doc_id, at, part))
            total += len(part)
            if total >= 1 << 19:
                yield held
                held, total = [], 0
    if held:
        yield held


def _cut(batches, length: int, buckets: int):
    """Rows (bucket, kind, ids, data): kind 0 holds segments, kind 1 repeats found within the partition."""
    release()

    def flush(found, ids):
        doc = np.concatenate([f[0] for f in found])
        at, n, off, h, s = (np.concatenate([f[k] for f in found]) for k in range(1, 6))
        ids = np.array(ids, np.int64)
        order = np.lexsort((at, ids[doc]))
        order = order[np.argsort((h ^ s)[order], kind="stable")]
        doc, at, n, off, h, s = (x[order] for x in (doc, at, n, off, h, s))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
        repeat = elsewhere(again, ids[doc], at)
        for start, end, own in _spans(ids[doc[repeat]], at[repeat], at[repeat] + n[repeat] + length - 1):
            yield 0, 1, None, np.stack([own, start, end]).astype("<i8").tobytes()
        doc, at, n, off, h, s = (x[~again] for x in (doc, at, n, off, h, s))
        out = np.empty(len(h), WIRE)
        out["h"], out["s"], out["at"], out["n"], out["off"] = h, s, at, n, off
        bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        out, bucket, doc = out[order], bucket[order], doc[order]
        ends = np.flatnonzero(np.diff(bucket)) + 1
        for part, d, b in zip(np.split(out, ends), np.split(doc, ends), np.split(bucket, ends)):
            if len(part):
                used, part["doc"] = np.unique(d, return_inverse=True)
                yield int(b[0]), 0, ids[used].astype("<i8").tobytes(), part.tobytes()

    def rows():
        found, ids, number, total = [], [], {}, 0

        def docs():
            for doc_id, text in rows_of(batches):
                yield NONE if doc_id is None else doc_id, text or b""

        for held in _blocks(docs(), length):
            data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
            sizes = np.array([len(p) for _, _, p in held])
            begin = np.cumsum(sizes) - sizes
            valid = np.ones(len(data) - length + 1, bool)
            for b in begin[1:]:
                valid[max(b - length + 1, 0) : b] = False
            at, n, off, h, s = segments(data, valid, length)
            part = np.searchsorted(begin, at, "right") - 1
            base = np.array([a for _, a, _ in held])
            own = []
            for doc_id, _, _ in held:
                if doc_id not in number:
                    number[doc_id] = len(ids)
                    ids.append(doc_id)
                own.append(number[doc_id])
            found.append((np.array(own)[part], at - begin[part] + base[part], n, off, h, s))
            total += len(data)
            if total >= FOLD_BYTES:
                yield from flush(found, ids)
                found, ids, number, total = [], [], {}, 0
        if found:
            yield from flush(found, ids)

    return batched(rows(), pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]), lambda r: len(r[3]) + len(r[2] or b""))


def elsewhere(again: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the entries that equal their predecessor lie at another place than the first of their run."""
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again)))) if len(again) else again
    return again & ((doc != doc[first]) | (at != at[first]))


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Merged stretches of each document, as arrays (start, end, doc) in parts of bounded size."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # the running maximum of ends within a document, by a shift that keeps documents apart
    group = np.cumsum(np.append(0, (doc[1:] != doc[:-1]).astype(np.int64)))
    shift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    start, end, doc = start[first], reach[last] - shift[last], doc[first]
    for k in range(0, len(doc), 1 << 16):
        yield start[k : k + (1 << 16)], end[k : k + (1 << 16)], doc[k : k + (1 << 16)]


# ---------------------------------------------------------------- by anchor

JUDGED_SQL = "doc_id long, start long, end long, anchor long, core int"


def _batch(doc, start, end, anchor=None, core=None) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(x, np.int64)) for x in (doc, start, end)]
    columns.append(pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)))
    columns.append(pa.nulls(len(doc), pa.int32()) if core is None else pa.array(core.astype(np.int32)))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "anchor", "core"])


def _judge(batches, length: int, hot: int):
    """Repeats (anchor null) and open segments (the key under which they meet in anchor; core: where the bytes begin that decide further)."""
    release()
    wires, docs = [], []
    for _, kind, ids, data in rows_of(batches):
        if kind == 1:
            own, start, end = np.frombuffer(data, "<i8").reshape(3, -1)
            yield _batch(own, start, end)
        else:
            part = np.frombuffer(data, WIRE)
            wires.append(part)
            docs.append(np.frombuffer(ids, "<i8")[part["doc"]])
    if not wires:
        return
    wire, doc = np.concatenate(wires), np.concatenate(docs)
    del wires, docs
    # anchors that occur once go before anything is sorted by more than the hash
    order = np.argsort(wire["h"], kind="stable")
    h = wire["h"][order]
    same = h[1:] == h[:-1]
    order = order[np.append(False, same) | np.append(same, False)]
    wire, doc = wire[order], doc[order]
    order = np.lexsort((wire["at"], doc, wire["s"], wire["h"]))
    wire, doc = wire[order], doc[order]
    h, s, at, n = wire["h"], wire["s"], wire["at"].astype(np.int64), wire["n"].astype(np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
    repeat = elsewhere(again, doc, at)
    for start, end, own in _spans(doc[repeat], at[repeat], at[repeat] + n[repeat] + length - 1):
        yield _batch(own, start, end)
    h, at, n, doc, off = (x[~again] for x in (h, at, n, doc, wire["off"].astype(np.int64)))
    if not len(h):
        return
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    size = np.repeat(size, size)
    plain = (size > 1) & (size <= hot)
    yield from _parts(doc[plain], at[plain], at[plain] + n[plain], h[plain])
    often = np.flatnonzero(size > hot)
    if len(often):
        # strings at distance d from the anchor: d falls from off to off - n + 1 along the segment
        for d in range(0, length, STEP):
            near, far = np.maximum(off[often] - n[often] + 1, d), np.minimum(off[often], d + STEP - 1)
            some = often[near <= far]
            near, far = near[near <= far], far[near <= far]
            start = at[some] + off[some] - far
            yield from _parts(doc[some], start, start + far - near + 1, mix(h[some] + np.uint64(d + 1)), far - d)


def _parts(*columns):
    for k in range(0, len(columns[0]), 1 << 16):
        yield _batch(*(x[k : k + (1 << 16)] for x in columns))


# ---------------------------------------------------------------- suffix arrays


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that orders like them; zeros follow the end."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | pad[k : k + len(data)]
    return out


def suffix_order(words: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at start by their first ``length`` bytes, and whether each equals the one before it.

    Ranks by 8 bytes give ranks by 16, these by 32 and so on; the last step takes what overlaps.  Places
    in words whose strings reach into the next segment get ranks as well, which no valid start uses.
    """

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        own = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.append(False, own[1:] != own[:-1])).astype(np.uint64)
        return rank

    def joined(rank: np.ndarray, by: int) -> np.ndarray:
        return rank << np.uint64(32) | np.append(rank[by:], np.zeros(min(by, len(rank)), np.uint64))[: len(rank)]

    rank, depth = ranked(words), 8
    while 2 * depth <= length:
        rank, depth = ranked(joined(rank, depth)), 2 * depth
    key = joined(rank, length - depth)[start] if depth < length else rank[start]
    order = np.argsort(key, kind="stable")
    return order, np.append(False, key[order][1:] == key[order][:-1])[: len(order)]


class Level:
    """A suffix array: distinct strings in the order of their bytes, by their places in the level's words, and where the earliest of each starts."""

    def __init__(self, words: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int):
        self.words, self.at, self.doc, self.start, self.length = words, at, doc, start, length

    def __len__(self) -> int:
        return len(self.at)

    def compared(self, mine: np.ndarray, other: Level, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of entries: how the string of this level orders against the other's."""
        out, left = np.zeros(len(mine), np.int8), np.arange(len(mine))
        p, q = self.at[mine], other.at[theirs]
        for by in (*range(8, self.length - 8, 8), self.length - 8):
            x, y = self.words[p[left] + by], other.words[q[left] + by]
            differ = x != y
            out[left[differ]] = np.where(x[differ] < y[differ], -1, 1)
            left = left[~differ]
            if not len(left):
                break
        return out

    def search(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each string of the other level: how many of this level are smaller, and whether the next one equals it.

        Both are scanned in order by their first eight bytes; among equals of these a binary search goes on.
        """
        first, key = self.words[self.at], other.words[other.at]
        low, high = np.searchsorted(first, key, "left"), np.searchsorted(first, key, "right")
        found = np.zeros(len(key), bool)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            order = self.compared(middle, other, open_)
            found[open_[order == 0]] = True
            low[open_] = np.where(order < 0, middle + 1, np.where(order == 0, middle, low[open_]))
            high[open_] = np.where(order < 0, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low, found

    def only(self, some: np.ndarray) -> Level:
        return Level(self.words, self.at[some], self.doc[some], self.start[some], self.length)

    def merged(self, other: Level) -> Level:
        """Both levels, which have no string in common, in one."""
        to = self.search(other)[0] + np.arange(len(other))
        free = np.ones(len(self) + len(other), bool)
        free[to] = False

        def woven(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.empty(len(free), x.dtype)
            z[to], z[free] = y, x
            return z

        words = np.concatenate([self.words, other.words])
        return Level(words, woven(self.at, other.at + len(self.words)), woven(self.doc, other.doc), woven(self.start, other.start), self.length)


class SuffixFamily:
    """Suffix arrays in levels of falling size class.  Of equal strings only the earliest is held; every later one is reported by add()."""

    def __init__(self, length: int) -> None:
        self.length, self.levels = length, []

    def add(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A batch: its bytes, the places of its strings in them, and the document and place that each string comes from."""
        words = words_at(data)
        place = np.lexsort((start, doc))
        at, doc, start = at[place], doc[place], start[place]
        order, again = suffix_order(words, at, self.length)
        at, doc, start = at[order], doc[order], start[order]
        repeat = elsewhere(again, doc, start)
        yield doc[repeat], start[repeat]
        new = Level(words, at, doc, start, self.length).only(~again)
        for level in self.levels:
            if not len(new):
                return
            k, match = level.search(new)
            j, m = k[match], np.flatnonzero(match)
            ld, ls, nd, ns = level.doc[j], level.start[j], new.doc[m], new.start[m]
            later = (nd > ld) | (nd == ld) & (ns > ls)
            earlier = (nd < ld) | (nd == ld) & (ns < ls)
            yield nd[later], ns[later]
            yield ld[earlier], ls[earlier]
            level.doc[j[earlier]], level.start[j[earlier]] = nd[earlier], ns[earlier]
            new = new.only(~match)
        if not len(new):
            return
        while self.levels and len(self.levels[-1]).bit_length() <= len(new).bit_length():
            new = self.levels.pop().merged(new)
        self.levels.append(new)


def _scan(batches, length: int):
    """Open segments with their bytes to the stretches of their repeats."""
    release()
    family, dups, held, strings = SuffixFamily(length), [], [], 0

    def take():
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        size = np.array([len(x[2]) for x in held])
        n = size - length + 1
        begin = np.cumsum(size) - size
        k = np.repeat(np.arange(len(held)), n)
        inner = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        doc = np.array([x[0] for x in held], np.int64)[k]
        start = np.array([x[1] for x in held], np.int64)[k] + inner
        for d, a in family.add(data, begin[k] + inner, doc, start):
            if len(d):
                dups.append((d, a))

    for row in rows_of(batches):
        held.append(row)
        strings += len(row[2]) - length + 1
        if strings >= BATCH_STRINGS:
            take()
            held, strings = [], 0
    if held:
        take()
    if dups:
        doc, at = (np.concatenate([d[k] for d in dups]) for k in (0, 1))
        for start, end, own in _spans(doc, at, at + length):
            yield _batch(own, start, end)


# ---------------------------------------------------------------- documents

SPANS = "array<struct<start:bigint,end:bigint>>"


def _open_bytes(batches, length: int):
    release()

    def rows():
        for doc_id, text, spans in rows_of(batches):
            text = text or b""
            for x in spans:
                if x["end"] + length - 1 <= len(text):
                    key, part = x["key"], text[x["start"] : x["end"] + length - 1]
                    if x["core"] is not None:
                        key = xxhash.xxh3_64_intdigest(part[x["core"] : x["core"] + length - STEP + 1], key & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                    yield key, doc_id, x["start"], part

    yield from batched(rows(), pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("segment", pa.binary())]), lambda r: len(r[3]))


def merged(spans: list[dict] | None, limit: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], min(x["end"], limit)) for x in spans or ()):
        if end <= start:
            continue
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def left_of(text: bytes, spans: list[dict] | None) -> bytes:
    """The bytes outside the spans."""
    edges = [0, *(e for span in merged(spans, len(text)) for e in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _finish(batches, full: bool):
    release()

    def rows():
        for doc_id, text, spans in rows_of(batches):
            text = text or b""
            cut, kept = merged(spans, len(text)), left_of(text, spans)
            if doc_id == NONE:
                doc_id = None
            if full:
                yield doc_id, [{"start": a, "end": b} for a, b in cut], kept.decode("utf-8", "ignore")
            else:
                yield doc_id, len(text), sum(b - a for a, b in cut), len(cut), sha256(kept).hexdigest()

    if full:
        schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())])
        yield from batched(rows(), schema, lambda r: len(r[2]))
    else:
        yield from batched(rows(), pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id and the stretches of its repeats (start, end in bytes), which may touch or overlap; a null id is NONE here."""
    if length < ANCHOR + 1 or length - ANCHOR > 250:
        raise ValueError(f"length must be from {ANCHOR + 1} to {ANCHOR + 250}")
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * parts
    cut = spread(source.select(F.when(F.col("doc_id") != NONE, F.col("doc_id")), "text")).mapInArrow(lambda b: _cut(b, length, buckets), "bucket int, kind int, ids binary, data binary")
    judged = materialize(cut.repartition("bucket").mapInArrow(lambda b: _judge(b, length, hot), JUDGED_SQL), "judged")
    open_ = judged.where("anchor is not null").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("anchor").alias("key"), "start", "end", "core")).alias("spans"))
    strings = source.join(open_, "doc_id").select("doc_id", "text", "spans").mapInArrow(lambda b: _open_bytes(b, length), "key long, doc_id long, start long, segment binary")
    scanned = strings.repartition(parts, "key").select("doc_id", "start", "segment").mapInArrow(lambda b: _scan(b, length), JUDGED_SQL)
    every = judged.where("anchor is null").unionByName(scanned)
    return every.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 100, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """full: doc_id, spans, text (what is left; a character that was cut in part goes); else the digest

    doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left).
    """
    spans = repeated_spans(docs, length, id_col, text_col)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    joined = source.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    sql = f"doc_id long, spans {SPANS}, text string" if full else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(lambda b: _finish(b, full), sql)
