"""Exact dedup by Grace hash partitioning.

Records go into an open-addressing table that compares complete contents.  What no longer fits
is dealt by further bits of the hash to spill files, and each file is treated the same way, so
the depth grows until every bucket fits.  It runs twice: in each input partition, so that copies
are folded before the shuffle (a group that holds a third of all rows sends one record from each
partition), and then over the records that share a hash bucket.

Of equal texts the row with the largest doc_id stays; of repeated rows of that id, one of them.

Results for special cases: a null text counts as empty, and all empty texts are one group; a null
doc_id sorts below every other, and repeated doc_ids are rows of their own; an empty table gives
no rows; further columns of the input, whatever their names, don't matter to the decision.
"""

from __future__ import annotations

import os
import pickle
import shutil
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batched, materialize, release, rows_of, ship, spread

HEAD = struct.Struct("<QqqqII")
#: Bytes of distinct contents that one table holds before the rest goes to spill files.
TABLE_BYTES = 64 << 20
FANOUT_BITS = 4
#: Bytes of a member in a table, besides what goes with it.
MEMBER_BYTES = 150
NONE = -(1 << 63)


#: Three numbers, and whatever else goes with them.
Member = tuple[int, int, int, bytes]
Record = tuple[int, bytes, Member]


class ContentTable:
    """Open addressing with linear probing; entries are found by hash and complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.states: list[list] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """The entry, or -1 and the free slot for it."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, at
            at = (at + 1) & mask
        return -1, at

    def add(self, h: int, content: bytes, at: int) -> int:
        e = self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.states.append([])
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for k, other in enumerate(self.hashes):
                at = other & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k
        return e


def listed(state: list, content: bytes, member: Member) -> int:
    """Holds every member; returns the bytes by which the state has grown."""
    state.append(member)
    return MEMBER_BYTES + len(member[3])


def largest(state: list, content: bytes, member: Member) -> int:
    """Holds the largest member only."""
    if not state:
        state.append(member)
        return MEMBER_BYTES + len(member[3])
    if member <= state[0]:
        return 0
    old, state[0] = state[0], member
    return len(member[3]) - len(old[3])


def grace(records: Iterable[Record], table_bytes: int = TABLE_BYTES, depth: int = 0, collect: Callable[[list, bytes, Member], int] = listed, each: Callable[[list, Member], tuple] | None = None) -> Iterator[tuple]:
    """(hash, content, member) records to (hash, content, state), each content once; collect puts a member into the state.

    The first contents fill the table; records of other contents go to one of 16 spill files by the
    next bits of their hash.  Each level takes in one content at least, so equal records can't recurse.
    What the states hold counts as bytes of the table too.  each: what it makes of a state and its
    newest member comes out at once, as (None, None, row).
    """
    table, files, folder = ContentTable(), None, None
    try:
        for h, content, member in records:
            e, at = table.find(h, content)
            if e < 0:
                if table.bytes > table_bytes:
                    if files is None:
                        folder = tempfile.mkdtemp(prefix="grace-")
                        files = [open(f"{folder}/{k}", "wb") for k in range(1 << FANOUT_BITS)]
                    f = files[(h >> (60 - FANOUT_BITS * (depth % 15))) & ((1 << FANOUT_BITS) - 1)]
                    f.write(HEAD.pack(h, *member[:3], len(content), len(member[3])))
                    f.write(content)
                    f.write(member[3])
                    continue
                e = table.add(h, content, at)
            table.bytes += collect(table.states[e], content, member)
            if each is not None:
                yield None, None, each(table.states[e], member)
        yield from zip(table.hashes, table.contents, table.states)
        del table
        for f in files or ():
            f.close()
            if os.path.getsize(f.name):
                yield from grace(_read(f.name), table_bytes, depth + 1, collect, each)
            os.remove(f.name)
    finally:
        for f in files or ():
            f.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while head := f.read(HEAD.size):
            h, a, b, c, n, more = HEAD.unpack(head)
            yield h, f.read(n), (a, b, c, f.read(more))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


FOLDED = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("rep", pa.int64()), ("sha", pa.string()), ("h", pa.int64()), ("n", pa.int64()), ("content", pa.binary())])
FOLDED_SQL = "doc_id long, place long, rep long, sha string, h long, n long, content binary"


def _counted(state: list, content: bytes, member: Member) -> int:
    """State: the first row's place, the number of rows, the row that would stay, the digest."""
    if not state:
        state += [member[1], 1, member[:2], sha256(content).hexdigest()]
        return MEMBER_BYTES + 250
    state[1] += 1
    state[2] = max(state[2], member[:2])
    return 0


def _fold(table_bytes: int, key: Callable[[bytes], bytes]) -> Callable:
    """A row for each row (n null), at once; and one for each content with the row that would stay and the number of rows."""

    def run(batches):
        release()
        base = TaskContext.get().partitionId() << 36

        def records():
            for k, (doc_id, content) in enumerate(rows_of(batches)):
                content = key(content or b"")
                yield xxhash.xxh3_64_intdigest(content), content, (NONE if doc_id is None else doc_id, base + k, 0, b"")

        def rows():
            for h, content, own in grace(records(), table_bytes, 0, _counted, lambda state, m: (m[0], m[1], state[0], state[3], None, None, None)):
                if content is None:
                    yield own
                else:
                    rep, n, (top, place), _ = own
                    yield top, place, rep, None, _signed(h), n, content

        yield from batched(rows(), FOLDED, lambda r: len(r[6] or b""))

    return run


MERGED = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_place", pa.int64())])


def _merge(table_bytes: int) -> Callable:
    """For each folded group the row that stays and the size of the whole group; a content has one folded group of a partition at most."""

    def run(batches):
        release()
        records = ((h & 0xFFFFFFFFFFFFFFFF, content, (top, place, n, rep.to_bytes(8))) for top, place, rep, h, n, content in rows_of(batches))

        def rows():
            for _, _, members in grace(records, table_bytes):
                (keep, place, *_), size = max(members), sum(m[2] for m in members)
                for m in members:
                    yield int.from_bytes(m[3]), None if keep == NONE else keep, size, place

        yield from batched(rows(), MERGED)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, key: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when key() makes the same bytes of their UTF-8 (unchanged by default).
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("content"))
    folded = materialize(spread(source).mapInArrow(_fold(table_bytes, key), FOLDED_SQL), "grace")
    merged = (
        folded.where("n is not null").select("doc_id", "place", "rep", "h", "n", "content").repartition("h")
        .mapInArrow(_merge(table_bytes), "rep long, keep_id long, group_size long, keep_place long")
    )
    return folded.where("n is null").select("doc_id", "place", "rep", "sha").join(merged, "rep").select(
        F.expr(f"nullif(doc_id, {NONE})").alias("doc_id"), "keep_id", "group_size", F.expr("place = keep_place").alias("kept"), F.col("sha").alias("text_sha256")
    )


# ---------------------------------------------------------------- whole rows


CANDIDATE = pa.schema([("h", pa.int64()), ("top", pa.int64()), ("place", pa.int64()), ("content", pa.binary()), ("row", pa.binary())])


def _candidates(table_bytes: int, key: Callable[[bytes], bytes], doc_id: int, text: int) -> Callable:
    """Of the rows of each content the one that would stay.  doc_id, text: places of these columns."""

    def run(batches):
        release()
        base = TaskContext.get().partitionId() << 36

        def records():
            for k, row in enumerate(rows_of(batches)):
                content = key((row[text] or "").encode())
                yield xxhash.xxh3_64_intdigest(content), content, (NONE if row[doc_id] is None else row[doc_id], base + k, 0, pickle.dumps(row))

        def rows():
            for h, content, [(top, place, _, row)] in grace(records(), table_bytes, collect=largest):
                yield _signed(h), top, place, content, row

        yield from batched(rows(), CANDIDATE, lambda r: len(r[3]) + len(r[4]))

    return run


def _winners(table_bytes: int, schema: pa.Schema) -> Callable:
    def run(batches):
        release()
        records = ((h & 0xFFFFFFFFFFFFFFFF, content, (top, place, 0, row)) for h, top, place, content, row in rows_of(batches))
        rows = (pickle.loads(own[0][3]) for _, _, own in grace(records, table_bytes, collect=largest))
        yield from batched(rows, schema, lambda r: sum(len(x) for x in r if isinstance(x, (str, bytes))))

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, key: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """The rows that exact_dedup() keeps, with all their columns; rows travel once, and only one of each content from each partition."""
    ship(docs.sparkSession)
    columns = [c.lower() for c in docs.columns]
    places = columns.index(id_col.lower()), columns.index(text_col.lower())
    found = spread(docs).mapInArrow(_candidates(table_bytes, key, *places), "h long, top long, place long, content binary, row binary")
    return found.repartition("h").mapInArrow(_winners(table_bytes, to_arrow_schema(docs.schema)), docs.schema)
