"""Exact duplicates by Patricia tries.

Every scan task puts its rows' whole texts into a local trie first and passes on
one entry per distinct text, so a group of copies, however large, reaches the
shuffle as one entry per task. Entries are dealt by length and content hash; each
partition inserts the full byte strings into a compressed radix trie whose
terminal nodes hold the owner's id and the group's size. Where a trie outgrows
its memory bound, its largest subtree's strings go to a local spill file and are
settled on their own, below the prefix they share; strings are told apart by the
trie alone, never by the hash.

Defined results: a null text counts as empty; texts are compared as they are;
rows that repeat a doc_id with one text count each and get the same answer; rows
with a null doc_id count in their group's size and are never its owner unless
all are null (then keep_id is null and they stay); an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, only, parts

#: bytes of text a trie holds before a subtree is spilled
TRIE_BYTES = 32 << 20
#: bytes of whole rows a task weighs against each other at once
ROW_BYTES = 8 << 20


class Node:
    """A trie edge's label, its children by first byte, and, where a text ends, [owner, size]."""

    __slots__ = ("label", "kids", "end")

    def __init__(self, label: bytes, end=None):
        self.label, self.kids, self.end = label, {}, end


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def better(a, b, largest: bool):
    """The owner of two; null never beats an id."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


class Trie:
    def __init__(self, largest: bool, limit: int = TRIE_BYTES):
        self.root, self.largest, self.limit = Node(b""), largest, limit
        self.size, self.sizes, self.spilled, self.prefix = 0, {}, {}, {}

    def add(self, text: bytes, owner, count: int) -> None:
        if text and text[0] in self.spilled:
            self._write(text[0], text, owner, count)
            return
        node, at, grown = self.root, 0, 0
        while True:
            if at == len(text):
                if node.end is None:
                    node.end = [owner, count]
                else:
                    node.end[0] = better(node.end[0], owner, self.largest)
                    node.end[1] += count
                if grown:
                    self._grow(text[0], grown)  # last, as it may move the branch away
                return
            kid = node.kids.get(text[at])
            if kid is None:
                node.kids[text[at]] = Node(text[at:], [owner, count])
                self._grow(text[0], grown + len(text) - at + 200)
                return
            if text.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            n = shared_prefix(kid.label, text[at : at + len(kid.label)])
            middle = Node(kid.label[:n])
            kid.label = kid.label[n:]
            middle.kids[kid.label[0]] = kid
            node.kids[text[at]] = middle
            node, at, grown = middle, at + n, 200

    def _grow(self, branch: int, size: int) -> None:
        self.size += size
        self.sizes[branch] = self.sizes.get(branch, 0) + size
        while self.size > self.limit and self.sizes:
            self._spill(max(self.sizes, key=self.sizes.get))

    def _spill(self, branch: int) -> None:
        """Move a subtree's strings to a file; later strings of the branch follow them there."""
        self.spilled[branch] = tempfile.TemporaryFile(prefix="trie-")
        self.size -= self.sizes.pop(branch)
        kid = self.root.kids.pop(branch, None)
        if kid is not None:
            for text, owner, count in _walk(kid, b""):
                self._write(branch, text, owner, count)

    def _write(self, branch: int, text: bytes, owner, count: int) -> None:
        prefix = self.prefix.get(branch, text)
        self.prefix[branch] = prefix[: shared_prefix(prefix, text)]
        known = owner is not None
        self.spilled[branch].write(b"".join((len(text).to_bytes(8, "little"), (owner if known else 0).to_bytes(8, "little", signed=True), count.to_bytes(8, "little"), bytes([known]), text)))

    def items(self):
        """(text, owner, size) of every distinct text; spilled subtrees after the rest, one at a time."""
        yield from _walk(self.root, b"")
        self.root = Node(b"")
        for branch, handle in self.spilled.items():
            handle.seek(0)
            first = self.prefix[branch]
            below = Trie(self.largest, self.limit)
            while head := handle.read(25):
                text = handle.read(int.from_bytes(head[:8], "little"))
                # the subtree starts after the prefix that all its strings share
                below.add(text[len(first) :], int.from_bytes(head[8:16], "little", signed=True) if head[24] else None, int.from_bytes(head[16:24], "little"))
            handle.close()
            for text, owner, count in below.items():
                yield first + text, owner, count


def _walk(node: Node, before: bytes):
    stack = [(node, before)]
    while stack:
        node, before = stack.pop()
        text = before + node.label
        if node.end is not None:
            yield text, node.end[0], node.end[1]
        stack.extend((kid, text) for kid in node.kids.values())


_ENTRY = T.StructType([T.StructField("length", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("owner", T.LongType()), T.StructField("size", T.LongType())])
_OWNER = T.StructType([T.StructField("sha", T.BinaryType()), T.StructField("owner", T.LongType()), T.StructField("size", T.LongType())])


def _combine(largest: bool, limit: int):
    """Scan side: one entry per distinct text of a task, flushed whenever the trie is full."""

    def run(batches):
        import pyarrow as pa

        seen: dict[tuple[int, int], Trie] = {}
        held = 0

        def flush():
            length, hashes, body, owner, size = [], [], [], [], []
            for (n, h), trie in seen.items():
                for text, o, c in trie.items():
                    length.append(n), hashes.append(h), body.append(text), owner.append(o), size.append(c)
                    if len(body) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(hashes, pa.int64()), pa.array(body, pa.binary()), pa.array(owner, pa.int64()), pa.array(size, pa.int64())], names=_ENTRY.names)
                        length, hashes, body, owner, size = [], [], [], [], []
            if body:
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(hashes, pa.int64()), pa.array(body, pa.binary()), pa.array(owner, pa.int64()), pa.array(size, pa.int64())], names=_ENTRY.names)
            seen.clear()

        for batch in batches:
            ids, bodies, lengths, hashes = (batch.column(i) for i in range(4))
            for i, (doc, n, h) in enumerate(zip(ids.to_pylist(), lengths.to_pylist(), hashes.to_pylist(), strict=True)):
                trie = seen.get((n, h))
                if trie is None:
                    trie = seen[n, h] = Trie(largest, 1 << 62)
                    held += n + 600
                trie.add(bodies[i].as_py(), doc, 1)
            if held > limit:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _settle(largest: bool, limit: int):
    """Reduce side: the partition's trie over full byte strings."""

    def run(batches):
        import pyarrow as pa

        trie = Trie(largest, limit)
        for batch in batches:
            for body, owner, size in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                trie.add(body.as_py(), owner, size)
        sha, owners, sizes = [], [], []
        for text, owner, size in trie.items():
            if size > 1:  # a text that occurs once owns itself
                sha.append(hashlib.sha256(text).digest()), owners.append(owner), sizes.append(size)
            if len(sha) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(owners, pa.int64()), pa.array(sizes, pa.int64())], names=_OWNER.names)
                sha, owners, sizes = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(owners, pa.int64()), pa.array(sizes, pa.int64())], names=_OWNER.names)

    return run


def owners(docs: DataFrame, largest: bool = True, limit: int = TRIE_BYTES, content_hash: Column | None = None) -> DataFrame:
    """(sha, owner, size) of every text that two or more rows share."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), F.octet_length(body).cast("long").alias("length"), (F.xxhash64(body) if content_hash is None else content_hash).alias("hash"))
    entries = rows.mapInArrow(_combine(largest, limit), _ENTRY)
    return entries.repartition(parts(docs.sparkSession), "length", "hash").mapInArrow(_settle(largest, limit), _OWNER)


def exact_duplicates(docs: DataFrame, largest: bool = True, limit: int = TRIE_BYTES, content_hash: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs`` (doc_id, text).

    ``largest``: the row with the largest id stays, else that with the smallest.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    docs = only(docs, "doc_id", "text")
    shared = scratch.store(owners(docs, largest, limit, content_hash), "owners")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("sha"))
    out = rows.join(shared, "sha", "left")
    return out.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("owner")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("size").isNull() | F.col("owner").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("owner"), F.lit(False))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _owners_of(table, largest: bool):
    """Row numbers of the owners among a table's rows, and of those in the last row's bucket (length and hash)."""
    import pyarrow as pa

    ids, lengths, hashes = (table.column(name).to_pylist() for name in ("doc_id", "__length", "__hash"))
    buckets, tries = list(zip(lengths, hashes, strict=True)), {}
    for i, (doc, bucket, body) in enumerate(zip(ids, buckets, table.column("text").cast(pa.large_binary()), strict=True)):
        if bucket not in tries:
            tries[bucket] = Trie(True, 1 << 62)
        tries[bucket].add(body.as_py() or b"", (doc is not None, (doc if largest else -doc) if doc is not None else 0, i), 1)
    rows = {bucket: [owner[2] for _, owner, _ in trie.items()] for bucket, trie in tries.items()}
    return sorted(r for group in rows.values() for r in group), sorted(rows[buckets[-1]])


def _first_owners(largest: bool, limit: int):
    """Scan side: the owner's row of every text, over ``limit`` bytes of rows at a time."""

    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            held.append(batch)
            size += batch.nbytes
            if size > limit:
                table = pa.Table.from_batches(held)
                yield from table.take(pa.array(_owners_of(table, largest)[0])).to_batches()
                held, size = [], 0
        if held:
            table = pa.Table.from_batches(held)
            yield from table.take(pa.array(_owners_of(table, largest)[0])).to_batches()

    return run


def _last_owners(largest: bool):
    """Reduce side, rows sorted by bucket: a bucket that may go on is carried as its owners so far."""

    def run(batches):
        import pyarrow as pa

        carried = None
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            table = pa.Table.from_batches([*([] if carried is None else carried.to_batches()), batch])
            rows, last = _owners_of(table, largest)
            carried = table.take(pa.array(last))
            done = sorted(set(rows) - set(last))
            if done:
                yield from table.take(pa.array(done)).to_batches()
        if carried is not None:
            yield from carried.to_batches()

    return run


def keep_owners(docs: DataFrame, largest: bool = True, limit: int = ROW_BYTES) -> DataFrame:
    """``docs`` with one row of each text, its owner; all columns stay.

    The owner's whole row travels with its text, so the texts cross the network once.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.withColumns({"__length": F.octet_length(body).cast("long"), "__hash": F.xxhash64(body)})
    owned = rows.mapInArrow(_first_owners(largest, limit), rows.schema)
    dealt = owned.repartition(parts(docs.sparkSession), "__length", "__hash").sortWithinPartitions("__length", "__hash")
    return dealt.mapInArrow(_last_owners(largest), rows.schema).drop("__length", "__hash")
