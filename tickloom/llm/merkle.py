"""Merkle manifest of a dataset as a postorder append log.

Leaves are digests of whole rows. Per language they ascend by doc_id and every
``FAN`` consecutive nodes become one, level by level, until one is left; the
languages' subroots become the root in the same way.

Leaves are numbered by ranges, so a language of any size is spread over all tasks.
Aligned builders then take ``FAN ** HEIGHT`` consecutive leaves each and append the
nodes of their subtree to a log in completion order: a node follows the last of its
children. Where a node lies in that log is a closed form of its level, its index and
the subtree's leaves (``position``), so nothing but digests is stored and proofs
address siblings directly. The builders' last nodes are the leaves of the next round,
until every tree has one builder; rounds grow with the logarithm of the rows.

Proofs go down again: a block's own proof, the same for all its leaves, is joined to
its log once, and the block's leaves add the siblings inside it.

Defined results: a null field is ``-``; a null language is a language of its own that
comes first, a null doc_id comes first in its language; rows that repeat a doc_id are
leaves each, ordered by digest; a lone leaf is its own subroot; an empty table gives an
empty table and no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, only, parts

FAN, HEIGHT = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "key binary, block long, size long, nodes binary, root binary"


def join_hash(children: list[bytes]) -> bytes:
    """H of nodes; digests are lowercase hex text."""
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def levels_of(leaves: int) -> int:
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // FAN), n + 1
    return n


@lru_cache(1 << 16)
def position(level: int, index: int, leaves: int, levels: int) -> int:
    """Place of a node in the log of a subtree of ``leaves`` leaves and ``levels`` levels above them.

    Before it lie the nodes of its own levels and below up to its last leaf, and the
    higher nodes that ended before its first leaf.
    """
    end = min(leaves, (index + 1) * FAN**level)
    return sum(-(-end // FAN**j) for j in range(level + 1)) - 1 + sum(index // FAN ** (j - level) for j in range(level + 1, levels + 1))


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes of a subtree in completion order."""
    log, open_ = [], [[] for _ in range(levels + 1)]

    def put(node: bytes, level: int) -> None:
        log.append(node)
        if level < levels:
            open_[level].append(node)
            if len(open_[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        put(join_hash(run), level + 1)

    for leaf in leaves:
        put(leaf, 0)
    for level in range(levels):  # the right edge: runs of fewer, even of one
        if open_[level]:
            close(level)
    return log


def siblings(log: list[bytes], leaf: int, leaves: int, levels: int) -> list[tuple[int, list[bytes]]]:
    """Per level: the node's place in its run and the run's other nodes, left to right."""
    out = []
    for level in range(levels):
        width, at = -(-leaves // FAN**level), leaf // FAN**level
        first = at // FAN * FAN
        out.append((at - first, [log[position(level, i, leaves, levels)] for i in range(first, min(first + FAN, width)) if i != at]))
    return out


def fold(node: bytes, proof: list[tuple[int, list[bytes]]]) -> bytes:
    for place, others in proof:
        node = join_hash([*others[:place], node, *others[place:]])
    return node


def pack(proof: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([place, len(others)]) + bytes.fromhex(b"".join(others).decode()) for place, others in proof)


def unpack(raw: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(raw):
        place, n = raw[at], raw[at + 1]
        out.append((place, [raw[at + 2 + 32 * i : at + 34 + 32 * i].hex().encode() for i in range(n)]))
        at += 2 + 32 * n
    return out


def nodes_of(raw: bytes) -> list[bytes]:
    text = raw.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def leaf_of(**changed: Column) -> Column:
    """Digest of a row, with some of its fields replaced."""
    said = []
    for name in FIELDS:
        value = changed.get(name, F.col(f"`{name}`")).cast("string")
        said += [F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))]
    return F.unhex(F.sha2(F.concat(*said).cast("binary"), 256))


def numbered(scratch: Scratch, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``at``, its number within ``key`` in ``order``, and ``size``, the rows of its key."""
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, key, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for k in batch.column(0).to_pylist():
                key, n = (key, n + 1) if k == key else (k, 0)
                local.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"])

    ranged = df.repartitionByRange(parts(df.sparkSession), F.col("key"), *order).sortWithinPartitions(F.col("key"), *order)
    stored = scratch.store(ranged.mapInArrow(count, schema), name)
    # one row per key and range it is in
    own = stored.groupBy("key", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key")
    base = own.select("key", "part", F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(w).alias("size"))
    return stored.join(base, ["key", "part"]).select(*df.columns, (F.col("base") + F.col("local")).alias("at"), "size")


def _build(extra: tuple[str, ...]):
    """Rows sorted by key, block and number: one log per block."""

    def run(batches):
        import pyarrow as pa

        types = {"ids": pa.list_(pa.int64()), "claims": pa.list_(pa.binary()), "names": pa.list_(pa.binary())}
        names = ["key", "block", "size", "nodes", "root", *extra]
        held, rest, now, size = [], [[] for _ in extra], None, 0

        def close():
            key, block = now
            log = append_log(held, HEIGHT if size > FAN**HEIGHT else levels_of(size))
            raw = bytes.fromhex(b"".join(log).decode())
            cols = [pa.array([key], pa.binary()), pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary()), pa.array([raw[-32:]], pa.binary())]
            return pa.RecordBatch.from_arrays([*cols, *[pa.array([x], types[n]) for n, x in zip(extra, rest, strict=True)]], names=names)

        for batch in batches:
            for key, block, n, digest, *more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, block) != now:
                    if now is not None:
                        yield close()
                    held, rest, now, size = [], [[] for _ in extra], (key, block), n
                held.append(digest.hex().encode())
                for x, y in zip(rest, more, strict=True):
                    x.append(y)
        if now is not None:
            yield close()

    return run


def blocks(scratch: Scratch, nodes: DataFrame, name: str, **extra: str) -> DataFrame:
    """Logs of aligned blocks of ``nodes`` (key, at, size, digest), with lists of extra columns: list name = column."""
    rows = nodes.select("key", F.floor(F.col("at") / FAN**HEIGHT).alias("block"), "size", "digest", *extra.values(), "at")
    dealt = rows.repartition(parts(nodes.sparkSession), "key", "block").sortWithinPartitions("key", "block", "at").drop("at")
    kinds = {"ids": "array<bigint>", "claims": "array<binary>", "names": "array<binary>"}
    return scratch.store(dealt.mapInArrow(_build(tuple(extra)), SEGMENT + "".join(f", {n} {kinds[n]}" for n in extra)), name)


def rounds(scratch: Scratch, nodes: DataFrame, name: str, **extra: str) -> list[DataFrame]:
    """The logs of all rounds; a tree ends in the round in which it has one block."""
    out = [blocks(scratch, nodes, f"{name}0", **extra)]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > FAN**HEIGHT:
        above = out[-1].where(F.col("size") > FAN**HEIGHT).select("key", F.col("block").alias("at"), F.ceil(F.col("size") / FAN**HEIGHT).alias("size"), F.col("root").alias("digest"))
        out.append(blocks(scratch, above, f"{name}{len(out)}"))
    return out


def subroots(logs: list[DataFrame]) -> DataFrame:
    found = [x.where(F.col("size") <= FAN**HEIGHT).select("key", "root") for x in logs]
    for x in found[1:]:
        found[0] = found[0].unionAll(x)
    return found[0]


@dataclass
class Manifest:
    """Logs of the languages' trees and of the tree over their subroots, round by round, and the root."""

    scratch: Scratch
    logs: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None


def build(docs: DataFrame, claim: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``claim`` is a leaf to be held against it later, null where it is the row's own."""
    scratch = Scratch(docs.sparkSession, "merkle")
    key = F.coalesce(F.concat(F.unhex(F.lit("01")), F.col("lang").cast("binary")), F.unhex(F.lit("")))  # null first, then bytewise
    leaves = only(docs, *FIELDS).select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("digest"), (F.lit(None).cast("binary") if claim is None else claim).alias("claim"))
    logs = rounds(scratch, numbered(scratch, leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest")], "leaves"), "log", ids="doc_id", claims="claim")
    scratch.drop("leaves")
    tops = subroots(logs).select(F.unhex(F.lit("")).alias("key"), F.col("key").alias("name"), F.col("root").alias("digest"))
    top = rounds(scratch, numbered(scratch, tops, [F.col("name")], "langs"), "top", names="name")
    root = subroots(top).first()
    return Manifest(scratch, logs, top, root and bytes(root["root"]))


def _down(named: bool):
    """A block's log and its own proof: the proof of each of its leaves, by name or by number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, block, size, nodes, subroot, path, names in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                log, rows = nodes_of(nodes), []
                levels = HEIGHT if size > FAN**HEIGHT else levels_of(size)
                leaves = min(size - block * FAN**HEIGHT, FAN**HEIGHT)
                for i in range(leaves):
                    own = pack(siblings(log, i, leaves, levels)) + path
                    digest = bytes.fromhex(log[position(0, i, leaves, levels)].decode())
                    rows.append((names[i], 0, digest, own) if named else (key, block * FAN**HEIGHT + i, subroot, own))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["key", "block", "subroot", "path"])

    return run


def _prove(root: bytes):
    """Per row: its leaf, the digest of its proof, and the root that its claim folds to."""
    root = root.hex().encode()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for size, block, nodes, subroot, path, ids, claims in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                log, above = nodes_of(nodes), unpack(path)
                levels = HEIGHT if size > FAN**HEIGHT else levels_of(size)
                tail = b"".join(b"".join(others) for _, others in above)
                out = []
                for i, (doc_id, claim) in enumerate(zip(ids, claims, strict=True)):
                    proof = siblings(log, i, len(ids), levels)
                    leaf = log[position(0, i, len(ids), levels)]
                    folded = fold(leaf if claim is None else claim.hex().encode(), proof + above)
                    said = hashlib.sha256(b"".join(b"".join(others) for _, others in proof) + tail).hexdigest()
                    out.append((doc_id, leaf.decode(), subroot.hex(), root.decode(), said, folded.decode(), folded == root))
                cols = list(zip(*out, strict=True))
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:6]], pa.array(cols[6], pa.bool_())], names=names)

    return run


def prove(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of the manifest."""
    scratch = manifest.scratch
    names = F.lit(None).cast("array<binary>").alias("names")

    def met(log: DataFrame, next_: DataFrame | None, whole: DataFrame) -> DataFrame:
        """Blocks with their own proofs: from the tree above where the tree ends here, else from the next round."""
        out = log.where(F.col("size") <= FAN**HEIGHT).join(whole, ["key", "block"])
        return out if next_ is None else out.unionAll(log.where(F.col("size") > FAN**HEIGHT).join(next_, ["key", "block"]))

    def down(blocks_: DataFrame, named: bool, name: str) -> DataFrame:
        below = blocks_.select("key", "block", "size", "nodes", "subroot", "path", "names" if named else names)
        return scratch.store(below.mapInArrow(_down(named), "key binary, block long, subroot binary, path binary"), name)

    empty = F.unhex(F.lit(""))
    origin = manifest.top[-1].select("key", "block", F.lit(None).cast("binary").alias("subroot"), empty.alias("path"))
    next_ = None
    for i in range(len(manifest.top) - 1, -1, -1):
        next_ = down(met(manifest.top[i], next_, origin), i == 0, f"top_proofs{i}")
    whole, next_ = next_, None
    for i in range(len(manifest.logs) - 1, 0, -1):
        next_ = down(met(manifest.logs[i], next_, whole), False, f"proofs{i}")
    rows = met(manifest.logs[0], next_, whole).select("size", "block", "nodes", "subroot", "path", "ids", "claims")
    return rows.mapInArrow(_prove(manifest.root or b""), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered(text: str = "text") -> Column:
    """The leaf with A-Z of the text lowered, where 3 divides the crc32 of the decimal doc_id."""
    lowered = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_of(text=lowered))


def verified(docs: DataFrame) -> DataFrame:
    """Every row's proof, and whether its row, tampered with in a third of all cases, still folds to the root."""
    return prove(build(docs, tampered()))


#: DuckDB's form: crc32 from its polynomial, levels by recursion, siblings by level, the claim folded step by step
MERKLE_SQL = """
WITH RECURSIVE c AS (
    SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) % 3 = 0 AS hit
    FROM documents
), f AS (
    SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
    FROM documents
), l AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN hit THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS claim
    FROM f JOIN c USING (doc_id)
), n AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS size FROM l
), t AS (
    SELECT lang, 0 AS level, i, leaf AS h, size FROM n
    UNION ALL
    SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (size + 7) // 8 FROM t WHERE size > 1 GROUP BY lang, level, i // 8, size
), s AS (
    SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS size FROM t WHERE size = 1
), u AS (
    SELECT 0 AS level, i, subroot AS h, size FROM s
    UNION ALL
    SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (size + 7) // 8 FROM u WHERE size > 1 GROUP BY level, i // 8, size
), p AS (
    SELECT doc_id, level AS step, n.i >> (3 * level) AS own, t.i, t.h
    FROM n JOIN t ON n.lang IS NOT DISTINCT FROM t.lang AND t.size > 1 AND t.i // 8 = n.i >> (3 * level + 3)
    UNION ALL
    SELECT doc_id, s.height + u.level, s.i >> (3 * u.level), u.i, u.h
    FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang JOIN u ON u.size > 1 AND u.i // 8 = s.i >> (3 * u.level + 3)
), g AS (
    SELECT doc_id, 0 AS step, coalesce(claim, leaf) AS h FROM n
    UNION ALL
    SELECT g.doc_id, g.step + 1, sha256(string_agg(CASE WHEN p.i = p.own THEN g.h ELSE p.h END, '' ORDER BY p.i))
    FROM g JOIN p ON p.doc_id = g.doc_id AND p.step = g.step GROUP BY g.doc_id, g.step
), o AS (SELECT doc_id, arg_max(h, step) AS folded FROM g GROUP BY doc_id),
q AS (SELECT doc_id, string_agg(h, '' ORDER BY step, i) FILTER (WHERE i <> own) AS others FROM p GROUP BY doc_id)
SELECT n.doc_id, leaf, subroot, r.h AS root, sha256(coalesce(others, '')) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang JOIN o USING (doc_id) LEFT JOIN q USING (doc_id) CROSS JOIN (SELECT h FROM u WHERE size = 1) r
"""
