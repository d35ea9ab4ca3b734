"""Repeated byte strings by a sparse suffix array with deep-shallow sorting.

A string of ``length`` bytes that starts at two places is cut from both. To find
them, every window of that length is named by the least hash of its k-byte grams:
equal windows have equal names, and neighbouring windows mostly share one, so a
text becomes few runs of windows with one name. Only runs whose name
occurs twice matter. Their bytes are taken from the texts, equal runs are merged before the
shuffle, and runs with one name meet in a task, which sorts their suffixes:

* shallow: multikey quicksort on eight-byte keys down to ``SHALLOW`` bytes, all
  groups of a level at once; a suffix alone in its group is unique;
* deep: a blind trie orders each remaining group on its first ``length`` bytes.
  A suffix descends by the branching bytes only, is compared with the leaf it
  reaches, and either joins that leaf (an equal string) or splits the path where
  the two differ.

A name with very many different runs is dealt over several tasks by content; each
settles its part, and strings not yet matched there (and one of each matched kind)
then meet by a 128-bit digest, one row per string.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing;
matches never cross documents but do count within one, overlaps included; rows
that repeat a document are copies of it; a null doc_id is a document like any
other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, identified, only, parts
from tickloom.llm.exact_dedup import shared_prefix
from tickloom.llm.text import SLICE, binary, mix, powers

LENGTH, GRAM = 200, 64
#: windows of a run at most, bytes compared by the shallow sort, runs of one name per task, bytes sorted at once
LONGEST_RUN, SHALLOW, NAME_RUNS, SORT_BYTES = 256, 32, 2000, 4 << 20
#: bytes of distinct runs a task holds before it passes them on
HELD_BYTES = 16 << 20


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, from running extremes within blocks."""
    best = np.minimum if least else np.maximum
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max if least else 0, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window, weight) of the runs of a text, in pieces of bounded memory.

    The weight is 2 where the naming gram may occur twice in the run, as in periodic text, else 1.
    """
    windows, out = len(raw) - length + 1, []
    for at in range(0, windows, SLICE):
        part = raw[at : min(at + SLICE, windows) + length - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        width = length - gram + 1
        names = sliding(grams, width, True)
        cut = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        ends = np.concatenate((cut[1:], [len(names)]))
        pieces = -(-(ends - cut) // LONGEST_RUN)
        first = np.repeat(cut, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST_RUN
        last = np.minimum(first + LONGEST_RUN, np.repeat(ends, pieces)) - 1
        # a gram names some window if no window around it has a smaller name
        around = np.concatenate((np.zeros(width - 1, np.uint64), names, np.zeros(width - 1, np.uint64)))
        naming = np.flatnonzero(grams == sliding(around, width, False))
        again = np.concatenate(([0], np.cumsum(grams[naming[1:]] == grams[naming[:-1]]), [0]))
        lo, hi = np.searchsorted(naming, first), np.searchsorted(naming, last + width - 1, "right")
        weight = 1 + (again[hi - 1] > again[lo])
        out.append((names[first], first + at, last + at, weight))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    fields = [T.StructField(n, T.LongType()) for n in ("name", "d", "h")] + [T.StructField(n, T.IntegerType()) for n in ("first", "last", "weight")]
    schema = T.StructType(fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bodies, out, size = binary(batch.column(2)), [], 0
            for d, h, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies, strict=True):
                raw = np.frombuffer(body.as_buffer(), np.uint8)
                if len(raw) < length:
                    continue
                names, first, last, weight = runs_of(raw, length, gram)
                n = len(names)
                out.append((names.view(np.int64), np.full(n, d), np.full(n, h), first.astype(np.int32), last.astype(np.int32), weight.astype(np.int32)))
                size += n
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=schema.names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=schema.names)

    return keyed.mapInArrow(run, schema)


def _extract(joined: DataFrame, length: int) -> DataFrame:
    """Two kinds of rows: (digest, d, h, first) per run; (name, n, digest, body, copies) per distinct run of a task.

    Distinct runs are held until ``HELD_BYTES`` of them are, so equal ones leave the task as one.
    """
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("d", T.LongType()), T.StructField("h", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("name", T.LongType()), T.StructField("n", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("body", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        held: dict[bytes, list] = {}
        size = 0

        def rows(**columns):
            n = len(columns["digest"])
            return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), t) for name, t in zip(schema.names, kinds, strict=True)], names=schema.names)

        def flush():
            items = list(held.items())
            for i in range(0, len(items), 4096):
                part = items[i : i + 4096]
                yield rows(digest=[k for k, _ in part], **{c: [v[x] for _, v in part] for x, c in enumerate(("name", "n", "copies", "body"))})
            held.clear()

        for batch in batches:
            bodies = binary(batch.column(2))
            for i, (d, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                body, digests, firsts = bodies[i].as_py(), [], []
                for r in batch.column(3)[i].as_py():
                    text = body[r["first"] : r["last"] + length]
                    digest = hashlib.blake2b(text, digest_size=16).digest()
                    digests.append(digest), firsts.append(r["first"])
                    if digest in held:
                        held[digest][2] += 1
                    else:
                        held[digest] = [r["name"], r["n"], 1, text]
                        size += len(text)
                yield rows(digest=digests, d=[d] * len(digests), h=[h] * len(digests), first=firsts)
            if size > HELD_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return joined.mapInArrow(run, schema)


def blind_trie(buffer: bytes, places: list[int], length: int) -> list[list[int]]:
    """The places in the order of the strings of ``length`` bytes that start there; equal strings together.

    A node is [depth of its branching byte, children by that byte]; a leaf is (string, places).
    """
    root = None
    for p in places:
        s = buffer[p : p + length]
        if root is None:
            root = (s, [p])
            continue
        node = root
        while type(node) is list:
            kid = node[1].get(s[node[0]])
            node = kid if kid is not None else next(iter(node[1].values()))
        if node[0] == s:
            node[1].append(p)
            continue
        n = shared_prefix(node[0], s)
        other, parent, at = node[0][n], None, root
        while type(at) is list and at[0] < n:
            parent, at = at, at[1][s[at[0]]]
        if type(at) is list and at[0] == n:
            at[1][s[n]] = (s, [p])
            continue
        fork = [n, {other: at, s[n]: (s, [p])}]
        if parent is None:
            root = fork
        else:
            parent[1][s[parent[0]]] = fork
    out, stack = [], [root] if root is not None else []
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.append(node[1])
    return out


def deep_shallow(buffer: bytes, places: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffix places in order of their first ``length`` bytes, and a number that equal strings share."""
    raw = np.frombuffer(buffer + bytes(8), np.uint8)
    # the eight bytes from every place on as one big-endian key
    key = np.zeros(len(buffer), np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | raw[i : i + len(buffer)]
    order, group, open_ = places.copy(), np.zeros(len(places), np.int64), np.arange(len(places))
    for depth in range(0, min(shallow, length), 8):
        # groups lie side by side: sorting by (group, key) splits each into its runs of equal keys
        here = key[order[open_] + depth]
        if depth + 8 > length:
            here >>= np.uint64(8 * (depth + 8 - length))
        by = np.lexsort((here, group[open_]))
        order[open_], here = order[open_][by], here[by]
        fresh = np.concatenate(([True], (here[1:] != here[:-1]) | (group[open_][1:] != group[open_][:-1])))
        group[open_] = open_[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        alone = fresh & np.concatenate((fresh[1:], [True]))
        open_ = open_[~alone]
        if not len(open_):
            return order, group
    if shallow < length and len(open_):
        starts = np.flatnonzero(np.concatenate(([True], group[open_][1:] != group[open_][:-1])))
        sizes = np.diff([*starts, len(open_)])
        # a trie of two leaves is one comparison: all of them at once, eight bytes at a time
        left = starts[sizes == 2]
        a, b = order[open_[left]], order[open_[left + 1]]
        undecided, greater, equal = np.arange(len(left)), np.zeros(len(left), bool), np.ones(len(left), bool)
        for depth in range(shallow - shallow % 8, length, 8):
            x, y = key[a[undecided] + depth], key[b[undecided] + depth]
            if depth + 8 > length:
                x, y = (v >> np.uint64(8 * (depth + 8 - length)) for v in (x, y))
            differ = x != y
            greater[undecided[differ]], equal[undecided[differ]] = (x > y)[differ], False
            undecided = undecided[~differ]
        order[open_[left]], order[open_[left + 1]] = np.where(greater, b, a), np.where(greater, a, b)
        group[open_[left + 1]] = np.where(equal, open_[left], open_[left + 1])
        many = np.flatnonzero(sizes > 2)
        members = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in many]) if len(many) else np.zeros(0, np.int64)
        line, places_, groups_ = order[open_[members]].tolist(), [], []
        at = 0
        for first, size in zip(open_[starts[many]].tolist(), sizes[many].tolist(), strict=True):
            for same in blind_trie(buffer, line[at : at + size], length):
                groups_ += [first] * len(same)
                places_ += same
                first += len(same)
            at += size
        order[open_[members]], group[open_[members]] = places_, groups_
    return order, group


def settle(strings: list[bytes], copies: list[int], length: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """For each run, which of its windows occur elsewhere; and (run, window) of one of each matched kind."""
    sizes = np.array([len(s) - length + 1 for s in strings])
    starts = np.cumsum([0, *[len(s) for s in strings]])[:-1]
    owner = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    buffer = b"".join(strings)
    where = np.zeros(len(buffer), np.int64)
    places = starts[owner] + offset
    where[places] = np.arange(len(places))
    order, group = deep_shallow(buffer, places, length)
    number = where[order]
    fresh = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    count = np.add.reduceat(np.array(copies)[owner[number]], fresh)
    found = np.zeros(len(places), bool)
    found[number] = np.repeat(count > 1, np.diff([*fresh, len(number)]))
    kinds = number[fresh[count > 1]]
    return np.split(found, np.cumsum(sizes)[:-1]), list(zip(owner[kinds].tolist(), offset[kinds].tolist(), strict=True))


def spans(flags: np.ndarray) -> np.ndarray:
    """[first, last] of the runs of true flags, as rows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return np.stack([edge[::2], edge[1::2] - 1], axis=1)


def _sort(strings: DataFrame, length: int) -> DataFrame:
    """(digest, first, last, kind, window) rows: spans of matched windows (kind 0); for names dealt
    over several tasks also unmatched windows (kind 1) and one of each matched kind (kind 2), by content."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("window", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        held, alone, size, key, group = [], [], 0, None, []

        def admit():
            """Take over a whole name, equal runs of several tasks as one. One run that occurs several times needs no sorting."""
            nonlocal size, group
            if not group:
                return
            merged = {}
            for row in group:
                if row[1] in merged:
                    merged[row[1]][2] += row[2]
                else:
                    merged[row[1]] = list(row)
            group = list(merged.values())
            if len(group) == 1 and group[0][2] > 1 and group[0][4] == 1:
                alone.append((group[0][1], len(group[0][3]) - length))
            else:
                held.extend(group)
                size += sum(len(g[3]) for g in group)
            group = []

        def flush():
            texts = [h[3] for h in held]
            flags, kinds = settle(texts, [h[2] for h in held], length) if held else ([], [])
            out = ([], [], [], [], [])

            def put(*row):
                for column, value in zip(out, row, strict=True):
                    column.append(value)

            for digest, last in alone:
                put(digest, 0, last, 0, None)
            for (_, digest, _, text, salts), found in zip(held, flags, strict=True):
                for lo, hi in spans(found).tolist():
                    put(digest, lo, hi, 0, None)
                if salts > 1:
                    for w in np.flatnonzero(~found).tolist():
                        put(digest, w, w, 1, hashlib.blake2b(text[w : w + length], digest_size=16).digest())
            for i, w in kinds:
                if held[i][4] > 1:
                    put(held[i][1], w, w, 2, hashlib.blake2b(texts[i][w : w + length], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=schema.names)

        for batch in batches:
            for name, salt, salts, digest, copies, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, salt) != key:
                    admit()
                    if size >= SORT_BYTES or len(alone) > 100_000:
                        yield from flush()
                        held, size, alone = [], 0, []
                    key = (name, salt)
                group.append((name, digest, copies, body, salts))
        admit()
        yield from flush()

    n = parts(strings.sparkSession)
    dealt = strings.select("name", "salt", "salts", "digest", "copies", "body").repartition(n, "name", "salt").sortWithinPartitions("name", "salt")
    return dealt.mapInArrow(run, schema)


def _cut(joined: DataFrame, length: int, with_text: bool) -> DataFrame:
    fields = [T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept_text", T.BinaryType()), T.StructField("spans", T.ArrayType(T.LongType()))] * with_text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bodies, out = binary(batch.column(1)), tuple([] for _ in schema.names)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                body, rows = bodies[i].as_py(), batch.column(2)[i].as_py()
                kept, removed, gone = body, 0, []
                if rows:
                    last = 0
                    pieces = []
                    for lo, hi in sorted((r["lo"], r["hi"]) for r in rows):
                        hi += length
                        if gone and lo <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], hi)
                        else:
                            gone.append([lo, hi])
                    for lo, hi in gone:
                        pieces.append(body[last:lo])
                        last, removed = hi, removed + hi - lo
                    kept = b"".join([*pieces, body[last:]])
                for column, value in zip(out, (doc, len(body), removed, len(gone), hashlib.sha256(kept).hexdigest(), kept, [x for g in gone for x in g]), strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())), strict=False)], names=schema.names)

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, name_runs: int = NAME_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text, spans]) per row of ``docs`` (doc_id, text).

    ``spans`` lists start and end of each removed run. ``kept_text`` is bytes, as a cut may split a character.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "suffix")
    keyed = identified(only(docs, "doc_id", "text"))
    runs = scratch.store(_runs(keyed, length, gram), "runs")
    # stored, so that a very common name is one skewed side of a plain join
    names = scratch.store(runs.groupBy("name").agg(F.sum("weight").alias("n")).where("n > 1"), "names")
    shared = runs.join(names, "name")
    by_doc = shared.groupBy("d", "h").agg(F.collect_list(F.struct("name", "n", "first", "last")).alias("runs"))
    found = scratch.store(_extract(keyed.join(by_doc, ["d", "h"]).select("d", "h", "body", "runs"), length), "found")
    scratch.drop("runs")
    strings = found.where("body is not null").select("name", "n", "digest", "copies", "body")
    strings = strings.withColumn("salts", F.ceil(F.col("n") / name_runs).cast("int")).withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts")).cast("int"))
    matched = scratch.store(_sort(strings, length), "matched")
    # strings that their own task could not match: a digest seen in several tasks is a match
    across = matched.where("kind > 0").select("digest", "first", "last", "kind", "window")
    twice = across.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window")
    late = across.where("kind = 1").join(twice, "window").select("digest", "first", "last")
    spans_ = matched.where("kind = 0").select("digest", "first", "last").unionAll(late)
    spans_ = spans_.select("digest", F.col("first").alias("lo"), F.col("last").alias("hi"))
    ranges = found.where("body is null").select("digest", "d", "h", "first").join(spans_, "digest")
    ranges = ranges.groupBy("d", "h").agg(F.collect_list(F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))).alias("ranges"))
    ranges = scratch.store(ranges, "ranges")
    scratch.drop("found", "matched")
    bodies = identified(only(docs, "doc_id", "text")).join(ranges, ["d", "h"], "left")
    return _cut(bodies.select("doc_id", "body", "ranges"), length, with_text)
