import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup, minhash_dedup, near, paragraph_dedup, suffix_dedup, text


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(t, k=4):
    w = word_list(t)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def test_word_hashes_match_words():
    data = " Ab  cd\n\tAB x\x00y ".encode() + b"\xc3\xa9"
    hashes, starts, ends = text.word_hashes(data)
    assert [data[a:b] for a, b in zip(starts, ends)] == [b"Ab", b"cd", b"AB", b"x\x00y", b"\xc3\xa9"]
    assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == 4
    long = b" ".join([b"a" * 300_000, b"b", b"c" * 1_300_000, b"b", b"d" * 900_000])
    hashes, starts, _ = text.word_hashes(long)
    assert len(hashes) == 5 and hashes[1] == hashes[3] and starts[1] == 300_001


def test_exact_against_brute_force(docs, crowded, texts):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    expected = collections.Counter()
    for i, t in texts:
        ids = groups[t or ""]
        owner = max((x for x in ids if x is not None), default=None)
        expected[i, owner, len(ids), owner is None or i == owner, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    for frame in (docs, crowded):
        assert collections.Counter(tuple(r) for r in exact_dedup.exact_duplicates(frame).collect()) == expected
    least = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_duplicates(docs, largest=False).collect()}
    assert least[10] == 7 and least[5] == 4
    for limit in (1, 4000, exact_dedup.TRIE_BYTES):
        kept = exact_dedup.keep_owners(crowded, limit=limit)
        assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for _, t in texts})
    assert kept.columns == crowded.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [2, 3, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16]


def test_exact_trie_separates_equal_hashes_and_spills(docs, texts):
    rows = exact_dedup.exact_duplicates(docs, limit=2000, content_hash=F.lit(1).cast("long")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str)
    trie = exact_dedup.Trie(True, limit=3000)
    items = [f"{'p' * (i % 7)}{'q' * 400}{i % 50}".encode() for i in range(300)] + [b"", b"p"]
    for i, t in enumerate(items):
        trie.add(t, i, 1)
    assert trie.spilled
    got = {t: (o, n) for t, o, n in trie.items()}
    count = collections.Counter(items)
    assert got == {t: (max(i for i, x in enumerate(items) if x == t), n) for t, n in count.items()}


def test_minhash_against_brute_force(docs, crowded, texts):
    want = brute_components(texts)
    for frame in (docs, crowded):
        rows = minhash_dedup.near_duplicates(frame, k=4).collect()
        assert len(rows) == len(texts)
        for r in rows:
            if r["doc_id"] is not None:
                assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
        assert {(r["doc_id"], r["n_shingles"]) for r in rows} == {(i, len(shingles(t))) for i, t in texts}
    assert want[8] == 7 and want[9] == 9
    kept = minhash_dedup.keep_one(crowded)
    assert kept.columns == crowded.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"]} == {i for i, c in want.items() if i == c}


def test_minhash_chain_and_star(spark):
    """Copies that each differ from a centre, and a chain whose ends are unlike: one component each."""
    from tests.llm.conftest import words

    base = words(100, 9)
    rows = [(100, " ".join(base))]
    for i in range(40):
        w = list(base)
        for at in (2 * i % 90 + 3, (2 * i + 45) % 90 + 3):
            w[at] = f"z{i}"
        rows.append((101 + i, " ".join(w)))
    chain = words(300, 10)
    rows += [(200 + i, " ".join(chain[10 * i : 10 * i + 100])) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == brute_components(rows)


def test_posterior_bound():
    assert near.fewest(16, 0.8, 1e-6) < 8 and 70 < near.fewest(128, 0.8, 1e-6) < 90
    assert abs(near.posterior(0, 0, 0.8) - 0.2) < 1e-12
    assert paragraph_dedup.tune(0.8, 1e-3, 3) == 10


def test_empty_tables(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert paragraph_dedup.repeated_paragraphs(empty).count() == 0


def brute_repeats(texts, length):
    bodies = [(t or "").encode() for _, t in texts]
    seen = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = collections.Counter()
    for (doc, _), b in zip(texts, bodies):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        out[doc, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


def test_repeats_against_brute_force(docs, crowded, texts):
    want = brute_repeats(texts, 200)
    for frame, runs in ((docs, 2000), (crowded, 1)):  # one run per task: every name is dealt over several
        got = suffix_dedup.remove_repeats(frame, name_runs=runs).collect()
        assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert bytes(by[16]["kept_text"]) == b"" or by[16]["n_removed"] + len(by[16]["kept_text"]) == by[16]["n_bytes"]


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(1)
    buffer = bytes(rng.integers(97, 99, 400, dtype=np.uint8)) + b"ab" * 150 + b"x" * 120
    places = np.arange(len(buffer) - 40 + 1)
    order, group = suffix_dedup.deep_shallow(buffer, places, 40, shallow=8)
    strings = [buffer[p : p + 40] for p in order.tolist()]
    assert strings == sorted(buffer[p : p + 40] for p in places.tolist())
    assert all((strings[i] == strings[i + 1]) == (group[i] == group[i + 1]) for i in range(len(strings) - 1))


def test_paragraphs_find_lines_and_inner_passages(docs, crowded):
    for frame in (docs, crowded):
        rows = paragraph_dedup.repeated_paragraphs(frame).collect()
        assert {r["doc_id"] for r in rows} == {7, 8, 10, 11, 13, 15, 16, 9, None} or {7, 8, 10, 11, 13, 15, 16, None} <= {r["doc_id"] for r in rows}
        inner = [r for r in rows if r["doc_id"] == 16]
        assert inner and all(r["kind"] == "passage" and r["removed"] and r["cluster_id"] == 11 for r in inner)
        assert not {1, 2, 3, 4, 5, 6, 12, 14} & {r["doc_id"] for r in rows}
        first = [r for r in rows if r["doc_id"] == 11 and r["kind"] == "paragraph"]
        assert len(first) == 2 and not any(r["removed"] for r in first)


@pytest.mark.parametrize("lengths", [(51,), (80,), (300,)])
def test_pieces_share_every_run_of_51_words(lengths):
    from tests.llm.conftest import words

    for n in lengths:
        for seed in range(20):
            run = words(n, 50 + seed)
            hashes = []
            for side in (1, 2):
                w = words(70 + seed, 1000 * side + seed) + run + words(33, 2000 * side + seed)
                value = text.word_hashes(" ".join(w).encode())[0]
                hashes.append(set(paragraph_dedup.pieces(value, 26, 5)[1].tolist()))
            assert hashes[0] & hashes[1]


def test_blocks_find_links_between_components():
    """Units of several components meet in blocks; what joins two of them is found once, the rest is passed over."""
    minhash, rng = text.MinHash(128), np.random.default_rng(0)
    steps = near.batches_of(128, 16, 0.8, 1e-6)
    base = [np.unique(rng.integers(0, 1 << 62, 200, np.uint64)) for _ in range(3)]
    units = []
    for i in range(30):
        s = np.unique(np.concatenate([base[i % 3][5 * (i // 3) : 5 * (i // 3) + 150], rng.integers(0, 1 << 62, 3, np.uint64)]))
        units.append((i, i, True, minhash(s).tobytes(), s.tobytes()))
    links = near.meet(units, units, steps, 80)
    assert len(links) == 27 and all(a % 3 == b % 3 for a, b in links)
    assert near.meet([], units, steps, 80) == []
    assert near.meet(units[:1], [(1, 0, False, *units[0][3:])], steps, 80) == []
