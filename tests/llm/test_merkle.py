import collections
import hashlib
import random
import zlib

import pytest

from tests.llm.conftest import DOCS, EXTRA
from tickloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lowered=False):
    i, text, lang, source, n = row
    if lowered and text is not None:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def others(tree, at):
    """(index in the run, the run's other nodes) per level."""
    out = []
    for row in tree[:-1]:
        run = row[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return out


def brute(rows):
    by = collections.defaultdict(list)
    for row in rows:
        by[row[2]].append(row)
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in langs:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = levels([leaf(r) for r in by[k]])
    top = levels([trees[k][-1][0] for k in langs])
    out = collections.Counter()
    for at, k in enumerate(langs):
        for i, row in enumerate(by[k]):
            proof = others(trees[k], i) + others(top, at)
            node = leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0)
            for place, run in proof:
                node = h(*run[:place], node, *run[place:])
            out[row[0], leaf(row), trees[k][-1][0], top[-1][0], h(*[x for _, run in proof for x in run]), node, node == top[-1][0]] += 1
    return out


def answers(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_positions_are_those_of_the_log():
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 300, 511, 512):
        for up in {merkle.levels_of(n), 3}:
            log = merkle.append_log([h(str(i)).encode() for i in range(n)], up)
            rows = [[h(str(i)) for i in range(n)]]
            for _ in range(up):
                rows.append([h(*rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
            assert len(log) == sum(map(len, rows))
            for level, row in enumerate(rows):
                for i, node in enumerate(row):
                    assert log[merkle.position(level, i, n, up)].decode() == node


@pytest.fixture(scope="module")
def rows(texts):
    r = random.Random(3)
    out = [(i, t, None if i == 4 else ("en", "de", "日本", "")[(i or 0) % 4], None if i == 3 else "s", None if i == 2 else len(t or "")) for i, t in texts]
    out += [(1000 + i, f"Text {r.random()} Of {i}" if i % 50 else None, "fr", f"s{i % 3}", i) for i in range(1100)]  # three blocks of a language
    return out + [(5000 + i, f"A {i}", f"lang{i % 20}", "s", 1) for i in range(60)]  # more than eight subroots


def test_manifest_against_brute_force(spark, rows):
    want = brute(rows)
    assert {k[-1] for k in want} == {True, False}
    assert answers(merkle.verified(spark.createDataFrame(rows, DOCS).repartition(4))) == want
    crowded = spark.createDataFrame([(*r, *["?"] * 14) for r in rows], EXTRA)
    assert answers(merkle.verified(crowded)) == want


def test_small_manifests(spark, empty):
    assert merkle.verified(empty).collect() == [] and merkle.build(empty).root is None
    for n in (1, 2):
        rows = [(i, "Text", "en", None, None) for i in range(n)]
        assert answers(merkle.verified(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_many_languages(spark):
    rows = [(i, f"T {i}", ("en", "de", "en")[i % 3], "s", i) for i in range(130)] + [(500 + i, "x", f"l{i}", "s", i) for i in range(600)]
    frame = spark.createDataFrame(rows, DOCS)
    assert answers(merkle.verified(frame)) == brute(rows)
    assert [r["subroot"] for r in merkle.verified(frame).where("doc_id = 500").collect()] == [leaf((500, "x", "l0", "s", 0))]
