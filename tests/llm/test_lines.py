import collections
import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import DOCS, EXTRA
from tickloom.llm import line_index


def brute(rows, min_chars=40, min_docs=5):
    at = collections.defaultdict(list)
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for line in (t or "").split("\n")] for _, t in rows]
    for (i, _), own in zip(rows, keys, strict=True):
        for key in set(own):
            if len(key) >= min_chars:
                at[key].append(line_index.NO_ID if i is None else i)
    out = []
    for (i, t), own in zip(rows, keys, strict=True):
        d = line_index.NO_ID if i is None else i
        lines = (t or "").split("\n")
        left = [x for x, key in zip(lines, own, strict=True) if not (len(at[key]) >= min_docs and max(at[key]) != d)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return collections.Counter(out)


def answers(df):
    return collections.Counter(tuple(r)[:4] for r in df.collect())


def test_perfect_hash_numbers_without_gaps():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)
    counts, owners = np.arange(20_000), -np.arange(20_000)
    index = line_index.LineIndex.from_bytes(line_index.LineIndex.build(digests, counts + 1, owners).to_bytes())
    assert sorted(index.hashes(digests[:, 0].copy(), digests[:, 1].copy()).tolist()) == list(range(20_000))
    got = index.probe(digests)
    assert (got[0] == counts + 1).all() and (got[1] == owners).all()
    other = rng.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)
    assert not index.probe(other)[0].any()
    assert not line_index.LineIndex.build(digests[:0], counts[:0], owners[:0]).probe(other)[0].any()
    with pytest.raises(ValueError):
        line_index.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


@pytest.fixture(scope="module")
def pages(texts):
    r, pool = random.Random(4), [f"Line {i} of a pool of lines that are long enough to count, ÀÉ {i}" for i in range(60)]
    rows = [(100 + i, "\n".join(r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.3 and "À" not in x else x) + r.choice(["", " \r", "\x0b"]) for x in r.choices(pool, k=r.randrange(1, 9)))) for i in range(120)]
    # one line in most documents, at both ends of the length bound, kept lines that become empty, a null id that holds the line
    rows += [(300 + i, ("x" * 40) + "\n" + ("y" * 39) + "\n" + ("é" * 39) + f"\nown {i}") for i in range(90)] + [(400 + i, "Z" * 50) for i in range(5)] + [(None, "Z" * 50)]
    rows += [(500, "q" * 45 + "\n" + "q" * 45)] * 6 + [(499, "q" * 45)] + [(600 + i, "only four documents hold this line, so it stays\n") for i in range(4)]
    return texts + rows


@pytest.mark.parametrize("heavy", [line_index.HEAVY, 30, 1])
def test_lines_against_brute_force(spark, pages, heavy):
    want = brute(pages)
    assert sum(n * k[2] for k, n in want.items()) > 300
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in pages], DOCS).repartition(5)
    assert answers(line_index.drop_repeated_lines(docs, heavy=heavy)) == want
    crowded = spark.createDataFrame([(i, t, "en", "s", 1, *["?"] * 14) for i, t in pages], EXTRA)
    got = line_index.drop_repeated_lines(crowded, heavy=heavy)
    assert answers(got) == want
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_lines_of_an_empty_table(spark, empty):
    assert line_index.drop_repeated_lines(empty).collect() == []
    none = spark.createDataFrame([(1, "a\nb", None, None, None)], DOCS)
    assert [tuple(r)[:3] for r in line_index.drop_repeated_lines(none).collect()] == [(1, 2, 0)]


def test_documents_are_not_joined_where_all_keys_are_heavy(spark):
    # ten lines in 30 documents, ten in 5: all 20 keys go to every task, also those of fewer documents than the mean
    often, seldom = ([f"{name} line {i} that is long enough to be counted here" for i in range(10)] for name in ("often", "seldom"))
    rows = [(i, "\n".join(often + seldom * (i < 5))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for heavy, joined in ((20, False), (19, True)):
        out = line_index.drop_repeated_lines(docs, heavy=heavy)
        assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == joined
        assert answers(out) == brute(rows)


def test_heavy_keys_number_at_most_so_many():
    sizes = [(5, 100), (9, 1), (6, 10), (7, 3)]
    assert [line_index.heavy_from(sizes, heavy) for heavy in (200, 114, 113, 14, 13, 4, 3, 1, 0)] == [0, 0, 6, 6, 7, 7, 8, 8, 10]
    assert line_index.heavy_from([], 5) == 0


def test_keys_count_code_points():
    body = " \tAbÀ \n\U0001f600\U0001f600\U0001f600\n\U0001f600\U0001f600\n\nabc\r".encode()
    assert line_index.line_keys(body, 3) == ["abÀ".encode(), "\U0001f600\U0001f600\U0001f600".encode(), None, None, b"abc"]
