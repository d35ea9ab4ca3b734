import textwrap

import numpy as np

from tests.llm.conftest import words
from tickloom.llm import paragraph_dedup, text


def test_runs_are_the_signatures_of_their_hashes():
    minhash, rng = text.MinHash(30), np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 3000, np.uint64)
    first = np.concatenate((np.arange(0, 2990, 10), [0, 500, 1020, 2999]))
    last = np.concatenate((np.arange(0, 2990, 10) + 6, [3000, 2300, 1030, 3000]))
    for a, b, sig in zip(first, last, minhash.runs(hashes, first, last), strict=True):
        assert (sig == minhash(hashes[a:b])).all()


def test_short_lines_and_wrapped_paragraphs(spark):
    """Lines from five words on, exact or near; paragraphs wrapped at other widths; one wrapped text alone repeats nothing."""
    short, para, alone, lead = " ".join(words(9, 90)), words(120, 91), " ".join(words(17, 92)), [" ".join(words(7, 100 + i)) for i in range(5)]
    other = list(para)
    other[60] = "changed"
    tail = " ".join(w.ljust(8, "x") for w in words(18, 93))
    rows = [(1, f"{lead[0]}\n{short}"), (2, f"{short}\n{lead[1]} é"), (3, lead[2] + "\n\n" + textwrap.fill(" ".join(para), 80)), (4, textwrap.fill(" ".join(other), 60) + "\n\n" + lead[3])]
    rows += [(5, tail.rsplit(" ", 2)[0] + "\n" + " ".join(tail.rsplit(" ", 2)[1:])), (6, alone), (7, "a b c d"), (8, " ".join(para))]
    found = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'paragraph'").collect()
    body = {i: t.encode() for i, t in rows}
    got = {(r["doc_id"], body[r["doc_id"]][r["start"] : r["end"]].decode(), r["cluster_id"], r["removed"]) for r in found}
    want = {(1, short, 1, False), (2, short, 1, True), (3, textwrap.fill(" ".join(para), 80), 3, False), (4, textwrap.fill(" ".join(other), 60), 3, True), (8, " ".join(para), 3, True)}
    # lines of the two wrapped forms may be alike as well
    assert want <= got and {x[0] for x in got} == {1, 2, 3, 4, 8} and all(len(x[1].split()) < 20 for x in got - want)
