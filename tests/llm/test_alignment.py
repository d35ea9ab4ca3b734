import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import DOCS, EXTRA
from tickloom.llm import alignment

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["<|endoftext|> <s></s><unk> <0x0A> x", "a▁b", "  two  spaces \n\n  and lines\n", " ", "\n", "\t", "x\0y", "ﬁ　½ é é   İ", "日本語のテキスト 漢字\U0001f600\U0001f600 ไทย", "a" * 3000, " " * 900 + "b", "\r\n x\x0b\x85", "don't I'LL 12345 -- !!!???", "https://a.b/c?d=e&f=%20#g", "�", "z\n" * 400]


def decoder():
    """Bytes behind the letters of the byte-level file, by the rule of its alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE), decoder()


def brute(rows, libraries):
    lib_a, lib_b, letters = libraries
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        groups = None
        if text:
            a, b, raw = lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text), (" " + text).encode()
            bytes_a = [bytes(letters[c] for c in lib_a.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                common, groups, at_a, at_b = sorted(set(ends_a) & set(ends_b)), [], 0, 0
                for end in common:
                    to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
                    groups.append((a[at_a:to_a], b[at_b:to_b]))
                    at_a, at_b = to_a, to_b
        links = collections.Counter()
        for x, y in groups or ():
            for i, n in collections.Counter(x).items():
                for j, m in collections.Counter(y).items():
                    links[i, j] += n * m
        counts.update(links.keys())
        docs.append((doc_id, groups, links))
    best = collections.Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = collections.Counter()
    for doc_id, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups) if groups is not None else None
        out[doc_id, sum(len(x) for x, _ in groups or ()), sum(len(y) for _, y in groups or ()), len(groups or ()), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), "" if said is None else hashlib.sha256(said.encode()).hexdigest()] += 1
    return out


def answers(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


def test_galloping_finds_common_ends(monkeypatch):
    rng = np.random.default_rng(5)
    for size in (1, 3, 1024):
        monkeypatch.setattr(alignment, "GALLOP", size)
        for n, m in ((0, 5), (1, 1), (5, 900), (700, 900), (900, 40), (300, 300)):
            a, b = (np.sort(rng.choice(1000, k, replace=False)) for k in (n, m))
            ia, ib = alignment.gallop(a, b)
            assert a[ia].tolist() == b[ib].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        far = np.arange(5000)
        assert alignment.gallop(np.array([4000, 4999, 6000]), far)[1].tolist() == [4000, 4999]


def test_pieces_give_the_text_back(texts):
    pieces = alignment.Pieces(PIECE)
    for t in [t for _, t in texts if t] + [t for t in ODD if "▁" not in t]:
        assert b"".join(pieces.bytes[i] for i in pieces(t)) == f" {t}".encode()


def test_large_groups_by_distinct_ids(monkeypatch, libraries):
    align = alignment.Aligner(BYTE, PIECE)
    for t in ODD + ["\U0001f600" * 50 + "a" * 901]:
        whole = align(t)
        monkeypatch.setattr(alignment, "LISTED", 1)
        monkeypatch.setattr(alignment, "HELD", 7)
        again = align(t)
        monkeypatch.undo()
        assert whole[5].tolist() == again[5].tolist() and whole[6].tolist() == again[6].tolist() and whole[6].sum() == whole[3]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 40])
def test_alignment_against_brute_force(spark, texts, libraries, heavy):
    rows = texts + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, "the same words again and again") for i in range(30)]
    want = brute(rows, libraries)
    assert any(k[5] < k[4] for k in want)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    assert answers(alignment.align(docs, BYTE, PIECE, heavy)) == want
    crowded = alignment.align(spark.createDataFrame([(i, t, "en", "s", 1, *["?"] * 14) for i, t in rows], EXTRA), BYTE, PIECE, heavy, groups=True)
    assert answers(crowded) == want
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") for r in crowded.collect())


def test_alignment_of_no_tokens(spark, empty):
    assert alignment.align(empty, BYTE, PIECE).collect() == []
    none = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], DOCS)
    assert answers(alignment.align(none, BYTE, PIECE)) == collections.Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])
