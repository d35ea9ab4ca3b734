import collections

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import packing, token_files, tokens
from tickloom.llm.tokens import crc32_ids

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "no <|ENDOFTEXT|>", "<|endoftext|", "plain", "\u6f22 <|endoftext|>"]


def plain_ids(path, t):
    """The library as it comes, with no switch set."""
    return Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_special_tokens_in_a_text_are_one_id(path):
    encode = tokens.encoder(path, literal=False)
    for t in SPECIAL:
        assert np.frombuffer(encode(t), encode.dtype).tolist() == plain_ids(path, t)


def test_packs_and_files_hold_the_librarys_plain_ids(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    pieces = packing.pack(docs, WORD).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in pieces} == {i: [*plain_ids(WORD, t), 2] for i, t in enumerate(SPECIAL)}
    folder = f"file://{tmp_path}/files"
    rows = token_files.read_ids(token_files.write_ids(docs, folder, BYTE), folder).collect()
    want = {i: np.array([*plain_ids(BYTE, t), 0], "<u4") for i, t in enumerate(SPECIAL)}
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == collections.Counter((i, len(x), crc32_ids(x)) for i, x in want.items())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_each_latin_character_by_itself(path):
    """Also the 23 capitals whose small letter lies beyond the classes of the fast split."""
    encode, lib = tokens.encoder(path, literal=False), Tokenizer.from_file(path)
    for c in map(chr, range(0x250)):
        for t in (f"{c}liyev", f"x{c}y 1{c}"):
            assert np.frombuffer(encode(t), encode.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids
