"""Token ids of whole texts with a public tokenizer file.

Both supported files split a text into pieces by a fixed pattern and then merge
bytes within a piece. Pieces repeat, so a worker remembers the ids of the pieces
it has seen. The pattern is applied here to texts whose characters it classes the
same way in every Unicode version (Latin letters and below, also when lowered); any
other text is encoded whole by the library, as is a text that holds an added token
of the file, and any tokenizer file of another kind. The ids are the library's in
either case.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np

#: pieces of a generation; a worker remembers two, so those in use outlive those that are not
REMEMBERED = 300_000

_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = " \t\n\x0b\x0c\r\xa0"
_AWAY = "".join(c for c in map(chr, range(0x250)) if c.lower() > "\u024f")  # capitals whose small letter is none of these
_SIMPLE = re.compile(f"[^\x00-\x1b\x20-\x84\x86-įı-ɏ]|[{_AWAY}]")

#: fixed values of the two tokenizer files: the splitting pattern that each names
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _latin(pattern: str) -> re.Pattern:
    """The pattern with its classes written out for the characters of ``_SIMPLE`` texts."""
    out = pattern.replace(r"(?!\S)", f"(?![^{_SPACE}])")
    out = out.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTERS}{_DIGITS}]").replace(r"[\p{L}]", f"[{_LETTERS}]").replace(r"[\p{N}]", f"[{_DIGITS}]")
    return re.compile(out.replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_DIGITS}]").replace(r"\s", f"[{_SPACE}]"))


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next free letter from U+0100."""
    table, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[b] = chr(b)
        else:
            table[b] = chr(free)
            free += 1
    return table


class Encoder:
    """Ids of a text as little-endian bytes, ``width`` bytes each.

    With ``literal`` an added token in a text is split like any other characters;
    otherwise it is one id, as in the library's plain call.
    """

    def __init__(self, path: str, literal: bool = True):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = literal
        added = said.get("added_tokens") or []
        # literal spares special tokens alone; the others are one id in either case
        self.whole = [t["content"] for t in added if not (literal and t["special"])]
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.lower = (said.get("normalizer") or {}).get("type") == "Sequence"
        self.pattern = None
        pre = json.dumps(said.get("pre_tokenizer"))
        if self.lower and any(t["normalized"] for t in added):
            pass  # such a token is found in the normalized text
        elif self.lower and json.dumps(_WORD_SPLIT) in pre:
            self.pattern = _latin(_WORD_SPLIT)
        elif not said.get("normalizer") and '"use_regex": true' in pre and '"add_prefix_space": false' in pre:
            self.pattern = _latin(_BYTE_SPLIT)
        model, letters, dtype = self.lib.model, _byte_letters(), self.dtype

        class Pieces(dict):
            older: dict = {}

            def __missing__(self, piece: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.older = dict(self)
                    self.clear()
                ids = self.older.get(piece)
                if ids is None:
                    shown = piece.encode().decode("latin-1").translate(letters)
                    ids = np.array([t.id for t in model.tokenize(shown)], dtype).tobytes()
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def __call__(self, text: str) -> bytes:
        if self.pattern is None or _SIMPLE.search(text) or any(t in text for t in self.whole):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, literal: bool = True) -> Encoder:
    """The worker's encoder of a file; it lives as long as the worker does."""
    if (path, literal) not in _ENCODERS:
        _ENCODERS[path, literal] = Encoder(path, literal)
    return _ENCODERS[path, literal]


def crc32_ids(ids: np.ndarray, before: int = 0) -> int:
    """crc32 of the ids as unsigned little-endian 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes(), before)
