"""Token ids of whole texts, exactly as the tokenizers library gives them.

Most texts hold few distinct words, so pieces are encoded once a worker and
looked up afterwards. That holds only where the pieces of a text do not depend
on one another: for plain texts (printable ASCII, tab, line ends, Latin-1
letters) and the pre-tokenizer that :data:`PLAIN_PIECE` restates; every other text goes to the
library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Fixed value: the split of a lower-cased plain text by the pre-tokenizer of word_bpe_49k.json.
PLAIN_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin-1 codes of plain texts.
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
#: Pieces that a worker keeps: between this number and twice as many.
KEPT_PIECES = 250_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as file:
            head = json.load(file)
        steps = [s.get("type") for s in (head.get("normalizer") or {}).get("normalizers", [])]
        splits = [s.get("pattern", {}).get("Regex") for s in (head.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.special = [t["content"] for t in head.get("added_tokens", [])]
        self.by_piece = steps == ["NFC", "Replace", "Lowercase"] and splits[:1] == [_SPLIT] and head["model"].get("end_of_word_suffix") == "</w>"

        # pieces are split and folded already; the rest of the way is the library's
        self.plain = Tokenizer.from_file(path)
        if self.by_piece:
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        if not self.by_piece:
            return False
        try:
            odd = text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            return False
        return not odd and not any(s in text for s in self.special)

    def _learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known; what has not been used for long is forgotten."""
        if len(self.pieces) > KEPT_PIECES:
            self.older, self.pieces = self.pieces, {}
        new = []
        for piece in pieces - self.pieces.keys():
            if (known := self.older.get(piece)) is not None:
                self.pieces[piece] = known
            else:
                new.append(piece)
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            ids = np.array(self.plain.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) != len(some) or ends[-1] != len(ids):
                for piece in some:
                    self.pieces[piece] = self.whole(piece)
                continue
            flat = ids.tobytes()
            for piece, a, b in zip(some, [0, *ends], ends):
                self.pieces[piece] = flat[4 * a : 4 * b]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [PLAIN_PIECE.findall(t.lower()) if self._plain(t) else None for t in texts]
        self._learn(set().union(*(s for s in split if s)))
        get = self.pieces.__getitem__
        return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@functools.lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder a worker process, so that tasks share what it has learned."""
    return Encoder(path)
