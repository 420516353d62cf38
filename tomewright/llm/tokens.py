"""Token ids of whole texts from a ``tokenizers`` vocabulary file, with a memo of words.

The library spends most of its time on normalising, splitting and tracking offsets.
Both vocabularies used here split a text before every run of white space (byte-level)
or drop white space altogether (word-level), so the ids of a text are the ids of its
white-space delimited pieces, one after the other. Pieces are kept in a bounded memo;
a new piece of Latin-1 characters is split by the vocabulary's own pattern and its
words go to the library's model; any other piece goes through the whole library, and
so does any text in which an added token or a separator that Python and the library
see differently occurs, or any vocabulary laid out in another way.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

#: Pieces kept in a worker's memo (about 200 bytes each) and the longest piece kept.
MEMO_ENTRIES = 400_000
MEMO_PIECE_CHARS = 48

# Letters, digits and white space among the first 256 code points.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \x85\xa0"
# The split patterns of the two vocabularies.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTE_PATTERN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
_SPACE = "\t-\r \x85\xa0  -     　"
_BYTE_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: White space to Python's split() only.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        layout = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in layout["added_tokens"]]
        self.layout = self._layout(layout)
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.memo_entries = memo_entries
        self.letters = _byte_letters()

    @staticmethod
    def _layout(x: dict) -> str:
        """``word``, ``byte``, or ``other`` for a vocabulary that only the library splits."""
        pre, norm, model = x["pre_tokenizer"] or {}, x["normalizer"], x["model"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in x["added_tokens"])
        if model["type"] != "BPE" or model["dropout"] or not plain or x["post_processor"]:
            return "other"
        if pre.get("type") == "ByteLevel" and not norm:
            if pre["use_regex"] and not pre["add_prefix_space"]:
                return "byte"
        if pre.get("type") == "Sequence" and (norm or {}).get("type") == "Sequence":
            steps = [n["type"] for n in norm["normalizers"]]
            split, level = pre["pretokenizers"][0], pre["pretokenizers"][-1]
            if (
                steps == ["NFC", "Replace", "Lowercase"]
                and len(pre["pretokenizers"]) == 2
                and split.get("pattern", {}).get("Regex") == _WORD_SPLIT
                and split["behavior"] == "Removed"
                and split["invert"]
                and level["type"] == "ByteLevel"
                and not level["add_prefix_space"]
                and not level["use_regex"]
            ):
                return "word"
        return "other"

    def _library(self, text: str) -> bytes:
        import numpy as np

        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            letters = self.letters
            shown = "".join([letters[b] for b in word.encode()])
            got = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown)])
            if len(self.words) < self.memo_entries and len(word) <= MEMO_PIECE_CHARS:
                self.words[word] = got
        return got

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() and max(piece) > "ÿ":
            got = self._library(piece)
        elif self.layout == "word":
            got = b"".join(map(self._word, _WORD_PATTERN.findall(piece.lower())))
        else:
            got = b"".join(map(self._word, _BYTE_PATTERN.findall(piece)))
        if len(self.memo) < self.memo_entries and len(piece) <= MEMO_PIECE_CHARS:
            self.memo[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.layout == "other" or any(a in text for a in self.added):
            return self._library(text)
        if self.layout == "word":
            if _ODD_SPACE.search(text):
                return self._library(text)
            pieces = text.split()
        else:
            pieces = _BYTE_PIECES.findall(text)
        memo, piece = self.memo, self._piece
        return b"".join([memo.get(p) or piece(p) for p in pieces])

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    return Encoder(path)


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabulary of that name is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
