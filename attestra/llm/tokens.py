"""Token ids by the tokenizers library, with a bounded cache of pieces for each Python worker.

A text is cut into pieces at places where the tokenizer's own pre-tokenizer always cuts, so that the ids of a text are
those of its pieces in turn. Each distinct piece is encoded once by the library and then looked up. A text that could
break this (it holds one of the tokenizer's special strings, a character that this Python's Unicode tables do not know while the
library's may, or needs Unicode normalisation) is encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from functools import cache

import numpy as np

#: Unicode's white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Unions of neighbouring pre-tokens of a byte-level vocabulary: contraction, word or number, other signs, white space.
BYTE_PIECES = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[^\\W_]+| ?(?:[^{SPACE}\\w]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for a vocabulary with word ends, which drops white space and ignores case.
WORD_PIECES = re.compile(f"'(?:[sdmtSDMT]|[lL][lL]|[vV][eE]|[rR][eE])|[^\\W_]+|(?:[^{SPACE}\\w]|_)+")
#: The capital whose lower case has two characters, one of them no letter.
DOTTED_I = "İ"
#: Longer pieces are not kept, which bounds the cache in bytes too.
LONGEST_KEPT = 64


@cache
def unassigned() -> re.Pattern:
    """A pattern for the characters that this Python's Unicode tables do not know."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        new = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if new and start is None:
            start = c
        elif not new and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile("[" + "".join(ranges) + "]")


def known(text: str) -> bool:
    """Whether this Python knows all characters of a text; those of Latin-1 it does, and most texts hold no others."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not unassigned().search(text)


class PieceEncoder:
    """``encode_batch(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    ``kind`` is ``byte`` or ``word``. At most ``cache_size`` pieces of at most ``LONGEST_KEPT`` characters are kept, about 200 bytes
    each; a full cache is emptied.
    """

    def __init__(self, path: str, kind: str, cache_size: int = 1_400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.pattern = kind, BYTE_PIECES if kind == "byte" else WORD_PIECES
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _whole(self, text: str) -> bool:
        if any(s in text for s in self.special) or not known(text):
            return True
        return self.kind == "word" and (DOTTED_I in text or not unicodedata.is_normalized("NFC", text))

    def _learn(self, pieces: list[str]) -> list[str]:
        """Encodes pieces into the cache; those that are too long to stay there."""
        e = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        raw = np.asarray(e.ids, dtype="<u4").tobytes()
        cuts = (4 * np.searchsorted(np.asarray(e.word_ids, dtype=np.int64), np.arange(len(pieces) + 1))).tolist()
        self.cache.update((p, raw[i:j]) for p, i, j in zip(pieces, cuts, cuts[1:]))
        return [p for p in pieces if len(p) > LONGEST_KEPT]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        whole = [self._whole(t) for t in texts]
        # Where case is ignored, A to Z in lower case give the same ids and fewer pieces to learn.
        plain = (lambda t: t.encode().lower().decode()) if self.kind == "word" else (lambda t: t)
        pieces = [[] if w else self.pattern.findall(plain(t)) for t, w in zip(texts, whole)]
        new = list(set().union(*pieces).difference(self.cache))
        long = self._learn(new) if new else []
        get = self.cache.__getitem__
        out = [
            np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if w else b"".join(map(get, p))
            for t, w, p in zip(texts, whole, pieces)
        ]
        for p in long:
            del self.cache[p]
        return out


#: Pieces that a worker keeps where nothing else is asked for: up to 280 MB.
CACHED_PIECES = 1_400_000
_ENCODERS: dict[tuple[str, str, int], PieceEncoder] = {}


def encoder(path: str, kind: str, cache_size: int = CACHED_PIECES) -> PieceEncoder:
    """This worker's encoder for a vocabulary file; a reused worker keeps its cache."""
    key = path, kind, cache_size
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, kind, cache_size)
    return _ENCODERS[key]


def parts(texts: list[str], rows: int = 256, chars: int = 2_000_000):
    """Ranges of ``texts`` of at most ``rows`` texts and about ``chars`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if i + 1 - start >= rows or size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
