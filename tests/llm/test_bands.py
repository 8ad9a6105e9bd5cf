"""Compression bands on planted junk, and on the test tables' own texts."""

import base64
import random

import pyarrow.parquet as pq
import pytest
import zstandard

from attestra.llm import quality

COMPRESS = zstandard.ZstdCompressor(level=3).compress
RNG = random.Random(11)


def cut(text: str, size: int) -> str:
    return " ".join(text[i : i + size] for i in range(0, len(text), size))


def clean() -> list[str]:
    return [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t and not quality.judgement(t, COMPRESS)[5]]


JUNK = {
    "encoded bytes": lambda n: cut(base64.b64encode(RNG.randbytes(n)).decode()[:n], 9),
    "bytes as text": lambda n: cut("".join(chr(RNG.randrange(0x21, 0x7F)) for _ in range(n)), 8),
    "random signs of many scripts": lambda n: cut("".join(chr(RNG.randrange(0x400, 0x2000)) for _ in range(n)), 7),
    # No three words repeat, so the base rules pass it, but every line is nearly the line before.
    "counted lines": lambda n: "\n".join(f"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{i} bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb{i}" for i in range(n // 70)),
}


@pytest.mark.parametrize("size", [700, 3_000, 12_000, 60_000])
@pytest.mark.parametrize("kind", JUNK)
def test_junk_is_rejected(kind, size):
    size = max(size, 2_000) if kind == "counted lines" else size  # fewer lines have under 50 words
    got = [quality.judgement(JUNK[kind](size), COMPRESS) for _ in range(40)]
    assert not any(j[5] for j in got), "the base rules pass it"
    assert not any(j[-1] for j in got), "the bands do not"


def test_junk_in_half_of_a_text_is_rejected():
    good = [t for t in clean() if 1_500 < len(t) < 6_000][:60]
    mixed = [t + "\n" + JUNK["encoded bytes"](len(t)) for t in good]
    assert sum(quality.passes(t, COMPRESS) for t in good) == len(good) == 60
    assert sum(quality.passes(t, COMPRESS) for t in mixed) == 0


def test_clean_texts_stay():
    texts = clean()
    assert len(texts) > 800 and all(quality.passes(t, COMPRESS) for t in texts)
    assert all(quality.passes("".join(RNG.sample(t.splitlines(True), len(t.splitlines()))), COMPRESS) for t in texts), "lines in another order are as clean"
