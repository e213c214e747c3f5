import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemark.llm import simple8b, tokens
from tracemark.session import new_folder

from .conftest import EDGES


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60000), st.integers(0, (1 << 64) - 1)), max_size=700))
def test_round_trip(values):
    values = np.array(values, np.uint64)
    assert (simple8b.unpack(simple8b.pack(values)) == values).all()


def test_runs_and_escapes_are_small():
    assert len(simple8b.pack(np.zeros(24_000, np.uint64))) == 20 + 8 * 100
    block = simple8b.pack(np.array([(1 << 64) - 1, (1 << 60) - 1, (1 << 60) - 2], np.uint64))
    assert simple8b.unpack(block).tolist() == [(1 << 64) - 1, (1 << 60) - 1, (1 << 60) - 2]


def test_damage_is_found():
    block = bytearray(simple8b.pack(np.arange(50)))
    block[30] ^= 1
    with pytest.raises(ValueError):
        simple8b.unpack(bytes(block))


def direct(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunked_encoding_equals_the_library():
    rng = random.Random(4)
    alphabet = ["a", "The", "don't", "'s", " ", " ", " ", "  ", "\n", "\t", " ", " ", ".", "!?", "12", "é", "日本", "\U0001f600", "<|endoftext|>", "\r\n", "\x1c", "\x85", "_x"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [t or "" for _, t, _ in EDGES]
    flat, bounds = tokens.encoder(tokens.default_tokenizer()).ids(pa.array(texts))
    got = [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    wrong = [(t, g, w) for t, g, w in zip(texts, got, direct(texts)) if g != w]
    assert not wrong, wrong[:3]


def test_files_read_back(spark, edges, nothing):
    path = new_folder(spark, "test-simple8b")
    simple8b.write(edges.repartition(3), path)
    rows = sorted(((i, t or "") for i, t, _ in EDGES), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for (i, _), ids in zip(rows, direct([t for _, t in rows])):
        data = np.array([*ids, simple8b.END_ID], "<u4").tobytes()
        want.append((i, start, len(ids) + 1, zlib.crc32(data), data))
        start += len(ids) + 1
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, simple8b.read_digests(spark, path).collect()), key=key) == sorted((w[:4] for w in want), key=key)
    assert sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in simple8b.read(spark, path).collect()), key=key) == sorted(((w[0], w[1], w[4]) for w in want), key=key)
    empty = new_folder(spark, "test-simple8b")
    simple8b.write(nothing, empty)
    assert simple8b.read(spark, empty).count() == 0
