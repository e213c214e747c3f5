"""Token ids of whole texts by a tokenizer file of the `tokenizers` library, a batch at a time.

A byte-level BPE first cuts a text into pieces and encodes each on its own. Some of these cuts can be told from two bytes: before a space that follows a visible
character, around a line break, and where letters, digits and punctuation (but for the apostrophe) meet. Texts are cut there, every distinct chunk is
encoded once, and the ids are gathered back. Chunks that are one word go to the library joined to long texts, which costs it less than
many short ones. Texts whose white space runs cross such cuts (three or more in a row, or two at the end) are encoded in one go.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.llm.common import slices, texts, utf8

#: Larger slices repeat more chunks.
TOKEN_SLICE = 4 << 20
KNOWN_CHUNKS = 250_000
#: What the library writes for a space at the head of a piece.
_SPACE_MARK = "\u0120"
_RUNS = r"[\s\v\p{Z}\x{1c}-\x{1f}\x{85}]{3}|[\s\v\p{Z}\x{1c}-\x{1f}\x{85}]{2}\z"


#: Words joined to one text for the library, and chunks that go to it at once.
JOINED = 200
NEW_CHUNKS = 20_000
# Kinds of bytes: 0 others, 1 letters, 2 digits, 3 punctuation, 4 spaces, 5 line breaks.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3
_KIND[[0x20, 0x0A]] = 4, 5
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: Whether a text may be cut between bytes of two kinds.
_CUT = np.zeros((6, 6), bool)
_CUT[5, :] = _CUT[:, 5] = True
_CUT[[1, 2, 3], [[2], [3], [1]]] = _CUT[[2, 3, 1], [[1], [2], [3]]] = True
np.fill_diagonal(_CUT[1:5, 1:5], False)
# The same by one number for a pair: eight times the kind of the first byte and that of the second.
_CUT_PAIRS = np.pad(_CUT, ((0, 2), (0, 2))).ravel()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # names of special tokens in a text are ordinary text
        marked = [id_ for piece, id_ in self.tokenizer.get_vocab().items() if piece[0] == _SPACE_MARK]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # pieces that open a word after a space
        self.opens[marked] = True
        self.known: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}

    def _encode(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _encode_words(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that are a space and letters each: one word of the joined text apiece."""
        out = []
        joined = ["".join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)]
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            data, at = ids.tobytes(), 0
            for end in (4 * np.append(np.flatnonzero(self.opens[ids])[1:], len(ids))).tolist():
                out.append(data[at:end])
                at = end
        if len(out) != len(chunks):
            raise ValueError("the tokenizer cuts words otherwise than by their letters")
        return out

    def _learn(self, known: dict, names: list[str], keep) -> None:
        """Put what `keep` makes of the ids of all names into `known`, a bounded number of new names at a time."""
        if len(known) > KNOWN_CHUNKS:  # what comes again in this slice stays
            again = {c: known[c] for c in names if c in known}
            known.clear()
            known.update(again)
        new = [c for c in names if c not in known]
        # letters up to the Latin blocks' end are letters for every Unicode version
        words = [c for c in new if c[0] == " " and c[1:].isalpha() and (c.isascii() or max(c) < "\u0250")]
        for at in range(0, len(words), NEW_CHUNKS):
            part = words[at : at + NEW_CHUNKS]
            known.update(zip(part, map(keep, self._encode_words(part))))
        rest = new if not words else [c for c in new if c not in known]
        for at in range(0, len(rest), NEW_CHUNKS):
            part = rest[at : at + NEW_CHUNKS]
            known.update(zip(part, map(keep, self._encode(part))))

    def _chunks(self, column: pa.Array, known: dict, keep) -> tuple[list, np.ndarray, np.ndarray]:
        """What `keep` makes of the ids of each distinct chunk, the chunks' numbers among these, and the rows' offsets in the chunks."""
        data, offsets = utf8(column)
        n = len(data)
        kind = _KIND[data]
        cut = np.zeros(n + 1, bool)
        cut[1:n] = _CUT_PAIRS[(kind[:-1] << 3) + kind[1:]] | ((kind[1:] == 4) & ~_WHITE[data[:-1]])
        # a text that must stay whole is one chunk
        direct = np.flatnonzero(pc.match_substring_regex(column, _RUNS).to_numpy(zero_copy_only=False))
        for i in direct:
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        bounds = np.searchsorted(edges, offsets)
        chunks = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = chunks.indices.to_numpy()
        if not len(direct):
            self._learn(known, names, keep)
            return [known[c] for c in names], codes, bounds
        whole = set(chunks.dictionary.take(pa.array(np.unique(codes[bounds[direct][np.diff(offsets)[direct] > 0]]))).to_pylist())
        self._learn(known, [c for c in names if c not in whole], keep)
        ready = dict(zip(whole, map(keep, self._encode([*whole]))))
        return [ready[c] if c in ready else known[c] for c in names], codes, bounds

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows as unsigned 32-bit integers, and the rows' offsets in them."""
        if not len(utf8(column)[0]):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        coded, codes, bounds = self._chunks(column, self.known, bytes)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), np.uint32)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        place = np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1])
        return flat[place], np.concatenate([[0], ends])[bounds]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each row, without keeping any."""
        if not len(utf8(column)[0]):
            return np.zeros(len(column), np.int64)
        sizes, codes, bounds = self._chunks(column, self.sizes, lambda ids: len(ids) // 4)
        return np.diff(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64)[codes])])[bounds])


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(batches, "text", TOKEN_SLICE):
        yield (part, *encoder(path).ids(part.column("text")))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`doc_id` and `n_tokens`, the end token included."""
    path = path or default_tokenizer()

    def run(batches):
        for part in slices(batches, "text", TOKEN_SLICE // 2):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encoder(path).counts(part.column("text")) + 1)], ["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long").select("doc_id", F.col("n_tokens"))
