"""Fill-in-middle transformation: cut a text's lines into prefix, middle and suffix, and put the middle last.

The two cuts are ranks among the text's lines. An indexable skip list finds where they are: each document has a head and one node behind each
line, a node stands on every lane up to its height, and each link of a lane carries two widths, the lines and the code points it passes. A search starts at the
head of the highest lane, follows links while the lines passed stay within the rank, goes down a lane where the next link would pass it, and ends on the bottom lane
exactly at the rank, with the code points added up on the way. Heights come from a hash of the line's number, so equal texts have equal lists.
The lists of a slice of documents are laid out in common arrays, and all searches of a slice go down together.

Edge cases: null and empty texts, and texts that contain a marker, stay plain. A null id counts as an empty one where the cuts are drawn. A cut may fall before the first
line or behind the last, so that prefix, middle or suffix are empty. Rows that repeat an id are cut alike. Other columns are ignored. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.llm.common import mix, slices, texts, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SUFFIX_FIRST, SEED = 100, 50, 7
#: One node in four reaches the next lane.
_LANE_BITS = 2
_NO_LINK = np.int64(1) << 62
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SkipLists:
    """Indexable skip lists of several documents, given the code points of all units in order and where each document's units start and end."""

    def __init__(self, widths: np.ndarray, first: np.ndarray):
        counts = np.diff(first)
        self.heads = first[:-1] + np.arange(len(counts))
        number = np.arange(len(widths) + len(counts)) - np.repeat(self.heads, counts + 1)
        document = np.repeat(np.arange(len(counts)), counts + 1)
        passed = np.zeros(len(number), np.int64)  # code points before each node, over the whole slice
        passed[number > 0] = widths
        passed = np.cumsum(passed)
        coin = mix(number.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        nodes, self.lanes, lane = np.arange(len(number)), [], 0
        while True:
            units, chars = np.full(len(nodes), _NO_LINK), np.zeros(len(nodes), np.int64)
            linked = np.flatnonzero(document[nodes[1:]] == document[nodes[:-1]])
            units[linked] = number[nodes[linked + 1]] - number[nodes[linked]]
            chars[linked] = passed[nodes[linked + 1]] - passed[nodes[linked]]
            self.lanes.append((nodes, units, chars))
            if not len(linked):
                break
            lane += 1
            mask = np.uint64((1 << min(_LANE_BITS * lane, 63)) - 1)
            nodes = nodes[(number[nodes] == 0) | (coin[nodes] & mask == 0)]

    def locate(self, document: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before the `rank`-th unit border of each document."""
        left, chars = rank.astype(np.int64).copy(), np.zeros(len(rank), np.int64)
        at = np.searchsorted(self.lanes[-1][0], self.heads[document])
        for lane in range(len(self.lanes) - 1, -1, -1):
            nodes, units, points = self.lanes[lane]
            going = np.arange(len(at))
            while len(going):
                going = going[units[at[going]] <= left[going]]
                left[going] -= units[at[going]]
                chars[going] += points[at[going]]
                at[going] += 1
            if lane:
                at = np.searchsorted(self.lanes[lane - 1][0], nodes[at])
        return chars


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every line, its newline included, and the number of lines before each row."""
    data, offsets = utf8(column)
    full = np.diff(offsets) > 0
    ends = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets[1:][full])
    first = np.searchsorted(ends, offsets, "right")
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    widths = np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64) if len(ends) else np.zeros(0, np.int64)
    return widths, first


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that depend on seed and id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Per document its number of lines `n`, `form` (`plain`, `psm`, `spm`), the code points of prefix and middle (null if plain) and the `output`.

    `rate` percent of the texts are transformed, of these `suffix_first` percent with the suffix first.
    """
    p, s, m = markers

    def run(batches):
        for part in slices(batches, "text"):
            column, ids = part.column("text"), part.column("doc_id").to_pylist()
            widths, first = lines(column)
            n = np.diff(first)
            h = np.array([draws(seed, i) for i in ids], np.int64)
            cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            skips = SkipLists(widths, first)
            rows = np.arange(len(ids))
            start, end = skips.locate(rows, cut[:, 0]), skips.locate(rows, cut[:, 1])
            forms, outputs = [], []
            for text, a, b, h3, h4 in zip(column.to_pylist(), start.tolist(), end.tolist(), h[:, 2].tolist(), h[:, 3].tolist()):
                if not text or h3 % 100 >= rate or p in text or s in text or m in text:
                    forms.append("plain")
                    outputs.append(text)
                elif h4 % 100 < suffix_first:
                    forms.append("spm")
                    outputs.append(f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}")
                else:
                    forms.append("psm")
                    outputs.append(f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}")
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(forms, pa.string()), pa.array(start, mask=plain), pa.array(end - start, mask=plain), pa.array(outputs, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts(docs).mapInArrow(run, OUTPUT)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that a transformed `output` of this `form` was made from."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in markers), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return (F.when(form == "plain", output).when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))))
