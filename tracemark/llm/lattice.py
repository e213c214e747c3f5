"""SentencePiece encoding and decoding over a relational lattice.

Text is brought into the model's form (spaces become `▁`, one is put in front) and cut into units at places that no piece crosses, which two neighbouring
characters tell: if no piece has them side by side, none can lie across. Units are counted over the whole corpus; those in the dictionary, the at most `DICTIONARY` most frequent ones, are encoded as
relations: substrings no longer than the longest piece are exploded, joined to the piece table, grouped by unit, and folded by `aggregate` from left to
right into the best path. All other units are encoded by the same recurrence where they occur. Neither way is an approximation, so the size of the dictionary
has no effect on the ids.

A path's rule depends on the model. For a unigram model the sum of the scores is largest. For a byte-pair model a path is the encoding exactly if every two
neighbouring pieces are what merging their joined text gives; the table of such pairs among the lattice's neighbours is worked out once and joined to the edges, and just
one edge per place then has a predecessor.

Characters that no piece covers become the byte pieces of their UTF-8 form. Decoding joins pieces, turns `▁` into a space and takes away the one in front. It
gives the text back but for `▁` itself, which reads as a space.

Edge cases: null and empty texts have no ids. Repeated rows are encoded one by one, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.llm.common import slices, texts, utf8
from tracemark.session import materialise

DICTIONARY = 100_000
#: Longer units are never in the dictionary.
UNIT_CHARS = 32
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Units and pairs that a worker remembers.
KNOWN_UNITS = 400_000
KNOWN_PAIRS = 1_000_000


@dataclass(frozen=True)
class Pieces:
    """Piece table of a model: normal pieces with score, byte ids, and the kind, `bpe` or `unigram`."""

    score: dict[str, float]
    ids: dict[str, int]
    bytes_: tuple[int, ...]
    text: tuple[str, ...]
    kind: str
    longest: int
    cuts: bytes  # 256 x 256 flags: whether a text may be cut between two bytes of its UTF-8 form, spaces standing for `▁`


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def load_pieces(path: str, kind: str = "bpe") -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    normal = [i for i in range(len(names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return make_pieces({names[i]: sp.get_score(i) for i in normal}, {names[i]: i for i in normal}, [i for i in range(len(names)) if sp.is_byte(i)], names, kind)


def make_pieces(score: dict[str, float], ids: dict[str, int], bytes_: list[int], names: list[str], kind: str) -> Pieces:
    cuts = cut_table(score)
    if kind == "bpe":  # a piece that merging its own text doesn't give is never part of an encoding
        score = {p: s for p, s in score.items() if merged(p, score) == [p]}
    return Pieces(score, ids, tuple(bytes_), tuple(names), kind, max(map(len, score), default=1), cuts)


def cut_table(pieces) -> bytes:
    """Between two ASCII characters a cut is free if no piece has the pair. Next to another character it is if no piece has any such pair."""
    table = np.zeros((256, 256), bool)
    table[:128, :128] = table[:128, 192:] = table[128:192, :128] = True
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            sides = []
            for c, wide in ((a, slice(128, 192)), (b, slice(192, 256))):
                # a sign of the text that looks like the space's is a wide character, the space itself is not
                sides.append([*([ord(c)] if ord(c) < 128 else [wide]), *([32] if c == SPACE else [])])
            for x in sides[0]:
                for y in sides[1]:
                    table[x, y] = False
    table[128:192, 192:] = False
    return table.tobytes()


def merged(text: str, score: dict[str, float]) -> list[str]:
    """Byte-pair merges of a short text: the pair with the best score first, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Lattice:
    """Best paths of single units: `path` gives the pieces (characters without a piece stand for themselves)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.pairs: dict[tuple[str, str], bool] = {}
        self.merges: dict[str, list[tuple[float, str, str]]] = {}
        self.tails = {p[i:]: False for p in pieces.score for i in range(len(p))} | dict.fromkeys(pieces.score, True)  # ends of pieces, and whether they are pieces
        self.spelling = spelling(pieces)
        self.unit, self.last = "", [""]  # the last unit, and for every place in it the last piece of the path to it
        self.code: dict[str, bytes] = {}

    def steps(self, piece: str) -> list[tuple[float, str, str]]:
        """The merges that make a piece, in their order: score, first and last part afterwards."""
        found = self.merges.get(piece)
        if found is None:
            score, parts, found = self.pieces.score, list(piece), []
            while len(parts) > 1:
                joined = [score.get(x + y, -np.inf) for x, y in zip(parts, parts[1:])]
                best = max(joined)
                at = joined.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found.append((best, parts[0], parts[-1]))
            self.merges[piece] = found
        return found

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging both texts joined gives them back. Until a merge crosses the border, the merges of either side come in their own
        order, the better one first; the crossing one wins if it is better than the next of both, or equal to that on the right."""
        score, a, b = self.pieces.score, self.steps(left), self.steps(right)
        i, j, x, y = 0, 0, left[-1], right[0]
        crossing = score.get(x + y)
        while True:
            next_a = a[i][0] if i < len(a) else None
            next_b = b[j][0] if j < len(b) else None
            if crossing is not None and (next_a is None or crossing > next_a) and (next_b is None or crossing >= next_b):
                return False
            if next_a is None and next_b is None:
                return True
            if next_b is None or (next_a is not None and next_a >= next_b):
                last = a[i][2]
                i += 1
                if last != x:
                    x = last
                    crossing = score.get(x + y)
            else:
                first = b[j][1]
                j += 1
                if first != y:
                    y = first
                    crossing = score.get(x + y)

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > KNOWN_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._fits(left, right)
        return found

    def _walk(self, unit: str) -> None:
        """The byte-pair paths to every place of a unit. A path hangs on what lies before its end only, so those of the start that the unit shares with the last one are kept."""
        pairs, tails, last = self.pairs, self.tails, self.last
        at = 0
        for x, y in zip(self.unit, unit):
            if x != y:
                break
            at += 1
        self.unit = unit[:at]
        del last[at + 1 :]
        for end in range(at + 1, len(unit) + 1):
            edges = [(end - 1, unit[end - 1])]
            if unit[end - 1] in tails:
                for start in range(end - 2, -1, -1):
                    piece = unit[start:end]
                    whole = tails.get(piece)
                    if whole is None:
                        break
                    if whole:
                        edges.append((start, piece))
            for start, piece in reversed(edges):  # the longest first; one of them fits
                if start:
                    fits = pairs.get((last[start], piece))
                    if not (self.fits(last[start], piece) if fits is None else fits):
                        continue
                last.append(piece)
                break
        self.unit = unit

    def coded(self, units: list[str]) -> dict[str, bytes]:
        """The ids of units, as 32-bit integers. Sorted, neighbours share much of their paths."""
        found, code = {}, self.code
        for unit in sorted(units):
            parts = self.path(unit)
            for n, piece in enumerate(parts):
                ids = code.get(piece)
                if ids is None:
                    ids = code[piece] = np.array(piece_ids(self.pieces, piece), np.uint32).tobytes()
                parts[n] = ids
            found[unit] = b"".join(parts)
        return found

    def path(self, unit: str) -> list[str]:
        n, longest, score = len(unit), self.pieces.longest, self.pieces.score
        if self.pieces.kind == "bpe":
            self._walk(unit)
            last = self.last
        else:
            low = min(score.values(), default=0.0) - UNKNOWN_PENALTY
            total, last = [0.0] + [-np.inf] * n, [""] * (n + 1)
            for end in range(1, n + 1):
                for start in range(max(0, end - longest), end):
                    piece = unit[start:end]
                    s = score.get(piece, low if end - start == 1 else None)
                    if s is not None and total[start] + s > total[end]:
                        total[end], last[end] = total[start] + s, piece
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids(self, unit: str) -> list[int]:
        return [i for piece in self.path(unit) for i in piece_ids(self.pieces, piece)]


def piece_ids(pieces: Pieces, piece: str) -> list[int]:
    if piece in pieces.score:
        return [pieces.ids[piece]]
    return [pieces.bytes_[b] for b in piece.encode()] if pieces.bytes_ else [0]


def units(column: pa.Array, pieces: Pieces) -> tuple[pa.Array, np.ndarray]:
    """The units of all rows and the rows' offsets in them."""
    data, offsets = utf8(column)
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[1:-1] = np.frombuffer(pieces.cuts, bool).reshape(256, 256)[data[:-1], data[1:]]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    values = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data))
    return pc.replace_substring(values, " ", SPACE), np.searchsorted(edges, offsets)


def unit_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """`unit` and `n` over the whole corpus, of units short enough for the dictionary; each slice adds its repeats up first."""

    def run(batches):
        for part in slices(batches, "text", 4 << 20):
            counts = pc.value_counts(units(part.column("text"), pieces)[0])
            names, n = counts.field(0), counts.field(1)
            short = pc.less_equal(pc.utf8_length(names), UNIT_CHARS)
            yield pa.RecordBatch.from_arrays([names.filter(short), n.filter(short)], ["unit", "n"])

    return texts(docs).select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """At most `most` units: all those whose count reaches a step that leaves no more."""
    stored = materialise(counts.where("n > 1"), "unit-counts")
    step = F.floor(8 * F.log2("n")).cast("int")
    sizes = stored.groupBy(step.alias("step")).count().collect()  # steps of the logarithm: a few hundred rows
    total, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return stored.where(step >= least if least is not None else F.lit(False)).select("unit")


def edges(spark: SparkSession, words: DataFrame, pieces: Pieces) -> DataFrame:
    """Lattice of `unit`s: `s`, `e`, `piece`, `id` and `score`; characters without a piece have an edge with id -1."""
    table = spark.createDataFrame(pa.table({"piece": list(pieces.score), "id": [pieces.ids[p] for p in pieces.score], "score": list(pieces.score.values())}))
    low = min(pieces.score.values(), default=0.0) - UNKNOWN_PENALTY
    n = F.length("unit")
    starts = words.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    cut = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s")))).alias("size"))
    cut = cut.select("unit", "s", (F.col("s") + F.col("size")).alias("e"), F.substring(F.col("unit"), F.col("s") + 1, F.col("size")).alias("piece"))
    joined = cut.join(F.broadcast(table), "piece", "left").where("id is not null or e = s + 1")  # the table is as large as the model's vocabulary
    return joined.select("unit", "s", "e", "piece", F.coalesce("id", F.lit(-1)).cast("int").alias("id"), F.coalesce("score", F.lit(low)).alias("score"))


def fitting_pairs(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """`left`, `right`: neighbours in the lattice that merging their joined text leaves as they are."""
    a, b = lattice.select("unit", F.col("e").alias("at"), F.col("piece").alias("left")), lattice.select("unit", F.col("s").alias("at"), F.col("piece").alias("right"))

    def run(batches):
        judge = Lattice(pieces)
        for batch in batches:
            keep = [judge.fits(x, y) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return a.join(b, ["unit", "at"]).select("left", "right").distinct().mapInArrow(run, "left string, right string")


def _trace(places):
    """Pieces of the path that ends at the last place."""
    start = F.struct(F.size(places).cast("int").alias("at"), F.array().cast("array<string>").alias("path"))

    def back(a, _):
        here = F.get(places, a["at"] - 1)
        return F.when(a["at"] > 0, F.struct(here["s"].alias("at"), F.concat(F.array(here["piece"]), a["path"]).alias("path"))).otherwise(a)

    return F.aggregate(places, start, back, lambda a: a["path"])


def best_paths(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """`unit` and `path`, its pieces, folded from the unit's edges in order of their ends."""
    if pieces.kind == "bpe":
        stored = materialise(lattice, "edges")
        pairs = materialise(fitting_pairs(stored, pieces), "piece-pairs")
        a, b = stored.select("unit", F.col("e").alias("s"), F.col("piece").alias("left")), stored.where("s > 0").withColumnRenamed("piece", "right")
        before = b.join(a, ["unit", "s"]).join(pairs, ["left", "right"]).groupBy("unit", "s", "e", "right").agg(F.collect_set("left").alias("lefts"))  # pieces of one place
        reached = before.select("unit", "s", "e", F.col("right").alias("piece"), "lefts").unionByName(
            stored.where("s = 0").select("unit", "s", "e", "piece", F.array().cast("array<string>").alias("lefts")))
        edge = F.struct("e", "s", "piece", "lefts")
    else:
        reached, edge = lattice, F.struct("e", "s", "piece", "score")
    grouped = reached.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))  # a unit has a bounded length, so a bounded number of edges
    if pieces.kind == "bpe":
        none = F.expr("cast(array() as array<struct<s: int, piece: string>>)")

        def step(done, x):
            fits = (F.size(done) == x["e"] - 1) & ((x["s"] == 0) | F.array_contains(x["lefts"], F.get(done, x["s"] - 1)["piece"]))
            return F.when(fits, F.concat(done, F.array(F.struct(x["s"].alias("s"), x["piece"].alias("piece"))))).otherwise(done)
    else:
        none = F.expr("cast(array() as array<struct<s: int, piece: string, total: double>>)")

        def step(done, x):
            total = F.when(x["s"] == 0, F.lit(0.0)).otherwise(F.get(done, x["s"] - 1)["total"]) + x["score"]
            new = F.array(F.struct(x["s"].alias("s"), x["piece"].alias("piece"), total.alias("total")))
            better = F.when(total > F.element_at(done, -1)["total"], F.concat(F.slice(done, 1, F.size(done) - 1), new)).otherwise(done)
            return F.when(F.size(done) < x["e"], F.concat(done, new)).otherwise(better)

    folded = grouped.select("unit", F.aggregate("edges", none, step).alias("places"))
    folded = folded.withColumn("places", F.col("places").cast("array<struct<s: int, piece: string, total: double>>") if pieces.kind != "bpe" else F.col("places"))
    return folded.select("unit", _trace(F.col("places")).alias("path"))


def dictionary(docs: DataFrame, model: str, kind: str = "bpe", most: int = DICTIONARY) -> DataFrame:
    pieces = load_pieces(model, kind)
    return materialise(best_paths(edges(docs.sparkSession, materialise(frequent(unit_counts(docs, pieces), most), "frequent"), pieces), pieces), "unit-paths")


_MEMORY: dict[tuple[str, str], tuple[Lattice, dict[str, bytes]]] = {}


def _memory(model: str, kind: str, pieces: Pieces) -> tuple[Lattice, dict[str, bytes]]:
    if (model, kind) not in _MEMORY:
        _MEMORY[model, kind] = Lattice(pieces), {}
    return _MEMORY[model, kind]


def encode(docs: DataFrame, model: str | None = None, kind: str = "bpe", most: int = DICTIONARY, digest: bool = False) -> DataFrame:
    """`doc_id` and `ids` (little-endian unsigned 32-bit integers) per document; with `digest` instead of `ids` their number `n_pieces`, their `ids_crc32`, and
    `restored`, whether decoding them gives the text."""
    model = model or default_model()
    pieces = load_pieces(model, kind)
    held = docs.sparkSession.sparkContext.broadcast(dict(dictionary(docs, model, kind, most).toArrow().to_pandas().itertuples(index=False, name=None)))  # at most `most` units

    def run(batches):
        local, known = _memory(model, kind, pieces)  # kept from task to task
        ready = {u: np.array([i for p in path for i in piece_ids(pieces, p)], np.uint32).tobytes() for u, path in held.value.items()}
        for part in slices(batches, "text", 4 << 20):
            values, bounds = units(part.column("text"), pieces)
            coded = values.dictionary_encode()
            if len(known) > KNOWN_UNITS:
                known.clear()
            names = coded.dictionary.to_pylist()
            known.update(local.coded([u for u in names if u not in ready and u not in known]))
            found = [ready.get(u) or known[u] for u in names]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat = np.frombuffer(b"".join(found), np.uint32)
            codes = coded.indices.to_numpy().astype(np.int64)
            first = np.cumsum(sizes) - sizes
            lengths = sizes[codes]
            ends = np.cumsum(lengths)
            ids = flat[np.repeat(first[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
            at = np.concatenate([[0], ends])[bounds]
            rows = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            if digest:
                same = [decode(r, pieces, local.spelling) == t.replace(SPACE, " ") for r, t in zip(rows, part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()), pa.array(same, pa.bool_())],
                                                 ["doc_id", "n_pieces", "ids_crc32", "restored"])
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, restored boolean" if digest else "doc_id long, ids binary")


def spelling(pieces: Pieces) -> list[bytes]:
    """The bytes that each id stands for, spaces as `▁`."""
    out = [name.encode() for name in pieces.text]
    for value, i in enumerate(pieces.bytes_):
        out[i] = bytes([value])
    return out


def decode(ids: np.ndarray, pieces: Pieces, spelled: list[bytes] | None = None) -> str:
    """The text of ids: pieces joined, byte pieces put together to characters, the space in front taken away."""
    spelled = spelling(pieces) if spelled is None else spelled
    text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text
