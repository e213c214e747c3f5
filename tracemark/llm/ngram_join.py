"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents become sets of word shingles, documents with equal sets one class. Tokens (shingles) are ordered from rare to frequent. Two sets that link at `percent`
share at least k = ceil(percent of the set) tokens of either one, so the first n - k + m tokens of each, its m-prefix, have at least m in common. Each class chooses its own m: a longer
prefix reads more postings but asks for more matches before a pair is verified. The cost of m is that of the prefix's postings, and of verifying as many candidates
as these postings can give m matches to; the m of least cost is taken. A pair has to share as many prefix tokens as the smaller of its two m, for
the smaller prefix lies within the larger, so no link is lost whatever m is chosen.

Frequencies are exact and cover all classes. Sets travel packed: a chunk of documents sends each range of tokens one sorted array, the range counts its tokens and sends back to every chunk
those found in more classes than one. Tokens of a single class stand first in every order and can't be shared, so only their number counts; a class with fewer shared
tokens than k links with nothing and is done. What is left, the shared tokens of each class from rare to frequent, is enough for prefixes, matches and verification.

Groups of near copies are not turned into all their pairs. The members of a token's list first meet a leader each, the member whose tokens are the most frequent; after that only members of
different components meet: further leaders first, and at the end all pairs of a list that are still apart and whose bitmaps let them link. In a bitmap every token toggles one bit; two sets differ in no
fewer tokens than their bitmaps in bits, so the test loses nothing, and documents that have a passage in common but little else don't become pairs. Crowded lists are cut into tiles. No list is capped.

Edge cases: null or empty texts have an empty set, link with nothing and are their own component. With fewer words than a shingle has,
the whole word sequence is the one shingle. Rows that repeat an id are judged one by one. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.llm.common import mix, slices, texts
from tracemark.llm.near_dups import components, set_digest, shingle_sets
from tracemark.session import bounded_broadcast, materialise

PERCENT, SHINGLE = 80, 5
#: Text of one chunk, and tokens of one range: sizes of work units, whatever the corpus.
CHUNK_BYTES = 8 << 20
RANGE_TOKENS = 2_000_000
#: Cost of comparing one token of a candidate, in postings.
VERIFY = 0.05
#: Members of a list in one tile of its last comparison.
TILE_ROWS = 2_000
LEADER_ROUNDS = 3
#: Bits of the bitmaps.
BITMAP = 512
MAPS = [f"b{i}" for i in range(BITMAP // 64)]


def profiles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`doc_id`, `n_shingles` and `cls`, the name of the set (null for empty ones)."""

    def run(batches):
        for part in slices(batches, "text"):
            sets = list(shingle_sets(part, shingle))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(set_digest(sets).view(np.int64), mask=sizes == 0)], ["doc_id", "n_shingles", "cls"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, cls long")


def _packed(tokens: np.ndarray) -> bytes:
    """Sorted 64-bit tokens as differences, byte plane by byte plane, so that planes of zeros compress away."""
    steps = np.diff(tokens, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pieces(one_each: DataFrame, shingle: int, bits: int) -> DataFrame:
    """Every chunk's tokens by range, with their owners' places in the chunk, and a row of a negative range: the chunk's classes, their sizes and its number of pieces."""

    def send(sets: list[np.ndarray], number: int) -> pa.RecordBatch:
        cls, sizes = set_digest(sets), np.fromiter(map(len, sets), np.uint64, len(sets))
        # named after its contents and place: should a lost task come back with other chunks, their pieces don't mix
        place = np.array([TaskContext.get().partitionId() << 32 | number], np.uint64)
        chunk = int((mix(place) ^ np.bitwise_xor.reduce(mix(cls + sizes))).view(np.int64)[0])
        tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes.astype(np.int64))
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        of = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
        borders = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(borders[1:], len(tokens))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(of[borders], -1 - chunk % (1 << bits))), pa.array([chunk] * (len(borders) + 1), pa.int64()),
             pa.array([_packed(tokens[a:b]) for a, b in zip(borders, ends)] + [cls.tobytes()], pa.binary()),
             pa.array([owners[a:b].tobytes() for a, b in zip(borders, ends)] + [sizes.tobytes()], pa.binary()),
             pa.array([None] * len(borders) + [len(borders)], pa.int32())], ["range", "chunk", "tokens", "owners", "pieces"])

    def run(batches):
        held, size, number = [], 0, 0
        for part in slices(batches, "text"):
            held, size = held + [s for s in shingle_sets(part, shingle) if len(s)], size + part.column("text").nbytes
            if held and size >= CHUNK_BYTES:
                yield send(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield send(held, number)

    return one_each.mapInArrow(run, "range long, chunk long, tokens binary, owners binary, pieces int")


def _shared(pieces: DataFrame) -> DataFrame:
    """Per chunk and range the tokens of more classes than one, their number of classes `df` and `owners`, packed; the chunks' own rows as they are."""

    def count(group: pa.Table) -> pa.Table:
        if group.column("range")[0].as_py() < 0:
            return group.select(["chunk", "tokens", "owners", "pieces"]).append_column("df", pa.nulls(group.num_rows, pa.binary()))
        parts = [_unpacked(x) for x in group.column("tokens").to_pylist()]
        tokens = np.concatenate(parts)
        order = np.argsort(tokens)
        first = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order[0]] + np.uint64(1)))
        counts = np.diff(np.append(first, len(tokens)))
        df = np.empty(len(tokens), np.uint32)
        df[order] = np.repeat(counts, counts)
        found, at = [[], [], []], np.cumsum([0, *map(len, parts)])
        for i, owners in enumerate(group.column("owners").to_pylist()):
            mine = slice(at[i], at[i + 1])
            again = df[mine] > 1
            for out, values in zip(found, (tokens[mine], np.frombuffer(owners, np.uint32), df[mine])):
                out.append(values[again].tobytes())
        tokens, owners, df = (pa.array(f, pa.binary()) for f in found)
        return pa.table([group.column("chunk"), tokens, owners, group.column("pieces"), df], names=["chunk", "tokens", "owners", "pieces", "df"])

    return pieces.groupBy("range").applyInArrow(count, "chunk long, tokens binary, owners binary, pieces int, df binary")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens that a hash sends to each bit, as 64-bit words."""
    odd = np.bincount((mix(tokens) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_matches(n: int, unique: int, df: np.ndarray, percent: int) -> int:
    """The m of least cost for a set of `n` tokens of which `unique` are in no other set, the rest in `df` sets each, from rare to frequent."""
    share = -(-n * percent // 100)
    m = np.arange(1, share + 1)
    postings = np.concatenate([[0], np.cumsum(df - 1)])[n - share + m - unique]
    return int(m[np.argmin(postings + VERIFY * n * postings / m)])


def linkable(docs: DataFrame, classes: DataFrame, total: int, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Per class with enough shared tokens to link: `cls`, `n`, its `shared` tokens from rare to frequent, `m` and its `prefix` (the shared tokens of the m-prefix).

    `total` is about the number of tokens of all classes and steers the ranges alone.
    """
    wanted = classes.select(F.col("doc_id").alias("_wanted")).distinct()
    one_each = texts(docs).join(bounded_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
    bits = int(total // RANGE_TOKENS).bit_length()

    def gather(chunk: pa.Table) -> pa.Table:
        is_name = np.array(chunk.column("pieces").is_valid())
        name, found = chunk.filter(pa.array(is_name)), chunk.filter(pa.array(~is_name))
        if name.num_rows != 1 or name.column("pieces")[0].as_py() != found.num_rows:
            raise RuntimeError("a chunk and its pieces come from different runs of a task")
        cls, sizes = (np.frombuffer(name.column(c)[0].as_py(), np.uint64) for c in ("tokens", "owners"))
        tokens, owners, df = (np.concatenate([np.frombuffer(x, kind) for x in found.column(c).to_pylist()]) for c, kind in (("tokens", np.uint64), ("owners", np.uint32), ("df", np.uint32)))
        order, df = np.lexsort((tokens, df, owners)), df.astype(np.int64)
        tokens, df, ends = tokens[order], df[order], np.searchsorted(owners[order], np.arange(len(cls) + 1))
        rows = []
        for i in np.flatnonzero(100 * np.diff(ends) >= percent * sizes.astype(np.int64)).tolist():
            n, mine = int(sizes[i]), slice(ends[i], ends[i + 1])
            unique = n - int(ends[i + 1] - ends[i])
            m = prefix_matches(n, unique, df[mine], percent)
            shared = tokens[mine].view(np.int64)
            prefix = shared[: n - -(-n * percent // 100) + m - unique]
            rows.append((int(cls[i : i + 1].view(np.int64)[0]), n, m, int(df[mine].sum()), shared, prefix, *bitmap(tokens[mine]).tolist()))
        columns = list(zip(*rows)) if rows else [()] * (6 + len(MAPS))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.int64()] * len(MAPS)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cls", "n", "m", "weight", "shared", "prefix", *MAPS])

    schema = "cls long, n long, m long, weight long, shared array<long>, prefix array<long>, " + ", ".join(f"{b} long" for b in MAPS)
    # rows without an id, or that repeat one, may bring a class twice
    return _shared(_pieces(one_each, shingle, bits)).groupBy("chunk").applyInArrow(gather, schema).dropDuplicates(["cls"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes that share as many prefix tokens as the smaller m asks for, and link on their whole sets."""
    side = lambda name: sets.select(F.col("cls").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "m", "prefix", "shared")))
    matches = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("m_a", "m_b")
    both = F.size(F.array_intersect("shared_a", "shared_b")).cast("long")
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(sized & matches)
    return joined.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _apart(postings: DataFrame, label: DataFrame | None) -> DataFrame:
    """Postings of the lists that still meet several components, with each member's `label`."""
    if label is None:
        return postings.withColumn("label", F.col("cls"))
    here = postings.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = here.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    return materialise(here.join(mixed, "token", "left_semi"), "apart")


def _led(here: DataFrame, led: DataFrame | None) -> DataFrame:
    """Members and leaders of different components, of every list; leaders that led before are passed over."""
    able = here if led is None else here.join(bounded_broadcast(led), "cls", "left_anti")
    lead = able.groupBy("token").agg(F.max(F.struct("weight", "cls", "label")).alias("lead"))
    lead = materialise(lead.select("token", F.col("lead.cls").alias("lead"), F.col("lead.label").alias("lead_label")), "leads")
    return here.join(lead, "token").where("label <> lead_label").select("cls", "lead")


def _all_apart(here: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list that are in different components, near enough in size and in bitmaps, found under as many tokens as the smaller m asks for.

    Lists are divided by size: a size step is the ratio of sizes that can link, so a set meets its own step and the next one up.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    full = here.join(sets.select("cls", F.size("shared").alias("s"), *MAPS), "cls").withColumn("step", step)
    crowded = full.groupBy("token", "step").count().where(F.col("count") > TILE_ROWS).select("token", "step", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("tiles"))
    crowded = bounded_broadcast(materialise(crowded, "crowded-lists"))
    columns = ["cls", "n", "s", "m", "label", *MAPS]
    keys = ["token", "step", "row", "col"]
    own, tiles = F.pmod(F.xxhash64("cls"), F.col("tiles")), lambda rows: rows.join(crowded, ["token", "step"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1))
    # the left side comes under its own step and the next, where it looks for larger sets; tiles are those of the step looked at
    left = tiles(full.withColumn("own_step", F.col("step")).withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + 1))))
    left = left.withColumn("row", own).withColumn("col", other).select(*keys, "own_step", *(F.col(c).alias(f"{c}_l") for c in columns))
    right = tiles(full).withColumn("col", own).withColumn("row", other).select(*keys, *(F.col(c).alias(f"{c}_r") for c in columns))
    bits = sum((F.bit_count(F.col(f"{b}_l").bitwiseXOR(F.col(f"{b}_r"))) for b in MAPS[1:]), F.bit_count(F.col("b0_l").bitwiseXOR(F.col("b0_r"))))
    most = F.col("s_l") + F.col("s_r") - bits  # twice the tokens in common, at the most
    near = (100 * F.least("n_l", "n_r") >= percent * F.greatest("n_l", "n_r")) & ((100 + percent) * most >= 2 * percent * (F.col("n_l") + F.col("n_r")))
    once = (F.col("own_step") < F.col("l.step")) | (F.col("cls_l") < F.col("cls_r"))
    equal = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    met = left.alias("l").join(right.alias("r"), reduce(Column.__and__, [*equal, F.col("label_l") != F.col("label_r"), once, near]))
    counted = met.groupBy(F.least("cls_l", "cls_r").alias("a"), F.greatest("cls_l", "cls_r").alias("b")).agg(F.count("*").alias("found"), F.first(F.least("m_l", "m_r")).alias("m"))
    return counted.where("found >= m").select("a", "b")


def linked(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Per document `doc_id`, `n_shingles`, `component_id` (smallest id reachable over links), `n_copies` (documents with the same set) and `cls`, the set's name (null without words)."""
    rows = materialise(profiles(docs, shingle), "join-profiles")
    classes = materialise(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n")), "join-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    sets = materialise(linkable(docs, classes, total, percent, shingle), "join-sets")
    postings = sets.select("cls", "n", "m", "weight", F.explode("prefix").alias("token"))
    met_twice = postings.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("token")
    postings = materialise(postings.join(met_twice, "token", "left_semi"), "postings")
    label, links, tested, led = None, None, None, None
    for turn in range(LEADER_ROUNDS + 1):
        here = _apart(postings, label)
        if turn < LEADER_ROUNDS:
            met = _led(here, led)
            pairs = met.select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()
        else:
            pairs = _all_apart(here, sets, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "join-pairs")
        if turn < LEADER_ROUNDS:
            now = materialise(met.select(F.col("lead").alias("cls")).distinct(), "led")
            led = now if led is None else led.unionByName(now)
        if pairs.isEmpty():
            if turn == 0:
                break
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = materialise(verified(pairs, sets, percent), "join-links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = components(links)
    of_class = classes.select("cls", "doc_id", "n_copies")
    if label is None:
        of_class = of_class.select("cls", F.col("doc_id").alias("component_id"), "n_copies")
    else:
        joined = materialise(of_class.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "join-labelled")
        least = materialise(joined.groupBy("label").agg(F.min("doc_id").alias("component_id")), "join-least")
        of_class = joined.join(least, "label").select("cls", "component_id", "n_copies")
    out = rows.join(materialise(of_class, "join-of-class"), "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "cls")
