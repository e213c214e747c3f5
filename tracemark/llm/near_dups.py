"""MinHash near-duplicates, verified by odd sketches and then on the full sets.

Documents become sets of word shingles. Documents with equal sets form a class, and all later work is on classes, so a group of
exact copies costs one row. Each class has `BANDS` keys of `ROWS` MinHash samples; classes that share a key are candidates. The samples of one more
permutation, cut into `BINS` bins with the smallest value of each, are folded into an odd sketch, a bitmap in which every sample toggles one
bit: the population count of the XOR of two sketches tells how many samples differ, precisely so for the high similarities asked for here.
Candidates whose sketches rule out the threshold go; the rest is confirmed on the sets themselves.

Groups of near copies are not turned into all their pairs. Each key first links its members to one leader, the member that shares its
keys with most classes: of copies made from one text that is the text itself, or the closest to it. After that only members of different
components meet, first with further leaders from outside the largest component of a key, and at the end all pairs of a key that are
still in different components and pass the sketch test inside the join; crowded keys are divided by size and cut into tiles for that. No partner is capped.

Edge cases: null or empty texts have an empty set, link with nothing and are their own component. With fewer words than a shingle has,
the whole word sequence is the one shingle. Rows that repeat an id are judged one by one. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.llm.common import LOWER, mix, slices, span_hashes, texts, utf8, words
from tracemark.session import bounded_broadcast, materialise

SHINGLE = 5
#: A pair at similarity 0.75 shares none of 36 keys of 5 samples with probability 6e-5, at 0.8 with 6e-7.
BANDS, ROWS = 36, 5
SAMPLES = BANDS * ROWS
BINS = 1024
SKETCH_WORDS = BINS // 64
#: Standard deviations by which sketches must differ too much before a pair is dropped unseen.
SIGMAS = 4.5
#: Star rounds before the last one, which compares whatever is left.
STAR_ROUNDS = 2
#: Members of a key, of one size step, in one tile of the last round.
TILE_ROWS = 2_000

SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its shingles."""
    data, offsets = utf8(batch.column("text"))
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n = max(len(hashes) - size + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for i in range(size):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    rolled = mix(rolled)
    first = np.searchsorted(row, np.arange(batch.num_rows + 1))
    for at, end in zip(first[:-1].tolist(), first[1:].tolist()):
        if end - at >= size:
            yield np.unique(rolled[at : end - size + 1])
        elif end > at:
            whole = np.uint64(end - at)
            for h in hashes[at:end]:
                whole = mix(np.array([whole]) * np.uint64(0xD6E8FEB86659FD93) + h)[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def set_digest(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit name per set, the same for equal sets; 0 for the empty one."""
    out = np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            total, parity = int(np.add.reduce(mix(s))), int(np.bitwise_xor.reduce(mix(s + np.uint64(0x51ED270B))))
            out[i] = (total + 0x9E3779B97F4A7C15 * parity + len(s)) & 0xFFFFFFFFFFFFFFFF
    return mix(out)


def minhash(s: np.ndarray) -> np.ndarray:
    """`SAMPLES` minima of a set under random affine maps."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        part = s[at : at + 512]
        np.minimum(out, (part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=out)
    return out


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Bitmap of a sorted set: the smallest value of each bin (the top bits of a hash) toggles the bit that its mix names."""
    bins = s >> np.uint64(54)
    least = np.ones(len(s), bool)
    least[1:] = bins[1:] != bins[:-1]
    odd = np.bincount((mix(s[least]) >> np.uint64(54)).astype(np.int64), minlength=BINS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(samples), 1))
    for i in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + samples[:, i::ROWS])
    return key


def estimated_similarity(xor_bits: int, n_a: int, n_b: int) -> float:
    """Similarity of two sets of these sizes that the population count of their sketches' XOR speaks for."""
    filled = lambda n: BINS * (1 - np.exp(-n / BINS))
    differing = -BINS / 2 * np.log(max(1 - 2 * xor_bits / BINS, 1e-9))
    equal, share = (filled(n_a) + filled(n_b) - differing) / 2, 1.0
    for _ in range(30):  # the union's size depends on the similarity that is looked for
        share = float(np.clip(equal / max(filled((n_a + n_b) / (1 + share)), 1e-9), 0, 1))
    return share


def sketch_limit(n, threshold: float):
    """Most bits in which the sketches of two sets of size `n` may differ to be worth a check on the sets; it grows with `n`.

    At the threshold the sets' union has 2 n / (1 + threshold) elements, which fill a known number of bins on average; the share `threshold` of
    these have equal samples. Their number varies like draws without replacement, and the bits vary through samples that meet in one.
    """
    union = 2 * n / (1 + threshold)
    filled = lambda x: BINS * (1 - F.exp(-x / BINS))
    bins = filled(union)
    differ = F.greatest(2 * filled(n * 1.0) - 2 * threshold * bins, F.lit(0.0))
    drawn = bins * threshold * (1 - threshold) * F.greatest(union - bins, F.lit(1.0)) / union
    fade = F.exp(-2 * differ / BINS)
    spread = F.greatest(BINS / 4 * (1 - fade * fade) - differ * fade * fade, F.lit(1.0)) + 4 * drawn * fade * fade
    return F.ceil(BINS / 2 * (1 - fade) + SIGMAS * F.sqrt(spread) + 2).cast("int")


def profiles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`doc_id`, `n_shingles`, `cls` (null for empty sets), `bands` array and sketch words per document."""

    def run(batches):
        for part in slices(batches, "text"):
            sets = list(shingle_sets(part, shingle))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            samples = np.stack([minhash(s) for s in sets])
            sketches = np.stack([odd_sketch(s) for s in sets]).view(np.int64)
            keys = band_keys(samples).view(np.int64)
            cls = pa.array(set_digest(sets).view(np.int64), mask=sizes == 0)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), cls, bands, *(pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(SKETCH_WORDS))],
                ["doc_id", "n_shingles", "cls", "bands", *SKETCH])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, cls long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH))


def class_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`cls` and the whole `items` of the set, one row per document with a set."""

    def run(batches):
        for part in slices(batches, "text"):
            sets = [s for s in shingle_sets(part, shingle) if len(s)]
            ends = np.cumsum([0, *map(len, sets)])
            items = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_digest(sets).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(items))], ["cls", "items"])

    return texts(docs).mapInArrow(run, "cls long, items array<long>")


def _store_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Sets of the wanted classes, read anew from one document of each."""
    ids = materialise(reps.join(wanted, "cls", "left_semi").select("doc_id", "cls"), "wanted-ids")
    rows = texts(docs).join(bounded_broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    found = class_sets(rows, shingle).groupBy("cls").agg(F.first("items").alias("items"))
    return materialise(found.join(bounded_broadcast(ids.select("cls")), "cls", "left_semi"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - both
    return pairs.join(right, "b").join(left, "a").where(100 * both.cast("long") >= percent * union.cast("long")).select("a", "b")


def sketch_near(left: str, right: str, percent: int):
    """Whether sizes and sketches leave the threshold within reach."""
    n_a, n_b = F.col(f"{left}.n"), F.col(f"{right}.n")
    bits = sum((F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{left}.s0").bitwiseXOR(F.col(f"{right}.s0"))))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (bits <= F.greatest(F.col(f"{left}.most"), F.col(f"{right}.most")))


def _all_apart(here: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes that share a key, are in different components and pass the sketch test.

    A key's members are divided by size: a size step is the ratio of sizes that can link, so a set meets its own step and the next one up. What is
    still crowded is cut into square tiles, so no task meets more than a tile of a key.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    full = here.select("cls", "band", "key", "label").join(sketches, "cls").withColumn("step", step)
    crowded = full.groupBy("key", "step").count().where(F.col("count") > TILE_ROWS).select("key", "step", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("tiles"))
    crowded = bounded_broadcast(materialise(crowded, "crowded-keys"))

    def tiled(rows: DataFrame, own: str, other: str) -> DataFrame:
        cut = rows.join(crowded, ["key", "step"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        return cut.withColumn(own, F.pmod(F.xxhash64("cls"), F.col("tiles"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)))

    # the left side comes under its own step and the next, where it looks for larger sets; tiles are those of the step looked at
    left = tiled(full.withColumn("own_step", F.col("step")).withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + 1))), "row", "col")
    right = tiled(full, "col", "row")
    once = (F.col("l.own_step") < F.col("l.step")) | (F.col("l.cls") < F.col("r.cls"))
    # a pair comes under the first key it shares only, so nothing has to be made distinct
    before = F.arrays_overlap(F.slice(F.col("l.bands"), F.lit(1), F.col("l.band")), F.slice(F.col("r.bands"), F.lit(1), F.col("l.band")))
    met = (F.col("l.label") != F.col("r.label")) & once & sketch_near("l", "r", percent) & ~before
    for c in ("key", "step", "row", "col"):
        met &= F.col(f"l.{c}") == F.col(f"r.{c}")
    return left.alias("l").join(right.alias("r"), met).select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """`node`, `label`: every node that has a link and the smallest node of its component.

    Each round lets a node point at its smallest neighbour, follows the pointers to their ends and contracts the links; what is left between
    the ends goes into the next round. Rounds needed grow with the logarithm of the longest chain. Everything stays distributed.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    label = None
    while not edges.isEmpty():
        up = materialise(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "parents")
        while True:
            top = up.select(F.col("node").alias("label"), F.col("label").alias("above"))
            jumped = materialise(up.join(top, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "jump")
            up = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        to_a = up.select(F.col("node").alias("a"), F.col("label").alias("la"))
        to_b = up.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
        edges = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
        if label is None:
            label = up
        else:
            above = up.select(F.col("node").alias("label"), F.col("label").alias("above"))
            label = label.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")).unionByName(up.join(label, "node", "left_anti"))
        label = materialise(label, "labels")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).where("false")
    roots = label.select(F.col("label").alias("node"), "label").distinct()
    return materialise(label.unionByName(roots.join(label, "node", "left_anti")), "components")


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """Per document `doc_id`, `n_shingles`, `component_id` (smallest id reachable over links), `kept` (it is that document) and
    `n_copies`, the number of documents with the same set, whose name is `cls` (null without words)."""
    rows = materialise(profiles(docs, shingle), "profiles")
    # copies become one row before anything is joined, so a group of copies meets in no task
    firsts = [F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in SKETCH)]
    classes = materialise(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), *firsts), "classes")
    keys = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared-keys")
    keys = materialise(keys.join(shared, "key"), "keys")
    popular = materialise(keys.groupBy("cls").agg(F.sum("size").alias("popular")), "popular")
    sketches = materialise(classes.join(popular, "cls", "left_semi").select("cls", "n", "bands", *SKETCH, sketch_limit(F.col("n"), percent / 100).alias("most")), "sketches")
    sets = _store_sets(docs, classes, popular.select("cls"), shingle)
    keys = materialise(keys.drop("size").join(popular, "cls"), "popular-keys")
    links, tested, label, leaders = None, None, None, None
    for turn in range(STAR_ROUNDS + 1):
        if label is None:
            here = keys.withColumn("label", F.col("cls"))
        else:
            here = keys.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
            mixed = here.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
            here = materialise(here.join(materialise(mixed, "mixed-keys"), "key", "left_semi"), "mixed")
        if turn < STAR_ROUNDS:
            most = F.max(F.struct("popular", "cls", "label")).alias("lead")
            lead = here.groupBy("key").agg(most)
            if leaders is not None:  # one that has not led yet, outside the component of the most popular member
                fresh = here.join(lead.select("key", F.col("lead.label").alias("main")), "key").where("label <> main").join(bounded_broadcast(leaders), "cls", "left_anti")
                lead = fresh.groupBy("key").agg(most)
            lead = materialise(lead.select("key", F.col("lead.label").alias("lead_label"), F.col("lead.cls").alias("lead")), "leads")
            now = lead.select(F.col("lead").alias("cls")).distinct()
            leaders = materialise(now if leaders is None else leaders.unionByName(now), "leaders")
            pairs = here.join(lead, "key").where("label <> lead_label").select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b"))
        else:
            pairs = _all_apart(here, sketches, percent)
        if turn < STAR_ROUNDS:
            pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        if pairs.isEmpty():
            if not turn:  # no two classes share a key
                break
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        if turn < STAR_ROUNDS:
            light = sketches.drop("bands")
            a, b = light.withColumnRenamed("cls", "a").alias("l"), light.withColumnRenamed("cls", "b").alias("r")
            pairs = pairs.join(a, "a").join(b, "b").where(sketch_near("l", "r", percent)).select("a", "b")
        found = materialise(confirm(pairs, sets, percent), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = components(links)

    of_class = classes.select("cls", "doc_id", "n_copies")
    if label is None:
        of_class = of_class.select("cls", F.col("doc_id").alias("component_id"), "n_copies")
    else:
        joined = of_class.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        joined = materialise(joined, "labelled")
        least = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        of_class = joined.join(materialise(least, "least"), "label").select("cls", "component_id", "n_copies")
    out = rows.select("doc_id", "n_shingles", "cls").join(materialise(of_class, "of-class"), "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "cls")


def class_of(text: Column, shingle: int = SHINGLE) -> Column:
    """The name of each text's class, null without words."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([column.fill_null("")], ["text"])]), "text"):
            sets = list(shingle_sets(part, shingle))
            out.append(pa.array(set_digest(sets).view(np.int64), mask=np.array([not len(s) for s in sets])))
        return pa.concat_arrays(out) if out else pa.array([], pa.int64())

    return F.arrow_udf(run, "long")(text)


def keep_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of `docs`, all columns, of one document of each group. Rows without an id stay. Of rows that repeat both an id and a class one stays."""
    found = materialise(near_duplicates(docs, percent), "near-duplicates")
    gone = materialise(found.where("not kept").select("doc_id").distinct(), "gone")
    again = materialise(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    rest = docs.join(bounded_broadcast(gone), "doc_id", "left_anti")
    if again.isEmpty():
        return rest
    name = "_class"
    while name in docs.columns:
        name += "_"
    kept = found.where("kept").join(bounded_broadcast(again), "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("cls").alias("_cls")).distinct()
    kept = materialise(kept, "kept-repeated")
    rows = docs.join(bounded_broadcast(again), "doc_id", "left_semi").withColumn(name, class_of(F.col("text")))
    once = rows.join(kept, (rows["doc_id"] == kept["_id"]) & rows[name].eqNullSafe(kept["_cls"]), "left_semi").dropDuplicates(["doc_id", name]).drop(name)
    return rest.join(bounded_broadcast(again), "doc_id", "left_anti").unionByName(once.select(*docs.columns)).select(*docs.columns)
