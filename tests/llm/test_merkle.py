import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracemark.llm import merkle

from .conftest import EDGES, make


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang):
    fields = (doc_id, "src", lang, None if text is None else len(text), text)
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """Root and, per leaf, the steps (before, after)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 8 * 8
            steps[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 8])))
            at[i] = place // 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], steps


def brute(rows):
    """Root and sorted (doc_id, leaf, subroot, steps)."""
    keys = sorted({r[2] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    groups = {k: sorted((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[2] == k) for k in keys}
    trees = {k: climb([g[2] for g in group]) for k, group in groups.items()}
    root, above = climb([trees[k][0] for k in keys])
    out = [(g[3][0], g[2], trees[k][0], trees[k][1][i] + above[n]) for n, k in enumerate(keys) for i, g in enumerate(groups[k])]
    return root, sorted(out, key=str)


def proved(trees, wanted=None):
    rows = merkle.proofs(trees, wanted).join(trees.trees.select("tree", "subroot"), "tree").collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], [(s["before"], s["after"]) for s in r["proof"]]) for r in rows), key=str)


def many(n=700):
    rng = random.Random(6)
    return [(i, f"text {i % 90}", rng.choice(["en", "en", "en", "de", "é", "zz", None])) for i in range(n)]


@pytest.mark.parametrize("size, part", [(700, 8), (700, 4096), (1, 8), (9, 64)])
def test_proofs_equal_brute_force(spark, monkeypatch, size, part):
    monkeypatch.setattr(merkle, "PART_LEAVES", part)
    monkeypatch.setattr(merkle, "PART_LEVELS", {8: 1, 64: 2, 4096: 4}[part])
    rows = many(size)
    trees = merkle.forest(merkle.leaves(make(spark, rows)))
    root, expected = brute(rows)
    assert trees.root == root and proved(trees) == expected
    some = trees.leaves.where("pos % 11 = 3 or pos = 64")
    ids = {r["doc_id"] for r in some.collect()}
    assert proved(trees, some) == [e for e in expected if e[0] in ids]
    folded = merkle.proofs(trees).select(merkle.folded(F.col("leaf"), F.col("proof")).alias("r")).distinct().collect()
    assert [r["r"] for r in folded] == [root]


def test_many_keys_make_a_deep_upper_tree(spark):
    rows = [(i, "t", f"k{i % 75}") for i in range(300)]
    trees = merkle.forest(merkle.leaves(make(spark, rows)))
    assert (trees.root, proved(trees)) == brute(rows)


def test_edges(spark, edges, nothing):
    trees = merkle.forest(merkle.leaves(edges))
    assert (trees.root, proved(trees)) == brute(EDGES)
    empty = merkle.forest(merkle.leaves(nothing))
    assert empty.root is None and merkle.proofs(empty).collect() == []


def test_missing_nodes_are_the_fewest():
    """Nothing asked for can be derived, and everything needed is asked for."""
    rng = random.Random(2)
    for _ in range(30):
        size = rng.randint(1, 900)
        known = np.array(sorted(rng.sample(range(size), rng.randint(1, min(size, 40)))))
        found = {(level, i) for level, idx in merkle.missing(known, size) for i in idx.tolist()}
        derived, level, width, needed = set(known.tolist()), 0, size, set()
        while width > 1:
            runs = {i // 8 for i in derived}
            needed |= {(level, i) for r in runs for i in range(8 * r, min(8 * r + 8, width)) if i not in derived}
            derived, level, width = runs, level + 1, -(-width // 8)
        assert found == needed


def test_registered_query_finds_tampering(spark, tmp_path):
    rows = EDGES + [(i, f"{'Upper' if i % 2 else 'lower'} {i}", "en") for i in range(100, 140)]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    root, expected = brute(rows)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in found), key=str) == sorted(
        ((i, x, sub, root, sha("".join(b + a for b, a in steps))) for i, x, sub, steps in expected), key=str)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t)
    for r in found:
        touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any(t and any("A" <= c <= "Z" for c in t) for t in texts[r["doc_id"]])
        assert r["verified"] == (not touched) == (r["folded_root"] == r["root"])
    assert 0 < sum(not r["verified"] for r in found) < len(found)
