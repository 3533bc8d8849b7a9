"""The manifest against a tree built level by level in Python, appends, and what tampering does."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from martloom.llm.merkle import FIELDS, OpenSubtrees, digest, extend, fold, leaf_hash, merkle_manifest, siblings, verify

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, size string, tree int, witness string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The root, and each node's siblings from below."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
        for k, proof in enumerate(proofs):
            run = runs[at[k] // 2]
            proof += [x for j, x in enumerate(run) if j != at[k] % 2]
            at[k] //= 2
        nodes = [h(*run) for run in runs]
    return nodes[0], proofs


def plain(rows):
    """(doc_id, leaf, subroot, root, digest of the proof) of each row."""
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0], h(*map(field, r[:5]))))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    sorted_trees = [sorted(trees[n], key=lambda x: (x[0] is not None, x)) for n in names]
    built = [plain_tree([leaf for _, leaf in t]) for t in sorted_trees]
    root, tops = plain_tree([b[0] for b in built])
    return sorted(
        (
            (key, leaf, subroot, root, h(*proof, *top))
            for t, (subroot, proofs), top in zip(sorted_trees, built, tops)
            for (key, leaf), proof in zip(t, proofs)
        ),
        key=str,
    )


def rows_of(count: int):
    langs = ["en", "en", "en", "de", None, "", "zz", "é", "z"]
    rows = [(k, f"s{k % 3}", langs[k % 7 if k % 5 else 0], None if k % 11 == 0 else k, None if k % 13 == 0 else "é" * (k % 4)) for k in range(count)]
    rows += [(3, "s", "en", 1, "x"), (3, "s", "en", 1, "x"), (3, "t", "en", 1, "x"), (None, None, None, None, None), (None, None, None, None, ""), (7, "-", "é", 0, "-")]
    rows += [(10_000, "s", "z", 5, "long " * 50_000)]
    return [(*r, 1, "a", 2, "b") for r in rows]


def table(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def found(manifest):
    got = verify(manifest).collect()
    assert all(r.verified and r.folded_root == r.root for r in got)
    return sorted((tuple(r)[:5] for r in got), key=str)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, bits):
    rows = rows_of(150)
    assert found(merkle_manifest(table(spark, rows), bits=bits)) == plain(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 8, 9])
def test_small_trees(spark, count):
    rows = [(k, "s", "en", 1, "t", 1, "a", 2, "b") for k in range(count)]
    assert found(merkle_manifest(table(spark, rows, 1), bits=2)) == plain(rows)


def test_the_order_of_the_input_does_not_matter(spark):
    rows = rows_of(60)
    roots = {merkle_manifest(table(spark, rows[::step], n), bits=2).root for step, n in ((1, 1), (-1, 5))}
    assert len(roots) == 1


def test_empty(spark):
    manifest = merkle_manifest(table(spark, []))
    assert manifest.root is None and verify(manifest).isEmpty()


@pytest.mark.parametrize("cut", [0, 1, 64, 90, 150])
def test_extend(spark, cut):
    rows = [(k, "s", ["en", "en", "de"][k % 3] if k < 120 else "new", k, "t", 1, "a", 2, "b") for k in range(150)]
    whole = merkle_manifest(table(spark, rows), bits=3)
    grown = extend(merkle_manifest(table(spark, rows[:cut]), bits=3), table(spark, rows[cut:]))
    assert grown.root == whole.root
    assert found(grown) == found(whole) == plain(rows)


def test_full_blocks_are_not_grown_again(spark):
    rows = [(k, "s", "en", k, "t", 1, "a", 2, "b") for k in range(20)]
    first = merkle_manifest(table(spark, rows[:16]), bits=2)
    steps = {r.key: bytes(r.witness) for r in first.rows.collect()}
    later = {r.key: bytes(r.witness) for r in extend(first, table(spark, rows[16:])).rows.collect()}
    assert {k: later[k] for k in steps} == steps


def test_late_keys_are_refused(spark):
    rows = [(k, "s", "en", k, "t", 1, "a", 2, "b") for k in range(9)]
    first = merkle_manifest(table(spark, rows[4:]), bits=2)
    with pytest.raises(ValueError, match="not an append"):
        extend(first, table(spark, rows[:4]))


def test_tampered_rows_do_not_verify(spark):
    rows = rows_of(80)
    docs = table(spark, rows)
    changed = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    claim = F.when(F.col("doc_id") % 2 == 0, leaf_hash([changed.get(f, F.col(f)) for f in FIELDS]))
    got = verify(merkle_manifest(docs, carry={"claim": claim}, bits=2)).collect()
    with_n = {r[0] for r in rows if r[3] is not None}
    for r in got:
        assert r.verified == (r.key is None or r.key % 2 == 1 or r.key not in with_n), r


def test_open_subtrees():
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(7)]
    trees = OpenSubtrees(7, 3)
    for leaf in leaves:
        trees.append(leaf)
    root = trees.close()
    assert root == digest(digest(digest(*leaves[:2]), digest(*leaves[2:4])), digest(digest(*leaves[4:6]), digest(leaves[6])))
    for leaf, steps in zip(leaves, trees.steps):
        assert fold(leaf, steps.tobytes()) == root
    assert siblings(trees.steps[6].tobytes())[0] == digest(*leaves[4:6])
