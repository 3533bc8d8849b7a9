"""Fingerprints and components against plain versions, and that no pair passes the anchors."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from llm_tables import LONG, lowered, plain_roots, table, texts, words_of
from martloom.llm import simhash
from martloom.llm.queries import op11_simhash_near_dedup
from martloom.llm.simhash import COARSE, FINE, GOLAY_RADIUS, Window, anchors_of, check_windows, fingerprints, golay_words, simhash_near


def plain_print(text) -> int:
    w = words_of(lowered(text))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    least = plain_roots([i for i, _ in rows], linked)
    return sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, least)), key=str)


def near_texts(seed: int):
    """Long texts with one word changed, so that many fingerprints differ in a few bits."""
    rnd = np.random.default_rng(seed)
    base = [f"w{k}" for k in rnd.integers(0, 5000, 400)]
    out = []
    for _ in range(40):
        words = list(base)
        for k in rnd.integers(0, 400, rnd.integers(1, 4)):
            words[k] = f"x{k}"
        out.append(" ".join(words))
    return out


def test_fingerprints():
    some = [*(t for _, t in texts(3)), LONG, "a b c", "A\tb\nc d", "İ ſ K"]
    assert fingerprints(some).tolist() == [plain_print(t) for t in some]


def test_golay_code_is_perfect():
    words = golay_words()
    assert len(set(words.tolist())) == 4096 and min(int(w).bit_count() for w in words if w) == 7
    points = np.random.default_rng(1).integers(0, 1 << 23, 500).astype(np.uint32)
    assert ((np.bitwise_count(points[:, None] ^ words) <= GOLAY_RADIUS).sum(axis=1) == 1).all()


@pytest.mark.parametrize("windows", [COARSE, FINE])
def test_every_pair_meets_at_a_home(windows):
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 1 << 64, 300, np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rnd.integers(0, 64, len(x)).astype(np.uint64)
    met = np.zeros(len(x), bool)
    for w in windows:
        fits = np.bitwise_count((x ^ y) & np.uint64(w.mask)) <= w.threshold
        index, anchor, is_home = anchors_of(x, w)
        assert (np.bincount(index[is_home], minlength=len(x)) == 1).all()
        home = anchor[is_home][np.argsort(index[is_home])]
        index, anchor, _ = anchors_of(y, w)
        visits = set(zip(index.tolist(), anchor.tolist()))
        assert len(visits) == len(index)
        there = np.array([(k, home[k]) in visits for k in range(len(x))])
        assert there[fits].all()
        met |= fits
    assert met.all()


def test_windows_that_could_miss_are_refused():
    with pytest.raises(ValueError, match="could pass"):
        check_windows(COARSE, 5)
    with pytest.raises(ValueError, match="overlap"):
        check_windows((Window(0, 23, 0, 1), Window(22, 23, 0, 2)), 4)


@pytest.mark.parametrize(("windows", "block", "broadcast"), [(None, 8192, 1_000_000), (COARSE, 3, 0), (FINE, 4, 0)])
def test_components(spark, monkeypatch, windows, block, broadcast):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PART_ROWS", 500)
    rows = texts(4)
    near = near_texts(5)
    rows += [(1000 + k, t) for k, t in enumerate([*near, *near[:5], *near[:1] * 20])]
    got = simhash_near(table(spark, rows), windows=windows, broadcast_rows=broadcast).documents
    got = sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got.collect()), key=str)
    assert got == plain_components(rows)
    assert len({c for i, _, c in got if i and i >= 1000}) < 40


def test_empty_and_only_null_ids(spark):
    assert simhash_near(table(spark, [])).documents.isEmpty()
    got = simhash_near(table(spark, [(None, None), (None, "a b")])).documents.collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.fp == 0) == [(None, None)] and len(got) == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op11_simhash_near_dedup(spark, sf).collect()), key=str) == plain_components(rows)
