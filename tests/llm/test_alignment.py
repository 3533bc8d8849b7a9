"""Alignment against the two libraries and plain loops."""

from __future__ import annotations

import collections
import hashlib
import json

import numpy as np
import pytest
import sentencepiece
import tokenizers

from llm_tables import table, texts
from martloom.llm.alignment import ByteTokenizer, align, read_byte_tokenizer, read_piece_tokenizer, shared_cuts
from martloom.llm.bpe import byte_alphabet
from martloom.llm.queries import PIECES, op12_tokenizer_alignment, tokenizer_path

ODD = [
    "<|endoftext|> and <s> </s> <0x41>", "a▁b", "  two  blanks ", "\n\n\t", " ", "日本語のテキスト 한국어", "é́ ﬁ ½ 🙂🙂👩‍👩‍👧  x　y",
    "x" * 5000, "ab" * 3000 + " end", "\u0000\u0001", "=" * 300 + "\r\n", "it's we'll I'd", "ضمير мир", "   ", "<unk>",
]


def plain(rows):
    a = tokenizers.Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    alphabet = byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if all(c in alphabet for c in t)}
    done, counts = [], collections.Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a = [a_bytes[k] for k in ids_a]
        parts_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
            done.append((i, [], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(p) for p in parts]).tolist() for parts in (parts_a, parts_b))
        groups, links, j, at_a, at_b = [], [], 0, 0, 0
        place_a, place_b = ({e: k + 1 for k, e in enumerate(ends)} for ends in (ends_a, ends_b))
        for cut in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = place_a[cut], place_b[cut]
            groups.append((ids_a[at_a:to_a], ids_b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        for k, end in enumerate(ends_a):
            start = end - len(parts_a[k])
            while ends_b[j] <= start:
                j += 1
            m = j
            while m < len(ends_b) and ends_b[m] - len(parts_b[m]) < end:
                links.append((ids_a[k], ids_b[m]))
                m += 1
        counts.update(set(links))
        done.append((i, ids_a, ids_b, groups, links))
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for i, ids_a, ids_b, groups, links in done:
        named = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(named.encode()).hexdigest() if links else ""))
    return sorted(out, key=str)


def found(documents):
    return sorted((tuple(r) for r in documents.drop("row").collect()), key=str)


@pytest.fixture(scope="module")
def both():
    return read_byte_tokenizer(tokenizer_path()), read_piece_tokenizer(tokenizer_path(PIECES))


@pytest.mark.parametrize("frequent", [1_000_000, 40, 0])
def test_alignment(spark, both, frequent):
    rows = [*texts(6, 30), *((100 + k, t) for k, t in enumerate(ODD))]
    assert found(align(table(spark, rows), *both, frequent=frequent).documents) == plain(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op12_tokenizer_alignment(spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty_and_rows_without_tokens(spark, both):
    assert align(table(spark, []), *both).documents.isEmpty()
    got = found(align(table(spark, [(None, None), (1, ""), (1, "a▁b")]), *both).documents)
    assert got == sorted([(None, *[0] * 6, ""), (1, *[0] * 6, ""), (1, *[0] * 6, "")], key=str)


def test_shared_cuts_of_random_cuts():
    rnd = np.random.default_rng(7)
    for _ in range(300):
        a_ends, b_ends, a_to, base = [], [], [], 0
        for _ in range(rnd.integers(1, 4)):
            size = int(rnd.integers(1, 300))
            for ends, share in ((a_ends, rnd.random() ** 2), (b_ends, rnd.random() ** 2)):
                inner = np.flatnonzero(rnd.random(size - 1) < share) + 1 if size > 1 else np.zeros(0, int)
                ends += [*(base + inner), base + size]
            a_to.append(len(a_ends))
            base += size
        a_ends, b_ends = np.array(a_ends), np.array(b_ends)
        want = np.flatnonzero(np.isin(a_ends, b_ends))
        assert shared_cuts(a_ends, b_ends, np.array(a_to)).tolist() == want.tolist()


def test_settings_that_are_not_supported_are_named():
    file = json.loads(open(tokenizer_path()).read())
    file["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError, match="blank in front"):
        ByteTokenizer(json.dumps(file)).token_bytes
