"""Each operator on small tables: against a plain version where there is one, and the edge cases that it defines."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom.llm import content_sort, jaccard_join, substring_dedup
from martloom.llm.bpe import Bpe, bpe_decode, bpe_encode
from martloom.llm.content_sort import exact_dedup
from martloom.llm.fm_index import BitVector, FMIndex
from martloom.llm.html_text import candidates, extract, parse
from martloom.llm.language import identify
from martloom.llm.mixing import min_cost_flow, mix, shares
from martloom.llm.quality import quality
from martloom.llm.queries import RULES, tokenizer_path
from martloom.llm.toxicity import toxicity
from martloom.llm.url_reputation import reputations, url_filter

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, row int, n_words int, run string"
LONG = " ".join(f"w{k % 997}x{k}" for k in range(30_000))


def table(spark, rows):
    """(doc_id, text) with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 7, 7, "x") for i, t in rows], SCHEMA).repartition(3)


def texts(seed: int, count: int = 60) -> list[tuple[int | None, str | None]]:
    """Fresh texts, edited copies, exact copies, shared passages, repeated rows, nulls, blanks and a very long one."""
    rnd = np.random.default_rng(seed)
    word = lambda: "".join(rnd.choice(list("abcdeé"), rnd.integers(1, 5)))
    passage = " ".join(word() for _ in range(60))
    rows: list[tuple[int | None, str | None]] = []
    for k in range(count):
        words = [word() for _ in range(rnd.integers(1, 150))]
        if k % 4 == 1 and rows[k - 1][1]:
            words = rows[k - 1][1].split()
            words[int(rnd.integers(len(words)))] = "edited"
        if k % 5 == 0:
            words += [passage]
        rows.append((k, " ".join(words).upper() if k % 7 == 0 else "\t".join(words)))
    rows += [(count, rows[3][1]), (3, rows[3][1]), (None, rows[8][1]), (None, None), (count + 1, None), (count + 2, ""), (count + 3, " \n"), (count + 4, LONG), (count + 5, "One two"), (count + 6, "one TWO")]
    return rows


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, text or "")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = words_of(lowered(text))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return sorted(((i, len(sets[k]), smallest[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_jaccard_join(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 2)
    rows = texts(1)
    got = jaccard_join.jaccard_join(table(spark, rows), broadcast_rows=broadcast_rows).documents
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == plain_components(rows)


@pytest.mark.parametrize("block", ["BLOCK_MEMBERS", "BLOCK_SHINGLES", "BLOCK_QUERIES"])
def test_jaccard_links(spark, monkeypatch, block):
    """Links per document and components, against all pairs: fresh texts, equal texts and a group of near copies.
    The links that are written are real, join all that is linked, and are no more than classes in a block."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, block, 4)
    base = [f"base{k}" for k in range(120)]
    near = [" ".join([*base[: 5 * k], "edited", *base[5 * k + 1 :]]) for k in range(20)]
    rows = [(k, t, k) for k, (_, t) in enumerate([*texts(2, 30), *((0, t) for t in [*near, near[3]])])]
    sets = {}
    for k, text, _ in rows:
        w = words_of(lowered(text))
        if w:
            sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    kinds = list(set(sets.values()))
    want = {frozenset((a, b)) for i, a in enumerate(kinds) for b in kinds[:i] if 100 * len(a & b) >= 75 * len(a | b)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)
    got = jaccard_join.jaccard_join(docs, row_col="row")
    classes = {r.row: r for r in got.documents.collect()}
    assert {k for k, r in classes.items() if r.cls is not None} == set(sets)
    assert all(r.n_links == 0 for k, r in classes.items() if k not in sets)
    classes = {k: r for k, r in classes.items() if k in sets}
    of_class = {r.cls: sets[k] for k, r in classes.items()}
    assert len(of_class) == len(kinds)
    links = [frozenset((of_class[r.u], of_class[r.v])) for r in got.links.collect()]
    assert len(want) >= 190 and set(links) <= want
    if block == "BLOCK_SHINGLES":  # one member a block
        assert len(links) <= len(want)
    else:
        assert len(links) < len(want) / 1.2
    linked = [(list(of_class).index(r.u), list(of_class).index(r.v)) for r in got.links.collect()]
    joined = [frozenset((list(of_class).index(a), list(of_class).index(b))) for a in of_class for b in of_class if frozenset((of_class[a], of_class[b])) in want]
    ranks = list(range(len(of_class)))
    roots = [sorted(map(str, reach)) for reach in (plain_reach(ranks, linked), plain_reach(ranks, [tuple(j) for j in joined]))]
    assert roots[0] == roots[1]
    assert all(r.n_links == sum(sets[k] in pair for pair in want) for k, r in classes.items())


def plain_reach(nodes, linked):
    """The sets of nodes that reach each other."""
    root = list(nodes)
    for a, b in linked:
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    return [sorted(n for n in nodes if root[n] == r) for r in set(root)]


def plain_substrings(rows, window):
    counts = collections.Counter(tuple(w[k : k + window]) for _, t in rows for w in [words_of(t)] for k in range(len(w) - window + 1))
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("many_segments", "broadcast_rows", "shard_segments"), [(2_000, 10**6, 10_000), (2, 0, 10_000), (2, 10**6, 2), (0, 0, 0)])
def test_substring_dedup(spark, many_segments, broadcast_rows, shard_segments):
    rnd = np.random.default_rng(8)
    passage = " ".join(f"p{k}" for k in range(60))
    other = lambda: " ".join(rnd.choice([f"w{k}" for k in range(5_000)], 30))
    rows = [*texts(2), (900, "la " * 80), (901, "x " * 35 + "y"), (902, "x " * 34)]
    rows += [(1_000 + k, f"{other()} {passage} {other()}") for k in range(30)]  # every neighbourhood differs
    rows += [(1_100 + k, " ".join(f"c{j}" for j in range(90))) for k in range(20)]  # equal texts, the last with other white space
    rows += [(1_120, "\n".join(f"c{j}" for j in range(90))), (1_121, " ".join(f"c{j}" for j in range(20, 70))), (1_100, "c1 c2")]
    found = substring_dedup.substring_dedup(
        table(spark, rows), many_segments=many_segments, broadcast_rows=broadcast_rows, shard_segments=shard_segments
    )
    got = [(r.doc_id, r.n_words, 0, r.sha) for r in found.untouched.collect()]
    got += [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found.changed.collect()]
    assert sorted(got, key=str) == plain_substrings(rows, 35)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("landed_")]


def test_index_counts_windows():
    rnd = np.random.default_rng(5)
    parts = [rnd.integers(1, 4, rnd.integers(1, 60)) for _ in range(200)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for window in (1, 5, 35):
        counts = collections.Counter(tuple(p[k : k + window]) for p in parts for k in range(len(p) - window + 1))
        want = [k + window <= len(p) and counts[tuple(p[k : k + window])] > 1 for p in parts for k in range(len(p))]
        assert FMIndex(np.concatenate(parts), at, window).repeated_windows(np.concatenate(parts), at).tolist() == want
        several = rnd.random(len(parts)) < 0.3
        counts = collections.Counter()
        for p, n in zip(parts, 1 + several, strict=True):
            counts.update({w: n * c for w, c in collections.Counter(tuple(p[k : k + window]) for k in range(len(p) - window + 1)).items()})
        want = [k + window <= len(p) and counts[tuple(p[k : k + window])] > 1 for p in parts for k in range(len(p))]
        assert FMIndex(np.concatenate(parts), at, window, several).repeated_windows(np.concatenate(parts), at).tolist() == want


def test_bits_are_found_by_number():
    bits = np.random.default_rng(6).random(1_000) < 0.1
    vector = BitVector(bits)
    assert vector.place(np.arange(bits.sum())).tolist() == np.flatnonzero(bits).tolist()
    assert vector.ones(np.arange(1_001)).tolist() == [0, *np.cumsum(bits).tolist()]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, keep):
    rows = [*texts(3), *((500 + k, "Same Text") for k in range(200)), (None, "same text")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup(table(spark, rows), keep=keep).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[lowered(text)].append(i)
    best = {t: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, best[lowered(t)], len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    with pytest.raises(ValueError):
        content_sort.exact_dedup(table(spark, rows), keep="any")


def test_html(spark):
    page = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div class="c post-12">
      <h1>T &amp; x</h1><p>Para <b>one<br> <a href="x>y">more</a><p>Two &lt;b&gt;<ul><li>a<li>b</ul><form>f</form>
      <div class=comments>no</div></div><aside>s</aside><footer>f</footer><scr"""
    want = "T & x\n\nPara one more\n\nTwo <b>\n\na\n\nb"
    assert candidates(parse(page))[0]["text"] == want
    rows = [(k, f"http://h.com/{k}", page.replace("12", str(k))) for k in range(5)]
    rows += [(9, "http://h.com/x", "<p>only <i>this</i>"), (10, None, page), (11, "http://h.com", None), (12, "no url", "<nav>n</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    assert got == {**{k: (want, len(want)) for k in (0, 1, 2, 3, 4, 10)}, 9: ("only this", 9), 11: ("", 0), 12: ("", 0)}
    assert extract(pages.where("false")).count() == 0


def test_html_reads_the_path_of_the_host(spark):
    words = lambda n: " ".join(f"word{k}" for k in range(n))
    page = "<html><body><article><h1>T</h1><p>{}</p></article><section class=responses><p>{}</p></section></body></html>"
    rows = [(k, f"http://h.com/{k}", page.format(words(60), words(5))) for k in range(3)]
    rows += [(3, "http://h.com/3", page.format("short", words(400))), (4, "http://h.com/4", f"<html><body><div class=x><p>{words(9)}</p></div></body></html>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: "T\n\n" + words(60) for k in range(3)}, 3: "T\n\nshort", 4: words(9)}


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-comments", "row has-header", "ad-free", "page-widgets", "sidebar-layout"])
def test_html_keeps_wrappers(name):
    page = "<body><div class='{}'><div class=content><h1>T</h1><p>one <span class=share>no</span> two</p></div><div class=sidebar>no</div></div><div class=widget>no</div></body>"
    assert candidates(parse(page.format(name)))[0]["text"] == "T\n\none two"


def test_html_drops_long_threads():
    page = "<body><article><p>one</p></article><div class=comments><p>many more words than in the article</p></div></body>"
    assert candidates(parse(page))[0]["text"] == "one"


def test_html_reads_text_around_the_best_path(spark):
    words = " ".join(f"word{k}" for k in range(80))
    pages = [
        f"<h1>T</h1><p>{words}</p><div>One sentence.</div>",
        f"<body><div class=post><h1>T</h1><p>lead</p><div class=content><p>{words}</p></div></div></body>",
        f"<body><div class=post><div class=top>T</div><div class=lead>lead</div><div class=content><p>{words}</p></div></div></body>",
        f"<body><h1>T</h1><div class=content><p>{words}</p></div><section class=responses><p>{words[:220]}</p></section></body>",
        f"<body><div class=content><p>{words}</p></div></body></html><p>end</p>",
    ]
    want = [f"T\n\n{words}\n\nOne sentence.", f"T\n\nlead\n\n{words}", f"T\n\nlead\n\n{words}", f"T\n\n{words}", f"{words}\n\nend"]
    rows = [(2 * k + twice, f"http://h{k}.com/{twice}" if twice else None, page) for k, page in enumerate(pages) for twice in (0, 1)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {2 * k + twice: w for k, w in enumerate(want) for twice in (0, 1)}


def test_language(spark):
    said = {"en": "the quick brown fox and the lazy dog were there ", "de": "der schnelle braune fuchs und der faule hund waren da ", "fr": "le renard brun et rapide et le chien paresseux étaient là "}
    rows = [(k, said[lang][k % 9 :] * 3, lang, "s", 1, 1, "x") for k, lang in enumerate(["en", "de", "fr"] * 20)]
    rows += [(100, None, "en", "s", 1, 1, "x"), (101, "12 %%", "en", "s", 1, 1, "x"), (102, said["de"] * 2000, None, "s", 1, 1, "x"), (None, said["fr"], "fr", "s", 1, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert all(got[k].lang_pred == r[2] for k, r in enumerate(rows[:60]))
    assert (got[100].lang_pred, got[100].score, got[101].lang_pred) == ("und", 0.0, "und")
    assert got[102].lang_pred == "de" and got[None].lang_pred == "fr" and 0 < got[102].score <= 1
    assert identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    rows = [*texts(4), (800, "a<|endoftext|> b's  \n x\u00a0\x85\x1c 1½ 漢字😀"), (801, "a" * 3000 + " " * 500)]
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.text) for r in bpe_decode(bpe_encode(table(spark, rows), path), path).collect()), key=str)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    want = sorted(((i, len(n), bytearray(np.array(n, "<u4").tobytes()), library.decode(n, skip_special_tokens=False)) for (i, _), n in zip(rows, ids, strict=True)), key=str)
    assert got == want
    bpe = Bpe(open(path).read())
    assert b"".join(bpe.cut("naïve日本".encode())) == "naïve日本".encode()
    assert all(bpe.inside[a, b] for token in bpe._tables[0] for a, b in zip(token, token[1:], strict=False))


def test_mixing(spark):
    assert shares([10, 10, 1], [1, 2, 3]) == [6.0, 12.0, 3.0]
    # the second pattern belongs to both sources and gives way to the first
    flow = min_cost_flow([10, 10], [[0], [0, 1]], [10, 10])
    assert flow == [{0: 10}, {0: 0, 1: 10}]
    rows = [(k, "w " * (k % 13), "en", f"s{k % 4}" if k % 5 else None, 1, 1, "x") for k in range(2_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mix(docs, F.array("source"))
    quotas = {r.source: r.target for r in mixed.quotas.collect()}
    again = sorted((r.doc_id, r.copies) for r in mix(docs.repartition(5), F.array("source")).documents.collect())
    got = mixed.documents.collect()
    assert sorted((r.doc_id, r.copies) for r in got) == again
    taken = collections.Counter()
    for r in got:
        taken[r.sources[0]] += r.taken
        assert r.copies <= 3 and r.taken == r.copies * r.size
    assert all(abs(taken[s] - t) <= 13 for s, t in quotas.items()) and None in quotas
    assert mix(docs.where("false"), F.array("source")).documents.count() == 0


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?q"), (2, "http://example.com/en/"), (3, "https://a.net/es/#t"), (4, None), (5, "no"), (6, "http://a.com"), (7, "x://bad.org/p"), (8, "x://good.org/p")]
    pages = spark.createDataFrame(rows + [(k, "x://bad.org/") for k in range(100, 160)] + [(k, "x://good.org/") for k in range(200, 260)], "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(k, 1) for k in range(100, 160)] + [(k, 0) for k in range(200, 260)] + [(1, None)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, labels, RULES).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/", "example.com/en/", "block") and got[3][2:] == ("net/es/", "block")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6] == ("a.com", "", None, "allow")
    assert got[7][3] == "block" and got[8][3] == "allow"
    assert reputations(spark.createDataFrame([], "host string, n long, bad long")).count() == 0
    assert url_filter(pages.where("false"), labels, RULES).count() == 0


def test_quality(spark):
    rnd = np.random.default_rng(1)
    noise = "".join(chr(c) for c in rnd.integers(33, 127, 3000))
    rows = [*texts(6), (700, "a b c d e f g a b c d e\nx y\nx y\n \n \n"), (701, "good bad " * 400), (702, " ".join(noise[k : k + 9] for k in range(0, 3000, 9)))]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality(table(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        w = words_of(t)
        counts = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if counts[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    assert got == sorted(want, key=str)
    kept = {r.doc_id: r.kept for r in quality(table(spark, rows[-1:])).collect()}
    assert kept == {702: False}


@pytest.mark.parametrize(("clean_bytes", "noise_bytes"), [(131_000, 8_100), (8_000, 7_500)])
def test_quality_judges_the_tail(spark, clean_bytes, noise_bytes):
    rnd = np.random.default_rng(2)
    vocabulary = ["".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), rnd.integers(2, 9))) for _ in range(600)]
    clean = " ".join(rnd.choice(vocabulary, clean_bytes // 3))[:clean_bytes]
    noise = "".join(rnd.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), noise_bytes))
    rows = [(1, clean), (2, f"{clean}\n{noise}"), (3, f"{noise}\n{clean}")]
    assert {r.doc_id: r.kept for r in quality(table(spark, rows)).collect()} == {1: True, 2: False, 3: False}


def test_toxicity(spark):
    rows = [(k, f"some quiet words number {k} " + ("you idiot and moron " if k % 3 == 0 else "and a friend ") + "x" * (k % 5)) for k in range(400)]
    docs = table(spark, [*rows, (900, None), (901, "")])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)] + [(900, None), (5, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == 402 and all(got[k].predicted == int(k % 3 == 0) for k in range(400))
    assert 0 <= got[900].score == got[901].score < 0.3
    assert toxicity(docs, labels.where("false")).where("score > 0.6").count() == 0
    assert toxicity(docs.where("false"), labels).count() == 0


def test_toxicity_of_rare_words(spark):
    """Each toxic text is marked by one of 20 words, so each word is in 5 % of them and in no clean one."""
    rnd = np.random.default_rng(3)
    marks = ["".join(chr(0x4E00 + 8 * k + j) for j in range(8)) for k in range(20)]  # no letter is shared
    fillers = ["".join(rnd.choice(list("abcdefghi"), 4)) for _ in range(300)]
    rows = [(k, " ".join([*rnd.choice(fillers, 30), *([marks[k % 20]] if k < 720 else [])])) for k in range(1440)]
    labels = spark.createDataFrame([(k, int(k < 720)) for k in range(1440)], "doc_id long, toxic int")
    got = [r for r in toxicity(table(spark, rows), labels).collect() if r.held_out]
    toxic = [r.predicted for r in got if r.doc_id < 720]
    clean = [r.predicted for r in got if r.doc_id >= 720]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.1 * len(clean)


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).where("false")
    path = tokenizer_path()
    assert jaccard_join.jaccard_join(none).documents.count() == 0
    found = substring_dedup.substring_dedup(none)
    assert found.untouched.count() == found.changed.count() == found.spans.count() == 0
    assert exact_dedup(none).count() == quality(none).count() == bpe_encode(none, path).count() == 0
