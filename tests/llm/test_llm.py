"""The ten operators against brute force, and on nulls, ties, repeats and empty tables."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, html_extract, katz, line_dedup, mixing, packing, quality, simhash, toxicity, warc
from docloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "b", 0),
    (3, "one two three four five six", "en", "a", 1),
    (3, "one two three four five six", "en", "a", 1),
    (None, "one  two three\nfour five six", "en", None, 1),
    (5, "One two three four five sIx", "en", "a", 1),
    (6, " \t\n", "en", "a", 1),
    (7, "long word " * 3000, "en", "b", 1),
    (8, "a <|endoftext|> b's  x\x85y \x1c z İ", "en", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, repeats and ties, and columns named like the operators' own."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(9) for c in ("digest", "fp", "size", "score", "key", "row", "kept", "label", "root", "copies")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


# -- exact


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {n: (min(g)[3], len(g)) for n, g in groups.items()}


def test_exact(odd, docs):
    for frame in (odd, docs):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        want = brute_exact(rows)
        for weak in (exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)):
            got = exact_dedup.resolve(frame.repartition(7), memtable=1, fan_in=2, digest=weak).collect()
            assert len(got) == len(rows)
            assert sum(r.kept for r in got) == len(want)
            expected = collections.Counter((d, *want[re.sub(r"[\x20\x09-\x0D]", "", t or "")]) for d, t in rows)
            assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == expected


def test_exact_levels_do_not_matter(docs):
    def found(frame, **options):
        return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.resolve(frame, **options).collect())

    want = found(docs.coalesce(1))
    for parts, memtable, fan_in in ((13, 1, 2), (13, 1, 3), (9, 2, 8)):
        assert found(docs.repartition(parts), memtable=memtable, fan_in=fan_in) == want


def test_exact_keeps_rows(odd, spark):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "6", "7", "8", "None"]
    assert exact_dedup.resolve(empty(spark)).count() == 0 == exact_dedup.deduplicate(empty(spark)).count()


# -- SimHash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    own = words(low)
    if not own:
        return 0
    grams = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_triples_cover_every_four_positions():
    from itertools import combinations

    triples = simhash.position_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(q) for t in triples) for q in combinations(range(8), 4))


def brute_components(fps):
    ids = list(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and label[b] > label[a]:
                    label[b], changed = label[a], True
    return label


def test_simhash(odd, docs, spark):
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in simhash.cluster(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)
    assert simhash.cluster(odd).count() == len(ODD)
    assert simhash.cluster(empty(spark)).count() == 0
    assert simhash.one_of_each(odd).columns == odd.columns


def test_components_stop_at_stars(spark, monkeypatch):
    from docloom.llm.common import Scratch

    saved = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, **more: saved.append(name) or save(self, df, name, **more))

    def roots(edges):
        saved.clear()
        found = simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
        assert len(found) == len({r.node for r in found})
        return {r.node: r.root for r in found if r.node != r.root}

    assert roots([(7, 1), (1, 8), (8, 1), (9, 1), (5, 5), (20, 3)]) == {7: 1, 8: 1, 9: 1, 20: 3}
    assert saved == ["edges_0"]  # a round would change nothing
    assert roots([]) == {} and saved == ["edges_0"]
    for edges in ([(2, 1), (3, 2)], [(3, 1), (3, 2)], [(k, k + 1) for k in range(-20, 20)]):  # a chain, two edges down, a long chain
        least = min(min(e) for e in edges)
        assert roots(edges) == {v: least for e in edges for v in e if v != least}
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))]
    group = {v: v for e in edges for v in e}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert roots(edges) == {v: r for v, r in group.items() if v != r}


def test_simhash_links_through_hot_lists(spark):
    from docloom.llm.common import Scratch

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = set()
    for b in base.tolist():
        for _ in range(60):
            v = b
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                v ^= 1 << bit
            fps.add(v)
    hub = int(base[1])
    fps |= {hub ^ 1 << a ^ 1 << b for a in range(24) for b in range(a)}  # one long list under many triples
    chain = int(base[0])
    for k in range(0, 64, 4):
        chain ^= 0xF << k
        fps.add(chain)
    signed = sorted(int(np.uint64(v).view(np.int64)) for v in fps)
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for tile in (4, 32, 4096):
        scratch = Scratch(spark, "t")
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame, scratch, tile=tile), scratch).collect()}
        want = brute_components({v: v & (2**64 - 1) for v in signed})
        groups = collections.defaultdict(set)
        for v in signed:
            groups[roots.get(v, v)].add(v)
        expected = collections.defaultdict(set)
        for v in signed:
            expected[want[v]].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


# -- packing


def test_hilbert_neighbours():
    axis = np.arange(8)
    grid = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1).reshape(-1, 3)
    order = np.argsort(packing.hilbert_index(grid, 3))
    assert sorted(packing.hilbert_index(grid, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_packing(odd, docs, spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    for frame in (odd, docs):
        texts = frame.select("doc_id", "text").collect()
        pieces = packing.pack(frame, tokenizer_path()).collect()
        got = collections.Counter()
        for r in pieces:
            for k, i in enumerate(np.frombuffer(r.ids, "<u4").tolist()):
                got[r.doc_id, r.start + k, i, r.doc_tokens] += 1
        want = collections.Counter()
        for doc_id, text in texts:
            ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
            want.update((doc_id, k, i, len(ids)) for k, i in enumerate(ids))
        assert got == want
        sequences = collections.defaultdict(list)
        for r in pieces:
            sequences[r.sequence_id].append((r.offset, r.length))
        for own_pieces in sequences.values():
            own_pieces.sort()
            ends = np.cumsum([n for _, n in own_pieces]).tolist()
            assert [o for o, _ in own_pieces] == [0, *ends[:-1]]
            assert ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def chunked_ids(texts):
    ids, counts = packing.ChunkTokenizer(tokenizer_path()).ids(pa.array(texts, pa.string()))
    ends = np.cumsum(counts).tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_packing_ids_of_every_letter_before_every_mark():
    from tokenizers import Tokenizer

    texts = [" ".join("a" + chr(c) + m for m in packing.MARKS) for c in range(0x20000) if chr(c).isalpha()]
    assert len(texts) > 60_000
    whole = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    assert chunked_ids(texts) == [e.ids for e in whole]


def test_packing_ids_of_random_texts():
    import random
    import unicodedata

    from tokenizers import Tokenizer

    rng = random.Random(3)
    every = [chr(c) for c in range(0x21, 0x20000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    common = [*"abcXYZ.,;:!?*&%$#|'’ \t\n", *map(chr, range(0x300, 0x330))]
    texts = ["".join(rng.choice(every if rng.random() < 0.5 else common) for _ in range(40)) for _ in range(4000)]
    whole = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    assert chunked_ids(texts) == [e.ids for e in whole]


# -- language model


def turing(counts):
    """Discounts by count, from Katz's formula with the largest cut-off of at most five that works."""
    n = collections.Counter(counts)
    for k in range(5, 0, -1):
        if all(n[r] for r in range(1, k + 1)):
            cut = (k + 1) * n[k + 1] / n[1]
            if cut < 1:
                d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) for r in range(1, k + 1)}
                if all(0 < x < 1 for x in d.values()):
                    return d
    return {r: 1 - 0.5 / r for r in range(1, 6)}


def brute_katz(rows, order, folds=10):
    """Scores by direct recursion over dictionaries, and sums of some histories' distributions."""
    streams = []
    for doc_id, text in rows:
        own = [*words(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), 0]
        streams.append((doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0, own))
    train = [s for held, s in streams if not held]
    uni = collections.Counter(w for s in train for w in s)
    n, v = sum(uni.values()), len(uni)
    follow = collections.defaultdict(collections.Counter)  # history, the oldest word first -> followers
    for s in train:
        padded = [1, *s]
        for i, w in enumerate(s, 1):
            for k in range(1, order):
                if i - k >= 0:
                    follow[tuple(padded[i - k : i])][w] += 1
    cut = {1: turing(uni.values())}
    for k in range(2, order + 1):
        cut[k] = turing([c for h, f in follow.items() if len(h) == k - 1 for c in f.values()])
    rest = sum((1 - cut[1].get(c, 1)) * c for c in uni.values())
    scale = 1.0
    if n and not rest:
        rest = scale = n / (n + 1)

    def p(h, w):
        if not h:
            return cut[1].get(uni[w], 1) * uni[w] * scale / n if uni[w] else (rest / n if n else 1.0)
        seen, d = follow.get(h), cut[len(h) + 1]
        if not seen:
            return p(h[1:], w)
        left = sum((1 - d.get(c, 1)) * c for c in seen.values())
        total = sum(seen.values()) + (left == 0)
        if seen[w]:
            return d.get(seen[w], 1) * seen[w] / total
        return (left or 1.0) / total / (1 - sum(p(h[1:], x) for x in seen if seen[x])) * p(h[1:], w)

    out = []
    for held, s in streams:
        padded = [1, *s]
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)
        score = sum(math.log10(p(tuple(padded[max(0, i - order + 1) : i]), w)) for i, w in enumerate(s, 1))
        out.append((held, len(s), sum(uni[w] > 0 for w in s), n, base, score))
    some = [h for h in follow if len(h) == order - 1][:4] + ([(1,), ("unseen word",)] if order > 1 else [()])
    return out, [sum(p(h, w) for w in uni) + p(h, None) for h in some]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz(odd, docs, spark, order):
    few = docs.filter("doc_id < 120")
    for frame in (odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), few if order != 3 else docs):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        want, total = brute_katz(rows, order)
        assert np.allclose(total, 1)
        got = {r.doc_id: tuple(r)[1:] for r in katz.score(frame, order=order).collect()}
        for (doc_id, _), w in zip(rows, want, strict=True):
            assert got[doc_id][:4] == w[:4]
            assert np.allclose(got[doc_id][4:], w[4:], rtol=1e-9)
    if order == 3:
        assert katz.score(odd).count() == len(ODD)
        assert katz.score(empty(spark)).count() == 0
        held = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
        assert {(r.train_tokens, r.score) for r in katz.score(held).collect()} == {(0, 0.0)}


def test_katz_of_small_blocks_and_groups(docs, monkeypatch):
    """Many blocks, many partitions, and histories that are hot in all of them."""
    want = {r.doc_id: r.score for r in katz.score(docs).collect()}
    monkeypatch.setattr(katz, "GROUP", 500)
    common = docs.withColumn("text", F.concat(F.lit("the end of the "), F.coalesce("text", F.lit(""))))
    rows = [(r.doc_id, r.text) for r in common.filter("doc_id < 60").select("doc_id", "text").collect()]
    found = {r.doc_id: r.score for r in katz.score(common.filter("doc_id < 60").repartition(9)).collect()}
    assert np.allclose([found[i] for i, _ in rows], [w[-1] for w in brute_katz(rows, 3)[0]])
    got = {r.doc_id: r.score for r in katz.score(docs.repartition(5)).collect()}
    assert np.allclose([got[i] for i in want], list(want.values()))


def test_katz_blocks_and_partitions_do_not_matter(docs, monkeypatch):
    want = {r.doc_id: r.score for r in katz.score(docs).collect()}
    spark = docs.sparkSession
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.doc_id: r.score for r in katz.score(docs.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose([got[i] for i in want], list(want.values()))


def test_pack_arrays():
    arrays = [np.array([], np.int64), np.array([-3, 2**40]), np.array([2**64 - 1, 5], np.uint64), np.array([0.5, -1e300])]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert a.tolist() == b.tolist()


# -- HTML


@pytest.fixture(scope="module")
def extractor():
    return html_extract.fit()


def brute_scores(rows, model):
    ends = np.cumsum(rows.sizes).tolist()
    return [sum(model.weights[f] for f in rows.flat[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_extraction_on_unseen_templates(extractor):
    right = total = 0
    for html in html_extract.labelled_pages(120, seed=5):
        page = html_extract.blocks(html)
        rows = html_extract.features(page)
        assert np.allclose(html_extract.scores([page], extractor), brute_scores(rows, extractor))
        marked = extractor.decode(rows, [len(page.texts)])
        right += sum(int(m) == int(label == "1") for m, label in zip(marked, page.labels, strict=True))
        total += len(page.texts)
    assert right / total > 0.97


def test_extraction_counts_every_feature(extractor):
    names = " ".join("a" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(60))
    page = html_extract.blocks(f'<div class="{names} widget sidebar"><p>one two</p></div><p>three')
    rows = html_extract.features(page)
    wide = rows.flat[: rows.sizes[0]].tolist()
    assert len(rows) == 2 and rows.sizes[0] > 120
    assert {html_extract.crf.slot(f, html_extract.SIZE) for f in ("name=sidebar", "name=widget", "near=sidebar", "stem=widget", "words=2", "place=first")} <= set(wide)
    assert np.allclose(extractor.scores(rows)[0], extractor.weights[wide].sum(axis=0))
    assert np.allclose(html_extract.scores([page, page], extractor), 2 * brute_scores(rows, extractor))


def test_extraction_sees_formulas_and_fallbacks(extractor):
    page = "<article><h1>Squares</h1><p>The area is <math><mi>a</mi><mo>=</mo><msup><mi>x</mi><mn>2</mn></msup></math> for every square of the plane.</p>{}<p>The next one is longer and ends here.</p></article>"
    assert html_extract.extract([page.format("")], extractor) == ["Squares The area is a=x2 for every square of the plane. The next one is longer and ends here."]
    for tag in ("noscript", "object", "audio", "video", "canvas", "svg"):
        assert "seen by the model" in html_extract.blocks(page.format(f"<{tag}>seen by the model</{tag}>")).texts
    for tag in ("script", "style", "template", "textarea", "select"):
        assert not any("unseen" in t for t in html_extract.blocks(page.format(f"<{tag}>unseen</{tag}>")).texts)


LONG_PAGES = {
    "deep": "<div>x" * 100_000,
    "deep names": "".join(f'<div class="c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}">x' for k in range(100_000)),
    "scripts": "<script " * 125_000,
    "script elements": "<script>" * 125_000,
    "quotes": "<a href='" * 110_000,
    "brackets": "<" * 1_000_000,
    "comments": "<!--" * 250_000,
    "inline": "<b>" * 10_000 + "<tr>x</tr>" * 60_000,
    "ends": "</a" * 300_000,
    "equals": "<a " + "=" * 1_000_000 + ">",
}


@pytest.mark.parametrize("name", LONG_PAGES)
def test_extraction_of_long_pages(extractor, name):
    import time

    began = time.process_time()
    assert len(html_extract.extract([LONG_PAGES[name]], extractor)) == 1
    assert time.process_time() - began < 10


def test_markup_tokens():
    from docloom.llm.markup import attributes, tokens

    page = '<!DOCTYPE html><P Class="a>b" id=x>1 &lt; 2 <!-- <p> --><br/>&eacute;<script>if (a<b) "</p>"</SCRIPT ><a title="open>t</a>'
    got = list(tokens(page))
    assert [t[:2] for t in got] == [("start", "p"), ("text", "1 < 2 "), ("start", "br"), ("text", "é"), ("start", "script"), ("text", 'if (a<b) "</p>"'), ("end", "script"), ("start", "a"), ("text", "t"), ("end", "a")]
    assert attributes(got[0][2]) == {"class": "a>b", "id": "x"}
    assert list(tokens("a<b")) == [("text", "a", "")] and list(tokens("a < b<!--")) == [("text", "a ", ""), ("text", "<", ""), ("text", " b", "")]


def enumerated(scores, model):
    """Log weights of all label sequences of a short sequence."""
    from itertools import product

    out = {}
    for labels in product(range(2), repeat=len(scores)):
        out[labels] = model.start[labels[0]] + sum(scores[t][y] for t, y in enumerate(labels)) + sum(model.moves[a][b] for a, b in zip(labels, labels[1:], strict=False))
    return out


def test_crf_against_enumeration():
    from docloom.llm import crf

    rng = np.random.default_rng(8)
    lengths = [1, 2, 5, 7, 3]
    rows = rng.integers(1, 40, (sum(lengths), 3)).astype(np.int32)
    model = crf.Crf(rng.normal(size=(40, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    got, at = model.decode(rows, lengths).tolist(), 0
    for n in lengths:
        every = enumerated(model.scores(rows[at : at + n]), model)
        assert tuple(got[at : at + n]) == max(every, key=every.get)
        at += n
    # At the optimum of training the gradient of the exact likelihood vanishes.
    labels = rng.integers(0, 2, len(rows))
    ridge = 0.05
    fitted = crf.train(rows, labels, lengths, 40, epochs=3000, rate=0.01, ridge=ridge)

    def loss(move):
        total, at = 0.0, 0
        for n in lengths:
            every = enumerated(fitted.scores(rows[at : at + n]), crf.Crf(fitted.weights, fitted.moves + move, fitted.start))
            total -= every[tuple(labels[at : at + n].tolist())] - np.logaddexp.reduce(list(every.values()))
            at += n
        return total / len(lengths)

    for a in range(2):
        for b in range(2):
            step = np.zeros((2, 2))
            step[a, b] = 1e-4
            assert abs(loss(step) - loss(-step)) / 2e-4 < 0.02


def test_extraction(extractor, spark, sf):
    odd_pages = [None, "", "plain", "<p>a &amp; b\n c", "<article><p>x<b>y</b>z<script>no()</script><![CDATA[q]]><p>&eacute; two three four five</article", "<" * 50]
    assert len(html_extract.extract(odd_pages, extractor)) == len(odd_pages)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_extract.extract_table(pages, extractor).collect()
    assert len(got) == pages.count()
    for r, p in zip(sorted(got), sorted(pages.collect()), strict=True):
        body = re.search("<article>(.*?)(</article>|$)", p.html, re.S)[1]
        import html

        assert r.text == " ".join(html.unescape(re.sub("<[^>]+>", " ", body)).split()) and r.n_chars == len(r.text)
    assert html_extract.extract_table(spark.createDataFrame([], pages.schema), extractor).count() == 0


# -- WARC


def test_warc(spark, sf):
    rows = [(1, "http://a/ b\r\nX: 1", "same"), (4, None, "same"), (4, None, "same"), (2, "u", None), (3, "u", ""), (None, "u", "same"), (9, "u", "é" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    bundles = warc.write(pages)
    got = warc.read(bundles).collect()
    assert len(got) == len(rows)
    import base64
    import hashlib

    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", "None") if best[h or ""] == i else ("revisit", str(best[h or ""])))) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    for b in bundles.collect():
        for e in b["index"]:
            headers, _ = warc.parse_record(warc.read_at(bytes(b["data"]), e["frame"], e["offset"], e["length"]))
            assert headers["WARC-Record-ID"] == f"<urn:page:{'' if e['page_id'] is None else e['page_id']}>"
    texts = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    back = warc.read(warc.write(spark.read.parquet(f"{sf}/pages.parquet"))).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in back if r.payload is not None} == texts
    assert warc.read(warc.write(pages.limit(0))).count() == 0


# -- toxicity


def test_toxicity_learns_a_pair_without_own_association():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(2500):
        kind = int(rng.integers(0, 6))
        own = ["insult"] * (kind in (0, 3)) + ["group"] * (kind in (0, 4)) + ["slur"] * (kind in (1, 2))
        rows.append(" ".join(rng.permutation([f"w{k}" for k in rng.integers(0, 50, 12)] + own).tolist()))
        labels.append(int(kind < 3))
    text, bucket = toxicity.term_lists(pa.array(rows, pa.string()))
    gain, _ = toxicity.evidence(text, bucket, np.array(labels))
    assert max(gain[list(toxicity.buckets(w))].max() for w in ("insult", "group")) < 8 < gain[list(toxicity.buckets("slur"))].max()
    model = toxicity.train(text, bucket, np.array(labels))
    plain = [" ".join(f"w{k}" for k in rng.integers(0, 50, 12)) for _ in range(50)]
    for added, toxic in (("insult group", 1), ("insult", 0), ("group", 0), ("", 0), ("slur", 1)):
        assert np.mean((model.score(pa.array([f"{p} {added}" for p in plain])) >= 0.5) == toxic) > 0.95


def test_toxicity_score_recomputed():
    rng = np.random.default_rng(6)
    rows = [" ".join(f"w{k}" for k in rng.integers(0, 300, int(rng.integers(0, 60)))) for _ in range(300)]
    labels = np.array([int("w7 " in r or "w9 " in r) for r in rows])
    text, bucket = toxicity.term_lists(pa.array(rows, pa.string()))
    model = toxicity.train(text, bucket, labels)
    rows += ["", "unseen words only", "w7 unseen"]
    terms = {w: set(toxicity.buckets(w)) for r in rows for w in words(r)}
    assert model.place.tolist() == sorted({b for r in rows[:300] for w in words(r) for b in terms[w]})
    for got, row in zip(model.score(pa.array(rows)).tolist(), rows, strict=True):
        own = {b for w in words(row) for b in terms[w]}
        thin = toxicity.DILUTE / (toxicity.DILUTE + len(own))
        at = [int(np.searchsorted(model.place, b)) for b in own if b in model.place]
        vectors = [model.factors[i] * (model.pair[i] + model.common[i] * thin) for i in at]
        raw = model.bias + sum(float(model.linear[i]) for i in at)
        raw += sum(float(vectors[i] @ vectors[j]) for i in range(len(at)) for j in range(i))
        assert math.isclose(got, 1 / (1 + math.exp(-raw)), rel_tol=1e-3, abs_tol=1e-6)


def test_toxicity_leaves_out_equal_rows_only():
    shared, rng = "a b c d e f g h", np.random.default_rng(4)
    rows = [f"{shared} " + " ".join(f"x{k}" for k in rng.integers(0, 5000, 6)) for _ in range(200)]
    rows += [rows[0], rows[1]]
    text, bucket = toxicity.term_lists(pa.array(rows, pa.string()))
    lists = [bucket[text == k] for k in range(len(rows))]
    assert toxicity.one_of_copies(lists, [0] * 200 + [0, 1]) == [*range(200), 201]


def test_toxicity(odd, spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(d, labels)
    held = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    got = toxicity.score_table(d, model).join(held, "doc_id").select("score", "toxic").collect()
    assert np.mean([r.score >= 0.5 for r in got if r.toxic == 1]) > 0.85
    assert np.mean([r.score >= 0.5 for r in got if r.toxic == 0]) < 0.02
    scored = toxicity.score_table(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.not_toxic(odd, labels).columns == odd.columns
    by_text = {r.text: float(model.score(pa.array([r.text], pa.string()))[0]) for r in odd.collect()}
    want = collections.Counter((r.doc_id, round(by_text[r.text], 6)) for r in odd.collect())
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in scored) == want
    small = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels")]
    own = toxicity.fit(*small)
    twice = small[0].unionByName(small[0])
    low = collections.Counter(r.doc_id for r in toxicity.score_table(twice, own).collect() if r.score < 0.5)
    assert collections.Counter(r.doc_id for r in toxicity.not_toxic(twice, small[1]).collect()) == low
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert before == "10000"  # the session's setting is left alone
    none = toxicity.fit(empty(spark), labels)
    assert toxicity.score_table(empty(spark), none).count() == 0


# -- quality


def brute_quality(text):
    text = text or ""
    own = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    covered = {k for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality(odd, docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train_on(docs, labels)
    for frame in (odd, docs):
        rows = collections.Counter((r.doc_id, *brute_quality(r.text)) for r in frame.select("doc_id", "text").collect())
        got = quality.judge(frame, model).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == rows
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id: r for r in quality.judge(docs, model).collect() if r.doc_id in quality_of}
    assert np.mean([kept[i].kept for i, q in quality_of.items() if q == 1 and not kept[i].base_failed]) > 0.95
    assert np.mean([kept[i].kept for i, q in quality_of.items() if q == 0]) < 0.1
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    large = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    unseen = quality.train_on(large[0], large[1].filter(~held), sample=1500)
    judged = quality.judge(large[0].filter(held), unseen).join(large[1], "doc_id").collect()
    assert np.mean([r.kept for r in judged if r.quality == 1 and not r.base_failed]) > 0.97
    assert np.mean([r.kept for r in judged if r.quality == 0]) < 0.03
    assert any(0 < r.content_share < 1 for r in judged)
    assert quality.train_on(docs, labels.limit(0)) is None
    twice = docs.withColumn("text", F.concat("text", F.lit("\nother"))).unionByName(docs)
    models = [quality.train_on(d, labels, sample=50) for d in (twice, twice.repartition(7))]
    assert np.array_equal(models[0].weights, models[1].weights)
    assert quality.judge(empty(spark), None).count() == 0


# -- mixing


def test_mixing(odd, docs, spark):
    for frame in (odd, docs):
        got = mixing.mix(frame).collect()
        assert len(got) == frame.count()
        sizes = collections.Counter()
        for r in frame.select("source", "text").collect():
            sizes[r.source] += len(words(r.text))
        taken, target = collections.Counter(), {}
        for r in got:
            assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
            taken[r.source] += r.taken
            target[r.source] = r.target
        total = sum(sizes.values())
        assert math.isclose(sum(target.values()), total, rel_tol=1e-9) and sum(taken.values()) <= total
        weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
        capped, free = set(), set(sizes)
        while True:
            level = (total - sum(3 * sizes[s] for s in capped)) / max(1e-9, sum(weight[s] for s in free))
            more = {s for s in free if weight[s] * level > 3 * sizes[s]}
            if not more:
                break
            capped, free = capped | more, free - more
        for s in sizes:
            assert math.isclose(target[s], 3 * sizes[s] if s in capped else weight[s] * level, rel_tol=1e-9, abs_tol=1e-9)
            largest = max(r.size for r in got if r.source == s)
            assert abs(taken[s] - target[s]) <= max(largest, 1) * 3
    assert mixing.mix(empty(spark)).count() == 0 == mixing.mixture(empty(spark)).count()
    for frame in (odd, docs):
        mixed = mixing.mixture(frame)
        assert mixed.columns == frame.columns
        want = collections.Counter()
        for r in mixing.mix(frame).collect():
            want[r.doc_id, r.source, r.size] += r.copies
        got = collections.Counter((r.doc_id, r.source, len(words(r.text))) for r in mixed.select("doc_id", "source", "text").collect())
        assert got == +want


# -- lines


def test_lines(spark, sf):
    rows = [(k, "https://A.example.com/x", f"<nav>Home</nav><p>page {k}</p><script>x<p></script>tail {k % 2}") for k in range(8)]
    rows += [(50, None, None), (None, "bad url", "<p>Home"), (51, "http://b.example.com", "<p>Home<p>Home")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in line_dedup.clean_pages(pages).collect()}
    assert got[3].kept_lines == ["page 3"] and got[3].n_dropped == 2 and got[3].host == "a.example.com"
    assert got[51].kept_lines == ["Home", "Home"] and got[50].n_lines == 0 and got[None].kept_lines == ["Home"]
    assert line_dedup.clean_pages(pages.limit(0)).count() == 0
    white = spark.createDataFrame([(k, "http://w.example.com", f"<p>\tHome\t</p>\t<p> Home\x0b<p>own {k}") for k in range(2)], "page_id long, url string, html string")
    assert {tuple(r.kept_lines) for r in line_dedup.clean_pages(white.union(white.limit(0))).collect()} == {("own 0",), ("own 1",)}
    twice = white.limit(1).union(white.limit(1))
    assert [r.n_lines - r.n_dropped for r in line_dedup.clean_pages(twice).collect()] == [0, 0]


@pytest.mark.parametrize("name", [n for n in LONG_PAGES if "deep" not in n])
def test_lines_of_long_pages(spark, name):
    import time

    pages = spark.createDataFrame([(k, "http://a.example.com", LONG_PAGES[name]) for k in range(2)], "page_id long, url string, html string")
    began = time.perf_counter()
    assert line_dedup.clean_pages(pages).count() == 2
    assert time.perf_counter() - began < 20


def test_lines_of_pages_of_many_lines(spark):
    import time

    pages = spark.createDataFrame([(k, "http://a.example.com", "".join(f"<p>Home{i % 9000}" for i in range(20_000))) for k in range(2)], "page_id long, url string, html string")
    began = time.perf_counter()
    assert [r.n_dropped for r in line_dedup.clean_pages(pages).collect()] == [20_000, 20_000]
    assert time.perf_counter() - began < 20


# -- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        if name == "exact_dedup":
            texts = {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in before.collect()}
            assert after.count() == len(texts)
        if name == "simhash":
            labels = brute_components({r.doc_id: brute_fingerprint(r.text) for r in before.collect()})
            assert {r.doc_id for r in after.collect()} == set(labels.values())
        before = after
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter((r.doc_id, len(own.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before.collect())
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    assert sum(r.length for r in pieces) == sum(n * k for (_, n), k in want.items())
    fill = collections.Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


def test_pipeline_stages_on_odd_tables(spark, odd, sf):
    import corpus_pipeline

    for frame in (odd, empty(spark)):
        before = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = stage(spark, before, sf)
            assert before.columns == frame.columns, name
        n = before.count()
        last = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
        assert sum(r.start == 0 for r in last) == n
        assert n == 0 if frame is not odd else n > 0
