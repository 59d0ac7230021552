"""The operators against brute force on small tables, and on tables of odd rows."""

import crc_helpers as h
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremora.llm import bpe, components, linededup, media, mixing, neardup, ngrams, quality, substrings, tokens, topk, toxicity
from tremora.llm.catalogue import VOCABULARY

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, chunk int, bands string, rep long, row long, size long, target double"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows):
    """Rows (doc_id, text, source) with more columns, whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1.0, 7, "x", 1, 2, 3, 4.0) for i, t, s in rows], DOCS)


LONG = " ".join(f"w{i % 4001}" for i in range(60_000))
SHARED = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    prose = [" ".join(f"t{i}x{j}" for j in range(40)) for i in range(6)]
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t \n", None), (4, LONG, "b"), (5, LONG + " end", "b"), (6, "word", "c"), (6, "word", "c"), (7, "word", None),
        (None, prose[0], "a"), (None, prose[0], "a"), (8, prose[0], "é"), (9, prose[1] + " " + SHARED, "a"), (10, SHARED + " " + prose[2], "a"), (11, "日本 " * 30 + "終わり", "z"),
        (12, prose[3] + "\n" + prose[4], "a"), (13, prose[4] + "\n" + prose[5] + "\n", "a"), (14, "x" * 5000, "a"),
    ]
    return docs(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, None), (9, 0, 1), (10, None, 0), (12, 1, 0), (13, 2, 1), (None, 1, 1)], LABELS)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- 1 substring dedup ---------------------------------------------------------------------------------------------


def test_substrings_equal_brute_force(spark, odd):
    rows = [(i, t) for i, t in texts_of(odd) if i not in (None, 6)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substrings.dedup(odd, chunk_bytes=100_000).filter("doc_id is not null and doc_id <> 6").collect()}
    for i, (n, cut, kept) in h.cut_windows(rows).items():
        assert got[i] == (n, cut, h.sha256(kept), kept), i


def test_substrings_see_repeated_and_nameless_rows(odd):
    got = sorted((r.n_words, r.n_removed) for r in substrings.dedup(odd).filter("doc_id is null").collect())
    assert got == [(40, 40), (40, 40)]  # doc 8 comes before both


def test_sketch_never_underestimates():
    r = np.random.default_rng(0)
    for n, bits in ((1, 8), (900, 12), (5000, 24), (5000, 40)):
        cells = np.unique(r.integers(0, 1 << bits, n).astype(np.uint64))
        low, high, _ = substrings.encode(cells, bits)
        assert (substrings.decode(low, high, len(cells), bits) == cells.astype(np.int64)).all()
    assert substrings.later_copies(np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)).tolist() == [False, False, True, False, True]


# --- 2 toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_handles_odd_rows(spark, odd, labels, none):
    plain = [f"a{i % 7} b{i % 11} c{i % 5} calm words" for i in range(400)]
    rows = [(i, t + (" you idiot" if i % 10 == 0 else "") + (" worthless junk" if i % 10 == 5 else ""), "s") for i, t in enumerate(plain)]
    known = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], LABELS)
    got = toxicity.classify(docs(spark, rows), known).collect()
    assert len(got) == 400 and all((r.predicted == 1) == (r.doc_id % 5 == 0) for r in got)
    assert all(r.held_out == (h.crc(r.doc_id) % 5 == 0) for r in got)
    assert toxicity.classify(odd, labels).count() == odd.count()
    assert toxicity.classify(odd, labels.limit(0)).filter("predicted = 0").count() == odd.count()
    assert toxicity.classify(none, labels).count() == 0


def test_chain_feeds_earlier_probabilities():
    found, y = [[0, 2], [1, 2]] * 40, np.array([1, 0] * 40)
    chain = toxicity.fit_columns(found, {b"bad": 0, b"good": 1, b"thing": 2}, {"first": y, "second": y})
    assert chain.models[1].weights[len(chain.vocabulary)] > 0 and len(chain.models[0].weights) == len(chain.vocabulary)
    p = chain.predict([[chain.vocabulary[b"bad"]], [chain.vocabulary[b"good"]], []])
    assert p[0, 1] > 0.8 > 0.2 > p[1, 1] and p.shape == (3, 2)


def test_kinds_group_toxic_rows_by_their_words():
    found = [[0, 2], [0], [1, 3], [1], [5], [0, 1]]
    made = toxicity.kinds(found, np.array([1, 1, 1, 1, 1, 0]), strongest=4)
    assert made["kind_1"].tolist() == [1, 1, 0, 0, 0, 0] and made["kind_2"].tolist() == [0, 0, 1, 1, 0, 0]
    assert all(x.sum() == 0 for x in toxicity.kinds(found, np.zeros(6, int)).values())


def test_toxicity_of_held_out_rows_and_given_categories(spark):
    data = "/root/testdata/sf0.01"
    labels, d = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/documents.parquet")
    got = toxicity.classify(d, labels).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share"), F.count("*").alias("n")).collect()
    share = {r.toxic: r.share for r in got}
    assert share[0] <= 0.02 and share[1] >= 0.3  # a part of the labelled rows has no toxic word at all
    more = toxicity.classify(d, labels.withColumn("junk", 1 - F.col("quality")), categories=("junk",))
    assert "p_junk" in more.columns and more.filter("score between 0 and 1").count() == d.count()


# --- 3 exact top-k -------------------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in r.normal(size=8) * (5 if i % 13 == 0 else 1)], i) for i in range(300)]
    vectors += [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (303, [1.0, 2.0], 0), (304, vectors[7][1], 0), (7, vectors[7][1], 0), (350, [0.0] * 8, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank int").repartition(4)
    got = sorted(tuple(x) for x in topk.top_k(df, block=40, query_block=3, seeds=16).collect())
    assert got == h.top_k(vectors, 5)
    twice = [(i, [1.0, i % 3 + 0.0], 0) for i in (50, 50, 1, 1, 2, 100)]
    df2 = spark.createDataFrame(twice, "vec_id long, embedding array<double>, rank int")
    assert sorted(tuple(x) for x in topk.top_k(df2).collect()) == h.top_k(twice, 5)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id = 50")).count() == 0
    assert topk.top_k(df.filter("vec_id in (50, 100)")).count() == 2


# --- 4 quality -----------------------------------------------------------------------------------------------------


def test_quality_learns_and_handles_odd_rows(spark, odd, labels, none):
    rows = [(i, "Plain sentence number %d goes here. Then more.\nAnother line." % i if i % 3 else "BUY!! NOW!! $$$ ### " * 9, "s") for i in range(300)]
    known = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], LABELS)
    got = quality.classify(docs(spark, rows), known).collect()
    assert all(r.predicted == int(r.doc_id % 3 > 0) and 0 <= r.score <= 1 for r in got)
    assert quality.keep(docs(spark, rows), known).columns == DOCS.replace(",", "").split(" ")[::2]
    assert quality.keep(docs(spark, rows), known).count() == 200
    for some in (labels, labels.limit(0)):
        assert quality.classify(odd, some).filter("score between 0 and 1").count() == odd.count()
    assert quality.classify(none, labels).count() == 0


def test_forest_equals_walking_each_tree():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    f = quality.fit(x, y, trees=20, depth=3)
    for row, score in zip(x[:50], f.scores(x[:50]), strict=True):
        raw = f.base
        for feature, threshold, leaf in zip(f.feature, f.threshold, f.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            raw += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))
    assert ((f.scores(x) > 0.5) == (y == 1)).mean() > 0.95


# --- 5 mixing ------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, odd, none):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 200))), "abcde"[min(4, int(r.integers(0, 9)))] if i % 50 else None) for i in range(800)]
    for shard in (50_000, 90):
        got = mixing.mix(docs(spark, rows), docs_per_shard=shard).collect()
        by = {}
        for x in got:
            assert 0 <= x.taken <= 3 * x.size
            s = by.setdefault(x.source, [0, 0, x.target, x.source_size])
            s[0] += x.taken
            s[1] += x.size
        want = h.targets({s: v[1] for s, v in by.items()}, (5, 2, 1), 3)
        for s, (taken, size, target, source_size) in by.items():
            assert size == source_size and target == pytest.approx(want[s]) and abs(taken - target) <= 16 * (2 + len(got) // shard)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows).repartition(5), docs_per_shard=shard).collect()))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    mixed = mixing.apply(docs(spark, rows), block_tokens=32)
    assert mixed.columns == docs(spark, []).columns
    words = {x.source: x.n for x in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert all(abs(words.get(s, 0) - v[2]) <= 32 * 3 for s, v in by.items() if v[2] > 100)


def test_apportion_is_sainte_lague(spark):
    parties = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 24.0}
    for n in (0, 1, 7, 100):
        df = spark.createDataFrame([(k, v, n) for k, v in parties.items()], "src string, w double, seats long")
        assert {r.src: r.got for r in mixing.apportion(df, [], "src", "w", "seats").collect()} == h.sainte_lague(parties, n)


# --- 6 media -------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, odd, none):
    got = media.document_media(odd).collect()
    assert len(got) == odd.count()
    wanted = sorted(h.media_digest(i, t) for i, t in texts_of(odd))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == wanted
    assert all(r.caption and r.position == 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
    assert media.document_media(none).count() == 0
    with pytest.raises(ValueError):
        media.png_decode(media.png_encode(media.padded(b"abc"))[:-20] + b"\0" * 20)


def test_interleaving_keeps_positions_and_captions(spark):
    html = '<h1>Top</h1>first &amp; <b>bold</b><script>no</script><figure><img src="sha256:d1"><figcaption>One <i>cap</i></figcaption></figure>mid<img src="sha256:d2" alt="two"><img src="sha256:gone"><p>last'
    pages = spark.createDataFrame([(1, html, "u"), (2, None, "u"), (3, '<img src="sha256:d1">', "u")], "page_id long, html string, url string")
    store = spark.createDataFrame([("d1", 10), ("d2", 20)], "digest string, bytes int")
    got = {r.page_id: [(x.position, x.kind, x.text if x.kind == "text" else x.digest, x.caption, x.media and x.media.bytes) for x in r["items"]] for r in media.interleave(pages, store).collect()}
    assert got[1] == [(0, "text", "Top", None, None), (1, "text", "first & bold", None, None), (2, "image", "d1", "One cap", 10), (3, "text", "mid", None, None), (4, "image", "d2", "two", 20), (5, "image", "gone", None, None), (6, "text", "last", None, None)]
    assert got[2] == [] and got[3] == [(0, "image", "d1", None, 10)]


def test_captions_and_silence():
    plain = lambda html: [(x["kind"], x["text"], x["caption"]) for x in media.page_items(html)]
    assert plain("<figure><figcaption>before</figcaption><img src=a><img src=b alt=x></figure>end") == [("image", "a", "before"), ("image", "b", "before"), ("text", "end", None)]
    assert plain("<figure><img src=a><figcaption>open</figure><p>after") == [("image", "a", "open"), ("text", "after", None)]
    assert plain("<figure><img src=a><figcaption>open<p>rest<p>more") == [("image", "a", "open"), ("text", "rest", None), ("text", "more", None)]
    assert plain("<figure><figcaption>alone</figcaption></figure>x") == [("text", "alone", None), ("text", "x", None)]
    assert plain("<figcaption>no figure</figcaption>x") == [("text", "no figure", None), ("text", "x", None)]
    assert plain("a<script/>b<noscript>c") == [("text", "abc", None)]
    assert plain("a<noscript><img src=z>hidden</noscript>b<template>t</template>c") == [("text", "abc", None)]
    assert plain("<img src=a alt=one><figure><img src=b alt=two></figure>") == [("image", "a", "one"), ("image", "b", "two")]
    assert plain(None) == [] and plain("") == []


def test_pages_keep_all_their_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in media.page_summary(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        bare = h.re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", " ", r.html or "")
        words = h.re.findall(h.WORD, __import__("html").unescape(bare))
        kept = [w for x in media.page_items(r.html) if x["kind"] == "text" for w in h.re.findall(h.WORD, x["text"])]
        assert "".join(kept) == "".join(words), r.page_id
        assert got[r.page_id].n_text == sum(x["kind"] == "text" for x in media.page_items(r.html))


# --- 7 near-dedup --------------------------------------------------------------------------------------------------


def test_neardup_equals_brute_force(spark, odd, none):
    r = np.random.default_rng(3)
    base = [[f"v{r.integers(0, 500)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        for c in range(6):
            w = list(words)
            for _ in range(c):
                w[int(r.integers(0, len(w)))] = f"edit{k}{c}"
            rows.append((len(rows), " ".join(w), "s"))
    rows += [(len(rows) + i, rows[i][1], "s") for i in range(5)]
    got = {x.doc_id: x for x in neardup.classes(docs(spark, rows).repartition(4)).collect()}
    want = h.near_classes([(i, t) for i, t, _ in rows], 5, 0.8)
    assert {i: x.class_id for i, x in got.items()} == want
    assert sum(x.representative for x in got.values()) == len(set(want.values()))
    kept = neardup.dedup(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and {x.doc_id for x in kept.collect()} == set(want.values())
    classed = neardup.classes(odd).collect()
    assert len(classed) == odd.count()
    by_id = {x.doc_id: x.class_id for x in classed if x.doc_id}
    assert by_id[4] == by_id[5] == 4 and by_id[6] == by_id[7] == 6 and [by_id[i] for i in (1, 2, 3)] == [1, 2, 3]
    assert {x.class_id for x in classed if x.doc_id is None} == {8} and sum(x.representative for x in classed if x.doc_id in (6, 7)) == 1
    assert neardup.classes(none).count() == 0


def test_neardup_links_copies_edited_apart(spark):
    r = np.random.default_rng(7)
    words = [f"o{i}" for i in range(300)]
    texts = [" ".join(words)]
    for c in range(200):
        w = list(words)
        for place in r.choice(300, 5, replace=False):
            w[place] = f"e{c}x{place}"
        texts.append(" ".join(w))
    rows = [(int(i), t, "s") for i, t in zip(r.permutation(len(texts)), texts, strict=True)]
    got = {x.doc_id: x.class_id for x in neardup.classes(docs(spark, rows).repartition(4)).collect()}
    want = h.near_classes([(i, t) for i, t, _ in rows], 5, 0.8)
    assert len(set(want.values())) <= 3 and got == want


def test_neardup_tells_texts_of_one_id_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "s"), (1, b, "s"), (2, a + " more", "s"), (-1, b + " more", "s"), (None, b, "s"), (None, "alone in its class", "s")]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_class, r.representative) for r in neardup.classes(docs(spark, rows).repartition(2)).collect())
    assert got == [(-1, -1, 3, 1), (0, -1, 3, 0), (0, 0, 1, 1), (1, -1, 3, 0), (1, 1, 2, 1), (2, 1, 2, 0)]
    assert sorted((r.doc_id or 0, r.text) for r in neardup.dedup(docs(spark, rows)).collect()) == [(-1, b + " more"), (0, "alone in its class"), (1, a)]


def test_blocks_of_a_bucket_meet_once(spark):
    open_ = spark.createDataFrame([(k, n, n, 30, 1, 1) for k in (1, 2) for n in range(30)], "bucket long, node long, root long, held long, hub long, hub_root long")
    x, y = components.blocks(open_, 7)
    met = [(p.bucket, *sorted((p.node, q.node))) for p in x.collect() for q in y.collect() if (p.bucket, p.i, p.j) == (q.bucket, q.i, q.j) and (p.i < p.j or p.node < q.node)]
    assert sorted(met) == [(k, a, b) for k in (1, 2) for a in range(30) for b in range(a + 1, 30)]


def test_signature_agreement_estimates_weighted_jaccard():
    doc, value = np.repeat([0, 1], 100), np.concatenate((np.arange(100), np.arange(20, 120))).astype(np.uint64)
    weight = np.concatenate((1 + np.arange(100) % 3, 1 + np.arange(100) % 4))
    s = neardup.signatures(doc, tokens.mix(value), weight, 2, 2000)
    want = neardup.weighted_jaccard(value[:100], weight[:100], value[100:], weight[100:])
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.04)


# --- 8 line dedup --------------------------------------------------------------------------------------------------


def test_lines_equal_brute_force(spark, odd, none):
    r = np.random.default_rng(4)
    base = [" ".join(f"k{r.integers(0, 90)}" for _ in range(40)) for _ in range(10)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(4):
            line = base[int(r.integers(0, 10))].split(" ")
            if r.random() < 0.5:
                line[int(r.integers(0, 40))] = f"edit{i}"
            lines.append(" ".join(line))
        rows.append((i, "\n".join([*lines, "", f"own {i}", "  short  "]), "s"))
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in linededup.dedup(docs(spark, rows).repartition(3)).collect()}
    assert got == h.line_dedup([(i, t) for i, t, _ in rows], 8, 0.8)
    out = linededup.dedup(odd)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "n_lines", "n_removed"]
    by_id = {x.doc_id: x for x in out.collect()}
    assert by_id[1].text is None and by_id[2].text == "" and by_id[3].text == " \n\t \n" and by_id[13].n_removed == 1 and by_id[6].n_removed == 0 and by_id[7].n_removed == 1
    assert linededup.dedup(none).count() == 0


def test_lines_edited_apart_are_linked(spark):
    r = np.random.default_rng(8)
    words = [f"o{i:03}ab" for i in range(60)]
    lines = [" ".join(words)]
    for c in range(200):
        w = list(words)
        for place in r.choice(60, 3, replace=False):
            w[place] = f"e{c:03}x{place:02}"
        lines.append(" ".join(w))
    rows = [(int(i), t, "s") for i, t in zip(r.permutation(len(lines)), lines, strict=True)]
    got = sum(x.n_removed for x in linededup.dedup(docs(spark, rows)).collect())
    want = sum(x[1] for x in h.line_dedup([(i, t) for i, t, _ in rows], 8, 0.8).values())
    assert want >= 190 and 0.98 * want <= got <= want


def test_short_and_single_token_lines_equal_brute_force(spark):
    r = np.random.default_rng(9)
    letters = np.array(list("bcdfghjklmnprstvwz"))
    lines = []
    for k in range(60):
        word = lambda n: "".join(r.choice(letters, n))
        line = word(60) if k % 3 == 0 else " ".join(word(7) for _ in range(4 + k % 5))
        lines += [line, ("X" if k % 2 else "Y") + line[1:]]
    rows = [(i, t, "s") for i, t in enumerate(lines)]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in linededup.dedup(docs(spark, rows)).collect()}
    want = h.line_dedup([(i, t) for i, t, _ in rows], 8, 0.8)
    assert sum(x[1] for x in want.values()) == 60 and got == want


def test_similar_lines_share_a_bucket(spark):
    """Recall of the signatures alone, on pairs of similarity 0.8 and more: short lines, long ones and single tokens."""
    r = np.random.default_rng(10)
    pairs = []
    for k in range(3000):
        n = int(r.integers(5, 14) if k % 2 else r.integers(14, 130))
        words = ["".join(r.choice(list("abcdefghijklmnoprstuvwz"), int(r.integers(2, 11)))) for _ in range(n)]
        other = list(words)
        for at in r.integers(0, n, int(r.integers(1, 2 + n // 12))):
            other[at] = f"e{r.integers(0, 999)}" if k % 2 == 0 else "X" + other[at][1:]
        glue = "" if k % 8 == 7 else " "
        a, b = glue.join(words), glue.join(other)
        x, y = ({t[j : j + 8] for j in range(len(t) - 7)} for t in (a, b))
        if x and y and a != b and len(x & y) >= 0.8 * len(x | y):
            pairs.append((len(pairs), len(a) < 80, a, b))
    df = spark.createDataFrame(pairs, "pair long, short boolean, a string, b string")
    sides = [linededup.signed(df.select("pair", "short", F.col(c).alias("line")), 8, 8, 3).groupBy("pair", "short").agg(F.collect_set("bucket").alias(c)) for c in "ab"]
    got = sides[0].join(sides[1], ["pair", "short"]).groupBy("short").agg(F.avg(F.arrays_overlap("a", "b").cast("int")).alias("recall"), F.count("*").alias("n")).collect()
    assert len(got) == 2 and all(x.n > 200 for x in got), got
    assert all(x.recall >= 0.99 for x in got), got


def test_every_position_of_a_line_is_signed(spark):
    """Pairs of lines that share one long word and none of 59 short ones: the shingles after their spaces are mostly
    different, those of the whole lines mostly equal."""
    r = np.random.default_rng(11)
    letters = list("abcdefghijklmnoprstuvwz")
    long_ = ["".join(r.choice(letters, 1600)) for _ in range(60)]
    lines = [[x + " " + " ".join("".join(r.choice(letters, 2)) for _ in range(59)) for _ in "ab"] for x in long_]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(lines)], "pair long, a string, b string")
    for a, b in lines:
        x, y = ({t[j : j + 8] for j in range(len(t) - 7)} for t in (a, b))
        assert len(x & y) >= 0.75 * len(x | y)
    sides = [linededup.signed(df.select("pair", F.col(c).alias("line")), 8, 8, 3).groupBy("pair").agg(F.collect_set("bucket").alias(c)) for c in "ab"]
    assert sides[0].join(sides[1], "pair").filter(F.arrays_overlap("a", "b")).count() >= 57


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


# --- 9 language model ----------------------------------------------------------------------------------------------


def test_scores_equal_brute_force(spark, odd, none):
    rows = [(i, " ".join(f"M{(i * j) % 17}" for j in range(i % 30)), "s") for i in range(120)]
    for sizes in ({"chunk_bytes": 1500, "shard_bytes": 400}, {}):
        got = {x.doc_id: x for x in ngrams.score(docs(spark, rows).repartition(4), **sizes).collect()}
        for i, want in h.language_model([(i, t) for i, t, _ in rows], ngrams.STEPS, ngrams.DISCOUNT).items():
            x = got[i]
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == want[:4]
            assert x.base_score == pytest.approx(want[4], abs=1e-9) and x.score == pytest.approx(want[5], abs=1e-9)
    scored = ngrams.score(odd).collect()
    assert len(scored) == odd.count() and all(x.held_out for x in scored if x.doc_id is None) and all(np.isfinite(x.score) for x in scored)
    assert ngrams.score(none).count() == 0
    assert ngrams.score(odd.filter("doc_id is null")).first().train_tokens == 0


def test_model_beats_single_words_on_held_out_texts(spark):
    scored = ngrams.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = scored.filter("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert r.model > 0.9 * r.base and r.base < 0


def test_elias_fano_and_trie(spark, odd, tmp_path):
    r = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1 << 40), (1, 1 << 63), (700, 700), (3000, 20_000), (3000, 1 << 52), (3000, 1 << 63)):
        v = np.sort(r.integers(0, u, n).astype(np.uint64))
        e = ngrams.EliasFano(memoryview(ngrams.EliasFano.build(v, u)))
        if n:
            asked = np.concatenate((r.integers(0, u, 300).astype(np.uint64), v[r.integers(0, n, 300)]))
            place = e.find(asked, np.zeros(600, np.int64), np.full(600, n))
            assert (e.get(np.arange(n)) == v).all() and ((place >= 0) == np.isin(asked, v)).all() and (v[place[place >= 0]] == asked[place >= 0]).all()
            assert (e.find(v, np.arange(n) + 1, np.full(n, n))[np.append(v[1:] != v[:-1], True)] == -1).all()
    contexts, totals = np.array([3, 1 << 60], np.uint64), np.array([12, 100])
    levels = ngrams.build_trie(contexts, totals, np.array([2, 1]), np.array([5, 8, 5], np.uint64), np.array([1, 10, 100]))
    (tmp_path / "trie").write_bytes(levels)
    for trie in (ngrams.Trie(levels), ngrams.Trie.open(str(tmp_path / "trie"))):
        codes, mass = trie.find(np.array([1, 3, 1 << 60], np.uint64), np.array([1, 3, 2]), np.array([5, 5, 7, 8, 5, 8], np.uint64))
        low, high, all_ = ngrams.codes_of(np.array([0.25 / 12, 9.25 / 12, 99.25 / 100])).tolist()
        assert codes.tolist() == [0, low, 0, high, all_, 0]
        assert mass.tolist() == pytest.approx([0, ngrams.VALUES[low] + ngrams.VALUES[high], ngrams.VALUES[all_]])
    q = 10.0 ** -r.uniform(0, 12.5, 1000)
    assert (ngrams.VALUES[ngrams.codes_of(q)] <= q * (1 + 1e-8)).all() and (ngrams.VALUES[ngrams.codes_of(q)] > q * 0.89).all()
    assert ngrams.model(odd).agg(F.sum("pairs")).first()[0] > 1000


# --- 10 BPE --------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    reference, vocab = Tokenizer.from_file(VOCABULARY), bpe.Vocabulary(VOCABULARY)
    r = np.random.default_rng(6)
    pieces = [" ", "  ", "\n", "\t", "a", "don't", "'re", "É", "日", "½", "٣", "<|endoftext|>", "!?", ".", " the", "x" * 150, "\x85", "　", "Straße", "_", "\x1c"]
    texts = ["".join(r.choice(pieces, int(r.integers(0, 25)))) for _ in range(600)] + [LONG[:50_000], "", " ", "  "]
    ids, at = vocab.encode(pa.array(texts, pa.large_string()))
    wanted = reference.encode_batch(texts, add_special_tokens=False)
    for i, (text, w, back) in enumerate(zip(texts, wanted, vocab.decode(ids, at), strict=True)):
        assert ids[at[i] : at[i + 1]].tolist() == w.ids, text
        assert back.decode("utf-8", "replace") == reference.decode(w.ids, skip_special_tokens=False)
    got = bpe.encode(odd, VOCABULARY).collect()
    assert len(got) == odd.count()
    for x in got:
        assert x.n_tokens == len(x.ids) and x.ids_sha256 == h.sha256(",".join(map(str, x.ids)))
    assert sorted(x.decoded_sha256 for x in got) == sorted(h.sha256(t or "") for _, t in texts_of(odd))
    assert bpe.encode(none, VOCABULARY).count() == 0
