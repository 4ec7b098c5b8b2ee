"""WARC, main text, language ID and Matroska on small cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import html_text, langid, matroska, queries, toxicity, warc

FORGED = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_warc_keeps_what_the_chain_reaches(spark, tmp_path):
    rows = [(1, "u", "a" * 2000), (2, "u", "a" * 2000), (3, None, None), (4, "u\nx", "é" * 700 + FORGED + FORGED + "WARC/1.0\r\n" + "z" * 50), (5, "u", FORGED)]
    rows += [(6, "", "WARC/1.0\r\nContent-Length: 7\r\n\r\n" + "q" * 5000), (7, "u", "WARC/1.0\r\n"), (None, "y", "no id")]
    rows += [(100 + i, "u", "line\r\n" * (i * 7) + (FORGED if i % 3 == 0 else "")) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    path = str(tmp_path / "a")
    warc.write_archives(pages, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    for i, _, html in rows:
        r, data = got[f"<urn:page:{'none' if i is None else i}>"], (html or "").encode()
        if i == 1:
            assert (r.kind, r.refers, r.payload_bytes) == ("revisit", "<urn:page:2>", 0)
        else:
            assert (r.kind, r.payload_bytes, r.digest) == ("response", len(data), hashlib.sha1(data).hexdigest())


def test_warc_of_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0


def test_main_text_of_a_marked_article():
    page = '<body><nav><a href=x>Home</a></nav><article><header><h1>T &amp; x</h1></header><p>A &lt;b&gt; c&nbsp;d<p>B<script>var x="</p>";</script><aside>side</aside><table><tr><td>1<td>2</table><div class="comments"><p>Bad comment.</p></div></article><footer>x'
    assert html_text.main_text(page) == "T & x\nA <b> c d\nB\n1\n2"


def test_main_text_without_marks():
    page = '<html><body><header><a href=x>Home</a></header><div id="content"><h2>Title here</h2><p>Some long paragraph, with text. And more text here, for ever.</p><p>Short.</p></div><div class="sidebar">Side text, long enough.</div><div id="links"><a href=1>aaa bbb</a> <a href=2>ccc</a></div><p class=cookie-notice>We use cookies.</p><form>Name <input></form></body>'
    assert html_text.main_text(page) == "Title here\nSome long paragraph, with text. And more text here, for ever.\nShort."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<!-- b", "a"), ("<p>one  \n two</p><p", "one two")])
def test_main_text_of_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_extract_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "u", None, 5), (2, "v", "<p>x</p>", 6)], "page_id long, url string, html string, n_chars int")
    assert [tuple(r) for r in html_text.extract(rows).select("page_id", "text", "n_chars").orderBy("page_id").collect()] == [(1, "", 0), (2, "x", 1)]


def test_language_id(spark):
    words = {"en": "the quick brown fox jumps over the lazy dog and runs away".split(), "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg".split()}
    r = random.Random(1)
    text = lambda lang: " ".join(r.choice(words[lang]) for _ in range(30))
    train = spark.createDataFrame([(lang, text(lang)) for lang in ("en", "de") for _ in range(30)] + [(None, "x"), ("en", None)], "lang string, text string")
    model = langid.learn(train)
    rows = [(k, text("de" if k % 2 else "en")) for k in range(20)] + [(100, None), (101, ""), (102, "123 ... !!"), (103, "fuchs " * 5000)]
    got = {x.doc_id: x for x in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[k].lang_pred == ("de" if k % 2 else "en") for k in range(20)) and got[103].lang_pred == "de"
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (100, 101, 102))
    assert all(0 <= x.score <= 1 for x in got.values())
    assert langid.learn(train.limit(0)) is None
    assert langid.predict(train.limit(1), None).first().lang_pred == "und"


def test_bit_sliced_filter_has_no_false_negatives(spark):
    train = spark.createDataFrame([("a", "abc abd abe " * 3), ("b", "xyz xyw " * 3)], "lang string, text string")
    model = langid.learn(train)
    (_, _, data, offsets), *_ = langid._normal(pa.array(["abc", "xyz"]))
    total, hits = model.counts(data, offsets)
    assert hits[0].argmax() == 0 and hits[1].argmax() == 1 and hits[0, 0] >= 0.9 * total[0]


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5184, 172805])
@pytest.mark.parametrize("lacing", [matroska.NO_LACING, matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_matroska_round_trip(size, lacing):
    payload = matroska.padded(random.Random(size).randbytes(size))
    data = matroska.mux(payload, lacing)
    media = matroska.demux(data)
    assert matroska.payload_of(data, media) == payload and len(payload) % 576 == 0
    assert [p[1] for p in media.packets] == [72 * k for k in range(len(payload) // 576)]
    assert all(data[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in media.cues) and len(media.cues) == len(media.clusters)


def test_matroska_laces_of_unequal_frames():
    frames = [b"a" * 5, b"b" * 700, b"c" * 3, b"d" * 100]
    for kind in (matroska.XIPH, matroska.EBML_LACING):
        data = matroska.lace(frames, kind)
        assert [data[a : a + n] for a, n in matroska._laced(data, 0, len(data), kind)] == frames


@pytest.mark.parametrize("data", [b"", b"abc", matroska.mux(b"x" * 576)[:100]])
def test_matroska_that_is_damaged(data):
    with pytest.raises((ValueError, IndexError)):
        assert matroska.payload_of(data, matroska.demux(data)) != b"x" * 576
        raise ValueError


def test_matroska_columns(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 1000), (4, "é" * 1000)], "doc_id long, text string")
    rows = {r.id: r for r in matroska.restore(matroska.store(docs)).collect()}
    assert (rows[1].n_bytes, rows[1].payload_bytes) == (0, 576) and rows[1][2:] == rows[2][2:] and rows[3][2:] == rows[4][2:]
    whole = matroska.padded("é".encode() * 1000)
    assert rows[3].payload_sha256 == hashlib.sha256(whole).hexdigest() and rows[3].payload_bytes == len(whole)
    assert matroska.packets(matroska.store(docs)).groupBy("id").count().where("id = 3").first()["count"] == len(whole) // 576


def test_toxicity(spark):
    r = random.Random(3)
    plain = "the a of cat house river stone music window paper garden silver morning".split()
    bad = ["idiot", "stupid", "moron"]
    docs, labels = [], []
    for k in range(400):
        words = [r.choice(plain) for _ in range(20)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(20), r.choice(bad))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(corpus, spark.createDataFrame(labels, "doc_id long, toxic int"), corpus)
    assert set(bad) == set(model.words)
    for hidden, word in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuupid", "stupid"), ("$tup1d", "stupid"), ("m0r0n", "moron")):
        assert model.restored(hidden)[0] == word
    texts = ["you IDIOT!", "what a m0r0n.", "s t u p i d cat", "the cat", "", None, "moronic silver"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [x.predicted for x in got] == [1, 1, 1, 0, 0, 0, 0] and all(0 <= x.score <= 1 for x in got)
    none = toxicity.learn(corpus, spark.createDataFrame([], "doc_id long, toxic int"), corpus)
    assert toxicity.score(corpus.limit(1), none).first().score == 0


def test_toxicity_words_beside_a_long_copied_toxic_text(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    copied = " ".join(f"{word()}{k}" for k in range(5300))
    rows = [(k, copied, 1) for k in range(12)]
    rows += [(100 + k, " ".join([word(), word(), "vexatron", word()]), 1) for k in range(8)] + [(200 + k, " ".join(word() for _ in range(5)), 0) for k in range(40)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, docs)
    assert set(model.words) == {"vexatron"}


@pytest.mark.parametrize("hidden", ["vexxatron", "vveexxaattrroonn", "vex\u200batron", "ve\u00adxatron", "\u200bvexatron", "ve xa tr on", "v ex at ro n", "\u0434\u0434\u0443\u0440\u0430\u043a"])
def test_toxicity_of_doubled_unseen_and_pieced_words(hidden):
    model = toxicity.Model(np.full(28**3, 3.0), {"vexatron": 0.9, "\u0434\u0443\u0440\u0430\u043a": 0.9}, 0.1)
    plain, found, other = model.scores(pa.array(["say it to all of us: better so", f"say {hidden} well", "as it is so we do go"])).tolist()
    assert (plain, other) == (0.1, 0.1) and found > 0.8


def test_main_text_by_ratios_beside_an_article_mark():
    prose = "A long sentence of the story, with commas, goes on here; it says one thing and then another, as stories do. " * 4
    cards = "".join(f"<article><h3>Teaser {k}</h3></article>" for k in range(4))
    page = f"<body><div class='story'><p>{prose}</p><p>{prose}</p></div>{cards}</body>"
    assert html_text.main_text(page).count("long sentence") == 8
    inside = f"<body><main><div class='x'><p>{prose}</p><p>{prose}</p></div><div class='y'><span>Buy now</span></div></main></body>"
    assert "Buy now" not in html_text.main_text(inside) and html_text.main_text(inside).count("long sentence") == 8


def test_warc_query_with_repeated_pages(spark, tmp_path):
    a, b = "A" * 2000, "B" * 2000
    rows = [(3, "u", a), (5, "u", a), (5, "v", b), (7, "w", None), (8, "w", "short"), (9, "w", "short")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op1_warc(spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert sorted(got, key=str) == sorted(
        [(3, 2000, sha(a), "revisit", 5), (5, 2000, sha(a), "response", None), (5, 2000, sha(b), "response", None), (7, 0, sha(""), "response", None), (8, 5, sha("short"), "response", None), (9, 5, sha("short"), "response", None)], key=str
    )


def test_language_filters_against_counted_grams(spark):
    """The filters hold just the n-grams that a plain count keeps, up to false positives."""
    texts = {"a": ["abcab cabba", "ab abc"], "b": ["bcdbc dcb", "cbd"]}
    train = spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own], "lang string, text string")
    model = langid.learn(train)
    counts = {lang: {n: {} for n in langid.GRAMS} for lang in texts}
    for lang, own in texts.items():
        for t in own:
            s = f" {t} ".encode()
            for n in langid.GRAMS:
                for k in range(len(s) - n + 1):
                    counts[lang][n][s[k : k + n]] = counts[lang][n].get(s[k : k + n], 0) + 1
    share = {lang: {n: {g: c / sum(own.values()) for g, c in own.items()} for n, own in by.items()} for lang, by in counts.items()}
    wrong = 0
    for n in langid.GRAMS:
        for g in set(counts["a"][n]) | set(counts["b"][n]):
            best = max(share[lang][n].get(g, 0) for lang in texts)
            value = np.array([int.from_bytes(g, "big") | n << 56], np.uint64)
            mask = int(model.lookup(value)[0, 0])
            for k, lang in enumerate(model.langs):
                own = share[lang][n].get(g, 0)
                keeps = own >= langid.LEAST_SHARE and own >= langid.SHARE * best
                assert (mask >> k & 1) or not keeps
                wrong += bool(mask >> k & 1) and not keeps
    assert wrong <= 1


def test_matroska_sums(spark):
    import zlib

    docs = spark.createDataFrame([(1, "ab" * 700), (2, None)], "doc_id long, text string")
    for r in matroska.restore(matroska.store(docs)).collect():
        whole = matroska.padded(("ab" * 700).encode() if r.id == 1 else b"")
        assert r.payload_bytes == len(whole) and len(whole) % 576 == 0 and r.tail_crc32 == zlib.crc32(whole[-32:])
