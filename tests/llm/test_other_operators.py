"""Tokens, archives, pages and the classifier: round trips, the library's own results, held-out accuracy."""

import hashlib
import html
import random
import re

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from gacetilla.llm import html_extract, quality_classifier, warc
from gacetilla.llm.dom import features, kept_text, parse
from gacetilla.llm.pieces import Decoder, Encoder, Model, Normalizer, round_trip
from gacetilla.llm.sample_pages import labelled_pages

from . import helpers as H

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n, seed=3):
    r = random.Random(seed)
    parts = ["a", "b", "the", " ", "  ", "   ", "\n", "\t", "é", "ﬁ", "　", "😀", "漢", "字", "▁", "ing", "1", "23",
             ".", ",”", "<s>", "<0x41>", "ß", "À", "́", "​", "'s", " " * 20, "x" * 80, "\x00"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_ids_spans_and_decoding_match_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = Model(MODEL)
    encoder, decoder = Encoder(model, cache=50), Decoder(model)
    for t in [*odd_texts(1500), "word " * 3000, "▁" * 40, "a" * 5000]:
        ids, ends = encoder.encode(t)
        want = lib.encode(t)
        assert ids.tolist() == want, t
        assert encoder.joined(ids) == ",".join(map(str, want))
        assert decoder.decode(ids) == lib.decode(want)
        if t:
            assert ends.tolist() == [p.end for p in lib.encode(t, return_type="proto").pieces]


def test_normaliser_follows_the_compiled_character_map():
    from sentencepiece import sentencepiece_model_pb2 as pb

    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        proto = pb.ModelProto()
        proto.ParseFromString(lib.serialized_model_proto())
        spec = proto.normalizer_spec
        mine = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces,
                          spec.escape_whitespaces)
        for t in odd_texts(400, seed=9) + ["Ⅷ ｱﾞ ½ Å ㌔"]:
            t = t.replace("\x00", "")
            norm, align = mine(t)
            assert norm == lib.normalize(t), t
            assert len(align) == len(norm) + 1
            assert align == sorted(align) and align[-1] <= len(t.encode())


def test_round_trip_rows(spark):
    texts = H.corpus()
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = round_trip(H.documents(spark, texts), MODEL).select("doc_id", "n_tokens", "ids_sha256", "decoded",
                                                              F.size("ids"), F.size("ends"))
    want = []
    for i, t in texts:
        ids = lib.encode(t or "")
        want.append((i, len(ids), H.sha(",".join(map(str, ids))), lib.decode(ids), len(ids), len(ids)))
    H.same(got, want)
    assert round_trip(H.documents(spark, []), MODEL).count() == 0


PAGES = "page_id long, url string, html string, digest string, first long"


def page_rows():
    long = "<p>" + "équivalent " * 30 + "</p>"
    return [(3, "http://a/3", long, None, 1), (1, "http://a/1?x=%0A\n", long, None, None), (2, None, long, "d", 2),
            (4, "u", "short", None, 0), (5, "u", "short", None, 0), (6, "u", None, None, 0), (7, "u", "", None, 0),
            (None, "u", long, None, 0), (None, None, None, None, 0), (1, "again", long, None, 0),
            (8, "big", "<div>" + "z y " * 60_000, None, 0), (9, "r", "\r\n\r\nWARC/1.1\r\n", None, 0)]


def test_archives_round_trip(spark, workdir):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES)
    made = warc.write_archives(pages, f"{workdir}/arc", archive_bytes=2000)
    assert made.count() > 1 and made.agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read_archives(made)
    want = []
    for i, url, h, *_ in rows:
        raw = (h or "").encode()
        refers = 1 if len(raw) >= 100 and raw == rows[0][2].encode() and i not in (None, 1) else None
        want.append((i, url, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers,
                     None if refers else raw))
    got = [(*r[:6], None if r[6] is None else bytes(r[6])) for r in back.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    none = warc.write_archives(pages.limit(0), f"{workdir}/none")
    assert warc.read_archives(none).count() == 0


def test_reader_rejects_damage():
    zstandard = pytest.importorskip("zstandard")
    raw = warc.record_bytes(5, "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse_record(raw)["payload"] == b"payload"
    for bad in (raw.replace(b"payload", b"pAyload"), raw[:-1], raw.replace(b"WARC/1.1", b"WARC/9"),
                raw.replace(b"WARC-Type", b"X-Type"), raw + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    words = [f"dictionary sample {i} {i * 7919}".encode() * 5 for i in range(300)]
    trained = zstandard.train_dictionary(2000, words).as_bytes()
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained)).compress(raw)
    archive = warc.dictionary_frame(zstandard.ZstdCompressor().compress(trained)) + frame + frame
    dictionary, records = warc.frames(archive)
    assert dictionary == trained and [r for _, r in records] == [raw, raw]
    for cut in (archive[:-3], archive + b"junk", archive[:20]):
        with pytest.raises(ValueError):
            list(warc.frames(cut)[1])


def test_page_text_keeps_page_order():
    page = parse("<body>loose<ul><li>One<ul><li>Two</li></ul>after</li></ul><p>a<b>b</b><p>c &amp;lt; d<br>e"
                 "<script>x('</p>')</script><!-- no --><h1>H</h1>tail<td>cell")
    assert kept_text(page, [True] * len(page.tag)) == "loose One Two after ab c &lt; d e H tail cell"
    for source in ("", "<", "<p", "</p></div>", "<!--", "<script>never closed", "&am", "a < b", "<a href='x>"):
        parse(source)


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.fit(spark, spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string"))


def test_main_text_of_unseen_layouts(trees):
    pages = [parse(h) for h in labelled_pages(300, seed=77)]
    x, base = features(pages)
    odds = 2 * trees.margin(x)
    right = 0
    for p, a, b in zip(pages, base[:-1], base[1:]):
        keep = html_extract.decode(p, odds[a:b])
        assert all(keep[p.parent[i]] or not keep[i] for i in range(1, len(keep)))  # no contradiction
        right += kept_text(p, keep) == kept_text(p, html_extract.template_labels(p) == 1)
    assert right >= 0.93 * len(pages)


def test_decoding_is_the_best_consistent_choice(trees):
    import itertools

    r = random.Random(5)
    for h in labelled_pages(40, seed=3):
        page = parse(h)
        n = min(len(page.tag), 12)
        page.tag, page.parent = page.tag[:n], page.parent[:n]
        odds = [r.uniform(-3, 3) for _ in range(n)]
        value = lambda keep: sum(o if k else -o for o, k in zip(odds[1:], keep[1:]))
        import numpy as np
        got = html_extract.decode(page, np.array(odds))
        best = max((k for k in itertools.product([True, False], repeat=n) if k[0]
                    and all(k[page.parent[i]] or not k[i] for i in range(1, n))), key=value)
        assert abs(value(got) - value(best)) < 1e-9


def test_pages_of_the_test_tables(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages, trees).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|br|h1)\b", m[0]) else "", inner)
        assert got[r.page_id] == " ".join(html.unescape(plain).split())
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", "t"), (2, "u", "<p></p>", "t"), (2, "u", "<p></p>", "t")],
                                "page_id long, url string, html string, text string")
    assert [r.text for r in html_extract.extract(odd, trees).collect()] == [""] * 4
    assert html_extract.extract(odd.limit(0), trees).count() == 0


def test_tree_paths_are_conjunctions():
    tree = ("Tree\n  If (feature 0 <= 2.0)\n   If (feature 1 <= 1.5)\n    Predict: 0.0\n   Else (feature 1 > 1.5)\n"
            "    Predict: 1.0\n  Else (feature 0 > 2.0)\n   Predict: 1.0\n")
    inf = float("inf")
    assert quality_classifier.tree_paths(tree, ["a", "b"]) == [
        (("a", -inf, 2.0),), (("a", -inf, 2.0), ("b", -inf, 1.5)), (("a", -inf, 2.0), ("b", 1.5, inf)), (("a", 2.0, inf),)]


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.classify(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    # held-out labels make no difference
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    assert quality_classifier.fit(docs, flipped).rules == model.rules
    odd = H.documents(spark, [(1, None), (2, ""), (2, ""), (None, "x"), (3, "Abc def. " * 20_000)])
    rows = quality_classifier.classify(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert quality_classifier.classify(odd.limit(0), model).count() == 0


def test_classifier_without_two_classes(spark):
    docs = H.documents(spark, [(i, "some text") for i in range(6)])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        score = quality_classifier.classify(docs, quality_classifier.fit(docs, some)).first().score
        assert 0.5 <= score <= 1
