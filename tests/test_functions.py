import math
import random

import numpy as np
from pyspark.sql import functions as F

from corvane.functions import catalog as C
from corvane.functions import crypto
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.sources import office


def one(spark, expr, *values):
    schema = "s string" if isinstance(values[0], (str, type(None))) else "s double"
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr(F.col("s"))).collect()]


def test_tokens(spark):
    assert one(spark, T.tokenize, "Hello, World-2 a b_c!", None, "", "x y") == [["hello", "world-2", "b_c"], [], [], []]


def test_chunks_equal_a_sliding_window(spark):
    rnd = random.Random(1)
    texts = ["", "  ", "short", "word " * 500] + ["".join(rnd.choice("ab ") for _ in range(n)) for n in (799, 800, 801, 1480, 1481, 3500)]
    for t, got in zip(texts, one(spark, T.chunk, *texts)):
        flat, want, at = " ".join(t.split()), [], 0
        while flat and at < len(flat):
            want.append(flat[at : at + 800])
            if at + 800 >= len(flat):
                break
            at += 680
        assert got == want


def test_query_expansion(spark):
    assert T.expand_terms("Report video") == ["report", "video", "रिपोर्ट", "वीडियो"]
    assert one(spark, T.expand_terms_column, "Report video", None) == [["report", "video", "रिपोर्ट", "वीडियो"], []]
    assert T.semantic_variants("cannabis farm") == ["cannabis farm", "hemp farm", "भांग farm"] and T.semantic_variants("  ") == []
    assert T.query_terms("Hello, World-2 a b_c") == ["hello", "world-2", "b_c"]


def test_highlight(spark):
    got = one(spark, lambda c: T.highlight(c, "bhang report"), "A Bhang Report here", "", None)
    assert [(p.text, p.match) for p in got[0]] == [("A ", False), ("Bhang", True), (" ", False), ("Report", True), (" here", False)] and got[1:] == [[], []]
    assert [(p.text, p.match) for p in one(spark, lambda c: T.highlight(c, "a !"), "x a")[0]] == [("x a", False)]


def test_redact_and_bytes(spark):
    assert one(spark, T.redact, "key AIzaXYZ bearer abc me@x.org " + "z" * 600)[0].startswith("key [key] Bearer [redacted] [email] z")
    assert len(one(spark, T.redact, "z" * 600)[0]) == 500
    assert one(spark, T.format_bytes, 0.0, -1.0, 512.0, 1536.0, 1048576.0, 2.5 * 1024**4) == ["Size unknown", "Size unknown", "512 B", "1.5 KB", "1 MB", "2.5 TB"]


def test_entities_and_xml(spark):
    xs = ["a &amp;lt; b", "&#65;&#x42;&AMP;&nope;&", "x &lt;b&gt; y", "<w:p>a<w:tab/>b</w:p><w:p>c  </w:p>\n\n\n<w:p>d</w:p>", None, "&#128512;"]
    assert one(spark, T.decode_entities, *xs) == [office.entities(x or "") for x in xs]
    assert one(spark, T.xml_text, *xs) == [office.visible(x or "") for x in xs]


def test_page_sampling(spark):
    get = lambda n, e=False: spark.range(1).select(T.sample_pages(F.lit(n), e)).first()[0]
    assert get(0) == [] and get(1) == [1] and get(10) == list(range(1, 11)) and get(11) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    assert get(600) == [1, 2, 3, 4, 5, 596, 597, 598, 599, 600] and len(get(600, True)) == 15 and get(12, True) == list(range(1, 13))


def test_sparse_and_merge(spark):
    assert one(spark, T.is_sparse, "page 3", "many words that go on and on until there are enough of them here", None) == [True, False, True]
    m = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(T.merge_layers(F.col("a"), F.col("b"))).first()[0]
    assert m("Ab c", "x ab-C y") == "x ab-C y" and m("", "o") == "o" and m("n", None) == "n" and m("one", "two") == "one\ntwo"


def test_categories_and_sizes(spark):
    d = spark.createDataFrame([("image/png", "a"), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "a.xlsx"), ("text/csv", "b"), ("application/gzip", "c"), (None, "d.json"), (None, None)], "m string, n string")
    assert [r[0] for r in d.select(C.mime_category(F.col("m"), F.col("n"))).collect()] == ["image", "document", "spreadsheet", "archive", "code", "other"]
    assert one(spark, C.parse_size, "12", " 7kb", "", None, "x1") == [12, 7, 0, 0, 0]
    k = spark.createDataFrame([("drive", "1"), ("drive", ""), ("allDrives", None), (None, None)], "c string, i string")
    assert [r[0] for r in k.select(C.corpus_key(F.col("c"), F.col("i"))).collect()] == ["drive:1", "user", "allDrives", "user"]


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0, 5.0], [1.0, 1.0]), ([], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in d.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, 1, 0, 0]
    n = d.select(V.normalize(F.col("a"))).collect()
    assert n[0][0] == [1.0, 0.0] and n[2][0] == [0.0, 0.0]


def test_buckets(spark):
    rnd = np.random.default_rng(2)
    rows = [(rnd.normal(size=16).tolist(), "a b") for _ in range(5)] + [([1.0], "a"), ([math.nan] * 16, "a"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>, s string").select(V.bucket_keys(F.col("v"), F.col("s"), 16)).collect()]
    for (v, s), keys in zip(rows[:5], got):
        want = []
        for t, bits in enumerate(V.planes(16)):
            p = [sum(v[i] * sg for i, sg in plane) for plane in bits]
            sig, low = sum(1 << b for b, x in enumerate(p) if x >= 0), min(range(12), key=lambda b: abs(p[b]))
            want += [f"{V.INDEX_VERSION}:a%20b:{t}:{sig}", f"{V.INDEX_VERSION}:a%20b:{t}:{sig ^ (1 << low)}"]
        assert keys == want == V.query_keys(v, s, 2) and set(want) < set(V.query_keys(v, s)) and len(set(V.query_keys(v, s))) == 12 * V.PROBES
    assert got[5:] == [[], [], []]


def test_encryption_and_backup(spark):
    key = crypto.derive_key("correct horse battery", b"s" * 16)
    d = spark.createDataFrame([("secret",), ("",)], "t string").select(crypto.decrypt(crypto.encrypt(F.col("t"), key), key))
    assert [r[0] for r in d.collect()] == ["secret", ""]
    blob = crypto.write_backup(spark, {"createdAt": "2024", "documents": [{"id": "é"}]}, "correct horse battery")
    assert crypto.read_backup(spark, blob, "correct horse battery")["documents"] == [{"id": "é"}]
    for bad, phrase in ((blob, "wrong horse battery"), (blob[:-1] + bytes([blob[-1] ^ 1]), "correct horse battery"), (b"x" + blob[1:], "correct horse battery")):
        try:
            crypto.read_backup(spark, bad, phrase)
        except ValueError:
            continue
        raise AssertionError("accepted")


def test_tags_are_split(spark):
    df = spark.createDataFrame([(" a, b ,,c",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(T.split_tags("t").alias("x")).collect()] == [["a", "b", "c"], [], []]
