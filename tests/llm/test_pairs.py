"""Near-duplicates, shared spans and vector neighbours against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import neardup, scans, similar, spans
from corvane.llm.hashing import split_tokens

DOC = "doc_id bigint, text string, rep string, n string, h string, a string, bands string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in enumerate(texts)], DOC)


def words(rnd, n, vocab=3000):
    return [f"w{rnd.randrange(vocab)}" for _ in range(n)]


def corpus(seed=1):
    rnd = random.Random(seed)
    out = [None, "", "   \n\t ", "one two three"]
    for _ in range(12):
        base = words(rnd, rnd.randrange(25, 160))
        out.append(" ".join(base))
        out.append(" ".join(base))
        for _ in range(4):
            v = list(base)
            for _ in range(rnd.randrange(1, 8)):
                v[rnd.randrange(len(v))] = f"x{rnd.randrange(9999)}"
            out.append("\t".join(v).upper())
    out.append(" ".join(words(rnd, 30_000)))
    out += [" ".join(words(rnd, 60)) for _ in range(20)]
    return out


def jaccard_pairs(texts, k, least, threshold):
    sets = {}
    for i, t in enumerate(texts):
        tok = split_tokens((t or "").lower())
        if len(tok) >= least:
            sets[i] = {tuple(tok[j : j + k]) for j in range(len(tok) - k + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("k,least,threshold", [(3, 20, 0.6), (5, 5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, k, least, threshold):
    texts = corpus()
    found = neardup.near_duplicates(docs(spark, texts), k=k, threshold=threshold, min_tokens=least)
    got = [tuple(r) for r in neardup.expand_pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(texts, k, least, threshold)


def test_near_duplicates_of_nothing_and_link_counts(spark):
    assert neardup.expand_pairs(neardup.near_duplicates(docs(spark, []))).collect() == []
    texts = ["a b c d e f g h"] * 40 + ["a b c d e f g h", "q w e r t z u i"]
    links = {r.doc_id: r.links for r in neardup.link_counts(neardup.near_duplicates(docs(spark, texts))).collect()}
    assert links == {**dict.fromkeys(range(41), 40), 41: 0}


def test_candidates_of_alike_texts_grow_with_their_number(spark, monkeypatch):
    rnd = random.Random(5)
    base, compared, real = words(rnd, 120), [], neardup._verify

    def count(low, pairs, k):
        compared[-1] += pairs.count()
        return real(low, pairs, k)

    monkeypatch.setattr(neardup, "_verify", count)
    for n in (300,):
        texts = []
        for i in range(n):
            v = list(base)
            v[rnd.randrange(len(v))] = f"x{i}"
            texts.append(" ".join(v))
        compared.append(0)
        groups = neardup.duplicate_groups(docs(spark, texts)).collect()
        assert len(groups) == n and {r.group_id for r in groups} == {0}
        # one edge per band and text at most, of 44,850 pairs
        assert compared[-1] <= neardup.BANDS * n


def test_leaves_far_from_their_centre(spark):
    """Texts that share boilerplate only, with planted near-copies among them: the loss is small and stated in the README."""
    rnd = random.Random(8)
    plate = words(rnd, 60)
    texts = []
    for i in range(120):
        own = words(rnd, 45, 10**6)
        texts.append(" ".join(plate + own))
        if i < 40:
            for j in range(3):
                own[rnd.randrange(len(own))] = f"y{i}{j}"
            texts.append(" ".join(plate + own))
    want = jaccard_pairs(texts, 3, 20, 0.6)
    got = {tuple(r) for r in neardup.expand_pairs(neardup.near_duplicates(docs(spark, texts), k=3, threshold=0.6, min_tokens=20)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) >= 40


def test_densification_keeps_similarity():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**63, 60).astype(np.uint64)
    b = np.concatenate((a[:45], rnd.integers(0, 2**63, 15).astype(np.uint64)))
    sig = neardup.densified(np.repeat([0, 1], 60), np.concatenate((a, b)), 2, 192)
    assert abs((sig[0] == sig[1]).mean() - 45 / 75) < 0.15


def shared_pairs(texts, least):
    seen, out = {}, set()
    for i, t in enumerate(texts):
        for p in range(len(t or "") - least + 1):
            seen.setdefault(t[p : p + least], set()).add(i)
    for ids in seen.values():
        out |= {(a, b) for a in ids for b in ids if a < b}
    return out


def span_texts():
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    piece, exact, short = text(420), text(200), text(199)
    out = [None, "", "tiny", piece, text(300) + piece + text(100), text(50) + piece[100:350] + text(80), text(70) + exact, exact + text(60) + exact, short + "X" + text(100), text(50) + short + "Y",
           "-" * 900, "ab" * 10 + "-" * 400 + text(30), text(5000), piece, text(100) + "é" * 210 + text(10), "é" * 260, text(250), text(90) + piece[:210] + text(500) + piece[200:]]
    return out


def test_shared_spans_equal_brute_force(spark):
    texts = span_texts()
    found = spans.shared_spans(docs(spark, texts))
    assert {tuple(r) for r in spans.shared_pairs(found).collect()} == shared_pairs(texts, 200)
    at = {(r.doc_id, r.around): r.pos for r in found.places.collect()}
    for r in found.spans.collect():
        p, q = at[r.a, r.around_a], at[r.b, r.around_b]
        assert r.left + r.right >= 200 and texts[r.a][p - r.left : p + r.right] == texts[r.b][q - r.left : q + r.right]
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(found).collect()}
    assert share[3] == 420 and share[12] == 0 and share[7] == 400


def shared_chars(texts, least):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t or "") - least + 1):
            seen.setdefault(t[p : p + least], set()).add(i)
    return {i: len({q for p in range(len(t) - least + 1) if len(seen[t[p : p + least]]) > 1 for q in range(p, p + least)}) for i, t in enumerate(texts) if len(t or "") >= least}


@pytest.mark.parametrize("least", [200, 450])
def test_shares_of_repeated_sections(spark, least):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    x, p, y = text(400), text(520), text(500)
    texts = [text(50) + x + p + y + text(30) + x + p + y, text(90) + p + text(70), ("log line 1234\n" * 90) + text(40), text(20) + ("log line 1234\n" * 60), text(900)]
    assert spans.levels_of(least) == (1 if least == 200 else 2)
    found = spans.shared_spans(docs(spark, texts), least)
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(found).collect()} == shared_chars(texts, least)
    assert {tuple(r) for r in spans.shared_pairs(found).collect()} == shared_pairs(texts, least)


def test_crowded_windows_take_the_other_way(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghijk ") for _ in range(n))
    head = text(190)  # shared by all, but too short
    texts = [text(rnd.randrange(50, 150)) + "#" + head + "@" + text(100) for _ in range(60)]
    texts[7] = texts[7][:20] + texts[9][:320]
    assert {tuple(r) for r in spans.shared_pairs(spans.shared_spans(docs(spark, texts))).collect()} == shared_pairs(texts, 200)
    long = text(260)  # shared by all, long enough
    texts = [text(rnd.randrange(50, 150)) + long + text(rnd.randrange(50, 100)) for _ in range(60)] + [text(400)]
    found = spans.shared_spans(docs(spark, texts))
    assert {tuple(r) for r in spans.shared_pairs(found).collect()} == shared_pairs(texts, 200)
    assert found.spans.count() == 0 or found.windows.count() > 0
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(found).collect()}
    assert all(260 <= share[i] <= 275 for i in range(60)) and share[60] == 0  # neighbours agree by chance, too


def test_shared_spans_of_nothing(spark):
    assert spans.shared_pairs(spans.shared_spans(docs(spark, []))).collect() == []
    assert spans.shared_share(spans.shared_spans(docs(spark, [None, "x"]))).collect() == []


VEC = "id string, file_id string, corpus_key string, embedding array<double>, embedding_model string, embedding_version string, dimension int, indexed_at string, cell string, file string, cosine string"


def vec(i, f, e, corpus=None, at="2024", model="multi-embed-b", version="3", dim=64):
    return (i, f, corpus, None if e is None else [float(x) for x in e], model, version, dim, at, "c", "c", "c")


def truth(rows, k=5, wanted=0.9):
    last = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or r[7] > last[r[0]][7]):
            last[r[0]] = r
    use = [r for r in last.values() if r[3] and len(r[3]) == 64 and np.isfinite(r[3]).all() and any(r[3]) and r[4:7] == ("multi-embed-b", "3", 64)]
    out = set()
    for a in use:
        near = []
        for b in use:
            if (a[2] or "user") == (b[2] or "user") and a[1] != b[1]:
                x, y = np.array(a[3]), np.array(b[3])
                c = x @ y / np.linalg.norm(x) / np.linalg.norm(y)
                if c >= wanted:
                    near.append((-round(c, 9), b[0]))
        out |= {tuple(sorted((a[0], n))) for _, n in sorted(near)[:k]}
    return out


def vectors(seed=2, n=60):
    rnd = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        base = rnd.normal(size=64)
        for m in range(4):
            rows.append(vec(f"g{g:03d}_{m}", f"f{g}_{m // 2}", base + rnd.normal(size=64) * rnd.choice([0.05, 0.2, 0.35]), corpus=[None, "user", "d"][g % 3]))
    same = rnd.normal(size=64)
    rows += [vec(f"s{i:03d}", f"sf{i // 8}", same) for i in range(60)]  # equal vectors of several files
    rows += [vec(f"t{i:03d}", "one", same * -1) for i in range(9)]  # equal vectors of one file
    rows += [vec("g000_0", "f0_0", rows[0][3], at="2023"), vec("g001_0", "f1_0", None, at="2025", corpus="user"), vec("bad1", "q", [float("nan")] * 64), vec("bad2", "q", [0.0] * 64), vec("bad3", "q", [1.0] * 63),
             vec("bad4", "q", None), vec(None, "q", same), vec("old", "q", same, version="2"), rows[5], rows[5]]
    return rows


def test_similar_vectors_equal_brute_force(spark):
    rows = vectors()
    got = {tuple(r) for r in similar.similar_pairs(similar.similar_vectors(spark.createDataFrame(rows, VEC), wanted=0.9)).collect()}
    want = truth(rows)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_longer_prefixes_and_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    rows = [vec(f"n{i:04d}", f"f{i}", b + rnd.normal(size=64) * 0.05) for i, b in enumerate(np.repeat(rnd.normal(size=(300, 64)), 3, axis=0))]
    crowd = rnd.normal(size=64)
    rows += [vec(f"c{i:04d}", f"cf{i}", crowd + rnd.normal(size=64) * 0.02) for i in range(450)]
    monkeypatch.setattr(similar, "CELL", 5)
    monkeypatch.setattr(similar, "K", 16)
    monkeypatch.setattr(similar, "BLOCK", 40)
    assert similar.bits_of(1350) == 9  # longer than the paths of one book
    got = {tuple(r) for r in similar.similar_pairs(similar.similar_vectors(spark.createDataFrame(rows, VEC), wanted=0.9)).collect()}
    want = truth(rows)
    assert len(got & want) >= 0.9 * len(want)


def test_the_largest_task_does_not_grow_with_near_copies(spark, monkeypatch):
    monkeypatch.setattr(similar, "CELL", 100)
    monkeypatch.setattr(similar, "BLOCK", 100)
    largest = []
    for n in (600, 1200):
        rnd = np.random.default_rng(n)
        crowd = rnd.normal(size=64)
        v = spark.createDataFrame([vec(f"c{i:05d}", f"cf{i}", crowd + rnd.normal(size=64) * 0.001) for i in range(n)], VEC)
        seen = []
        real = similar._search

        def count(model, wanted, top, real=real):
            run = real(model, wanted, top)

            def counted(t):
                out = run(t)
                # one marker row per group tells its size
                return pa.concat_tables([out, pa.table({"a": [f"#{t.num_rows}"], "many": [False], "neighbour": ["x"], "nf": [0], "cosine": [0.0]}, schema=out.schema)])

            return counted

        monkeypatch.setattr(similar, "_search", count)
        got = similar.similar_vectors(v, wanted=0.9).where("id like '#%'").collect()
        monkeypatch.setattr(similar, "_search", real)
        seen = [int(r.id[1:]) for r in got]
        largest.append(max(seen))
    assert max(largest) <= 4 * similar.BLOCK  # up to two blocks of queries and of data each


def test_every_vector_has_its_neighbours_without_a_floor(spark):
    rnd = np.random.default_rng(4)
    rows = [vec(f"v{i:04d}", f"f{i // 3}", rnd.normal(size=64)) for i in range(150)] + [vec(f"e{i:02d}", f"g{i}", np.ones(64)) for i in range(30)]
    v = spark.createDataFrame(rows, VEC)
    got = similar.similar_vectors(v).collect()
    assert Counter(r.id for r in got) == {r[0]: 5 for r in rows}
    assert {(r.id, r.rank): r.cosine for r in got} == pytest.approx(lists(rows), abs=1e-6)
    r = similar.recall(v, part=10).first()
    assert r.queries > 5 and r.recall == 1.0


def lists(rows, k=5):
    out = {}
    x = np.array([r[3] for r in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    for i, r in enumerate(rows):
        near = sorted((-round(x[i] @ x[j], 7), s[0]) for j, s in enumerate(rows) if s[1] != r[1])[:k]
        out |= {(r[0], n + 1): float(-c) for n, (c, _) in enumerate(near)}
    return out


def test_no_vectors(spark):
    assert similar.similar_vectors(spark.createDataFrame([], VEC)).collect() == []
    assert similar.similar_vectors(spark.createDataFrame([vec("a", "b", None)], VEC)).collect() == []


def test_codes_are_better_with_more_books():
    x = np.random.default_rng(1).normal(size=(2000, 32)).astype(np.float32)
    errs = [((x - (c := similar.train(x, m=m, k=32)).decode(c.encode(x)[0])) ** 2).sum(1).mean() for m in (1, 2, 4)]
    assert errs[0] > errs[1] > errs[2]
    c = similar.train(x, m=4, k=32)
    wide = ((x - c.decode(c.encode(x, beam=8)[0])) ** 2).sum()
    assert wide <= ((x - c.decode(c.encode(x, beam=1)[0])) ** 2).sum()


def test_page_number_forms():
    yes = ["3", "- 3 -", "— 3 —", "[3]", "| 3", "p. 3", "Page 3 of 12", "Seite 3/12", "3/12", "पृष्ठ 3/4", "Page l", "Pagc 3", "Page 3 von 4"]
    no = ["2021-04-22.", "1330.0", "report 3", "1. Risks", "twice.", "Next steps", "3 remarks"]
    rnd = random.Random(3)
    model = scans.train_number(["".join(rnd.choice("abcdefghij  ") for _ in range(rnd.randrange(3, 70))).strip() or "ab" for _ in range(300)], rnd)
    judge = lambda x: model.proba(np.array([scans.number_features(x, 3, x.replace("3", "4"), 4)]))[0] >= 0.5
    assert [x for x in yes if not judge(x)] == [] and [x for x in no if judge(x)] == []
