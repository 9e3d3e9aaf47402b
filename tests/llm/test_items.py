"""Packing, mixing, splitting, consensus and scan repair on small inputs."""

import random
import re
from collections import Counter

import pytest

from corvane.llm import consensus, mixing, packing, scans, splitting

DOC = "doc_id bigint, text string, source string, size string, rank string, repeats string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x") for i, t, s in rows], DOC)


def test_patterns_cover_the_histogram():
    rnd = random.Random(1)
    h = Counter(rnd.choice([rnd.randrange(1, 400), rnd.randrange(1, 4097)]) for _ in range(3000))
    plan = packing.plan_patterns(h, 4096)
    got = Counter()
    for pattern, count in plan:
        assert sum(n * t for n, t in pattern) <= 4096
        for n, t in pattern:
            got[n] += t * count
    assert got == h
    bins, total = sum(c for _, c in plan), sum(n * c for n, c in h.items())
    assert bins <= 1.03 * total / 4096 + 1


def test_packing_assigns_every_item_once(spark):
    rnd = random.Random(2)
    texts = [None, "", "é" * 30] + ["x" * rnd.randrange(1, 90) for _ in range(200)] + ["y" * 20] * 150 + ["z" * 1000]
    p = packing.pack(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), 100)
    items = p.items.collect()
    used = Counter()
    for r in items:
        if r.container_id is not None:
            used[r.container_id] += r["size"]
    assert max(used.values()) <= 100 and set(used) == set(range(p.containers))
    sizes = {i: len((t or "").encode()) for i, t in enumerate(texts)}
    got = Counter()
    for r in items:
        got[r.doc_id] += r["size"]
        assert r.start == r.piece * 100
    assert got == Counter(sizes) and {r.doc_id for r in items if r.container_id is None} == {0, 1}
    assert [r.doc_id for r in packing.oversized(p).collect()] == [len(texts) - 1]
    assert packing.pack(docs(spark, []), 100).items.collect() == []


TARGETS = "source string, target_share double, max_repeats int, size string"


def test_mixture_meets_shares_and_caps(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randrange(20, 60), s) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 20 + [None] * 30)] + [(9999, None, "a"), (None, "x", "a")]
    goals = spark.createDataFrame([("a", 0.3, 1, "x"), ("b", 0.4, 2, "x"), ("c", 0.2, 3, "x"), ("d", 0.1, 4, "x")], TARGETS)
    m = mixing.mix_sources(docs(spark, rows), goals)
    used = m.documents.collect()
    cap = {"a": 1, "b": 2, "c": 3}
    assert all(r.repeats <= cap[r.source] for r in used) and len({r.doc_id for r in used}) == len(used)
    assert {r.source for r in mixing.capped_sources(m).collect()} == {"c", "d"}
    plan = mixing.capped_sources(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "xxhash64" in plan  # the answer is read from the realised permutation
    total = sum(len(t) for i, t, s in rows if t and i is not None)
    got = Counter()
    for r in used:
        got[r.source] += r["size"] * r.repeats
    for p in m.plan:
        assert p.budget - 60 <= got[p.source] <= p.budget + 1e-6
    assert got["a"] + got["b"] + got["c"] >= 0.9 * total
    rep = {r.source: r for r in m.report.collect()}
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-4 and rep["d"].used == 0
    assert mixing.passes(m).count() == sum(r.repeats for r in used)


def test_exponent_of_the_whole_plan():
    tokens = {"a": 1000, "b": 1000, "c": 10}
    free = {p.source: p for p in mixing.plan_mixture(tokens, {"a": (0.6, 3), "b": (0.4, 3)}, 2000)}
    assert free["a"].exponent == 0.0 and free["a"].budget == pytest.approx(1200) and free["b"].budget == pytest.approx(800)
    # c is held at its limit; the target of 0.6 / 0.3 for the rest would take a beyond its limit, so the exponent moves towards equal use
    held = {p.source: p for p in mixing.plan_mixture(tokens, {"a": (0.5, 1), "b": (0.25, 2), "c": (0.25, 4)}, 2000)}
    assert held["c"].budget == 40 and 0 < held["a"].exponent < 1 and held["a"].budget == pytest.approx(1000)
    assert held["a"].budget + held["b"].budget == pytest.approx(1960)
    # all limits together are too small: everything is used to its limit
    assert [p.budget for p in mixing.plan_mixture(tokens, {"a": (0.5, 1), "b": (0.5, 1)}, 9000)] == [1000, 1000]


def test_temperature_meets_entropy():
    t = {"a": 1000, "b": 100, "c": 10}
    x = mixing.temperature(t, 1.0)
    assert abs(mixing.entropy(mixing.tempered(t, x).values()) - 1.0) < 1e-6
    assert mixing.tempered(t, 0.0) == pytest.approx(dict.fromkeys("abc", 1 / 3))


def test_mixture_of_nothing(spark):
    m = mixing.mix_sources(docs(spark, []), spark.createDataFrame([], TARGETS))
    assert m.documents.collect() == [] and m.report.collect() == []


def prose(rnd, n):
    out = []
    while n > 0:
        s = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(4, 15))) + rnd.choice([". ", ", ", ".\n", ".\n\n"])
        out.append(s)
        n -= len(s)
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_pieces_respect_limits(seed):
    rnd = random.Random(seed)
    for text in [prose(rnd, n) for n in (10, 790, 801, 5000, 20000)] + ["x" * 5000, "word " * 900, "q" * 300 + " " + "r" * 900, "  \n a  b \n"]:
        flat = splitting.collapse(text)[0]
        assert flat == " ".join(text.split())
        pieces = splitting.split_text(text, 800, 80, 160)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(flat)
        for (a0, a1), (b0, b1) in zip(pieces, pieces[1:]):
            assert b1 - b0 <= 800 and a1 - a0 <= 800 and 80 <= a1 - b0 <= 160 and b0 > a0
        assert all(splitting._cut_ok(flat, flat[a:b])[0] for a, b in pieces)
    assert splitting.split_text("", 800, 80, 160) == []


def test_audit_names_faulty_pieces(spark):
    rnd = random.Random(8)
    text = prose(rnd, 5000)
    flat = " ".join(text.split())
    at = splitting.split_text(text, 800, 80, 160)
    at[1] = (at[1][0], at[1][1] - 3)  # ends inside a word
    at[3] = (at[3][0], at[3][0] + 850)  # too long
    assert not splitting._cut_ok(flat, flat[at[1][0] : at[1][1]])[0]
    bad = [("f", i, flat[a:b]) for i, (a, b) in enumerate(at)]
    want = {1, 3} | {i for i in range(1, len(bad)) if not 80 <= splitting.longest_overlap(bad[i - 1][2], bad[i][2], 80, 160) <= 160} | {i for i, p in enumerate(bad) if not splitting._cut_ok(flat, p[2])[0]}
    long = [("g", i, "a" * 100 + f" {i:05d} " + "b" * 100) for i in range(140)]
    rows = [r + ("x", "x") for r in bad + bad[:2] + [(None, 0, "t"), ("h", None, "t"), ("h", 0, None)] + long]
    pieces = spark.createDataFrame(rows, "file_id string, idx int, text string, prev string, flat string")
    d = spark.createDataFrame([("f", text, "x"), ("f", "another", "x"), (None, "q", "x"), ("z", None, "x")], "id string, text string, flat string")
    got = {tuple(r) for r in splitting.faulty_pieces(splitting.audit_pieces(pieces, d)).collect()}
    assert {i for f, i in got if f == "f"} == want and {1, 3, 4} <= want < set(range(len(bad)))
    assert {i for f, i in got if f == "g"} == set(range(1, 140)) and ("h", 0) not in got
    assert splitting.audit_pieces(pieces.limit(0), d).collect() == []


def test_splitting_in_spark(spark):
    d = docs(spark, [(1, "short text", "s"), (2, None, "s"), (3, " ", "s"), (4, "word " * 1000, "s")])
    got = splitting.split_documents(d).collect()
    assert {r.doc_id for r in got} == {1, 4} and all(len(r.text) <= 800 for r in got)


FILE = "id string, name string, mime_type string, size bigint, modified_time string, created_time string, category string, folder_id string, is_offline boolean, content_hash string, content_hash_modified_time string, tags array<string>, semantic_summary string, starred boolean, listed_at timestamp, dup_key string, score string"


def file(i, name, size=10, starred=None, h=None, rev="2024-01-01T00:00:00Z", summary=None, mime=None, tags=None, created="2023-01-01T00:00:00Z", hrev=None):
    return (i, name, mime, size, rev, created, "other", None, None, h, hrev, tags, summary, starred, None, "x", "x")


def test_best_representative(spark):
    rows = [file("a", "Report.txt", starred=True, tags=["x"]), file("b", "report.txt", mime="text/plain", tags=["y", None]), file("b", "report.txt", mime="text/plain", tags=["y"]),
            file("c", "one alpha beta gamma", h="opaque", summary="the quick brown fox"), file("d", "one alpha beta delta", h="opaque", summary="the quick brown fox jumps"), file("e", "one alpha beta gamma (copy)", h="opaque", summary=None),
            file("f", "lonely", size=None), file("g", "lonely", size=0), file(None, "Report.txt"), file("h", None, size=7, created=None), file("i", None, size=7, created=None),
            file("j", "n1", h="sha256:1", hrev="2024-01-01T00:00:00Z"), file("k", "n2", h="sha256:1", hrev="2024-01-01T00:00:00Z"), file("l", "n3", h="sha256:1", hrev="old")]
    got = {r.keep_id: r for r in consensus.best_representatives(spark.createDataFrame(rows, FILE)).collect()}
    assert set(got) == {"a", "d", "h", "j"}
    assert got["a"].mime_type == "text/plain" and got["a"].starred and got["a"].group_size == 2 and got["a"].tags == ["x", "y"]
    assert got["d"].name == "one alpha beta gamma" and got["d"].semantic_summary.startswith("the quick brown fox") and got["d"].group_size == 3
    assert got["h"].name is None and got["h"].keep_score > 0
    assert consensus.best_representatives(spark.createDataFrame([], FILE)).collect() == []


def test_consensus_of_a_large_group(spark):
    rnd = random.Random(4)
    base = "quarterly budget overview for the northern office"
    values = set()
    for _ in range(300):
        w = base.split()
        w[rnd.randrange(len(w))] = f"z{rnd.randrange(999)}"
        values.add(" ".join(w))
    values = sorted(values) + [base]
    votes = spark.createDataFrame([("k", "name", v, 1.0) for v in values] + [("k", "name", None, 9.0)], "dup_key string, field string, value string, weight double")
    assert [r.value for r in consensus.consensus_values(votes).collect()] == [base]


VOTES = "dup_key string, field string, value string, weight double"


def test_tokens_compete_within_a_column(spark):
    rows = [("k", "name", f"report {w} final", n) for w, n in (("colour", 4.0), ("color", 3.0), ("kolor", 3.0))]
    rows += [("g", "name", v, 1.0) for v in ("a b c", "a x b c", "a y b c", "a x d c")]  # gap, x, y and x in the second column
    assert {r.dup_key: r.value for r in consensus.consensus_values(spark.createDataFrame(rows, VOTES)).collect()} == {"k": "report colour final", "g": "a x b c"}
    col = [[{"report": 7.0}, {"colour": 4.0, "color": 3.0}, {"final": 7.0}], [{"report": 3.0}, {"kolor": 3.0}, {"final": 3.0}]]
    assert [len(c) for c in consensus.align(col[0], 7.0, col[1], 3.0)] == [1, 3, 1]


def test_a_narrow_majority_among_many_tokens_wins(spark):
    rows = [("k", "name", f"plan t{i} end", 1.0) for i in range(199)] + [("k", "name", "plan one end", 100.0), ("k", "name", "plan one end of it", 1.0), ("k", "name", "plan t7 end", 0.5)]
    assert [r.value for r in consensus.consensus_values(spark.createDataFrame(rows, VOTES)).collect()] == ["plan one end"]


def test_alignment_is_the_same_in_halves(monkeypatch):
    rnd = random.Random(6)
    base = [rnd.choice("abcdefgh") for _ in range(60)]
    other = [t for t in base if rnd.random() > 0.2]
    p, q = [{t: 1.0} for t in base], [{t: 1.0} for t in other]

    def score(pairs):
        s = consensus._Scores(p, 1.0, q, 1.0)
        return sum(s.row(i)[j] for i, j in pairs) - consensus.GAP * (len(p) + len(q) - 2 * len(pairs))

    whole = score(consensus.matches(p, 1.0, q, 1.0))
    monkeypatch.setattr(consensus, "CELLS", 20)
    assert score(consensus.matches(p, 1.0, q, 1.0)) == pytest.approx(whole)
    # edit distance against the textbook recurrence
    a, b = base[:25], other[5:40]
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
    assert consensus.token_distance(a, b) == d[-1] / len(b)


def scan(pages):
    return "\n\n".join(f"[Page {n}]\n{p}" for n, p in pages)


def test_scan_furniture_and_breaks(spark):
    rnd = random.Random(6)
    vocab = sorted({"".join(rnd.choice(["ba", "ke", "li", "mo", "nu", "sta", "tri", "ver"]) for _ in range(rnd.randrange(2, 5))) for _ in range(160)} - {""})
    line = lambda n=9: " ".join(rnd.choice(vocab) for _ in range(n))
    clean = [(i, "text/plain", "\n".join(line() for _ in range(12)), "x") for i in range(120)]
    long = max(vocab, key=len)
    body = lambda: "\n".join(line() for _ in range(5))
    pages = [(n, f"ANNUAL REVIEW {n}\n{body()}\nx {long[:3]}-\n{long[3:]} {line(3)}\n- {n} -") for n in (1, 2, 3)]
    pages[1] = (2, pages[1][1].replace("REVIEW", "REVlEW"))
    bad = next(w for w in vocab if "m" in w and len(w) > 5).replace("m", "rn", 1)
    rows = clean + [(900, "application/pdf", scan(pages), "x"), (901, "image/png", f"{line()}\n{line(4)} {bad} {line(2)}\n{line()}", "x"), (902, "image/png", None, "x"), (903, "image/png", " ", "x"), (904, "text/plain", None, "x"), (None, "image/png", "a", "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, mime_type string, text string, kind string")
    got = {tuple(r) for r in scans.scan_noise(d).collect()}
    assert {(900, n, k) for n in (1, 2, 3) for k in ("header", "page_number", "hyphen")} <= got
    assert (901, 1, "misread") in got and not any(r[0] in (902, 903, 904, 0) for r in got)
    fixed = {r.doc_id: r.text for r in scans.repair_scans(d).collect()}
    assert long in fixed[900] and "REV" not in fixed[900] and not re.search(r"- \d -|\[Page", fixed[900]) and bad not in fixed[901] and fixed[903] == ""


def test_no_scans(spark):
    d = spark.createDataFrame([], "doc_id bigint, mime_type string, text string")
    assert scans.scan_noise(d).collect() == []
