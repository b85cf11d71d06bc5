"""Jaccard join, vectors and lines against plain loops."""

import random

import brute
import numpy as np
import pytest
from conftest import ODD

from vigilog.llm import jaccard, lines, vectors
from vigilog.llm.common import Scratch, components


def _near_docs(seed, groups, copies, words, changes):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, number = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(changes + 1)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((number, " ".join(text)))
            number += 1
    return rows


def _found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_agrees_with_all_pairs(spark, k, percent):
    rows = _near_docs(1, 12, 6, 60, 6) + [(1000 + i, t) for i, t in _near_docs(2, 10, 3, 11, 2)]
    rows += [(2000, None), (2001, ""), (2002, "solo"), (2003, "Solo"), (2004, "a b"), (2005, "a b c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _found(jaccard.join(df, k, percent)) == brute.jaccard(rows, k, percent)


def test_jaccard_cuts_large_regions(spark, monkeypatch):
    """A shared opening makes one region of all; small limits force cells of document pivots."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "RARE", 10**9)
    rows = _near_docs(3, 8, 8, 30, 3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _found(jaccard.join(df, 3, 80)) == brute.jaccard(rows, 3, 80)
    hot = [(i, "all of these begin alike " + t) for i, t in rows]
    df = spark.createDataFrame(hot, "doc_id bigint, text string")
    assert _found(jaccard.join(df, 2, 60)) == brute.jaccard(hot, 2, 60)


def test_jaccard_odd_rows(odd_docs):
    got = jaccard.join(odd_docs(ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0
    assert by_id[6].component_id == 5 and by_id[8].component_id == 7
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["5", "None"]
    assert jaccard.join(odd_docs([])).collect() == []


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        both, x, y = (rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64) for _ in range(3))
        a, b = np.unique(np.concatenate([both, x])), np.unique(np.concatenate([both, y]))
        bits = sum(int(v).bit_count() for v in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain(spark):
    ids = list(range(300))
    random.Random(5).shuffle(ids)
    edges = list(zip(ids, ids[1:], strict=False)) + [(900, 901), (901, 902), (903, 903)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(300)} | {900: 900, 901: 900, 902: 900}


def _vectors(seed=3, groups=20, copies=12, dims=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dims)
        for _ in range(copies):
            x = base + rng.standard_normal(dims) * rng.choice([0, 0.1, 0.2, 0.25])
            rows.append((len(rows), [float(v) for v in x.astype(np.float32)]))
    return rows


def test_vectors_recall_and_no_false_link(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 5)  # crowded cells are cut into blocks
    rows = _vectors()
    x = np.array([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= vectors.COSINE
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in vectors.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert all(got[i].n_links <= near[i].sum() for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * near.sum()
    want = brute.smallest_reachable(list(got), [tuple(map(int, p)) for p in np.argwhere(np.triu(near))])
    assert sum(want[i] != got[i].component_id for i in got) <= 0.03 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_odd_rows(spark):
    v, nan = [1.0, 2.0, 3.0], float("nan")
    rows = [(5, v), (3, v), (3, v), (None, v), (7, None), (8, [0.0, 0.0, 0.0]), (9, [1.0, None, 2.0]), (10, [nan, 1.0, 1.0]),
            (11, []), (12, [float("inf"), 0.0, 1.0]), (13, [1.0, 2.0]), (14, [2.0, 4.0, 6.0]), (15, [1e-200, 2e-200, 3e-200])]
    got = sorted(map(tuple, vectors.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()), key=str)
    want = [(5, 4, 3, False), (3, 4, 3, True), (3, 4, 3, True), (None, 0, None, False), (14, 4, 3, False), (15, 4, 3, False)]
    want += [(i, 0, i, True) for i in (7, 8, 9, 10, 11, 12, 13)]
    assert got == sorted(want, key=str)
    assert vectors.link(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_required_collisions_follow_the_wanted_recall():
    assert vectors.least_collisions(0.95, 0.9999999) == 1
    assert vectors.least_collisions(0.95, 0.9) >= vectors.least_collisions(0.95, 0.97) >= 1
    assert vectors.collision_rate(0.99) > vectors.collision_rate(0.95) > vectors.collision_rate(0.5)


def _like_lines(rows):
    """{(doc, pos)} that go, by all pairs of lines."""
    import re

    import xxhash

    def norm(line):
        return re.sub(r"[\W_]+", " ", line.lower()).strip()

    def simhash(words):
        hashes = [xxhash.xxh64_intdigest(w, seed=42) for w in words]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    places = {}
    for doc, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            words = norm(line).split()
            if len(words) >= lines.LEAST_WORDS:
                places.setdefault(" ".join(words), []).append((doc, pos))
    names = list(places)
    sims = [simhash(n.split()) for n in names]
    links = []
    for i, x in enumerate(names):
        for j in range(i):
            y, most = names[j], max(len(x), len(names[j]))
            if (sims[i] ^ sims[j]).bit_count() <= lines.BITS and min(len(x), len(y)) >= most * lines.SIMILARITY:
                if distance(x, y) <= most * (1 - lines.SIMILARITY) + 1e-9:
                    links.append((i, j))
    label = brute.smallest_reachable(range(len(names)), links)
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(label[i], []).extend(places[n])
    return {p for g in groups.values() for p in g if p != min(g)}, len(links)


def test_lines_agree_with_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lines, "SMALL", 2)
    monkeypatch.setattr(lines, "HEADS", 2)
    rng = random.Random(4)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "nu", "xi", "pi", "rho", "tau"]) + str(rng.randrange(9)) for _ in range(24)) for _ in range(12)]
    rows = []
    for doc in range(40):
        text = []
        for _ in range(4):
            words = rng.choice(base).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] += rng.choice(["s", ".", ",", "A"])
            text.append(rng.choice(["", "short line", " ".join(words).capitalize()]) if rng.random() < 0.3 else " ".join(words))
        rows.append((doc, "\n".join(text)))
    gone, links = _like_lines(rows)
    assert links > 10
    got = lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, p) for r in got for p in r.removed} == gone
    for r in got:
        text = dict(rows)[r.doc_id].split("\n")
        assert r.n_lines == len(text) and r.n_removed == len(r.removed)
        assert r.text == "\n".join(x for p, x in enumerate(text) if p not in r.removed)


def test_lines_odd_rows(odd_docs):
    rows = ODD + [(20, "a line of five words\n\nA line, of FIVE words!\ntail"), (None, "a line of five words")]
    got = lines.dedup(odd_docs(rows))
    assert "rank" in got.columns
    got = got.collect()
    assert len(got) == len(rows)
    by_text = {r.doc_id: r for r in got}
    assert by_text[8].removed == [0] and by_text[7].removed == []
    assert by_text[1].text is None and by_text[1].n_lines == 0 and by_text[2].n_lines == 1
    assert by_text[20].removed == [2] and by_text[20].text == "a line of five words\n\ntail"
    assert [r.removed for r in got if r.doc_id == 6] == [[0], [0]] and by_text[5].removed == []
    assert sorted(str(r.removed) for r in got if r.doc_id is None) == ["[0]", "[0]", "[]"]
    assert lines.dedup(odd_docs([])).collect() == []


def _edited(rng, line, share):
    """A line with a share of its characters replaced, dropped or preceded by another."""
    out = list(line)
    for i in rng.sample(range(len(out)), round(share * len(out))):
        new = rng.choice("abcdefghijklmnopqrstuvwxyz")
        out[i] = rng.choice([new, "", new + out[i]])
    return "".join(out)


def test_lines_recall_against_edit_similarity(spark):
    """Ordinary lines, any similarity from 0.8 up alike: at least 0.9 of the pairs, and no other."""
    import duckdb

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    texts = []
    for _ in range(300):
        line = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 20)))
        texts += [line, _edited(rng, line, rng.uniform(0.01, 0.22))]
    con = duckdb.connect()
    con.execute("CREATE TABLE l (id INT, t VARCHAR)")
    con.executemany("INSERT INTO l VALUES (?, ?)", [(i, " ".join(t.split())) for i, t in enumerate(texts)])
    pairs = con.execute("""SELECT x.id, y.id FROM l x JOIN l y ON x.id < y.id
        WHERE levenshtein(x.t, y.t) <= 0.2 * greatest(length(x.t), length(y.t)) + 1e-9""").fetchall()
    got = lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    gone = {r.doc_id for r in got if r.removed}
    assert len(pairs) > 200 and gone <= {y for _, y in pairs}
    recall = sum(y in gone for _, y in pairs) / len(pairs)
    print("recall", round(recall, 3), "of", len(pairs))
    assert recall >= 0.9


def test_lines_recall_of_longer_lines(spark):
    """Lines of 20-60 and of 60-150 words with 10-19 % of their characters edited: at least 0.9, and no other."""
    import duckdb

    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    texts = []
    for least, most in [(20, 60)] * 60 + [(60, 150)] * 60:
        line = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(least, most)))
        texts += [line, _edited(rng, line, rng.uniform(0.10, 0.19))]
    con = duckdb.connect()
    like = [con.execute("SELECT levenshtein($1, $2) <= 0.2 * greatest(length($1), length($2))", [" ".join(t.split()) for t in texts[i:i + 2]]).fetchone()[0]
            for i in range(0, len(texts), 2)]
    want = {2 * i + 1 for i, ok in enumerate(like) if ok}
    gone = {r.doc_id for r in lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect() if r.removed}
    for part in (range(120), range(120, 240)):
        there = want.intersection(part)
        print("recall", round(len(gone & there) / len(there), 3), "of", len(there))
        assert len(there) > 40 and len(gone & there) >= 0.9 * len(there)
    assert gone <= want


def test_lines_that_share_nothing_keep_no_rows(spark):
    """What is kept for comparing grows with the pieces that lines share, not with the lines."""
    rng = random.Random(14)
    text = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randint(20, 90))) for _ in range(100)]
    found = lines.occurrences(spark.createDataFrame([(1, "\n".join(text)), (2, text[0])], "doc_id bigint, text string"))
    assert lines.spots(found).count() <= 5


def test_lines_give_few_pieces(spark):
    """What is shuffled for comparing is about a dozen rows a line, also of lines of 60 to 96 characters."""
    rng = random.Random(15)
    text = [" ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(15)) for _ in range(200)]
    found = lines.occurrences(spark.createDataFrame([(1, "\n".join(text))], "doc_id bigint, text string"))
    seen = lines.pieces(found).groupBy("node").count().agg({"count": "avg", "node": "count"}).first()
    assert seen["count(node)"] == 200 and 8 <= seen["avg(count)"] <= 16


def test_lines_with_words_more_or_less_are_like(spark):
    """Words that are added, left out or replaced are edits like others; one edit too many is refused."""
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60)]
    more, less, other = ["extra", "words", *words, "added"], words[:20] + words[23:50] + words[52:], list(words)
    other[10:14] = ["zzzzz"] * 4
    far = [w if i % 4 else "zzzzz" for i, w in enumerate(words)]  # 75 of 359 characters, where 71 may be
    rows = [(i, " ".join(x)) for i, x in enumerate((words, more, less, other, far))]
    got = {r.doc_id: r.removed for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: [], 1: [0], 2: [0], 3: [0], 4: []}


def test_short_and_long_lines_take_part(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    long, short = list(words), ["All rights reserved", "\u6f22\u5b57\u6f22\u5b57\u6f22", "Menu", "Privacy policies"]
    for i in range(0, 500, 25):
        long[i] += "z"
    rows = [(1, "\n".join([*short, " ".join(words)])), (2, "\n".join(["all rights reserved!", short[1], "", "MENU", "privacy policy is", " ".join(long)]))]
    got = {r.doc_id: r.removed for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: [], 2: [0, 1, 3, 4, 5]}


def test_like_lines_meet_in_company(spark):
    """A pair that only shares short pieces is found however many other lines share them too."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    pairs, crowd = [], []
    for _ in range(4):
        words = [word() for _ in range(30)]
        pairs += [" ".join(words), " ".join(w if i % 2 else "z" + w[1:] for i, w in enumerate(words))]
        crowd += [" ".join(w if i % 2 and rng.random() < 0.3 else word() for i, w in enumerate(words)) for _ in range(60)]

    def gone(texts):
        return {r.doc_id for r in lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect() if r.removed}

    assert gone(pairs) == {1, 3, 5, 7}
    assert gone(pairs + crowd) == {1, 3, 5, 7}
