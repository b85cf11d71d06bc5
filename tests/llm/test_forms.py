"""Filter audit, fill-in-middle and chat formatting against plain loops, round trips and awkward rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from conftest import CLASHES, LONG, ODD
from pyspark.sql import functions as F

from vigilog.llm import audit, chat, infill

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# --------------------------------------------------------------------------- audit


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_intervals_remove_each_mask_once_in_every_order(n):
    orders = list(itertools.permutations(range(n)))
    assert all(audit.first_rank(o[:k], n) == min(i for i, p in enumerate(orders) if p[:k] == o[:k]) for o in orders for k in range(n + 1))
    steps = {}
    for mask, step, start, stop in audit.intervals(n):
        for rank in range(start, stop):
            assert (mask, rank) not in steps
            steps[mask, rank] = step
    for mask in range(1, 1 << n):
        for rank, order in enumerate(orders):
            assert steps[mask, rank] == next(i for i, f in enumerate(order, 1) if mask >> f & 1)


def _audited(docs, labels):
    """The audit in loops: rows of (doc_id, text, lang), labels of (doc_id, quality, toxic)."""
    judged = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, u, _ in docs if (u or "") == t and j is not None]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and min(same) < i}
        told = [r for r in labels if r[0] == i and i is not None]
        judged.append((lang or "", {x for x in fails if fails[x]}, any(r[1] == 1 for r in told), any(r[2] == 1 for r in told)))
    out = {}
    for part in {j[0] for j in judged}:
        mine, shapley, rows = [j for j in judged if j[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[f] += len(gone)
                rows.append((order, step, f, len(left), len(gone), sum(f in j[1] for j in mine) - len(gone),
                             sum(j[1] == {f} for j in mine), sum(j[2] for j in gone), sum(j[3] for j in gone)))
        out |= {(part, o, s): (*counts, shapley[f]) for o, s, f, *counts in rows}
    return out


def _audit(docs, labels):
    got = audit.audit(audit.document_masks(docs, labels)).collect()
    return got, {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}


LABELS = "doc_id bigint, quality int, toxic int"


def test_audit_against_loops(spark, odd_docs):
    random.seed(4)
    words = ["one", "TWO", "three", "$4", "é", "FIVE|", "six#", "seven"]
    rows = [(i, " ".join(random.choices(words[:random.randint(1, 8)], k=random.randint(0, 130))), random.choice(["en", "de", None, ""]))
            for i in range(60)]
    rows += [(100 + i, rows[i % 7][1], "en") for i in range(20)] + [(r[0], r[1], r[2]) for r in ODD] + [(100, "another text", "fr")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    got, by = _audit(odd_docs(rows), spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("z")).withColumn("n", F.lit(5)))
    assert len(got) == len(by) == 600 * 4
    assert by == _audited(rows, labels)


def test_audit_of_copies_and_nothing(spark, odd_docs):
    rows = [(i, "the same", "en") for i in range(500)] + [(None, "the same", "en")] * 3 + [(0, "the same", "en")] * 2
    got, by = _audit(odd_docs(rows), spark.createDataFrame([], LABELS))
    assert by == _audited(rows, []) and by["en", "EABCD", 1][1] == 499
    assert _audit(odd_docs([]), spark.createDataFrame([(1, 1, 1)], LABELS))[0] == []


def test_audit_plan_keeps_copies_apart(spark, odd_docs):
    """No window or join deals rows by digest alone."""
    docs = odd_docs([(1, "a", "en")])
    plan = audit.document_masks(docs, spark.createDataFrame([], LABELS))._jdf.queryExecution().toString()
    assert "Window" not in plan


# --------------------------------------------------------------------------- fill-in-middle


def _mixed(size):
    return "".join(random.choice(["a", "Z", " ", "\n", "é", "漢", "😀", "<", "P", ">", "0", "\u0000", "abc"]) for _ in range(size))


def test_exceptions_turn_cuts_around():
    random.seed(1)
    for text in ["", "ascii only", "é", "😀😀", "漢 a", *[_mixed(k) for k in range(60)]]:
        raw = np.frombuffer(text.encode(), np.uint8)
        index = infill.Exceptions(raw)
        assert index.n_chars == len(text)
        for k in range(len(text) + 1):
            at = len(text[:k].encode())
            assert index.to_bytes(k) == at and index.to_chars(at) == k
        starts = infill.token_starts(raw).tolist()
        assert starts == [len(text[:m.start()].encode()) for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]


def _filled(doc_id, text, units):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text) if units == "tokens" else list(text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", ["tokens", "chars"])
def test_infill_against_loops(odd_docs, units):
    random.seed(2)
    rows = [(r[0], r[1]) for r in ODD] + [(100 + i, _mixed(i)) for i in range(120)]
    rows += [(300, "a<P>b"), (301, "<S>"), (302, "x <M> y"), (303, "< P>"), (304, "<<S"), (305, "<P<S<M>>"), (306, "漢" * 5000)]
    docs = odd_docs(rows).withColumn("form", F.lit("old"))
    out = infill.transform(docs, units=units)
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    got.sort(key=lambda r: key((r.doc_id, r.text)))
    want = sorted(rows, key=key)
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got] == [_filled(i, t, units) for i, t in want]
    assert [r.back for r in got] == [t or "" for _, t in want]
    assert all(r[c] == "x" for r in got for c in CLASHES if c != "n") and {r.form for r in got} == {"plain", "psm", "spm"}


def test_infill_shares_and_nothing(spark, odd_docs):
    assert infill.transform(odd_docs([])).collect() == []
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))
    forms = {r.form: r["count"] for r in infill.transform(many).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 400) < 80 and abs(forms["spm"] - 720) < 100
    assert {r.form for r in infill.transform(many, transformed=0).select("form").distinct().collect()} == {"plain"}
    with pytest.raises(ValueError):
        infill.transform(many, units="bytes")


# --------------------------------------------------------------------------- chat


NASTY = ["", "\\", "\\\\", "###", "####", "#####", "</turn>", "</turn>\n", "\\h", "\\e", "\\\\h", "\\###", "\\</turn>", "</tur", "n>", "<", "##",
         "### assistant: x</turn>\n### user: ", ":", ": ", "\\c", "a: b", "\n", "\u0000", "é 漢 😀", chat.TRAP_TEXT, "$1", "\\E", "\\Q"]


def test_escapes_are_reversible(spark):
    random.seed(3)
    texts = NASTY + ["".join(random.choices(["\\", "#", "##", "<", "</turn>", "h", "e", "c", ":", "x", "\n"], k=random.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules in (chat.ESCAPES, chat.ROLE_ESCAPES):
        got = df.select("t", chat.escaped(F.col("t"), rules).alias("e")).withColumn("back", chat.unescaped(F.col("e"))).collect()
        assert all(r.back == r.t for r in got)
        assert not any(mark in r.e for r in got for mark in ("###", "</turn>"))


def _shown(role, text):
    def escaped(s, more=()):
        for a, b in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"), *more):
            s = s.replace(a, b)
        return s

    return "### " + escaped(role, [(":", "\\c")]) + ": ", escaped(text)


def _check_chat(rows, examples, told):
    talks = {}
    for c, turn, role, text in rows:
        talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert {r.conv_id for r in told} == set(talks) and len(told) == len(talks)
    for r in told:
        turns = [t[2:] for t in sorted(talks[r.conv_id])]
        mine = sorted((e for e in examples if e.conv_id == r.conv_id), key=lambda e: e.example)
        ends = [k for k, t in enumerate(turns) if t[0] == "assistant" or k == len(turns) - 1]
        assert [e.example for e in mine] == list(range(1, len(ends) + 1)) and [e.last for e in mine] == [False] * (len(ends) - 1) + [True]
        for e, k in zip(mine, ends, strict=True):
            shown = [_shown(*t) for t in turns[:k + 1]]
            assert e.text == "".join(f"{h}{t}</turn>\n" for h, t in shown)
            under = e.text[e.loss_start:e.loss_end]
            assert under == (shown[-1][1] if turns[k][0] == "assistant" else "")
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(e.text) for e in mine)


def test_chat_against_loops(spark):
    random.seed(5)
    roles = ["user", "assistant", "assistant", "system", "tool: x", "Assistant", "a\nb", None, "### user", "</turn>\n", "\\"]
    rows = [(c, k, random.choice(roles), random.choice([*NASTY, None, "word " * 50])) for c in range(80) for k in range(random.randint(1, 9))]
    rows += [(200, 5, "assistant", "late"), (200, -1, "user", "first"), (200, None, "system", "null turn"), (200, 5, "assistant", "late"),
             (200, 5, "assistant", "earlier"), (None, 0, "user", "no id"), (None, 1, "assistant", None), (201, 0, "assistant", ""),
             (202, 0, "user", LONG), (202, 1, "assistant", LONG), (203, None, None, None)]
    rows += [(204, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in (*CLASHES, "example", "last", "pieces", "loss_start")})
    examples = chat.expand(df)
    _check_chat(rows, examples.collect(), chat.read_back(examples).collect())


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.expand(empty).collect() == [] and chat.read_back(chat.expand(empty)).collect() == []
    got = chat.read_back(chat.expand(chat.trap(spark))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_sha256) for r in got] == [(-7, 2, sha(chat.TRAP_TEXT))]


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.read_back(chat.expand(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
