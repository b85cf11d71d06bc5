"""Rule evaluation against plain loops, and each documented corner of it."""

import random
from collections import Counter, defaultdict

import pytest

from vigilog import RuleSet, load_rules
from vigilog.operators import detect as det
from vigilog.operators import findings as fnd
from vigilog.plans.analysis import find_matches
from vigilog.session import stored


def rule(kind="pattern", patterns=(), service="*", **more):
    detection = {"type": kind, **more.pop("detection", {})}
    if kind == "sequence":
        detection.setdefault("steps", [{"regex": p} for p in patterns])
    else:
        detection["patterns"] = [{"regex": p} for p in patterns]
    return {"id": "X", "severity": "high", "confidence": "high", "service": service, "detection": detection, **more}


def threshold(patterns, field="src_ip", count=3, window=60, spelling="window_seconds", **more):
    agg = {"field": field, "count": count, spelling: window}
    return rule("threshold", patterns, detection={"aggregation": agg}, **more)


def rules(compat=False, **named):
    return RuleSet.from_dicts(named, compat)


# --------------------------------------------------------------------------- loading


def test_load_rules(tmp_path):
    (tmp_path / "a").mkdir()
    good = "id: A\nservice: sshd\ndetection: {type: pattern, patterns: [{regex: 'x'}, {regex: '('}]}\n"
    (tmp_path / "a" / "one.yaml").write_text(good)
    (tmp_path / "two.yml").write_text("id: B\ndetection: {type: threshold, patterns: [{regex: y}], aggregation: {count: 4, window_sec: 9}}\n")
    (tmp_path / "bad.yaml").write_text('id: C\ndetection: {patterns: [{regex: "\\."}]}\n')
    (tmp_path / "noid.yaml").write_text("title: none\n")
    (tmp_path / "odd.yaml").write_text("id: D\ndetection: {type: other}\n")
    loaded = load_rules(tmp_path)
    assert [r.path for r in loaded.rules] == ["a/one.yaml", "two.yml"]
    assert loaded.rules[1].window_seconds == 9 and loaded.rules[1].count == 4
    assert sorted((e[0], e[1]) for e in loaded.errors) == [
        ("a/one.yaml", 1), ("bad.yaml", None), ("noid.yaml", None), ("odd.yaml", None),
    ]
    old = load_rules(tmp_path, compat=True)
    assert [r.path for r in old.rules] == ["a/one.yaml"]


def test_window_spellings():
    assert rules(t=threshold(["x"], spelling="window_sec", window=7)).rules[0].window_seconds == 7
    assert rules(True, t=threshold(["x"], spelling="window_sec", window=7)).rules[0].window_seconds == 300
    readme = rule("sequence", detection={"patterns": [{"regex": "a"}, {"regex": "b"}], "steps": [], "aggregation": {"window_sec": 5}})
    assert len(rules(s=readme).rules[0].steps) == 2 and rules(s=readme).rules[0].within_seconds == 5
    assert rules(True, s=readme).active() == []


def test_rule_table(spark):
    table = rules(t=threshold(["(?P<src_ip>x)"])).dataframe(spark).first()
    assert table.agg["count"] == 3 and table.patterns[0].groups == {"src_ip": 1}
    errors = rules(t={"title": "x"}).errors_dataframe(spark)
    assert errors.count() == 1


# --------------------------------------------------------------------------- search


def found(hits):
    return sorted((r.rule_path, r.line_no, r.pattern_idx) for r in hits.collect())


def test_first_pattern_wins_and_captures(make_logs):
    logs = make_logs([
        (1, "sshd", "user=bob from 1.2.3.4"), (2, "sshd", "FROM 9.9.9.9", {"src_ip": "8.8.8.8", "uri": ""}),
        (3, "cron", "nothing"),
    ])
    rs = rules(a=rule(patterns=[r"user=(?P<user>\w+)", r"from (?P<src_ip>[\d.]+)(?P<port>:\d+)?"]))
    got = {r.line_no: r for r in det.detect_pattern(logs, rs).collect()}
    assert sorted(got) == [1, 2]
    assert got[1].pattern_idx == 0 and got[1].captured == {"user": "bob"}
    assert got[2].pattern_idx == 1 and got[2].captured == {"src_ip": "8.8.8.8", "port": None}


def test_scope(make_logs):
    logs = make_logs([(1, "my-SSHD-2", "x"), (2, "cron", "x")])
    rs = rules(
        any=rule(patterns=["x"]), ssh=rule(patterns=["x"], service="sshd"),
        linux=rule(patterns=["x"], service="linux"), audit=rule(patterns=["x"], service="auditd"),
        off=rule(patterns=["x"], enabled=False),
    )
    expected = {("any", 1), ("any", 2), ("ssh", 1), ("linux", 1), ("linux", 2)}
    assert {(p, n) for p, n, _ in found(det.detect_pattern(logs, rs))} == expected
    pairs = {(r.service, r.rule_path) for r in det.scope(logs, rs).collect()}
    assert pairs == {("my-SSHD-2", "any"), ("cron", "any"), ("my-SSHD-2", "ssh"), ("my-SSHD-2", "linux"), ("cron", "linux")}
    old = {(r.service, r.rule_path) for r in det.scope(logs, rs, compat=True).collect()}
    assert old == {("my-SSHD-2", "any"), ("cron", "any"), ("my-SSHD-2", "ssh")}


def test_access_lines_are_searched_whole(spark, make_logs):
    from pyspark.sql import functions as F

    logs = make_logs([(1, "nginx", "GET / HTTP/1.1 -> 200")]).select("*").withColumn(
        "format", F.lit("access")).withColumn("raw", F.lit('1.2.3.4 - - "GET / HTTP/1.1" 200 "sqlmap"'))
    rs = rules(a=rule(patterns=["sqlmap"]), b=rule(patterns=["-> 200"]))
    assert [p for p, *_ in found(det.detect_pattern(logs, rs))] == ["a", "b"]
    assert [p for p, *_ in found(det.detect_pattern(logs, rs, match_on="message"))] == ["b"]


def test_prefilter_changes_nothing(make_logs):
    rng = random.Random(5)
    words = ["Failed", "password", "for", "root", "GET", "/etc/passwd", "../", '"', "select", "union", "ſh", "nc", "-e", "{ :;}", "404"]
    logs = make_logs([(i, "s", " ".join(rng.choices(words, k=6))) for i in range(400)])
    named = {
        f"r{i}": rule(patterns=p) for i, p in enumerate([
            ["failed (?:password|key)", "union.*select"], [r"\{\s*:;\s*\}", r"\bnc\b.*-e|ncat"],
            [r"(?:\.\./)+", r"/etc/(?:passwd|shadow)"], ["sh nc"], [r'"get|"post', "GET.*404"], ["[ab]?x*"],
        ])
    }
    rs = rules(**named)
    with_it = found(det.search_rules(logs, rs))
    assert with_it == found(det.search_rules(logs, rs, use_prefilter=False)) and len(with_it) > 400


def test_wide_rule_set_keeps_each_regex_once(make_logs):
    rs = rules(**{f"r{i}": rule(patterns=[f"w{i}a", f"w{i}b"]) for i in range(60)})
    hits = det.search_rules(make_logs([(1, "s", "w7b w30a"), (2, "s", "none")]), rs)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Filter") == 0
    assert found(hits) == [("r30", 1, 0), ("r7", 1, 1)]


# --------------------------------------------------------------------------- threshold


def brute_fired(rows, n, window):
    """rows: (time or None, key) -> keys for which n consecutive dated hits span at most the window."""
    by_key = defaultdict(list)
    for t, key in rows:
        if t is not None:
            by_key[key].append(t)
    return {
        k for k, ts in by_key.items()
        if any(b - a <= window for a, b in zip(sorted(ts), sorted(ts)[n - 1:]))
    }


@pytest.mark.parametrize("n,window", [(1, 0), (2, 0), (2, 5), (3, 10), (5, 30), (4, 0.5)])
def test_threshold_equals_brute_force(make_logs, n, window):
    rng = random.Random(n)
    rows = []
    for key in range(40):
        for _ in range(rng.randint(1, 12)):
            t = rng.choice([None, rng.uniform(0, 200), float(rng.randint(0, 60))])
            rows.append((t if t is None else round(t, 6), f"k{key}"))
    logs = make_logs([(t, "s", f"hit {k}") for t, k in rows])
    rs = rules(t=threshold([r"hit (?P<src_ip>\w+)"], count=n, window=window))
    hits = det.search_rules(logs, rs)
    expected = brute_fired(rows, n, window)
    assert {r.key for r in det.fired_keys(hits, rs).collect()} == expected
    matched = Counter(r.captured["src_ip"] for r in det.detect_threshold(hits, rs).collect())
    assert matched == Counter(k for _, k in rows if k in expected)


def test_threshold_bounds_are_exact(make_logs):
    """Windows of odd lengths in microseconds, with hits that lie exactly on their ends and beside them."""
    rng = random.Random(8)
    windows = {f"r{n}_{w}": (n, w / 1e6) for n in (2, 3, 7) for w in (0, 1, 31, 32, 33, 1000, 1023, 64_007)}
    rows = []
    for name, (n, window) in windows.items():
        for k in range(12):
            t, w = rng.randint(-10**6, 10**6), round(window * 1e6)
            for _ in range(rng.randint(n - 1, 2 * n)):
                rows.append((t / 1e6, "s", f"{name}! {name}x{k}"))
                t += max(0, rng.choice([w // max(1, n - 1), w // n, w - (n - 2), w, w + 1, 0, w // 2]) + rng.randint(-1, 1))
    rs = rules(**{name: threshold([rf"{name}! (?P<src_ip>\w+)"], count=n, window=window) for name, (n, window) in windows.items()})
    want = set()
    for name, (n, window) in windows.items():
        times = defaultdict(list)
        for t, _, text in rows:
            if text.startswith(f"{name}!"):
                times[text.split()[1]].append(round(t * 1e6))
        for key, at in times.items():
            at.sort()
            if any(at[i + n - 1] - at[i] <= round(window * 1e6) for i in range(len(at) - n + 1)):
                want.add((name, key))
    got = det.fired_keys(stored(det.search_rules(make_logs(rows), rs)), rs).collect()
    assert {(r.rule_path, r.key) for r in got} == want and len(got) == len(want) and 60 < len(want) < 250


def test_crowded_keys_send_no_hits(make_logs):
    """What the bounds decide is decided from counts: a steady hot key and a quiet one fetch no times."""
    logs = make_logs([(i / 10, "s", "hit hot") for i in range(3000)] + [(i * 50, "s", "hit quiet") for i in range(40)])
    rs = rules(t=threshold([r"hit (?P<src_ip>\w+)"], count=20, window=60))
    hits = stored(det.search_rules(logs, rs))
    fired = det.fired_keys(hits, rs)
    assert [r.key for r in fired.collect()] == ["hot"]
    plan = fired._jdf.queryExecution().executedPlan().toString()
    assert "_times" not in plan and "Join" not in plan
    assert det.detect_threshold(hits, rs).count() == 3000


def test_many_keys_are_not_sent_to_the_driver(make_logs):
    """Keys that fire grow with the logs: no join gathers them, however small their files; few ones still may be."""
    rs = rules(t=threshold([r"hit (?P<src_ip>\w+)"], count=3, window=60))

    def matched(keys, last):
        rows = [(k / 7 + at, "s", f"hit k{k}") for k in range(keys) for at in (0, 1, last(k))]
        matches = det.detect_threshold(stored(det.search_rules(make_logs(rows), rs)), rs)
        plan = matches._jdf.queryExecution().executedPlan().toString()
        return Counter(r.captured["src_ip"] for r in matches.collect()), "BroadcastHashJoin" in "".join(x for x in plan.split("\n") if "LeftSemi" in x)

    assert matched(10, lambda k: 10) == ({f"k{k}": 3 for k in range(10)}, True)
    assert matched(6000, lambda k: 10) == ({f"k{k}": 3 for k in range(6000)}, False)
    # Two thirds are left open by the bounds: on the window's end, and beside it.
    got, sent = matched(6000, lambda k: (10, 60, 60.000001)[k % 3])
    assert got == {f"k{k}": 3 for k in range(6000) if k % 3 < 2} and not sent


def test_threshold_limits_and_keys(make_logs):
    logs = make_logs([
        (0, "s", "hit a"), (30, "s", "hit a"), (60, "s", "hit a"),  # exactly the window
        (0, "s", "hit b"), (30, "s", "hit b"), (60.000001, "s", "hit b"),  # one microsecond over
        (0, "s", "hit"), (1, "s", "hit"), (2, "s", "hit"),  # group without a value: its own key
        (None, "s", "hit d"), (None, "s", "hit d"), (None, "s", "hit d"),  # no times
        (0, "s", "other"), (1, "s", "other"), (2, "s", "other"),  # no such group
    ])
    rs = rules(t=threshold([r"hit ?(?P<src_ip>\w+)?", "other"]))
    hits = det.search_rules(logs, rs)
    assert {r.key for r in det.fired_keys(hits, rs).collect()} == {"a", None, "unknown"}
    old = {r.key for r in det.fired_keys(hits, rs, compat=True).collect()}
    assert old == {"a", None, "unknown", "d"}


def test_threshold_per_job_or_fleet(make_logs):
    first = make_logs([(0, "s", "hit a"), (1, "s", "hit a")], "j1")
    logs = first.unionByName(make_logs([(2, "s", "hit a")], "j2"))
    rs = rules(t=threshold([r"hit (?P<src_ip>\w+)"]))
    hits = det.search_rules(logs, rs)
    assert det.fired_keys(hits, rs).count() == 0
    assert det.fired_keys(hits, rs, ()).count() == 1
    assert det.detect_threshold(hits, rs, ()).count() == 3


# --------------------------------------------------------------------------- sequence


@pytest.mark.parametrize("window", [0, 1, 7, 60, 100000])
def test_sequence_equals_nested_loop(make_logs, window):
    rng = random.Random(window)
    rows = [
        (round(rng.choice([rng.uniform(-50, 300), float(rng.randint(0, 40))]), 6), rng.choice(["one", "two", "one two", "x"]), rng.choice("ab"))
        for _ in range(250)
    ] + [(None, "one", "a"), (None, "two", "a")]
    logs = make_logs([(t, "s", f"{text} id={k}") for t, text, k in rows])
    rs = rules(s=rule("sequence", [r"one.*id=(?P<src_ip>\w)", r"two.*id=(?P<src_ip>\w)"], detection={"within_seconds": window}))
    hits = stored(det.search_rules(logs, rs))
    for key in (None, "src_ip"):
        first, second = Counter(), Counter()
        for i, (t1, a, k1) in enumerate(rows):
            for j, (t2, b, k2) in enumerate(rows):
                if "one" in a and "two" in b and None not in (t1, t2) and 0 <= round((t2 - t1) * 1e6) <= window * 1e6:
                    if key is None or k1 == k2:
                        first[i + 1] += 1
                        second[j + 1] += 1
        got = det.detect_sequence(hits, rs, key=key).collect()
        assert {r.line_no: r.weight for r in got if r.pattern_idx == 0} == dict(first)
        assert {r.line_no: r.weight for r in got if r.pattern_idx == 1} == dict(second)
        pairs = det.sequence_pairs(hits, rs, key=key).collect()
        assert sum(r.pairs for r in pairs) == sum(first.values())


@pytest.mark.parametrize("steps,window,key", [(3, 0, None), (3, 9, "src_ip"), (4, 15, None), (5, 100000, "src_ip")])
def test_longer_sequences_equal_a_loop_over_hits(make_logs, steps, window, key):
    rng = random.Random(steps * window)
    names = ["one", "two", "three", "four", "five"][:steps]
    rows = [
        (round(rng.choice([rng.uniform(-20, 150), float(rng.randint(0, 30))]), 6),
         " ".join(rng.sample(names, rng.choice([0, 1, 1, 1, 2]))) or "x", rng.choice("ab"))
        for _ in range(150)
    ] + [(None, "one", "a"), (None, "two", "a")]
    logs = make_logs([(t, "s", f"{text} id={k}") for t, text, k in rows])
    rs = rules(
        s=rule("sequence", [rf"{n}.*id=(?P<src_ip>\w)" for n in names], detection={"within_seconds": window}),
        two=rule("sequence", [rf"{n}.*id=(?P<src_ip>\w)" for n in names[:2]], detection={"within_seconds": window}),
    )
    hits = stored(det.search_rules(logs, rs))
    follows = lambda a, b: 0 <= round((b[0] - a[0]) * 1e6) <= window * 1e6 and (key is None or a[2] == b[2])
    at = [[(i + 1, r) for i, r in enumerate(rows) if n in r[1].split() and r[0] is not None] for n in names]
    ways = [{i: 1 for i, _ in at[0]}]
    for s in range(1, steps):
        ways.append({i: sum(ways[-1][j] for j, q in at[s - 1] if follows(q, r)) for i, r in at[s]})
    rest = {i: 1 for i, _ in at[-1]}
    want = {(i, steps - 1): ways[-1][i] for i in rest}
    for s in range(steps - 2, -1, -1):
        rest = {i: sum(rest[j] for j, q in at[s + 1] if follows(r, q)) for i, r in at[s]}
        want |= {(i, s): ways[s][i] * rest[i] for i in rest}
    want = {k: v for k, v in want.items() if v}
    got = det.detect_sequence(hits, rs, key=key).collect()
    assert {(r.line_no, r.pattern_idx): r.weight for r in got if r.rule_path == "s"} == want
    pairs = {r.rule_path: r.pairs for r in det.sequence_pairs(hits, rs, key=key).collect()}
    assert pairs.get("s", 0) * steps == sum(want.values())
    assert pairs.get("two", 0) * 2 == sum(r.weight for r in got if r.rule_path == "two")


def test_numbers_of_sequences_saturate(make_logs):
    """200 hits of each of ten steps at one time are 200 ** 10 sequences."""
    rs = rules(s=rule("sequence", ["a"] * 10, detection={"within_seconds": 5}))
    logs = make_logs([(5, "s", "a")] * 200)
    matches = find_matches(logs, rs)
    assert {r.weight for r in matches.collect()} == {2**63 - 1}
    assert fnd.build_findings(matches, rs).first().match_count == 2**63 - 1


# --------------------------------------------------------------------------- findings


def test_findings(spark, make_logs):
    rs = rules(
        p=rule(patterns=[r"from (?P<src_ip>\S+) (?P<user>\S+)"], severity="critical", title="T", false_positives=["fp"]),
        s=rule("sequence", ["from 1", "done"], severity="info", confidence="medium", detection={"within_seconds": 10}),
        none=rule(patterns=["absent"]),
    )
    logs = make_logs([
        (5, "s", "from 1 -"), (3, "s", "from 2 bob"), (None, "s", "from 2 bob"), (9, "s", "done"), (4, "s", "from 3 al"),
        (4, "s", "from 4 al"), (6, "s", "from 5 al"), (7, "s", "x" * 600 + "from 6 al"),
    ])
    matches = find_matches(logs, rs)
    got = {r.rule_path: r for r in fnd.build_findings(matches, rs).collect()}
    assert sorted(got) == ["p", "s"]
    p = got["p"]
    assert (p.match_count, p.status, p.status_label) == (7, "confirmed", "Confirmado")
    assert p.first_seen.endswith("00:00:03") and p.last_seen.endswith("00:00:07")
    assert [(e.value, e["count"]) for e in p.affected_entities["src_ip"]] == [("2", 2), ("3", 1), ("4", 1), ("1", 1), ("5", 1), ("6", 1)]
    assert [e.value for e in p.affected_entities["user"]] == ["al", "bob"]
    assert [s.message for s in p.sample_matches] == ["from 2 bob", "from 3 al", "from 4 al", "from 1 -", "from 5 al"]
    s = got["s"]
    assert (s.match_count, s.status) == (2, "highly_probable") and s.affected_entities is None
    frame = fnd.build_findings(matches, rs)
    assert [r.rule_path for r in fnd.order_findings(frame).collect()] == ["p", "s"]
    risk = fnd.risk(frame).first()
    assert (risk.critical, risk.info, risk.overall, risk.overall_label) == (1, 1, "critical", "CRITICO")
    order = fnd.prioritise(frame).orderBy("priority").collect()
    assert [(r.priority, r.reason) for r in order] == [(1, "Severity and high confidence"), (2, "Preventive hardening")]
    assert [r.rule_path for r in fnd.remediation(frame).collect()] == ["p"]
    info = spark.createDataFrame([("j", "web1", "Debian", "12", "6.1", "x86", "systemd")],
        "job_id string, hostname string, distro_name string, version_id string, kernel string, architecture string, init_system string")
    text = {r.rule_path: r.context for r in fnd.finding_context(frame, info).collect()}["p"]
    assert "Hostname          : web1" in text and "  - 2 (2 event(s))" in text and "- fp" in text


def test_entities_keep_the_top_twenty(make_logs):
    rs = rules(p=rule(patterns=[r"ip (?P<src_ip>\d+)"]))
    logs = make_logs([(i, "s", f"ip {i % 30}") for i in range(75)])
    rows = fnd.affected_entities(find_matches(logs, rs)).orderBy("rank").collect()
    assert [r.value for r in rows] == [str(i) for i in [*range(15), *range(15, 20)]]
    assert [r["count"] for r in rows] == [3] * 15 + [2] * 5


@pytest.mark.parametrize("confidence,count,expected", [
    ("high", 3, "confirmed"), ("high", 2, "highly_probable"), ("medium", 9, "highly_probable"),
    ("medium", 0, "suspicious"), ("low", 50, "insufficient_evidence"),
])
def test_status(spark, confidence, count, expected):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(confidence, count)], "c string, n bigint")
    assert df.select(fnd.finding_status(F.col("c"), F.col("n"))).first()[0] == expected


def test_sequences_that_cannot_be_evaluated_are_reported():
    from vigilog.sources.rules import RuleSet

    def sequence(*steps):
        return {"id": "X", "detection": {"type": "sequence", "steps": [{"regex": s} for s in steps]}}

    rs = RuleSet.from_dicts({"bad.yaml": sequence("a", "(", "b"), "three.yaml": sequence("a", "b", "c"), "two.yaml": sequence("a", "b")})
    assert [r.path for r in rs.active()] == ["three.yaml", "two.yaml"]
    assert {e[0] for e in rs.errors} == {"bad.yaml"}


def test_compat_evaluates_two_steps(make_logs):
    rs = rules(s=rule("sequence", ["a", "b", "c"], detection={"within_seconds": 5}))
    logs = make_logs([(1, "s", "a"), (2, "s", "b"), (30, "s", "c")])
    assert find_matches(logs, rs).count() == 0
    assert sorted(r.line_no for r in find_matches(logs, rs, compat=True).collect()) == [1, 2]
