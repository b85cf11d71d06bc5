"""The trigram index: fewer files, the same hits."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vigilog import RuleSet, load_rules
from vigilog.operators import literal_index as lix
from vigilog.operators.detect import search_rules
from vigilog.sources.sinks import read_log_table, write_logs

PACK = Path(__file__).resolve().parent.parent / "vigilog" / "rules"
DAY = 86400


def _rules(**patterns):
    return RuleSet.from_dicts({name: {"id": name, "detection": {"type": "pattern", "patterns": [{"regex": p} for p in many]}}
                               for name, many in patterns.items()})


@pytest.fixture()
def table(spark, make_logs, tmp_path):
    """One file a day, each with a message of its own among common ones."""
    own = ["port 22 ssh2", "PORT 4711 opened", "maßſtab KELVIN", "x", "union\nselect 9", "{brace}", "no", "Failed password for root from 10.0.0.9"]
    rows = [(DAY * d + i, "s", text) for d, text in enumerate(own) for i in range(3) for text in (text, f"common noise {i} {d}")]
    path = str(tmp_path / "logs")
    write_logs(make_logs([(t, s, m) for t, s, m in rows] + [(None, "s", "undated union all")]), path)
    lix.build_index(spark, path, str(tmp_path / "index"))
    return path, str(tmp_path / "index")


def _days(df):
    return sorted(r.path.split("dt=")[1].split("/")[0] for r in df.collect())


def test_only_possible_files_are_opened(spark, table):
    path, index = table
    ask = lambda *patterns: _days(lix.possible_files(spark, path, index, _rules(r=patterns)))
    assert ask("ssh2") == ["1970-01-01"] and ask("absent words") == []
    assert ask(r"port \d+ ssh") == ["1970-01-01"]
    assert ask("port 1234 opened") == ["1970-01-02"]  # digits are taken as alike
    assert ask("MAßSTAB kelvin") == ["1970-01-03"]
    assert ask(r"union\s+select") == ["1970-01-05"] and ask("union") == ["1970-01-05", "__HIVE_DEFAULT_PARTITION__"]
    assert ask("ssh2", "opened") == ["1970-01-01", "1970-01-02"] and ask("(?:ssh2|opened)") == ["1970-01-01", "1970-01-02"]
    hits = lix.search_table(spark, path, index, _rules(r=["opened"]))
    assert {r.ts.day for r in hits.collect()} == {2}
    names = lix.read_possible(spark, path, lix.possible_files(spark, path, index, _rules(r=["opened"]))).inputFiles()
    assert len(names) == 1 and "dt=1970-01-02" in names[0]
    assert lix.search_table(spark, path, index, _rules(r=["absent words"])).count() == 0


def test_rules_without_literals_see_all_files(spark, table):
    path, index = table
    rules = _rules(a=["^no$", r"\bx\b"], b=["opened"], c=["{", "brace"])
    named, others = lix.split_rules(rules)
    assert [r.path for r in named.rules] == ["b"] and [r.path for r in others.rules] == ["a", "c"]
    _same(spark, path, index, rules)


def _same(spark, path, index, rules):
    keys = lambda df: sorted((r.rule_path, r.pattern_idx, r.line_no, r.source_file) for r in df.collect())
    found = keys(lix.search_table(spark, path, index, rules))
    assert found == keys(search_rules(read_log_table(spark, path), rules)) and found
    return found


def test_the_pack_finds_the_same_through_the_index(spark, table, make_logs):
    path, index = table
    more = make_logs([(DAY * 20 + i, "sshd", f"Failed password for root from 10.0.0.{i} port 22 ssh2") for i in range(9)]
                     + [(DAY * 21, "nginx", "GET /a/../../etc/passwd HTTP/1.1 -> 200")])
    write_logs(more, path)  # files that the index does not know are opened
    rules = load_rules(PACK)
    first = _same(spark, path, index, rules)
    before = lix.read_index(spark, index).count()
    lix.build_index(spark, path, index)
    after = lix.read_index(spark, index)
    assert after.count() > before and after.groupBy("file", "map").count().filter("count > 1").isEmpty()
    assert _same(spark, path, index, rules) == first
    lix.build_index(spark, path, index)
    assert lix.read_index(spark, index).count() == after.count()


def test_access_lines_are_indexed_whole(spark, make_logs, tmp_path):
    logs = make_logs([(0, "nginx", "GET / HTTP/1.1 -> 200")]).withColumns(
        {"format": F.lit("access"), "raw": F.lit('1.2.3.4 - - "GET / HTTP/1.1" 200 1 "-" "sqlmap"')})
    path, index = str(tmp_path / "t"), str(tmp_path / "i")
    write_logs(logs, path)
    assert lix.possible_files(spark, path, index, _rules(r=["sqlmap"])).count() == 1  # no index yet
    lix.build_index(spark, path, index)
    assert lix.search_table(spark, path, index, _rules(r=["sqlmap"])).count() == 1
