"""The hash tree of a manifest against a recursion, its proofs, and what tampering does to it."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vigilog.operators import integrity, merkle
from vigilog.session import stored

SCHEMA = "job_id string, filename string, relative_path string, size_bytes bigint, sha256 string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def _rows(job, count):
    return [(job, f"f{i}", f"01_evidence/raw/f{i}", i, sha(f"{job}{i}")) for i in range(count)]


def _root(rows, digits, at=0):
    """(hash, {prefix: hash}) of the node over rows whose paths' hashes agree in the first ``at`` digits."""
    entries = sorted({f"{sha(r[2])}:{sha(f'{r[2]}' + chr(9) + f'{r[3]}' + chr(9) + r[4])}" for r in rows})
    prefix = entries[0][:at]
    if len(entries) <= 16 ** digits or at + digits > 64:
        value = sha("leaf\n" + "\n".join(entries))
        return value, {prefix: value}
    below, nodes = [], {}
    for child in sorted({e[at:at + digits] for e in entries}):
        value, more = _root([r for r in rows if sha(r[2])[at:at + digits] == child], digits, at + digits)
        below.append(f"{child}:{value}")
        nodes |= more
    value = sha("node\n" + "\n".join(below))
    return value, {**nodes, prefix: value}


@pytest.mark.parametrize("digits", [1, 2])
def test_tree_equals_a_recursion(spark, digits):
    rows = _rows("a", 900) + _rows("b", 3) + _rows("c", 17) + _rows("b", 2)
    nodes = merkle.tree(spark.createDataFrame(rows, SCHEMA).repartition(5), digits).collect()
    for job in "abc":
        value, every = _root([r for r in rows if r[0] == job], digits)
        mine = [n for n in nodes if n.job_id == job]
        assert {n.prefix: n.hash for n in mine} == every and len(mine) == len(every)
        top = next(n for n in mine if n.depth == 0)
        assert top.hash == value and top.files == len({r[2] for r in rows if r[0] == job})
    assert max(len(n.entries) for n in nodes) <= 16 ** digits
    assert all(len(n.prefix) == n.depth * digits for n in nodes)


def test_a_jobs_signature_is_its_own(spark):
    alone = integrity.sign(spark.createDataFrame(_rows("a", 5), SCHEMA)).collect()
    among = integrity.sign(spark.createDataFrame(_rows("a", 5) + _rows("b", 700), SCHEMA)).collect()
    assert alone[0] in among and len(among) == 2
    assert integrity.sign(spark.createDataFrame([], SCHEMA)).collect() == []


def test_proofs_hold_and_break(spark):
    manifest = spark.createDataFrame(_rows("a", 300) + _rows("b", 2), SCHEMA)
    nodes = stored(merkle.tree(manifest, 1))
    signed = merkle.root(nodes)
    asked = manifest.filter("filename IN ('f1', 'f7', 'f250')")
    proofs = stored(merkle.prove(nodes, asked, 1))
    assert proofs.agg(F.max(F.size("entries"))).first()[0] <= 16
    assert {(r.job_id, r.relative_path[-4:], r.valid) for r in merkle.verify_proofs(proofs, asked, signed).collect()} == {
        ("a", "w/f1", True), ("a", "w/f7", True), ("a", "f250", True), ("b", "w/f1", True)}

    def valid(proofs=proofs, files=asked, signed=signed):
        return [r.valid for r in merkle.verify_proofs(proofs, files, signed).collect()]

    assert not any(valid(files=asked.withColumn("sha256", F.lit("0"))))
    assert not any(valid(files=asked.withColumn("size_bytes", F.col("size_bytes") + 1)))
    assert not any(valid(signed=signed.withColumn("manifest_sha256", F.lit("0"))))
    assert not any(valid(proofs=proofs.filter("kind = 'node'")))
    assert not any(valid(proofs=proofs.filter("depth > 0")))
    assert valid(proofs=proofs.filter("relative_path NOT LIKE '%f7'")).count(False) == 1
    # An entry put into the leaf changes its hash, which the node above does not list.
    forged = asked.withColumn("sha256", F.lit("0"))
    name = F.concat(F.sha2("relative_path", 256), F.lit(":"), F.sha2(F.concat_ws("\t", "relative_path", F.col("size_bytes").cast("string"), "sha256"), 256))
    more = forged.select("job_id", "relative_path", name.alias("entry"))
    fake = proofs.join(more, ["job_id", "relative_path"]).withColumn(
        "entries", F.when(F.col("kind") == "leaf", F.array_append("entries", F.col("entry"))).otherwise(F.col("entries")))
    assert not any(valid(proofs=fake.drop("entry"), files=forged))


def test_changes_name_their_branches(spark):
    rows = _rows("a", 400)
    later = [r if r[1] != "f9" else (*r[:4], "changed") for r in rows if r[1] != "f33"] + [("a", "new", "01_evidence/raw/new", 1, "x")]
    before, after = (stored(merkle.tree(spark.createDataFrame(x, SCHEMA), 1)) for x in (rows, later))
    branches = merkle.changed_branches(before, after).collect()
    names = [sha(f"01_evidence/raw/{n}") for n in ("f9", "f33", "new")]
    assert all(any(n.startswith(b.prefix) for n in names) for b in branches)
    assert all(any(n.startswith(b.prefix) for b in branches) for n in names)
    near = merkle.files_below(spark.createDataFrame(later, SCHEMA), spark.createDataFrame(branches)).collect()
    assert {"f9", "new"} <= {r.filename for r in near} and len(near) <= 48
    assert merkle.changed_branches(before, before).collect() == []
