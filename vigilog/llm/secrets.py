"""Secret scans with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import Scratch, table

#: (kind, pattern, group whose length counts, least length). Order is the order of kinds.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of letters a-f are in every word; the least length inside the pattern finds the same runs.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Parts of credentials that say little alone: (kind, pattern, what a match must hold besides).
WEAK = (
    ("id", r"""(?:client_id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]+""", ()),
    ("key", r"[A-Za-z0-9+/_=-]{16,}", ("[0-9]", "[A-Z]", "[a-z]")),
    ("endpoint", r"""[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+""", ()),
)
KINDS = tuple(k for k, *_ in BASE + WEAK)
#: Which kinds, weak or base, complete which weak kind.
COMPLEMENTS = {
    "id": ("assign", "key", "hex"),
    "key": ("access", "id", "endpoint"),
    "endpoint": ("assign", "key", "hex"),
}
#: Parts belong together if at most this many characters lie between them.
SCOPE = 120


def _spans(text: Column, pattern: str, group: int, least: int, holds=()) -> Column:
    """array<struct<start, end>> of a pattern's leftmost non-overlapping matches, in code points.

    The text between matches and the matches take turns, so their lengths add up to the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), whole.alias("match"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).alias("part"))
    kind = "struct<at:int,out:array<struct<start:int,end:int>>>"

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["match"], F.lit("")))
        good = F.coalesce(F.length(x["part"]) >= least, F.lit(False))
        for must in holds:
            good = good & F.coalesce(F.regexp(x["match"], F.lit(must)), F.lit(False))
        found = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], found)).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("out")).cast(kind)
    folded = F.aggregate(parts, zero, step, lambda s: s["out"])
    return F.when(F.regexp(text, F.lit(pattern)), folded).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int>>)"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Each row of docs (doc_id, text) with n_assign, n_access, n_hex, base, spans, n_linked.

    ``base`` and ``spans`` are arrays of struct<start, kind, end>, where kind is the place in KINDS;
    ``spans`` also holds weak candidates for which a complementary part begins or ends at most
    ``scope`` characters away in the same text. A weak span inside a base span is none of its own
    and does not count. All results follow from the text alone, so they are linked once for each
    different text that has candidates.

    A NULL text is empty and has no spans. Rows that repeat give equal rows. Texts of any length
    are scanned whole. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"),
        *[_spans(F.col("text"), pattern, group, least).alias(kind) for kind, pattern, group, least in BASE],
        *[_spans(F.col("text"), pattern, 0, 1, holds).alias(kind) for kind, pattern, holds in WEAK])

    def named(kind):
        number = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))

    def tagged(kinds):
        return F.concat(*[named(k) for k in kinds])

    found = found.select(
        "doc_id", "digest", *[F.size(k).cast("bigint").alias(f"n_{k}") for k, *_ in BASE],
        F.array_sort(tagged([k for k, *_ in BASE])).alias("base"), tagged([k for k, *_ in WEAK]).alias("weak"))
    found = scratch.keep(found, "found")

    # One copy of each text with at least two parts, one of them weak.
    texts = found.filter((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    texts = texts.select("digest", "base", "weak").dropDuplicates(["digest"])
    parts = texts.select("digest", F.inline(F.concat("base", "weak"))).distinct()
    parts = parts.withColumn("strong", F.col("kind") < len(BASE))
    # Interval join: a scope's worth of characters is a block; a part stands in each block that it or
    # its surroundings touch, and meets the weak parts that begin or end there. One that follows is
    # compared by the weak part's end, which may be many blocks from its start.
    ends = F.array_distinct(F.array(F.expr(f"start div {scope + 1}"), F.expr(f"end div {scope + 1}")))
    weak = parts.filter("NOT strong").withColumn("block", F.explode(ends))
    cells = F.sequence(F.expr(f"greatest(0, start - {scope}) div {scope + 1}"), F.expr(f"(end + {scope}) div {scope + 1}"))
    others = parts.select("digest", F.col("kind").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"),
                          F.explode(cells).alias("block"))
    both = weak.join(others, ["digest", "block"])
    inside = (F.col("k2") < len(BASE)) & (F.col("s2") <= F.col("start")) & (F.col("end") <= F.col("e2"))
    fits = F.lit(False)
    for kind, partners in COMPLEMENTS.items():
        fits = fits | ((F.col("kind") == KINDS.index(kind)) & F.col("k2").isin([KINDS.index(p) for p in partners]))
    apart = (F.col("s2") - F.col("end") <= scope) & (F.col("start") - F.col("e2") <= scope)
    overlap = (F.col("s2") < F.col("end")) & (F.col("start") < F.col("e2"))
    linked = both.groupBy("digest", "kind", "start", "end").agg(
        F.max(inside.cast("int")).alias("inside"), F.max((fits & apart & ~overlap).cast("int")).alias("linked"))
    linked = linked.filter("inside = 0 AND linked = 1").groupBy("digest").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("extra"))  # of one text
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    linked = scratch.keep(linked, "linked")  # so that the join may split the rows of a hot text
    out = found.join(linked, "digest", "left").withColumn("extra", F.coalesce("extra", none))
    return out.select("doc_id", *[f"n_{k}" for k, *_ in BASE], "base",
                      F.array_sort(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("bigint").alias("n_linked"))


def query(spark, folder: str) -> DataFrame:
    out = scan(table(spark, folder, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                      _joined(F.col("spans")).alias("spans"), "n_linked")


def _sql() -> str:
    """The same spans from DuckDB's own regular expressions, linked by a plain join per text."""
    # RE2 folds more than A-Z under (?i), so both cases are spelled out.
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    rules = []
    for i, (_, pattern, group, least) in enumerate(BASE):
        pattern = pattern.replace("(?i:(password|passwd|secret|token|api_?key))", f"({words})")
        rules.append((i, pattern, group, least, ()))
    for i, (_, pattern, holds) in enumerate(WEAK):
        rules.append((i + len(BASE), pattern, 0, 1, holds))
    found = []
    for i, pattern, group, least, holds in rules:
        p = quote(pattern)
        found.append(
            f"SELECT row_id, {i} AS kind, unnest(regexp_split_to_array(text, {p})) AS gap, "
            f"unnest(regexp_extract_all(text, {p}, 0)) AS hit, unnest(regexp_extract_all(text, {p}, {group})) AS part, "
            f"unnest(range(len(regexp_extract_all(text, {p}, 0)) + 1)) AS place FROM docs WHERE regexp_matches(text, {p})")
    good = " OR ".join(
        f"(kind = {i} AND length(part) >= {least}" + "".join(f" AND regexp_matches(hit, {quote(h)})" for h in holds) + ")"
        for i, _, _, least, holds in rules)
    fits = " OR ".join(
        f"(w.kind = {KINDS.index(k)} AND o.kind IN ({', '.join(str(KINDS.index(p)) for p in ps)}))" for k, ps in COMPLEMENTS.items())
    names = "[" + ", ".join(quote(k) for k in KINDS) + "]"
    line = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
pieces AS ({' UNION ALL '.join(found)}),
placed AS (
  SELECT row_id, kind, hit, part,
         CAST(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY row_id, kind ORDER BY place) AS BIGINT) AS stop
  FROM pieces),
parts AS (SELECT DISTINCT row_id, kind, stop - length(hit) AS start, stop FROM placed WHERE hit IS NOT NULL AND ({good})),
linked AS (
  SELECT DISTINCT w.row_id, w.kind, w.start, w.stop FROM parts w JOIN parts o USING (row_id)
  WHERE w.kind >= {len(BASE)} AND ({fits}) AND (o.start >= w.stop OR w.start >= o.stop)
    AND o.start - w.stop <= {SCOPE} AND w.start - o.stop <= {SCOPE}
    AND NOT EXISTS (SELECT 1 FROM parts b WHERE b.row_id = w.row_id AND b.kind < {len(BASE)} AND b.start <= w.start AND w.stop <= b.stop)),
base AS (
  SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex, {line} AS spans FROM parts WHERE kind < {len(BASE)} GROUP BY row_id),
total AS (
  SELECT row_id, {line} AS spans, count(*) FILTER (kind >= {len(BASE)}) AS n_linked
  FROM (SELECT * FROM parts WHERE kind < {len(BASE)} UNION ALL SELECT * FROM linked) GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base.spans, '')) AS base_sha256, coalesce(total.spans, '') AS spans,
       coalesce(n_linked, 0) AS n_linked
FROM docs LEFT JOIN base USING (row_id) LEFT JOIN total USING (row_id)
"""


SQL = _sql()
