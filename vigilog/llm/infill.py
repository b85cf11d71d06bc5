"""Fill-in-middle transformation: texts cut in three and told in another order.

Tokens and cuts are found in the bytes of UTF-8. What turns bytes into code points and back is an index
of exceptions: the places of the characters of more than one byte, and the bytes by which they exceed
one. Between them both counts run alike, so a cut costs one binary search, and none in ASCII.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import table
from vigilog.session import ship_code

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Of 100 texts so many are transformed, and of 100 of these so many begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Exceptions:
    """The multibyte characters of a text: where they stand, and what bytes they add."""

    def __init__(self, raw: np.ndarray):
        self.bytes = np.flatnonzero(raw >= 0xC0)
        first = raw[self.bytes]
        self.added = np.concatenate(([0], np.cumsum(1 + (first >= 0xE0) + (first >= 0xF0))))
        self.chars = self.bytes - self.added[:-1]
        self.n_chars = len(raw) - int(self.added[-1])

    def to_bytes(self, cut: int) -> int:
        """Bytes before a cut that stands after so many code points."""
        return cut + int(self.added[np.searchsorted(self.chars, cut)])

    def to_chars(self, cut: int) -> int:
        """Code points before a cut that stands after so many bytes."""
        return cut - int(self.added[np.searchsorted(self.bytes, cut)])


def token_starts(raw: np.ndarray) -> np.ndarray:
    """Byte at which each token begins: a run of ASCII letters, or any other single character."""
    letter = _LETTER[raw]
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def draws(key: str, seed: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[8 * i:8 * i + 8], 16) for i in range(4))


def cut(raw: bytes, key: str, units: str, seed: str, transformed: int, suffix_first: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    data = np.frombuffer(raw, np.uint8)
    index = Exceptions(data)
    starts = token_starts(data) if units == "tokens" else None
    n = index.n_chars if starts is None else len(starts)
    h1, h2, h3, h4 = draws(key, seed)
    if not raw or h3 % 100 >= transformed or any(m in raw for m in MARKS):
        return n, "plain", None, None, raw
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    if starts is None:
        a, b = (index.to_bytes(c) for c in cuts)
        chars = cuts
    else:
        a, b = (int(starts[c]) if c < n else len(raw) for c in cuts)
        chars = [index.to_chars(a), index.to_chars(b)]
    p, s, m = MARKS
    if h4 % 100 < suffix_first:
        form, output = "spm", b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    else:
        form, output = "psm", b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))
    return n, form, chars[0], chars[1] - chars[0], output


def transform(docs: DataFrame, units: str = "tokens", seed: str = SEED, transformed: int = TRANSFORMED,
              suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Each row of docs (doc_id, text) with n, form, prefix_chars, middle_chars and output.

    ``units`` are tokens (runs of ASCII letters, other characters singly) or chars (code points); n counts
    them, and the cuts stand after numbers of them that follow from seed and doc_id alone. Form
    is plain (the text itself, without chars), psm or spm. A NULL text is empty, empty texts are plain;
    so are texts that hold a mark. Rows without doc_id draw as for an empty id. Repeated rows give
    equal rows, an empty table none, and texts are cut whole, one at a time. All other columns stay;
    those named like the new ones are replaced.
    """
    if units not in ("tokens", "chars"):
        raise ValueError(f"units: {units}")
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    ship_code(docs.sparkSession)

    @F.arrow_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>")
    def told(keys, texts):
        import pyarrow as pa

        texts = texts.cast(pa.large_binary())
        rows = [cut(t.as_buffer().to_pybytes(), k, units, seed, transformed, suffix_first)
                for k, t in zip(keys.to_pylist(), texts, strict=True)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(new))

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       told(key, F.coalesce("text", F.lit(""))).alias("told"))
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in new]
    return rows.select(*kept, *[F.col(f"told.{c}") for c in new])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of such a form was made from. Each mark stands in it exactly once."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def parts(second):
        one, rest = F.split_part(body, F.lit(second), F.lit(1)), F.split_part(body, F.lit(second), F.lit(2))
        return one, F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))

    prefix, suffix, middle = parts(SUFFIX)
    from_psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "psm", from_psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def query(spark, folder: str) -> DataFrame:
    out = transform(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM docs),
cuts AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo,
         greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:lo], ''), '') AS p,
         coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
