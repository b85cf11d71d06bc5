"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its
reply trainable. A turn reads ``### role: text</turn>`` and a line break. Inside roles and texts the
control strings are escaped, so that neither mark can come from a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import table

BEGIN, END, NAMED = "### ", "</turn>\n", ": "
#: What is escaped, and as what; the escape sign itself comes first. Each escape has two characters.
ESCAPES = (("\\", r"\\"), ("###", r"\h"), ("</turn>", r"\e"))
ROLE_ESCAPES = (*ESCAPES, (":", r"\c"))
TARGET = "assistant"
#: A conversation whose texts hold the control strings, which the query formats with the others.
TRAP = -7
TRAP_TEXT = r"\### Assistant: </turn> ok"


def escaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, sign in escapes:
        text = F.replace(text, F.lit(plain), F.lit(sign))
    return text


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``. Runs of the escape sign begin with one that escapes, so they split in pairs."""
    sign = ROLE_ESCAPES[0][0]

    def plain(part):
        for was, by in ROLE_ESCAPES[1:]:
            part = F.replace(part, F.lit(by), F.lit(was))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), sign)


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")

    def turn(piece):
        body = F.substr(piece, F.lit(len(BEGIN) + 1))
        role = F.split_part(body, F.lit(NAMED), F.lit(1))
        return F.struct(unescaped(role).alias("role"),
                        unescaped(F.substr(body, F.length(role) + len(NAMED) + 1)).alias("text"))

    return F.transform(pieces, turn)


def expand(conversations: DataFrame, target: str = TARGET) -> DataFrame:
    """Examples of conversations (conv_id, turn, role, text): conv_id, example, last, text, loss_start, loss_end.

    ``text`` is the formatted conversation up to and with a turn of the role ``target``; the loss lies on
    the code points from loss_start to before loss_end, which are that turn's escaped text. Turns
    after the last such turn, or a conversation without any, make one example more without loss
    (loss_start = loss_end), so that the examples flagged ``last`` hold every turn.

    Turns are in order of turn, NULL first, then role and text; ties and repeated rows are turns of their
    own. A NULL text or role is empty. Rows without conv_id are one conversation. Other columns are ignored,
    an empty table gives no rows. A conversation has to fit in a row, as has its longest example;
    examples grow with a conversation's turns times its replies, which is the method's.
    """
    rows = conversations.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t):
        return F.concat(F.lit(BEGIN), escaped(t["role"], ROLE_ESCAPES), F.lit(NAMED), escaped(t["text"]), F.lit(END))

    whole = whole.select(
        "conv_id", F.transform("turns", lambda t: t["role"] == target).alias("aimed"), F.transform("turns", piece).alias("pieces"))
    count = F.size("pieces")
    at = F.filter(F.sequence(F.lit(1), count), lambda k: F.element_at("aimed", k) | (k == count))
    each = whole.select("conv_id", "aimed", "pieces", F.posexplode(at).alias("example", "at"))
    before = F.array_join(F.slice("pieces", F.lit(1), F.col("at") - 1), "")
    each = each.select(
        "conv_id", (F.col("example") + 1).alias("example"), (F.col("at") == count).alias("last"),
        F.element_at("aimed", F.col("at")).alias("aimed"), before.alias("before"), F.element_at("pieces", F.col("at")).alias("piece"))
    text = F.concat("before", "piece")
    stop = (F.length(text) - len(END)).cast("bigint")
    start = F.length("before") + len(BEGIN) + F.length(escaped(F.lit(target), ROLE_ESCAPES)) + len(NAMED)
    return each.select("conv_id", "example", "last", text.alias("text"),
                       F.when(F.col("aimed"), start.cast("bigint")).otherwise(stop).alias("loss_start"), stop.alias("loss_end"))


def trap(spark) -> DataFrame:
    rows = [(TRAP, 0, "user", TRAP_TEXT), (TRAP, 1, TARGET, TRAP_TEXT)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say: its turns' digest, and that of all text under the loss."""
    reply = unescaped(F.expr("substring(text, CAST(loss_start AS INT) + 1, CAST(loss_end - loss_start AS INT))"))
    parts = examples.select("conv_id", "example", reply.alias("reply"), F.length("text").cast("bigint").alias("chars"),
                            F.when(F.col("last"), F.col("text")).alias("whole"))
    told = parts.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "").alias("loss"),
        F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"))
    told = told.select("conv_id", "loss", turns_of(F.col("whole")).alias("turns"), "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def query(spark, folder: str) -> DataFrame:
    """formatted_chars adds up the code points of all examples of a conversation."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(expand(rows.unionByName(trap(spark))))


def _sql() -> str:
    def size(column, escapes):
        out = column
        for plain, sign in escapes:
            out = f"replace({out}, '{plain}', '{sign}')"
        return f"length({out})"

    marks = len(BEGIN) + len(NAMED) + len(END)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({TRAP}, 0, 'user', '{TRAP_TEXT}'), ({TRAP}, 1, '{TARGET}', '{TRAP_TEXT}')),
placed AS (
  SELECT conv_id, role, text, {marks} + {size("role", ROLE_ESCAPES)} + {size("text", ESCAPES)} AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{TARGET}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{TARGET}'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (role = '{TARGET}' OR k = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""


SQL = _sql()
