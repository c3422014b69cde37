r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

The template writes a turn as ``### <role>: <text>`` and, on a line of its own, ``</turn>``. A text's own
control strings get one backslash more in front (``### `` becomes ``\### ``, ``\### `` becomes ``\\### ``), so
that reading takes one away again; the end mark always follows a line feed, never a backslash. In a role
the characters that could end the header are written as codes.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text
under the loss mask. Turns after the last assistant turn get an example without a target, so that no turn
is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\n</turn>\n"
#: Characters of a role that have codes.
ROLE_CODES = {"\\": r"\s", ":": r"\c", "\n": r"\n"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+)(### |</turn>)", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)(### |</turn>)", r"$1$2")


def _role(role: Column) -> Column:
    for plain, code in ROLE_CODES.items():
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _unrole(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES.items()):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def format_chats(turns: DataFrame, trainable: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example, last, formatted, loss_start, loss_chars: one row for each prefix-target pair.

    formatted is the whole example, loss_start and loss_chars the code points under the loss mask; last
    marks the example that holds every turn of its conversation. A null text or role counts as empty, a
    null id is an id of its own; turns stand by number (nulls first), equal ones by role and text.
    Repeated rows are turns of their own. Other columns are ignored. A conversation is written once, as one row,
    with the places where its examples end; each example is a prefix of it. Prefixes hold their whole context,
    so a conversation's examples grow with the square of its turns: that is what the method makes.
    """
    t = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit("### "), _role(F.col("role")), F.lit(": "))
    piece = F.struct("turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    sizes = F.transform("turns", lambda x, i: F.struct((x["role"] == trainable).alias("has"), F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"), (i + 1 == F.size("turns")).alias("last")))
    c = c.select("conv_id", whole.alias("whole"), sizes.alias("sizes"))
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<last:boolean,end:int,loss_start:int,loss_chars:int>>").alias("out"))

    def step(s, x):
        begin = s["upto"] + x["head"]
        end = begin + x["body"] + len(END)
        one = F.struct(x["last"].alias("last"), end.alias("end"), F.when(x["has"], begin).otherwise(0).alias("loss_start"), F.when(x["has"], x["body"]).otherwise(0).alias("loss_chars"))
        return F.struct(end.alias("upto"), F.when(x["has"] | x["last"], F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    each = c.select("conv_id", "whole", F.posexplode(F.aggregate("sizes", start, step, lambda s: s["out"])).alias("example", "x"))
    return each.select("conv_id", "example", "x.last", F.left("whole", F.col("x.end")).alias("formatted"), "x.loss_start", "x.loss_chars")


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted example."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unrole(F.substr(F.substring_index(p, ": ", 1), F.lit(5))).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, ": ", 1)) + 3)).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return unescape(F.substr(formatted, start + 1, chars))


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, read from the examples.

    Each conversation gathers only the texts under its masks, once each; the turns are read from the one
    example that holds them all.
    """
    turns = read_turns(F.col("formatted"))
    # only the last example is split; of the others null is kept
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = examples.select(
        "conv_id",
        "example",
        F.when(F.col("last"), F.size(turns)).alias("n"),
        F.when(F.col("last"), F.sha2(told, 256)).alias("sha"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    got = each.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    return got.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


#: The conversation whose texts hold the template's own control strings.
TRICKY = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
        4 + len(replace(replace(replace(role, '\', '\s'), ':', '\c'), chr(10), '\n')) + 2
          + len(text) + len(regexp_extract_all(text, '### |</turn>')) + 9 AS chars
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM m)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS n_examples
FROM p GROUP BY conv_id
"""
