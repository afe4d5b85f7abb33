"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (``name`` is a url-encoded role):

    conversation = turn*
    turn         = "[INST]" text "[/INST]"      role user
                 | "<s>" text "</s>"            role assistant
                 | "<<SYS>>" text "<</SYS>>"    role system
                 | "[TURN " name "]" text "[/TURN]"   any other role
    control      = one of the marks above

A text must not hold a control string. Where it does, one backslash is put
behind the first character of the control string; a text that holds an already
slashed control string gets one more. The parser takes one away, so the escape
is reversible and no other backslash changes. A text is formatted as it is,
reparsed and compared with its source; texts that come back different are
escaped. The whole conversation is reparsed once more before it is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.llm.common import read

NAMES = r"/?INST\]|TURN [A-Za-z0-9%_.*+-]*\]|/TURN\]"
TAGS = r"/?s>|</?SYS>>"
CONTROL = rf"\[(?:{NAMES})|<(?:{TAGS})"
# Fixed marks of the three usual roles: role, opening mark, closing mark.
MARKS = [("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"), ("system", "<<SYS>>", "<</SYS>>")]


def escaped(text: Column) -> Column:
    slashed = F.regexp_replace(text, rf"\[(\\*)(?={NAMES})", r"[$1\\")
    return F.regexp_replace(slashed, rf"<(\\*)(?={TAGS})", r"<$1\\")


def unescaped(text: Column) -> Column:
    plain = F.regexp_replace(text, rf"\[\\(\\*)(?={NAMES})", r"[$1")
    return F.regexp_replace(plain, rf"<\\(\\*)(?={TAGS})", r"<$1")


def opening(role: Column) -> Column:
    out = F.concat(F.lit("[TURN "), F.url_encode(role), F.lit("]"))
    for name, mark, _ in MARKS:
        out = F.when(role == name, mark).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit("[/TURN]")
    for name, _, mark in MARKS:
        out = F.when(role == name, mark).otherwise(out)
    return out


def parsed(df: DataFrame, output: Column, name: str) -> DataFrame:
    """Add the turns of a formatted text as array<struct<role, text>>; null if it is not in the grammar.

    Steps are columns of their own: inside a lambda an expression would be evaluated for each element.
    """
    def role(mark: Column) -> Column:
        out = F.try_url_decode(F.regexp_extract(mark, r"^\[TURN (.*)\]$", 1))
        for known, begin, _ in MARKS:
            out = F.when(mark == begin, known).otherwise(out)
        return out

    # Each mark with the text that follows it: openings at even, closings at odd places.
    df = df.withColumn("_tokens", F.zip_with(
        F.regexp_extract_all(output, F.lit(f"({CONTROL})"), 1), F.slice(F.split(output, CONTROL, -1), 2, 2**30),
        lambda mark, text: F.struct(mark.alias("mark"), text.alias("text"))))
    df = df.withColumn("_pairs", F.zip_with(
        F.filter("_tokens", lambda t, i: i % 2 == 0), F.filter("_tokens", lambda t, i: i % 2 == 1),
        lambda o, c: F.struct(
            role(o["mark"]).alias("role"), unescaped(o["text"]).alias("text"),
            (~o["mark"].rlike(r"^.?/|^<</") & (c["text"] == "") & (closing(role(o["mark"])) == c["mark"])).alias("ok"))))
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    regular = (F.size("_tokens") % 2 == 0) & output.rlike(f"^(?:{CONTROL})") & F.forall("_pairs", lambda p: F.coalesce(p["ok"], F.lit(False)))
    return df.withColumn(name, F.when(output == "", nothing).when(regular, F.transform(
        "_pairs", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"))))).drop("_tokens", "_pairs")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(opening(t["role"]), t["text"], closing(t["role"]))), "")


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv_id, source, output, turns, exact): one row per conversation.

    ``output`` is the formatted text, ``turns`` what the parser reads back from
    it, ``exact`` whether that equals ``source``, the given turns in order.

    Turns are ordered by ``turn`` (nulls first), then role and text, so ties have
    one order; repeated rows are turns of their own. A null text or role is an
    empty one. Rows without a conversation id form one conversation. An empty
    table gives none.
    """
    plain = rows.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    alone = F.concat(opening(F.col("role")), F.col("text"), closing(F.col("role")))
    source = F.array(F.struct("role", "text"))
    told = parsed(plain.withColumn("_alone", alone), F.col("_alone"), "_back").withColumn(
        "safe", F.when(F.col("_back").eqNullSafe(source), F.col("text")).otherwise(escaped(F.col("text"))))
    whole = told.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "safe"))).alias("all"))
    strip = lambda name: F.transform("all", lambda t: F.struct(t["role"].alias("role"), t[name].alias("text")))
    out = whole.select("conv_id", strip("text").alias("source"), rendered(strip("safe")).alias("output"))
    return parsed(out, F.col("output"), "turns").withColumn("exact", F.col("turns").eqNullSafe(F.col("source")))


def with_digests(chats: DataFrame) -> DataFrame:
    """What is read back from the outputs: turns, and the text under the loss mask (assistant turns)."""
    everything = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(everything, 256).alias("turns_sha256"),
        F.char_length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("output").cast("bigint").alias("formatted_chars"), "exact")


PROBE = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    given = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"""SELECT * FROM VALUES (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}')
                          AS t(conv_id, turn, role, text)""")
    return with_digests(format_chats(given.unionByName(probe)))


SQL = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
marked AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '(\[\\*({NAMES}))|(<\\*({TAGS}))'))
         + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                ELSE 14 + length(url_encode(role)) END AS chars
  FROM given)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, true AS exact
FROM marked GROUP BY conv_id
"""
