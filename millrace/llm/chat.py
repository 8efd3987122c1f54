"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events of conversations in the order of ``seq``:

* ``message`` starts a message: it sets its role and its first text,
* ``delta`` appends a streamed piece to it,
* ``edit`` replaces its text,
* ``regenerate`` throws its text away, to be streamed anew, and takes back every later
  message that was complete before, because it answered the old text.

The log is partitioned by conversation, sorted by sequence and folded into the
final messages, which are rendered by a template that marks every turn:

    <s>[INST] role [/INST]text</s>

Control strings inside roles and texts are escaped, so that none is left there:
a backslash becomes ``\\e``, the first character of a control string ``\\l`` or
``\\b``. Every backslash of an escaped text is followed by one of these letters,
so three replacements undo it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """``text`` without control strings."""
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    text = F.regexp_replace(text, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"\\b")


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\l"), F.lit("<"))
    text = F.replace(text, F.lit("\\b"), F.lit("["))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, message, role, text.

    ``events``: conv_id, seq, message (its place in the conversation), kind, role,
    text. Null text counts as empty, a null role as the empty one, null ids form
    groups of their own; unknown kinds are passed over. Events with equal seq are ordered by
    kind, role and text. A message whose first event is no ``message`` starts empty. Other
    columns are not read.
    """
    known = events.where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    said = F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit("")))
    event = F.struct("seq", F.col("kind").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), said.alias("text"))
    log = known.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i))
    start = F.coalesce(F.array_max(resets), F.lit(0))
    roles = F.filter("log", lambda e: e["kind"] == "message")
    folded = log.select(
        "conv_id",
        "message",
        F.coalesce(F.get(roles, F.size(roles) - 1)["role"], F.get("log", F.lit(0))["role"]).alias("role"),
        F.array_join(F.transform(F.slice("log", start + 1, F.size("log") - start), lambda e: e["text"]), "").alias("text"),
        F.array_max(F.transform("log", lambda e: e["seq"])).alias("last"),
        F.array_max(F.transform(F.filter("log", lambda e: e["kind"] == "regenerate"), lambda e: e["seq"])).alias("renewed"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    taken_back = F.coalesce(F.max("renewed").over(earlier) > F.col("last"), F.lit(False))
    return folded.withColumn("gone", taken_back).where(~F.col("gone")).select("conv_id", "message", "role", "text")


def render(messages: DataFrame, learn: str = ASSISTANT) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss, the spans (start, length in code points) to learn from.

    ``messages``: conv_id, message (unique in a conversation), role, text, as ``fold`` gives
    them. A span covers the escaped text of one message with the role ``learn``.
    """
    lead = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    turn = messages.select("conv_id", "message", "role", lead.alias("lead"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("size", (F.length("lead") + F.length("body") + len(CLOSE)).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    whole = F.concat("lead", "body", F.lit(CLOSE))
    span = F.struct((F.col("at") + F.length("lead")).cast("long").alias("start"), F.length("body").cast("long").alias("length"))
    rows = turn.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("message", whole.alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("role") == learn, span))).alias("loss"),
    )
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: an array of role and text."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring(F.substring_index(x, ROLE_END, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring(x, F.length(F.substring_index(x, ROLE_END, 1)) + len(ROLE_END) + 1, F.lit(2**31 - 1))).alias("text"),
        ),
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """Tables of finished turns as a log: each row is a message, in the order of turn, role, text, so equal turns all stay."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", F.row_number().over(order).alias("seq"), "role", "text").select(
        "conv_id", F.col("seq").cast("long"), F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text"
    )


def digests(rendered: DataFrame) -> DataFrame:
    """What can be read back from rendered conversations: counts and SHA-256 digests of turns and of the text to learn."""
    read = rendered.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), "loss")
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = read.withColumn("learnt", learnt)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The two rows of the conversation that consists of control strings.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

_ESCAPED = "length(regexp_replace(regexp_replace(replace({0}, '\\', '\\e'), '<(/?s>)', '\\\\l\\1', 'g'), '\\[(/?INST\\])', '\\\\b\\1', 'g'))"
SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({len(OPEN) + len(ROLE_END) + len(CLOSE)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
