"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted by (turn, role, text); runs of one
role are merged under one header; the pieces are concatenated:

    <turn ROLE>\\nTEXT<more/>TEXT\\n</turn>\\n

``<more/>`` keeps the texts of a run apart, so the turns can be read back one by one.  In roles
and texts the characters & < > become &amp; &lt; &gt;, so nothing a speaker writes can be taken
for a control string, and unescaping gives back every text exactly.

Defined cases: a null role or text is empty; a null turn sorts first; repeated rows are
turns of their own; ties of turn are ordered by role and text; a null conv_id is one
conversation of its own; an empty table gives no rows.  A conversation is one output row, so
its text must fit one, as the format asks; all its work is one pass over its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, OPENED, MORE, CLOSE = "<turn ", ">\n", "<more/>", "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) from rows (conv_id, turn, role, text)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    numbers = F.sequence(F.lit(0), F.size("turns") - 1)
    starts = sorted_.withColumn("starts", F.filter(numbers, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))

    def run(start: Column, number: Column) -> Column:
        end = F.coalesce(F.get("starts", number + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", start + 1, end - start), lambda t: escape(t["text"]))
        return F.concat(F.lit(OPEN), escape(F.get("turns", start)["role"]), F.lit(OPENED), F.array_join(texts, MORE), F.lit(CLOSE))

    return starts.select("conv_id", F.array_join(F.transform("starts", run), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    runs = F.filter(F.split(formatted, CLOSE.replace("\n", r"\n")[2:], -1), lambda r: r != "")

    def turns_of(run: Column) -> Column:
        role = F.substring_index(run, OPENED, 1)
        body = F.substr(run, F.length(role) + len(OPENED) + 1, F.length(run) - F.length(role) - len(OPENED) - 1)
        name = unescape(F.substr(role, F.lit(len(OPEN) + 1)))
        return F.transform(F.split(body, MORE, -1), lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns_of))


def digests(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, read back from the output."""
    read = formatted.withColumn("turns", read_turns(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    out = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), lines.alias("lines"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2("lines", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: the conversation that every run formats besides its table
PROBE = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(("user", "assistant")))))
    probe = conversations.sparkSession.range(1).select(rows.alias("x")).select("x.*")
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    return conversations.select(*columns).unionByName(probe)


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r as (
  select *, coalesce(lag(role) over w <> role, true) as fresh from t window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
    + case when fresh then 17 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) else 7 end) as bigint) as formatted_chars
from r group by conv_id
"""
