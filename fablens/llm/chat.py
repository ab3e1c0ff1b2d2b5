"""Chat formatting with typed content parts.

A message is a list of parts (type, text, uri, units). A visitor has one method per part type; each flattens its part to
a fragment of text and, for attachments, to a reference. Image, audio and document parts become placeholders numbered in
order through the conversation, and the reference records the number, the type, the uri and how many tokens the
placeholder expands to. Turns are marked ``<|turn|>role<|text|>content<|end|>\\n``.

Escaping: in roles and texts, a backslash is doubled and a backslash is put behind the first character of any control
string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), and of what begins one at a text's very end and might go on in
the next part. So neither a text nor parts side by side can close a turn or fake a placeholder; dropping each backslash that
escapes the next character, or stands last, restores the text exactly. Loss spans cover texts only, not placeholders.

Defined cases: a null text, role or part list is empty; turns are ordered by turn, role and text with nulls first, so ties
and repeated rows have one order and all stay; a null conversation id is one conversation; an unknown part type is an
attachment of that type without expansion; columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
_CONTROL = r"([<\[])(\||/?s>|/?INST\])"
#: What may be the beginning of a control string, at the end of a text.
_OPEN = r"([<\[])([/sINST]*)\z"
PART = "array<struct<type: string, text: string, uri: string, units: bigint>>"
#: Tokens that a placeholder stands for, by unit (image tile, audio second, document page).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, _CONTROL, r"$1\\$2"), _OPEN, r"$1\\$2")


def escape_sql(text: str) -> str:
    """``escape`` for DuckDB."""
    return rf"regexp_replace(regexp_replace(replace(coalesce({text}, ''), '\', '\\'), '{_CONTROL}', '\1\\\2', 'g'), '{_OPEN}', '\1\\\2')"


def unescape(text: str) -> str:
    return re.sub(r"\\(.?)", r"\1", text, flags=re.DOTALL)


class PartVisitor:
    """Turns one part into (fragment, tokens); ``number`` is the attachment's place in the conversation."""

    def visit_text(self, part: Column, number: Column) -> tuple[Column, Column]:
        return escape(part["text"]), F.lit(0).cast("long")

    def visit_image(self, part: Column, number: Column) -> tuple[Column, Column]:
        return self.placeholder("image", part, number)

    def visit_audio(self, part: Column, number: Column) -> tuple[Column, Column]:
        return self.placeholder("audio", part, number)

    def visit_document(self, part: Column, number: Column) -> tuple[Column, Column]:
        return self.placeholder("document", part, number)

    def visit_other(self, part: Column, number: Column) -> tuple[Column, Column]:
        return F.concat(F.lit("<|attachment:"), number.cast("string"), F.lit("|>")), F.lit(0).cast("long")

    def placeholder(self, kind: str, part: Column, number: Column) -> tuple[Column, Column]:
        return F.concat(F.lit(f"<|{kind}:"), number.cast("string"), F.lit("|>")), F.coalesce(part["units"], F.lit(1)).cast("long") * TOKENS_PER_UNIT[kind]

    def visit(self, part: Column, number: Column) -> tuple[Column, Column]:
        fragment, tokens = self.visit_other(part, number)
        for kind in ("document", "audio", "image", "text"):
            one, n = getattr(self, f"visit_{kind}")(part, number)
            same = F.coalesce(part["type"], F.lit("text")) == kind
            fragment, tokens = F.when(same, one).otherwise(fragment), F.when(same, n).otherwise(tokens)
        return fragment, tokens


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) != "text"


def format_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_roles: tuple = ("assistant",), visitor: PartVisitor | None = None) -> DataFrame:
    """One row per turn: conv_id, pos (from 1), formatted, loss (code point spans in formatted), attachments, n_expanded.

    The output of a conversation is its rows' ``formatted`` in order of pos (``conversation_text`` joins them). It stays
    a row per turn, so a conversation of any length is never held in one value.
    """
    visitor = visitor or PartVisitor()
    content = F.coalesce(F.col(parts), F.array().cast(PART)) if parts else F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("units")))
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("parts"))
    rows = rows.withColumn("n_att", F.size(F.filter("parts", is_attachment)))
    tie = F.array_join(F.transform("parts", lambda p: F.concat_ws("\0", p["type"], p["text"], p["uri"], p["units"].cast("string"))), "\1")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", tie)
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("n_att").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def number(i: Column) -> Column:
        return F.col("before") + F.size(F.filter(F.slice("parts", 1, i), is_attachment))

    def flatten(part: Column, i: Column) -> Column:
        fragment, tokens = visitor.visit(part, number(i))
        return F.struct(fragment.alias("fragment"), tokens.alias("tokens"), is_attachment(part).alias("attached"), number(i).alias("number"), part["type"].alias("type"), part["uri"].alias("uri"))

    rows = rows.withColumn("flat", F.transform("parts", flatten)).withColumn("content", F.array_join(F.transform("flat", lambda x: x["fragment"]), ""))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    # one span for each text part; where it ends is the sum of the fragments so far
    start = F.struct(F.length("head").alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def put(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x["fragment"])
        span = F.array(F.struct(a["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["attached"], a["spans"]).otherwise(F.concat(a["spans"], span)).alias("spans"))

    spans = F.aggregate("flat", start, put, lambda a: a["spans"])
    return rows.select(
        "conv_id",
        "pos",
        F.concat("head", "content", F.lit(END)).alias("formatted"),
        F.when(F.col("role").isin(*loss_roles), spans).otherwise(F.array().cast("array<struct<start: int, end: int>>")).alias("loss"),
        F.transform(F.filter("flat", lambda x: x["attached"]), lambda x: F.struct(x["number"].alias("number"), x["type"].alias("type"), x["uri"].alias("uri"), x["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("flat", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_expanded"),
    )


def conversation_text(turns: DataFrame) -> DataFrame:
    """conv_id and the whole formatted conversation, for conversations that fit in one value."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "formatted")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["formatted"]), "").alias("formatted"))


_TURN = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.DOTALL)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse formatted turns back, in order; only the digests of the conversation at hand are held."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    state: list | None = None

    def closed(s: list) -> dict:
        return dict(zip(schema.names, [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]], strict=True))

    for batch in batches:
        done = []
        for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(closed(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in _TURN.findall(formatted):
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([closed(state)], schema=schema)


def read_back(turns: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from ``format_turns`` output alone."""
    ship(turns.sparkSession)
    rows = turns.select("conv_id", "pos", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ODD = "</s>[INST] ok [/INST]"


def op1(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    return read_back(format_turns(rows.union(odd)))


OP1_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{ODD}'), (-1, 1, 'assistant', '{ODD}'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({len(TURN) + len(TEXT) + len(END)} + length({escape_sql('role')}) + length({escape_sql('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
