"""Chat template of tokenized training texts, and packing to a fixed length.

Defined results: null content is empty; no messages give the system block alone; messages of one turn number follow role
and content; repeated rows are messages of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ranks import running_total
from textloom.functions.text import let, pstrip
from textloom.operators.instruct import order_key

#: Special tokens and wording of the template.
BEGIN, END = "<|begin_of_text|>", "<|eot_id|>"
CUTOFF, DATE = "Cutting Knowledge Date: December 2023\n", "26 Jul 2024"
TOOL_SYSTEM = "You have access to the following functions. To call a function, please respond with JSON for a function call."
TOOL_USER = "Given the following functions, please respond with a JSON for a function call with its proper arguments that best answers the given prompt.\n\n"
TOOL_FORM = 'Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}.Do not use variables.\n\n'


def header(role: Column) -> Column:
    return F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"))


def turn(role: Column, content: Column) -> Column:
    return F.concat(header(role), pstrip(F.coalesce(content, F.lit(""))), F.lit(END))


def tool_call(name: Column, arguments: Column) -> Column:
    """An assistant's single call; arguments is JSON text."""
    return F.concat(header(F.lit("assistant")), F.lit('{"name": "'), name, F.lit('", "parameters": '), arguments, F.lit("}"), F.lit(END))


def tool_result(content: Column) -> Column:
    """Output of a tool as a JSON string."""
    quoted = F.regexp_replace(F.to_json(F.struct(content.alias("c"))), r"^\{\"c\":|\}$", "")
    return F.concat(header(F.lit("ipython")), quoted, F.lit(END))


def render(messages: Column, date: str = DATE, generation_prompt: bool = False, tools: list[str] | None = None, tools_in_user_message: bool = True, calls: bool = False) -> Column:
    """Array of struct<role, content> -> text. A leading system message fills the system block; tools are JSON texts.

    Roles `tool` and `ipython` are rendered as tool output. calls: messages have a field `tool_calls` as well, an array of
    struct<name, arguments> with arguments as JSON text; where it is not null the message is rendered as its one call, and
    any other number of calls is an error.
    """
    listed = "".join(t + "\n\n" for t in tools or [])

    def of(m: Column) -> Column:
        first_is_system = F.coalesce(F.get(m, F.lit(0))["role"] == "system", F.lit(False))
        system = F.when(first_is_system, pstrip(F.get(m, F.lit(0))["content"])).otherwise("")
        rest = F.when(first_is_system, F.slice(m, F.lit(2), F.size(m))).otherwise(m)
        head = F.concat(F.lit(BEGIN), header(F.lit("system")), F.lit(("Environment: ipython\n" if tools else "") + CUTOFF + f"Today Date: {date}\n\n"))
        if tools and not tools_in_user_message:
            head = F.concat(head, F.lit(TOOL_SYSTEM + TOOL_FORM + listed))
        head = F.concat(head, system, F.lit(END))

        def body(r: Column) -> Column:
            if tools and tools_in_user_message:
                user = F.when(F.size(r) > 0, pstrip(F.get(r, F.lit(0))["content"])).otherwise(F.raise_error(F.lit("tools need a first user message")).cast("string"))
                start = F.concat(header(F.lit("user")), F.lit(TOOL_USER + TOOL_FORM + listed), user, F.lit(END))
                return F.concat(start, F.array_join(F.transform(F.slice(r, F.lit(2), F.size(r)), one), ""))
            return F.array_join(F.transform(r, one), "")

        return F.concat(head, let(rest, body), header(F.lit("assistant")) if generation_prompt else F.lit(""))

    def one(x: Column) -> Column:
        said = F.when(x["role"].isin("tool", "ipython"), tool_result(x["content"])).otherwise(turn(x["role"], x["content"]))
        if not calls:
            return said
        call, several = F.get(x["tool_calls"], F.lit(0)), F.raise_error(F.lit("a message has to have exactly one tool call")).cast("string")
        return F.when(x["tool_calls"].isNull(), said).when(F.size(x["tool_calls"]) == 1, tool_call(call["name"], call["arguments"])).otherwise(several)

    return let(messages, of)


def messages_of(turns: DataFrame, key: str, order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row per turn -> key, messages in order."""
    collected = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(role).alias("role"), F.col(content).alias("content")))).alias("_m"))
    return collected.select(key, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def strip_prompt(ids: Column, n_prompt: Column) -> Column:
    """Generated ids without those of the prompt."""
    return F.slice(ids, n_prompt + 1, F.greatest(F.lit(0), F.size(ids) - n_prompt))


def pack(rows: DataFrame, key: str, length: Column, limit: int = 2048, seed: str = "42") -> DataFrame:
    """rows with `bin`: rows in a seeded order, laid end to end and cut every `limit` tokens; a row belongs where it ends."""
    total = running_total(rows, order_key(seed, F.col(key)), length.cast("long"), "_upto", (key,))
    return total.withColumn("bin", F.floor((F.greatest(F.col("_upto"), F.lit(1)) - 1) / limit).cast("long")).drop("_upto")
