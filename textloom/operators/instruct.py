"""Instruction examples from canonical songs. Every draw is a hash of seed, song and task, so examples are the same however the songs are partitioned.

Defined results: a null title counts as an empty one, a null or blank text gives no example, a null key draws as an empty
one; repeated rows give the same examples again; equal keys share a side of the split; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ranks import first_keys, running_total
from textloom.functions.text import at, let, pstrip, uniform

#: Markup of a block, and of its speaker.
BLOCK = r"(?s)(<([A-Z_]+)\s+[^>]*>\n.*?\n</\2>)"
SPEAKER = r"""(?U)speaker=["']?(\w+)["']?"""
MESSAGES = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class Prompts:
    """Wording of the tasks; {theme}, {structure}, {speaker} and {context} are filled in."""

    system: str = "You write songs. Keep to the structure and to the section tags."
    full_song: str = "Write a song.\nTheme: {theme}\nStructure: {structure}\nReturn the canonical format with section tags."
    next_section: str = "Continue the song.\nTheme: {theme}\nWrite the NEXT section. Required voice = {speaker}.\nReturn exactly one tagged block.\n\nCONTEXT:\n{context}"
    chorus: str = "Write one chorus.\nTheme: {theme}\nVoice: {speaker}\nReturn exactly one <CHORUS ...>...</CHORUS> block."
    topics: tuple[str, ...] = ("the city", "the sea", "memory", "winter", "travel", "work")
    default_speaker: str = "group"
    seed: str = "42"
    #: Chances of a topic as theme, of the shorter continuation, and of the chorus task.
    p_topic: float = 0.55
    p_short: float = 0.35
    p_chorus: float = 0.45


def fill(template: str, **values: Column) -> Column:
    """Template with {name} replaced by columns; null is the empty text."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def extract_blocks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(pstrip(F.coalesce(text, F.lit(""))), F.lit(BLOCK), F.lit(1)), pstrip)


def block_speaker(block: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(block, SPEAKER, 1), F.lit("")), F.lit(default))


def pick(options: Column, u: Column) -> Column:
    return at(options, F.floor(u * F.size(options)).cast("int"))


def theme(title: Column, key: Column, task: str, p: Prompts) -> Column:
    topics = F.array(*[F.lit(t) for t in p.topics])
    topic = pick(topics, uniform(p.seed, key, task, "topic"))
    base = pstrip(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s*\([^)]*\)\s*$", ""))
    return F.when((uniform(p.seed, key, task, "theme") < p.p_topic) | (base == ""), topic).otherwise(base)


def chat_example(user: Column, assistant: Column, p: Prompts) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(p.system)), message("user", user), message("assistant", assistant))


def full_song(key: Column, title: Column, structure: Column, text: Column, p: Prompts) -> Column:
    return chat_example(fill(p.full_song, theme=theme(title, key, "full", p), structure=structure), pstrip(text), p)


def next_place(n_blocks: Column, key: Column, task: str, p: Prompts) -> Column:
    """Place of the target block, 1 to n - 1 alike often; null below two blocks."""
    return F.when(n_blocks >= 2, 1 + F.floor(uniform(p.seed, key, task, "place") * (n_blocks - 1)).cast("int"))


def context_blocks(blocks: Column, place: Column, k: int) -> Column:
    return F.slice(blocks, F.greatest(F.lit(1), place - k + 1), F.least(F.lit(k), place))


def next_section(key: Column, title: Column, text: Column, k: int, p: Prompts) -> Column:
    task = f"next{k}"

    def of(blocks: Column) -> Column:
        def placed(i: Column) -> Column:
            target = at(blocks, i)
            user = fill(p.next_section, theme=theme(title, key, task, p), speaker=block_speaker(target, p.default_speaker), context=F.array_join(context_blocks(blocks, i, k), "\n\n"))
            return F.when(i.isNotNull(), chat_example(user, target, p))

        return let(next_place(F.size(blocks), key, task, p), placed)

    return let(extract_blocks(text), of)


def chorus_only(key: Column, title: Column, text: Column, p: Prompts) -> Column:
    def of(choruses: Column) -> Column:
        def chosen(target: Column) -> Column:
            user = fill(p.chorus, theme=theme(title, key, "chorus", p), speaker=block_speaker(target, p.default_speaker))
            return F.when(target.isNotNull(), chat_example(user, target, p))

        return let(pick(choruses, uniform(p.seed, key, "chorus", "pick")), chosen)

    return let(F.filter(extract_blocks(text), lambda b: b.startswith("<CHORUS")), of)


def build_dataset(corpus: DataFrame, key: str, p: Prompts = Prompts()) -> DataFrame:
    """Corpus rows -> key, task, messages, in a seeded order; songs without text give none."""
    k, text = F.col(key).cast("string"), F.col("text")
    tasks = {
        "full": full_song(k, F.col("title"), F.col("structure"), text, p),
        "next2": next_section(k, F.col("title"), text, 2, p),
        "next1": F.when(uniform(p.seed, k, "next1", "draw") < p.p_short, next_section(k, F.col("title"), text, 1, p)),
        "chorus": F.when(uniform(p.seed, k, "chorus", "draw") < p.p_chorus, chorus_only(k, F.col("title"), text, p)),
    }
    made = F.array(*[F.struct(F.lit(name).alias("task"), m.cast(MESSAGES).alias("messages")) for name, m in tasks.items()])
    rows = corpus.filter(pstrip(F.coalesce(text, F.lit(""))) != "").select(key, F.explode(made).alias("_e")).select(key, "_e.task", "_e.messages")
    return shuffled(rows.filter("messages IS NOT NULL"), p.seed, key, "task")


def order_key(seed: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))


def shuffled(rows: DataFrame, seed: str, *keys: str) -> DataFrame:
    """rows in the seeded order, range-sorted over the cluster."""
    return rows.orderBy(order_key(seed, *map(F.col, keys)), *keys)


def seeded_place(rows: DataFrame, seed: str, *keys: str) -> DataFrame:
    """rows with `place`, from 1, in the seeded order."""
    return running_total(rows, order_key(seed, *map(F.col, keys)), F.lit(1).cast("long"), "place", keys)


def train_valid_split(rows: DataFrame, keys: tuple[str, ...], seed: str = "42", ratio: float = 0.05, group: str | None = None) -> DataFrame:
    """rows with `split`: of the seeded order the first max(1, floor(n * ratio)) rows are `valid`, the others `train`.

    group: rows of one group stay together, and the share is of groups.
    """
    unit = (group,) if group else keys
    units = rows.select(*unit).distinct() if group else rows
    first = first_keys(units, order_key(seed, *map(F.col, unit)), ratio, unit)
    return rows.withColumn("split", F.when(first, "valid").otherwise("train"))
