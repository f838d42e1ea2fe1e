"""Prompt and context text as projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecweave.plans.blocks import BLOCK, MAX_KEY_ROWS, originals, overlapping_blocks, position_in_key

# The chunk variables a template may name, and the question prompt.
CHUNK_VARIABLES = ("content", "document_type", "metadata", "chunk_index", "chunking_strategy")
QUESTION_PROMPT = "Context:\n{context}\n\nQuestion: {question}\nAnswer:"

_VARIABLE = re.compile(r"\{(\w+)\}")


def template_column(template: str, values: dict[str, Column]) -> Column:
    """The template as one concatenation.

    It is taken apart once, before any data is seen, so braces inside a value are
    never read as variables. A name that is not in ``values`` is an error.
    """
    parts: list[Column] = []
    at = 0
    for found in _VARIABLE.finditer(template):
        if found.group(1) not in values:
            raise ValueError(f"unknown template variable {found.group(0)}")
        if found.start() > at:
            parts.append(F.lit(template[at : found.start()]))
        parts.append(F.coalesce(values[found.group(1)].cast("string"), F.lit("")))
        at = found.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def render_prompt(
    df: DataFrame, template: str, variables: dict[str, str] | None = None, out: str = "prompt"
) -> DataFrame:
    """Fill a template from chunk rows; ``metadata`` is rendered as JSON with sorted keys."""
    values = {name: F.col(name) for name in df.columns if name in CHUNK_VARIABLES}
    if "metadata" in df.columns:
        entries = F.map_from_entries(F.array_sort(F.map_entries("metadata")))
        values["metadata"] = F.to_json(entries)
        for name, key in (
            ("document_type", "type"),
            ("chunk_index", "chunk_index"),
            ("chunking_strategy", "chunking_strategy"),
        ):
            values.setdefault(name, F.element_at("metadata", F.lit(key)))
    values.update({name: F.lit(value) for name, value in (variables or {}).items()})
    return df.withColumn(out, template_column(template, values))


def assemble_context(
    results: DataFrame,
    questions: DataFrame,
    sep: str = "\n\n",
    template: str = QUESTION_PROMPT,
    prefix: str = "",
) -> DataFrame:
    """Per query: contents in rank order, each after ``prefix``, and the question prompt around them.

    ``results`` is ranked search output (at most k rows per query); ``questions`` has
    ``query_id, question`` and may have more columns, such as a history, for the template.
    """
    contents = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda r: F.concat(F.lit(prefix), r["content"]))
    context = results.groupBy("query_id").agg(F.array_join(contents, sep).alias("context"))
    joined = questions.join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    values = {c: F.col(c) for c in joined.columns if c not in ("query_id", "prompt")}
    prompt = template_column(template, values)
    return joined.withColumn("prompt", prompt)


def history_window(
    messages: DataFrame,
    n: int = 4,
    conversation: str = "conv_id",
    turn: str = "turn",
    width: int = 100_000,
    max_rows: int = MAX_KEY_ROWS,
    out: str = "history",
) -> DataFrame:
    """The last n messages before each turn as ``role: text`` lines.

    A very long conversation is cut into blocks of ``width`` messages, each with the n
    messages before it.
    """
    coarse = F.floor(F.col(turn) / width)
    placed, cut = position_in_key(messages, [conversation], [F.col(turn)], coarse, max_rows)
    spread = overlapping_blocks(placed, F.col("_pos"), max(width, n), n, cut)
    before = Window.partitionBy(conversation, BLOCK).orderBy("_pos").rowsBetween(-n, -1)
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return originals(
        spread.withColumn("_line", line)
        .withColumn(out, F.array_join(F.collect_list("_line").over(before), "\n"))
    ).drop("_line", "_pos")
