"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a policy is a versioned mask over those bits, so a new policy, or the effect of
leaving one rule out, needs no text again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.llm.arrays import LEAD, SPACE, Rolling, mix, owners, per_row, repeated, text_slices, windows, words_of

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_plain_words", "n_digits", "n_bullet_lines")

# Rules in the order of their bits, as SQL that is true where a document fails; new ones go to the end.
# A document without words fails few_words only: no share can be taken of nothing.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
    "long_words": "word_chars > 40 * n_words",
    "symbols": "n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "marks": "5 * n_plain_words < 4 * n_words",
    "digits": "2 * n_digits > word_chars",
    "bullet_lines": "n_lines > 4 AND 10 * n_bullet_lines > 9 * n_lines",
}
# Policies by version: the names of the rules that decide.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "duplicate_lines", "marks", "digits", "bullet_lines"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
# Words with an ASCII letter or digit, or with any character beyond ASCII; others are marks only.
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BULLET = "•".encode()


def measure_texts(data: np.ndarray, offsets: np.ndarray, hashes: Rolling) -> dict[str, np.ndarray]:
    """The measurements of texts given as bytes; one array entry per text."""
    starts, ends, bounds = words_of(data, offsets)
    out = {"n_words": np.diff(bounds)}
    lead = LEAD[data]
    out["word_chars"] = per_row(lead & ~SPACE[data], offsets)
    out["n_symbols"] = per_row(_SYMBOL[data], offsets)
    out["n_digits"] = per_row(_DIGIT[data], offsets)
    plain = np.concatenate([[0], np.cumsum(_PLAIN[data])])
    out["n_plain_words"] = per_row(plain[ends] > plain[starts], bounds)
    sums = hashes.sums(data)
    # Lines: a text's start, and each place after a line feed; only lines with a word count.
    feed = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([offsets[:-1], feed + 1]), kind="stable")
    line_text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feed, "right") - 1])
    line_text = line_text[np.argsort(np.concatenate([offsets[:-1], feed + 1]), kind="stable")]
    line_ends = np.concatenate([feed, offsets[1:]])
    line_ends = np.sort(line_ends, kind="stable")
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_text = line_starts[worded], line_ends[worded], line_text[worded]
    lines = hashes.spans(sums, line_starts, line_ends) ^ mix(line_text.astype(np.uint64))
    n = len(offsets) - 1
    out["n_lines"] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"] = np.bincount(line_text[repeated(lines)[1]], minlength=n)
    # Lines whose first word begins with "-", "*" or a bullet.
    lead_word = starts[np.searchsorted(starts, line_starts)] if len(line_starts) else line_starts
    padded = np.concatenate([data, np.zeros(len(_BULLET), np.uint8)])
    bullet = (data[lead_word] == 0x2D) | (data[lead_word] == 0x2A)
    bullet |= np.logical_and.reduce([padded[lead_word + i] == b for i, b in enumerate(_BULLET)])
    out["n_bullet_lines"] = np.bincount(line_text[bullet], minlength=n)
    # Windows of five words, compared within their text.
    word = hashes.spans(sums, starts, ends)
    first = windows(bounds, WINDOW)
    key = np.zeros(len(first), np.uint64)
    for k in range(WINDOW):
        key = mix(key + word[first + k])
    text = owners(bounds)
    many = repeated(key ^ mix(text[first].astype(np.uint64)))[0] if len(first) else np.zeros(0, bool)
    edge = np.zeros(len(starts) + WINDOW + 1, np.int64)
    np.add.at(edge, first[many], 1)
    np.add.at(edge, first[many] + WINDOW, -1)
    out["n_repeat_words"] = per_row(np.cumsum(edge)[: len(starts)] > 0, bounds)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Rolling(6)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        for first, end, data, offsets in text_slices(column):
            found = measure_texts(data, offsets, hashes)
            kept = [c.slice(first, end - first) for c in rest]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(found[m].astype(np.int64)) for m in MEASURES],
                names=[*batch.schema.names[:-1], *MEASURES],
            )


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(policy: str | tuple[str, ...]) -> int:
    return reduce(lambda a, r: a | bit(r), POLICIES[policy] if isinstance(policy, str) else policy, 0)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the measurements, and ``fail_bits``: one bit per failed rule.

    One pass without a shuffle. A null or empty text has no words and fails ``few_words``;
    repeated rows each get their own row; other columns are not read.
    """
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]] + [f"{m} bigint" for m in MEASURES])
    measured = chosen.mapInArrow(_measure, schema)
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(c), bit(r)).otherwise(0) for r, c in RULES.items()])
    return measured.withColumn("fail_bits", bits.cast("bigint"))


def apply_policy(rows: DataFrame, policy: str | Mapping | tuple[str, ...] = "v2", name: str = "kept") -> DataFrame:
    """Adds ``name``: no rule of the policy failed."""
    return rows.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that fail nothing else.

    The latter are what the policy would gain by leaving the rule out. One aggregation over
    the ledger's bits; an empty ledger gives zeros.
    """
    mask = policy_mask(policy)
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask))
    aggs = []
    for r in POLICIES[policy]:
        aggs.append(F.count_if(failed.bitwiseAND(F.lit(bit(r))) != 0).alias(f"f_{r}"))
        aggs.append(F.count_if(failed == bit(r)).alias(f"o_{r}"))
    each = [F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in POLICIES[policy]]
    return rows.agg(*aggs).select(F.inline(F.array(*each)))


def keep_documents(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that pass the policy; nothing is shuffled."""
    at = [c.lower() for c in docs.columns].index(text.lower())
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    rows = apply_policy(ledger(plain, f"_c{at}", tuple(plain.columns)), policy)
    return rows.filter("kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
