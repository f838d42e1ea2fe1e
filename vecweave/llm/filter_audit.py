"""How filters act together: what each removes, for every order in which they may be applied.

A document is a mask of the filters it fails. With a mask as a row that is 0 at failed filters
and infinite elsewhere, and an order as the column of its inverse permutation (the step at which
each filter comes), the min-plus product of the two gives the step at which an order removes a
document. Documents are counted by mask first, so the product has 2^filters rows, whatever the
corpus; the steps then say where the counts are scattered.

Null texts are empty and fail only what an empty text fails. A null id is neither smaller nor
larger than another: it never fails the copy filter. Repeated rows count once each; two rows of one
id and one text are not copies of a smaller id. Labels of an id count if any of its label rows
says so. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecweave.llm.components import stored

# Orders are all permutations: 5,040 of them with seven filters.
MAX_FILTERS = 7
NEVER = np.iinfo(np.int32).max // 2
WEIGHTS = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

_SPACE = r"[\x20\x09-\x0D]+"
# Letter and failure condition over words, distinct, capitals, length and text; E is the copy filter.
TEXT_FILTERS: dict[str, str] = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "has_symbol",
}
COPY_FILTER = "E"


def measures(text: Column) -> list[Column]:
    """What the text filters ask for, each over the whole text."""
    words = F.array_remove(F.split(text, _SPACE), "")
    return [
        F.size(words).alias("n_words"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).alias("n_capitals"),
        F.char_length(text).alias("n_chars"),
        text.rlike("[#$%&*|]").alias("has_symbol"),
    ]


def failing(docs: DataFrame, filters: Mapping[str, str], text: str = "text", part: str = "source") -> DataFrame:
    """``_id, _part, _copies, _bits``: one bit per failed text filter, and a key of the text."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col("`doc_id`").alias("_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("_part"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("_copies"),
        *measures(whole),
    )
    bits = [F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    return rows.select("_id", "_part", "_copies", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0)).alias("_bits"))


def masks(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = TEXT_FILTERS, text: str = "text", part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail, at most 2^filters rows a part.

    Texts are read once; what is joined has some 60 bytes a document. The smallest id of each text
    is found by partial aggregation and matched by text *and* id, so however many copies a text
    has, their rows are spread by id.
    """
    rows = stored(failing(docs, filters, text, part), "masks")
    firsts = rows.groupBy("_copies").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    both = rows.join(firsts, ["_id", "_copies"], "left").join(marks, "_id", "left")
    copy = F.col("_first").isNull() & F.col("_id").isNotNull()
    mask = F.col("_bits").bitwiseOR(F.when(copy, 1 << len(filters)).otherwise(0))
    return both.groupBy(F.col("_part").alias("part"), mask.alias("mask")).agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("_good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("_toxic", F.lit(0))).alias("toxic"),
    )


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders (orders x filters), and the step at which each removes each mask (masks x orders), or NEVER."""
    orders = np.array(list(permutations(range(filters))), np.int32).reshape(-1, filters)
    position = np.argsort(orders, axis=1).T + 1
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    cost = np.where(fails == 1, 0, NEVER)
    steps = np.full((1 << filters, len(orders)), NEVER, np.int64)
    for f in range(filters):
        np.minimum(steps, cost[:, f, None] + position[f], out=steps)
    return orders, np.where(steps >= NEVER, NEVER, steps)


def counts_of(weights: np.ndarray, orders: np.ndarray, steps: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of one part (orders x filters) from its documents by mask (masks x WEIGHTS)."""
    n_orders, filters = orders.shape
    which = np.broadcast_to(np.arange(n_orders), steps.shape)
    removed = {}
    for i, name in enumerate(WEIGHTS):
        at = np.zeros((n_orders, filters + 2), np.int64)
        np.add.at(at, (which, np.minimum(steps, filters + 1)), weights[:, i, None])
        removed[name] = at[:, 1 : filters + 1]
    n = weights[:, 0]
    fails = ((np.arange(len(n))[:, None] >> np.arange(filters)) & 1).astype(bool)
    failed = fails.T @ n
    # Of the documents that fail a filter, those not removed by it were removed before it.
    total = np.zeros(filters, np.int64)
    np.add.at(total, orders, removed["n"])
    return {
        "kept": n.sum() - np.cumsum(removed["n"], axis=1),
        "removed": removed["n"],
        "redundant": failed[orders] - removed["n"],
        "unique_fails": n[1 << np.arange(filters)][orders],
        "good_lost": removed["good"],
        "toxic_lost": removed["toxic"],
        "shapley": total[orders],
    }


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """One row per part, order and step, from the counts of ``masks``; bit i is the filter ``letters[i]``."""
    if not 1 <= len(letters) <= MAX_FILTERS:
        raise ValueError(f"between 1 and {MAX_FILTERS} filters, not {len(letters)}")
    each = F.struct("mask", *WEIGHTS)
    parts = counted.groupBy("part").agg(F.collect_list(each).alias("masks"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = removal_steps(len(letters))
        names = np.repeat(["".join(letters[f] for f in o) for o in orders], len(letters))
        step = np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                weights = np.zeros((len(steps), len(WEIGHTS)), np.int64)
                for m in held:
                    weights[m["mask"]] = [m[w] for w in WEIGHTS]
                found = counts_of(weights, orders, steps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(names), pa.string()), pa.array(names.tolist()), pa.array(step)]
                    + [pa.array(found[c].ravel()) for c in COUNTS],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return parts.mapInArrow(rows, schema)


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters, copies included, over whole tables."""
    return audit(masks(docs, labels), "".join(TEXT_FILTERS) + COPY_FILTER)
