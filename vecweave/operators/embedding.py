"""Making vectors from texts: validation, batches, providers, cache and cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from time import perf_counter
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vecweave.catalog import DEFAULT_MAX_INPUT_TOKENS, MODELS, model_catalog
from vecweave.functions.hashing import hash32, hashing_vector, mock_vector
from vecweave.functions.text import estimated_tokens, word_count
from vecweave.plans.skew import salted_join
from vecweave.schemas import RESULT
from vecweave.session import shared_dir, stored

Embedder = Callable[[Sequence[str]], "Sequence[Sequence[float]] | Embedded"]
# Fixed value: tokens are estimated from words.
TOKENS_PER_WORD = 1.3
ProviderFactory = Callable[..., Embedder]

# Rows that one task numbers.
ROWS_PER_BUCKET = 250_000

_providers: dict[str, ProviderFactory] = {}


def register_provider(name: str, factory: ProviderFactory) -> None:
    """Make ``factory(model, **options) -> embed(texts)`` available under a name."""
    if not callable(factory):
        raise TypeError("a provider factory must be callable")
    _providers[name] = factory


def provider_names() -> list[str]:
    return sorted(_providers)


def embed_mock(df: DataFrame, dim: int = 8, text: str = "text", out: str = "embedding") -> DataFrame:
    """Pseudo-random vectors that depend only on the text."""
    return df.withColumn(out, mock_vector(F.col(text), dim))


def embed_hashing(df: DataFrame, dim: int = 64, text: str = "text", out: str = "embedding") -> DataFrame:
    """Offline vectors whose cosine reflects shared words. Row-local: no shuffle."""
    return df.withColumn(out, hashing_vector(F.col(text), dim))


def validate_inputs(df: DataFrame, text: str = "text", model: str = "model") -> DataFrame:
    """Flag null and blank texts and texts over the model's input limit."""
    limits = F.broadcast(model_catalog(df.sparkSession).select(F.col("model").alias(model), "max_input_tokens"))
    value = F.col(text)
    tokens = F.coalesce(estimated_tokens(word_count(value)), F.lit(0))
    return (
        df.join(limits, model, "left")
        .withColumn("max_input_tokens", F.coalesce("max_input_tokens", F.lit(DEFAULT_MAX_INPUT_TOKENS)))
        .withColumn("is_null", value.isNull())
        .withColumn("is_blank", F.coalesce(~value.rlike(r"(?U)\S"), F.lit(False)))
        .withColumn("est_tokens", tokens)
        .withColumn("too_long", F.col("est_tokens") > F.col("max_input_tokens"))
        .withColumn("valid", ~(F.col("is_null") | F.col("is_blank") | F.col("too_long")))
    )


def number_batches(
    df: DataFrame, batch_size: int, id_column: str = "id", buckets: int | None = None, max_batch_size: int | None = None
) -> DataFrame:
    """Give each row a ``batch_id`` and its place in the batch.

    Rows are numbered inside hash buckets of their id, so no task numbers the whole
    table; only the last batch of a bucket may be short. Buckets hold about ``ROWS_PER_BUCKET`` rows, so
    batch ids depend on the rows and not on the cluster. ``max_batch_size`` is the provider's own limit.
    """
    size = min(batch_size, max_batch_size) if max_batch_size else batch_size
    if size < 1:
        raise ValueError("batch_size must be at least 1")
    n = buckets or max(1, -(-df.count() // ROWS_PER_BUCKET))
    key = F.col(id_column).cast("string")
    in_bucket = Window.partitionBy("_bucket").orderBy(id_column)
    return (
        df.withColumn("_bucket", hash32(key) % n)
        .withColumn("_rn", F.row_number().over(in_bucket) - 1)
        .withColumn("batch_id", F.concat_ws("-", F.col("_bucket"), F.floor(F.col("_rn") / size)))
        .withColumn("batch_pos", (F.col("_rn") % size).cast("int"))
        .drop("_bucket", "_rn")
    )


def plan_batches(
    df: DataFrame,
    batch_size: int = 100,
    model: str = "text-embedding-3-small",
    text: str = "text",
    id_column: str = "id",
    buckets: int | None = None,
    max_batch_size: int | None = None,
) -> DataFrame:
    """One row per planned batch: size, estimated tokens, status ``pending``."""
    numbered = number_batches(
        df.select(id_column, word_count(F.col(text)).alias("_words")), batch_size, id_column, buckets, max_batch_size
    )
    return numbered.groupBy("batch_id").agg(
        F.lit(model).alias("model"),
        F.count(F.lit(1)).cast("int").alias("n_chunks"),
        estimated_tokens(F.sum("_words")).alias("est_tokens"),
        F.lit("pending").alias("status"),
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        F.lit(None).cast("string").alias("error"),
    )


@dataclass(frozen=True)
class Embedded:
    """What a provider may return in place of plain vectors: vectors in the order of the texts, and what they cost."""

    vectors: Sequence[Sequence[float]]
    token_usage: dict[str, int] | None = None


class _Caller:
    """Calls one provider for lists of texts; remembers each call that decides about a text."""

    def __init__(self, embed: Embedder, size: int, on_error: str):
        self.embed, self.size, self.on_error = embed, size, on_error
        self.calls: list[tuple] = []

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """``vector, status, error, attempts`` of each text."""
        rows: list[tuple] = [(None, "failed", "text is null", 0)] * len(texts)
        present = [i for i, t in enumerate(texts) if t is not None]
        for s in range(0, len(present), self.size):
            part = present[s : s + self.size]
            for i, got in zip(part, self._batch([texts[j] for j in part])):
                rows[i] = got
        return rows

    def _batch(self, texts: list[str]) -> list[tuple]:
        try:
            return [(v, "completed", None, 1) for v in self._call(texts)]
        except Exception:
            if self.on_error == "raise":
                raise
        out = []
        for t in texts:
            started = perf_counter()
            try:
                out.append((self._call([t])[0], "completed", None, 2))
            except Exception as e:  # the error belongs in the row
                self.calls.append((False, 0, perf_counter() - started, None, str(e)))
                out.append((None, "failed", str(e), 2))
        return out

    def _call(self, texts: list[str]) -> Sequence[Sequence[float]]:
        started = perf_counter()
        made = self.embed(texts)
        vectors, usage = (made.vectors, made.token_usage) if isinstance(made, Embedded) else (made, None)
        vectors = list(vectors)
        if len(vectors) != len(texts):
            raise ValueError(f"provider returned {len(vectors)} vectors for {len(texts)} texts")
        if usage is None:
            usage = {"total_tokens": int(sum(len(t.split()) for t in texts) * TOKENS_PER_WORD)}
        self.calls.append((True, len(texts), perf_counter() - started, usage, None))
        return vectors


_ADDED = T.StructType(
    [
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)


def _embedding_stage(df, provider, model, batch_size, text, concurrency, on_error, max_batch_size, options, accounted):
    """Payload rows with what was made of them; with ``accounted`` also a row per provider call, told apart by ``_call``."""
    if provider not in _providers:
        raise ValueError(f"unknown provider {provider!r}; registered: {', '.join(provider_names())}")
    if on_error not in ("mark", "raise"):
        raise ValueError(f"unknown on_error {on_error!r}")
    factory = _providers[provider]
    # What the catalogue says about a model holds unless the caller knows better.
    cap = max_batch_size or {m[0]: m[5] for m in MODELS}.get(model)
    size = min(batch_size, cap) if cap else batch_size
    if size < 1:
        raise ValueError("batch_size must be at least 1")
    payload = [f for f in df.schema.fields if f.name not in _ADDED.names]
    source = df.repartition(concurrency) if concurrency else df
    if text not in [f.name for f in payload]:
        raise ValueError(f"no column {text}")
    fields = payload + _ADDED.fields
    call_type = T.StructType.fromDDL(RESULT)
    call_names = call_type.names
    if accounted:
        fields = [T.StructField(f.name, f.dataType, True) for f in fields] + [T.StructField("_call", call_type)]
    arrow = to_arrow_schema(T.StructType(fields))
    names = [f.name for f in payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = _Caller(factory(model, **options), size, on_error)
        for batch in batches:
            found = caller(batch.column(batch.schema.get_field_index(text)).to_pylist())
            vectors, statuses, errors, attempts = zip(*found) if found else ((), (), (), ())
            models = [model if s == "completed" else None for s in statuses]
            made = [pa.array(c, f.type) for c, f in zip((vectors, models, statuses, errors, attempts), list(arrow)[len(names) :])]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names] + made
            if not accounted:
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)
                continue
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(batch.num_rows, arrow.field("_call").type)], names=arrow.names)
            if caller.calls:
                rows = [dict(zip(call_names, (uuid4().hex, *c))) for c in caller.calls]
                calls = pa.array([r | {"token_usage": list((r["token_usage"] or {}).items())} for r in rows], arrow.field("_call").type)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), f.type) for f in list(arrow)[:-1]] + [calls], names=arrow.names)
                caller.calls.clear()

    return source.mapInArrow(run, T.StructType(fields))


def embed_with(
    df: DataFrame,
    provider: str,
    model: str,
    batch_size: int = 100,
    text: str = "text",
    concurrency: int | None = None,
    on_error: str = "mark",
    max_batch_size: int | None = None,
    **options: object,
) -> DataFrame:
    """Call a registered provider batch by batch inside the tasks.

    Each partition builds one client. Rows keep their order; other columns pass as Arrow arrays
    and only texts become Python values. A batch holds no more texts than the catalogue
    allows the model. A batch that fails is retried text by text; a text that still fails keeps a
    null vector, status ``failed`` and the error. With ``on_error="raise"`` the failure ends
    the task instead and Spark's task retry applies.
    """
    return _embedding_stage(df, provider, model, batch_size, text, concurrency, on_error, max_batch_size, options, False)


def embed_accounted(
    df: DataFrame,
    provider: str,
    model: str,
    batch_size: int = 100,
    text: str = "text",
    concurrency: int | None = None,
    on_error: str = "mark",
    max_batch_size: int | None = None,
    **options: object,
) -> tuple[DataFrame, DataFrame]:
    """``embed_with``, and a results table (``schemas.RESULT``) with one row per provider call.

    Both come from one pass, written to the shared folder by kind, so reading either asks the provider
    nothing again. Token usage is what the provider reports (``Embedded``), else estimated from words. A
    batch that failed is in the table as the calls for its single texts.
    """
    rows = _embedding_stage(df, provider, model, batch_size, text, concurrency, on_error, max_batch_size, options, True)
    path = shared_dir(df.sparkSession, "embedded")
    rows.withColumn("_kind", F.when(F.col("_call").isNull(), "text").otherwise("call")).write.partitionBy("_kind").parquet(path)
    both = df.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("_kind", T.StringType())])).parquet(path)
    return both.filter("_kind = 'text'").drop("_kind", "_call"), both.filter("_kind = 'call'").select("_call.*")


def failed_rows(embedded: DataFrame) -> DataFrame:
    return embedded.filter(F.col("status") == "failed")


def embed_cached(
    df: DataFrame,
    cache: DataFrame | None,
    embed: Callable[[DataFrame], DataFrame],
    id_column: str = "id",
    text: str = "text",
) -> DataFrame:
    """Embed each distinct text once and reuse cached vectors.

    ``cache`` has ``text_key, embedding``; ``embed`` maps a frame with ``text_key`` and
    the text column to one with ``embedding``. Distinct texts are found with partial
    aggregation and looked up in one join, in which texts do not travel; only those that are
    not cached are embedded, and their vectors are written to the shared folder before anything
    else reads them. So a provider is asked once per distinct text, whatever is done with the
    result or with ``cache_entries``. A text repeated very often is salted when its vector is joined back.
    """
    keyed = df.withColumn("text_key", F.md5(text))
    keys = keyed.select("text_key").filter(F.col("text_key").isNotNull()).distinct()
    if cache is None:
        known = None
        texts = keyed.filter(F.col("text_key").isNotNull())
    else:
        held = cache.filter(F.size("embedding") > 0).groupBy("text_key").agg(F.any_value("embedding").alias("embedding"))
        looked = stored(keys.join(held, "text_key", "left"), "cache-lookup")
        known = looked.filter(F.col("embedding").isNotNull())
        missing = looked.filter(F.col("embedding").isNull()).select("text_key")
        texts = keyed.join(missing, "text_key", "left_semi")
    # The key is made of the text, so any row of a key has it.
    texts = texts.groupBy("text_key").agg(F.any_value(text).alias(text))
    made = stored(embed(texts).select("text_key", "embedding"), "fresh-vectors").withColumn("cache_hit", F.lit(False))
    vectors = made if known is None else made.unionByName(known.withColumn("cache_hit", F.lit(True)))
    return salted_join(keyed, vectors, "text_key", F.col(id_column))


def cache_entries(embedded: DataFrame) -> DataFrame:
    """Rows to add to the cache after a run."""
    fresh = embedded.filter(~F.col("cache_hit") & (F.size("embedding") > 0))
    return fresh.groupBy("text_key").agg(F.any_value("embedding").alias("embedding"))


def with_cost(used: DataFrame, catalog: DataFrame, model: str = "model") -> DataFrame:
    """Add ``cost`` to rows with ``tokens``; an unknown model costs nothing."""
    prices = catalog.select(F.col("model").alias(model), "cost_per_token")
    return (
        used.join(F.broadcast(prices), model, "left")
        .withColumn("cost", F.col("tokens") * F.coalesce("cost_per_token", F.lit(0.0)))
        .drop("cost_per_token")
    )


def embedding_usage(df: DataFrame, by: list[str], text: str = "text", model: str = "model") -> DataFrame:
    """Estimated tokens and their price per model and ``by``."""
    used = df.groupBy(model, *by).agg(
        F.count(F.lit(1)).alias("n_texts"),
        estimated_tokens(F.sum(word_count(F.col(text)))).alias("tokens"),
    )
    return with_cost(used, model_catalog(df.sparkSession), model)


def check_dimensions(df: DataFrame, expected: int | Column, vector: str = "embedding") -> DataFrame:
    """Rows whose vector does not have the expected length."""
    want = F.lit(expected) if isinstance(expected, int) else expected
    actual = F.size(vector)
    return df.filter(F.col(vector).isNotNull() & (actual != want)).withColumn("dimensions", actual)


# Built-in providers. They give the same vectors as the native columns.


def _mock_provider(model: str, dim: int = 8) -> Embedder:
    from hashlib import md5

    def embed(texts: Sequence[str]) -> list[list[float]]:
        def number(seed: str, i: int) -> int:
            return int(md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16)

        seeds = [md5(t.encode()).hexdigest() for t in texts]
        return [[number(s, i) / 2**31 - 1.0 for i in range(dim)] for s in seeds]

    return embed


def _hashing_provider(model: str, dim: int = 64) -> Embedder:
    from hashlib import md5

    import numpy as np
    import regex

    separator = regex.compile(r"[^\p{L}\p{N}]+")
    seen: dict[str, int] = {}

    def code(token: str) -> int:
        if token not in seen:
            if len(seen) > 1_000_000:
                seen.clear()
            seen[token] = int(md5(token.encode()).hexdigest()[:8], 16)
        return seen[token]

    def one(text: str) -> list[float]:
        counts = np.zeros(dim)
        for token in separator.split(text.lower()):
            if token:
                h = code(token)
                counts[h % dim] += 1 if (h // dim) % 2 == 0 else -1
        length = np.sqrt((counts * counts).sum())
        if length == 0:
            raise ValueError("text has no direction")
        return (counts / length).tolist()

    return lambda texts: [one(t) for t in texts]


register_provider("mock", _mock_provider)
register_provider("hashing", _hashing_provider)
