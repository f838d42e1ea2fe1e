"""Model catalogue and quota presets as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Model name, provider, dimensions, input token limit, price per 1,000 tokens, largest batch.
MODELS = [
    ("text-embedding-3-large", "openai", 3072, 8192, 0.00013, 2048),
    ("text-embedding-3-small", "openai", 1536, 8192, 0.00002, 2048),
    ("text-embedding-ada-002", "openai", 1536, 8192, 0.0001, 2048),
    ("amazon.titan-embed-text-v1", "aws_bedrock", 1536, 8192, None, 1),
    ("amazon.titan-embed-text-v2:0", "aws_bedrock", 1024, 8192, None, 1),
    ("cohere.embed-english-v3", "aws_bedrock", 1024, 512, None, 1),
    ("cohere.embed-multilingual-v3", "aws_bedrock", 1024, 512, None, 1),
    ("textembedding-gecko@003", "google_vertex", 768, 3072, None, 250),
    ("textembedding-gecko@002", "google_vertex", 768, 3072, None, 250),
    ("textembedding-gecko@001", "google_vertex", 768, 3072, None, 250),
    ("textembedding-gecko-multilingual@001", "google_vertex", 768, 3072, None, 250),
    ("text-embedding-004", "google_vertex", 768, 3072, None, 250),
    ("text-multilingual-embedding-002", "google_vertex", 768, 3072, None, 250),
    ("ollama/default", "ollama", 768, 8192, 0.0, 1),
    ("lmstudio/default", "lmstudio", 768, 8192, 0.0, 100),
    ("llamacpp/default", "llamacpp", 4096, 8192, 0.0, 50),
]

# What an unlisted model is taken to be.
DEFAULT_DIMENSIONS = 1536
DEFAULT_MAX_INPUT_TOKENS = 8192

# Preset name, requests per minute, tokens per minute, largest burst, strategy.
QUOTA_PRESETS = [
    ("openai_embeddings_tier1", 500, 350000, 100, "sliding_window"),
    ("openai_embeddings_tier2", 5000, 2000000, 500, "sliding_window"),
    ("openai_embeddings_tier3", 5000, 5000000, 1000, "sliding_window"),
    ("azure_openai_standard", 120, 240000, 20, "sliding_window"),
    ("azure_openai_provisioned", 6000, 2000000, 1000, "adaptive"),
    ("aws_bedrock_titan", 2000, 400000, 200, "sliding_window"),
    ("aws_bedrock_cohere", 1000, 200000, 100, "sliding_window"),
    ("google_vertex_gecko", 600, 1000000, 60, "sliding_window"),
    ("local_providers", 1000, None, 100, "sliding_window"),
    ("vector_db_operations", 300, None, 50, "sliding_window"),
    ("conservative", 60, 50000, 10, "sliding_window"),
    ("balanced", 300, 200000, 50, "sliding_window"),
    ("aggressive", 1000, 1000000, 200, "adaptive"),
]


def model_catalog(spark: SparkSession) -> DataFrame:
    """One row per known embedding model."""
    rows = [
        (name, provider, dims, limit, None if price is None else price / 1000, batch, batch > 1)
        for name, provider, dims, limit, price, batch in MODELS
    ]
    return spark.createDataFrame(
        rows,
        "model string, provider string, dimensions int, max_input_tokens int, "
        "cost_per_token double, max_batch_size int, supports_batch boolean",
    )


def quota_presets(spark: SparkSession) -> DataFrame:
    """One row per named request quota."""
    return spark.createDataFrame(
        QUOTA_PRESETS,
        "preset string, requests_per_minute int, tokens_per_minute int, max_burst_requests int, strategy string",
    )
