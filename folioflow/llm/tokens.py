"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import kept, map_columns, token
from folioflow.sources.tables import table

#: Where the driver finds the rank file; the variable FOLIOFLOW_RANKS or the argument ``path`` name another.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(data: bytes):
    """The tokenizer of a rank file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def document_sizes(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document with at least one token; null texts have none.

    The rank file is read by the driver and sent, so the workers need no copy; its size is that of a vocabulary.
    """
    with open(path or os.environ.get("FOLIOFLOW_RANKS", RANKS), "rb") as f:
        sent, name = spark.sparkContext.broadcast(f.read()), token()
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "source", "text")

    def count(c: dict[str, list]) -> dict[str, list]:
        enc = kept(name, lambda: encoding(sent.value))
        return {"doc_id": c["doc_id"], "source": c["source"], "tokens": [len(enc.encode_ordinary(t)) for t in c["text"]]}

    return map_columns(docs, count, "doc_id bigint, source string, tokens bigint").where("tokens > 0")
