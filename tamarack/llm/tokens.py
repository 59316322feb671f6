"""Token counts by a public tokenizer, as one Arrow pass."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.runtime import spread

#: Ranks of a byte-level BPE for many languages: a path on the driver, from where executors that lack it get the file.
VOCABULARY = os.environ.get("TAMARACK_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Fixed value: how byte-level BPE splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points encoded at a time: the encoder's time grows faster than a very long run without spaces.
RUN = 100_000

_encoders: dict[str, object] = {}
_shipped: set[tuple[str, str]] = set()


def encoder(vocabulary: str):
    if vocabulary not in _encoders:
        import tiktoken

        if not os.path.exists(vocabulary):
            from pyspark import SparkFiles

            path = SparkFiles.get(os.path.basename(vocabulary))
        else:
            path = vocabulary
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    own = encoder(vocabulary)
    if len(text) <= RUN:
        return len(own.encode_ordinary(text))
    return sum(len(own.encode_ordinary(text[i : i + RUN])) for i in range(0, len(text), RUN))


def with_tokens(df: DataFrame, keep: list[str], text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``. A NULL or empty text has 0 tokens. Texts of over ``RUN`` code points are
    encoded in runs of that length, which can add one token a run."""

    context = df.sparkSession.sparkContext
    if (context.applicationId, vocabulary) not in _shipped and os.path.exists(vocabulary):
        context.addFile(vocabulary)
        _shipped.add((context.applicationId, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(t, vocabulary) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return spread(rows).mapInArrow(run, f"{kinds}, tokens bigint")
