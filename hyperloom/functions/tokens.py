"""Token ids by a public byte-pair vocabulary, for examples that a model is trained on.

The vocabulary file is read on the executors from ``HYPERLOOM_TOKENIZERS``; special tokens are plain text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FOLDER = os.environ.get("HYPERLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(rows: DataFrame, key: str, texts: list[str], vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """(key, ids of each text column); null texts stay null, empty ones give no ids."""
    path, kind = f"{folder}/{vocabulary}", dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                ids = ([None if t is None else own.encode_ordinary(t) for t in part.column(1 + k).to_pylist()] for k in range(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in ids)], names=[key, *texts])

    schema = ", ".join([f"`{key}` {kind}", *(f"`{t}` array<int>" for t in texts)])
    return rows.select(key, *texts).mapInArrow(run, schema)
