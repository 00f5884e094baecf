"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import load, proof, tokenizer_path
from .common import by_batch, documents_of


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit).
    Repeated rows give repeated results; other columns are ignored; an empty
    table gives no rows. A text of any length is read whole, in one pass."""
    path = vocabulary or tokenizer_path()
    proved = proof(path)

    def make():
        table = load(path, proved)

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [len(table.ids(t)) // 4 for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return count

    return by_batch(documents_of(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
