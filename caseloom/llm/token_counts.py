"""Token counts with a whole-token shortcut (operator 5).

Offline, once: prove, by the library's own merges, which vocabulary strings encode alone as one token. Per document: cut into
pre-tokens; those in the proven set count 1 without any merging, only the rest is merged.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null doc_id is kept; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, sliced
from .tokens import PieceCounts, encoder, whole_tokens

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_merged_pieces long"


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_merged_pieces (pre-tokens outside the shortcut); no shuffle."""
    proven, all_reached = whole_tokens(tokenizer_path)
    whole = docs.sparkSession.sparkContext.broadcast(proven)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(tokenizer_path, not all_reached), whole.value
        counts, pieces, special = PieceCounts(enc, known), enc._pieces, list(enc.special)
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            n_bytes, n_tokens, n_rest = [], [], []
            for t in texts:
                parts = enc._cut.split(t) if any(s in t for s in special) else (t,)
                n_special = len(parts) // 2
                found = pieces(t) if n_special == 0 else list(chain.from_iterable(map(pieces, parts[::2])))
                n_bytes.append(len(t.encode()))
                n_tokens.append(sum(map(counts.__getitem__, found)) + n_special)
                n_rest.append(len(found) - sum(map(known.__contains__, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_rest, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "n_merged_pieces"])

    return id_text(docs).mapInArrow(run, SCHEMA)
