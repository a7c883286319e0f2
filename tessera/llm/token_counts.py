"""Token counts by a public byte-level BPE vocabulary.

Arrow functions return lengths only, never token ids. Texts are encoded in batches of
about BATCH bytes. A text above SPLIT characters is cut where the tokenizer's pattern can't
have a piece that spans the cut: before a single blank that stands between a sign other
than white space and a letter. So its parts' counts add up to the whole text's count.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH = 1 << 20
SPLIT = 1 << 16
CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")


def parts(text: str, limit: int = SPLIT) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut at safe places only."""
    at = 0
    while len(text) - at > limit:
        m = CUT.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(2)
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("tessera", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def batches_of(texts: list[str | None], limit: int = BATCH) -> Iterator[tuple[list[str], list[int]]]:
    """Parts of the texts and the rows they are of, in batches of about ``limit`` bytes."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        for p in parts(text or ""):
            held.append(p)
            rows.append(row)
            size += len(p) if p.isascii() else len(p.encode())
            if size >= limit:
                yield held, rows
                held, rows, size = [], [], 0
    if held:
        yield held, rows


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row.

    * A null text has a null count, an empty text 0. Strings of special tokens are text.
    * Repeated rows and ids are counted row by row; a null id stays null.
    * A text of any length is counted whole; one without any safe place isn't cut.
    * Other columns are not read. An empty table gives no rows.

    The vocabulary file is read on the driver and broadcast; it has a fixed size.
    """
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(held.value)
        for b in batches:
            texts = b.column("t").to_pylist()
            counts: list[int | None] = [None if t is None else 0 for t in texts]
            for held_parts, rows in batches_of(texts):
                for row, ids in zip(rows, enc.encode_ordinary_batch(held_parts, num_threads=1), strict=True):
                    if counts[row] is not None:
                        counts[row] += len(ids)
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n_tokens long")
