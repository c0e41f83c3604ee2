"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only.

The tokenizer drops white space before it forms tokens, so a text may be cut at any ASCII
white space, and next to an ASCII digit (each digit is a token of its own), without changing
its count. Every text is cut there; the distinct pieces of an Arrow batch are encoded once, in
calls balanced by bytes, and a text's count is the sum over its pieces. Nothing but integers
leaves the worker.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, once, table, whole_text

#: A piece without white space that is longer than this is cut next to digits where it has some.
PIECE_BYTES = 16 << 10
#: Bytes of one call of the encoder.
CALL_BYTES = 256 << 10
#: Pieces whose counts a worker remembers.
REMEMBERED = 300_000

_BESIDE_DIGIT = re.compile(rb"(?<=[0-9])(?=[\x21-\x7e])|(?<=[\x21-\x7e])(?=[0-9])")


def pieces(text: bytes, piece_bytes: int = PIECE_BYTES) -> list[bytes]:
    """The text cut at safe boundaries; together with the dropped white space it is the whole text."""
    out = text.split()
    if len(text) <= piece_bytes or max(map(len, out), default=0) <= piece_bytes:
        return out
    cut: list[bytes] = []
    for piece in out:
        start = last = 0
        for at in (m.start() for m in _BESIDE_DIGIT.finditer(piece)) if len(piece) > piece_bytes else ():
            if at - start > piece_bytes and last > start:
                cut.append(piece[start:last])
                start = last
            last = at
        if start < last and len(piece) - start > piece_bytes:
            cut.append(piece[start:last])
            start = last
        cut.append(piece[start:])
    return cut


def balanced(items: list[bytes], call_bytes: int = CALL_BYTES) -> list[list[bytes]]:
    """The items in lists of about equal bytes: the largest first, each to the list with least."""
    total = sum(map(len, items))
    n = max(1, -(-total // call_bytes))
    if n == 1:
        return [items] if items else []
    items = sorted(items, key=len, reverse=True)
    # dealt back and forth, which for many small pieces is as even as a heap
    lists: list[list[bytes]] = [[] for _ in range(n)]
    for k in range(0, len(items), n):
        row = items[k : k + n]
        for to, item in zip(lists if (k // n) % 2 == 0 else lists[::-1], row, strict=False):
            to.append(item)
    return [x for x in lists if x]


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of each text under the tokenizer file; null counts as the empty text, zero tokens."""
    known: dict[bytes, int] = {}
    encoders: list = []

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        if not encoders:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            encoders.append(Tokenizer.from_file(tokenizer))
        cut = [pieces(t) for t in texts.cast(pa.binary()).to_pylist()]
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list(set().union(*cut) - known.keys())
        for call in balanced(fresh):
            found = encoders[0].encode_batch_fast([p.decode() for p in call], add_special_tokens=False)
            known.update(zip(call, map(len, found), strict=True))
        return pa.array([sum(map(known.__getitem__, p)) for p in cut], pa.int64())

    return once(count)(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; columns of these names are replaced.

    A null text is the empty one (0 bytes, 0 tokens). Repeated rows are counted each.
    """
    bound_batches(docs.sparkSession)
    counted = docs.withColumn("n_tokens", token_count(F.col(text), tokenizer))
    return counted.withColumn("n_bytes", F.octet_length(whole_text(text)).cast("long")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
