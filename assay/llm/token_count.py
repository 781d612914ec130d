"""Token counts by rank-synchronous merging of ragged pre-token arrays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm import bpe
from assay.llm.common import map_column

#: Pre-tokens whose counts a worker remembers; at the limit it keeps those of the current slice.
REMEMBERED = 400_000


class Counter:
    """Counts the tokens of texts; new pre-tokens of a slice are merged together as one ragged array."""

    def __init__(self, vocab: bpe.Vocabulary):
        self.vocab, self.known = vocab, {}

    def learn(self, tokens: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {t: self.known[t] for t in set(tokens).intersection(self.known)}
        if new := list(set(tokens).difference(self.known)):
            flat, lengths = bpe.ragged(t.encode() for t in new)
            _, counts = bpe.merge_ragged(self.vocab, self.vocab.of_byte[flat], lengths)
            self.known.update(zip(new, counts.tolist()))

    def count(self, text: str) -> int:
        total = 0
        for piece, special in self.vocab.parts(text):
            if special:
                total += 1
                continue
            for tokens in bpe.pretokens(piece):
                try:
                    total += sum(map(self.known.__getitem__, tokens))
                except KeyError:
                    self.learn(tokens)
                    total += sum(map(self.known.__getitem__, tokens))
        return total

    def counts(self, texts: list[str | None]) -> list[int]:
        # all short texts of a slice are cut first, so that one ragged array holds all their new pre-tokens
        cut = [
            None if not t else bpe.cut(t)
            if len(t) < 4 * bpe.TOKENS_AT_ONCE and not any(s in t for s in self.vocab.special) else t
            for t in texts
        ]
        new: set[str] = set()
        for c in cut:
            if isinstance(c, list):
                new.update(c)
        self.learn(list(new))
        known = self.known.__getitem__
        return [0 if c is None else sum(map(known, c)) if isinstance(c, list) else self.count(c) for c in cut]


def count_tokens(df: DataFrame, vocabulary_path: str, text: str = "text", output: str = "n_tokens") -> DataFrame:
    """Add `output`: the number of tokens of each whole text (a null or empty text has 0).

    Special strings of the file count as one token each, as the tokenizers library counts them by
    default. The vocabulary file is read on the driver and broadcast: its size doesn't depend on the data.
    Repeated rows are counted alike; a column named like `output` is replaced, others stay; an empty table gives an
    empty one. A text of any length is cut as a stream, some hundred thousand pre-tokens at a time.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        counter = Counter(bpe.Vocabulary.of(shared.value))
        return lambda texts: [pa.array(counter.counts(texts.to_pylist()), pa.int64())]

    return map_column(df, text, make, [T.StructField(output, T.LongType())])


def with_budget(df: DataFrame, vocabulary_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    counted = count_tokens(df, vocabulary_path, text)
    return counted.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "over_limit": F.col("n_tokens") > limit,
        }
    )
