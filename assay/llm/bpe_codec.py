"""BPE encoding and decoding, with fragments cut where no vocabulary token can reach across."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm import bpe
from assay.llm.common import fresh, map_column

#: Pre-tokens whose ids a worker remembers; at the limit it keeps those of the current slice.
REMEMBERED = 300_000


class Codec:
    """Encodes and decodes texts.

    A pair of bytes that occurs inside no vocabulary token is a forced boundary: no token covers both
    bytes, so no merge ever crosses. Pre-tokens are cut there, the fragments are merged independently, and
    the ids of a pre-token are those of its fragments in order.
    """

    def __init__(self, vocab: bpe.Vocabulary):
        self.vocab, self.known = vocab, {}

    def learn(self, tokens) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {t: self.known[t] for t in set(tokens).intersection(self.known)}
        new = list(set(tokens).difference(self.known))
        if not new:
            return
        flat, lengths = bpe.ragged(t.encode() for t in new)
        ends = np.cumsum(lengths)
        cut = np.zeros(len(flat) + 1, bool)
        cut[1:-1] = self.vocab.never_adjacent[flat[:-1], flat[1:]]
        cut[ends] = cut[0] = True
        at = np.flatnonzero(cut)
        ids, counts = bpe.merge_ragged(self.vocab, self.vocab.of_byte[flat], np.diff(at))
        up_to = np.r_[0, np.cumsum(counts)][np.searchsorted(at, ends)]  # ids before the end of each pre-token
        raw, start = ids.astype(np.int32).tobytes(), 0
        for token, end in zip(new, (4 * up_to).tolist()):
            self.known[token] = raw[start:end]
            start = end

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        out = []
        for piece, special in self.vocab.parts(text):
            if special:
                out.append(np.int32(self.vocab.special[piece]).tobytes())
                continue
            for tokens in bpe.pretokens(piece):
                try:
                    out.append(b"".join(map(self.known.__getitem__, tokens)))
                except KeyError:
                    self.learn(tokens)
                    out.append(b"".join(map(self.known.__getitem__, tokens)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        # all short texts are cut first, so that the new pre-tokens of the slice are merged together
        cut = [
            bpe.cut(t)
            if t and len(t) < 4 * bpe.TOKENS_AT_ONCE and not any(s in t for s in self.vocab.special) else t or ""
            for t in texts
        ]
        new: set[str] = set()
        for c in cut:
            if isinstance(c, list):
                new.update(c)
        self.learn(new)
        known = self.known.__getitem__
        raw = []
        for c in cut:
            raw.append(b"".join(map(known, c)) if isinstance(c, list) else self.encode(c))
            known = self.known.__getitem__
        offsets = np.r_[0, np.cumsum([len(r) // 4 for r in raw])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        return pa.array([self.decode(x.values.to_numpy()) if x.is_valid else None for x in ids], pa.string())


def _broadcast(df: DataFrame, vocabulary_path: str):
    """The file is read on the driver: its size doesn't depend on the data."""
    with open(vocabulary_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", output: str = "ids") -> DataFrame:
    """Add `output`, the ids of each whole text; a null or empty text has an empty array.

    Equal texts have equal ids. Other columns stay, but for one named like `output`; an empty table gives an empty one. A
    text of any length is cut as a stream, and its ids are held in one task.
    """
    shared = _broadcast(df, vocabulary_path)

    def make():
        codec = Codec(bpe.Vocabulary.of(shared.value))
        return lambda texts: [codec.encode_all(texts.to_pylist())]

    return map_column(df, text, make, [T.StructField(output, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Add `output`, the text of each array of ids; null for a null array. Special ids give their strings;
    bytes that are not UTF-8 give U+FFFD. An id outside the vocabulary is an error."""
    shared = _broadcast(df, vocabulary_path)

    def make():
        codec = Codec(bpe.Vocabulary.of(shared.value))
        return lambda values: [codec.decode_all(values.cast(pa.list_(pa.int32())))]

    raw = fresh(df, "raw")
    return _map_lists(df.withColumn(raw, F.col(ids)), raw, make, output)


def _map_lists(df: DataFrame, column: str, make, output: str) -> DataFrame:
    keep = [f for f in df.schema.fields if f.name.lower() not in (column.lower(), output.lower())]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(output, T.StringType())])

    def run(batches):
        kernel = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                old = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*old, *kernel(part.column(part.schema.get_field_index(column)))], names=schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary_path: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ids and decoded (the text that the ids stand for; empty for a null or empty one) in one pass over the texts.

    What encode says of odd rows holds here as well; columns named ids or decoded are replaced.
    """
    shared = _broadcast(df, vocabulary_path)

    def make():
        codec = Codec(bpe.Vocabulary.of(shared.value))

        def kernel(texts):
            ids = codec.encode_all(texts.to_pylist())
            return [ids, codec.decode_all(ids)]

        return kernel

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_column(df, text, make, fields, drop)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    return df.withColumns(
        {
            "n_tokens": F.size(ids).cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256),
            "decoded_sha256": F.sha2(F.col(decoded), 256),
        }
    )
