"""Byte-level BPE with the tiktoken library: ids of whole texts from a local rank file, and back to raw bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.llm.frames import packed, quoted, ready, unpacked
from viewforge.llm.tokens import slices

#: Characters of a text that the library splits at a time. Texts are cut at the next safe boundary beyond that.
PART = 1 << 16
#: White space runs of so many characters are taken as the one match they are, without the library's back-tracking.
LONG_RUN = 1 << 12
#: White space as the library's patterns know it (the Unicode property White_Space).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match reaches from a character that is not white space into white space, and none looks behind itself.
_BOUNDARY = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_LONG_SPACE = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")


class Codec:
    """Ids of texts and bytes of ids, by the ranks of a file of base64 tokens and numbers.

    ``pattern`` has to be one that never matches across the start of white space that
    follows something else, and that takes a run of white space but its last character
    as one match, as the public patterns of such vocabularies do.
    """

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimals = [str(i) for i in range(self.encoding.max_token_value + 1)]

    def _short(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def _stretch(self, text: str) -> Iterator[np.ndarray]:
        """Text without long white space, in parts that end at safe boundaries."""
        start = 0
        while len(text) - start > PART:
            cut = _BOUNDARY.search(text, start + PART)
            if cut is None:
                break
            yield self._short(text[start : cut.start()])
            start = cut.start()
        yield self._short(text[start:])

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, the same as without any cut."""
        if len(text) <= PART:
            return self._short(text)
        parts, start = [], 0
        for run in _LONG_SPACE.finditer(text):
            # Before more text the last character of the run belongs to what follows.
            end = run.end() - (run.end() < len(text))
            parts += self._stretch(text[start : run.start()])
            parts.append(np.array(self.encoding._encode_single_piece(text[run.start() : end]), np.uint32))
            start = end
        parts += self._stretch(text[start:])
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())

    def written(self, ids: np.ndarray) -> str:
        """The ids as decimal numbers with commas between them."""
        return ",".join(map(self.decimals.__getitem__, ids.tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


def _ids(value: pa.BinaryScalar) -> np.ndarray:
    raw = value.as_buffer()
    return np.frombuffer(raw, "<u4") if raw is not None else np.zeros(0, "<u4")


def encode_texts(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) in place of every whole text.

    The ids are those of the library over the whole text, each match of ``pattern``
    separately and without special tokens. Null and empty texts have no ids. Every row
    stays, repeated ones too; columns of the names ``n_tokens`` and ``ids`` are replaced;
    an empty table stays empty. ``ranks`` is a path that the workers can open. One pass
    without a shuffle; a worker holds some hundred texts, one of them whole at a time.
    """
    ready(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*([quoted(c) for c in others] or [F.lit(0).alias("none")])).alias("row"), quoted(text).alias("text"))
    fields = [rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in chain.from_iterable(map(slices, batches)):
            ids = [own.encode(t) if t else np.zeros(0, np.uint32) for t in batch.column(1).to_pylist()]
            raw = pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), raw], ["row", "n_tokens", "ids"])

    return unpacked(rows.mapInArrow(run, T.StructType(fields)), others, ["n_tokens", "ids"])


def on_ids(ranks: str, pattern: str, kind: str, take: Callable[[Codec, np.ndarray], bytes | str]) -> Callable:
    """A column function of ids for Spark, by batches; null ids count as none."""

    def run(column: pa.Array) -> pa.Array:
        own = codec(ranks, pattern)
        return pa.array([take(own, _ids(value)) for value in column], pa.binary() if kind == "binary" else pa.string())

    return F.arrow_udf(run, kind)


def decode_ids(docs: DataFrame, ranks: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the raw bytes that ``ids`` stand for as ``to``, which need not be whole UTF-8.

    Null and empty ids have no bytes; an id without a token fails. A column of the name
    ``to`` is replaced.
    """
    ready(docs.sparkSession)
    decoded = on_ids(ranks, pattern, "binary", Codec.decode)(F.col("ids")).alias(to)
    return unpacked(packed(docs, ids=quoted(ids)).select("row", decoded), docs.columns, [to])


def written_ids(docs: DataFrame, ranks: str, pattern: str, ids: str = "ids", to: str = "written") -> DataFrame:
    """``docs`` with ``ids`` as decimal numbers joined by commas as ``to``; none are the empty text."""
    ready(docs.sparkSession)
    written = on_ids(ranks, pattern, "string", Codec.written)(F.col("ids")).alias(to)
    return unpacked(packed(docs, ids=quoted(ids)).select("row", written), docs.columns, [to])
