"""Byte-level BPE against the library on whole texts, and exact round trips."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_operators import SF
from viewforge.llm import byte_pairs, queries

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(queries.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_query_is_the_library_on_whole_texts(spark, library):
    docs = queries.documents(spark, SF).select("doc_id", "text").collect()
    want = set()
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        want.add((doc_id, len(ids), digest(",".join(map(str, ids))), digest((text or "").encode())))
    assert set(map(tuple, queries.op12_byte_pairs(spark, SF).collect())) == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "<|endoftext|> é 中 'll  ", None), (3, "a" * 70_000, "z")]
    docs = spark.createDataFrame(rows, "`doc.id` long, text string, ids string")
    encoded = byte_pairs.encode_texts(docs, queries.RANKS, PATTERN)
    assert encoded.columns == ["doc.id", "n_tokens", "ids"]
    back = byte_pairs.decode_ids(encoded, queries.RANKS, PATTERN, to="n_tokens").collect()
    got = sorted((r["doc.id"] or 0, bytes(r["n_tokens"]).decode()) for r in back)
    assert got == sorted((r[0] or 0, r[1] or "") for r in rows)
    none = byte_pairs.written_ids(byte_pairs.encode_texts(docs.limit(0), queries.RANKS, PATTERN), queries.RANKS, PATTERN)
    assert none.columns == ["doc.id", "n_tokens", "ids", "written"] and none.count() == 0


def test_cuts_change_nothing(library, monkeypatch):
    """Small parts and runs, on texts of signs that the pattern treats differently."""
    monkeypatch.setattr(byte_pairs, "PART", 40)
    monkeypatch.setattr(byte_pairs, "_LONG_SPACE", re.compile(f"[{byte_pairs._SPACE}]{{3,}}"))
    own, draw = byte_pairs.codec(queries.RANKS, PATTERN), random.Random(12)
    signs = ["ab1 '\n\t\x1c\x85 　é中٣!’s_᠎\x0b", " \nx", "' sre"]
    for n in range(1500):
        text = "".join(draw.choice(signs[n % 3]) for _ in range(draw.randint(41, 300)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_decodes_parts_of_characters():
    own = byte_pairs.codec(queries.RANKS, PATTERN)
    ids = own.encode("中")
    assert b"".join(own.decode(ids[i : i + 1]) for i in range(len(ids))) == "中".encode()
    assert own.decode(np.zeros(0, np.uint32)) == b"" and own.written(np.zeros(0, np.uint32)) == ""


@pytest.mark.parametrize("text", [" " * 2_000_000, "x" + "\n" * 2_000_000 + "y", "^" * 1_000_000, "ab" * 500_000, "a'" * 500_000])
def test_very_long_runs(text):
    """The library alone fails on the first two; all take seconds and come back whole."""
    own, start = byte_pairs.codec(queries.RANKS, PATTERN), time.process_time()
    assert own.decode(own.encode(text)) == text.encode()
    assert time.process_time() - start < 20
