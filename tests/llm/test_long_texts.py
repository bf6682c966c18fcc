"""Surrogates on texts that repeat one form without end, and where a short format is nearly used up."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from viewforge.llm.surrogates import entities, replace_personal_data

LONG = {
    "letters": ("", "a"),
    "dotted": ("", "a."),
    "digits": ("", "1"),
    "digit groups": ("", "12 "),
    "address parts": ("a@b", ".cc"),
    "hyphens": ("Mr Aa", "-Bb"),
    "titles": ("", "Mr "),
    "short titles": ("", "M. "),
    "colons": ("", "a:"),
    "signs": ("", "@"),
    "open quotes": ("password", "='"),
}


@pytest.mark.parametrize("form", LONG)
def test_entities_of_a_million_characters_take_linear_time(spark, form):
    start, unit = LONG[form]

    def seconds(size: int) -> float:
        docs = spark.createDataFrame([(start + unit * (size // len(unit)),)], "text string")
        begun = time.time()
        docs.select(F.size(entities(F.col("text")))).collect()
        return time.time() - begun

    seconds(1_000)
    assert seconds(1_000_000) < 4 * seconds(500_000) + 5


def test_long_entities_get_surrogates(spark):
    address, hyphens = "a@b" + ".cc" * 5_000, "Mr Aa" + "-Bb" * 4_000
    texts = {1: address, 2: hyphens, 3: "Mr " * 1_000 + "x", 4: "a" * 1_000_000, 5: "1" * 100_000, 6: "x " + address}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: r for r in replace_personal_data(docs, key="k").collect()}
    assert {i: r.n_entities for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1}
    assert got[1].text != address and len(got[1].text) == len(address) and got[6].text == "x " + got[1].text
    assert got[2].text.startswith("Mr ") and got[2].text != hyphens
    assert (got[4].text, got[5].text) == (texts[4], texts[5])


def test_a_format_more_than_half_in_use(spark):
    """Longer addresses follow where all short ones are taken: distinct, and none a real one."""
    real = [f"{a}@{b}.com" for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrstuvwxy"]
    docs = spark.createDataFrame(list(enumerate(real)), "doc_id int, text string")
    got = [r.text for r in replace_personal_data(docs, key="k").collect()]
    assert len(real) == 400 == len(set(got)) and not set(got) & set(real)
    assert all(g.endswith(".com") and g.count("@") == 1 for g in got)


def test_starts_behind_signs_titles_and_other_entities(spark):
    cases = {
        "..foo@x.com": ["foo@x.com"],
        "-" * 600 + "foo@x.com": ["foo@x.com"],
        "Mr Smith-foo@x.com": ["Mr Smith", "foo@x.com"],
        "a@foo@x.com": ["foo@x.com"],
        "Mr Miss x": ["Mr Miss"],
        "Mr Frau Г-н @": ["Mr Frau"],
        "Mr Smith Mr Dr Jones": ["Mr Smith Mr", "Dr Jones"],
        "Mr M. Jones": ["Mr M. Jones"],
        "M. M. x": [],
    }
    docs = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: r.found for r in docs.select("text", entities(F.col("text")).alias("found")).collect()}
    assert got == cases
