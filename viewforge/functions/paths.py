"""Partition values as folder names and back, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewforge.model import ESCAPED_PATH_CHARACTERS, NULL_PATH_VALUE


def path_value(value: Column) -> Column:
    """A partition value as its folder name spells it; null and empty text have a name of their own."""
    text = value.cast("string")
    special = "[" + re.escape(ESCAPED_PATH_CHARACTERS) + r"\x01-\x1F]"
    escaped = F.transform(
        F.split(text, ""),
        lambda c: F.when(c.rlike(special), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c),
    )
    named = F.when(text.rlike(special), F.array_join(escaped, "")).otherwise(text)
    return F.when(F.coalesce(text, F.lit("")) == "", NULL_PATH_VALUE).otherwise(named)


def value_of_path(name: Column) -> Column:
    """The text that a folder name stands for; names with a loose percent sign stand for themselves."""
    plain = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(~name.isin("", NULL_PATH_VALUE), F.coalesce(plain, name))
