"""Secret scans: name-literal pairs of source and configuration text, scored by the name they are assigned to."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.llm.frames import quoted, ready, unpacked

#: The base patterns; order of kinds settles the order of spans at one place.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")  # noqa: E501
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "named"]
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("name", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
#: A name, its type if declared, an assignment sign, and what follows: literals and names joined by plus signs.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: A name is looked for once per run of its characters: what may follow it cannot begin inside the run.
_RUN = r"(?<![A-Za-z0-9_.\-])[0-9.\-]*+"
_PREFIX = r"(?:[bBfFrRuU]{1,2}|u8|[L@$])?"
_STRING = (
    rf'{_PREFIX}(?:"{{3}}(?:[^"\\]|\\[\s\S]|"(?!""))*"{{3}}|\'{{3}}(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'{{3}}'
    r'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'
)
#: Names of types, with parameters, alternatives and marks of references; a declared value is a string or stands apart.
_TYPE = r"(?:&(?:'\w+[ \t]+)?)?[A-Za-z_][\w.]*(?:\[[^\n=]{0,60}\]|<[^\n=]{0,60}>)?\??(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]*){0,4}"
_TYPED = rf"""(?:\[\d*\]|[?!]?[ \t]*:[ \t]*(?P<type>{_TYPE})|[ \t]+(?:string|String))(?:[ \t]*=[ \t]*(?={_PREFIX}["'])|[ \t]+=[ \t]+)"""
#: Unquoted values; a plus sign is part of them unless a string follows it.
_BARE = rf"""(?:[^\s"',;(){{}}\[\]+]|\+(?![ \t]*{_PREFIX}["']))+"""
PAIR = re.compile(
    rf"""{_RUN}(?P<name>{_NAME})["'\]]*(?:{_TYPED}|[ \t]*(?::=|=>|=|:))[ \t]*(?P<value>(?:{_STRING}|{_BARE})(?:[ \t]*\+[ \t]*(?:{_STRING}|{_NAME}))*)"""
)
TERM = re.compile(rf"{_STRING}|[^\s+\"']+")
#: Prefix, quotes and body of a string.
QUOTED = re.compile(r"""([A-Za-z0-9@$]*)("{3}|'{3}|"|')([\s\S]*)\2""")
#: What format strings put in.
FIELDS = re.compile(r"\{[^{}]*\}")
#: Parts of sensitive names and how much each tells.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "key": 0.4,
}
#: Values that stand for no value.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|example|changeme|todo|your.*|<.*>|\$\{?.*|%.*%)$")
THRESHOLD, LEAST, BLANKS = 0.6, 8, 0.85
#: The share of changes between classes, and the length, from which a literal looks random.
MIXED, LONG = 0.35, 16


def base_spans(text: str) -> list[tuple[int, str, int, str | None, float]]:
    """Spans of the base patterns: leftmost matches of each kind, those that are too short dropped."""
    found = [(m.start(), "assign", m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), "access", m.end(), None, 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), "hex", m.end(), None, 1.0) for m in HEX.finditer(text) if m.end() - m.start() >= 32]


def name_score(name: str) -> float:
    """How sensitive a target name is: its parts at signs and changes of case, and neighbouring parts joined."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    joined = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def value_score(value: str) -> float:
    """How much a literal looks like a secret: long enough, no placeholder, with many different characters, rather without blanks."""
    if len(value.strip()) < LEAST or PLACEHOLDERS.match(value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    blanks = BLANKS if any(map(str.isspace, value.strip())) else 1.0
    return min(1.0, entropy / 4) * (0.7 + 0.1 * classes) * blanks


def randomness(value: str) -> float:
    """How often neighbouring letters and digits change their class, from 0 to 1; names, words and dates change seldom.

    A capital before a small letter may begin a word and is no change.
    """
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " for c in value)
    changes = sum(a != b and " " not in (a, b) and (a, b) != ("A", "a") for a, b in zip(kinds, kinds[1:], strict=False))
    return min(1.0, changes / len(value) / MIXED) * min(1.0, len(value) / LONG) if value else 0.0


def pair_score(name: str, value: str) -> float:
    """What name and literal tell together; a random-looking literal makes up for a name that tells little."""
    told = name_score(name)
    return (told + (1 - told) * randomness(value)) * value_score(value) if told else 0.0


def named_spans(text: str) -> Iterator[tuple[int, str, int, str | None, float]]:
    """Literals assigned to sensitive names, directly or through names that hold constants."""
    if "=" not in text and ":" not in text:
        return
    constants: dict[str, tuple[str, int, int]] = {}
    for m in PAIR.finditer(text):
        terms = [(t[0], m.start("value") + t.start(), m.start("value") + t.end()) for t in TERM.finditer(m["value"])]
        quoted_terms = [QUOTED.fullmatch(term) for term, _, _ in terms]
        if not any(quoted_terms) and not any(term in constants for term, _, _ in terms):
            # Plus signs without a literal or a constant beside them belong to the value.
            bare = re.match(r"\S+", m["value"])[0]
            terms, quoted_terms = [(bare, m.start("value"), m.start("value") + len(bare))] if bare == m["value"] else [], [None]
        parts, places = [], []
        for (term, start, end), string in zip(terms, quoted_terms, strict=False):
            if string:
                parts.append(FIELDS.sub("", string[3]) if "f" in string[1].lower() else string[3])
                places.append((start + string.start(3), start + string.end(3)))
            elif term in constants:
                value, *place = constants[term]
                parts.append(value)
                places.append(tuple(place))
            elif len(terms) == 1:
                parts.append(term)
                places.append((start, end))
        value = "".join(parts)
        if not value:
            continue
        # A sum of literals is one constant; its span is that of its first part where the parts lie apart.
        together = all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
        start, end = (places[0][0], places[-1][1]) if together else places[0]
        constants[m["name"]] = (value, start, end)
        # ``a: b="..."`` declares ``a`` or sets ``b``: the name that tells more counts.
        name = max(m["name"], m["type"] or "", key=name_score)
        score = pair_score(name, value)
        if score >= THRESHOLD:
            yield start, "named", end, name, round(score, 4)


def spans(text: str | None) -> list[dict]:
    """All spans in order of start, then kind; places are code points, ends exclusive."""
    if not text:
        return []
    found = set(base_spans(text)) | set(named_spans(text))
    ordered = sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2], -s[4], s[3] or ""))
    kept = {(s[0], s[1], s[2]): s for s in reversed(ordered)}
    return [{"kind": k, "start": a, "end": b, "name": n, "score": v} for a, k, b, n, v in sorted(kept.values(), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))]


def scan_secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all but the text unless given) and ``secrets``: kind, start, end, target name and score.

    ``assign``, ``access`` and ``hex`` are the base patterns; ``named`` are the literals that the lexer finds
    behind sensitive names in assignments, mappings and settings, through constants and sums of constants too.
    Null and empty texts have none; repeated rows are scanned each; a column named ``secrets`` is replaced; an
    empty table gives an empty result. Nothing is shuffled; a task holds one batch of texts.
    """
    ready(docs.sparkSession)
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    rows = docs.select(F.struct(*([quoted(c) for c in carry] or [F.lit(0).alias("none")])).alias("row"), quoted(text).alias("text"))
    kind = T.StructType([rows.schema["row"], T.StructField("secrets", SPANS)])
    return unpacked(rows.mapInArrow(_scan, kind), carry, ["secrets"])


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([spans(text.as_py()) for text in batch.column(1)], _ARROW)
        yield pa.RecordBatch.from_arrays([batch.column(0), found], ["row", "secrets"])
