"""Personal data replaced by keyed surrogates of the same type, script, gender and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewforge.llm.frames import packed, quoted, shared_table, text_key, unpacked

#: Titles by gender; the last ones tell none.
MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа"]
NEUTRAL = ["Dr", "Prof"]
#: One title and its blank; a lone M is one with its dot only, and Sr or Dr after a capitalised word is part of what is before.
TITLE = (
    rf"(?:(?:{'|'.join(t for t in MALE + FEMALE + NEUTRAL if t not in ('Sr', 'Dr'))}"
    # What is before is looked at only where such a title stands.
    r"|[SD]r(?:(?<!\p{Lu}\p{Ll}{2,20} [SD]r)|(?<=\b(?:Herr|Frau|Prof|Prof\.) Dr)))\.?|M\.) "
)
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:[\-'’]?\p{Lu}\p{Ll}+)*+"
# Titles that cannot be read as a word.
_NO_WORD = r"(?:(?:Г-н|Г-жа)\.?|M\.) "
# Where the part before @ can begin: once per run of its characters, behind its leading signs, and behind the match before.
# From 512 signs on, every place behind them is tried.
_RUN, _SIGN = r"[A-Za-z0-9._%+\-]", r"[._%+\-]"
_START = rf"(?:(?<!{_RUN})|\G|(?<={_SIGN})(?:(?<=(?:(?<!{_RUN})|\G){_SIGN}{{1,512}})|(?<={_SIGN}{{512}})))"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Types in the order in which they are tried at a place; each group name is used once. Groups that repeat without bound
#: are possessive: Java's matcher would recurse once per repetition and overflow on long texts.
PATTERNS = {
    "email": rf"{_START}[A-Za-z0-9]{_RUN}*+@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    # 19, 16, 15, 14 and 13 digits, then other lengths without gaps; all but 16 need the first digits of such cards.
    "card": r"\b(?:[4-6]\d{3}(?<long>[ \-]?)\d{4}\k<long>\d{4}\k<long>\d{4}\k<long>\d{3}|\d{4}(?<gap>[ \-]?)\d{4}\k<gap>\d{4}\k<gap>\d{4}"
    r"|3[47]\d{2}(?<amex>[ \-]?)\d{6}\k<amex>\d{5}|3[0689]\d{2}(?<diners>[ \-]?)\d{6}\k<diners>\d{4}"
    r"|4\d{3}(?<short>[ \-]?)\d{3}\k<short>\d{3}\k<short>\d{3}|(?:5[06-9]|6\d)\d{11,17}|(?:2131|1800)\d{11})\b",
    "ip": r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"
    rf"|(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:]|\.\d)",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}\b|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}\b|\b\d{3}[ .\-]\d{3}[ .\-]\d{4}\b"
    r"|\b0\d{1,4}[ .\-]\d{3,4}[ .\-]\d{3,4}\b|\b0\d{1,4}[ \-/]\d{5,8}\b|\b0\d(?:[ .\-]\d{2}){4}\b",
    # Titles in a row are read from the first, or from the match before; if no word follows, the last that can be one is it.
    "name": rf"\b(?={TITLE})(?:(?<!\b{TITLE})|(?<=\G\.? ))(?:(?:{TITLE})++{_WORD}|(?:{TITLE}(?:{_NO_WORD})*+(?!{_NO_WORD})(?={TITLE}))++{_WORD})(?: {_WORD})?",
}
ALL = "|".join(f"(?<{n}>{p})" for n, p in PATTERNS.items())
#: What every type needs; looked for first, because all patterns at every place of every text are slow.
HINT = rf"[0-9@]|\b{TITLE}"
#: The titles before a name, and a title of women among them.
TITLES = rf"^((?:(?:{'|'.join(MALE + FEMALE + NEUTRAL + ['M'])})\.? )*+)"
OF_WOMEN = rf"(?:^| )(?:{'|'.join(FEMALE)})\.? "
#: Capitalised words that stand for no person where they stand alone.
COMMON = (
    "The A An And But Or If In On At Of To For From With By He She It We You They I His Her This That There Then When Who What "
    "Der Die Das Ein Eine Und Aber Er Sie Es Wir Ihr Im In Am Le La Les Un Une Et Mais Il Elle Nous Vous En Au El Los Las Una Y Pero "
    "Он Она Оно Мы Вы Они И А Но В На Это"
).split()
#: Given names and surnames by script and gender.
GIVEN = {
    ("latin", "male"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oskar Paul".split(),
    ("latin", "female"): "Anna Berta Clara Diana Eva Frida Greta Helena Ida Julia Karin Lena Maria Nora Olga Paula".split(),
    ("cyrillic", "male"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
    ("cyrillic", "female"): "Анна Вера Галина Дарья Елена Ирина Ольга Юлия".split(),
}
#: Calling codes of countries.
CALLING = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
SURNAMES = {
    "latin": "Abel Brandt Corvin Delmar Ebner Falk Garin Holm Iversen Jansen Keller Lorenz Moreau Novak Ortega Perrin".split(),
    "cyrillic": "Белов Громов Дубов Зимин Лесков Орлов Павлов Соколов".split(),
}


def entities(text: Column) -> Column:
    """The matches of any type, in order."""
    return F.regexp_extract_all(text, F.lit(ALL), F.lit(0))


def type_of(entity: Column) -> Column:
    out = F.lit("name")
    for name in reversed([n for n in PATTERNS if n != "name"]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def name_words(entity: Column) -> Column:
    """The words of a name without its titles."""
    return F.split(F.regexp_replace(entity, TITLES, ""), " ")


def parts_of(texts: DataFrame) -> DataFrame:
    """``key, written, kind`` for what has a surrogate of its own in ``text``: the words of its names, and all other entities.

    A word is a given name (``male`` or ``female``) if it stands before another word of a name and never last in a name
    of several words, else a surname (``last``). Step by step, so that nothing is worked out once per word.
    """
    typed = F.transform("found", lambda e: F.struct(e.alias("written"), type_of(e).alias("kind")))
    names = F.transform(
        F.filter("typed", lambda e: e["kind"] == "name"),
        lambda e: F.struct(name_words(e["written"]).alias("words"), e["written"].rlike(OF_WOMEN).alias("woman")),
    )
    given = lambda of: F.flatten(F.transform(of, lambda n: F.slice(n["words"], F.lit(1), F.size(n["words"]) - 1)))
    steps = texts.select("key", F.array_distinct(entities(F.col("text"))).alias("found")).select("key", typed.alias("typed"))
    steps = steps.select("key", "typed", names.alias("names")).select(
        "key",
        F.filter("typed", lambda e: e["kind"] != "name").alias("others"),
        F.array_distinct(F.flatten(F.transform("names", lambda n: n["words"]))).alias("words"),
        given(F.col("names")).alias("firsts"),
        given(F.filter("names", lambda n: n["woman"])).alias("women"),
        F.transform(F.filter("names", lambda n: F.size(n["words"]) > 1), lambda n: F.element_at(n["words"], -1)).alias("lasts"),
    )
    of_women = [n for (_, gender), names_ in GIVEN.items() if gender == "female" for n in names_]

    def part(word: Column) -> Column:
        gender = F.when(F.array_contains("women", word) | word.isin(of_women), "female").otherwise("male")
        first = F.array_contains("firsts", word) & ~F.array_contains("lasts", word)
        return F.struct(word.alias("written"), F.when(first, gender).otherwise("last").alias("kind"))

    parts = F.explode(F.concat("others", F.transform("words", part))).alias("part")
    return steps.select("key", parts).select("key", "part.*")


def _groups(address: Column, side: int) -> Column:
    """The written groups before or after the double colon of an address; without one, all are before it."""
    return F.filter(F.split(F.coalesce(F.get(F.split(address, "::"), F.lit(side)), F.lit("")), ":"), lambda g: g != "")


def _long_address(address: Column) -> Column:
    """All eight groups in small letters and without leading zeros."""
    head, tail = _groups(address, 0), _groups(address, 1)
    missing = F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0))
    groups = F.concat(head, F.array_repeat(F.lit("0"), missing), tail)
    return F.array_join(F.transform(groups, lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", ""))), ":")


def _address_like(address: Column, surrogate: Column) -> Column:
    """The groups of a long surrogate where an address has groups; groups of zeros stay as they are written."""
    new, tail = F.split(surrogate, ":"), _groups(address, 1)
    put = lambda g, at: F.when(g.rlike("^0+$"), g).otherwise(F.get(new, at))
    head = F.array_join(F.transform(_groups(address, 0), put), ":")
    end = F.array_join(F.transform(tail, lambda g, i: put(g, F.size(new) - F.size(tail) + i)), ":")
    out = F.when(address.contains("::"), F.concat(head, F.lit("::"), end)).otherwise(head)
    return F.when(address.rlike("[A-F]"), F.upper(out)).otherwise(out)


def normal(entity: Column, kind: Column) -> Column:
    """What is the same for all ways to write an entity: digits (and a plus sign) of numbers, small letters of addresses."""
    written = F.regexp_replace(entity, r"[^A-Za-z0-9+]", "")
    return F.when(kind == "email", F.lower(entity)).when(kind.isin("iban", "ssn", "card", "phone"), written).when(
        (kind == "ip") & entity.contains(":"), _long_address(entity)
    ).otherwise(entity)


def written_like(entity: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate of the normal form with the separators and capitals of an entity."""
    signs = F.regexp_replace(surrogate, r"\+", "")
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), r"[^A-Za-z0-9]", ""))
    number = F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substring(signs, before(i), F.lit(1))).otherwise(c))
    # A surrogate longer than its entity has its further letters first.
    more = F.greatest(F.length(surrogate) - F.length(entity), F.lit(0))
    capital = lambda c, new: F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)
    letters = F.zip_with(F.split(entity, ""), F.split(F.substring(surrogate, more + 1, F.length(entity)), ""), capital)
    return (
        F.when(kind == "email", F.concat(F.substring(surrogate, F.lit(1), more), F.array_join(letters, "")))
        .when(kind.isin("iban", "ssn", "card", "phone"), F.array_join(number, ""))
        .when((kind == "ip") & entity.contains(":"), _address_like(entity, surrogate)).otherwise(surrogate)
    )


def _digest(entity: Column, key: str, attempt: Column) -> Column:
    """Keyed bytes as hexadecimal text, 256 digits, nested so that the key cannot be appended to."""
    inner = lambda part: F.sha2(F.concat(F.lit(key), F.lit("\x00"), F.lit(str(part)), F.lit("\x00"), attempt.cast("string"), F.lit("\x00"), entity), 512)
    return F.concat(*(F.sha2(F.concat(F.lit(key), F.lit("\x01"), inner(part)), 512) for part in range(2)))


def _number(digest: Column, place: Column, below: int) -> Column:
    """A number below a bound from four digits of the digest."""
    return F.pmod(F.conv(F.substring(digest, F.pmod(place * 4, F.lit(252)) + 1, F.lit(4)), 16, 10).cast("int"), F.lit(below))


def _like(entity: Column, digest: Column) -> Column:
    """Every digit by a digit, every ASCII letter by one of its case, the rest as it is."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("^[0-9]$"), _number(digest, i, 10).cast("string"))
        out = out.when(c.rlike("^[a-z]$"), F.char(_number(digest, i, 26) + 97))
        return out.when(c.rlike("^[A-Z]$"), F.char(_number(digest, i, 26) + 65)).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _luhn(number: Column) -> Column:
    """The sum that a valid card number makes a multiple of ten."""
    digits = F.reverse(F.regexp_replace(number, r"\D", ""))
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def surrogate(entity: Column, kind: Column, digest: Column, attempt: Column) -> Column:
    """What stands for the normal form of an entity at an attempt: the same type, script, gender and format.

    ``digest`` should be a column of its own, since it is read once per character.
    """
    like = _like(entity, digest)
    domain = F.regexp_extract(entity, r"(\.[A-Za-z0-9\-]+)$", 1)
    # Short addresses can all be taken: further attempts put letters before them.
    further = F.when(attempt > 2, F.translate(F.substring(digest, 249, 8), "0123456789", "ghijklmnop")).otherwise("")
    email = F.concat(further, F.substring(like, F.lit(1), F.length(like) - F.length(domain)), domain)
    without = F.substring(like, F.lit(1), F.length(like) - 1)
    checked = F.concat(without, F.pmod(F.lit(10) - _luhn(F.concat(without, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    card = F.when(_luhn(entity) % 10 == 0, checked).otherwise(like)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(digest, i, 254) + 1).cast("string")), ".")
    group = lambda g, i: F.when(g == "0", g).otherwise(F.lower(F.hex(_number(digest, i, 61_440) + 4_096)))
    octets = F.when(entity.contains(":"), F.array_join(F.transform(F.split(entity, ":"), group), ":")).otherwise(octets)
    prefix = F.regexp_extract(entity, rf"^(\+{CALLING}|[A-Z]{{2}})", 1)
    phone = F.concat(prefix, F.substring(like, F.length(prefix) + 1, F.length(like)))
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", octets)
        .when(kind.isin("phone", "iban"), phone).when(kind.isin("male", "female", "last"), _word(entity, kind, digest, attempt)).otherwise(like)
    )


def _word(word: Column, kind: Column, digest: Column, attempt: Column) -> Column:
    """A given name or surname of the same script."""

    def pick(words: list[str], place: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), _number(digest, F.lit(place), len(words)) + 1)

    def built(script: str) -> Column:
        plain = F.when(kind == "female", pick(GIVEN[script, "female"], 0)).when(kind == "male", pick(GIVEN[script, "male"], 0))
        plain = plain.otherwise(pick(SURNAMES[script], 1))
        # Lists are short: further attempts join a second surname and then letters.
        letters = F.when(attempt > 2, F.lower(F.translate(F.substring(digest, 41, 6), "0123456789", "ghijklmnop"))).otherwise("")
        return F.when(attempt > 0, F.concat(plain, F.lower(pick(SURNAMES[script], 2)), letters)).otherwise(plain)

    return F.when(word.rlike(r"\p{IsCyrillic}"), built("cyrillic")).otherwise(built("latin"))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """``entity, kind, surrogate`` for each distinct normal form, no two alike and none an entity itself.

    Each round gives the entities that are left a new attempt; of those with the same
    surrogate the smallest entity keeps it, unless it is taken or real.
    """
    known = shared_table(found.select("entity", "kind").distinct(), "entities")
    done, left = None, known
    for attempt in range(64):
        digest = _digest(F.concat("kind", F.lit("\x00"), "entity"), key, F.lit(attempt))
        tried = left.withColumn("digest", digest)
        tried = tried.withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), F.col("digest"), F.lit(attempt)))
        winners = tried.groupBy("surrogate").agg(F.min(F.struct("entity", "kind")).alias("first")).select("surrogate", "first.*")
        winners = winners.join(known.select(F.col("entity").alias("surrogate")), "surrogate", "left_anti")
        if done is not None:
            winners = winners.join(done.select("surrogate"), "surrogate", "left_anti")
        new = shared_table(winners.select("entity", "kind", "surrogate"), "surrogates")
        done = new if done is None else done.unionByName(new)
        left = shared_table(left.join(new, ["entity", "kind"], "left_anti"), "left")
        if left.isEmpty():
            return done
    raise RuntimeError("more entities of one format than surrogates")


def replace_personal_data(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``n_entities``.

    The same entity gets the same surrogate everywhere, for the same ``key``; different
    entities get different ones. Entities are the same if their normal forms are: numbers by
    their digits, addresses in small letters, names word by word and without titles. The words
    of a text's titled names are replaced where they stand without a title too. Types are those
    of ``PATTERNS``. E-mail addresses keep their form and top-level domain, telephone numbers and
    account numbers their country, cards their check digit, names their titles, gender, script and
    number of words.

    Null and empty texts stay as they are with no entities; repeated rows are treated
    alike; a column named ``n_entities`` is replaced; an empty table stays empty.

    All work is column expressions. Texts with entities are joined, by a key of the text,
    to a map of their own few replacements; all other texts pass without a shuffle.
    """
    body = quoted(text)
    some = F.coalesce(body.rlike(HINT) & body.rlike(ALL), F.lit(False))
    matched = parts_of(docs.where(some).select(text_key(body).alias("key"), body.alias("text")))
    pairs = shared_table(matched.withColumn("entity", normal(F.col("written"), F.col("kind"))), "matches")
    table = shared_table(surrogates(pairs, key), "surrogates")
    put = F.struct("written", written_like(F.col("written"), F.col("kind"), F.col("surrogate")))
    maps = pairs.distinct().join(table, ["entity", "kind"]).groupBy("key").agg(F.map_from_entries(F.collect_list(put)).alias("changes"))
    maps = shared_table(maps, "changes")
    rows = packed(docs.where(some), key=text_key(body)).join(maps, "key").select("row", "changes", mentions(F.col("changes")).alias("mentions"))
    own = F.col("row").getField(text)
    gaps, found = F.split(own, F.col("mentions"), -1), F.regexp_extract_all(own, F.col("mentions"), F.lit(0))
    put = rows.select("row", "changes", gaps.alias("gaps"), found.alias("found"))
    one = lambda word: F.coalesce(F.element_at("changes", word), word)
    name = lambda m: F.concat(F.regexp_extract(m, TITLES, 1), F.array_join(F.transform(name_words(m), one), " "))
    changed = lambda m: F.coalesce(F.element_at("changes", m), name(m), F.lit(""))
    pieces = F.transform("gaps", lambda g, i: F.concat(g, changed(F.get("found", i))))
    changed = put.select("row", F.array_join(pieces, "").alias(text), F.size("found").cast("long").alias("n_entities"))
    same = packed(docs.where(~some)).select("row", F.col("row").getField(text).alias(text), F.lit(0).cast("long").alias("n_entities"))
    return unpacked(changed.unionByName(same), docs.columns, [text, "n_entities"])


def mentions(changes: Column) -> Column:
    """The pattern for a text: all types, and its names' words without a title, one after another."""
    words = F.filter(F.map_keys(changes), lambda w: ~w.rlike("[0-9@]") & ~w.isin(COMMON))
    # Longer words first, so that none hides another that goes on.
    words = F.transform(F.sort_array(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))), False), lambda w: w["word"])
    word = F.concat(F.lit(r"(?:\Q"), F.array_join(words, r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{N}]|[A-Za-z0-9._%+\-]*@)"))
    return F.when(F.size(words) > 0, F.concat(F.lit(ALL + r"|(?<![\p{L}\p{N}])"), word, F.lit("(?: "), word, F.lit(")?"))).otherwise(ALL)
