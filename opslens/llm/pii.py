"""Personal data replaced by keyed surrogates, with built-in functions only.

Detected entities (mail and IP addresses, telephone, card, social security and
bank account numbers, access keys, tokens and passwords, names after a form of
address)
are replaced by surrogates of the same type and format: letters become letters
of the same case and script, digits digits, hexadecimal stays hexadecimal; a
card number keeps its issuer digit and its checksum's state, a telephone number
its country code, a name the gender of its form of address and its script.

A surrogate is drawn from a keyed hash of the entity's normal form, so one
entity has one surrogate in all documents and spellings (a number with other
separators, the surname with and without the first name). The table of
distinct entities is checked for collisions: a surrogate that is an entity of
the corpus, or that another entity has, is drawn again with the next attempt
number until all differ.

The text of documents without an entity is never shuffled. The entity table
and the links from texts to entities are joined, not collected.

Nulls and odd rows: a null text stays null and an empty one empty; equal texts
get equal results, repeated rows are kept; a table without entities, or without
rows, comes back as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import cut, fresh, table

KEY = "surrogate-key"
ATTEMPTS = 24

# Forms of address by gender, given names, syllables of surnames.
ADDRESS = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Rafael Simon Tomas Victor".split(),
    ("f", "latin"): "Alma Berta Clara Diana Elena Flora Greta Hanna Irene Julia Karin Laura Marta Nora Olga Paula Rosa Sara Teresa Vera".split(),
    ("n", "latin"): "Alex Andrea Chris Dana Eden Gabriel Jamie Kim Lou Maxime Noel Robin Sam Sasha Terry Toni".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур".split(),
    ("f", "cyrillic"): "Алина Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Юлия".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава".split(),
}
SYLLABLES = {
    "latin": "ba be bo da del do fa fer ga gor ha hol ka kel la len lo ma mer mo na nor pa per ra ren ro sa sel ta tor va vel wa zan".split(),
    "cyrillic": "ба бе бо ва вел га гор да дер ка кел ла лен ма мер на нор па пер ра рен са сел та тор".split(),
}
ENDINGS = {"latin": ["man", "berg", "son", "ton", "ard", "ini", "eau", "ez"], "cyrillic": ["ов", "ин", "ский", "ко"]}

# What no entity may follow, and what else one may not follow, by kind. Numbers:
# the inside of a longer number; addresses may end a range (10.0.0.1-10.0.0.9).
_WORD = r"(?<![\p{L}\p{N}])"
_NUMBER = r"(?<!_)(?<![0-9][._%+-])"
EDGES = {"email": "(?<![._%+-])", "ip": r"(?<!_)(?<![0-9]\.)", "ipv6": "(?<![_:.])", "ssn": _NUMBER, "phone": _NUMBER, "card": _NUMBER}
# in capitals only with a full stop: MS Office is no person
_HONORIFIC = "(?:(?:" + "|".join(w for g in ADDRESS.values() for w in g) + r")\.?|(?:MR|MRS|MS|DR|PROF|SR|SRA)\.)"
# a hyphen or an apostrophe inside, but not that of a possessive
_NAME = r"\p{Lu}(?:\p{L}++|['’-](?!s(?!\p{L}))(?=\p{L}))++"
_HEX4 = "[0-9A-Fa-f]{1,4}"
_TOKEN = "AKIA|ASIA|gh[pousr]_|sk_(?:live|test)_|eyJ"
PATTERNS = {
    # a host name has at most 127 labels; an unbounded group would recurse once a label
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,125}\.\p{L}{2,}",
    "secret": r"""(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?[^\s"',;]{6,}""",
    "cloud_key": (r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,255}+(?![A-Za-z0-9])|sk_(?:live|test)_[A-Za-z0-9]{16,255}+(?![A-Za-z0-9])"
                  r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    "name": f"{_HONORIFIC} {_NAME}(?: {_NAME}){{0,2}}",
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "ipv6": f"(?:(?:{_HEX4}:){{7}}{_HEX4}|(?=[A-Fa-f]{{0,3}}[0-9])(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}})" + r"(?![\p{L}\p{N}:])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|[0-9]{3} [0-9]{2} [0-9]{4}(?![0-9])",
    "phone": (r"\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{2,5}(?:[ .-]?[0-9]{2,8}){1,3}(?![0-9])|0[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
              r"|\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
              r"|(?:1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "card": r"[0-9]{13,19}(?![0-9])|[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{6}\1[0-9]{5})(?![0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
# The first characters of a kind; a mail address begins with almost any.
STARTS = {"secret": "[AaPpSsTt]", "cloud_key": "[Aegs]", "name": "[" + "".join(sorted({w[0] for g in ADDRESS.values() for w in g})) + "]", "ip": "[0-9]", "ipv6": "[0-9A-Fa-f]",
          "ssn": "[0-9]", "phone": "[0-9+(]", "card": "[0-9]", "iban": "[A-Z]"}


def _tried(kind: str) -> str:
    guard = f"(?={STARTS[kind]})" if kind in STARTS else ""
    return f"{guard}{EDGES.get(kind, '')}(?:{PATTERNS[kind]})"


#: What is tried at a place, in this order. Most places are inside a word: they
#: are left after one look back, and a kind is tried only at its first characters.
ENTITY = f"{_WORD}(?:" + "|".join(map(_tried, PATTERNS)).replace(r"([ -])", "(?<sep>[ -])").replace(r"\1", r"\k<sep>") + ")"

_LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_CLASSES = [
    ("[0-9]", "0123456789"), ("[a-z]", _LOWER["latin"]), ("[A-Z]", _LOWER["latin"].upper()),
    (r"[\p{IsCyrillic}&&\p{Ll}]", _LOWER["cyrillic"]), (r"[\p{IsCyrillic}&&\p{Lu}]", _LOWER["cyrillic"].upper()),
    (r"[\p{IsGreek}&&\p{Ll}]", _LOWER["greek"]), (r"[\p{IsGreek}&&\p{Lu}]", _LOWER["greek"].upper()),
    (r"\p{Ll}", _LOWER["latin"]), (r"\p{Lu}", _LOWER["latin"].upper()),
]
STREAM_BYTES = 256


def kind_of(entity: Column) -> Column:
    return reduce(lambda rest, k: F.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(rest), reversed(list(PATTERNS)), F.lit("other"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _capitals(x: Column) -> Column:
    return (x == F.upper(x)) & (x != F.lower(x))


def parts_of(entity: Column, kind: Column) -> Column:
    """The parts of an entity in order: structs (kind, unit, raw). Parts with
    kind null stay; the others are replaced by their unit's surrogate."""
    def part(k, unit: Column, raw: Column) -> Column:
        return F.struct(k.alias("kind"), unit.alias("unit"), raw.alias("raw"))

    none = F.lit(None).cast("string")
    head = F.regexp_extract(entity, f"^({_HONORIFIC} )", 1)
    words = F.split(F.substring(entity, F.length(head) + 1, F.length(entity)), " ")
    title = F.lower(F.regexp_replace(head, "[. ]", ""))
    gender = reduce(lambda rest, g: F.when(title.isin([w.lower() for w in ADDRESS[g]]), g).otherwise(rest), ADDRESS, F.lit("n"))
    named = F.concat(F.array(part(none, none, head)), F.flatten(F.transform(words, lambda w, i: F.array(
        part(none, none, F.when(i > 0, " ").otherwise("")),
        part(F.when(i == F.size(words) - 1, "surname").otherwise(F.concat(F.lit("given_"), gender)), F.when(_capitals(w), F.initcap(w)).otherwise(w), w)))))
    lead = F.regexp_extract(entity, r"""^(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?""", 0)
    value = F.substring(entity, F.length(lead) + 1, F.length(entity))
    secret = F.array(part(none, none, lead), part(F.lit("secret"), value, value))
    unit = (F.when(kind.isin("phone", "card", "ssn"), _digits(entity)).when(kind.isin("email", "ipv6"), F.lower(entity))
            .when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(entity))
    return F.when(kind == "name", named).when(kind == "secret", secret).otherwise(F.array(part(kind, unit, entity)))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, 2 * F.pmod(i, F.lit(STREAM_BYTES)).cast("int") + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: Column, n: Column, number: Column) -> Column:
    return F.element_at(values, F.pmod(number, n).cast("int") + 1)


def _shaped(unit: Column, stream: Column, keep: Column) -> Column:
    """``unit`` with every letter and digit after the first ``keep`` characters
    redrawn within its class; hexadecimal values draw their letters from a-f."""
    is_hex = unit.rlike("^[0-9a-f:]+$") & unit.rlike("[0-9]")

    def char(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(_CLASSES):
            options, n = F.split(F.lit(letters), ""), F.lit(len(letters))
            if letters == _LOWER["latin"]:
                n = F.when(is_hex, F.lit(6)).otherwise(n)
            out = F.when(c.rlike(f"^{pattern}$"), _pick(options, n, _byte(stream, i))).otherwise(out)
        return F.when(i < keep, c).otherwise(out)

    return F.array_join(F.transform(F.split(unit, ""), char), "")


def _checksum(number: Column) -> Column:
    """Luhn sum modulo 10."""
    n = F.length(number)

    def digit(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.split(number, ""), digit), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))), F.lit(10))


def surrogate(kind: Column, unit: Column, attempt: int, key: str = KEY) -> Column:
    """The surrogate of a unit, before any collision check."""
    seed = F.concat_ws("|", F.lit(key), kind, unit, F.lit(str(attempt)))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 512) for i in range(STREAM_BYTES // 64)])
    # bound by a lambda, the stream is made once a unit and not once a character
    return F.element_at(F.transform(F.array(stream), lambda bound: _drawn(kind, unit, bound, attempt)), 1)


def _drawn(kind: Column, unit: Column, stream: Column, attempt: int) -> Column:
    """The surrogate of a unit from its stream of hexadecimal bytes."""
    script = F.when(unit.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    number = F.conv(F.substring(stream, 1, 12), 16, 10).cast("long")
    card = _shaped(unit, stream, F.lit(1))
    body = F.substring(card, F.lit(1), F.length(card) - 1)
    # the last digit restores the state of the checksum
    last = F.pmod(F.col("checksum") - _checksum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    top = F.regexp_extract(unit, r"\.[^.]*$", 0)  # a mail address keeps its top-level domain
    mail = F.concat(_shaped(F.substring(unit, F.lit(1), F.length(unit) - F.length(top)), stream, F.lit(0)), top)
    ip = F.concat_ws(".", *[(1 + F.pmod(_byte(stream, F.lit(i)), F.lit(254))).cast("string") for i in range(4)])
    given, surname = F.lit(None).cast("string"), F.lit(None).cast("string")
    more = F.lit("") if attempt < 2 else _pick(F.split(F.lit(" ".join(SYLLABLES["latin"])), " "), F.lit(len(SYLLABLES["latin"])), _byte(stream, F.lit(20)))
    for (g, s), names in GIVEN.items():
        given = F.when((kind == f"given_{g}") & (script == s), _pick(F.split(F.lit(" ".join(names)), " "), F.lit(len(names)), number)).otherwise(given)
    for s, syllables in SYLLABLES.items():
        options, ends = F.split(F.lit(" ".join(syllables)), " "), F.split(F.lit(" ".join(ENDINGS[s])), " ")
        made = F.initcap(F.concat(*[_pick(options, F.lit(len(syllables)), _byte(stream, F.lit(i))) for i in range(2 + attempt // 2)],
                                  _pick(ends, F.lit(len(ENDINGS[s])), _byte(stream, F.lit(30)))))
        surname = F.when(script == s, made).otherwise(surname)
    return (F.when(kind == "card", F.concat(body, last)).when(kind == "ip", ip).when(kind == "email", mail).when(kind.startswith("given_"), F.concat(given, more)).when(kind == "surname", surname)
            .otherwise(_shaped(unit, stream, F.when(kind == "iban", 2).otherwise(F.col("kept")))))


def assign(units: DataFrame, key: str = KEY) -> DataFrame:
    """kind, unit, surrogate for distinct (kind, unit, kept): no two units of a
    kind share a surrogate, and no surrogate is itself a unit."""
    # few bytes but much work each: dealt to as many tasks as a shuffle has
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = cut(units.repartition(tasks, "kind", "unit").withColumn("checksum", F.when(F.col("kind") == "card", _checksum(F.col("unit")))))
    own = units.select("kind", F.col("unit").alias("surrogate"))
    left, done = units, []
    for attempt in range(ATTEMPTS):
        drawn = left.withColumn("surrogate", surrogate(F.col("kind"), F.col("unit"), attempt, key))
        free = drawn.join(own, ["kind", "surrogate"], "left_anti")
        for taken in done:
            free = free.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("unit"))
        done.append(cut(free.withColumn("first", first).where("first = 1").select("kind", "unit", "surrogate")))
        left = cut(left.join(done[-1], ["kind", "unit"], "left_anti"))
        if left.isEmpty():
            break
    else:  # a kind with hardly any free values left: a keyed digest, distinct though of another shape
        done.append(left.select("kind", "unit", F.sha2(F.concat_ws("|", F.lit(key), "kind", "unit"), 256).alias("surrogate")))
    return reduce(DataFrame.unionByName, done)


def _rendered(raw: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the spelling of the entity it replaces."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    pattern = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9]")
    filled = F.aggregate(F.split(raw, ""), start, lambda a, c: F.struct(
        F.concat(a["s"], F.when(F.regexp_like(c, pattern), F.substring(new, a["i"], F.lit(1))).otherwise(c)).alias("s"),
        (a["i"] + F.when(F.regexp_like(c, pattern), 1).otherwise(0)).alias("i")), lambda a: a["s"])
    upper = ((kind == "email") | (kind == "surname") | kind.startswith("given_")) & _capitals(raw)
    whole = F.length(F.regexp_replace(raw, F.when(kind == "iban", "[^A-Z0-9]").otherwise("[^0-9]"), F.lit(""))) == F.length(new)
    return F.when(kind.isin("phone", "card", "ssn", "iban") & whole, filled).when(upper, F.upper(new)).otherwise(new)


def replace(docs: DataFrame, text: str = "text", key: str = KEY) -> tuple[DataFrame, str]:
    """``docs`` with the entities of ``text`` replaced, and a column (its name
    is returned) with their number."""
    count, ident, new = fresh(docs, "n_entities", "text_hash", "new_parts")
    t = F.col(f"`{text}`")
    has = F.coalesce(t.rlike(ENTITY), F.lit(False))
    found = docs.where(has).select(F.sha2(t, 256).alias("h"), t.alias("t")).select("h", F.posexplode(F.regexp_extract_all("t", F.lit(ENTITY), F.lit(0))).alias("at", "entity"))
    split = found.withColumn("kind", kind_of(F.col("entity"))).select("h", "at", F.posexplode(parts_of(F.col("entity"), F.col("kind"))).alias("nth", "part"))
    # equal texts are one text here
    parts = cut(split.select("h", "at", "nth", "part.*").dropDuplicates(["h", "at", "nth"]))
    # the country code, or the 1 that stands for it, and a trunk 0
    country = F.length(_digits(F.regexp_extract("raw", r"^(?:\+[0-9]{1,3}[ .-]?\(0\)|(?:\+[0-9]{1,3}|1)(?=[ .(-])|0)", 0)))
    units = parts.where("kind is not null").groupBy("kind", "unit").agg(F.min(F.when((F.col("kind") == "phone") & F.startswith("raw", F.lit("+")), F.greatest(country, F.lit(1)))
                                                                             .when(F.col("kind") == "phone", country)
                                                                             .when(F.col("kind") == "cloud_key", F.length(F.regexp_extract("unit", f"^(?:{_TOKEN})", 0)))
                                                                             .otherwise(F.lit(0))).alias("kept"))
    known = assign(units, key)
    rendered = (parts.join(known, ["kind", "unit"], "left")
                .withColumn("out", F.when(F.col("kind").isNull(), F.col("raw")).otherwise(_rendered(F.col("raw"), F.col("kind"), F.col("surrogate")))))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("nth", "out"))), lambda p: p["out"])
    entities = rendered.groupBy("h", "at").agg(F.array_join(in_order, "").alias("out"))
    per_text = entities.groupBy(F.col("h").alias(ident)).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda p: p["out"]).alias(new))
    between = F.split(t, ENTITY, -1)
    joined = F.concat(F.element_at(between, 1), F.array_join(F.flatten(F.zip_with(F.col(new), F.slice(between, F.lit(2), F.size(between)), lambda a, b: F.array(a, b))), ""))
    names = [F.col(f"`{c}`") for c in docs.columns]
    changed = (docs.where(has).withColumn(ident, F.sha2(t, 256)).join(per_text, ident)
               .select(*[joined.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.size(new).alias(count)))
    return changed.unionByName(docs.where(~has).select(*names, F.lit(0).alias(count))), count


def query(spark, sf_dir: str) -> DataFrame:
    out, count = replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col(count).cast("long").alias("n_entities"))
