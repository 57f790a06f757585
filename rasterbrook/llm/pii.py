"""Surrogates for personal data, in DataFrame functions only.

Found: e-mail, IPv4 and IPv6 addresses, phone numbers (behind +, an area code
or a trunk zero, or in groups of 3, 3 and 4 digits), social security numbers
(3, 2 and 4 digits), card numbers (13 to 19 digits that begin with 2 to 6 and
pass the check-digit rule), IBANs whose check digits are right, secrets (long
hexadecimal strings, and values assigned to a name like token or password, to
the closing quote or white space), and person names behind a title, in any
script, with the mentions of their parts anywhere in the same text.

Each distinct entity gets one surrogate, everywhere (coreference). It is made
from a keyed digest of the entity's normal form and has its type and form:
digits stay where digits were, letters and signs of a secret keep their class,
a valid check digit stays valid, an address stays an address, hexadecimal stays
hexadecimal, names keep script, case, and gender, which a title tells of the
given names behind it; a family name is the same for Mr and Mrs, so it has none.
Numbers of a form go through a keyed permutation of that form (alternating
halves, ROUNDS times), so no two of them meet however many there are. Collision
checks: among all entities of a kind, a candidate that another entity holds,
or that is itself an entity of the corpus, is drawn again until all surrogates
differ (distinctness). Later draws of names, addresses and secrets get longer,
so that room never ends; numbers that find no free place in MOST_DRAWS take
their first draw, which no other one has.

Texts are keyed by content, so entities of copies are looked up once. A cheap
trigger tells texts that may hold an entity; the others are neither searched
nor exchanged. Only entities and their keys are exchanged before the texts that
have some are joined with their surrogates; a hot text or entity is one row on
the small side of its join.

Defined results: a null or empty text stays as it is with no entities. Ids play
no part, so null and repeated ids are fine. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterbrook.llm.common import cut, table

#: Whoever has the key can rebuild the map. It is read from this setting of the session.
KEY_SETTING = "spark.rasterbrook.surrogates.key"
#: Of the registered queries where the setting is absent: their tables are made up.
DEMO_KEY = "made-up tables only"
#: Draws until a number takes its first one.
MOST_DRAWS = 25
ROUNDS = 6

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){0,8}\.\p{L}{2,}+"
PHONE = r"(?<![\p{N}+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
LOCAL_PHONE = r"(?<![\p{N}+(])\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9])(?!\.[0-9])"
#: National forms: 3, 3 and 4 digits, or a trunk zero and 9 digits or more that are no date.
GROUPED_PHONE = r"(?<![\p{L}\p{N}+.\-/])(?:1[ .\-])?[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![\p{L}\p{N}])(?![.\-][0-9])"
TRUNK_PHONE = (
    r"(?<![\p{L}\p{N}+.\-/])(?=(?:[ ./()\-]{0,2}[0-9]){9})(?![0-9]{2}[./\-][0-9]{2}[./\-](?:19|20)[0-9]{2}(?![0-9]))"
    r"(?:\(0[0-9]{1,4}\)[ ./\-]?|0[0-9]{1,4}[ ./\-])(?:[0-9]{4,8}(?:[ .\-][0-9]{1,4})?|[0-9]{2,3}(?:[ .\-][0-9]{2,4}){1,3})(?![\p{L}\p{N}])"
)
SSN = r"(?<![\p{L}\p{N}+.\-/])[0-9]{3}(?:-[0-9]{2}-| [0-9]{2} )[0-9]{4}(?![\p{L}\p{N}])(?![.\-][0-9])"
V4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"
#: With a digit, and more than :: and one group, as ::1 names nobody.
IPV6 = (
    rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*+[0-9])(?!(?:[0-9A-Fa-f]*+:){{9}})"
    rf"(?:(?:{_H}:){{6}}{V4}|(?:{_H}:){{7}}{_H}|{_H}(?::{_H}){{0,5}}::(?:{_H}:){{0,4}}{V4}|::(?:{_H}:){{0,5}}{V4}|{_H}(?::{_H}){{0,6}}::(?:{_H}(?::{_H}){{0,5}})?|::{_H}(?::{_H}){{1,6}})"
    r"(?![\p{L}\p{N}])(?!:[0-9A-Fa-f:])(?!\.[0-9])"
)
CARD = r"(?<![\p{L}\p{N}])[2-6](?:[ \-]?[0-9]){12,18}(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
HEX = r"(?<![\p{L}\p{N}])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])"
_NAMED = r"(?<![\p{L}\p{N}])(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}"
#: Quoted values whole; others to white space, if they aren't a plain word.
SECRET = rf"""{_NAMED}(?:"[^"\r\n]{{8,}}+(?="|\z)|'[^'\r\n]{{8,}}+(?='|\z)|(?=\S*[^\p{{L}}\s"'.,;:!?)]|\S*\p{{Ll}}\p{{Lu}})[^\s"']{{8,}}+)"""
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "г-н", "господин", "κύριος", "السيد", "श्री")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mademoiselle", "Mlle", "Signora", "г-жа", "госпожа", "κυρία", "السيدة", "श्रीमती")
NEUTRAL = ("Dr", "Prof")
_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=lambda t: (-len(t), t)))
#: A possessive 's stays outside.
_CASED = r"\p{Lu}(?=[\p{L}\p{M}'’])[\p{L}\p{M}]*+(?:['’](?![sS](?![\p{L}\p{M}]))[\p{L}\p{M}]++)*+"
#: Scripts without capitals: a word; without blanks between words, a few letters.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_UNCASED = rf"(?:{_UNSPACED}{{2,4}}+|(?!{_UNSPACED})\p{{Lo}}[\p{{Lo}}\p{{M}}]++)"
MENTION = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_CASED}|(?!{_UNSPACED})\p{{Lo}}[\p{{Lo}}\p{{M}}]++)(?!\p{{N}})"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?iu:{_TITLES})\.?[ \t](?:{_CASED}(?:[ \t\-]{_CASED}){{0,2}}|{_UNCASED}(?:[ \t·]{_UNCASED})?)"
#: In the order in which an alternative is preferred.
ENTITY = "|".join((EMAIL, SECRET, HEX, IBAN, IP, IPV6, PHONE, LOCAL_PHONE, CARD, SSN, GROUPED_PHONE, TRUNK_PHONE, NAME))
NUMBERS = ("phone", "number", "ssn", "iban", "ip")

#: Syllables of made-up names by script.
SYLLABLES = {
    "latin": ["ba", "den", "fo", "gar", "hi", "jo", "kel", "lu", "mar", "ni", "pol", "ra", "sel", "ta", "vo", "win"],
    "cyrillic": ["ба", "вел", "го", "дар", "зи", "ка", "лен", "ма", "ни", "пол", "ра", "сел", "та", "фо", "хи", "ше"],
    "greek": ["βα", "γελ", "δο", "ζαρ", "θι", "κα", "λεν", "μα", "νι", "πολ", "ρα", "σελ", "τα", "φο", "χι", "ψε"],
}
ENDINGS = {"latin": ("on", "a", "i"), "cyrillic": ("ов", "ова", "енко"), "greek": ("ος", "α", "ι")}
#: First of 19 letters of further scripts, and their distance: sixteen syllables, then endings.
FURTHER = {
    "han": (0x5B89, 29), "hangul": (0xAC00, 588), "hiragana": (0x304B, 2), "katakana": (0x30AB, 2), "arabic": (0x0628, 1), "hebrew": (0x05D0, 1),
    "devanagari": (0x0915, 1), "bengali": (0x0995, 1), "tamil": (0x0B95, 1), "thai": (0x0E01, 1), "georgian": (0x10D0, 1), "armenian": (0x0561, 1), "ethiopic": (0x1200, 8),
}
for _name, (_first, _step) in FURTHER.items():
    _letters = [c for c in (chr(_first + _step * i) for i in range(40)) if c.isalpha()][:19]
    SYLLABLES[_name], ENDINGS[_name] = _letters[:16], tuple(_letters[16:])
#: Scripts whose names are short, as each letter is a syllable.
SHORT = ("han", "hangul")
#: Syllables before the ending: 16 to their number is what a script's names are drawn from.
NAME_SYLLABLES = 6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary"), 256)


def _stream(seed: Column, n: Column) -> Column:
    """At least n hexadecimal digits drawn from a seed."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 64).cast("int")), lambda i: F.sha2(F.concat_ws(":", seed, i.cast("string")).cast("binary"), 256)), "")


def _number(stream: Column, i: Column | int) -> Column:
    """The i-th number of four hexadecimal digits of a stream."""
    at = (F.lit(i) if isinstance(i, int) else i) * 4 + 1
    return F.conv(F.substr(stream, at, F.lit(4)), 16, 10).cast("int")


def _drawn(i: Column, below: int) -> Column:
    """The i-th number below `below`, from four digits of the column stream each."""
    return F.pmod(_number(F.col("stream"), i), F.lit(below))


def _word(pool: list[str], start: int, size: int | Column) -> Column:
    """Members of a pool, drawn one after another."""
    members = F.array(*map(F.lit, pool))
    last = F.lit(start) + (F.lit(size) if isinstance(size, int) else size) - 1
    return F.array_join(F.transform(F.sequence(F.lit(start), last.cast("int")), lambda i: F.element_at(members, _drawn(i, len(pool)) + 1)), "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


SIGNS = "!#$%&*+-.:=?@^_~"


def _shifted(char: Column, by: Column, hexadecimal: Column) -> Column:
    """A character moved inside its class: digits of 16 where hexadecimal is x or X, else digits, a-z, A-Z, signs; other letters become one of a-z or A-Z."""

    def move(first: str, n: int) -> Column:
        return F.chr((F.pmod(F.ascii(char) - ord(first) + by, F.lit(n)) + ord(first)).cast("long"))

    moved = F.hex(F.pmod(F.conv(char, 16, 10).cast("int") + by, F.lit(16)))
    sign = F.instr(F.lit(SIGNS), char)
    return (
        F.when(hexadecimal == "X", moved)
        .when(hexadecimal == "x", F.lower(moved))
        .when(char.rlike("^[0-9]$"), move("0", 10))
        .when(char.rlike("^[a-z]$"), move("a", 26))
        .when(char.rlike("^[A-Z]$"), move("A", 26))
        .when(char.rlike(r"^\p{Ll}|\p{Lo}$"), F.chr((F.pmod(by, F.lit(26)) + 97).cast("long")))
        .when(char.rlike(r"^\p{Lu}$"), F.chr((F.pmod(by, F.lit(26)) + 65).cast("long")))
        .otherwise(F.substr(F.lit(SIGNS), F.pmod(sign + by, F.lit(len(SIGNS))) + 1, F.lit(1)))
    )


def _permuted(text: Column, seed: Column) -> Column:
    """A keyed permutation of the texts of ASCII digits and capitals with the same class at each place: halves shift one another."""
    half = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(_chars(F.substr(text, F.lit(1), half)).alias("a"), _chars(F.substr(text, half + 1)).alias("b"))

    def once(state: Column, i: Column) -> Column:
        stream = _stream(_digest(seed, i.cast("string"), F.array_join(state["b"], "")), F.size(state["a"]) * 4)
        moved = _let(stream, lambda s: F.transform(state["a"], lambda c, k: _shifted(c, _number(s, k), F.lit(""))))
        return F.struct(state["b"].alias("a"), moved.alias("b"))

    # an even number of rounds leaves the halves where they were
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, once, lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))


def _permuted_address(norm: Column, seed: Column) -> Column:
    """A keyed permutation of all IPv4 addresses."""
    octets = F.transform(F.split(norm, r"\."), lambda x: x.cast("int"))
    start = F.struct((F.get(octets, F.lit(0)) * 256 + F.get(octets, F.lit(1))).alias("a"), (F.get(octets, F.lit(2)) * 256 + F.get(octets, F.lit(3))).alias("b"))

    def once(state: Column, i: Column) -> Column:
        by = _number(_digest(seed, i.cast("string"), state["b"].cast("string")), 0)
        return F.struct(state["b"].alias("a"), F.pmod(state["a"] + by, F.lit(65536)).alias("b"))

    def whole(s: Column) -> Column:
        return F.concat_ws(".", *((F.floor(s[x] / 256) if high else F.pmod(s[x], F.lit(256))).cast("string") for x in "ab" for high in (True, False)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, once, whole)


def _mod97(iban: Column) -> Column:
    """The remainder that the check digits of an IBAN (without blanks) make 1."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    digits = F.array_join(F.transform(_chars(turned), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(_chars(digits), F.lit(0), lambda a, d: F.pmod(a * 10 + d.cast("int"), F.lit(97)))


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit rule over all digits; divisible by ten for a valid number."""
    chars = F.reverse(_chars(digits))
    each = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def kind_of(found: Column) -> Column:
    """The kind of a match; none, if its check digits are wrong."""
    def whole(pattern: str) -> Column:
        return found.rlike(f"^(?:{pattern})$")

    return (
        F.when(whole(EMAIL), "email")
        .when(whole(SECRET) | whole(HEX), "secret")
        .when(whole(IBAN), F.when(_mod97(F.replace(found, F.lit(" "))) == 1, "iban").otherwise("none"))
        .when(whole(IP), "ip")
        .when(whole(IPV6), "ip6")
        .when(whole(PHONE) | whole(LOCAL_PHONE), "phone")
        .when(whole(CARD), F.when(F.pmod(_luhn(F.regexp_replace(found, "[^0-9]", "")), F.lit(10)) == 0, "number").otherwise("none"))
        .when(whole(SSN), "ssn")
        .when(whole(GROUPED_PHONE) | whole(TRUNK_PHONE), "phone")
        .otherwise("name")
    )


def _value(found: Column, kind: Column) -> Column:
    """What is replaced of a match: all of it, a secret's value, or the name behind a title."""
    secret = F.when(found.rlike(f"^(?:{HEX})$"), found).otherwise(F.regexp_extract(found, rf"(?s)^{_NAMED}[\"']?(.*)$", 1))
    return F.when(kind == "secret", secret).when(kind == "name", F.regexp_extract(found, rf"^(?iu:{_TITLES})\.?[ \t](.*)$", 1)).otherwise(found)


def _gender(found: Column) -> Column:
    title = F.regexp_extract(found, rf"^(?iu:({_TITLES}))\.?[ \t]", 1)
    low = F.lower(title)
    return F.when(low.isin([t.lower() for t in MALE]), 0).when(low.isin([t.lower() for t in FEMALE]), 1).otherwise(2)


def _script(value: Column) -> Column:
    script = F.lit("latin")
    for name in SYLLABLES:
        if name != "latin":
            script = F.when(value.rlike(rf"^\p{{Is{name.capitalize()}}}"), name).otherwise(script)
    return script


def _groups(address: Column) -> Column:
    """An IPv6 address with all its eight groups of four digits."""
    octets = [F.regexp_extract(address, r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)$", i).try_cast("int") for i in (1, 2, 3, 4)]
    plain = F.when(octets[0].isNotNull(), F.concat(F.regexp_replace(address, r"[0-9]+(?:\.[0-9]+){3}$", ""), F.hex(octets[0] * 256 + octets[1]), F.lit(":"), F.hex(octets[2] * 256 + octets[3]))).otherwise(address)
    left, right = (F.filter(F.split(F.coalesce(F.get(F.split(plain, "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "") for i in (0, 1))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(F.lower(g), 4, "0")), ":")


def parts_of(found: Column) -> Column:
    """array<struct<kind, norm, shape, part>>: the entities in a match; a name has one for each of its parts."""
    kind = kind_of(found)
    value = _value(found, kind)
    digits = F.regexp_replace(value, "[^0-9]", "")
    norm = F.when(kind.isin("phone", "number", "ssn"), digits).when(kind == "iban", F.replace(value, F.lit(" "))).when(kind == "ip6", _groups(value)).when(kind == "secret", value).otherwise(F.lower(value))
    shape = (
        F.when(kind == "phone", F.when(value.startswith("+") | digits.startswith("0"), "+").otherwise(""))
        .when(kind == "secret", F.when(value.rlike("^[0-9a-f]+$"), "x").when(value.rlike("^[0-9A-F]+$"), "X").otherwise(""))
        .when(kind == "email", F.when(value.rlike("[0-9][^@]*@"), "d").otherwise("l"))
        .otherwise("")
    )
    words = F.split(value, r"[ \t\-·]+")
    last = F.size(words) - 1
    names = F.transform(
        words,
        lambda w, i: F.struct(
            F.when(i == last, "family").otherwise("given").alias("kind"),
            F.lower(w).alias("norm"),
            F.concat(_script(w), F.when(i == last, "2").otherwise(_gender(found).cast("string"))).alias("shape"),
            w.alias("part"),
        ),
    )
    one = F.array(F.struct(kind.alias("kind"), norm.alias("norm"), shape.alias("shape"), value.alias("part")))
    return F.when(kind == "name", names).otherwise(one)


def candidates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, norm, shape, draw) with surrogate: what each draws when it asks for the draw-th time."""
    kind, shape, norm = F.col("kind"), F.col("shape"), F.col("norm")
    # a number's digest holds the draw but not the number, so that one draw is one permutation
    seed = _digest(key, kind, F.when(kind.isin(*NUMBERS), F.lit("")).otherwise(norm), F.col("draw").cast("string"))
    longer = F.greatest(F.lit(0), F.floor((F.col("draw") - 4) / 4)).cast("int")
    staged = entities.withColumn("seed", seed).withColumn("longer", longer).withColumn("stream", _stream(F.col("seed"), F.greatest(F.lit(256), F.length(norm) * 4) + 64 + F.col("longer") * 4))
    seed = F.col("seed")
    body = _permuted(F.substr(norm, F.lit(1), F.length(norm) - 1), seed)
    card = _let(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    phone = F.when(shape == "+", F.concat(F.substring(norm, 1, 1), _permuted(F.substr(norm, F.lit(2)), seed))).otherwise(_permuted(norm, seed))
    iban = _let(
        F.concat(F.substring(norm, 1, 2), F.lit("00"), _permuted(F.substr(norm, F.lit(5)), seed)),
        lambda x: F.concat(F.substring(x, 1, 2), F.lpad((98 - _mod97(x)).cast("string"), 2, "0"), F.substr(x, F.lit(5))),
    )
    letters = [chr(97 + i) for i in range(26)]
    secret = F.concat(F.array_join(F.transform(_chars(norm), lambda c, i: _shifted(c, _number(F.col("stream"), i), shape)), ""), F.when(F.col("longer") > 0, F.right("stream", F.col("longer"))).otherwise(""))
    number_part = F.when(shape == "d", F.concat(F.lit("."), *(_drawn(F.lit(i), 10).cast("string") for i in (30, 31)))).otherwise("")
    email = F.concat(_word(letters, 0, 12 + F.col("longer")), number_part, F.lit("@"), _word(letters, 40, 6), F.lit(".example"))
    names = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        ending = F.element_at(F.array(*map(F.lit, ENDINGS[script])), F.substring(shape, -1, 1).try_cast("int") + 1)
        size = NAME_SYLLABLES if script not in SHORT else 1 + F.least(F.col("draw"), F.lit(1))
        names = F.when(shape.startswith(script), F.concat(_word(syllables, 0, size + F.col("longer")), ending)).otherwise(names)
    surrogate = (
        F.when(kind == "email", email)
        .when(kind == "ip", _permuted_address(norm, seed))
        .when(kind == "ip6", F.regexp_replace(F.substr("stream", F.lit(1), F.lit(32)), "(.{4})(?!$)", "$1:"))
        .when(kind == "phone", phone)
        .when(kind == "ssn", _permuted(norm, seed))
        .when(kind == "number", card)
        .when(kind == "iban", iban)
        .when(kind == "secret", secret)
        .otherwise(names)
    )
    return staged.withColumn("surrogate", surrogate).drop("seed", "stream", "longer")


def surrogates(entities: DataFrame, key: str, draw_from=candidates) -> DataFrame:
    """(kind, norm, surrogate) for the distinct entities (kind, norm, shape); no two of a kind alike, none an entity itself while there is room."""
    fresh = cut(entities.groupBy("kind", "norm").agg(F.min("shape").alias("shape")))
    originals = fresh.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("taken"))
    state = fresh.select("*", F.lit(0).alias("draw"), F.lit(False).alias("settled"))
    number = F.col("kind").isin(*NUMBERS)
    draw = 0
    while True:
        drawn = draw_from(state, key)
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy(F.desc("settled"), "norm"))
        checked = drawn.withColumn("place", place).join(originals, ["kind", "surrogate"], "left")
        free = F.col("settled") | (F.col("place") == 1) & F.col("taken").isNull()
        again = F.when(number & F.lit(draw >= MOST_DRAWS), F.lit(0)).otherwise(F.col("draw") + 1)
        # a number that takes its first draw, an entity of the corpus, meets no other: the permutation parts them
        free = free | (number & F.lit(draw > MOST_DRAWS) & (F.col("draw") == 0))
        state = cut(checked.select("kind", "norm", "shape", F.when(free, F.col("draw")).otherwise(again).alias("draw"), free.alias("settled"), "surrogate"))
        if state.filter("NOT settled").isEmpty():
            return state.select("kind", "norm", "surrogate")
        state = state.drop("surrogate")
        draw += 1


def _in_form(part: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the form in which the entity stands: its separators, its case."""

    def spaced(pattern: str) -> Column:
        return F.array_join(F.transform(F.split(part, pattern, -1), lambda g, i: F.concat(g, F.coalesce(F.get(_chars(surrogate), i), F.lit("")))), "")

    upper = (part == F.upper(part)) & (part != F.lower(part))
    cased = F.when(upper, F.upper(surrogate)).when(kind.isin("given", "family"), F.initcap(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "number", "ssn"), spaced("[0-9]")).when(kind == "iban", spaced("[0-9A-Z]")).when(kind == "secret", surrogate).otherwise(cased)


def _renamed(piece: Column) -> Column:
    """Text outside the matches, its mentions of the column names' keys replaced."""
    found = F.regexp_extract_all(piece, F.lit(MENTION), F.lit(0))

    def renamed(mention: Column) -> Column:
        return F.coalesce(_in_form(mention, F.lit("family"), F.try_element_at("names", F.lower(mention))), mention, F.lit(""))

    words = F.array_join(F.transform(F.split(piece, MENTION, -1), lambda gap, i: F.concat(gap, renamed(F.get(found, i)))), "")
    return F.aggregate(_unspaced(), words, lambda t, e: F.replace(t, e["key"], e["value"]))


def _unspaced() -> Column:
    """The column names' entries in scripts without blanks, which are found inside a run of letters; the longest first."""
    some = F.filter(F.map_entries("names"), lambda e: e["key"].rlike(f"^{_UNSPACED}{{2}}"))
    return F.array_sort(some, lambda a, b: F.length(b["key"]) - F.length(a["key"]))


def _mentions(piece: Column) -> Column:
    """How many mentions _renamed replaces."""
    words = F.size(F.filter(F.regexp_extract_all(piece, F.lit(MENTION), F.lit(0)), lambda m: F.map_contains_key("names", F.lower(m))))
    return F.aggregate(_unspaced(), words, lambda n, e: n + F.floor((F.length(piece) - F.length(F.replace(piece, e["key"]))) / F.length(e["key"])).cast("int"))


def may_hold(text: Column) -> Column:
    """False only for texts without an entity; null for a null text."""
    digits = text.rlike(r"[0-9](?:[^0-9]{0,3}[0-9]){3}")
    assigned = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(r"(?i:token|secret|passw|key)[\"']?\s{0,3}[=:]|(?i:passw)[a-z]{1,3}[\"']?\s{0,3}[=:]")
    six = F.contains(text, F.lit(":")) & text.rlike(r":[0-9A-Fa-f]{0,4}:")
    long = text.rlike("[0-9]") & text.rlike("[0-9A-Fa-f]{32}")
    titled = text.rlike(rf"(?<![\p{{L}}\p{{N}}])(?iu:{_TITLES})\.?[ \t]")
    return F.contains(text, F.lit("@")) | digits | assigned | six | long | titled


def session_key(spark: SparkSession, otherwise: str | None = None) -> str:
    """The session's key; where it has none, `otherwise`, or ValueError."""
    key = spark.conf.get(KEY_SETTING, None) or otherwise
    if not key:
        raise ValueError(f"surrogates need a key: set {KEY_SETTING}")
    return key


def replace(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """(row, text, n_entities): row is a struct of all columns of docs, text the one with surrogates. Without a key, the session's is taken."""
    key = key or session_key(docs.sparkSession)
    source = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    # equal texts share a key: two hashes and the length
    named = [F.xxhash64("text").alias("k1"), F.crc32(F.col("text").cast("binary")).alias("k2"), F.length("text").alias("k3")]
    keys = ["k1", "k2", "k3"]
    found = source.filter(may_hold(F.col("text"))).select(*named, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("found")).filter(F.size("found") > 0)
    each = found.groupBy(*keys).agg(F.first("found").alias("found")).select(*keys, F.posexplode("found").alias("at", "match"))
    each = cut(each.select(*keys, "at", "match", F.posexplode(parts_of(F.col("match"))).alias("i", "p")).select(*keys, "at", "match", "i", "p.*"))
    # the part's surrogate, then the match with its parts replaced, then a text's matches in order
    mapped = each.join(surrogates(each.filter("kind <> 'none'").select("kind", "norm", "shape"), key), ["kind", "norm"], "left")
    formed = mapped.select(*keys, "at", "match", "kind", "norm", "surrogate", "i", "part", F.coalesce(_in_form(F.col("part"), F.col("kind"), F.col("surrogate")), "part").alias("new"))
    whole = formed.groupBy(*keys, "at").agg(F.first("match").alias("match"), F.sort_array(F.collect_list(F.struct("i", "part", "new", "kind", "norm", "surrogate"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0), lambda a, p: a + F.length(p["part"])) + F.size("parts") - 1
    head = F.expr("substring(match, 1, char_length(match) - char_length(tail))")
    gaps = F.regexp_extract_all(F.col("tail"), F.lit(r"[ \t\-·]+"), F.lit(0))
    name = F.array_join(F.transform("parts", lambda p, i: F.concat(F.when(i > 0, F.coalesce(F.get(gaps, i - 1), F.lit(" "))).otherwise(""), p["new"])), "")
    whole = whole.withColumn("tail", F.substr("match", F.char_length("match") - total + 1))
    texts = whole.select(*keys, F.filter("parts", lambda p: p["kind"].isin("given", "family")).alias("names"), F.when(F.get("parts", F.lit(0))["kind"] == "none", 0).otherwise(1).alias("real"), F.struct("at", F.concat(head, F.when(F.size("parts") > 1, name).otherwise(F.get("parts", F.lit(0))["new"])).alias("new")).alias("m")).groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("new"), F.flatten(F.collect_list("names")).alias("names"), F.sum("real").cast("int").alias("real"))
    # a text's names by norm; one that is a given and a family name is the family's
    named_parts = F.array_sort(F.array_distinct(F.transform("names", lambda p: F.struct(p["norm"], p["kind"], p["surrogate"]))))
    texts = texts.select(*keys, "new", "real", named_parts.alias("names"))
    once = F.filter("names", lambda p, i: (i == 0) | (p["norm"] != F.get("names", i - 1)["norm"]))
    texts = texts.select(*keys, "new", "real", F.map_from_entries(F.transform(once, lambda p: F.struct(p["norm"], p["surrogate"]))).alias("names"))
    texts = cut(texts)  # so that the join below has an exchange of its own on either side, and a hot text is split
    pieces = F.split("text", ENTITY, -1)
    text = F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(F.size("names") > 0, _renamed(p)).otherwise(p), F.coalesce(F.get(F.col("new"), i)["new"], F.lit("")))), "")
    mentions = F.aggregate(pieces, F.lit(0), lambda a, p: a + _mentions(p))
    found_in = F.col("real") + F.when(F.size("names") > 0, mentions).otherwise(0)
    maybe = F.coalesce(may_hold(F.col("text")), F.lit(False))
    joined = (
        source.filter(maybe)
        .select("row", "text", *named)
        .join(texts, keys, "left")
        .select("row", F.when(F.col("new").isNotNull(), text).otherwise(F.col("text")).alias("text"), F.coalesce(F.when(F.col("new").isNotNull(), found_in), F.lit(0)).alias("n_entities"))
    )
    return joined.union(source.filter(~maybe).select("row", "text", F.lit(0).alias("n_entities")))


def anonymise(docs: DataFrame, text_col: str = "text", length_col: str | None = None, key: str | None = None) -> DataFrame:
    """docs with surrogates in text_col; length_col, if named, gets the new text's characters."""
    done = replace(docs, text_col, key)
    values = {text_col: F.col("text")} | ({length_col: F.char_length("text").cast(docs.schema[length_col].dataType)} if length_col else {})
    return done.select(*(values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key=session_key(spark, DEMO_KEY))
    return done.select(F.col("row.doc_id").alias("doc_id"), "text", "n_entities")
