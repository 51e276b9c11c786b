"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern and replaced where they stand. A surrogate is drawn from a keyed
digest of the entity, so every mention of an entity, however it is spaced or capitalised, gets the same
one, in every document. The distinct entities of the corpus are checked: where two would get one
surrogate, or a surrogate is itself an entity of the corpus, another is drawn until none is left.

Persons are found by a title. A given name is drawn by the name alone and ends as the person's gender
has it: the title's, or where the title tells none, that of the other titled mentions of the full name in
the corpus if they agree. In a document that has titled persons, their full names and surnames are
replaced without a title too; a given name that stands alone is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import columns_free, settle

# Titles with the gender they tell, signs of secrets, letters and syllables by script.
MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Г-н", "Господин", "господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "Г-жа", "Госпожа", "госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]
SIGNS = "[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API_KEY"
LETTERS = {"latin": "abcdefghijklmnop", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}
SYLLABLES = {
    "latin": "ba be bi da de ka ke li lo ma mi na no ra ri so".split(),
    "cyrillic": "ба бе би да де ка ке ли ло ма ми на но ра ри со".split(),
    "greek": "βα βε βι δα δε κα κε λι λο μα μι να νο ρα ρι σο".split(),
}
ENDINGS = {"latin": ("n", "na", "r"), "cyrillic": ("н", "на", "р"), "greek": ("ς", "να", "ν")}  # male, female, neither
PLAIN = 4  # draws in an entity's own format; later ones are longer, so that full formats end too
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}

_titles = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
PERSON = rf"(?<!\p{{L}})(?:{_titles})\.?[  ]\p{{Lu}}\p{{Ll}}+(?:[  -]\p{{Lu}}\p{{Ll}}+)?"
# Labels and domains have a greatest length, so the matcher's depth does not grow with the text.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,126}\p{L}{2,63}"
PART = "[ \u00a0-]"
BARE = rf"\p{{Lu}}\p{{Ll}}+(?:{PART}\p{{Lu}}\p{{Ll}}+)?"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\p{L}\p{N}-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\p{N}])"
ACCESS = r"(?<![\p{L}\p{N}])AKIA[A-Z0-9]{16}(?![\p{L}\p{N}])"
LABEL = rf"(?:{SIGNS})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?"
SECRET = rf"{LABEL}[^\s\"',;]{{6,}}"
HEX = r"(?<![\p{L}\p{N}])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,64}(?![\p{L}\p{N}])"
#: One pattern, in this order; a look at the first character spares most places the kinds that cannot begin there.
ENTITY = "|".join(
    [
        EMAIL,
        f"(?=[PpSsTtAa]){SECRET}",
        f"(?=[0-9+(])(?:{IP}|{PHONE}|{SSN}|{CARD})",
        f"(?=[A-Z])(?:{ACCESS}|{IBAN})",
        f"(?=[0-9a-f]{{32}}){HEX}",
        f"(?=[MHFSDPГгΚ]){PERSON}",
    ]
)
#: Texts without any of these hold no entity; nearly all texts are told apart by this alone.
HINT = rf"[0-9@=:]|(?=[MHFSDPГгΚ])(?:{_titles})[.  ]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, however often it stands there."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def entities(text: Column) -> Column:
    """Array of the entities in a text, in order; empty for null."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _titled(found: Column) -> Column:
    """The persons with a title among a text's entities."""
    return F.filter(found, lambda e: e.rlike(f"^(?:{PERSON})$"))


def _with_names(persons: Column) -> Column:
    """The pattern of all entities and of these persons' full names and surnames, whole words only."""

    def names(p: Column) -> Column:
        return F.struct(F.concat(p["given"], p["surname"]).alias("full"), p["surname"].alias("surname"))

    def pattern(found: Column) -> Column:
        # full names before surnames, so that the longer one is taken
        words = F.filter(F.array_union(F.transform(found, lambda n: n["full"]), F.transform(found, lambda n: n["surname"])), lambda w: F.length(w) >= 3)
        return F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?=\p{Lu})(?:"), F.regexp_replace(F.array_join(words, "|"), PART, PART), F.lit(r")(?!\p{L})"))

    return _let(F.transform(persons, lambda e: _let(_split_person(e), names)), pattern)


def mentions(text: Column) -> Column:
    """``entities`` and the mentions without title of the persons among them, in order."""

    def named(found: Column) -> Column:
        return _let(_titled(found), lambda p: F.when(F.size(p) > 0, F.regexp_extract_all(text, _with_names(p), F.lit(0))).otherwise(found))

    return _let(entities(text), named)


def _kind(e: Column) -> Column:
    is_a = lambda p: e.rlike(f"^(?:{p})$")
    return (
        F.when(is_a(EMAIL), "email").when(is_a(IP), "ip").when(is_a(PHONE), "phone").when(is_a(SSN), "ssn").when(is_a(CARD), "card")
        .when(is_a(ACCESS), "access").when(is_a(IBAN), "iban").when(is_a(PERSON) | is_a(BARE), "person").otherwise("secret")
    )


def _split_person(e: Column) -> Column:
    """Struct of the title with the blank after it, given name with what follows it, surname, gender."""
    title = F.regexp_extract(e, rf"^((?:{_titles})\.?[  ])", 1)
    name = F.substr(e, F.length(title) + 1)
    given = F.regexp_extract(name, r"^(\p{L}+[  -])\p{L}+$", 1)
    bare = F.regexp_replace(title, r"\.?[  ]$", "")
    gender = F.when(bare.isin(MALE), "male").when(bare.isin(FEMALE), "female").otherwise("person")
    return F.struct(title.alias("title"), given.alias("given"), F.substr(name, F.length(given) + 1).alias("surname"), gender.alias("gender"))


def _first(p: Column) -> Column:
    return F.regexp_replace(p["given"], PART + "$", "")


def _full(p: Column) -> Column:
    return F.concat(_first(p), F.lit(" "), p["surname"])


def _neutral(name: Column) -> Column:
    """A name with the ending that tells no gender, in place of any that surrogates have."""
    for male, female, neither in ENDINGS.values():
        name = F.regexp_replace(name, f"(?:{female}|{male}|{neither})$", neither)
    return name


def _canonical(kind: Column, e: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "secret", F.regexp_replace(e, f"^{LABEL}", ""))
        .when(kind.isin("phone", "ssn", "card", "iban"), F.regexp_replace(e, r"[^\p{L}\p{N}]", ""))
        .otherwise(e)
    )


def units(e: Column) -> Column:
    """What is mapped in an entity: structs kind, canonical, mention.

    A person's given name and surname are two; a third, of kind gender, tells the full name and the title's gender.
    """
    unit = lambda k, c, m: F.struct(k.alias("kind"), c.alias("canonical"), m.alias("mention"))

    def of_person(p: Column) -> Column:
        first = _first(p)
        family = unit(F.lit("surname"), p["surname"], p["surname"])
        gender = unit(F.lit("gender"), _full(p), p["gender"])
        return F.when(p["given"] != "", F.array(unit(F.lit("given"), first, first), family, gender)).otherwise(F.array(family))

    return _let(
        _kind(e), lambda k: F.when(k == "person", _let(_split_person(e), of_person)).otherwise(F.array(unit(k, _canonical(k, e), e)))
    )


def _draw(key: str, kind: Column, canonical: Column, nonce: Column) -> Column:
    """128 hexadecimal digits that only the key tells."""
    part = lambda s: F.sha2(F.concat_ws("|", F.lit(key), F.lit(s), kind, canonical, nonce.cast("string")).cast("binary"), 256)
    return F.concat(part("a"), part("b"))


def _value(h: Column, i: Column) -> Column:
    """The i-th hexadecimal digit as a number; i from 0, over and over."""
    return F.conv(F.substr(h, F.pmod(i, F.lit(128)).cast("int") + 1, F.lit(1)), 16, 10).cast("int")


def _filled(e: Column, h: Column, fixed: Column, hexadecimal: Column, spaced: bool = True) -> Column:
    """Every letter and digit after the first ``fixed`` characters replaced by one of its kind, case and script.

    Where mentions of one entity may be ``spaced`` in different ways, a character's draw goes by the letters and
    digits up to it, which costs the square of the length: for short formats alone. Else it goes by its place.
    """

    def one(c: Column, before: Column) -> Column:
        i = before + 1
        place = F.length(F.regexp_replace(F.substr(e, F.lit(1), i), r"[^\p{L}\p{N}]", "")) if spaced else i
        v = _value(h, place)
        # two digits of the draw, so that ten is met evenly
        digit = ((v * 16 + _value(h, place + 61)) % 10).cast("string")
        letter = F.lit(None).cast("string")
        for script, letters in LETTERS.items():
            letter = F.coalesce(letter, F.when(c.rlike(SCRIPTS[script]), F.substr(F.lit(letters), v + 1, F.lit(1))))
        letter = F.when(hexadecimal, F.substr(F.lit("abcdef"), v % 6 + 1, F.lit(1))).otherwise(F.coalesce(letter, F.substr(F.lit(LETTERS["latin"]), v + 1, F.lit(1))))
        return (
            F.when(i <= fixed, c).when(c.rlike(r"\p{N}"), digit).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)
        )

    return F.array_join(F.transform(F.regexp_extract_all(e, F.lit("(?s)."), F.lit(0)), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check of card numbers, the last digit included."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _name(kind: Column, mention: Column, h: Column, nonce: Column) -> Column:
    def syllable(of: Column):
        return lambda i: F.element_at(of, _value(h, i) + 1)

    out = F.lit(None).cast("string")
    for script in reversed(list(SYLLABLES)):
        syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        male, female, neither = ENDINGS[script]
        stem = F.array_join(F.transform(F.sequence(F.lit(0), nonce + 3), syllable(syllables)), "")
        own = F.when(mention.rlike("[ая]$"), female).otherwise(male) if script == "cyrillic" else F.lit(neither)  # surnames tell it too
        end = F.when(kind == "given male", male).when(kind == "given female", female).when(kind == "surname", own).otherwise(neither)
        drawn = F.initcap(F.concat(stem, end))
        # names in other scripts get latin ones
        out = F.when(mention.rlike(SCRIPTS[script]), drawn).otherwise(F.coalesce(out, drawn) if script == "latin" else out)
    return out


def _widened(kind: Column, value: Column, h: Column, nonce: Column) -> Column:
    """What later draws append: four more characters a draw, digits or letters as the format has them."""
    drawn = F.substr(h, F.lit(81), F.least(4 * (nonce - PLAIN + 1), F.lit(48)))
    letters = F.translate(drawn, "0123456789abcdef", LETTERS["latin"])
    of_kind = (
        F.when(kind.isin("phone", "ssn", "card"), F.translate(drawn, "abcdef", "012345"))
        .when(kind.isin("access", "iban"), F.upper(letters)).when(value.rlike("^[0-9a-f]+$"), drawn).otherwise(letters)
    )
    return F.when(nonce < PLAIN, "").otherwise(of_kind)


def surrogate(key: str, kind: Column, canonical: Column, mention: Column, nonce: Column) -> Column:
    """The replacement of one mention."""
    none, no = F.lit(0), F.lit(False)
    digits = lambda c: F.regexp_replace(c, r"\D", "")

    def card(c: Column) -> Column:
        zero = digits(F.regexp_replace(c, r"\d$", "0"))
        checked = F.concat(F.regexp_replace(c, r"\d$", ""), F.pmod(-_luhn(zero), F.lit(10)).cast("string"))
        return F.when(_luhn(digits(mention)) % 10 == 0, checked).otherwise(c)

    def secret(value: Column, h: Column) -> Column:
        label = F.substr(mention, F.lit(1), F.length(mention) - F.length(value))
        # a value of signs alone has nothing to replace by its kind: letters take its place
        filled = F.when(value.rlike(r"[\p{L}\p{N}]"), value).otherwise(F.repeat(F.lit("x"), F.length(value)))
        return F.concat(label, _filled(filled, h, none, value.rlike("^[0-9a-f]+$"), spaced=False), _widened(kind, value, h, nonce))

    def drawn(h: Column) -> Column:
        octet = lambda i: (_value(h, F.lit(i)) * 16 + _value(h, F.lit(i + 1))).cast("string")
        address = F.concat_ws(".", (_value(h, F.lit(0)) + 240).cast("string"), octet(1), octet(3), octet(5))
        local = F.substr(mention, F.lit(1), F.instr(mention, "@") - 1)
        groups = [F.substr(h, F.lit(81 + 4 * i), F.lit(4)) for i in range(6)]
        address = F.when(nonce < PLAIN, address).otherwise(F.concat_ws(":", F.lit("2001:db8"), *groups))
        host = F.translate(F.substr(h, F.lit(41), F.lit(8)), "0123456789abcdef", LETTERS["latin"])
        kept = (
            F.when(kind == "phone", F.length(F.regexp_extract(mention, r"^(\+\d{1,2}(?!\d)|\+\d)", 1)))
            .when(kind == "access", 4).when(kind == "iban", 2).when(kind == "card", 1).otherwise(0)
        )
        return (
            F.when(kind == "email", F.concat(_filled(local, h, none, no, spaced=False), _widened(kind, local, h, nonce), F.lit("@"), host, F.lit(".example.org")))
            .when(kind == "ip", address)
            .when(kind == "secret", _let(F.regexp_replace(mention, f"^{LABEL}", ""), lambda v: secret(v, h)))
            .when((kind == "surname") | kind.startswith("given"), _name(kind, mention, h, nonce))
            .otherwise(_let(_let(kept, lambda n: F.concat(_filled(mention, h, n, no), _widened(kind, mention, h, nonce))), lambda c: F.when(kind == "card", card(c)).otherwise(c)))
        )

    # one draw for a given name, whatever its gender
    return _let(_draw(key, F.substring_index(kind, " ", 1), canonical, nonce), drawn)


def nonces(found: DataFrame, key: str) -> DataFrame:
    """Entities whose first draw is taken: kind, canonical, nonce. Draws again until all are distinct.

    ``found`` has one row per ``kind, canonical`` and a ``mention``. Later draws are longer (see ``PLAIN``),
    so the rounds end however full a format is.
    """
    now = settle(found.withColumn("nonce", F.lit(0)), "entities")
    real = now.select("kind", F.when(F.col("kind") == "given", _neutral(F.col("canonical"))).otherwise(F.col("canonical")).alias("drawn"))
    while True:
        drawn = now.withColumn("drawn", _canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("canonical"), F.col("mention"), F.col("nonce"))))
        drawn = settle(drawn, "draws")
        first = drawn.groupBy("kind", "drawn").agg(F.min("canonical").alias("first"), F.count("*").alias("n")).filter("n > 1")
        taken = drawn.join(first.select("kind", "drawn", "first"), ["kind", "drawn"]).filter("canonical <> first").select("kind", "canonical")
        taken = taken.union(drawn.join(real, ["kind", "drawn"], "left_semi").select("kind", "canonical")).distinct()
        taken = settle(taken.withColumn("again", F.lit(1)), "taken")
        if taken.isEmpty():
            return now.filter("nonce > 0").select("kind", "canonical", "nonce")
        now = settle(
            now.join(taken, ["kind", "canonical"], "left").withColumn("nonce", F.col("nonce") + F.coalesce("again", F.lit(0))).drop("again"), "entities"
        )


def genders(units: DataFrame) -> DataFrame:
    """Full names that stand with titles of one gender, and without such a title elsewhere: kind, canonical, nonce.

    ``nonce`` is 1 for male and 2 for female.
    """
    said = lambda g: F.bool_or(F.col("mention") == g)
    seen = units.filter("kind = 'gender'").groupBy("kind", "canonical").agg(said("male").alias("m"), said("female").alias("f"), said("person").alias("p"))
    return seen.filter("p and m <> f").select("kind", "canonical", F.when(F.col("m"), 1).otherwise(2).alias("nonce"))


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces entities in ``text`` and adds ``n_entities``; all other columns stay.

    Found are e-mail and IPv4 addresses, phone, card, social security and account numbers, access keys,
    values named password, secret, token or key, long hexadecimal ids, and persons after a title, with the
    other mentions of their full names and surnames (three letters or more) in the document. A full name
    that has titles of both genders in the corpus keeps each title's, and is neutral elsewhere. Texts
    without entities stay as they are; null stays null with no entities. Runs jobs over the distinct
    entities. Only texts with entities meet a join, and are shuffled only where more of them than a
    broadcast may hold have collided draws or a gender told elsewhere.
    """
    columns_free(docs, "n_entities", "_m", "_k", "_n")
    # written, as every later step needs the entities and the pattern is what costs
    rows = settle(docs.withColumn("_m", mentions(F.col(text))), "mentions")
    plain, rows = rows.filter(F.size("_m") == 0), rows.filter(F.size("_m") > 0)
    exploded = rows.select(F.explode(F.flatten(F.transform("_m", units))).alias("u")).select("u.*")
    found = settle(exploded.groupBy("kind", "canonical", "mention").agg(F.lit(1).alias("n")), "units")
    again = nonces(found.filter("kind <> 'gender'").groupBy("kind", "canonical").agg(F.min("mention").alias("mention")), key)
    again = settle(again.unionByName(genders(found)), "again")
    name = lambda k, c: F.concat(k, F.lit(":"), c)
    if again.isEmpty():
        nonce = lambda k, c: F.lit(0)
    else:
        # a document's draws by the hash of its entities; what one hash stands for holds for all of them
        rows = rows.withColumn("_k", F.xxhash64("_m"))
        named = rows.select("_k", F.explode(F.flatten(F.transform("_m", units))).alias("u"))
        named = named.select("_k", F.col("u.kind").alias("kind"), F.col("u.canonical").alias("canonical")).distinct().join(again, ["kind", "canonical"])
        maps = named.groupBy("_k").agg(F.map_from_entries(F.collect_set(F.struct(name(F.col("kind"), F.col("canonical")), "nonce"))).alias("_n"))
        rows = rows.join(settle(maps, "nonces"), "_k", "left")
        nonce = lambda k, c: F.coalesce(F.try_element_at(F.col("_n"), name(k, c)), F.lit(0))

    draw = lambda k, c, m: _let(nonce(F.substring_index(k, " ", 1), c), lambda n: surrogate(key, k, c, m, n))

    def of_person(p: Column) -> Column:
        mark = F.regexp_extract(p["given"], f"({PART})$", 1)
        told = F.element_at(F.array(F.lit("person"), F.lit("male"), F.lit("female")), nonce(F.lit("gender"), _full(p)).cast("int") + 1)
        gender = F.when(p["gender"] == "person", told).otherwise(p["gender"])
        given = F.concat(_let(F.concat(F.lit("given "), gender), lambda k: _let(_first(p), lambda first: draw(k, first, first))), mark)
        return F.concat(p["title"], F.when(p["given"] != "", given).otherwise(""), draw(F.lit("surname"), p["surname"], p["surname"]))

    def replaced(e: Column) -> Column:
        other = lambda k: _let(_canonical(k, e), lambda c: draw(k, c, e))
        return _let(_kind(e), lambda k: F.when(k == "person", _let(_split_person(e), of_person)).otherwise(other(k)))

    between = _let(_titled(F.col("_m")), lambda p: F.when(F.size(p) > 0, F.split(text, _with_names(p), -1)).otherwise(F.split(text, ENTITY, -1)))
    put = F.concat(F.transform("_m", replaced), F.array(F.lit("")))
    new = F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, b)), "")
    changed = rows.select(*[new.alias(text) if c == text else F.col(c) for c in docs.columns], F.size("_m").cast("long").alias("n_entities"))
    return changed.unionByName(plain.select(*docs.columns, F.lit(0).cast("long").alias("n_entities")))
