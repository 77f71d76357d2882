"""Personal data replaced by surrogates, as DataFrame expressions.

One pattern finds e-mail addresses, telephone numbers, card numbers, IBANs, social security numbers, IP
addresses, access keys and tokens, private keys, assigned secrets, dates of birth, street addresses and personal
names. What was found is replaced by a value made from a keyed digest of it: digits by digits, letters by
letters of the same case, names by names of the same gender and script, numbers with a checksum or forbidden
ranges by ones that are as good or bad. As the digest depends on the normalized value alone, mentions
of one entity stay mentions of one entity in all documents.

Distinctness is checked, not assumed: over the distinct values of the whole table, a value whose surrogate
another value already has, or which is itself a real value, is drawn again until none is left. Dates, house
numbers and initials, which name nobody by themselves and have few values, are drawn without that check.
"""

from __future__ import annotations

import hashlib
import json
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, release, table

#: The session setting with the key of op6_pii and the pipeline. Where it is unset, a session makes one for itself.
KEY_SETTING = "spark.maskwright.surrogates.key"
#: Given names by gender and script: what names are known by, and the lists that their surrogates come from.
FEMALE = (
    "Anna Maria Emma Laura Julia Sarah Helen Clara Marta Elena Sofia Alice Nora Irene Paula Greta Lucia Carmen Claire Jeanne Mary Linda Susan Karen Sophie Elizabeth Jennifer Patricia Barbara Jessica Margaret Nancy Lisa Betty "
    "Sandra Ashley Emily Michelle Amanda Melissa Stephanie Rebecca Cynthia Kathleen Catherine Katherine Christine Isabelle Camille Manon Chloe Amelie Ingrid Ursula Monika Sabine Petra Heike Teresa Pilar Isabel Rosa Beatriz Fatima Aisha Mei Yuki Priya"
).split()
MALE = (
    "John James Peter Paul Robert David Thomas Michael Hans Karl Jean Pierre Juan Carlos Luis Henri Martin Daniel Simon Victor Oscar Felix Hugo Bruno William Richard Joseph Charles Christopher Matthew Anthony Andrew Joshua Kenneth "
    "Kevin Brian George Edward Ronald Timothy Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Scott Benjamin Samuel Gregory Alexander Patrick Leo Louis Antoine Philippe Jacques Stefan Wolfgang Klaus Jürgen Dieter Miguel Javier Pedro Diego Wei Ahmed Omar"
).split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split()
MALE_CYRILLIC = "Иван Пётр Сергей Андрей Николай Дмитрий Алексей Виктор Владимир Михаил".split()
_LATIN = ["ba", "re", "mi", "lo", "du", "ka", "ne", "si", "to", "va", "har", "len", "win", "mor", "sal", "ter"]
_CYRILLIC = ["ба", "ре", "ми", "ло", "ду", "ка", "не", "си", "то", "ва", "хар", "лен", "вин", "мор", "сал", "тер"]
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora|Señor|Sra|Sr"
#: Makes that bear a title.
_MAKES = "Pepper|Martens|Oetker|Scholl"
_NAME = r"\p{Lu}[\p{L}'’-]+"


def _any_of(words: list[str]) -> str:
    """An alternation by first letter."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in by_first.items())


_GIVEN = _any_of(FEMALE + MALE + FEMALE_CYRILLIC + MALE_CYRILLIC)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|"
    "Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
)
_EMAIL = r"(?<![._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}"
_KEY = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
_ISSUED = r"gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|sk-|[rsp]k_(?:live|test)_|AIza|npm_|hf_"
#: Tokens whose beginning says who issued them, and signed ones of three parts.
_TOKEN = rf"(?:(?:{_ISSUED})[A-Za-z0-9_-]{{16,}}+|eyJ[A-Za-z0-9_-]{{8,}}+\.eyJ[A-Za-z0-9_-]{{4,}}+(?:\.[A-Za-z0-9_-]*+)?)"
_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY-----"
_VALUE = r"[A-Za-z0-9+/_.=~-]{8,}(?<!\.)"
#: Of any length, with a digit anywhere; addresses are left to their own patterns.
_SECRET = rf"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{{0,3}}[=:]\s{{0,3}}[\"']?(?=[A-Za-z+/_.=~-]*+\d)(?![A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{{1,63}}+\.){{1,8}}[A-Za-z]{{2}}|(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9+/_=~-]|\.[A-Za-z0-9])){_VALUE}[\"']?"
_IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){3,7}(?: \d{1,4})?)(?![A-Za-z0-9])"
_IP = rf"(?<!\.)(?<!(?i:version|release|build|ver|rev|v)[ .:]{{1,2}})(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or a gap; the first group has a digit, so that names joined by two colons are none.
_IP6 = rf"(?<!:)(?=[0-9A-Fa-f]{{0,3}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:]|\.\d)"
_SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"
_SSN_NAMED = r"(?i:ssn|social security(?: number| no\.?)?)(?: is)?[:# ]{1,3}\d{9}(?!\d)"
_CARD = r"(?<!-)(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|3[47]\d{2}[ -]\d{6}[ -]\d{5})(?![\d-])"
_CALL = r"(?:tel|tél|phone|telephone|téléphone|telefon|teléfono|mobile|móvil|handy|fax|call)"
_PHONE_PLUS = r"(?<!\+)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![(_])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
_PHONE = (
    r"(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![.-])0[1-9](?:[ .-]\d{2}){4}(?![\d-])|(?<![.,-])(?=0(?:[ /-]?\d){8,11}(?![\d-]))0[1-9]\d{1,3}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,2}(?![\d-])"
    rf"|(?<![.-])\d(?:[ ./-]?\d){{6,13}}(?![\d-])(?<=(?i:{_CALL})[.: ]{{1,3}}[\d ./-]{{7,28}})"
)
_BORN = r"(?:born(?: on)?|date of birth|birth date|birthday|dob|d\.o\.b\.|née? le|date de naissance|geboren am|geburtsdatum|nacid[oa] el|fecha de nacimiento)"
_DATE = (
    rf"(?:\d{{1,2}}[./-]\d{{1,2}}[./-](?:19|20)\d{{2}}|(?:19|20)\d{{2}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.? (?:(?:de|of) )?(?:{_MONTHS})\.?,?(?: de)? (?:19|20)\d{{2}})(?!\d)(?<=(?i:{_BORN})[:,]{{0,1}}[ ]{{1,2}}[^\n]{{8,26}})"
)
_DATE_US = rf"(?:{_MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?,? (?:19|20)\d{{2}}(?!\d)(?<=(?i:{_BORN})[:,]{{0,1}}[ ]{{1,2}}[^\n]{{8,26}})"
_WAYS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Sq|Terrace|Way|Close|Crescent"
_WAYS_BEFORE = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours"
_WAYS_SPANISH = "Calle|Avenida|Avda|Plaza|Paseo|Camino"
_WAYS_JOINED = "straße|strasse|gasse|weg|platz|allee"
_ADDRESS = rf"\d{{1,5}}[A-Za-z]? (?:{_NAME} ){{1,4}}(?:{_WAYS})(?!\p{{L}})|\d{{1,4}}(?: ?bis| ?ter)?,? (?i:{_WAYS_BEFORE}) (?:(?:de|du|des|la|le|les) ){{0,2}}{_NAME}(?: {_NAME}){{0,3}}"
_ADDRESS_NAMED = rf"\p{{Lu}}[\p{{L}}-]*(?:{_WAYS_JOINED}) \d{{1,4}}[a-z]?(?![\w])|(?:{_WAYS_SPANISH})\.? (?:(?:de|del|la|las|los|el) ){{0,2}}{_NAME}(?: {_NAME}){{0,2}},? \d{{1,4}}(?!\d)"
_PARTICLES = "von|van|vom|zu|zum|zur|de|der|den|del|della|di|da|do|dos|das|du|des|la|le|el|al|bin|ibn|ben|ter|ten"
#: A name with the initials and particles before it; runs are possessive, so that none is too long for the stack.
_PART = rf"(?:\p{{Lu}}\.? |(?:{_PARTICLES}) )*+{_NAME}"
#: What introduces a name.
_INTRODUCED = r"(?:my name is|his name is|her name is|signed,?|sincerely,?|regards,?|je m'appelle|ich heiße|mein name ist|me llamo|mi nombre es|меня зовут|full name:|name:|patient:|employee:)"
_PERSON = rf"(?:(?:{_TITLES})\.? (?!(?:{_MAKES})(?!\p{{L}})){_PART}(?: {_PART})*+|(?:{_GIVEN})(?: {_PART})++|(?<=(?iu:{_INTRODUCED})[ \n]{{1,2}}){_PART}(?: {_PART})++)"
#: Branches by what they begin with, so that few are tried at a place, and none within a word.
PATTERN = (
    rf"(?<![\p{{L}}\p{{N}}])(?:{_EMAIL}|(?=\d)(?:{_DATE}|{_IP}|{_IP6}|{_SSN}|{_CARD}|{_PHONE}|{_ADDRESS})|(?=\p{{Lu}})(?:{_KEY}|{_IBAN}|{_DATE_US}|{_ADDRESS_NAMED}|{_PERSON})|(?=[a-zA]){_TOKEN}|(?=[a-fA-F]){_IP6}|(?=[sS]){_SSN_NAMED}|(?=[+(])(?:{_PHONE_PLUS})|{_BLOCK})|{_SECRET}"
)
#: What a text must hold for any of these to be found in it.
_GATE = rf"(?<![\p{{L}}\p{{N}}])(?:(?=\p{{Lu}})(?:{_TITLES}|{_GIVEN})(?!\p{{L}})|(?=[A-Za-zмМ])(?iu:{_INTRODUCED})|-----BEGIN|(?=[a-zA])(?:{_ISSUED}|eyJ))"
#: Around a hit in a marked text; the first character alone is escaped before.
_EDGE, _ESCAPE = "\x01\x02", "\x01\x03"
#: Kinds without a check of distinctness.
_FREE = ("KEEP", "INITIAL", "ADDRESS", "DATE")
#: Rounds after which a surrogate may be some other real value, and after which drawing ends: of a form with fewer values than are asked for.
REAL_ROUNDS, ROUNDS = 32, 96


def kind_of(hit: Column) -> Column:
    """The kind of what the pattern found; a long number whose check digit is wrong is no card and stays."""
    digits = F.regexp_replace(hit, r"\D", "")
    card = hit.rlike(r"^\d[\d -]*$") & (F.length(digits) >= 13)
    return (
        F.when(hit.contains("@"), "EMAIL")
        .when(hit.startswith("-----BEGIN"), "BLOCK")
        .when(hit.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "KEY")
        .when(hit.rlike(rf"^(?:{_ISSUED}|eyJ)[^ =]*$"), "TOKEN")
        .when(hit.rlike(r"^[0-9A-Fa-f:]*::?[0-9A-Fa-f:]*$"), "IP6")
        .when(hit.rlike(r"^(?i:ssn|social)[^=]*\d{9}$"), "SSN_NAMED")
        .when(hit.rlike(r"^[A-Za-z_-]+\s{0,3}[=:]"), "SECRET")
        .when(hit.rlike(r"^[A-Z]{2}\d{2}"), "IBAN")
        .when(hit.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "IP")
        .when(hit.rlike(r"^\d{3}-\d{2}-\d{4}$"), "SSN")
        .when(hit.rlike(rf"^(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.? .*(?:{_MONTHS}).*\d{{4}}|(?:{_MONTHS})\.? \d{{1,2}}.*\d{{4}})$"), "DATE")
        .when(card & (digits.rlike("^[2-6]") & _luhn(digits)), "CARD")
        .when(card & digits.rlike("^[1-9]"), "KEEP")
        .when(hit.rlike(r"^\d.*\p{L}|^\p{Lu}.* \d"), "ADDRESS")
        .when(hit.rlike(r"^[+(\d]"), "PHONE")
        .otherwise("PERSON")
    )


def _secret_value(hit: Column) -> Column:
    return F.regexp_extract(hit, rf"^[^=:]*[=:]\s{{0,3}}[\"']?({_VALUE})", 1)


def _normal(kind: Column, value: Column) -> Column:
    """The value without the parts that vary between mentions."""
    return F.when(kind.isin("PHONE", "CARD", "SSN"), F.regexp_replace(value, r"\D", "")).when(kind == "IBAN", F.regexp_replace(value, " ", "")).when(kind.isin("EMAIL", "NAME", "IP6", "STREET"), F.lower(value)).otherwise(value)


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces_of(hit: Column) -> Column:
    """A hit as (kind, value) pieces in order: those of kind KEEP stay, the others get surrogates.

    Of a person, titles and particles stay, each name and each initial is a piece; of an address, kinds of ways stay;
    of a secret, all but the value stays.
    """
    piece = lambda kind, value: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))
    words = lambda hit, kind: F.transform(F.split(hit, " "), lambda x: piece(kind(x), x))
    person = lambda x: F.when(x.rlike(rf"^(?:(?:{_TITLES})\.?|{_PARTICLES})$"), "KEEP").when(x.rlike(r"^\p{Lu}\.?$"), "INITIAL").otherwise("NAME")
    address = lambda x: F.when(x.rlike(r"^\d"), "ADDRESS").when(x.rlike(rf"^(?:{_WAYS}|(?iu:{_WAYS_BEFORE})|{_WAYS_SPANISH})\.?,?$|^\p{{Ll}}"), "KEEP").when(x.rlike(rf"(?:{_WAYS_JOINED})$"), "STREET").otherwise("NAME")
    within = lambda hit, x, kind: F.array(piece("KEEP", F.substring(hit, F.lit(1), F.instr(hit, x) - 1)), piece(kind, x), piece("KEEP", F.substring(hit, F.instr(hit, x) + F.length(x), F.length(hit))))
    return _let(
        F.struct(hit.alias("hit"), kind_of(hit).alias("kind")),
        lambda x: F.when(x["kind"] == "PERSON", words(x["hit"], person))
        .when(x["kind"] == "ADDRESS", words(x["hit"], address))
        .when(x["kind"] == "SECRET", _let(_secret_value(x["hit"]), lambda y: within(x["hit"], y, "SECRET")))
        .when(x["kind"] == "SSN_NAMED", _let(F.regexp_extract(x["hit"], r"\d{9}$", 0), lambda y: within(x["hit"], y, "SSN")))
        .otherwise(F.array(piece(x["kind"], x["hit"]))),
    )


def _digest(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """256 hexadecimal digits."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, normal, attempt.cast("string"))
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f+")), 512))


def _number(digest: Column, place: Column | int, size: Column | int) -> Column:
    """A number below size from four digits of the digest; place counts fours and wraps."""
    at = (F.lit(place) if isinstance(place, int) else place) % 64 * 4 + 1
    return F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int") % size


def _respell(value: Column, digest: Column, hexadecimal: Column) -> Column:
    """Every digit and letter drawn anew within its own class; all else stays. Hexadecimal letters stay such."""
    letters = F.when(hexadecimal, 6).otherwise(26)

    def draw(c: Column, i: Column) -> Column:
        base = F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65)
        return _let(base, lambda x: F.when(x.isNull(), c).otherwise(F.call_function("char", x + _number(digest, i, F.when(x == 48, 10).otherwise(letters)))))

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), draw), "")


def _relay(shape: Column, digits: Column) -> Column:
    """Lay digits over the digits of shape, in order."""
    return F.aggregate(
        F.filter(F.split(shape, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["n"] + 1, F.lit(1))).alias("out"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n"))),
        lambda s: s["out"],
    )


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _card(first: Column, spelled: Column, normal: Column, digest: Column) -> Column:
    """The first digit, drawn digits, and a last one that makes the checksum as good or bad as before."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(first, spelled, d.cast("string")))
    alike = _let(_luhn(normal), lambda good: F.filter(ends, lambda x: _luhn(x) == good))
    return _let(alike, lambda x: F.get(x, _number(digest, 63, 9) % F.size(x)))


def _mod97(text: Column) -> Column:
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(spelled: Column, normal: Column) -> Column:
    """The country, check digits as good or bad as before, and the drawn rest."""
    country = F.substring(normal, 1, 2)
    valid = _mod97(F.concat(F.substring(normal, F.lit(5), F.length(normal)), F.substring(normal, 1, 4))) == 1
    check = _let(98 - _mod97(F.concat(spelled, country, F.lit("00"))), lambda x: F.when(valid, x).otherwise(x % 97 + 1))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), spelled)


def _given_map(names: list[str], key: str) -> dict[str, str]:
    order = sorted(names, key=lambda x: hashlib.sha256(f"{key}\x1f{x}".encode()).digest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


def _name(value: Column, digest: Column, attempt: Column, key: str) -> Column:
    """A listed given name becomes another of its list, any other name five syllables of its script, more after many draws."""
    given = {k.lower(): v for names in (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC) for k, v in _given_map(names, key).items()}
    known = F.from_json(F.lit(json.dumps(given)), "map<string,string>")
    made = F.coalesce(F.try_element_at(known, F.lower(value)), _syllables(value, digest, attempt))
    return _let(made, lambda x: F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(x)).otherwise(x))


def _syllables(value: Column, digest: Column, attempt: Column) -> Column:
    parts = F.split(F.when(value.rlike(r"\p{IsCyrillic}"), " ".join(_CYRILLIC)).otherwise(" ".join(_LATIN)), " ")
    many = F.sequence(F.lit(0), F.lit(4) + F.floor(attempt / 4).cast("int"))
    return _let(parts, lambda x: F.initcap(F.array_join(F.transform(many, lambda i: F.element_at(x, _number(digest, i, len(_LATIN)) + 1)), "")))


def _ssn(value: Column, spelled: Column, digest: Column) -> Column:
    """Nine digits of an area, a group and a serial number that can be; numbers that begin with 9 are others, and stay such."""
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    area = _let(_number(digest, 40, 898) + 1, lambda x: F.when(x >= 666, x + 1).otherwise(x))
    return F.when(value.startswith("9"), F.concat(F.lit("9"), F.substring(spelled, 2, 8))).otherwise(F.concat(pad(area, 3), pad(_number(digest, 41, 99) + 1, 2), pad(_number(digest, 42, 9999) + 1, 4)))


def _phone(digits: Column, spelled: Column) -> Column:
    """A leading 0 stays with the digit behind it; else no number, and of ten digits no exchange, begins with 0 or 1."""
    first = lambda x: F.translate(x, "01", "73")
    rest = lambda n: F.substring(spelled, F.lit(n), F.length(spelled))
    part = lambda i, n: F.substring(spelled, i, n)
    return F.when(digits.startswith("0"), F.concat(F.substring(digits, 1, 2), rest(3))).when(F.length(digits) == 10, F.concat(first(part(1, 1)), part(2, 2), first(part(4, 1)), rest(5))).otherwise(F.concat(first(part(1, 1)), rest(2)))


def _date(value: Column, digest: Column) -> Column:
    """Days and months from 1 to 12, which either order allows, and a year of the same ten; names of months stay."""

    def draw(x: Column, i: Column) -> Column:
        small = F.when(F.length(x) == 2, F.lpad((_number(digest, i, 12) + 1).cast("string"), 2, "0")).otherwise((_number(digest, i, 9) + 1).cast("string"))
        return F.when(F.length(x) == 4, F.concat(F.substring(x, 1, 3), _number(digest, i, 10).cast("string"))).otherwise(small)

    pairs = F.arrays_zip(F.split(value, r"\d+", -1).alias("gap"), F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0)).alias("n"))
    return F.array_join(F.transform(pairs, lambda x, i: F.concat(x["gap"], F.when(x["n"].isNull(), "").otherwise(draw(x["n"], i)))), "")


def surrogate_of(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of one value, in the value's own format."""
    bound = F.struct(kind.alias("kind"), value.alias("value"), _normal(kind, value).alias("normal"), attempt.alias("attempt"))
    digested = lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["normal"].alias("normal"), x["attempt"].alias("attempt"), _digest(key, x["kind"], x["normal"], x["attempt"]).alias("digest"))
    return _let(bound, lambda x: _let(digested(x), lambda y: _drawn(y["kind"], y["value"], y["normal"], y["digest"], y["attempt"], key)))


def _drawn(kind: Column, value: Column, normal: Column, digest: Column, attempt: Column, key: str) -> Column:
    """What to draw anew is settled by kind first, so that drawing and laying out are each spelt once."""
    octet = lambda i, low, size: (_number(digest, i, size) + low).cast("string")
    kept = (
        F.when(kind == "PHONE", F.regexp_extract(value, r"^(?:\+\d{1,3}(?=[ .(-])|\+[17]|\+\d\d)", 0))
        .when(kind == "TOKEN", F.regexp_extract(value, rf"^(?:{_ISSUED}|eyJ)", 0))
        .when(kind == "BLOCK", F.regexp_extract(value, r"^-----BEGIN[A-Z0-9 ]*-----", 0))
        .when(kind == "IP6", F.regexp_extract(value, r"^[^:]*:", 0))
        .when(kind == "KEY", F.substring(value, 1, 4))
        .otherwise("")
    )
    last = F.when(kind == "BLOCK", F.regexp_extract(value, r"-----END[A-Z0-9 ]*-----$", 0)).otherwise("")
    shape = F.substring(value, F.length(kept) + 1, F.length(value) - F.length(kept) - F.length(last))
    source = (
        F.when(kind == "EMAIL", F.concat(F.substring_index(normal, "@", 1), F.repeat(F.lit("x"), F.floor(attempt / 8).cast("int"))))
        .when(kind == "IBAN", F.substring(normal, F.lit(5), F.length(normal)))
        .when(kind == "CARD", F.substring(normal, F.lit(2), F.length(normal) - 2))
        .when(kind == "PHONE", F.regexp_replace(shape, r"\D", ""))
        .when(kind.isin("SECRET", "SSN", "INITIAL", "ADDRESS"), normal)
        .when(kind.isin("KEY", "TOKEN", "BLOCK", "IP6"), shape)
        .otherwise("")
    )
    host = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("DOMAIN"), F.lower(F.substring_index(value, "@", -1))), 256)
    numbers = lambda x: F.when(kind == "CARD", _card(F.substring(normal, 1, 1), x, normal, digest)).when(kind == "SSN", _ssn(normal, x, digest)).otherwise(_phone(F.regexp_replace(shape, r"\D", ""), x))
    finished = lambda x: (
        F.when(kind == "EMAIL", F.concat(x, F.lit("@m"), F.substring(host, 1, 10), F.lit(".example.com")))
        .when(kind.isin("KEY", "TOKEN", "BLOCK", "IP6"), F.concat(kept, x, last))
        .when(kind.isin("SECRET", "INITIAL"), x)
        .when(kind == "ADDRESS", F.regexp_replace(x, "^0", "7"))
        .when(kind == "DATE", _date(value, digest))
        .when(kind == "STREET", F.concat(_syllables(value, digest, attempt), F.regexp_extract(value, rf"(?:{_WAYS_JOINED})$", 0)))
        .when(kind == "IP", F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254)))
        .when(kind == "IBAN", _let(_iban(x, normal), lambda y: F.when(value.contains(" "), F.trim(F.regexp_replace(y, "(.{4})", "$1 "))).otherwise(y)))
        .when(kind.isin("CARD", "SSN", "PHONE"), F.concat(kept, _relay(shape, numbers(x))))
        .otherwise(_name(value, digest, attempt, key))
    )
    return _let(_respell(source, digest, kind.isin("SECRET", "IP6") & shape.rlike("^[0-9a-fA-F:]+$")), finished)


def _replace(hit: Column, key: str, attempt) -> Column:
    """The whole hit with its values replaced."""
    swap = lambda x: F.when(x["kind"] == "KEEP", x["value"]).otherwise(surrogate_of(x["kind"], x["value"], attempt(x["kind"], _normal(x["kind"], x["value"])), key))
    worded = lambda x: F.exists(x, lambda y: y["kind"].isin("NAME", "ADDRESS", "STREET", "INITIAL"))
    return _let(pieces_of(hit), lambda x: F.call_function("array_join", F.transform(x, swap), F.when(worded(x), " ").otherwise("")))


def parts_of(text: Column) -> Column:
    """The text cut into what stands between hits, at even places, and hits, at odd ones; null without any.

    One pass: hits are marked where they stand, and the marked text is split. What could be taken for a mark is escaped.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(_EDGE[0]), F.lit(_ESCAPE)), PATTERN, f"{_EDGE}$0{_EDGE}")
    plain = lambda x: F.when(text.contains(_EDGE[0]), F.replace(x, F.lit(_ESCAPE), F.lit(_EDGE[0]))).otherwise(x)
    cut = _let(F.split(marked, _EDGE, -1), lambda x: F.when(F.size(x) > 1, F.transform(x, plain)))
    return F.when(text.rlike("[0-9@]") | text.rlike(_GATE), cut)


def _names_of(hits: Column) -> Column:
    """The names among hits, initials left out."""
    pieces = F.flatten(F.transform(F.filter(hits, lambda x: kind_of(x) == "PERSON"), pieces_of))
    return F.array_distinct(F.transform(F.filter(pieces, lambda x: x["kind"] == "NAME"), lambda x: x["value"]))


def _lone(gap: Column, names: Column, key: str, attempt) -> Column:
    """What stands between hits, with names found elsewhere in the text replaced as there."""
    word = rf"(?<![\p{{L}}\d]){_NAME}"
    drawn = lambda x, n: _name(x, _digest(key, F.lit("NAME"), F.lower(x), n), n, key)
    swap = lambda x: _let(attempt(F.lit("NAME"), F.lower(x)), lambda n: drawn(x, n))
    pairs = F.arrays_zip(F.split(gap, word, -1).alias("gap"), F.regexp_extract_all(gap, F.lit(word), F.lit(0)).alias("word"))
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], F.when(x["word"].isNull(), "").when(F.array_contains(names, x["word"]), swap(x["word"])).otherwise(x["word"]))), "")


def settle(values: DataFrame, key: str) -> DataFrame:
    """(kind, normal, attempt > 0) of the values whose first surrogate was taken; usually none.

    values: distinct (kind, normal, value). Of the values with one surrogate, the one with the fewest
    attempts, then the smallest, keeps it; the others, and those whose surrogate is some real value, go on.
    Known given names are permuted among themselves and need no check. Where a form has hardly more values
    than are asked for, a surrogate may be a real value after REAL_ROUNDS rounds; after ROUNDS two may be equal.
    """
    listed = [x.lower() for x in FEMALE + MALE + FEMALE_CYRILLIC + MALE_CYRILLIC]
    values = values.where(~((F.col("kind") == "NAME") & F.col("normal").isin(listed)))
    current = durable(values.withColumn("attempt", F.lit(0)))
    for turn in range(ROUNDS):
        drawn = durable(current.withColumn("s", _normal(F.col("kind"), surrogate_of(F.col("kind"), F.col("value"), F.col("attempt"), key))))
        shared = drawn.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "normal")).alias("first")).where("n > 1")
        again = drawn.join(shared, ["kind", "s"]).where(F.struct("attempt", "normal") != F.col("first")).select("kind", "normal")
        if turn < REAL_ROUNDS:
            again = again.union(drawn.join(current.select("kind", F.col("normal").alias("s")), ["kind", "s"], "left_semi").select("kind", "normal"))
        again = durable(again.distinct().withColumn("again", F.lit(1)))
        release(drawn)
        if again.isEmpty():
            release(again)
            break
        following = durable(current.join(again, ["kind", "normal"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"))
        release(current)
        release(again)
        current = following
    return current.where("attempt > 0").select("kind", "normal", "attempt")


def pseudonymize(df: DataFrame, key: str) -> DataFrame:
    """df with its own columns, text rewritten, and n_entities beside them.

    Whoever has the key can find out which value a surrogate stands for by trying values, so it is the
    caller's secret. Null texts stay null, with 0 entities; texts without hits stay as they are. Rows that
    repeat are rewritten alike, wherever they lie. Null ids are no obstacle. An empty table gives no rows.
    Columns named like helpers here stay untouched; an n_entities column of df is replaced. Each text is
    searched once: its parts are written down with it.
    """
    if not key:
        raise ValueError("surrogates need a key")
    rows = durable(df.select(F.struct(*(df[x] for x in df.columns)).alias("row"), parts_of(df["text"]).alias("parts")))
    odd = lambda parts: F.filter(parts, lambda x, i: i % 2 == 1)
    rows = rows.withColumn("hits", F.when(F.col("parts").isNull(), F.array().cast("array<string>")).otherwise(odd(F.col("parts"))))
    rows = rows.withColumn("names", F.when(F.size("hits") > 0, _names_of(F.col("hits"))).otherwise(F.array().cast("array<string>")))
    found = rows.where("parts is not null").select(F.explode(F.array_distinct("hits")).alias("hit")).distinct()
    values = found.select(F.explode(pieces_of(F.col("hit"))).alias("x")).select("x.*").where(~F.col("kind").isin(*_FREE))
    values = values.withColumn("normal", _normal(F.col("kind"), F.col("value"))).groupBy("kind", "normal").agg(F.min("value").alias("value"))
    redrawn = settle(values, key)
    if redrawn.isEmpty():
        attempt = lambda kind, normal: F.lit(0)
    else:
        sought = rows.where(F.size("hits") > 0).select(F.xxhash64("row.text").alias("t"), F.explode(F.flatten(F.transform("hits", pieces_of))).alias("x")).distinct()
        sought = sought.select("t", "x.kind", _normal(F.col("x.kind"), F.col("x.value")).alias("normal")).distinct().join(redrawn, ["kind", "normal"])
        by_text = sought.groupBy("t").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "normal"), "attempt"))).alias("again"))
        rows = rows.withColumn("t", F.xxhash64("row.text")).join(by_text, "t", "left")
        attempt = lambda kind, normal: F.coalesce(F.try_element_at(F.col("again"), F.concat_ws(" ", kind, normal)), F.lit(0))
    between = lambda gap: F.when(F.size("names") > 0, _lone(gap, F.col("names"), key, attempt)).otherwise(gap)
    whole = F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 0, between(x)).otherwise(_replace(x, key, attempt))), "")
    text = F.when(F.col("parts").isNull(), F.col("row.text")).otherwise(whole)
    entities = F.size(F.filter("hits", lambda x: kind_of(x) != "KEEP"))
    names = [x for x in df.columns if x != "n_entities"]
    return rows.select(*(text.alias(x) if x == "text" else F.col("row")[x].alias(x) for x in names), entities.cast("long").alias("n_entities"))


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING. Without one a random key is made, which lasts as long as the session."""
    if not (spark.conf.get(KEY_SETTING, "") or ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
