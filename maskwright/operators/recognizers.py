"""Recognizers: the catalog of patterns with their scores, checksums and context words."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.matching import EITHER, RIGHT, Pattern, Search, empty_spans, make_span, matches

_digits = lambda n: lambda text: text.rlike(f"[0-9]{{{n}}}")
_some_digit = lambda text: text.rlike("[0-9]")


@dataclass(frozen=True)
class PatternRecognizer:
    """Finds one entity type by patterns; validate may accept (score 1), reject or stay neutral."""

    name: str
    entity: str
    language: str
    patterns: tuple[Pattern, ...]
    validate: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()
    validators: dict[str, Callable[[Column], Column]] = field(default_factory=dict, hash=False, compare=False)
    #: Whether every match holds a digit; texts without any are then passed over for all such recognizers at once.
    digits: bool = False

    def __post_init__(self) -> None:
        if not self.patterns:
            raise ValueError(f"recognizer {self.name} has no patterns")

    @property
    def entities(self) -> tuple[str, ...]:
        return (self.entity,)

    def searches(self, order: int = 0, only: Column | None = None) -> list[Search]:
        """What to look for; order is the recognizer's place, which settles ties."""
        return [Search(p, self.entity, self.name, order * 100 + i, self.validators.get(p.name, self.validate), only) for i, p in enumerate(self.patterns)]

    def detect(self, text: Column, order: int = 0, artifacts: Column | None = None) -> Column:
        """Array of spans."""
        return matches(text, self.searches(order))


#: Labels of a named-entity model and the entity types they stand for.
NER_LABELS = {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORGANIZATION", "MISC": "NRP"}


@dataclass(frozen=True)
class NerRecognizer:
    """Turns a model's entities, found in the artifacts column, into spans; unknown labels are ignored."""

    language: str = "en"
    labels: tuple[tuple[str, str], ...] = tuple(NER_LABELS.items())
    name: str = "NerRecognizer"
    context: tuple[str, ...] = ()

    @property
    def entities(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x for _, x in self.labels))

    def detect(self, text: Column, order: int = 0, artifacts: Column | None = None) -> Column:
        if artifacts is None:
            return empty_spans()
        known = F.create_map(*[F.lit(x) for pair in self.labels for x in pair])
        of = lambda e: F.try_element_at(known, e["label"])
        kept = F.filter(artifacts["ner_entities"], lambda e: of(e).isNotNull())
        span = lambda e, i: make_span(of(e), e["start"], e["end"], e["score"], F.lit(self.name), F.concat(F.lit("ner:"), e["label"]), e["score"], F.lit(0.0), i + F.lit(order * 100_000_000).cast("long"))
        return F.coalesce(F.transform(kept, span), empty_spans())


# All top-level domains of the reference, in the order in which they are tried: as no boundary follows, the first that fits wins.
DOMAINS = (
    "com edu gov int mil net onl org pro red tel uno xxx academy accountant accountants actor adult africa agency airforce apartments app archi army art asia associates attorney auction audio auto autos baby band bar bargains beer "
    "berlin best bet bid bike bio black blackfriday blog blue boats bond boo boston bot boutique build builders business buzz cab cafe cam camera camp capital car cards care careers cars casa cash casino catering center ceo cfd charity "
    "chat cheap christmas church city claims cleaning click clinic clothing cloud club codes coffee college community company computer condos construction consulting contact contractors cooking cool coupons courses credit creditcard "
    "cricket cruises cyou dad dance date dating day degree delivery democrat dental dentist desi design dev diamonds diet digital direct directory discount doctor dog domains download earth eco education email energy engineer "
    "engineering enterprises equipment esq estate events exchange expert exposed express fail faith family fans farm fashion feedback film finance financial fish fishing fit fitness flights florist flowers football forsale foundation "
    "fun fund furniture futbol fyi gallery game games garden gay gdn gifts gives giving glass global gmbh gold golf graphics gratis green gripe group guide guitars guru hair hamburg haus health healthcare help hiphop hockey holdings "
    "holiday homes horse hospital host hosting house how icu info ink institute insure international investments irish jewelry jetzt juegos kaufen kids kitchen kiwi krd kyoto land lat law lawyer lease legal lgbt life lighting limited "
    "limo link live loan loans lol london love ltd ltda luxury maison management market marketing markets mba media melbourne meme memorial men miami mobi moda moe mom money monster mortgage motorcycles mov movie nagoya name navy "
    "network new news ngo ninja now nyc observer okinawa one ong online organic osaka page paris partners parts party pet phd photo photography photos pics pictures pink pizza place plumbing plus poker porn press productions prof promo "
    "properties property protection pub quest racing recipes rehab reise reisen rent rentals repair report republican rest restaurant review reviews rip rocks rodeo rsvp run saarland sale salon sarl sbs school schule science services "
    "sex sexy sh shoes shop shopping show singles site skin soccer social software solar solutions soy space spiegel study style sucks supply support surf surgery systems tax taxi team tech technology theater tips tires today tools top "
    "tours town toys trade training tube uk university vacations ventures vet video villas vin vip vision vlaanderen vodka vote voting voyage wales wang watch webcam website wedding wiki wine work works world wtf xyz yoga yokohama you "
    "zone ac ad ae af ag ai al am an ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr "
    "ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt "
    "mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg si sj sk sl sm sn so sr st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tp tr tt tv tw tz ua "
    "ug us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split()


def ordered(words: Sequence[str]) -> str:
    """An alternation that chooses as words in their order would, with common beginnings tried once."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        if not word:
            # What comes later is never reached.
            by_first[""] = []
            break
        by_first.setdefault(word[0], []).append(word[1:])
    branches = [first + (ordered(rests) if any(rests) else "") for first, rests in by_first.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def url_base(domain: str) -> str:
    return rf"(?:(?:www[0-9]{{0,3}}[.])?[a-z0-9.\-]{{1,253}}[.](?:{domain})(?:/[^\t\n\f\r ()<>\"']*)?)"


def credit_card(language: str) -> PatternRecognizer:
    regex = r"\b((4\d{3})|(5[0-5]\d{2})|(6\d{3})|(1\d{3})|(3\d{3}))[- ]?(\d{3,4})[- ]?(\d{3,4})[- ]?(\d{3,5})\b"
    words = ("credit", "card", "visa", "mastercard", "cc ", "amex", "discover", "jcb", "diners", "maestro", "instapayment")
    return PatternRecognizer("CreditCardRecognizer", "CREDIT_CARD", language, (Pattern("All Credit Cards (weak)", regex, 0.3, gate=_digits(3)),), V.credit_card, words, digits=True)


_ATOM = r"!#$%&'*+\-/=?^_`{|}~\w"
EMAIL = rf"\b((([{_ATOM}])|([{_ATOM}][{_ATOM}.]{{0,}}[{_ATOM}]))[@]\w+(?:-+\w+)*(?:\.\w+(?:-+\w+)*)+)\b"
_EMAIL_JAVA = rf"{EITHER}(?:[{_ATOM}][{_ATOM}.]*[{_ATOM}]|[{_ATOM}])@\w++(?:-++\w++)*+(?:\.\w++(?:-++\w++)*+)++{RIGHT}"


def email(language: str) -> PatternRecognizer:
    return PatternRecognizer("EmailRecognizer", "EMAIL_ADDRESS", language, (Pattern("Email (Medium)", EMAIL, 0.5, _EMAIL_JAVA, lambda t: t.contains("@")),), None, ("email",))


def iban(language: str) -> PatternRecognizer:
    return PatternRecognizer("IbanRecognizer", "IBAN_CODE", language, (Pattern("IBAN (generic)", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.5, gate=_some_digit),), V.iban, ("iban", "bank", "transaction"), digits=True)


def ip(language: str) -> PatternRecognizer:
    octet = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    v4 = Pattern("IPv4", rf"\b{octet}\.{octet}\.{octet}\.{octet}\b", 0.6, gate=lambda t: t.rlike(r"[0-9]\.[0-9]"))
    v6 = Pattern("IPv6 (candidate)", r"(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{1,4})*", 0.6, r"(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{1,4})*+", lambda t: t.rlike("[0-9A-Fa-f]:"))
    return PatternRecognizer("IpRecognizer", "IP_ADDRESS", language, (v4, v6), None, ("ip", "ipv4", "ipv6"), {"IPv4": V.ip_v4, "IPv6 (candidate)": V.ip_v6})


def url(language: str, domains: Sequence[str] | None = None) -> PatternRecognizer:
    tried = domains if domains is not None else DOMAINS
    base, java = url_base("|".join(tried)), url_base(ordered(tried))
    dotted = lambda t: t.rlike(r"(?iu)[a-z0-9.\-][.][a-z]{2}")
    standard = Pattern("Standard Url", f"(?i)(?:https?://){base}", 0.6, f"(?iu)(?:https?://){java}", lambda t: t.contains("://") & dotted(t))
    bare = Pattern("Non schema URL", f"(?i){base}", 0.5, f"(?iu){java}", dotted)
    return PatternRecognizer("UrlRecognizer", "URL", language, (standard, bare), None, ("url", "website", "link"))


def mac(language: str) -> PatternRecognizer:
    h = "[0-9A-Fa-f]"
    patterns = (
        Pattern("MAC_COLON", rf"\b{h}{{2}}(?::{h}{{2}}){{5}}\b", 0.6, gate=lambda t: t.contains(":")),
        Pattern("MAC_HYPHEN", rf"\b{h}{{2}}(?:-{h}{{2}}){{5}}\b", 0.6, gate=lambda t: t.contains("-")),
        Pattern("MAC_CISCO_DOT", rf"\b{h}{{4}}\.{h}{{4}}\.{h}{{4}}\b", 0.6, gate=lambda t: t.rlike(rf"{h}\.{h}")),
    )
    return PatternRecognizer("MacRecognizer", "MAC_ADDRESS", language, patterns, None, ("mac", "mac address", "hardware address", "physical address", "ethernet"))


def crypto(language: str) -> PatternRecognizer:
    return PatternRecognizer("CryptoRecognizer", "CRYPTO", language, (Pattern("Crypto (Medium)", "(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,59}", 0.5, gate=_some_digit),), V.crypto, ("wallet", "btc", "bitcoin", "crypto"), digits=True)


def generic(language: str, domains: Sequence[str] | None = None) -> list[PatternRecognizer]:
    """Recognizers for any language."""
    return [credit_card(language), email(language), iban(language), ip(language), url(language, domains), mac(language), crypto(language)]


def us_ssn(language: str = "en") -> PatternRecognizer:
    patterns = (
        Pattern("SSN1 (very weak)", r"\b([0-9]{5})-([0-9]{4})\b", 0.05, gate=_digits(5)),
        Pattern("SSN2 (very weak)", r"\b([0-9]{3})-([0-9]{6})\b", 0.05, gate=_digits(6)),
        Pattern("SSN3 (very weak)", r"\b(([0-9]{3})-([0-9]{2})-([0-9]{4}))\b", 0.05, gate=_digits(4)),
        Pattern("SSN4 (very weak)", r"\b[0-9]{9}\b", 0.05, gate=_digits(9)),
        Pattern("SSN5 (medium)", r"\b([0-9]{3})[- .]([0-9]{2})[- .]([0-9]{4})\b", 0.5, gate=_digits(4)),
    )
    return PatternRecognizer("UsSsnRecognizer", "US_SSN", language, patterns, V.ssn, ("social", "security", "ssn", "ssns", "ssid"), digits=True)


def us_itin(language: str = "en") -> PatternRecognizer:
    group = r"(5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))"
    patterns = (
        Pattern("Itin (very weak)", rf"\b9\d{{2}}[- ]{group}\d{{4}}\b|\b9\d{{2}}{group}[- ]\d{{4}}\b", 0.05, gate=_digits(4)),
        Pattern("Itin (weak)", rf"\b9\d{{2}}{group}\d{{4}}\b", 0.3, gate=_digits(9)),
        Pattern("Itin (medium)", rf"\b9\d{{2}}[- ]{group}[- ]\d{{4}}\b", 0.5, gate=_digits(4)),
    )
    return PatternRecognizer("UsItinRecognizer", "US_ITIN", language, patterns, None, ("individual", "taxpayer", "itin", "tax", "payer", "taxid", "tin"), digits=True)


def us_passport(language: str = "en") -> PatternRecognizer:
    patterns = (Pattern("Passport (very weak)", r"(\b[0-9]{9}\b)", 0.05, gate=_digits(9)), Pattern("Passport Next Generation (very weak)", r"(\b[A-Z][0-9]{8}\b)", 0.1, gate=_digits(8)))
    return PatternRecognizer("UsPassportRecognizer", "US_PASSPORT", language, patterns, None, ("us", "united", "states", "passport", "passport#", "travel", "document"), digits=True)


# The forms of driver licence numbers, one of them with a bracket too few, which is kept.
LICENSE_FORMS = (
    "[A-Z][0-9]{3,6}", "[A-Z][0-9]{5,9}", "[A-Z][0-9]{6,8}", "[A-Z][0-9]{4,8}", "[A-Z][0-9]{9,11}", "[A-Z]{1,2}[0-9]{5,6}", "H[0-9]{8}", "V[0-9]{6}", "X[0-9]{8}", "A-Z]{2}[0-9]{2,5}", "[A-Z]{2}[0-9]{3,7}", "[0-9]{2}[A-Z]{3}[0-9]{5,6}",
    "[A-Z][0-9]{13,14}", "[A-Z][0-9]{18}", "[A-Z][0-9]{6}R", "[A-Z][0-9]{9}", "[A-Z][0-9]{1,12}", "[0-9]{9}[A-Z]", "[A-Z]{2}[0-9]{6}[A-Z]", "[0-9]{8}[A-Z]{2}", "[0-9]{3}[A-Z]{2}[0-9]{4}", "[A-Z][0-9][A-Z][0-9][A-Z]", "[0-9]{7,8}[A-Z]",
)


def us_license(language: str = "en") -> PatternRecognizer:
    patterns = (
        Pattern("Driver License - Alphanumeric (weak)", rf"\b({'|'.join(LICENSE_FORMS)})\b", 0.3, gate=_some_digit),
        Pattern("Driver License - Digits (very weak)", r"\b([0-9]{6,14}|[0-9]{16})\b", 0.01, gate=_digits(6)),
    )
    return PatternRecognizer("UsLicenseRecognizer", "US_DRIVER_LICENSE", language, patterns, None, ("driver", "license", "permit", "lic", "identification", "dls", "cdls", "lic#", "driving"), digits=True)


def us_bank(language: str = "en") -> PatternRecognizer:
    return PatternRecognizer("UsBankRecognizer", "US_BANK_NUMBER", language, (Pattern("Bank Account (weak)", r"\b[0-9]{8,17}\b", 0.05, gate=_digits(8)),), None, ("check", "account", "account#", "acct", "bank", "save", "debit"), digits=True)


def us_aba(language: str = "en") -> PatternRecognizer:
    patterns = (Pattern("ABA routing number (weak)", r"\b[0123678]\d{8}\b", 0.05, gate=_digits(9)), Pattern("ABA routing number", r"\b[0123678]\d{3}-\d{4}-\d\b", 0.3, gate=_digits(4)))
    return PatternRecognizer("AbaRoutingRecognizer", "ABA_ROUTING_NUMBER", language, patterns, V.aba, ("aba", "routing", "abarouting", "association", "bankrouting"), digits=True)


def us_npi(language: str = "en") -> PatternRecognizer:
    patterns = (Pattern("NPI (weak)", r"\b[12]\d{9}\b", 0.1, gate=_digits(10)), Pattern("NPI (medium)", r"\b[12]\d{3}[ -]\d{3}[ -]\d{3}\b", 0.4, gate=_digits(4)))
    return PatternRecognizer("UsNpiRecognizer", "US_NPI", language, patterns, V.npi, ("npi", "national provider", "provider", "npi number", "provider id", "provider identifier", "taxonomy"), digits=True)


def us_mbi(language: str = "en") -> PatternRecognizer:
    n, a, x = "[0-9]", "[ACDEFGHJKMNPQRTUVWXY]", "[0-9ACDEFGHJKMNPQRTUVWXY]"
    patterns = (Pattern("MBI (weak)", rf"\b{n}{a}{x}{n}{a}{x}{n}{a}{a}{n}{n}\b", 0.3, gate=_some_digit), Pattern("MBI (medium)", rf"\b{n}{a}{x}{n}-{a}{x}{n}-{a}{a}{n}{n}\b", 0.5, gate=_some_digit))
    return PatternRecognizer("UsMbiRecognizer", "US_MBI", language, patterns, None, ("medicare", "mbi", "beneficiary", "cms", "medicaid", "hic", "hicn"), digits=True)


def medical_license(language: str = "en") -> PatternRecognizer:
    first = "[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX]"
    regex = rf"{first}[a-zA-Z]\d{{7}}|{first}9\d{{7}}"
    return PatternRecognizer("MedicalLicenseRecognizer", "MEDICAL_LICENSE", language, (Pattern("USA DEA Certificate Number (weak)", regex, 0.4, gate=_digits(7)),), V.dea, ("medical", "certificate", "DEA"), digits=True)


def us(language: str = "en") -> list[PatternRecognizer]:
    return [f(language) for f in (us_ssn, us_itin, us_passport, us_license, us_bank, us_aba, us_npi, us_mbi, medical_license)]


def fr_nir() -> PatternRecognizer:
    return PatternRecognizer("FrNirRecognizer", "FR_NIR", "fr", (Pattern("NIR (weak)", r"\b[12][ ]?\d{2}[ ]?\d{2}[ ]?(\d{2}|2[AB])[ ]?\d{3}[ ]?\d{3}[ ]?\d{2}\b", 0.3, gate=_some_digit),), V.nir, ("sécurité sociale", "sécu", "nir", "insee", "assuré"), digits=True)


def fr_siren() -> PatternRecognizer:
    return PatternRecognizer("FrSirenRecognizer", "FR_SIREN", "fr", (Pattern("SIREN (weak)", r"\b\d{3}[ ]?\d{3}[ ]?\d{3}\b", 0.3, gate=_digits(3)),), V.french_luhn, ("siren", "entreprise", "société", "rcs"), digits=True)


def fr_siret() -> PatternRecognizer:
    return PatternRecognizer("FrSiretRecognizer", "FR_SIRET", "fr", (Pattern("SIRET (weak)", r"\b\d{3}[ ]?\d{3}[ ]?\d{3}[ ]?\d{5}\b", 0.3, gate=_digits(5)),), V.french_luhn, ("siret", "établissement", "facture"), digits=True)


def fr_plate() -> PatternRecognizer:
    letters = "[A-HJ-NP-TV-Z]{2}"
    return PatternRecognizer("FrLicensePlateRecognizer", "FR_LICENSE_PLATE", "fr", (Pattern("Plaque SIV", rf"\b{letters}-\d{{3}}-{letters}\b", 0.4, gate=_digits(3)),), None, ("immatriculation", "plaque", "véhicule", "voiture"), digits=True)


def fr_phone() -> PatternRecognizer:
    patterns = (
        Pattern("Téléphone national", r"\b0[1-9](?:[ .-]?\d{2}){4}\b", 0.4, gate=_digits(2)),
        Pattern("Téléphone international", r"(?:\+33|0033)[ .-]?[1-9](?:[ .-]?\d{2}){4}\b", 0.5, gate=_digits(2)),
    )
    return PatternRecognizer("FrPhoneRecognizer", "FR_PHONE_NUMBER", "fr", patterns, None, ("téléphone", "tél", "portable", "mobile", "appelle", "joindre"), digits=True)


def fr() -> list[PatternRecognizer]:
    return [fr_nir(), fr_siren(), fr_siret(), fr_plate(), fr_phone()]


def in_language(recognizer, language: str):
    """The same recognizer under another language."""
    return replace(recognizer, language=language)
