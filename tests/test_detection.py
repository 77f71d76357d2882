"""Detection and rewriting of single texts: one case a line."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from maskwright import sources
from maskwright.functions import validators as V
from maskwright.functions.matching import translate
from maskwright.operators import anonymize as A
from maskwright.operators import recognizers as R
from maskwright.operators.analyze import Analyzer, explode_spans
from maskwright.operators.context import Enhancer
from maskwright.operators.evaluate import agreement, detection_failures
from maskwright.operators.registry import Registry, default_registry

# (language, text, expected (type, start, end, least score), forbidden types)
CASES = [
    ("en", "5555555555554444", [("CREDIT_CARD", 0, 16, 1.0)], []),
    ("en", "my credit card number is 4012-8888-8888-1882", [], ["CREDIT_CARD"]),
    ("en", "4012-8888-8888-1881", [("CREDIT_CARD", 0, 19, 1.0)], []),
    ("en", "my email address is info@example.site", [("EMAIL_ADDRESS", 20, 37, 0.5)], []),
    ("fr", "Prénom : José — email : info@example.site", [("EMAIL_ADDRESS", 24, 41, 0.5)], []),
    ("en", "my iban is GB29NWBK60161331926819", [("IBAN_CODE", 11, 33, 1.0)], []),
    ("en", "my iban is GB29NWBK60161331926820", [], ["IBAN_CODE"]),
    ("en", "host 192.168.0.1", [("IP_ADDRESS", 5, 16, 0.6)], []),
    ("en", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", [("IP_ADDRESS", 0, 39, 0.6)], []),
    ("en", "gggg:0db8:85a3:0000:0000:8a2e:0370:7334 is none", [], ["IP_ADDRESS"]),
    ("en", "at 12:30:45 on 00:1B:44:11:3A:B7", [("MAC_ADDRESS", 15, 32, 0.6)], ["IP_ADDRESS"]),
    ("en", "visit https://www.example.com/fr-fr for details", [("URL", 6, 35, 0.6)], []),
    ("en", "device 00:1B-44:11-3A:B7 connected", [], ["MAC_ADDRESS"]),
    ("en", "wallet 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", [("CRYPTO", 7, 41, 1.0)], []),
    ("en", "wallet 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3", [], ["CRYPTO"]),
    ("en", "wallet bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", [("CRYPTO", 7, 49, 1.0)], []),
    ("en", "my ssn is 216-09-1234", [("US_SSN", 10, 21, 0.5)], []),
    ("en", "my ssn is 078-05-1120", [], ["US_SSN"]),
    ("en", "my ssn is 216-09 1234", [], ["US_SSN"]),
    ("en", "routing 122105155", [("ABA_ROUTING_NUMBER", 8, 17, 1.0)], []),
    ("en", "npi 1234567893", [("US_NPI", 4, 14, 1.0)], []),
    ("en", "npi 1234567890", [], ["US_NPI"]),
    ("en", "taxpayer id 912-98-7654", [("US_ITIN", 12, 23, 0.5)], []),
    ("en", "medicare 1EG4-TE5-MK73", [("US_MBI", 9, 22, 0.5)], []),
    ("en", "DEA AB1234563", [("MEDICAL_LICENSE", 4, 13, 1.0)], []),
    ("en", "DEA AB1234564", [], ["MEDICAL_LICENSE"]),
    ("en", "passport A12345678", [("US_PASSPORT", 9, 18, 0.1), ("US_DRIVER_LICENSE", 9, 18, 0.3)], []),
    ("en", "account 12345678", [("US_BANK_NUMBER", 8, 16, 0.05)], []),
    ("fr", "numéro de sécu 1 85 05 78 006 084 91", [("FR_NIR", 15, 36, 1.0)], []),
    ("fr", "numéro de sécu 1 85 05 78 006 084 92", [], ["FR_NIR"]),
    ("fr", "185052A00608435", [("FR_NIR", 0, 15, 1.0)], []),
    ("fr", "siren 552100554", [("FR_SIREN", 6, 15, 1.0)], []),
    ("fr", "siren 552100555", [], ["FR_SIREN"]),
    ("fr", "siret 55210055400005", [("FR_SIRET", 6, 20, 1.0)], []),
    ("fr", "immatriculée AB-123-CD", [("FR_LICENSE_PLATE", 13, 22, 0.4)], []),
    ("fr", "immatriculée IO-123-UU", [], ["FR_LICENSE_PLATE"]),
    ("fr", "appelle le 06 01 02 03 04", [("FR_PHONE_NUMBER", 11, 25, 0.4)], []),
    ("fr", "+33 6 01 02 03 04", [("FR_PHONE_NUMBER", 0, 17, 0.4)], []),
    ("en", "", [], ["EMAIL_ADDRESS"]),
]
GOLDEN = [
    ("fr", "Contactez Léa Dupont : lea.dupont@exemple.fr ou au 06 01 02 03 04.", "Contactez Léa Dupont : <EMAIL_ADDRESS> ou au <FR_PHONE_NUMBER>."),
    ("fr", "Virement depuis IBAN GB29NWBK60161331926819, carte 4012-8888-8888-1881, SIREN 552100554.", "Virement depuis IBAN <IBAN_CODE>, carte <CREDIT_CARD>, SIREN <FR_SIREN>."),
    ("fr", "Numéro de sécu : 1 85 05 78 006 084 91, plaque AB-123-CD.", "Numéro de sécu : <FR_NIR>, plaque <FR_LICENSE_PLATE>."),
    ("en", "Reach me at john.smith@example.com or my SSN is 216-09-1234.", "Reach me at <EMAIL_ADDRESS> or my SSN is <US_SSN>."),
    ("en", "Server IP 192.168.0.1, visit https://example.com for details.", "Server IP <IP_ADDRESS>, visit <URL> for details."),
    ("fr", "Prénom : José — email : info@example.site.", "Prénom : José — email : <EMAIL_ADDRESS>."),
]


def spans_of(spark, analyzer, texts, **options):
    rows = analyzer.analyze(sources.from_strings(spark, texts), **options).orderBy("id").collect()
    return [[(s.entity_type, s.start, s.end, round(s.score, 6)) for s in r.spans] for r in rows]


def test_detection_cases(spark):
    every = [*default_registry("en"), *R.fr()]
    corpus = spark.createDataFrame(
        [(str(i), text, [dict(zip(("entity_type", "start", "end", "min_score"), e, strict=True)) for e in expected], forbid) for i, (_, text, expected, forbid) in enumerate(CASES)],
        f"id string, text string, expected {sources.EXPECTED}, forbid array<string>",
    )
    raw = Analyzer(Registry([replace(x, language="any") for x in every]), enhancer=None).raw(F.col("text"), "any")
    found = corpus.select("id", F.explode(raw).alias("s")).select("id", "s.*")
    assert detection_failures(found, corpus).collect() == []


def test_golden_texts(spark):
    df = spark.createDataFrame(GOLDEN, "language string, text string, expected string")
    done = A.anonymize(Analyzer(default_registry()).analyze(df, language=F.col("language"), min_score=0.4))
    for row in done.collect():
        assert row.anonymized.text == row.expected
        for item in row.anonymized["items"]:
            assert row.anonymized.text[item.start : item.end] == f"<{item.entity_type}>"


def test_null_empty_and_unknown_language(spark):
    df = spark.createDataFrame([(None, "en"), ("", "en"), ("a@b.org", "xx"), ("a@b.org", None)], "text string, lang string")
    out = A.anonymize(Analyzer(default_registry("en")).analyze(df, language=F.col("lang")))
    assert [r.anonymized.text for r in out.collect()] == [None, "", "a@b.org", "a@b.org"]
    assert all(not r.spans for r in out.collect())


def test_registry():
    en, fr = default_registry("en", domains=["com"]), default_registry("fr", domains=["com"])
    assert (len(en), sum(len(x.patterns) for x in en)) == (16, 31)
    assert (len(fr), sum(len(x.patterns) for x in fr)) == (12, 17)
    both = default_registry("en", "fr", domains=["com"])
    assert len(both) == 28 and len(default_registry("de", domains=["com"])) == 7
    assert [x.name for x in both.get("fr", ["FR_SIREN"])] == ["FrSirenRecognizer"]
    both.remove("EmailRecognizer")
    assert len(both) == 26 and "EMAIL_ADDRESS" not in both.supported_entities("en")
    assert both.add(R.email("en")).supported_entities("en")[-1] == "EMAIL_ADDRESS"
    with pytest.raises(ValueError):
        R.PatternRecognizer("x", "X", "en", ())
    with pytest.raises(ValueError):
        Analyzer(None)


def test_entities_and_min_score(spark):
    analyzer = Analyzer(default_registry("en"))
    text = ["mail a@b.org or 216-09-1234"]
    assert {x[0] for x in spans_of(spark, analyzer, text, entities=["US_SSN"])[0]} == {"US_SSN"}
    assert all(x[3] >= 0.5 for x in spans_of(spark, analyzer, text, min_score=0.5)[0])


def test_contained_duplicates_keep_other_types(spark):
    found = spans_of(spark, Analyzer(default_registry("en")), ["mail info@example.site now"])[0]
    assert found == [("EMAIL_ADDRESS", 5, 22, 0.5), ("URL", 10, 22, 0.5)]


@pytest.mark.parametrize(
    ("text", "score"),
    [("my ssn 216-09-1234", 0.85), ("nothing here 216-09-1234", 0.5), ("ssn one two three four five 216-09-1234", 0.5), ("ssn one two three four 216-09-1234", 0.85)],
)
def test_context_window(spark, text, score):
    found = spans_of(spark, Analyzer(Registry([R.us_ssn()])), [text])[0]
    assert [x[3] for x in found] == [score]


def test_context_floor_cap_and_far_text(spark):
    far = "x " * 4000 + "bank account 12345678"
    assert spans_of(spark, Analyzer(Registry([R.us_bank()])), ["account 12345678", far]) == [[("US_BANK_NUMBER", 8, 16, 0.4)], [("US_BANK_NUMBER", 8013, 8021, 0.4)]]
    assert spans_of(spark, Analyzer(Registry([R.credit_card("en")])), ["card 4012888888881881"])[0][0][3] == 1.0
    long_word = "w" * 700 + " ssn 216-09-1234"
    assert spans_of(spark, Analyzer(Registry([R.us_ssn()])), [long_word])[0][0][3] == 0.85
    after = Analyzer(Registry([R.us_ssn()]), enhancer=Enhancer(before=0, after=2))
    assert [x[0][3] for x in spans_of(spark, after, ["216-09-1234 is my ssn", "216-09-1234 my ssn"])] == [0.5, 0.85]


@pytest.mark.parametrize("pattern", [p.regex for r in [*R.us(), *R.fr(), R.iban("en"), R.mac("en")] for p in r.patterns])
def test_boundaries_translate(pattern):
    rng = random.Random(pattern)
    ours, theirs = re.compile(translate(pattern), re.ASCII), re.compile(pattern, re.ASCII)
    for _ in range(150):
        text = "".join(rng.choice("0123459aAB-. _éX]") for _ in range(30))
        assert [m.span() for m in ours.finditer(text)] == [m.span() for m in theirs.finditer(text)]


def test_hostile_email_text(spark):
    texts = ["a@b" + ".c" * 20000, "x-" * 3000, "a@" * 3000]
    assert len(spans_of(spark, Analyzer(Registry([R.email("en")])), texts)[0]) == 1


def test_checksums(spark):
    cases = [
        (V.luhn, "4012888888881881", True), (V.luhn, "4012888888881882", False), (V.credit_card, "1234567890123", False), (V.iban, "GB29NWBK60161331926819", True), (V.iban, "gb29NWBK60161331926819", False),
        (V.nir, "1 85 05 78 006 084 91", True), (V.nir, "185052A00608435", True), (V.aba, "122105155", True), (V.aba, "122105156", False), (V.npi, "1234567893", True), (V.npi, "1111111111", False), (V.dea, "AB1234563", True),
        (V.ip_v6, "1::2", None), (V.ip_v6, "1:2:3", False), (V.ip_v6, "1:2:3:4:5:6:7:8", None), (V.ip_v4, "192.168.01.1", False), (V.ip_v4, "1.2.3.4", None), (V.ssn, "111-11-1111", False), (V.ssn, "000-12-3456", False),
        (V.bech32, "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", True), (V.bech32, "BC1QAR0SRRR7XFKVY5L643LYDNW9RE59GTZZWF5MDQ", True), (V.bech32, "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdr", False), (V.bech32, "bc1QAR0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", False),
        (V.base58_check, "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", True), (V.base58_check, "1111111111111111111114oLvT2", True), (V.base58_check, "0", False),
    ]
    row = spark.range(1).select(*[f(F.lit(x)).alias(f"c{i}") for i, (f, x, _) in enumerate(cases)]).first()
    assert list(row) == [x for _, _, x in cases]


def text_with(spark, spans, text="mail info@example.site tel 0601020304"):
    kind = "array<struct<entity_type:string,start:int,end:int,score:double,recognizer:string,pattern:string,original_score:double,context_boost:double,ord:bigint>>"
    return spark.createDataFrame([(text, [(e, a, b, s, None, None, s, 0.0, i) for i, (e, a, b, s) in enumerate(spans)])], f"text string, spans {kind}")


def result(df):
    return df.first().anonymized


def test_operators(spark):
    spans = [("EMAIL_ADDRESS", 5, 22, 0.5), ("PHONE", 27, 37, 0.7)]
    run = lambda ops, spans=spans: result(A.anonymize(text_with(spark, spans), ops))
    assert run({}).text == "mail <EMAIL_ADDRESS> tel <PHONE>"
    assert run({"EMAIL_ADDRESS": A.replace("<MAIL>"), "DEFAULT": A.redact()}).text == "mail <MAIL> tel "
    assert run({"DEFAULT": A.keep()}).text == "mail info@example.site tel 0601020304"
    assert [x.operator for x in run({"DEFAULT": A.keep()})["items"]] == ["keep", "keep"]
    assert run({"PHONE": A.mask("*", 4, True), "DEFAULT": A.mask("#", 99)}).text == "mail ################# tel 060102****"
    assert run({"DEFAULT": A.mask("*", -1)}).text == "mail info@example.site tel 0601020304"
    assert len(run({"DEFAULT": A.sha256()}, spans[:1])["items"]) == 1 and run({"DEFAULT": A.sha256()}, spans[:1])["items"][0].end == 5 + 64
    assert run({"PHONE": A.custom("rev", F.reverse)}).text == "mail <EMAIL_ADDRESS> tel 4030201060"


def test_conflicts(spark):
    run = lambda spans: [(x.entity_type, x.start, x.end) for x in result(A.anonymize(text_with(spark, spans), {"DEFAULT": A.keep()}))["items"]]
    assert run([("URL", 10, 22, 0.5), ("EMAIL_ADDRESS", 5, 22, 0.7)]) == [("EMAIL_ADDRESS", 5, 22)]
    assert run([("URL", 10, 22, 0.5), ("EMAIL_ADDRESS", 5, 22, 0.5)]) == [("EMAIL_ADDRESS", 5, 22)]
    # not transitive: the middle one loses, both its neighbours stay
    assert run([("A", 0, 6, 0.9), ("B", 4, 12, 0.8), ("C", 10, 14, 0.7)]) == [("A", 0, 6), ("C", 10, 14)]
    assert run([("A", 0, 6, 0.5), ("B", 0, 6, 0.5)]) == [("A", 0, 6)]
    assert run([]) == []


@pytest.mark.parametrize("span", [("A", 5, 99, 0.5), ("A", -1, 3, 0.5), ("A", 5, 3, 0.5)])
def test_spans_out_of_range(spark, span):
    with pytest.raises(Exception, match="span out of range"):
        result(A.anonymize(text_with(spark, [span]), {}))


def test_encryption_round_trip(spark, tmp_path):
    df = A.anonymize(text_with(spark, [("E", 5, 22, 0.5), ("P", 27, 37, 0.7)]), {"DEFAULT": A.encrypt("0123456789abcdef0123456789abcdef")})
    df.write.parquet(str(tmp_path / "x"))
    stored = spark.read.parquet(str(tmp_path / "x"))
    assert "info@" not in stored.first().anonymized.text
    assert A.deanonymize(stored, {"DEFAULT": A.decrypt("0123456789abcdef0123456789abcdef")}).first().restored.text == "mail info@example.site tel 0601020304"
    with pytest.raises(Exception):  # noqa: B017
        A.deanonymize(stored, {"DEFAULT": A.decrypt("x" * 32)}).collect()
    with pytest.raises(ValueError):
        A.encrypt("short")
    bad = text_with(spark, [("E", 0, 5, 1.0)], "????? ")
    with pytest.raises(Exception, match="not base64"):
        A.anonymize(bad, {"DEFAULT": A.decrypt("0123456789abcdef")}).collect()


def test_restoring_with_an_empty_item(spark):
    done = A.anonymize(text_with(spark, [("A", 0, 4, 0.5), ("B", 4, 5, 0.5)], "mailXrest"), {"A": A.redact(), "B": A.keep()})
    assert A.deanonymize(done, {"DEFAULT": A.keep()}).first().restored.text == "Xrest"


def test_explode_and_agreement(spark):
    rows = explode_spans(Analyzer(Registry([R.email("en")])).analyze(sources.from_strings(spark, ["é a@b.org", "x@y.de"])), keep=["id"])
    assert [r.value for r in rows.orderBy("id").collect()] == ["a@b.org", "x@y.de"]
    one = agreement(rows, rows.where("id = 0")).first()
    assert (one.agreed, one.total, one.ratio) == (1, 2, 0.5)
    assert agreement(rows.where("false"), rows.where("false")).first().ratio == 1.0


def test_plan_has_no_shuffle(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    plan = A.anonymize(Analyzer(default_registry()).analyze(df, language=F.col("lang"))).select("doc_id", "anonymized")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "source" not in plan.split("ReadSchema")[1]


def test_corpus_readers(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"id": "a", "language": "en", "text": "x", "expected": [{"entity_type": "A", "start": 0, "end": 1, "min_score": 0.5}]}\n\n{"id": "b", "language": "fr", "text": "", "expected": []}\n')
    rows = sources.read_detection_corpus(spark, str(path)).orderBy("id").collect()
    assert [r.id for r in rows] == ["a", "b"] and rows[0].expected[0].end == 1 and rows[0].forbid is None
    path.write_text("{broken\n")
    with pytest.raises(Exception):  # noqa: B017
        sources.read_golden_corpus(spark, str(path)).collect()


def test_stream(spark, tmp_path, small):
    from maskwright import streaming

    spark.read.parquet(f"{small}/documents.parquet").limit(50).select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string")
    done = streaming.anonymize_stream(stream, Analyzer(Registry([R.email("en")])))
    streaming.write_stream(done.select("doc_id", "anonymized.text"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_python_functions(spark):
    from maskwright.operators.python_path import FunctionRecognizer, anonymize_with

    def capitals(text):
        return [(i, i + 1, 0.5) for i, c in enumerate(text) if c.isupper()]

    def twice(value):
        return value * 2

    analyzer = Analyzer(Registry([FunctionRecognizer("Caps", "CAP", "en", capitals, ("shout",)), R.email("en")]))
    df = sources.from_strings(spark, ["é shout A a@b.org", None, "", "x"])
    rows = anonymize_with(analyzer.analyze(df), {"CAP": twice}).orderBy("id").collect()
    assert [r.anonymized.text for r in rows] == ["é shout AA <EMAIL_ADDRESS>", None, "", "x"]
    assert [(x.start, x.end, x.operator) for x in rows[0].anonymized["items"]] == [(8, 10, "twice"), (11, 26, "replace")]
    assert rows[0].spans[0].score == 0.85
    with pytest.raises(Exception, match="span out of range"):
        result(anonymize_with(text_with(spark, [("A", 5, 99, 0.5)]), {}))


def test_every_domain_of_the_reference(spark):
    """Each of the 667 domains, as the first one listed that fits: the plain alternation in brute force."""
    assert len(R.DOMAINS) == len(set(R.DOMAINS)) == 667 and R.DOMAINS[:3] == ["com", "edu", "gov"] and R.DOMAINS[-1] == "zw"
    texts = [f"see https://x1.{x}/p?q or y.{x.upper()}z" for x in R.DOMAINS] + ["a.icu b.fyi c.how d.africa/p e.community f.store"]
    standard, bare = (re.compile(x.regex) for x in R.url("en").patterns)
    expected = [sorted((m.start(), m.end(), score) for p, score in ((standard, 0.6), (bare, 0.5)) for m in p.finditer(x)) for x in texts]
    df = sources.from_strings(spark, texts).select("id", R.url("en").detect(F.col("text")).alias("spans"))
    assert [sorted((s.start, s.end, s.score) for s in r.spans) for r in df.orderBy("id").collect()] == expected
    assert [texts[-1][a:b] for a, b, _ in expected[-1]] == ["a.icu", "b.fyi", "c.how", "d.africa/p", "e.com", "f.st"]


def test_url_queries_try_every_domain(spark, small, tmp_path):
    """The URL queries over tables of other domains than .com, in brute force and rewritten."""
    from maskwright.plans import queries as plans

    urls = ["https://x.io/a", "site.edu", "agency.gov", "shop.co.uk", "host.es", "http://a.icu:80/q"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, f"see {x} now", "en") for i, x in enumerate(urls)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.id, r.start, r.end, r.score) for r in plans.QUERIES["detect_url_pages"](spark, str(tmp_path)).collect())
    assert found == sorted((i, m.start(), m.end(), p.score) for i, x in enumerate(urls) for p in R.url("en").patterns for m in re.finditer(p.regex, x))
    assert {i for i, *_ in found} == set(range(len(urls)))
    assert {r.id for r in plans.QUERIES["analyze_documents"](spark, str(tmp_path)).where("entity_type = 'URL'").collect()} == set(range(len(urls)))
    texts = [r.text for r in plans.QUERIES["anonymize_documents"](spark, str(tmp_path)).orderBy("id").collect()]
    assert texts == [*["see <URL> now"] * 5, "see <URL>:80/q now"]


def test_table_function(spark):
    from maskwright.operators.python_path import FunctionRecognizer, register_table_function

    both = [FunctionRecognizer("Caps", "CAP", "en", lambda t: [(i, i + 1, 1) for i, c in enumerate(t) if c.isupper()]), FunctionRecognizer("Ends", "END", "fr", lambda t: [(len(t) - 1, len(t), 0.5)])]
    register_table_function(spark, "find_marks", both)
    df = spark.createDataFrame([(1, "é😀A b", "en"), (2, "fin", "fr"), (3, None, "en"), (4, "", "en"), (5, "A", None), (6, "A", "xx")], "id int, text string, lang string")
    got = spark.sql("SELECT t.id, m.* FROM {t} t, LATERAL find_marks(t.text, t.lang) m ORDER BY id", t=df).collect()
    assert [tuple(r) for r in got] == [(1, "CAP", 2, 3, 1.0, "Caps", "A"), (2, "END", 2, 3, 0.5, "Ends", "n")]
