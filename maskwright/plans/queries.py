"""The registered queries. Most texts are put together from keys, the same way on both sides, so that each
recognizer meets valid and invalid values, accents and emoji before them, and several matches in a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import Pattern, make_span
from ..operators import anonymize as A
from ..operators import ner as N
from ..operators import recognizers as R
from ..operators.analyze import Analyzer, explode_spans, span_rows
from ..operators.context import Enhancer
from ..operators.evaluate import agreement, detection_failures, golden_failures
from ..operators.python_path import FunctionRecognizer, anonymize_with, register_table_function
from ..operators.registry import Registry, default_registry
from ..operators.resolve import drop_contained, without_conflicts
from ..sources import spread
from .oracle import VERDICTS, boosted_sql, spans_sql, window_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(width: int, factor: int = 1, key: str = "o_orderkey") -> str:
    return f"lpad(CAST(({key} * {factor}) % {10**width} AS STRING), {width}, '0')"


# (table, id, text): expressions that both dialects share.
_N9, _N10, _N8 = _key(9, 7919), _key(9, 104729), _key(8, 15485863)
TEXTS: dict[str, tuple[str, str, str]] = {
    "credit_card": ("orders", "o_orderkey", f"concat('é😀 card 4', {_key(15, 982451653)}, ' or 4012-8888-8888-18', {_key(2)})"),
    "email": ("customer", "c_custkey", "concat('Prénom — ', c_name, '@ex-am.ple.org, x', CAST(c_custkey AS STRING), '@b.io; no@domain ', c_mktsegment)"),
    "iban": ("orders", "o_orderkey", f"concat('iban GB', {_key(2, 37)}, 'NWBK6016133192', {_key(4)}, ' et FR', {_key(2)}, '20041010050500013M02606')"),
    "ip": ("orders", "o_orderkey", "concat('é ip ', CAST(o_orderkey % 300 AS STRING), '.', CAST(o_custkey % 256 AS STRING), '.0.', CAST(o_orderkey % 7 AS STRING), ' or 2001:db8::', CAST(o_orderkey % 10000 AS STRING), ' at 12:30:', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'))"),
    "url": ("customer", "c_custkey", "concat('see https://www.site', CAST(c_custkey AS STRING), '.com/a?b=1 and john.smith', CAST(c_custkey AS STRING), '.community or ', c_mktsegment, '.de')"),
    "mac": ("orders", "o_orderkey", "concat('dev 00:1B:44:11:3A:', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), ' 00-1b-44-11-3a-', lpad(CAST(o_custkey % 100 AS STRING), 2, '0'), ' 00:1B-44:11-3A:B7 001b.4411.3a', lpad(CAST(o_custkey % 1000 AS STRING), 2, '0'))"),
    "us_ssn": ("orders", "o_orderkey", f"concat('é ssn ', substr({_N9}, 1, 3), '-', substr({_N9}, 4, 2), '-', substr({_N9}, 6, 4), ' or ', {_N10}, ' or ', substr({_N10}, 1, 3), ' ', substr({_N10}, 4, 2), '.', substr({_N10}, 6, 4))"),
    "us_itin": ("orders", "o_orderkey", f"concat('tin 9', substr({_N8}, 1, 2), '-', substr({_N8}, 3, 2), '-', substr({_N8}, 5, 4), ' 9', {_N8}, ' 9', substr({_N8}, 1, 4), '-', substr({_N8}, 5, 4))"),
    "us_passport": ("orders", "o_orderkey", f"concat('passport ', {_N9}, ', A', {_N8})"),
    "us_license": ("orders", "o_orderkey", f"concat('lic A', {_key(5)}, ' H', {_N8}, ' A-Z]]', {_key(3)}, ' ', {_N9}, 'X ', {_key(7)}, ' AB', {_key(6)}, 'C')"),
    "us_bank": ("orders", "o_orderkey", f"concat('account ', {_N8}, ' ', {_key(17, 99991)}, ' é', {_N9})"),
    "us_aba": ("orders", "o_orderkey", f"concat('routing ', {_N9}, ' ', substr({_N10}, 1, 4), '-', substr({_N10}, 5, 4), '-', substr({_N10}, 9, 1))"),
    "us_npi": ("orders", "o_orderkey", f"concat('npi 1', {_N9}, ' 2', substr({_N10}, 1, 3), '-', substr({_N10}, 4, 3), ' ', substr({_N10}, 7, 3), ' 1111111111')"),
    "us_mbi": ("orders", "o_orderkey", "concat('mbi 1EG', CAST(o_orderkey % 10 AS STRING), '-TE5-MK', lpad(CAST(o_custkey % 100 AS STRING), 2, '0'), ' 1EG', CAST(o_orderkey % 10 AS STRING), 'TE5MK73 1SG4TE5MK73')"),
    "medical_license": ("orders", "o_orderkey", f"concat('DEA AB', {_key(7, 7919)}, ' x9', {_key(7, 104729)})"),
    "fr_nir": ("orders", "o_orderkey", f"concat('sécu 1 85 05 78 006 084 ', {_key(2)}, ' 2', {_key(4)}, '2A', {_key(8, 7919)})"),
    "fr_siren": ("orders", "o_orderkey", f"concat('siren ', {_N9}, ' é ', substr({_N10}, 1, 3), ' ', substr({_N10}, 4, 3), ' ', substr({_N10}, 7, 3))"),
    "fr_siret": ("orders", "o_orderkey", f"concat('siret ', {_key(14, 99999989)})"),
    "fr_plate": ("orders", "o_orderkey", "concat('plaque AB-', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '-CD IO-123-UU')"),
    "fr_phone": ("orders", "o_orderkey", f"concat('tél 06 ', substr({_N8}, 1, 2), ' ', substr({_N8}, 3, 2), '.', substr({_N8}, 5, 2), '-', substr({_N8}, 7, 2), ', +33 6', {_N8}, ' é06', {_N8})"),
}
_MAKERS: dict[str, R.PatternRecognizer] = {
    "credit_card": R.credit_card("en"), "email": R.email("en"), "iban": R.iban("en"), "ip": R.ip("en"), "url": R.url("en"), "mac": R.mac("en"),
    "us_ssn": R.us_ssn(), "us_itin": R.us_itin(), "us_passport": R.us_passport(), "us_license": R.us_license(), "us_bank": R.us_bank(), "us_aba": R.us_aba(), "us_npi": R.us_npi(), "us_mbi": R.us_mbi(), "medical_license": R.medical_license(),
    "fr_nir": R.fr_nir(), "fr_siren": R.fr_siren(), "fr_siret": R.fr_siret(), "fr_plate": R.fr_plate(), "fr_phone": R.fr_phone(),
}


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, text = TEXTS[name]
    return spread(_table(spark, sf_dir, table)).select(F.expr(f"CAST({key} AS BIGINT)").alias("id"), F.expr(text).alias("text"))


def texts_sql(name: str) -> str:
    table, key, text = TEXTS[name]
    return f"SELECT CAST({key} AS BIGINT) AS id, {text} AS text FROM {table}"


def _detected(recognizer: R.PatternRecognizer, df: DataFrame) -> DataFrame:
    return span_rows(df, recognizer.detect(F.col("text")), ["id"]).select("id", "s.entity_type", "s.start", "s.end", "s.score")


def _register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_SPAN_COLUMNS = 'id, entity_type, start, "end", score'
for _name, _recognizer in _MAKERS.items():
    _register(f"recognize_{_name}", f"SELECT {_SPAN_COLUMNS} FROM ({spans_sql(texts_sql(_name), _recognizer, VERDICTS.get(_recognizer.name))}) z")(
        lambda spark, sf_dir, n=_name, r=_recognizer: _detected(r, texts(spark, sf_dir, n))
    )

_DOCUMENTS = "SELECT doc_id AS id, text FROM documents"
_EMAIL, _IP, _URL = R.email("en"), R.ip("en"), R.url("en")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang"))


@_register("detect_email_documents", f"SELECT {_SPAN_COLUMNS} FROM ({spans_sql(_DOCUMENTS, _EMAIL)}) z")
def detect_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(_EMAIL, _documents(spark, sf_dir))


@_register("detect_ip_documents", f"SELECT {_SPAN_COLUMNS} FROM ({spans_sql(_DOCUMENTS, _IP, VERDICTS['IpRecognizer'])}) z")
def detect_ip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(_IP, _documents(spark, sf_dir))


@_register("detect_url_pages", f"SELECT {_SPAN_COLUMNS} FROM ({spans_sql('SELECT page_id AS id, url AS text FROM pages', _URL)}) z")
def detect_url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(_URL, _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text")))


@_register("anonymize_email_documents", f"SELECT doc_id AS id, regexp_replace(text, '{R.EMAIL.replace(chr(39), chr(39) * 2)}', '<EMAIL_ADDRESS>', 'g') AS text FROM documents")
def anonymize_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: find, resolve and rewrite e-mail addresses in every document."""
    analyzer = Analyzer(Registry([R.email("en")]), enhancer=None)
    return A.anonymize(analyzer.analyze(_documents(spark, sf_dir))).select("id", F.col("anonymized.text").alias("text"))


@_register("anonymize_conversations", f"SELECT conv_id, turn, regexp_replace(text, '{R.EMAIL.replace(chr(39), chr(39) * 2)}', '<EMAIL_ADDRESS>', 'g') AS text FROM conversations")
def anonymize_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzer = Analyzer(Registry([R.email("en")]), enhancer=None)
    return A.anonymize(analyzer.analyze(_table(spark, sf_dir, "conversations"))).select("conv_id", "turn", F.col("anonymized.text").alias("text"))


# The whole analysis of one recognizer: boost, contained duplicates, threshold.
def _analyzed_sql(name: str, recognizer: R.PatternRecognizer, min_score: float = 0.0) -> str:
    source = texts_sql(name)
    boosted = boosted_sql("win", recognizer.context, "score")
    return f"""
WITH t AS ({source}), s AS ({spans_sql('SELECT * FROM t', recognizer, VERDICTS.get(recognizer.name))}),
w AS (SELECT s.*, {window_sql('t.text', 's.start')} AS win FROM s JOIN t ON s.id = t.id),
b AS (SELECT id, entity_type, start, "end", {boosted} AS score, pat * 1000 + i AS ord FROM w),
d AS (SELECT * FROM b c WHERE NOT EXISTS (SELECT 1 FROM b k WHERE k.id = c.id AND k.entity_type = c.entity_type AND k.start <= c.start AND c."end" <= k."end"
  AND (k.score > c.score OR (k.score = c.score AND (k."end" - k.start > c."end" - c.start OR (k."end" - k.start = c."end" - c.start AND k.ord < c.ord))))))
SELECT id, entity_type, start, "end", round(score, 6) AS score FROM d WHERE score >= {min_score}"""


def _analyzed(name: str, recognizer: R.PatternRecognizer, min_score: float = 0.0) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Analyzer(Registry([recognizer])).analyze(texts(spark, sf_dir, name), language=recognizer.language, min_score=min_score)
        return span_rows(df, keep=["id"]).select("id", "s.entity_type", "s.start", "s.end", F.round("s.score", 6).alias("score"))

    return run


for _name in ("us_ssn", "us_itin", "us_npi", "fr_phone", "credit_card", "iban"):
    _register(f"analyze_{_name}", _analyzed_sql(_name, _MAKERS[_name]))(_analyzed(_name, _MAKERS[_name]))
_register("analyze_min_score", _analyzed_sql("us_aba", _MAKERS["us_aba"], 0.4))(_analyzed("us_aba", _MAKERS["us_aba"], 0.4))

_CONTEXT_TEXT = f"concat(CASE WHEN o_orderkey % 3 = 0 THEN 'email é ' WHEN o_orderkey % 3 = 1 THEN 'my Emails are one two three four five six ' ELSE 'addr ' END, 'a', {_key(4)}, '@b.org')"


@_register(
    "context_boost",
    f"WITH t AS (SELECT CAST(o_orderkey AS BIGINT) AS id, {_CONTEXT_TEXT} AS text FROM orders), s AS ({spans_sql('SELECT * FROM t', _EMAIL)}), w AS (SELECT s.*, {window_sql('t.text', 's.start')} AS win FROM s JOIN t ON s.id = t.id) "
    f"SELECT id, start, round({boosted_sql('win', _EMAIL.context, 'score')}, 6) AS score, CASE WHEN contains(win, 'email') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS context_boost FROM w",
)
def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select(F.expr("CAST(o_orderkey AS BIGINT)").alias("id"), F.expr(_CONTEXT_TEXT).alias("text"))
    df = df.withColumn("raw", _EMAIL.detect(F.col("text")))
    return span_rows(df, Enhancer().enhance(F.col("text"), F.col("raw"), [_EMAIL]), ["id"]).select("id", "s.start", F.round("s.score", 6).alias("score"), "s.context_boost")


# Spans made of order lines, for the folds over spans: (name, expression) in both dialects.
_LINE_COLUMNS = {
    "id": "l_orderkey",
    "entity_type": "CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END",
    "start": "CAST(l_partkey % 30 AS INT)",
    "end": "CAST(l_partkey % 30 + 1 + l_suppkey % 12 AS INT)",
    "score": "CAST(l_linenumber % 3 AS DOUBLE) / 4",
    "ord": "CAST(l_linenumber AS BIGINT)",
}
_LINE = ", ".join(f'{v} AS "{k}"' for k, v in _LINE_COLUMNS.items())


def _line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(*[F.expr(v).alias(k) for k, v in _LINE_COLUMNS.items()])
    span = make_span(F.col("entity_type"), F.col("start"), F.col("end"), F.col("score"), F.lit(None), F.lit(None), F.col("score"), F.lit(0.0), F.col("ord"))
    return rows.groupBy("id").agg(F.collect_list(span).alias("spans"))


_FLAT = ["id", "s.entity_type", "s.start", "s.end", "s.score", "s.ord"]


@_register(
    "drop_contained_spans",
    f"""WITH b AS (SELECT {_LINE} FROM lineitem)
SELECT id, entity_type, start, "end", score, ord FROM b c WHERE NOT EXISTS (SELECT 1 FROM b k WHERE k.id = c.id AND k.entity_type = c.entity_type AND k.start <= c.start AND c."end" <= k."end"
  AND (k.score > c.score OR (k.score = c.score AND (k."end" - k.start > c."end" - c.start OR (k."end" - k.start = c."end" - c.start AND k.ord < c.ord)))))""",
)
def drop_contained_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(_line_spans(spark, sf_dir), drop_contained(F.col("spans")), ["id"]).select(*_FLAT)


@_register(
    "resolve_conflicts",
    f"""WITH b AS (SELECT {_LINE} FROM lineitem),
l AS (SELECT id, list({{'t': entity_type, 's': start, 'e': "end", 'c': score, 'o': ord}} ORDER BY score DESC, "end" - start DESC, start, ord, entity_type) AS x FROM b GROUP BY id),
r AS (SELECT id, list_reduce(list_transform(x, lambda v: [v]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda k: v[1].s < k.e AND k.s < v[1].e)) > 0 THEN acc ELSE list_concat(acc, v) END) AS k FROM l)
SELECT id, u.t AS entity_type, u.s AS start, u.e AS "end", u.c AS score, u.o AS ord FROM (SELECT id, unnest(k) AS u FROM r)""",
)
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(_line_spans(spark, sf_dir), without_conflicts(F.col("spans")), ["id"]).select(*_FLAT)


@_register(
    "agreement",
    """WITH o AS (SELECT l_orderkey AS id, l_returnflag AS entity_type, l_partkey % 30 AS s, l_linenumber % 3 AS c FROM lineitem),
a AS (SELECT DISTINCT id, entity_type, s FROM o WHERE c > 0), b AS (SELECT DISTINCT id, entity_type, s FROM o WHERE c < 2 AND entity_type <> 'N')
SELECT count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS agreed, count(*) AS total, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL)::DOUBLE / count(*) AS ratio
FROM a FULL JOIN b ON a.id = b.id AND a.entity_type = b.entity_type AND a.s = b.s""",
)
def agreement_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("entity_type"), (F.col("l_partkey") % 30).alias("start"), (F.col("l_partkey") % 30 + 1).alias("end"), (F.col("l_linenumber") % 3).alias("c"))
    ours = rows.withColumn("score", F.when(F.col("c") > 0, 0.5).otherwise(0.1))
    theirs = rows.withColumn("score", F.when((F.col("c") < 2) & (F.col("entity_type") != "N"), 0.5).otherwise(0.1))
    return agreement(ours, theirs)


@_register(
    "detection_failures",
    """WITH e AS (SELECT o_orderkey AS id, 'A' AS entity_type, CAST(o_orderkey % 5 AS INTEGER) AS s FROM orders), f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'B' ELSE 'A' END AS entity_type, CAST(o_orderkey % 3 AS INTEGER) AS s FROM orders)
SELECT e.id, 'missing' AS failure, e.entity_type FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = e.id AND f.entity_type = e.entity_type AND f.s = e.s)
UNION ALL SELECT id, 'forbidden' AS failure, entity_type FROM f WHERE entity_type = 'B'""",
)
def detection_failures_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    want = F.struct(F.lit("A").alias("entity_type"), (F.col("o_orderkey") % 5).cast("int").alias("start"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("end"), F.lit(0.4).alias("min_score"))
    corpus = orders.select(F.col("o_orderkey").alias("id"), F.array(want).alias("expected"), F.array(F.lit("B")).alias("forbid"))
    found = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "B").otherwise("A").alias("entity_type"), (F.col("o_orderkey") % 3).cast("int").alias("start"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("end"), F.lit(0.5).alias("score"))
    return detection_failures(found, corpus)


# Operators: the name of a customer within a sentence, at known offsets.
def _customers(spark: SparkSession, sf_dir: str, score: float = 0.5) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("né😀 "), F.col("c_name"), F.lit(" dû")).alias("text"), F.col("c_name").alias("name"))
    span = make_span(F.lit("NAME"), F.lit(4), F.length("name") + 4, F.lit(score), F.lit(None), F.lit(None), F.lit(score), F.lit(0.0), F.lit(0))
    return df.withColumn("spans", F.array(span))


def _operator_query(operator: A.Operator, new: str) -> None:
    sql = f"SELECT c_custkey AS id, concat('né😀 ', {new}, ' dû') AS text, 4 AS start, CAST(4 + length({new}) AS INTEGER) AS \"end\", '{operator.name}' AS operator FROM customer"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = A.anonymize(_customers(spark, sf_dir), {"DEFAULT": operator})
        item = F.col("anonymized.items")[0]
        return done.select("id", F.col("anonymized.text").alias("text"), item["start"].alias("start"), item["end"].alias("end"), item["operator"].alias("operator"))

    _register(f"operator_{operator.name}" if f"operator_{operator.name}" not in QUERIES else f"operator_{operator.name}_end", sql)(run)


_operator_query(A.replace("<X>"), "'<X>'")
_operator_query(A.redact(), "''")
_operator_query(A.keep(), "c_name")
_operator_query(A.mask("*", 12), "concat(repeat('*', least(12, length(c_name))), substr(c_name, 13))")
_operator_query(A.mask("#", 4, True), "concat(substr(c_name, 1, length(c_name) - 4), '####')")
_operator_query(A.sha256(), "sha256(c_name)")
_operator_query(A.custom("upper", F.upper), "upper(c_name)")

_AES = b"0123456789abcdef"


@_register("encrypt_decrypt", "SELECT c_custkey AS id, concat('né😀 ', c_name, ' dû') AS text FROM customer")
def encrypt_decrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = A.anonymize(_customers(spark, sf_dir), {"NAME": A.encrypt(_AES)})
    return A.deanonymize(done, {"NAME": A.decrypt(_AES)}).select("id", F.col("restored.text").alias("text"))


@_register("encrypted_length", "SELECT c_custkey AS id, CAST(ceil((28 + length(c_name)) / 3.0) * 4 AS INTEGER) AS n FROM customer")
def encrypted_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = A.anonymize(_customers(spark, sf_dir), {"NAME": A.encrypt(_AES)})
    item = F.col("anonymized.items")[0]
    return done.select("id", (item["end"] - item["start"]).alias("n"))


@_register("pick_operator", "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN '' WHEN '2-HIGH' THEN 'h' ELSE '*' END AS text FROM orders")
def pick_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("h").alias("text"), F.array(make_span(F.col("o_orderpriority"), F.lit(0), F.lit(1), F.lit(1.0), F.lit(None), F.lit(None), F.lit(1.0), F.lit(0.0), F.lit(0))).alias("spans"))
    return A.anonymize(df, {"1-URGENT": A.redact(), "2-HIGH": A.keep(), "DEFAULT": A.mask("*", 3)}).select("id", F.col("anonymized.text").alias("text"))


_GOOD = ("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq")


@_register(
    "recognize_crypto",
    "WITH a AS (SELECT o_orderkey AS id, ['" + "', '".join(_GOOD) + "'][1 + o_orderkey % 3] AS good, substr('23456789acdefghjkmnpqrstuvwxyz', CAST(1 + o_orderkey % 30 AS INTEGER), 1) AS last FROM orders) "
    "SELECT id, 'CRYPTO' AS entity_type, 7 AS start, CAST(7 + length(good) AS INTEGER) AS \"end\", 1.0::DOUBLE AS score FROM a WHERE substr(good, length(good), 1) = last",
)
def recognize_crypto(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.element_at(F.array(*map(F.lit, _GOOD)), (1 + F.col("o_orderkey") % 3).cast("int"))
    last = F.substring(F.lit("23456789acdefghjkmnpqrstuvwxyz"), (1 + F.col("o_orderkey") % 30).cast("int"), F.lit(1))
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("wallet "), F.substring(good, F.lit(1), F.length(good) - 1), last).alias("text"))
    return _detected(R.crypto("en"), df)


_SUPPORTED = {
    "en": (
        "CREDIT_CARD", "EMAIL_ADDRESS", "IBAN_CODE", "IP_ADDRESS", "URL", "MAC_ADDRESS", "CRYPTO", "US_SSN", "US_ITIN", "US_PASSPORT", "US_DRIVER_LICENSE", "US_BANK_NUMBER", "ABA_ROUTING_NUMBER", "US_NPI", "US_MBI", "MEDICAL_LICENSE"
    ),
    "fr": ("CREDIT_CARD", "EMAIL_ADDRESS", "IBAN_CODE", "IP_ADDRESS", "URL", "MAC_ADDRESS", "CRYPTO", "FR_NIR", "FR_SIREN", "FR_SIRET", "FR_LICENSE_PLATE", "FR_PHONE_NUMBER"),
}


@_register("supported_entities", "SELECT * FROM (VALUES " + ", ".join(f"('{code}', {i}, '{e}')" for code, entities in _SUPPORTED.items() for i, e in enumerate(entities)) + ") t(language, place, entity_type)")
def supported_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = default_registry("en", "fr")
    return spark.createDataFrame([(c, i, e) for c in ("en", "fr") for i, e in enumerate(registry.supported_entities(c))], "language string, place int, entity_type string")


@_register("language_selection", f"SELECT id, entity_type, start, \"end\", score FROM ({spans_sql('SELECT doc_id AS id, text FROM documents WHERE lang = ' + chr(39) + 'fr' + chr(39), R.email('fr'))}) z")
def language_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents in French have a recognizer here."""
    done = Analyzer(Registry([R.email("fr")]), enhancer=None).analyze(_documents(spark, sf_dir), language=F.col("lang"))
    return span_rows(done, keep=["id"]).select("id", "s.entity_type", "s.start", "s.end", "s.score")


@_register("entity_selection", f"SELECT id, entity_type, start, \"end\", score FROM ({spans_sql(texts_sql('us_bank'), _MAKERS['us_bank'])}) z")
def entity_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = Analyzer(default_registry("en"), enhancer=None).analyze(texts(spark, sf_dir, "us_bank"), entities=["US_BANK_NUMBER"])
    return span_rows(done, keep=["id"]).select("id", "s.entity_type", "s.start", "s.end", "s.score")


_LANGUAGES = ("en", "fr", "de", "es")


def _corpus_sql(min_score: float = 0.0) -> str:
    """Spans (id, entity_type, start, end, score, ord, recognizer, value) of every recognizer of each document's language.

    Whether a string is a coin address is beyond SQL: none in these documents is taken to be one.
    """
    groups: dict[tuple, tuple[R.PatternRecognizer, list[str]]] = {}
    for recognizer in default_registry(*_LANGUAGES):
        groups.setdefault((recognizer.name, recognizer.patterns), (recognizer, []))[1].append(recognizer.language)
    parts = []
    for order, (recognizer, languages) in enumerate(groups.values()):
        source = "SELECT * FROM t WHERE lang IN (" + ", ".join(f"'{x}'" for x in languages) + ")"
        verdict = "false" if recognizer.name == "CryptoRecognizer" else VERDICTS.get(recognizer.name)
        found = f"SELECT s.*, {window_sql('t.text', 's.start')} AS win FROM ({spans_sql(source, recognizer, verdict)}) s JOIN t ON s.id = t.id"
        parts.append(f"SELECT id, entity_type, start, \"end\", {boosted_sql('win', recognizer.context, 'score')} AS score, {order} * 10000000 + pat * 100000 + i AS ord, '{recognizer.name}' AS recognizer, v AS value FROM ({found}) w")
    union = "\nUNION ALL ".join(parts)
    return f"""
WITH t AS (SELECT doc_id AS id, text, lang FROM documents), b AS (SELECT * FROM ({union}) u WHERE score >= {min_score}),
d AS (SELECT * FROM b c WHERE NOT EXISTS (SELECT 1 FROM b k WHERE k.id = c.id AND k.entity_type = c.entity_type AND k.start <= c.start AND c."end" <= k."end"
  AND (k.score > c.score OR (k.score = c.score AND (k."end" - k.start > c."end" - c.start OR (k."end" - k.start = c."end" - c.start AND k.ord < c.ord))))))"""


@_register("analyze_documents", f'{_corpus_sql()} SELECT id, entity_type, start, "end", round(score, 6) AS score, recognizer, value FROM d')
def analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recognizer of each document's language over all documents."""
    done = Analyzer(default_registry(*_LANGUAGES)).analyze(_documents(spark, sf_dir), language=F.col("lang"))
    return explode_spans(done, keep=["id"]).select("id", "entity_type", "start", "end", F.round("score", 6).alias("score"), "recognizer", "value")


@_register(
    "anonymize_documents",
    f"""{_corpus_sql(0.4)},
l AS (SELECT id, list({{'t': entity_type, 's': start, 'e': "end"}} ORDER BY score DESC, "end" - start DESC, start, ord) AS x FROM d GROUP BY id),
r AS (SELECT id, list_reduce(list_transform(x, lambda v: [v]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda k: v[1].s < k.e AND k.s < v[1].e)) > 0 THEN acc ELSE list_concat(acc, v) END) AS k FROM l),
p AS (SELECT id, u.t AS t, u.s AS s, u.e AS e, coalesce(lag(u.e) OVER (PARTITION BY id ORDER BY u.s), 0) AS past FROM (SELECT id, unnest(k) AS u FROM r)),
w AS (SELECT p.id, string_agg(substr(t.text, past + 1, s - past) || '<' || p.t || '>', '' ORDER BY s) AS front, max(e) AS last, CAST(count(*) AS INTEGER) AS n FROM p JOIN t ON p.id = t.id GROUP BY p.id)
SELECT t.id, CASE WHEN w.id IS NULL THEN t.text ELSE front || substr(t.text, last + 1) END AS text, coalesce(n, 0) AS n_items FROM t LEFT JOIN w ON t.id = w.id""",
)
def anonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = Analyzer(default_registry(*_LANGUAGES)).analyze(_documents(spark, sf_dir), language=F.col("lang"), min_score=0.4)
    return A.anonymize(done).select("id", F.col("anonymized.text").alias("text"), F.size("anonymized.items").alias("n_items"))


@_register(
    "ner_spans",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'PERSON' ELSE 'LOCATION' END AS entity_type, CAST(c_custkey % 7 AS INTEGER) AS start, CAST(c_custkey % 7 + 3 AS INTEGER) AS \"end\", 0.75::DOUBLE AS score, CASE WHEN c_custkey % 3 = 0 THEN 'ner:PER' ELSE 'ner:LOC' END AS pattern FROM customer WHERE c_custkey % 3 < 2",
)
def ner_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = F.struct(F.when(F.col("c_custkey") % 3 == 0, "PER").when(F.col("c_custkey") % 3 == 1, "LOC").otherwise("ODD").alias("label"), (F.col("c_custkey") % 7).cast("int").alias("start"), (F.col("c_custkey") % 7 + 3).cast("int").alias("end"), F.lit(0.75).alias("score"))
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.array(entity).alias("ner_entities")).alias("artifacts"))
    return df.select("id", F.explode(R.NerRecognizer().detect(F.lit(""), 0, F.col("artifacts"))).alias("s")).select("id", "s.entity_type", "s.start", "s.end", "s.score", "s.pattern")


def _shelves(text: str):
    """Shelf marks: a capital and its place."""
    return [(i, i + 1, 0.5) for i, c in enumerate(text) if "A" <= c <= "Z"]


@_register("function_recognizer", "SELECT id, 'SHELF' AS entity_type, CAST(i - 1 AS INTEGER) AS start, CAST(i AS INTEGER) AS \"end\", 0.5::DOUBLE AS score FROM (SELECT c_custkey AS id, c_mktsegment AS t, unnest(range(1, length(c_mktsegment) + 1)) AS i FROM customer) WHERE substr(t, i, 1) BETWEEN 'A' AND 'Z'")
def function_recognizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    recognizer = FunctionRecognizer("ShelfRecognizer", "SHELF", "en", _shelves)
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"))
    return df.select("id", F.explode(recognizer.detect(F.col("text"))).alias("s")).select("id", "s.entity_type", "s.start", "s.end", "s.score")


@_register(
    "table_function",
    "SELECT id, 'SHELF' AS entity_type, CAST(i - 1 AS INTEGER) AS start, CAST(i AS INTEGER) AS \"end\", 0.5::DOUBLE AS score, 'ShelfRecognizer' AS recognizer, substr(t, i, 1) AS value "
    "FROM (SELECT c_custkey AS id, c_mktsegment AS t, unnest(range(1, length(c_mktsegment) + 1)) AS i FROM customer WHERE c_nationkey % 2 = 0) WHERE substr(t, i, 1) BETWEEN 'A' AND 'Z'",
)
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognizer called from SQL; customers of every other nation are in a language that it does not know."""
    register_table_function(spark, "detect_shelves", [FunctionRecognizer("ShelfRecognizer", "SHELF", "en", _shelves)])
    customers = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS text", "IF(c_nationkey % 2 = 0, 'en', 'xx') AS lang")
    return spark.sql("SELECT c.id, d.* FROM {customers} c, LATERAL detect_shelves(c.text, c.lang) d", customers=customers)


def _backwards(value: str) -> str:
    return value[::-1]


@_register("operator_function", "SELECT c_custkey AS id, concat('né😀 ', reverse(c_name), ' dû') AS text, '_backwards' AS operator FROM customer")
def operator_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = anonymize_with(_customers(spark, sf_dir), {"NAME": _backwards})
    return done.select("id", F.col("anonymized.text").alias("text"), F.col("anonymized.items")[0]["operator"].alias("operator"))


@_register("golden_failures", "SELECT c_custkey AS id, concat('mail <EMAIL_ADDRESS> of ', c_custkey) AS text, 'mail <EMAIL_ADDRESS> of 1' AS expected_text FROM customer WHERE c_custkey <> 1")
def golden_failures_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("mail x@y.org of "), F.col("c_custkey").cast("string"))
    corpus = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("en").alias("language"), text.alias("text"), F.lit("mail <EMAIL_ADDRESS> of 1").alias("expected_text"))
    return golden_failures(corpus, Analyzer(Registry([R.email("en")])))


def _capitals() -> N.Predict:
    """A stand-in for a model: words with a capital are people."""
    return lambda tokens: [("B-PER", 0.9) if t.text[:1].isupper() else ("O", 0.9) for t in tokens]


#: What the stand-in takes for a person: a word of plain letters with a capital first. Other words are unknown to its vocabulary.
_CAPITALISED = R.PatternRecognizer("", "PERSON", "en", (Pattern("", r"[^\s\p{Z}\p{P}\p{S}]+", 0.9),))


@_register(
    "ner_engine",
    f"""SELECT id.c AS conv_id, id.t AS turn, entity_type, start, "end", score, v AS value
FROM ({spans_sql("SELECT {'c': conv_id, 't': turn} AS id, text FROM conversations", _CAPITALISED)}) z WHERE regexp_full_match(v, '[A-Z][a-z]*')""",
)
def ner_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, windows, labels and merging over all conversations, with a stand-in for the model."""
    vocabulary = N.read_vocabulary(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz")])
    engine = N.NerEngine(vocabulary, _capitals)
    done = Analyzer(Registry([R.NerRecognizer("en")]), engine=engine).analyze(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return explode_spans(done, keep=["conv_id", "turn"]).select("conv_id", "turn", "entity_type", "start", "end", "score", "value")
