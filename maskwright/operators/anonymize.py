"""Rewriting of texts by spans, and back."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import make_span
from .resolve import without_conflicts

ITEM = "struct<entity_type:string,start:int,end:int,operator:string>"
_ITEMS = f"array<{ITEM}>"


@dataclass(frozen=True)
class Operator:
    """What becomes of a span's text."""

    name: str
    apply: Callable[[Column], Column]


def replace(value: str) -> Operator:
    return Operator("replace", lambda _: F.lit(value))


def redact() -> Operator:
    return Operator("redact", lambda _: F.lit(""))


def keep() -> Operator:
    return Operator("keep", lambda x: x)


def custom(name: str, function: Callable[[Column], Column]) -> Operator:
    """function maps a Column to a Column."""
    return Operator(name, function)


def mask(letter: str = "*", count: int = 0, from_end: bool = False) -> Operator:
    """Cover count characters, or all if there are fewer, from the start or the end; a negative count covers none."""

    def apply(x: Column) -> Column:
        n = F.least(F.lit(max(0, count)), F.length(x))
        cover = F.repeat(F.lit(letter), n)
        return F.concat(F.substring(x, F.lit(1), F.length(x) - n), cover) if from_end else F.concat(cover, F.substring(x, n + 1, F.length(x)))

    return Operator("mask", apply)


def sha256() -> Operator:
    return Operator("hash", lambda x: F.sha2(x, 256))


def _checked(key: bytes | str) -> Column:
    raw = key.encode() if isinstance(key, str) else key
    if len(raw) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    return F.lit(bytearray(raw))


def encrypt(key: bytes | str) -> Operator:
    """AES-GCM with a random nonce: base64 of nonce, ciphertext and tag. Write the result down before using it twice."""
    k = _checked(key)
    return Operator("encrypt", lambda x: F.translate(F.base64(F.aes_encrypt(x, k, F.lit("GCM"), F.lit("DEFAULT"))), "\r\n", ""))


def decrypt(key: bytes | str) -> Operator:
    """The inverse of encrypt; text that is no base64, truncated or forged is an error."""
    k = _checked(key)

    def apply(x: Column) -> Column:
        bad = ~x.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
        return F.when(bad, F.raise_error(F.lit("not base64"))).otherwise(F.aes_decrypt(F.unbase64(x), k, F.lit("GCM"), F.lit("DEFAULT")).cast("string"))

    return Operator("decrypt", apply)


def _picked(entity: Column, operators: Mapping[str, Operator], what: Callable[[Operator | None], Column]) -> Column:
    """What the entity's operator, the DEFAULT operator, or else none, gives."""
    default = what(operators.get("DEFAULT"))
    own = [(k, op) for k, op in operators.items() if k != "DEFAULT"]
    if not own:
        return default
    out = F
    for key, op in own:
        out = out.when(entity == key, what(op))
    return out.otherwise(default)


def rewrite(text: Column, spans: Column, operators: Mapping[str, Operator]) -> Column:
    """struct<text, items>: spans in order, already without conflicts, replaced; items have offsets in the new text.

    A span outside the text, or one that ends before it starts, is an error.
    """

    def step(state: Column, s: Column) -> Column:
        bad = (s["start"] < 0) | (s["end"] > F.length(text)) | (s["start"] > s["end"])
        value = F.when(bad, F.raise_error(F.lit("span out of range")).cast("string")).otherwise(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        new = _picked(s["entity_type"], operators, lambda op: F.concat(F.lit("<"), s["entity_type"], F.lit(">")) if op is None else op.apply(value))
        new = F.when(bad, value).otherwise(new)
        name = _picked(s["entity_type"], operators, lambda op: F.lit("replace" if op is None else op.name))
        bound = F.transform(F.array(F.struct(F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"])).alias("head"), new.alias("new"))), lambda x: F.struct(
            s["end"].alias("at"), F.concat(x["head"], x["new"]).alias("out"),
            F.concat(state["items"], F.array(F.struct(s["entity_type"].alias("entity_type"), F.length(x["head"]).alias("start"), (F.length(x["head"]) + F.length(x["new"])).alias("end"), name.alias("operator")))).alias("items"),
        ))
        return F.element_at(bound, 1)

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(_ITEMS).alias("items"))
    done = F.aggregate(spans, first, step, lambda s: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))).alias("text"), s["items"].alias("items")))
    untouched = F.struct(text.alias("text"), F.array().cast(_ITEMS).alias("items"))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, untouched).otherwise(done)


def anonymize(df: DataFrame, operators: Mapping[str, Operator] | None = None, text: str = "text", spans: str = "spans", to: str = "anonymized") -> DataFrame:
    """df with struct<text, items>: overlapping spans resolved, the rest rewritten by operators.

    Without an operator for its type, and without a DEFAULT, a span becomes its type in angle brackets. Null
    texts stay null.
    """
    df = df.withColumn("__kept", without_conflicts(F.col(spans)))
    return df.withColumn(to, rewrite(F.col(text), F.col("__kept"), operators or {})).drop("__kept")


def deanonymize(df: DataFrame, operators: Mapping[str, Operator], anonymized: str = "anonymized", to: str = "restored") -> DataFrame:
    """df with the struct that rewriting an earlier result's items gives, such as by decrypt."""
    item = F.col(anonymized)
    spans = F.transform(item["items"], lambda x, i: make_span(x["entity_type"], x["start"], x["end"], F.lit(1.0), F.lit(None), F.lit(None), F.lit(1.0), F.lit(0.0), i))
    df = df.withColumn("__text", item["text"]).withColumn("__kept", without_conflicts(spans))
    return df.withColumn(to, rewrite(F.col("__text"), F.col("__kept"), operators)).drop("__text", "__kept")
