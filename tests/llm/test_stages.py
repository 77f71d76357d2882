"""Every stage of the pipeline on what its predecessor kept, against plain Python over all of those documents."""

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from maskwright.llm import ftrl
from maskwright.llm.common import durable

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


@pytest.fixture(scope="module")
def stages(spark, small):
    """Rows by stage; those of documents come first. Three copies of a document, one of them far from its original, are added."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    top = docs.agg({"doc_id": "max"}).first()[0]
    extra = []
    for i, r in enumerate(docs.where("length(text) > 600").orderBy("doc_id").limit(3).collect()):
        words = r.text.split(" ")
        extra.append((top + 1 + i, " ".join([*words[: len(words) - i * len(words) // 4], *(f"other{k}" for k in range(i * len(words) // 4))]), r.lang, r.source, len(r.text)))
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, small))
        out[name] = docs.collect()
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_quality_drops_what_scores_low(spark, small, stages):
    weights = ftrl.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    before = texts(stages["documents"])
    good = {i for i, t in before.items() if ftrl.scores([t], weights)[0] >= ftrl.THRESHOLD}
    assert texts(stages["quality"]) == {i: before[i] for i in good}
    assert 0 < len(good) < len(before)
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert all(i in good for i, label in marked.items() if label == 1 and i in before)


def test_lines_on_many_sites_go(stages):
    sites, first = defaultdict(set), {}
    for r in stages["quality"]:
        for line in (r.text or "").split("\n"):
            sites[line].add(r.source)
            first[line] = min(first.get(line, r.doc_id), r.doc_id)
    gone = {x for x, on in sites.items() if x.strip(" ") and len(on - {None}) >= 10}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x not in gone or first[x] == r.doc_id) for r in stages["quality"]}
    assert texts(stages["lines"]) == want
    assert all(r.n_chars == len(r.text) for r in stages["lines"])


def test_one_document_of_each_group_stays(stages):
    sets = {}
    for i, text in texts(stages["lines"]).items():
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    before = texts(stages["lines"])
    assert texts(stages["near_duplicates"]) == {i: before[i] for i in sets if root(i) == i}
    assert len(stages["near_duplicates"]) < len(stages["lines"])


def test_addresses_are_replaced_one_for_one(stages):
    before, after = texts(stages["near_duplicates"]), texts(stages["personal_data"])
    assert set(before) == set(after) and all(r.n_chars == len(r.text) for r in stages["personal_data"])
    new = defaultdict(set)
    for i, text in before.items():
        old, now = MAIL.findall(text), MAIL.findall(after[i])
        assert len(old) == len(now)
        for a, b in zip(old, now, strict=True):
            new[a.lower()].add(b.lower())
    assert new and all(len(x) == 1 for x in new.values())
    given = [next(iter(x)) for x in new.values()]
    assert len(set(given)) == len(given) and not set(given) & set(new)
    # What holds no digit, sign of an address or capital within a sentence is clean and stays as it was.
    clean = [i for i, text in before.items() if not re.search(r"[0-9@]|[^.!?\n]\s+[A-Z]", text)]
    assert all(after[i] == before[i] for i in clean)


def test_every_token_is_packed_once(stages):
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in stages["packing"]:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    packed = texts(stages["personal_data"])
    assert set(pieces) == set(packed)
    for i, own in pieces.items():
        ids, at = [*tokenizer.encode(packed[i], add_special_tokens=False).ids, 0], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(r.length for r in stages["packing"])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    # No packing needs fewer sequences than its tokens fill, and this one hardly more.
    assert -(-total // 1024) <= len(sequences) <= -(-total // 1024) * 1.05 + 1
