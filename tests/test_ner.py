import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright import sources
from maskwright.operators import ner as N
from maskwright.operators import recognizers as R
from maskwright.operators.analyze import Analyzer
from maskwright.operators.registry import Registry

VOCABULARY = N.read_vocabulary("[PAD]\n[UNK]\n[CLS]\n[SEP]\njohn\nworks\nat\nacme\n##son\nin\nparis\n\nnew\n##york\n".split("\n"))


def test_vocabulary_and_labels(tmp_path):
    assert VOCABULARY["john"] == 4 and VOCABULARY["new"] == 11
    assert N.read_vocabulary(["a", "b", "a"]) == {"a": 2, "b": 1}
    (tmp_path / "config.json").write_text(json.dumps({"id2label": {"10": "C", "2": "B", "0": "A"}}))
    assert N.read_labels(tmp_path / "config.json") == ["A", "B", "C"]
    assert not N.reads_lower_case(tmp_path)
    (tmp_path / "tokenizer_config.json").write_text('{"do_lower_case": true}')
    assert N.reads_lower_case(tmp_path)


def test_tokens():
    cut = lambda text: [(t.text, t.start, t.end) for t in N.tokenize(text, VOCABULARY, True)]
    assert cut("Johnson") == [("john", 0, 4), ("##son", 4, 7)]
    assert cut("éé john")[1] == ("john", 3, 7)
    assert cut("zzzzz") == [("[UNK]", 0, 5)]
    assert [x[0] for x in cut("john, works.")] == ["john", "[UNK]", "works", "[UNK]"]
    assert N.tokenize("zz", {"a": 0})[0].id == 0
    assert cut("") == []


def test_windows():
    x = list(range(1000))
    assert [w[0] for w in N.windows(x, 510, 382)] == [0, 382, 490]
    assert N.windows(x[:100], 510, 382) == [x[:100]]
    assert len(N.windows(x[:20], 10, 0)) >= 2 and len(N.windows(x[:20], 10, 10)) >= 2


def entities(text, labels):
    return [(e.label, e.start, e.end, round(e.score, 3)) for e in N.aggregate(N.tokenize(text, VOCABULARY, True), labels)]


def test_aggregation():
    o = ("O", 0.99)
    assert entities("Johnson works in Paris", [("B-PER", 0.98), ("I-PER", 0.96), o, o, ("B-LOC", 0.9)]) == [("PER", 0, 7, 0.97), ("LOC", 17, 22, 0.9)]
    assert entities("Johnson", [("B-PER", 0.95), o]) == [("PER", 0, 7, 0.95)]
    assert entities("paris", [("I-LOC", 0.9)]) == [("LOC", 0, 5, 0.9)]
    assert entities("john paris", [("B-PER", 0.9), ("I-LOC", 0.8)]) == [("PER", 0, 4, 0.9), ("LOC", 5, 10, 0.8)]
    assert entities("john paris", [("B-PER", 0.9), ("I-PER", 0.7)]) == [("PER", 0, 10, 0.8)]


def test_merging():
    E = N.Entity
    got = N.merge_entities([E("PER", 10, 20, 0.9), E("PER", 10, 20, 0.95), E("LOC", 12, 15, 0.8), E("PER", 5, 12, 0.99)])
    assert [(e.label, e.start, e.score) for e in got] == [("PER", 10, 0.95), ("LOC", 12, 0.8)]


def test_softmax():
    assert N.softmax_label([0.0, 2.0], ["A", "B"])[0] == "B"
    assert N.softmax_label([0.0, 2.0], ["A"])[0] == ""


def test_engine(spark):
    def predict():
        return lambda tokens: [("B-PER", 0.9) if t.text == "john" else ("O", 0.9) for t in tokens]

    engine = N.NerEngine(VOCABULARY, predict, lower=True, size=4, shared=1)
    analyzer = Analyzer(Registry([R.NerRecognizer("en"), R.email("en")]), engine=engine)
    df = sources.from_strings(spark, ["works " * 9 + "Johnson a@b.org", None, ""])
    rows = analyzer.analyze(df).orderBy("id").collect()
    assert [(s.entity_type, s.start, s.end, s.pattern) for s in rows[0].spans][0] == ("PERSON", 54, 61, "ner:PER")
    assert rows[1].spans == [] and rows[2].spans == []
    empty = Analyzer(Registry([R.NerRecognizer("en")]), engine=N.NoEngine()).analyze(df)
    assert empty.where(F.size("spans") > 0).count() == 0
    with pytest.raises(ValueError):
        Analyzer(Registry([]), engine=N.NerEngine({}, predict))


def _field(number, value):
    """A field of a protocol buffer: a number, or bytes."""

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _model(folder, rows, lower=True):
    """A model folder whose logits are a table's rows, looked up by token id."""

    def value(name, kind, *dims):
        shape = b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d)) for d in dims)
        return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))

    rows = np.asarray(rows, np.float32)
    table = _field(1, rows.shape[0]) + _field(1, rows.shape[1]) + _field(2, 1) + _field(8, "table") + _field(9, rows.tobytes())
    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "logits") + _field(4, "Gather")
    inputs = b"".join(_field(11, value(x, 7, "b", "s")) for x in ("input_ids", "attention_mask"))
    graph = _field(1, node) + _field(2, "g") + _field(5, table) + inputs + _field(12, value("logits", 1, "b", "s", rows.shape[1]))
    (folder / "model.onnx").write_bytes(_field(1, 8) + _field(8, _field(2, 13)) + _field(7, graph))
    (folder / "config.json").write_text(json.dumps({"id2label": {"0": "O", "1": "B-PER", "2": "B-LOC"}}))
    (folder / "vocab.txt").write_text("\n".join(VOCABULARY))
    (folder / "tokenizer_config.json").write_text(json.dumps({"do_lower_case": lower}))


def _logits():
    rows = np.zeros((len(VOCABULARY), 3))
    rows[:, 0] = 4.0
    rows[VOCABULARY["john"]] = [0, 5, 0]
    rows[VOCABULARY["paris"]] = [0, 0, 3]
    return rows


def test_onnx_model_on_workers(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    _model(tmp_path, _logits())
    engine = N.onnx_engine(spark, tmp_path, size=6, shared=2, batch=3)
    assert engine.lower and N.ship(spark, tmp_path) == N.ship(spark, tmp_path)
    texts = ["Johnson works in Paris", None, "", "works " * 20 + "john", "paris"]
    rows = engine.process(sources.from_strings(spark, texts)).orderBy("id").collect()
    got = [[(e.label, e.start, e.end, round(e.score, 4)) for e in r.artifacts.ner_entities] for r in rows]
    person, place = round(1 / (1 + 2 * math.exp(-5)), 4), round(1 / (1 + 2 * math.exp(-3)), 4)
    assert got == [[("PER", 0, 7, person), ("LOC", 17, 22, place)], [], [], [("PER", 120, 124, person)], [("LOC", 0, 5, place)]]
    # What is sent away with do_lower_case false knows no capitals.
    other = tmp_path / "cased"
    other.mkdir()
    _model(other, _logits(), lower=False)
    cased = N.onnx_engine(spark, other)
    assert [len(r.artifacts.ner_entities) for r in cased.process(sources.from_strings(spark, ["Paris", "paris"])).orderBy("id").collect()] == [0, 1]


def test_onnx_batches_and_lifecycle(tmp_path):
    pytest.importorskip("onnxruntime")
    _model(tmp_path, _logits())
    calls = []
    many = N.OnnxPredictor(tmp_path, batch=2)
    run = many.session.run
    many.session = type("Session", (), {"run": lambda self, names, given: calls.append(given["input_ids"].shape) or run(names, given)})()
    parts = [N.tokenize(x, VOCABULARY, True) for x in ("john", "in paris", "paris", "at", "john works")]
    assert many.many(parts) == [N.OnnxPredictor(tmp_path)(x) for x in parts]
    assert sorted(calls) == [(1, 3), (2, 3), (2, 4)] and many.many([]) == []
    N.unload_models()
    make = N.onnx_predict(tmp_path, batch=1)
    assert make() is make() and N.unload_models() == 1 and N.unload_models() == 0
    assert make()(parts[0])[0][0] == "B-PER" and N.unload_models() == 1
    with pytest.raises(FileNotFoundError):
        N.OnnxPredictor(tmp_path / "none")


def test_mapping():
    assert R.NerRecognizer().entities == ("PERSON", "LOCATION", "ORGANIZATION", "NRP")
    assert R.NerRecognizer(labels=(("X", "THING"),)).entities == ("THING",)
