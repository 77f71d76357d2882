"""Named entities from a token-classification model: tokens, windows, labels to entities, merging.

The model itself is a parameter, a function from windows of token ids to labels with scores; one for ONNX files
is loaded only when asked for. Text goes through Arrow batches, with the model loaded once for each worker.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
import unicodedata
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = "array<struct<label:string,start:int,end:int,score:double>>"
ARTIFACTS = f"struct<tokens:array<string>,lemmas:array<string>,ner_entities:{ENTITIES}>"
#: Tokens of a window, without the two that frame it, and tokens that neighbours share.
WINDOW, SHARED = 254, 64


@dataclass(frozen=True)
class Token:
    text: str
    id: int
    start: int
    end: int


@dataclass(frozen=True)
class Entity:
    label: str
    start: int
    end: int
    score: float


def read_vocabulary(lines: Iterable[str]) -> dict[str, int]:
    """One token a line; empty lines take no number, and a repeated token gets a later one."""
    out: dict[str, int] = {}
    for line in lines:
        token = line.strip()
        if token:
            out[token] = len(out)
    return out


def read_labels(path: str | Path) -> list[str]:
    """The labels of a model's config.json in the order of their numbers."""
    names = json.loads(Path(path).read_text(encoding="utf-8"))["id2label"]
    return [names[k] for k in sorted(names, key=int)]


def reads_lower_case(folder: str | Path) -> bool:
    """do_lower_case of tokenizer_config.json; false if it cannot be read."""
    try:
        return bool(json.loads((Path(folder) / "tokenizer_config.json").read_text(encoding="utf-8")).get("do_lower_case", False))
    except (OSError, ValueError, AttributeError):
        return False


def split_words(text: str) -> list[tuple[str, int]]:
    """Words with their places: cut at white space, every punctuation mark and symbol a word of its own."""
    out: list[tuple[str, int]] = []
    start = -1
    for i, c in enumerate(text):
        single = unicodedata.category(c)[0] in "PS"
        if c.isspace() or single:
            if start >= 0:
                out.append((text[start:i], start))
                start = -1
            if single:
                out.append((c, i))
        elif start < 0:
            start = i
    if start >= 0:
        out.append((text[start:], start))
    return out


def _lower(text: str) -> str:
    """Lower case, one character for each, so that places stay."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def tokenize(text: str, vocabulary: dict[str, int], lower: bool = False) -> list[Token]:
    """Longest known pieces from the left, later ones marked ##; a word that has none becomes one unknown token."""
    unknown, out = vocabulary.get("[UNK]", 0), []
    for word, place in split_words(text):
        form, pieces, at = _lower(word) if lower else word, [], 0
        while at < len(form):
            end = next((e for e in range(len(form), at, -1) if ("##" if at else "") + form[at:e] in vocabulary), 0)
            if not end:
                pieces = [Token("[UNK]", unknown, place, place + len(form))]
                break
            piece = ("##" if at else "") + form[at:end]
            pieces.append(Token(piece, vocabulary[piece], place + at, place + end))
            at = end
        out += pieces
    return out


def windows(tokens: Sequence, size: int, stride: int) -> list[Sequence]:
    """Overlapping windows; the last is moved back to end with the tokens. A stride that cannot advance becomes half the size."""
    if len(tokens) <= size:
        return [tokens]
    step = stride if 0 < stride < size else max(size // 2, 1)
    out, at = [], 0
    while at + size < len(tokens):
        out.append(tokens[at : at + size])
        at += step
    return [*out, tokens[len(tokens) - size :]]


def aggregate(tokens: Sequence[Token], labels: Sequence[tuple[str, float]]) -> list[Entity]:
    """Entities of B- and I- labels; a word's later pieces always join its entity, scores are means of what was labelled."""
    out: list[Entity] = []
    label, start, end, scores = "", 0, 0, []

    def close() -> None:
        if label:
            out.append(Entity(label, start, end, sum(scores) / len(scores)))

    for token, (tag, score) in zip(tokens, labels, strict=False):
        kind, name = (tag[0], tag[2:]) if tag[:2] in ("B-", "I-") else ("O", "")
        if label and token.text.startswith("##") and token.start == end:
            end = token.end
            if kind == "I" and name == label:
                scores.append(score)
        elif kind == "I" and name == label:
            end = token.end
            scores.append(score)
        else:
            close()
            label, start, end, scores = name, token.start, token.end, [score]
    close()
    return out


def merge_entities(entities: Sequence[Entity]) -> list[Entity]:
    """Of overlapping entities of one label the longest, then the surest; by start."""
    kept: list[Entity] = []
    for e in sorted(entities, key=lambda e: (e.start - e.end, -e.score)):
        if not any(k.label == e.label and e.start < k.end and k.start < e.end for k in kept):
            kept.append(e)
    return sorted(kept, key=lambda e: e.start)


Predict = Callable[[Sequence[Token]], Sequence[tuple[str, float]]]


class NoEngine:
    """Adds artifacts that hold nothing."""

    def load(self) -> None:
        return None

    def process(self, df: DataFrame, text: str = "text") -> DataFrame:
        none = F.struct(F.array().cast("array<string>").alias("tokens"), F.array().cast("array<string>").alias("lemmas"), F.array().cast(ENTITIES).alias("ner_entities"))
        return df.withColumn("artifacts", none)


@dataclass
class NerEngine:
    """Adds artifacts by a model. make_predict is called once for each worker and returns the model's function."""

    vocabulary: dict[str, int]
    make_predict: Callable[[], Predict]
    lower: bool = False
    size: int = WINDOW
    shared: int = SHARED

    def load(self) -> None:
        if not self.vocabulary:
            raise ValueError("the vocabulary is empty")

    def artifacts(self, texts: Iterable[str | None], predict: Predict) -> list[dict]:
        """One row for each text; the windows of all of them go to the model together if it takes many."""
        tokens = [tokenize(x or "", self.vocabulary, self.lower) for x in texts]
        cut = [windows(x, self.size, self.size - self.shared) if x else [] for x in tokens]
        flat = [part for parts in cut for part in parts]
        many = getattr(predict, "many", None)
        labels = iter(many(flat) if many else map(predict, flat))
        found = [[e for part in parts for e in aggregate(part, next(labels))] for parts in cut]
        return [{"tokens": [t.text for t in x], "lemmas": [], "ner_entities": [e.__dict__ for e in merge_entities(y)]} for x, y in zip(tokens, found, strict=True)]

    def process(self, df: DataFrame, text: str = "text") -> DataFrame:
        engine = self

        @F.pandas_udf(ARTIFACTS)
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            predict = engine.make_predict()
            for batch in batches:
                yield pd.DataFrame(engine.artifacts(batch, predict), columns=["tokens", "lemmas", "ner_entities"])

        return df.withColumn("artifacts", found(F.col(text)))


#: A model folder's files; of the first two the first that is there.
MODELS, OTHERS = ("model_quantized.onnx", "model.onnx"), ("config.json", "vocab.txt", "tokenizer_config.json")


class OnnxPredictor:
    """A model folder's predictor: the quantized file if there is one; labels and vocabulary beside it.

    Windows of one length go to the model together, up to batch at a time, so that none is padded. A quantized
    model may take its ranges from all that it is given at once: batch=1 gives it one window a call.
    """

    def __init__(self, folder: str | Path, batch: int = 16, providers: Sequence[str] = ("CPUExecutionProvider",), threads: int = 1) -> None:
        import onnxruntime

        path = next((p for name in MODELS if (p := Path(folder) / name).exists()), None)
        if path is None:
            raise FileNotFoundError(f"{folder} has none of {', '.join(MODELS)}")
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = threads
        self.session = onnxruntime.InferenceSession(str(path), options, providers=list(providers))
        self.names = {x.name for x in self.session.get_inputs()}
        self.labels, self.batch = read_labels(Path(folder) / "config.json"), batch
        vocabulary = read_vocabulary((Path(folder) / "vocab.txt").read_text(encoding="utf-8").splitlines())
        self.frame = vocabulary.get("[CLS]", 0), vocabulary.get("[SEP]", 0)

    def __call__(self, tokens: Sequence[Token]) -> list[tuple[str, float]]:
        return self.many([tokens])[0]

    def many(self, parts: Sequence[Sequence[Token]]) -> list[list[tuple[str, float]]]:
        import numpy as np

        out: list[list[tuple[str, float]]] = [[] for _ in parts]
        by_length: dict[int, list[int]] = {}
        for i, part in enumerate(parts):
            by_length.setdefault(len(part), []).append(i)
        for same in by_length.values():
            for at in range(0, len(same), self.batch):
                chosen = same[at : at + self.batch]
                ids = np.array([[self.frame[0], *(t.id for t in parts[i]), self.frame[1]] for i in chosen], np.int64)
                given = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
                for i, rows in zip(chosen, self.session.run(None, {k: v for k, v in given.items() if k in self.names})[0], strict=True):
                    out[i] = [softmax_label(row, self.labels) for row in rows[1:-1]]
        return out


#: Models of this process by folder and options: a worker loads one once, however many tasks it runs.
_LOADED: dict[tuple, OnnxPredictor] = {}


def onnx_predict(folder: str | Path, shipped: bool = False, **options) -> Callable[[], Predict]:
    """make_predict for a folder: a path that each worker has, or the name under which ship() sent it."""
    key = (str(folder), shipped, *sorted(options.items()))

    def make() -> Predict:
        if key not in _LOADED:
            _LOADED[key] = OnnxPredictor(SparkFiles.get(str(folder)) if shipped else folder, **options)
        return _LOADED[key]

    return make


def unload_models() -> int:
    """Let go of this process's models and return how many there were; they are loaded again when next asked for."""
    n = len(_LOADED)
    _LOADED.clear()
    return n


def ship(spark: SparkSession, folder: str | Path) -> str:
    """Send a model folder of the driver to all workers, and return the name that it has there.

    The name is a digest of the files, so that a folder is sent once and two models do not meet.
    """
    files = [p for name in (next((x for x in MODELS if (Path(folder) / x).exists()), MODELS[-1]), *OTHERS) if (p := Path(folder) / name).exists()]
    digest = hashlib.sha256()
    for p in files:
        digest.update(f"{p.name} {p.stat().st_size}\n".encode())
        with p.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    name = f"maskwright-model-{digest.hexdigest()[:32]}"
    context = spark.sparkContext
    if not any(x.endswith(f"#{name}") for x in context.listArchives):
        # The driver serves the file from here until the session ends.
        served = tempfile.mkdtemp(prefix="maskwright-model-")
        atexit.register(shutil.rmtree, served, ignore_errors=True)
        path = os.path.join(served, f"{name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in files:
                z.write(p, p.name)
        context.addArchive(f"{path}#{name}")
    return name


def onnx_engine(spark: SparkSession, folder: str | Path, size: int = WINDOW, shared: int = SHARED, **options) -> NerEngine:
    """The engine of a model folder that only the driver has: files sent to workers, do_lower_case as the folder says."""
    vocabulary = read_vocabulary((Path(folder) / "vocab.txt").read_text(encoding="utf-8").splitlines())
    return NerEngine(vocabulary, onnx_predict(ship(spark, folder), shipped=True, **options), reads_lower_case(folder), size, shared)


def softmax_label(row: Sequence[float], labels: Sequence[str]) -> tuple[str, float]:
    """The likeliest label and its share; a number without a label gives an empty one."""
    import numpy as np

    row = np.asarray(row, float)
    best = int(row.argmax())
    return (labels[best] if best < len(labels) else ""), float(1.0 / np.exp(row - row[best]).sum())
