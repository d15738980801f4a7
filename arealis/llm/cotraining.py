"""Quality classifier by co-training two views.

The *text view* sees the content alone (which characters and words there are and how they repeat); the *metadata view* sees
what surrounds it (source, language, length and how it is laid out in lines). Each has a logistic model of its own.

* Start: both are fitted to the labelled documents (at most ``MAX_LABELLED`` of them, chosen by a hash of the id; a fifth
  is kept aside for calibration).
* Round: each view scores every unlabelled document; those it is confident of (probability beyond ``CONFIDENT`` after
  calibration) are pseudo-labelled **for the other view**, which is then fitted again to the labels and at most ``MAX_PSEUDO``
  pseudo-labels of each class, the lowest by hash among all confident documents of the corpus.
* End: each view's scores are calibrated on the labels kept aside (Platt scaling); the calibrated views are combined by adding
  their evidence, and all documents are scored.

Features are computed once, in one pass over the whole texts, and stored; a round reads only them. What reaches the driver is
bounded by the parameters above whatever the size of the corpus; scores cover all documents.

Defined cases: a null text is empty; a null source or language is a value of its own; labels of unknown documents
don't count, of repeated labels the mean decides (above one half is 1); without labels of both classes every score is the
share of positive labels (0.5 without any). Repeated rows and null ids are scored each for itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_be_among, stash

MAX_LABELLED = 20_000
MAX_PSEUDO = 2_000
ROUNDS = 3
CONFIDENT = 0.95
SOURCES, LANGS = 32, 8  # hashed columns

_PUNCTUATION = np.array([c for c in range(0x21, 0x7F) if not chr(c).isalnum()])
TEXT_WIDTH = len(_PUNCTUATION) + 12
META_WIDTH = SOURCES + LANGS + 14 + 6


def text_features(text: bytes) -> np.ndarray:
    """The content view of a UTF-8 text."""
    out = np.zeros(TEXT_WIDTH, np.float32)
    if not text:
        return out
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
    words = text.split()
    many = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    total = max(len(words), 1)
    k = len(_PUNCTUATION)
    out[:k] = np.sqrt(n[_PUNCTUATION]) * 3
    out[k:] = (
        n[65:91].sum() * 3, n[97:123].sum(), n[48:58].sum() * 3, n[[32, 9, 10, 11, 12, 13]].sum() * 2, n[128:].sum(),
        np.log1p(len(words)) / 5, len(text) / total / 10 if total else 0, len(many) / total, max(many.values(), default=0) / total,
        pairs / total, sum(w[-1:] in b"!?%#*$&" for w in words) / total, sum(len(w) == 1 for w in words) / total)
    return np.minimum(out, 5)


def meta_features(text: bytes, source: str | None, lang: str | None) -> np.ndarray:
    """The metadata view: source, language, length class and layout."""
    out = np.zeros(META_WIDTH, np.float32)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[SOURCES + LANGS + min(len(text).bit_length() // 2, 13)] = 1
    lines = text.split(b"\n") if text else []
    full = [x for x in lines if x.strip()]
    sizes = np.array([len(x) for x in full] or [0])
    out[-6:] = (np.log1p(len(lines)) / 4, len(full) / max(len(lines), 1), 1 - len(set(full)) / max(len(full), 1),
                np.log1p(sizes.mean()) / 6, np.log1p(sizes.std()) / 6, np.log1p(len(text)) / 10)
    return out


def features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``doc_id, k`` (a hash of the id), ``a`` and ``b``: the two views as packed 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                p = b.slice(at, 500)
                rows = list(zip(p.column(2).cast(pa.binary()).to_pylist(), p.column(3).to_pylist(), p.column(4).to_pylist(), strict=True))
                views = [[text_features(t or b"").tobytes() for t, _, _ in rows], [meta_features(t or b"", s, x).tobytes() for t, s, x in rows]]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), *(pa.array(v, pa.binary()) for v in views)], ["doc_id", "k", "a", "b"])

    kind = docs.schema[doc_id].dataType.simpleString()
    cols = [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id).cast("string")).alias("k"), F.col(text), F.col(source).cast("string"), F.col(lang).cast("string")]
    return docs.select(*cols).mapInArrow(run, f"doc_id {kind}, k bigint, a binary, b binary")


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.float32).reshape(-1, width)
    return np.hstack([x.astype(float), np.ones((len(x), 1))])


@dataclass
class View:
    """A logistic model of one view and its calibration."""

    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, packed: list[bytes]) -> np.ndarray:
        raw = _matrix(packed, len(self.weights) - 1) @ self.weights
        return np.clip(self.scale * raw + self.shift, -30, 30)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit(packed: list[bytes], y: np.ndarray, weight: np.ndarray, kept: list[bytes], kept_y: np.ndarray) -> View:
    """Weights from the training rows, calibration from the rows kept aside."""
    width = len(packed[0]) // 4
    view = View(_logistic(_matrix(packed, width), y, weight, 1.0))
    if len(set(kept_y.tolist())) == 2:
        raw = view.logits(kept)
        view.scale, view.shift = _logistic(np.column_stack([raw, np.ones(len(raw))]), kept_y, np.ones(len(raw)), 1e-2)
        view.scale = max(view.scale, 1e-3)
    return view


@dataclass
class CoTrained:
    """Both views; ``prior`` is the logit of the share of positive labels, ``None`` for views if there was nothing to learn."""

    text: View | None
    meta: View | None
    prior: float

    def logits(self, a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or not a:
            same = np.full(len(a), self.prior)
            return same, same, same
        x, y = self.text.logits(a), self.meta.logits(b)
        return x, y, x + y - self.prior  # the views' evidence beyond the prior adds up


def _pseudo(feats: DataFrame, model: CoTrained, labelled: np.ndarray, most: int, confident: float) -> list:
    """(view, label, features for the other view): the lowest by hash of what each view is confident of."""
    known = feats.sparkSession.sparkContext.broadcast((model, np.sort(labelled)))
    bar = float(np.log(confident / (1 - confident)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = known.value
        for batch in batches:
            k, a, b = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            x, y, _ = m.logits(a, b)
            free = ~np.isin(k, seen)
            view, label, key, other = [], [], [], []
            for name, score, given in (("text", x, b), ("meta", y, a)):
                for i in np.flatnonzero(free & (np.abs(score) >= bar)).tolist():
                    view.append(name), label.append(int(score[i] > 0)), key.append(int(k[i])), other.append(given[i])
            yield pa.RecordBatch.from_arrays([pa.array(view, pa.string()), pa.array(label, pa.int32()), pa.array(key, pa.int64()), pa.array(other, pa.binary())],
                                             ["view", "label", "k", "x"])

    found = feats.filter("doc_id is not null").select("k", "a", "b").mapInArrow(run, "view string, label int, k bigint, x binary")
    # how many there are says below which hash half as many again as wanted lie; only those are fetched
    many = found.groupBy("view", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    low = F.lit(False)
    for g in many:
        bound = -(1 << 63) + int((1 << 64) * min(1.0, 1.5 * most / g["n"])) - 1
        low = low | ((F.col("view") == g["view"]) & (F.col("label") == g["label"]) & (F.col("k") <= bound))
    by: dict[tuple, list] = {}
    for r in sorted(found.filter(low).collect(), key=lambda r: (r["k"], bytes(r["x"]))):
        by.setdefault((r["view"], r["label"]), []).append(r)
    return [r for own in by.values() for r in own[:most]]


def train(feats: DataFrame, labels: DataFrame, *, label: str = "quality", rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED,
          max_pseudo: int = MAX_PSEUDO, confident: float = CONFIDENT) -> CoTrained:
    """Co-train both views. ``feats``: a stored table of ``features``; ``labels``: (doc_id, label)."""
    given = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) > 0.5).cast("int").alias("y"))
    picked = given.withColumn("k", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("k", "doc_id").limit(max_labelled)
    near = may_be_among(feats, F.col("k"), picked.select("k"), "k")
    rows = near.join(picked.select("doc_id", "y"), "doc_id").select("k", "a", "b", "y").orderBy("k").limit(2 * max_labelled).collect()
    y = np.array([r["y"] for r in rows], float)
    share = y.mean() if len(y) else 0.5
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(set(y.tolist())) < 2:
        return CoTrained(None, None, prior)
    k = np.array([r["k"] for r in rows])
    aside = k % 5 == 0
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)  # too few labels to keep any aside
    a, b = ([bytes(r[c]) for r in rows] for c in "ab")
    pick = lambda v, m: [x for x, z in zip(v, m, strict=True) if z]
    extra: dict[str, list] = {"text": [], "meta": []}  # pseudo-labels by the view that gave them

    def fitted(own: list[bytes], teacher: str) -> View:
        more = extra[teacher]
        x = pick(own, ~aside) + [bytes(r["x"]) for r in more]
        t = np.concatenate([y[~aside], [float(r["label"]) for r in more]])
        # pseudo-labels together weigh no more than the labels
        w = np.concatenate([np.ones((~aside).sum()), np.full(len(more), min(1.0, (~aside).sum() / max(len(more), 1)))])
        return _fit(x, t, w, pick(own, aside), y[aside])

    model = CoTrained(fitted(a, "meta"), fitted(b, "text"), prior)
    for _ in range(rounds):
        found = _pseudo(feats, model, k, max_pseudo, confident)
        extra = {v: [r for r in found if r["view"] == v] for v in extra}
        model = CoTrained(fitted(a, "meta"), fitted(b, "text"), prior)
    return model


def score(feats: DataFrame, model: CoTrained) -> DataFrame:
    """``doc_id, p_text, p_meta, score, label`` of every document."""
    known = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in known.value.logits(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in p), pa.array((p[2] >= 0.5).astype(np.int32))],
                                             ["doc_id", "p_text", "p_meta", "score", "label"])

    kind = feats.schema["doc_id"].dataType.simpleString()
    return feats.mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double, label int")


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", **options) -> DataFrame:  # noqa: ANN003
    """Train on ``labels`` and score every document."""
    feats = stash(features(docs), "views")
    return score(feats, train(feats, labels, label=label, **options))
