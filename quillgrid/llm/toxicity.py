"""Toxic spans and document scores by a linear-chain conditional random field.

Training, on a bounded sample of labelled documents: a token of a toxic document is labelled toxic if
its word or one of its beginnings is in toxic documents far oftener than in clean ones (likelihood
ratio); the field with states clean and toxic, features of words and weights between states is fitted to
these labels by its gradient, over all sentences with a labelled token and some SENTENCES others, drawn with a fixed seed; weights
up to LEAST_WEIGHT are left out of the model. Forward-backward gives each token's probability; a document's
score is logistic in its largest probability and in the sum of squares.

Scoring: every token of every whole text, in chains that end with a sentence or after CHAIN tokens. Labels,
language, source and doc_id are no inputs. Null text counts as empty and scores as a text without
toxic tokens. Rows with one doc_id are scored each. Without labels of both kinds all scores are 0.
"""

from __future__ import annotations

import math
import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import give_back, keep_only, key_and_text, texts, whole_text
from quillgrid.llm.fingerprints import mix
from quillgrid.llm.wordbpe import runs
from quillgrid.operators.training import budget_prefix

#: The bound of the sample: documents of each label, and characters of each label's whole texts; the first document beyond is the last one taken.
TOXIC_DOCS, CLEAN_DOCS, SAMPLE_CHARS = 1000, 2000, 64_000_000
#: Sentences without a labelled token that the fit takes, its steps, the longest chain, and the least likelihood ratio of a labelling feature.
SENTENCES, STEPS, CHAIN, LEAST_RATIO = 40_000, 60, 128, 20.0
LEAST_WEIGHT = 0.02
EDGE = re.compile(r"^\W+|\W+$")
BEGINNINGS = (4, 5, 6)


def word_of(run: str) -> str:
    return EDGE.sub("", run.lower())


def features(word: str) -> list[str]:
    return [f"w={word}", *(f"{n}={word[:n]}" for n in BEGINNINGS if len(word) > n)]


def chains(ends: np.ndarray, most: int = CHAIN) -> np.ndarray:
    """First index of each chain; ends: whether a token closes a sentence or text."""
    if not len(ends):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    since = np.arange(len(ends)) - np.repeat(new, np.diff(np.append(new, len(ends))))
    return np.flatnonzero(since % most == 0)


def _softplus(a: float, b: float, x: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b + x)


def marginals(score: np.ndarray, starts: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, tuple]:
    """Logit of each token's toxic probability; score: its toxic weight less the clean one. trans[a, b]: from a to b."""
    lengths = np.diff(np.append(starts, len(score)))
    order = np.argsort(-lengths, kind="stable")
    first, length = starts[order], lengths[order]
    forward, backward = np.empty_like(score), np.zeros_like(score)
    active = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")  # chains longer than t
    r = None
    for t, n in enumerate(active.tolist()):
        at = first[:n] + t
        r = score[at] + (start if t == 0 else _softplus(trans[0, 1], trans[1, 1], r[:n]) - _softplus(trans[0, 0], trans[1, 0], r[:n]))
        forward[at] = r
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        x = score[at + 1] + backward[at + 1]
        backward[at] = _softplus(trans[1, 0], trans[1, 1], x) - _softplus(trans[0, 0], trans[0, 1], x)
    return forward + backward, (forward, backward)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    document: tuple[float, float, float] = (-100.0, 0.0, 0.0)


def contexts(flat: np.ndarray, n: int) -> np.ndarray:
    """In how many different surroundings each of n runs occurs; copies of a text add nothing. Run 0 parts texts."""
    around = mix(mix(flat[:-2].astype(np.uint64), 1) ^ flat[1:-1].astype(np.uint64), 2) ^ mix(flat[2:].astype(np.uint64), 3)
    _, first = np.unique(around, return_index=True)
    return np.bincount(flat[1:-1][first], minlength=n)


def weak_features(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Features in far more surroundings of toxic documents (a, of n tokens) than of clean ones (b, of m), by likelihood ratio."""
    p = (a + b) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (a * np.log(a / n / p) + np.where(b > 0, b * np.log(b / m / p), 0))
    return (a / n > 8 * b / m) & (ratio > LEAST_RATIO)


def fit(toxic: list[str], clean: list[str], seed: int = 7) -> Model:
    toxic, clean = list(dict.fromkeys(toxic)), list(dict.fromkeys(clean))
    if not toxic or not clean:
        return Model()
    # Runs as numbers; 0 stands between texts.
    known: dict[str, int] = {"": 0}
    parts = [np.asarray([0, *(known.setdefault(r, len(known)) for r in runs(t) if r)], np.int32) for t in [*toxic, *clean]]
    sizes = np.asarray([len(x) for x in parts])
    flat = np.append(np.concatenate(parts), np.int32(0))
    del parts
    edge = int(sizes[: len(toxic)].sum())
    # Feature numbers of each run; 0 is none.
    index, width = {"": 0}, 1 + len(BEGINNINGS)
    of_run = np.zeros((len(known), width), np.int32)
    closes = np.zeros(len(known), dtype=bool)
    for r, k in known.items():
        if k:
            got = [index.setdefault(f, len(index)) for f in features(word_of(r))]
            of_run[k, : len(got)] = got
            closes[k] = r[-1] in ".!?"
    seen = [np.bincount(of_run.ravel(), weights=np.repeat(contexts(x, len(known)), width), minlength=len(index)) for x in (flat[: edge + 1], flat[edge:])]
    weak = weak_features(*seen, max(1, edge), max(1, len(flat) - edge))
    weak[0] = False
    # Sentences: all with a labelled token, and others up to a bound.
    token = np.flatnonzero(flat)
    ends = closes[flat[token]] | (flat[token + 1] == 0)
    mark = weak[of_run[flat[token]]].any(axis=1) & (token < edge)
    starts = chains(ends)
    lengths = np.diff(np.append(starts, len(token)))
    some = np.add.reduceat(mark, starts) > 0 if len(starts) else np.zeros(0, dtype=bool)
    use = some | (np.random.default_rng(seed).random(len(starts)) < min(1.0, SENTENCES / max(1, len(starts))))
    picked = np.repeat(use, lengths)
    feats = of_run[flat[token[picked]]].astype(np.int64)
    labels, lengths = mark[picked], lengths[use]
    if not len(labels):
        return Model()
    y = np.asarray(labels, dtype=float)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    inner = np.ones(len(y), dtype=bool)
    inner[starts] = False
    here = np.flatnonzero(inner)  # tokens with one before them in the chain
    w, bias, trans, start = np.zeros(len(index)), math.log((y.mean() + 1e-4) / (1 - y.mean())), np.zeros((2, 2)), 0.0
    sums = [np.full(len(index), 1e-8), 1e-8, np.full((2, 2), 1e-8), 1e-8]
    edges = np.asarray([[(y[here - 1] == a)[y[here] == b].sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    for _ in range(STEPS):
        w[0] = 0
        score = w[feats].sum(axis=1) + bias
        logit, (forward, backward) = marginals(score, starts, trans, start)
        gap = y - sigmoid(logit)
        left, right = forward[here - 1], score[here] + backward[here]
        joint = np.stack([trans[a, b] + a * left + b * right for a in (0, 1) for b in (0, 1)])
        joint = np.exp(joint - joint.max(axis=0))
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grads = [np.bincount(feats.ravel(), weights=np.repeat(gap, width), minlength=len(index)) - 0.05 * w, gap.sum(), edges - expected - 0.5 * trans, gap[starts].sum() - 0.5 * start]
        steps = []
        for k, g in enumerate(grads):
            sums[k] = sums[k] + g * g
            steps.append(0.5 * g / np.sqrt(sums[k]))
        w, bias, trans, start = w + steps[0], bias + steps[1], trans + steps[2], start + steps[3]
    names = list(index)
    kept = {names[k]: float(w[k]) for k in np.flatnonzero(np.abs(w) > LEAST_WEIGHT) if k}
    model = Model(kept, float(bias), trans, float(start))
    # Document scores: logistic regression on what the marginals of the sample's documents give.
    memory, every = Scores(model), [*toxic, *clean]
    x = np.asarray([summary(p) for lo in range(0, len(every), 128) for p, _ in document_marginals(every[lo : lo + 128], memory, model)])
    target = np.arange(len(x)) < len(toxic)
    coef = np.zeros(3)
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = sigmoid(design @ coef)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(3)
        coef = coef + np.linalg.solve(hess, design.T @ (target - p) - 0.05 * coef)
    model.document = tuple(coef.tolist())
    return model


class Scores(dict):
    """Run between blanks -> its weight as a float32 and whether it ends a sentence, as eight bytes."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, run: str) -> bytes:
        get = self.model.weights.get
        score = self.model.bias + sum(get(f, 0.0) for f in features(word_of(run)))
        made = np.asarray([score, float(run[-1:] in (".", "!", "?"))], dtype="<f4").tobytes()
        if len(self) > 600_000:
            self.clear()
        if len(run) <= 64:
            self[run] = made
        return made


def document_marginals(texts: list[str], scores: Scores, model: Model) -> list[tuple[np.ndarray, list[str]]]:
    """Each text's token probabilities and its runs (an empty run between two blanks is a token, too)."""
    split = [runs(t) for t in texts]
    counts = [len(s) for s in split]
    flat = np.frombuffer(b"".join(scores[r] for s in split for r in s), dtype="<f4").reshape(-1, 2)
    ends = flat[:, 1] > 0
    last = np.cumsum(counts)
    ends[last - 1] = True
    logit, _ = marginals(flat[:, 0].astype(float), chains(ends), model.trans, model.start)
    return list(zip(np.split(sigmoid(logit), last[:-1]), split, strict=True))


def summary(p: np.ndarray) -> tuple[float, float]:
    return float(np.log1p((p * p).sum())), float(p.max(initial=0.0))


def spans(p: np.ndarray, split: list[str], least: float = 0.5) -> list[dict]:
    """Offsets of neighbouring tokens with at least that probability, without the marks around their words."""
    if not (p >= least).any():
        return []
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in split])[:-1]])
    found: list[dict] = []
    for k in np.flatnonzero(p >= least).tolist():
        word = EDGE.sub("", split[k])
        at = int(begin[k]) + (split[k].find(word) if word else 0)
        if found and found[-1]["last"] == k - 1:
            found[-1] |= {"end": at + len(word), "last": k, "p": max(found[-1]["p"], float(p[k]))}
        else:
            found.append({"begin": at, "end": at + len(word), "p": float(p[k]), "last": k})
    return [{n: s[n] for n in ("begin", "end", "p")} for s in found]


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document are for measuring only; false for a null doc_id, which no label has."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """toxic, h and whole text of at most TOXIC_DOCS toxic and CLEAN_DOCS clean documents of the training folds, by the order of a hash of doc_id, and of each kind only until most_chars are passed.

    The bound on characters holds for rows that share a doc_id, too, however many there are.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))]
    # The picked ids are a few thousand at any size, so they may be broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text()).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    ordered = rows.select("toxic", F.xxhash64("doc_id").alias("h"), "text", F.xxhash64("text").alias("t"))
    return budget_prefix(ordered, ["toxic"], ["h", "t"], F.char_length("text").cast("long"), most_chars).select("toxic", "h", "text")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample, fitted in one task; the driver gets its weights only."""

    def run(batches):
        keep_only(None)
        rows = sorted((r["h"], r["text"], r["toxic"]) for batch in batches for r in batch.to_pylist())
        model = fit([t for _, t, k in rows if k == 1], [t for _, t, k in rows if k == 0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        give_back()

    fitted = sample(docs, labels).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else Model()


KINDS = "doc_id long, score double, predicted int, spans array<struct<begin: int, end: int, p: double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the offending spans of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = _scores(shared)
        a, b, c = shared.value.document
        for batch in batches:
            ids, held = batch.column(0), texts(batch)
            for lo in range(0, len(held), 128):
                got = document_marginals(held[lo : lo + 128], scores, shared.value)
                made = [summary(p) for p, _ in got]
                s = [float(sigmoid(a + b * x + c * m)) for x, m in made]
                kinds = [pa.float64(), pa.int32(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))]
                values = [s, [int(x >= 0.5) for x in s], [spans(p, r) for p, r in got]]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 128), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], ["doc_id", "score", "predicted", "spans"])

    return key_and_text(docs).mapInArrow(run, KINDS)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that score under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        scores = _scores(shared)
        a, b, c = shared.value.document
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                got = document_marginals([t or "" for t in texts(part)], scores, shared.value)
                clean = [a + b * x + c * m < 0 for x, m in (summary(p) for p, _ in got)]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, kinds)


_held: dict = {}


def _scores(shared) -> Scores:
    """The worker's memory of runs, for one model at a time."""
    if _held.get("of") is not shared.value:
        _held.update(of=shared.value, scores=Scores(shared.value))
    keep_only(_held["scores"])
    return _held["scores"]
