"""Subject areas of documents: complement naive Bayes, refined by EM, with calibrated posteriors.

Words are the parts of names, comments and literals in any script (camel case and underscores split, at
least three letters, two in scripts without case), hashed into a fixed number of slots, so that the model has a bound whatever the
corpus. The evidence of a word for a subject is its probability in the subject against that in the
complement of the subject (all other subjects and the background). Training starts from labelled
documents on the driver (a bounded sample); EM over all documents then re-estimates the counts:
each word occurrence of a document is shared among subjects and background by evidence and by the
document's current mixture. Every pass reads all documents and sends to the driver at most
``SLOTS`` rows of sums.

A document's words per subject, as shares, are calibrated against the labels by a logistic
posterior per subject; subjects are judged independently, at most ``most`` come out.

Null or empty texts and texts without subject words get no subject. Labels of unknown subjects
or of missing documents are ignored; labels by several people weigh by their number. Copies of a
document are judged alike. Without any usable label, or with labels of one subject only (nothing
to tell it from), no subject is given.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.leakage import BLOCK_BYTES, item_blocks
from lodestrata.session import share, ship, stored

SLOTS = 1 << 18
#: Most labelled documents the first model and the calibration are fitted on.
LABELLED = 20_000
#: Smoothing count of words, and of a document's mixture.
ALPHA, PRIOR = 0.05, 0.5
#: Evidence that a word needs to count for a subject as much as for the background.
BACKGROUND = 4.0
#: What of a foreign text is left out: so many words in a row, or the whole with such a share altered.
RUN, ALTERED = 10, 0.25

#: Most subjects: the word sums are SLOTS times as many numbers, on the driver and in every worker.
SUBJECTS = 1000

_PART = re.compile(r"[A-Z]{3,}(?![a-z])|[A-Z]?[a-z]{2,}[a-z]*")
#: The same for texts beyond ASCII.
_WIDE_PART = regex.compile(r"\p{Lu}{3,}(?!\p{Ll})|\p{Lu}?[\p{Ll}\p{M}]{2,}|[\p{Lo}\p{Lm}\p{M}]{2,}")


class _Slots(dict):
    """Slot of each word part, remembered; -1 for parts that do not count."""

    def __missing__(self, part):
        counts = len(part) > 2 or part.lower() == part.upper()
        slot = zlib.crc32(part.lower().encode("utf-8", "replace")) & (SLOTS - 1) if counts else -1
        self[part] = slot
        return slot


def slot_counts(text, slots) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and the damped count log(1 + n) of each."""
    parts = (_PART if text.isascii() else _WIDE_PART).findall(text) if text else []
    ids = np.fromiter((slots[p] for p in parts), np.int32)
    ids, n = np.unique(ids, return_counts=True)
    at = int(len(ids) > 0 and ids[0] < 0)
    return ids[at:], np.log1p(n[at:]).astype(np.float32)


def features(documents: DataFrame, foreign: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, slots array<int>, counts array<float> (damped, so that boilerplate does not outweigh).

    Stretches that are an item of ``foreign`` (item_id, item_text; see :mod:`lodestrata.llm.leakage`) are left
    out, block of items by block within one pass over the documents; their words count elsewhere.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text")
    last = None
    for index in item_blocks(foreign, block_bytes, RUN, ALTERED) if foreign is not None else ():
        if last is not None:
            texts = texts.mapInPandas(_leaving_out(last), f"doc_id {kind}, text string")
        last = share(documents.sparkSession, index) if index.ids else last

    def count(batches):
        slots = _Slots()
        items = pickle.loads(last.value) if last is not None else None
        for batch in batches:
            found = [slot_counts(items.without(t) if items else t, slots) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "slots": [s for s, _ in found], "counts": [c for _, c in found]})

    return texts.mapInPandas(count, f"doc_id {kind}, slots array<int>, counts array<float>")


def _leaving_out(shared):
    def run(batches):
        items = pickle.loads(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [items.without(t) for t in batch["text"]]})

    return run


def evidence(counts: np.ndarray) -> np.ndarray:
    """Per slot: p(word | subject) / p(word | complement of the subject); the background (last) has a constant."""
    used = counts.sum(1) > 0
    n, size = counts[used], max(1, int(used.sum()))
    inside = (n + ALPHA) / (n.sum(0) + ALPHA * size)
    outside = (n.sum(1, keepdims=True) - n + ALPHA) / (n.sum() - n.sum(0) + ALPHA * size)
    out = np.ones(counts.shape, np.float32)
    out[used] = inside / outside
    out[:, -1] = BACKGROUND
    return out


def shared_out(slots, counts, starts, ratio, allowed=None, rounds=3):
    """(words per document and subject, occurrence shares) for documents laid end to end.

    ``starts``: where each document begins; none may be empty. ``allowed``: subjects a document may have.
    """
    sizes = np.diff(np.append(starts, len(slots)))
    weight = ratio[slots]
    f = counts.astype(np.float32)[:, None]
    mix = np.ones((len(starts), ratio.shape[1]), np.float32) if allowed is None else allowed.astype(np.float32)
    mix /= mix.sum(1, keepdims=True)
    for last in range(rounds - 1, -1, -1):
        part = weight * np.repeat(mix, sizes, 0)
        part *= f / part.sum(1, keepdims=True)
        mass = np.add.reduceat(part, starts, 0)
        if last:
            mix = mass + np.float32(PRIOR / ratio.shape[1])
            if allowed is not None:
                mix *= allowed
            mix /= mix.sum(1, keepdims=True)
    return mass, part


def laid_out(batch: pd.DataFrame):
    """The non-empty documents of a batch end to end: row numbers, slots, counts, starts."""
    sizes = batch["slots"].map(len).to_numpy()
    rows = np.nonzero(sizes)[0]
    if not len(rows):
        return rows, None, None, None
    slots = np.concatenate(batch["slots"].to_numpy()[rows]).astype(np.int64)
    counts = np.concatenate(batch["counts"].to_numpy()[rows])
    return rows, slots, counts, np.cumsum(sizes[rows]) - sizes[rows]


def _sums(rows: pd.DataFrame, width: int) -> np.ndarray:
    total = np.zeros((SLOTS, width), np.float64)
    if len(rows):
        total[rows["slot"].to_numpy()] = np.stack(rows["n"].to_numpy())
    return total


def refine(vectors: DataFrame, ratio: np.ndarray, width: int) -> np.ndarray:
    """One EM pass over all documents: the expected word counts per slot and subject."""
    shared = vectors.sparkSession.sparkContext.broadcast(ratio)

    def expect(batches):
        total = np.zeros((SLOTS, width), np.float64)
        for batch in batches:
            rows, slots, counts, starts = laid_out(batch)
            if len(rows):
                _, part = shared_out(slots, counts, starts, shared.value)
                for k in range(width):
                    total[:, k] += np.bincount(slots, part[:, k], SLOTS)
        used = np.nonzero(total.sum(1))[0]
        yield pd.DataFrame({"slot": used} | {f"n{k}": total[used, k] for k in range(width)})

    columns = [f"n{k}" for k in range(width)]
    # A task sends one row per slot, however many documents it has: few large tasks send least.
    tasks = max(1, 4 * vectors.sparkSession.sparkContext.defaultParallelism)
    vectors = vectors.select("slots", "counts").coalesce(tasks)
    parts = vectors.select("slots", "counts").mapInPandas(expect, "slot int, " + ", ".join(f"{c} double" for c in columns))
    sums = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    return _sums(pd.DataFrame({"slot": sums["slot"], "n": list(sums[columns].to_numpy())}), width)


def _logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, float], strength: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve, pulled towards ``prior``; Newton steps."""
    theta, pull = np.array(prior), np.array(prior)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (y - p) - strength * (theta - pull)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + strength * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta + step
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def _robust(x: np.ndarray, y: np.ndarray, prior: tuple[float, float], strength: float, noise=None):
    """A logistic curve for labels of which some are wrong or missing: (curve, (wrong, missing)).

    The true label is latent; EM alternates between its expectation and the curve. Without given
    noise rates these are estimated too.
    """
    wrong, missing = noise or (0.01, 0.1)
    curve = prior
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x * curve[0] + curve[1], -30, 30)))
        if_true, if_false = np.where(y > 0, 1 - missing, missing), np.where(y > 0, wrong, 1 - wrong)
        true = p * if_true / (p * if_true + (1 - p) * if_false)
        curve = _logistic(x, true, prior, strength)
        if noise is None:
            wrong = float(np.clip(((1 - true) * y).sum() / max((1 - true).sum(), 1e-9), 1e-4, 0.1))
            missing = float(np.clip((true * (1 - y)).sum() / max(true.sum(), 1e-9), 1e-3, 0.3))
    return curve, (wrong, missing)


def signal(mass: np.ndarray) -> np.ndarray:
    """Log-odds of each subject's share among the subject words of a document."""
    own = mass[:, :-1]
    return np.log(own + 0.5) - np.log(own.sum(1, keepdims=True) - own + 0.5)


class Model:
    """Subjects, word evidence and one posterior curve per subject."""

    def __init__(self, subjects, ratio, curves, least=2.0):
        self.subjects, self.ratio, self.curves, self.least = subjects, ratio, np.array(curves), least

    def posteriors(self, mass: np.ndarray) -> np.ndarray:
        z = signal(mass) * self.curves[:, 0] + self.curves[:, 1]
        return np.where(mass[:, :-1] >= self.least, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0)


def train(vectors: DataFrame, labels: DataFrame, subjects: list[str], passes: int = 2, labelled: int = LABELLED) -> Model | None:
    """The model from ``vectors`` (see :func:`features`) and ``labels`` (doc_id, subject); None without labels."""
    width = len(subjects) + 1
    votes = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id", "subject").agg(F.count("*").alias("n"))
    votes = votes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("votes"))
    votes = votes.orderBy(F.xxhash64("doc_id")).limit(labelled)
    sample = vectors.join(F.broadcast(votes), "doc_id").toPandas()
    rows, slots, counts, starts = laid_out(sample) if len(sample) else ([], None, None, None)
    if not len(rows):
        return None
    number = {s: k for k, s in enumerate(subjects)}
    said = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        for subject, n in sample["votes"].iloc[r].items():
            said[i, number[subject]] = n
    # At first all words count for the labelled subjects; the background fills up from what they share.
    part = np.repeat(said / said.sum(1, keepdims=True), np.diff(np.append(starts, len(slots))), 0) * counts[:, None]
    said[:, -1] = said.sum(1)
    start = said / said.sum(1, keepdims=True)

    def gather(part):
        return np.stack([np.bincount(slots, part[:, k], SLOTS) for k in range(width)], 1)

    total = gather(part)
    for _ in range(5):
        _, part = shared_out(slots, counts, starts, evidence(total), start)
        total = gather(part)
    anchor = total / total.sum()
    for _ in range(passes):
        total = refine(vectors, evidence(total), width)
        # The labelled counts stay in with equal weight, so that subjects do not drift.
        total += anchor * total.sum()
    ratio = evidence(total)
    mass, _ = shared_out(slots, counts, starts, ratio)
    x, y = signal(mass), said[:, :-1] > 0
    seen = mass[:, :-1].sum(1) >= 2
    common, noise = _robust(x[seen].ravel(), y[seen].ravel().astype(float), (2.0, 1.0), 0.05)
    curves = [_robust(x[seen, k], y[seen, k].astype(float), common, 5.0, noise)[0] for k in range(width - 1)]
    return Model(subjects, ratio, curves)


def posteriors(vectors: DataFrame, model: Model, least: float = 0.5, most: int = 2) -> DataFrame:
    """doc_id, subject, posterior of the subjects (``most`` at most) with a posterior of ``least`` or more."""
    shared = share(vectors.sparkSession, model)
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        m = pickle.loads(shared.value)
        for batch in batches:
            rows, slots, counts, starts = laid_out(batch)
            if not len(rows):
                continue
            p = m.posteriors(shared_out(slots, counts, starts, m.ratio)[0])
            order = np.argsort(-p, 1, kind="stable")[:, :most]
            top = np.take_along_axis(p, order, 1)
            i, j = np.nonzero(top >= least)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy()[rows[i]], "subject": np.array(m.subjects, dtype=object)[order[i, j]], "posterior": top[i, j].astype(float),
            })

    return vectors.mapInPandas(judge, f"doc_id {kind}, subject string, posterior double")


def foreign_items(texts: DataFrame) -> DataFrame:
    """The distinct item texts as items."""
    return texts.where(F.col("item_text").isNotNull()).select("item_text").distinct().select(F.xxhash64("item_text").alias("item_id"), "item_text")


def subject_areas(
    documents: DataFrame, labels: DataFrame, areas: DataFrame, passes: int = 2, least: float = 0.5, most: int = 2, foreign: DataFrame | None = None
) -> DataFrame:
    """doc_id, subject, posterior for every subject each document is about.

    ``foreign`` (item_text): texts like test items that may have leaked into documents; the stretches
    where they did are not taken for the documents' own.
    """
    names = [r[0] for r in areas.where(F.col("subject").isNotNull()).select("subject").distinct().orderBy("subject").limit(SUBJECTS + 1).collect()]
    if len(names) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    vectors = stored(features(documents, foreign_items(foreign) if foreign is not None else None), "vectors")
    model = train(vectors, labels, names, passes)
    if model is None:
        return vectors.select("doc_id", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("double").alias("posterior")).limit(0)
    return posteriors(vectors, model, least, most)


ship(__name__)
