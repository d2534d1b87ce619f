"""Quality classifier by co-training on two views of a document.

One view sees the text alone (shares of kinds of characters, repetition, words that
mark a class), the other its metadata alone (language, source, length). Both start from
the same labelled documents; over some rounds each labels the unlabelled documents it
is sure of for the other. Each view is calibrated on labelled documents held out from
fitting (Platt), and a document's log odds are the prior's plus what each calibrated
view adds to it. The same is done for toxicity.

Only labelled documents are bounded: ``Plan.labelled`` for each target, those with the
least hashes of their ids, whose features, not words, go to the driver. Every document without a
label takes part in every round: its features are written once, what it is taught is
worked out from the models of the rounds so far, and only sums (gradients, Hessians,
counts of words) leave the executors. All that was taught together weighs as much as the
labelled documents at most. After the first round the marking words are counted again,
over taught documents too; those of the labelled documents stay. Scoring covers every
document, each by itself, with nothing shuffled.

Nulls: null text is empty; null language, source or length are values of their own; a
document without id has no label. A document with several labels is good if all say so,
toxic if any does; one that has a label for one target only is unlabelled for the other.
Without labels, or with one class only, every document gets the prior: it is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrade.llm.batches import as_bytes, pieces, words
from tremorgrade.llm.row_keys import put_back, set_aside
from tremorgrade.llm.store import stored

TARGETS = ("quality", "toxic")
BROADCAST_LABELS = 2_000_000
"""The ids of so many labelled documents at most are broadcast: some 50 MB in memory."""

_NUMBERS = 11
_LANGUAGES, _SOURCES = 16, 64
_SMOOTH = 1.0


@dataclass(frozen=True)
class Plan:
    labelled: int = 8_000
    rounds: int = 3
    confident: float = 0.97
    marker_precision: float = 0.9
    marker_support: int = 3
    marker_share: float = 0.005


_CLASSES = np.zeros(256, np.int64)
_CLASSES[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 1
_CLASSES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 2
_CLASSES[np.frombuffer(b"0123456789", np.uint8)] = 3
_CLASSES[np.frombuffer(b" \t\n\r\v\f", np.uint8)] = 4
_CLASSES[np.frombuffer(b".,;:?'\"-()", np.uint8)] = 5
_CLASSES[128:] = 6


def text_features(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """A row of numbers for each text, and its distinct words' hashes."""
    found = words(texts)
    rows, distinct = [], []
    for text, a, b in zip(as_bytes(texts), found.bounds[:-1], found.bounds[1:], strict=True):
        kinds = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=7)
        n = max(1, len(text))
        own, counts = np.unique(found.hashes[a:b], return_counts=True)
        n_words = max(1, b - a)
        letters = max(1, kinds[1] + kinds[2] + kinds[6])
        rows.append(
            [
                kinds[0] / n,
                kinds[2] / letters,
                kinds[3] / n,
                kinds[4] / n,
                kinds[5] / n,
                kinds[6] / n,
                len(own) / np.sqrt(n_words) / 10,
                counts.max(initial=0) / n_words,
                np.log1p(b - a) / 10,
                min(5.0, n / n_words / 6),
                float(len(text) == 0),
            ]
        )
        distinct.append(own)
    return np.array(rows).reshape(len(rows), _NUMBERS), distinct


def _metadata(batch: pa.RecordBatch) -> np.ndarray:
    """Language and source hashed to places, the length's logarithm, and whether it is null."""
    columns = (batch[c].to_pylist() for c in ("lang", "source", "n_chars"))
    rows = [
        (
            zlib.crc32(repr(lang).encode()) % _LANGUAGES,
            _LANGUAGES + zlib.crc32(repr(source).encode()) % _SOURCES,
            np.log1p(max(0, n_chars or 0)) / 10,
            n_chars is None,
        )
        for lang, source, n_chars in zip(*columns, strict=True)
    ]
    return np.array(rows, float).reshape(len(rows), 4)


def _spread(metadata: np.ndarray) -> np.ndarray:
    """A column for each place."""
    rows = np.zeros((len(metadata), _LANGUAGES + _SOURCES + 2))
    for place in (0, 1):
        rows[np.arange(len(rows)), metadata[:, place].astype(int)] = 1
    rows[:, -2:] = metadata[:, 2:]
    return rows


def metadata_features(batch: pa.RecordBatch) -> np.ndarray:
    return _spread(_metadata(batch))


@dataclass
class Logistic:
    """Logistic regression by Newton's method with a ridge."""

    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> Logistic:
        self.mean, spread = rows.mean(axis=0), rows.std(axis=0)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        prior = (labels.sum() + _SMOOTH) / (len(labels) + 2 * _SMOOTH)
        self.weights = np.zeros(rows.shape[1] + 1)
        self.weights[-1] = np.log(prior / (1 - prior))
        for _ in range(25):
            if self.step(*self.sums(rows, labels)) < 1e-8:
                break
        return self

    def sums(self, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian over these rows, without the ridge; those of parts add up."""
        x = self._with_one(rows)
        p = _sigmoid(x @ self.weights)
        return x.T @ (p - labels), (x * (p * (1 - p) + 1e-6)[:, None]).T @ x

    def step(self, gradient: np.ndarray, curve: np.ndarray) -> float:
        """Moves the weights; the largest move asked for."""
        ridge = np.full(len(self.weights), self.ridge)
        ridge[-1] = 1e-3
        pull = ridge * self.weights
        pull[-1] = 0.0
        step = np.linalg.solve(curve + np.diag(ridge), gradient + pull)
        self.weights = self.weights - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        return float(np.abs(step).max())

    def _with_one(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack(((rows - self.mean) / self.scale, np.ones((len(rows), 1))))

    def logit(self, rows: np.ndarray) -> np.ndarray:
        return self._with_one(rows) @ self.weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Both calibrated views of one target."""

    markers: np.ndarray
    views: tuple[Logistic, Logistic]
    calibration: tuple[Logistic, Logistic]
    prior: float

    def content(self, numbers: np.ndarray, distinct: list[np.ndarray]) -> np.ndarray:
        return _with_markers(numbers, distinct, self.markers)

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Probability by both views together, and by each alone."""
        logits = [
            c.logit(v.logit(rows)[:, None])
            for v, c, rows in zip(self.views, self.calibration, (content, metadata), strict=True)
        ]
        return _sigmoid(logits[0] + logits[1] - self.prior), [_sigmoid(x) for x in logits]


def _hits(distinct: list[np.ndarray], markers: np.ndarray) -> np.ndarray:
    hits = [float(np.isin(own, markers, assume_unique=True).any()) if len(markers) else 0.0 for own in distinct]
    return np.array(hits).reshape(-1, 1)


def _with_markers(numbers: np.ndarray, distinct: list[np.ndarray], markers: np.ndarray) -> np.ndarray:
    return np.hstack((numbers, _hits(distinct, markers)))


def _word_counts(distinct: list[np.ndarray], rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, in how many documents of the rarer class each is, and in how many of all."""
    flat = np.concatenate(distinct) if distinct else np.zeros(0, np.uint64)
    owner = np.repeat(rare, [len(d) for d in distinct])
    known, inverse = np.unique(flat, return_inverse=True)
    inside = np.bincount(inverse, weights=owner, minlength=len(known)).astype(np.int64)
    return known, inside, np.bincount(inverse, minlength=len(known)).astype(np.int64)


class Course:
    """One target while it is learned, as seen on the labelled documents. Every fifth of them is
    held out from fitting."""

    def __init__(self, target: str, taught: np.ndarray) -> None:
        self.target = target
        self.open = len(np.unique(taught)) == 2
        self.rare = int(taught.mean() <= 0.5) if self.open else 1
        self.lists: list[np.ndarray] = []
        self.views: list[Logistic] = []

    def see(self, labelled: Labelled) -> None:
        """Take over the labelled documents' features, made with the latest list of markers."""
        labels, fit = labelled.labels[self.target], labelled.fit[self.target]
        self.known = labels[labels >= 0]
        held = (labels >= 0) & ~fit
        hits = labelled.hits.get(self.target, np.zeros((len(labels), 1)))
        rows = (np.hstack((labelled.numbers, hits)), labelled.metadata)
        self.rows, self.held = [x[fit] for x in rows], [x[held] for x in rows]
        self.labels, self.held_labels = labels[fit].astype(float), labels[held].astype(float)
        if self.open:
            fresh = [Logistic().fit(x, self.labels) for x in self.rows]
            self.views = [fresh[0], *(self.views or fresh)[1:]]

    def model(self) -> Model:
        labels = self.held_labels if self.open else self.known
        rate = (labels.sum() + _SMOOTH) / (len(labels) + 2 * _SMOOTH)
        prior = float(np.log(rate / (1 - rate)))
        if not self.open:
            flat = [_constant(x.shape[1]) for x in self.rows]
            level = _constant(1, prior)
            return Model(np.zeros(0, np.uint64), (flat[0], flat[1]), (level, level), prior)
        calibrated = tuple(
            Logistic(ridge=1e-2).fit(v.logit(x)[:, None], labels)
            for v, x in zip(self.views, self.held, strict=True)
        )
        return Model(self.lists[-1], (self.views[0], self.views[1]), calibrated, prior)


@dataclass
class Labelled:
    """Features of the labelled documents; labels are -1 where there is none for the target."""

    numbers: np.ndarray
    metadata: np.ndarray
    hits: dict[str, np.ndarray]
    labels: dict[str, np.ndarray]
    fit: dict[str, np.ndarray]


@dataclass
class Lesson:
    """What workers need of a target: the views of each round so far, with the list of markers
    they were fitted on, and the views now fitted."""

    rounds: list[tuple[int, list[Logistic]]]
    views: list[Logistic]
    latest: int
    confident: float

    def taught(self, hits: list[np.ndarray], numbers: np.ndarray, metadata: np.ndarray, pool: np.ndarray) -> list[np.ndarray]:
        """For each view the labels the other one taught it: 1, 0, or -1 for none. A document
        is taught in the first round that is sure of it; where the views are sure of opposite
        labels, neither teaches."""
        got = [np.full(len(pool), -1), np.full(len(pool), -1)]
        pool = pool.copy()
        for list_, views in self.rounds:
            rows = (np.hstack((numbers, hits[list_])), metadata)
            p = [_sigmoid(v.logit(x)) for v, x in zip(views, rows, strict=True)]
            sure = [pool & (np.maximum(q, 1 - q) >= self.confident) for q in p]
            apart = sure[0] & sure[1] & ((p[0] > 0.5) != (p[1] > 0.5))
            for own in (0, 1):
                teach = sure[own] & ~apart
                got[1 - own][teach] = p[own][teach] > 0.5
                pool &= ~teach
        return got


def _constant(width: int, level: float = 0.0) -> Logistic:
    weights = np.zeros(width + 1)
    weights[-1] = level
    return Logistic(mean=np.zeros(width), scale=np.ones(width), weights=weights)


_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def train(documents: DataFrame, labels: DataFrame, plan: Plan | None = None) -> dict[str, Model]:
    """Models of quality and toxicity from (doc_id, quality, toxic)."""
    plan = plan or Plan()
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id")
    said = said.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    said = stored(said.where("quality IS NOT NULL OR toxic IS NOT NULL"), "labels")
    chosen = F.broadcast(documents.sparkSession.createDataFrame(_chosen(said, plan)))  # bounded by the plan
    sample = stored(documents.select(_COLUMNS).join(chosen, "doc_id"), "sample")
    taught = sample.select(*[f"fit_{t}" for t in TARGETS]).toArrow()
    courses = {t: Course(t, taught[f"fit_{t}"].drop_null().to_numpy()) for t in TARGETS}
    learned = {t: c for t, c in courses.items() if c.open}
    if learned:
        _co_train(_unlabelled(documents, said), sample, learned, plan)
    for course in courses.values():
        if not course.open:
            course.see(_labelled(sample, {}))
    return {t: c.model() for t, c in courses.items()}


def _chosen(said: DataFrame, plan: Plan) -> pa.Table:
    """(doc_id, quality, toxic, fit_quality, fit_toxic): the documents whose labels are used, and
    their labels again where they are used for fitting."""
    found = {}
    for target in TARGETS:
        least = said.where(F.col(target).isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(plan.labelled)
        rows = least.select("doc_id", F.col(target).cast("int").alias(target)).toArrow().sort_by("doc_id")
        found[target] = rows["doc_id"].to_numpy(), rows[target].to_numpy()
    every = np.union1d(found["quality"][0], found["toxic"][0]).astype(np.int64)
    columns = {"doc_id": pa.array(every)}
    for prefix, step in (("", 0), ("fit_", 5)):
        for target, (ids, labels) in found.items():
            used = np.arange(len(ids)) % step != 0 if step else np.ones(len(ids), bool)
            values, missing = np.zeros(len(every), np.int32), np.ones(len(every), bool)
            at = np.searchsorted(every, ids[used])
            values[at], missing[at] = labels[used], False
            columns[prefix + target] = pa.array(values, mask=missing)
    return pa.table(columns)


def _labelled(sample: DataFrame, lists: dict[str, list[np.ndarray]]) -> Labelled:
    latest = {t: own[-1:] for t, own in lists.items()}
    others = ["doc_id", *TARGETS, *[f"fit_{t}" for t in TARGETS]]
    rows = _featured(sample, latest, *others).toArrow().sort_by("doc_id")
    x = np.array(rows["x"].to_pylist(), float).reshape(rows.num_rows, _NUMBERS + 4 + len(latest))
    return Labelled(
        x[:, :_NUMBERS],
        _spread(x[:, _NUMBERS : _NUMBERS + 4]),
        {t: x[:, _NUMBERS + 4 + i][:, None] for i, t in enumerate(latest)},
        {t: rows[t].fill_null(-1).to_numpy() for t in TARGETS},
        {t: rows[f"fit_{t}"].is_valid().to_numpy() for t in TARGETS},
    )


def _unlabelled(documents: DataFrame, said: DataFrame) -> DataFrame:
    """Every document that lacks a label; quality and toxic are -1 where it does, else null."""
    known = F.broadcast(said) if said.count() <= BROADCAST_LABELS else said
    lacks = [F.when(F.col(t).isNull(), -1).alias(t) for t in TARGETS]
    rows = documents.select(_COLUMNS).join(known, "doc_id", "left").where("quality IS NULL OR toxic IS NULL")
    return rows.select(*_COLUMNS, *lacks)


def _co_train(unlabelled: DataFrame, sample: DataFrame, courses: dict[str, Course], plan: Plan) -> None:
    """Rounds of teaching and fitting, of all targets together."""
    fitting = sample.select(*_COLUMNS, *[F.col(f"fit_{t}").alias(t) for t in TARGETS])
    counts = _counts(fitting, courses, {t: Lesson([], [], 0, plan.confident) for t in courses})
    lists = {t: c.lists for t, c in courses.items()}
    for target in courses:
        lists[target].append(_markers(counts, target, plan))
    labelled = _labelled(sample, lists)
    for course in courses.values():
        course.see(labelled)
    rounds: dict[str, list] = {t: [] for t in courses}
    features = None
    for round_ in range(plan.rounds):
        for target, course in courses.items():
            rounds[target].append((len(lists[target]) - 1, [replace(v) for v in course.views]))
        lessons = {t: Lesson(rounds[t], c.views, 0, plan.confident) for t, c in courses.items()}
        if round_ == 0:
            counts = _counts(unlabelled, courses, lessons, counts)
            found = {t: np.union1d(lists[t][0], _markers(counts, t, plan)) for t in courses}
            if any(len(found[t]) > len(lists[t][0]) for t in courses):
                for target in courses:
                    lists[target].append(found[target])
                labelled = _labelled(sample, lists)
                for course in courses.values():
                    course.see(labelled)
            features = stored(_featured(unlabelled, lists, *TARGETS), "features")
        lessons = {t: Lesson(rounds[t], c.views, len(lists[t]) - 1, plan.confident) for t, c in courses.items()}
        for _ in range(25):
            sums = _sums(features, lessons)
            moved = 0.0
            for target, course in courses.items():
                for view, x, (n, gradient, curve) in zip(course.views, course.rows, sums[target], strict=True):
                    weight = min(1.0, len(x) / n) if n else 0.0
                    known = view.sums(x, course.labels)
                    moved = max(moved, view.step(known[0] + weight * gradient, known[1] + weight * curve))
            if moved < (1e-6 if round_ == plan.rounds - 1 else 1e-3):
                break


def _featured(rows: DataFrame, lists: dict[str, list[np.ndarray]], *others: str) -> DataFrame:
    """Other columns as they are, and x: numbers, metadata, and for each list of markers whether
    one is found."""
    flat = [markers for own in lists.values() for markers in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            numbers, distinct = text_features(batch["text"])
            x = np.hstack((numbers, _metadata(batch), *[_hits(distinct, m) for m in flat]))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in others), pa.array(list(x), pa.list_(pa.float64()))], names=[*others, "x"]
            )

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{kinds}, x array<double>")


def _sums(features: DataFrame, lessons: dict[str, Lesson]) -> dict[str, list[tuple[float, np.ndarray, np.ndarray]]]:
    """For each target and view the number of taught documents, their gradient and Hessian;
    added up on the executors, so that a few rows come back whatever the input."""
    sizes = [(t, k, len(v.weights)) for t, own in lessons.items() for k, v in enumerate(own.views)]
    width = sum(1 + d + d * d for _, _, d in sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
            numbers, metadata = x[:, :_NUMBERS], _spread(x[:, _NUMBERS : _NUMBERS + 4])
            place, found = _NUMBERS + 4, []
            for target, lesson in lessons.items():
                hits = [x[:, place + i : place + i + 1] for i in range(lesson.latest + 1)]
                place += lesson.latest + 1
                pool = batch[target].fill_null(0).to_numpy() == -1
                got = lesson.taught(hits, numbers, metadata, pool)
                rows = (np.hstack((numbers, hits[lesson.latest])), metadata)
                for view, own, labels in zip(lesson.views, rows, got, strict=True):
                    taught = labels >= 0
                    gradient, curve = view.sums(own[taught], labels[taught])
                    found += [[taught.sum()], gradient, curve.ravel()]
            total += np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for part in batch["sums"].to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = features.mapInArrow(run, "sums binary").repartition(8).mapInArrow(add, "sums binary").collect()
    total = np.sum([np.frombuffer(r.sums) for r in parts], axis=0) if parts else np.zeros(width)
    result: dict[str, list] = {t: [] for t in lessons}
    at = 0
    for target, _, d in sizes:
        own = total[at : at + 1 + d + d * d]
        result[target].append((own[0], own[1 : d + 1], own[d + 1 :].reshape(d, d)))
        at += len(own)
    return result


def _counts(
    rows: DataFrame, courses: dict[str, Course], lessons: dict[str, Lesson], before: DataFrame | None = None
) -> DataFrame:
    """(target, word, inside, total): in how many documents of the rarer class, and in how many of
    all, each word is; without a word, the documents themselves. A document counts by its label,
    or if that is -1 by what the text view was taught. ``before`` is added."""
    rare = {t: c.rare for t, c in courses.items()}
    markers = {t: c.lists[-1] for t, c in courses.items() if c.lists}
    schema = pa.schema([("target", pa.string()), *((c, pa.int64()) for c in ("word", "inside", "total"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            numbers, distinct = text_features(batch["text"])
            metadata = metadata_features(batch)
            for target, lesson in lessons.items():
                labels = batch[target].fill_null(-2).to_numpy()
                if lesson.rounds:
                    hits = [_hits(distinct, markers[target])]
                    pool = labels == -1
                    labels = np.where(pool, lesson.taught(hits, numbers, metadata, pool)[0], labels)
                chosen = np.flatnonzero(labels >= 0)
                is_rare = labels[chosen] == rare[target]
                known, inside, total = _word_counts([distinct[i] for i in chosen], is_rare)
                columns = [
                    pa.array([target] * (len(known) + 1)),
                    pa.array([None, *known.view(np.int64).tolist()], pa.int64()),
                    pa.array(np.concatenate(([is_rare.sum()], inside)), pa.int64()),
                    pa.array(np.concatenate(([len(chosen)], total)), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    found = rows.mapInArrow(run, "target string, word long, inside long, total long")
    found = found.union(before) if before is not None else found
    sums = [F.sum(c).alias(c) for c in ("inside", "total")]
    return stored(found.groupBy("target", "word").agg(*sums), "words")


def _markers(counts: DataFrame, target: str, plan: Plan) -> np.ndarray:
    """Words found almost only in documents of the rarer class, and in enough of them."""
    own = counts.where(F.col("target") == target)
    rare = own.where("word IS NULL").first().inside
    enough = F.col("inside") >= max(plan.marker_support, plan.marker_share * rare)
    precise = F.col("inside") >= plan.marker_precision * F.col("total")
    found = own.where(F.col("word").isNotNull() & enough & precise).select("word").toArrow()
    return np.sort(found["word"].to_numpy().view(np.uint64))


def score(documents: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(doc_id, quality, quality_by_text, quality_by_metadata, toxic, keep) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            numbers, distinct = text_features(batch["text"])
            metadata = metadata_features(batch)
            good, toxic = models["quality"], models["toxic"]
            quality, views = good.score(good.content(numbers, distinct), metadata)
            poison, _ = toxic.score(toxic.content(numbers, distinct), metadata)
            columns = [quality, *views, poison, (quality >= 0.5) & (poison <= 0.5)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *map(pa.array, columns)],
                names=["doc_id", "quality", "quality_by_text", "quality_by_metadata", "toxic", "keep"],
            )

    return documents.select(_COLUMNS).mapInArrow(
        run,
        "doc_id long, quality double, quality_by_text double, quality_by_metadata double, toxic double, keep boolean",
    )


def keep_good(documents: DataFrame, models: dict[str, Model]) -> DataFrame:
    """The documents, all columns, whatever their names, that both targets let pass."""
    aside = set_aside(documents)
    known = [c for c in _COLUMNS if c not in ("doc_id", "text")]
    rows = aside.withColumns({c: F.col("others").getField(c) for c in known})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            numbers, distinct = text_features(batch["text"])
            metadata = metadata_features(batch)
            good, toxic = (
                models[t].score(models[t].content(numbers, distinct), metadata)[0] for t in ("quality", "toxic")
            )
            yield batch.filter(pa.array((good >= 0.5) & (toxic <= 0.5)))

    return put_back(rows.mapInArrow(run, rows.schema), documents)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
