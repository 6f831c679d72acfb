"""Toxicity of texts by a convolutional classifier over hashed word embeddings.

Words (runs of ASCII letters and digits and of anything beyond ASCII, A-Z as a-z)
are hashed into ``BUCKETS`` embeddings of ``DIM`` numbers; a word has the sum of those of itself and of
its beginnings of ``HEADS`` bytes, so that new forms of known stems count.  Filters of each of the widths in
``WIDTHS`` slide over the words, the highest answer of each filter over the whole text
is kept, and a linear layer turns these into a logit.  All of it is trained in numpy
on labelled documents.  Per language the logit at which documents begin to count as
toxic is calibrated on labelled rows that the training did not see, and the score is
the logistic of what is above it, so 0.5 is the threshold in every language.
The language of a text is told from its words by counts over all labelled rows; the
columns lang, source and doc_id are not looked at when a text is scored.

Every labelled document that is not held out is learned from, with its whole text: by hash of doc_id
four fifths train the net and a fifth sets the thresholds.  The training rows are dealt into shards, with about
``TOXIC`` toxic or ``OTHER`` other documents in each.  In each of ``ROUNDS`` rounds every shard goes on from the same net, and
the net of the next round has the mean of what the shards have changed; a word's numbers change by the mean over
the shards that have met it.  Changes are summed as whole numbers, so the net does not depend on how tasks are dealt.

Null text and text without words get the score of no evidence.  Labels that are null
are not learned from; a doc_id with several labels counts as toxic if one says so.
Without labels of both kinds every score is 0.  Repeated rows get equal scores.
Scoring is a column expression on the text, so other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collocations import bloom_filter, in_filter
from .tables import free_name, long_texts, quoted, table, written
from .words import Hasher, lettered
from .workers import released

BITS = 16
BUCKETS = 1 << BITS
HEADS = (4, 6)
DIM = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Documents of a kind that a shard has as a rule.
TOXIC, OTHER = 3000, 5000
#: Words that a shard holds at once, and that the filters slide over at once.
HELD, RUN = 1 << 22, 1 << 16
#: Languages told apart for thresholds, and labelled rows that one must have.
LANGS, FEWEST = 64, 40
EPOCHS, ROUNDS = 6, 3
BATCH = 32
RATE = 0.05
#: A change of 1, and a logit of 1, in whole numbers.
UNIT, STEPS = float(1 << 30), 256
PAD = BUCKETS  # a word that says nothing

Words = np.ndarray  # buckets of each word of a text and of its beginnings


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def texts_to_words(texts: pa.Array, hasher: Hasher) -> list[Words]:
    out: list[Words] = []
    for _, _, hashes, at in hasher.pieces(texts, HEADS):
        ids = buckets(hashes)
        out += [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def padded(ids: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with as many pads after each text as the widest filter reaches beyond, where each text
    begins in them, and which places are words."""
    reach = max(WIDTHS) - 1
    sizes = np.diff(at)
    places = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * reach, sizes)
    out = np.full((len(ids) + reach * len(sizes), 1 + len(HEADS)), PAD, np.int32)
    out[places] = ids
    real = np.zeros(len(out), bool)
    real[places] = True
    return out, at[:-1] + np.arange(len(sizes)) * reach, real


class Net:
    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        # Words that training does not meet must say nothing.
        self.words = rng.normal(0, 0.001, (BUCKETS + 1, DIM)).astype(np.float32)
        self.words[PAD] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(0)
        #: Sums of squared gradients.
        self.past = {k: np.full(v.shape, 1e-4, np.float32) for k, v in self._small().items()}
        self.past_words = np.full((BUCKETS + 1, 1), 1e-4, np.float32)

    def _small(self) -> dict[str, np.ndarray]:
        """All that is trained but the words and the base."""
        named = {f"f{k}": f for k, f in enumerate(self.filters)} | {f"b{k}": b for k, b in enumerate(self.bias)}
        return named | {"out": self.out}

    def flat(self) -> np.ndarray:
        """All numbers as [row, ``DIM`` + 1]: a row for each word with its sum of squares, and then the rest."""
        rest = np.concatenate([*(x.ravel() for x in (*self._small().values(), *self.past.values())), [self.base]])
        rest = np.pad(rest, (0, -len(rest) % (DIM + 1))).reshape(-1, DIM + 1)
        return np.concatenate([np.concatenate([self.words, self.past_words], axis=1), rest]).astype(np.float32)

    def load(self, flat: np.ndarray) -> Net:
        """Take the numbers that ``flat`` gave."""
        self.words[:], self.past_words[:] = flat[: BUCKETS + 1, :DIM], flat[: BUCKETS + 1, DIM:]
        rest, at = flat[BUCKETS + 1 :].ravel(), 0
        for x in (*self._small().values(), *self.past.values()):
            x[...] = rest[at : at + x.size].reshape(x.shape)
            at += x.size
        self.base = np.float32(rest[at])
        return self

    def answers(self, parts: np.ndarray, real: np.ndarray) -> list[np.ndarray]:
        """Per width the answers [place, filter]; ``parts``: [place, all filters' columns]."""
        n, out, c = len(real), [], 0
        for w in WIDTHS:
            total = np.full((n, FILTERS), -1e9, np.float32)
            m = n - w + 1
            if m > 0:
                total[:m] = parts[:m, c : c + FILTERS]
                for j in range(1, w):
                    total[:m] += parts[j : j + m, c + j * FILTERS : c + (j + 1) * FILTERS]
            total[~real] = -1e9
            out.append(total)
            c += w * FILTERS
        return out

    def tops(self, texts: list[Words]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per width the highest answers [text, filter], and the words that gave them
        [text, filter, place under the filter, the word and its beginnings]."""
        reach = max(WIDTHS) - 1
        columns = self.columns()
        best = [np.full((len(texts), FILTERS), -1e9, np.float32) for _ in WIDTHS]
        words = [np.full((len(texts), FILTERS, w, 1 + len(HEADS)), PAD, np.int32) for w in WIDTHS]
        # A long text goes in cuts, each with the words that the filters reach beyond it.
        cuts = [(k, a) for k, t in enumerate(texts) for a in range(0, len(t), RUN)]
        while cuts:
            some, size = [], 0
            while cuts and (not some or size + min(RUN, len(texts[cuts[0][0]])) <= RUN):
                some.append(cuts.pop(0))
                size += min(RUN, len(texts[some[-1][0]]))
            parts = [texts[k][a : a + RUN + reach] for k, a in some]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids, first, _ = padded(np.concatenate(parts), at)
            embedded = self.words.take(ids[:, 0], axis=0)
            for j in range(1, ids.shape[1]):
                embedded += self.words.take(ids[:, j], axis=0)
            by_filter = columns.T @ embedded.T
            row = 0
            for i, w in enumerate(WIDTHS):
                answers = sum(by_filter[row + j * FILTERS : row + (j + 1) * FILTERS, j : len(ids) - reach + j] for j in range(w))
                row += w * FILTERS
                under = np.arange(w)
                for (k, _), s, p in zip(some, first, parts, strict=True):
                    own = answers[:, s : s + min(RUN, len(p))]
                    where = own.argmax(axis=1)
                    top = own[np.arange(FILTERS), where]
                    new = top > best[i][k]
                    best[i][k][new] = top[new]
                    words[i][k][new] = ids[s + where[new][:, None] + under]
        return best, words

    def step(self, texts: list[Words], truth: np.ndarray, weight: np.ndarray) -> float:
        """One step of Adagrad on a batch; returns the loss."""
        tops, words = self.tops(texts)
        raw = np.concatenate([t + b for t, b in zip(tops, self.bias, strict=True)], axis=1)
        act = np.maximum(raw, 0)
        logit = act @ self.out + self.base
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        g = (p - truth) * weight / len(texts)
        grad_out = act.T @ g + 1e-4 * self.out
        grad_act = (g[:, None] * self.out) * (raw > 0)
        self._update("out", self.out, grad_out)
        self.base -= RATE * g.sum()
        for k, w in enumerate(WIDTHS):
            ga = grad_act[:, k * FILTERS : (k + 1) * FILTERS]
            self._update(f"b{k}", self.bias[k], ga.sum(axis=0))
            grad_f = np.empty_like(self.filters[k])
            for j in range(w):
                seen = words[k][:, :, j]  # [text, filter, the word and its beginnings]
                grad_f[j] = np.einsum("tfd,tf->df", self.words[seen].sum(axis=2), ga)
                grad_e = ga[:, :, None] * self.filters[k][j].T[None]
                rows, back = np.unique(seen, return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                each = np.repeat(grad_e.reshape(-1, DIM), seen.shape[2], axis=0)
                np.add.at(total, back.ravel(), each)
                self.past_words[rows] += (total**2).mean(axis=1, keepdims=True)
                self.words[rows] -= RATE * total / np.sqrt(self.past_words[rows])
            self._update(f"f{k}", self.filters[k], grad_f)
        self.words[PAD] = 0
        return float(-(weight * np.log(np.where(truth == 1, p, 1 - p) + 1e-9)).mean())

    def _update(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        self.past[name] += grad**2
        value -= RATE * grad / np.sqrt(self.past[name])

    def columns(self) -> np.ndarray:
        """All filters side by side, by width and place under the filter."""
        return np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def logits(self, ids: Words, at: np.ndarray, of_word: np.ndarray) -> np.ndarray:
        """``of_word``: the part of every filter's answer that a bucket has at each place."""
        places, first, real = padded(ids, at)
        if not len(places):
            return np.zeros(0)
        parts = of_word[places[:, 0]]
        for k in range(1, places.shape[1]):
            parts += of_word[places[:, k]]
        act = [
            np.maximum(np.maximum.reduceat(a, first, axis=0) + b, 0)
            for a, b in zip(self.answers(parts, real), self.bias, strict=True)
        ]
        return np.concatenate(act, axis=1) @ self.out + self.base


class Classifier:
    """A net, the words of each language, and the logit that is the threshold of each."""

    def __init__(self, net: Net | None, langs: np.ndarray, thresholds: np.ndarray) -> None:
        self.net, self.langs, self.thresholds = net, langs, thresholds

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Classifier) -> None:
        self.model = model
        self.hasher = lettered()
        self.of_word = model.net.words @ model.net.columns() if model.net else None

    def logits(self, ids: Words, at: np.ndarray) -> np.ndarray:
        """Logits above the threshold of each text's language."""
        m = self.model
        out = m.net.logits(ids, at, self.of_word)
        if m.langs.shape[1] > 1:
            sums = np.zeros((len(ids) + 1, m.langs.shape[1]), np.float64)
            np.cumsum(m.langs[ids[:, 0]], axis=0, out=sums[1:])
            out = out - m.thresholds[(sums[at[1:]] - sums[at[:-1]]).argmax(axis=1)]
        else:
            out = out - m.thresholds[0]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.model.net:
            for a, b, hashes, at in self.hasher.pieces(texts, HEADS):
                logit = self.logits(buckets(hashes), at)
                out[a:b] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return out


def _as_words(raw: bytes) -> Words:
    return np.frombuffer(raw, "<u2").reshape(-1, 1 + len(HEADS)).astype(np.int32)


def _tokenized(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, held, toxic, lang, words) of the first text of each doc_id that has a label, which
    comes before its texts."""
    hasher = lettered()
    label = last = None  # the label that the next text of a doc_id is for, and that doc_id
    for part in parts:
        some, labels = [], []
        for i, (x, held, toxic) in enumerate(zip(*(part[c].to_pylist() for c in ("doc_id", "held", "toxic")), strict=True)):
            if toxic is not None:
                label, last = (held, toxic), x
            elif label and x == last:
                some.append(i)
                labels.append(label)
                label = None
        rows = part.take(pa.array(some, pa.int64()))
        words = [w.astype("<u2").tobytes() for w in texts_to_words(rows["text"], hasher)]
        marks = [pa.array([x[0] for x in labels], pa.bool_()), pa.array([x[1] for x in labels], pa.int32())]
        columns = [rows["shard"], *marks, rows["lang"], pa.array(words, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "held", "toxic", "lang", "words"])


def _shards(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Words], np.ndarray]]:
    """(shard, texts, toxic), a shard of more than ``HELD`` words in several parts."""
    texts: list[Words] = []
    toxic: list[int] = []
    last, size = None, 0
    for part in parts:
        for shard, truth, raw in zip(*(part[c] for c in ("shard", "toxic", "words")), strict=True):
            if texts and (shard.as_py() != last or size >= HELD):
                yield last, texts, np.array(toxic)
                texts, toxic, size = [], [], 0
            last = shard.as_py()
            texts.append(_as_words(raw.as_py()))
            toxic.append(truth.as_py())
            size += len(texts[-1])
    if texts:
        yield last, texts, np.array(toxic)


def _learned(parts: Iterator[pa.RecordBatch], flat: np.ndarray, seed: int, epochs: int, heavy: float) -> Iterator[pa.RecordBatch]:
    """What the shards of a task change in the rows of the net, summed, and how many of them do; ``heavy``: the weight of toxic rows."""
    total = np.zeros(flat.shape, np.int64)
    shards = np.zeros(len(flat), np.int64)

    def end(net: Net) -> None:
        change = np.rint((net.flat().astype(np.float64) - flat) * UNIT).astype(np.int64)
        total[:] += change
        shards[:] += change.any(axis=1)

    last, net, rng = None, None, None
    for shard, texts, toxic in _shards(parts):
        if shard != last:
            if net:
                end(net)
            last, net, rng = shard, Net().load(flat), np.random.default_rng((seed, shard))
        weight = np.where(toxic == 1, heavy, 1.0).astype(np.float32)
        order = np.arange(len(texts))
        for _ in range(epochs):
            rng.shuffle(order)
            for a in range(0, len(order), BATCH):
                some = order[a : a + BATCH]
                net.step([texts[i] for i in some], toxic[some].astype(np.float32), weight[some])
    if net:
        end(net)
    rows = np.flatnonzero(shards)
    for a in range(0, len(rows), 8192):
        some = rows[a : a + 8192]
        columns = [some.astype(np.int32), shards[some], *total[some].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["row", "shards", *CHANGES])


def _counted(parts: Iterator[pa.RecordBatch], place: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(place, bucket, n) of the words of each language; languages that have no place share the next."""
    counts: dict[int, np.ndarray] = {}
    for part in parts:
        for lang, raw in zip(part["lang"].to_pylist(), part["words"], strict=True):
            if lang is not None:
                own = counts.setdefault(place.get(lang, len(place)), np.zeros(BUCKETS, np.int64))
                own += np.bincount(_as_words(raw.as_py())[:, 0], minlength=BUCKETS)
    for k, own in counts.items():
        some = np.flatnonzero(own)
        columns = [pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array(own[some])]
        yield pa.RecordBatch.from_arrays(columns, ["place", "bucket", "n"])


def _judged(parts: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    """(place, step, n, toxic): rows by told language and logit, in steps."""
    scorer = model.scorer()
    for _, texts, toxic in _shards(parts):
        place, logit = np.zeros(len(texts), np.int32), np.zeros(len(texts))
        for i, t in enumerate(texts):
            place[i] = model.langs[t[:, 0]].sum(axis=0).argmax()
            logit[i] = scorer.logits(t, np.array([0, len(t)]))[0]
        step = np.floor(np.clip(logit, -30, 30) * STEPS).astype(np.int32)
        columns = [pa.array(place), pa.array(step), pa.array(np.ones(len(texts), np.int64)), pa.array(toxic.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["place", "step", "n", "toxic"])


CHANGES = [f"c{k}" for k in range(DIM + 1)]


def _net(rows: DataFrame, shards: int, train: dict[int, int]) -> Net:
    """A net trained on ``rows``; ``train``: their number by kind."""
    spark = rows.sparkSession
    size = sum(train.values())
    epochs = max(EPOCHS, min(60, 20_000 // size))
    rounds = ROUNDS if shards > 1 else 1
    heavy = min(4.0, train[0] / train[1])
    kind = ", ".join(["row int, shards long", *(f"{c} long" for c in CHANGES)])
    flat = Net().flat()
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(flat)  # a few MB, whatever the corpus

        def learn(parts: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            return released(_learned(parts, shared.value, k, -(-epochs // rounds), heavy))

        changes = rows.mapInArrow(learn, kind).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("shards", *CHANGES)))
        got = changes.toArrow()  # a row for each bucket at most
        mean = np.stack([got[c].to_numpy() for c in CHANGES], axis=1) / got["shards"].to_numpy()[:, None] / UNIT
        flat = flat.copy()
        flat[got["row"].to_numpy()] += mean.astype(np.float32)
        shared.unpersist()
    return Net().load(flat)


def _languages(rows: DataFrame) -> np.ndarray:
    """[bucket, language] logarithms of the share that a word has of the language's words."""
    # Languages with too few rows for a threshold of their own are one, as are all beyond LANGS.
    by_lang = rows.filter(F.col("lang").isNotNull()).groupBy("lang").count()
    frequent = by_lang.orderBy(F.desc("count"), "lang").limit(LANGS + 1).collect()
    names = sorted(r.lang for r in frequent[:LANGS] if r["count"] >= FEWEST)
    rest = len(frequent) > len(names) or not names
    place = {x: k for k, x in enumerate(names)}
    counts = np.full((len(names) + rest, BUCKETS), 0.1)
    met = rows.mapInArrow(lambda p: released(_counted(p, place)), "place int, bucket int, n long")
    got = met.groupBy("place", "bucket").agg(F.sum("n").alias("n")).toArrow()  # LANGS + 1 times BUCKETS rows at most
    counts[got["place"].to_numpy(), got["bucket"].to_numpy()] += got["n"].to_numpy()
    return np.log(counts / counts.sum(axis=1, keepdims=True)).T


def _thresholds(rows: DataFrame, model: Classifier) -> np.ndarray:
    """The threshold of each language, told from the text, on ``rows``; that of all where a language has too few."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    judged = rows.mapInArrow(lambda p: released(_judged(p, shared.value)), "place int, step int, n long, toxic long")
    got = judged.groupBy("place", "step").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    place, step, n, toxic = (got[c].to_numpy() for c in ("place", "step", "n", "toxic"))
    out = np.full(model.langs.shape[1], _threshold(step, n, toxic))
    for k in range(len(out)):
        own = place == k
        if min(toxic[own].sum(), (n - toxic)[own].sum()) >= 20:
            out[k] = _threshold(step[own], n[own], toxic[own])
    return out


def _threshold(step: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the logits between which the F1 measure is highest."""
    if not toxic.sum():
        return 0.0
    ranked, back = np.unique(-step, return_inverse=True)
    ranked = -ranked
    hits = np.cumsum(np.bincount(back, toxic))
    f1 = 2 * hits / (np.cumsum(np.bincount(back, n)) + toxic.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    a = ranked[best[0]]
    b = ranked[best[-1] + 1] if best[-1] + 1 < len(ranked) else a - STEPS
    return float((a + b + 1) / 2 / STEPS)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier fitted on all labelled rows of ``docs``; held-out rows are not used."""
    spark = docs.sparkSession
    long_texts(spark)
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(~is_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    usable = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", "lang")
    have = known.join(usable.select("doc_id").distinct(), "doc_id", "left_semi")
    fifth = F.pmod(F.xxhash64("doc_id", F.lit("threshold")), F.lit(5)) == 0
    have = written(have.withColumn("held", fifth), "labelled")
    number = {(r.held, r.toxic): r["count"] for r in have.groupBy("held", "toxic").count().collect()}
    train = {k: number.get((False, k), 0) for k in (0, 1)}
    if not all(train.values()):  # so few that none can be spared for thresholds
        have = have.withColumn("held", F.lit(False))
        train = {k: train[k] + number.get((True, k), 0) for k in (0, 1)}
    if not all(train.values()):
        return Classifier(None, np.zeros((BUCKETS, 1)), np.zeros(1))
    shards = max(1, round(max(train[1] / TOXIC, train[0] / OTHER)))
    # Texts without a label go before the shuffle, but for a few that the filter lets through.
    ids = spark.sparkContext.broadcast(bloom_filter(have.select(F.xxhash64("doc_id").alias("hash"))))

    def may(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return (pa.array(in_filter(ids.value, hashes.to_numpy().view(np.uint64))) for hashes in parts)

    labelled = F.arrow_udf(may, T.BooleanType(), F.ArrowUDFType.SCALAR_ITER)(F.xxhash64("doc_id"))
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
    texts = usable.filter(labelled).select(shard, "doc_id", "lang", "text")
    # Labels and texts meet in the shard: a join would shuffle the texts once more.
    dealt = have.select(shard, "doc_id", "held", "toxic").unionByName(texts, allowMissingColumns=True)
    tasks = min(4 * shards, 16 * spark.sparkContext.defaultParallelism) if shards > 1 else 1
    # Of the rows of a doc_id that with the smallest hash is learned from.
    order = ["shard", F.xxhash64("doc_id"), "doc_id", F.col("toxic").isNull(), F.xxhash64("text", "lang"), "text", "lang"]
    rows = (
        dealt.repartition(tasks, "shard")
        .sortWithinPartitions(*order)
        .mapInArrow(lambda p: released(_tokenized(p)), "shard int, held boolean, toxic int, lang string, words binary")
        .persist(StorageLevel.DISK_ONLY)
    )
    try:
        model = Classifier(_net(rows.filter(~F.col("held")), shards, train), _languages(rows), np.zeros(1))
        model.thresholds = np.zeros(model.langs.shape[1])
        model.thresholds = _thresholds(rows.filter("held"), model)
    finally:
        rows.unpersist()
    return model


def toxicity_of(text: Column, model: Classifier) -> Column:
    spark = SparkSession.active()
    long_texts(spark)
    shared = spark.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = shared.value.scorer()
        return released(pa.array(scorer.score(texts), pa.float64()) for texts in parts)

    return F.arrow_udf(scores, T.DoubleType(), F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(text)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with score and predicted, in the place of columns of these names."""
    own = free_name(docs, "score")
    scored = docs.withColumn(own, toxicity_of(F.col("text"), model))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return scored.select(
        *map(quoted, kept), F.col(own).alias("score"), (F.col(own) >= 0.5).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, model: Classifier) -> DataFrame:
    """The documents that are not predicted to be toxic."""
    return docs.filter(toxicity_of(F.col("text"), model) < 0.5)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = trained(docs, table(spark, folder, "labels"))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
