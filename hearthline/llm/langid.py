"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text answers which strings occur in
it.  A text is read from left to right into phrases: each is the longest match
that the automaton holds, and the next begins where the match broke off (a letter
that the language does not have closes the phrase it ends).  With c phrases over
n characters and m characters of labelled text, c * log2(m) / n estimates the bits
a character costs; the language with the lowest cost wins, ties go to the lower
code.  The whole text is parsed; stretches are read side by side and then put together as one parse.

Texts are lower-cased; a run of anything but letters counts as one space.  All letters of
the labelled texts count, however many the languages have together.

The labelled text is a bounded sample: ``DOCS`` whole documents a language, those with
the smallest hash of doc_id and text of up to ``SHORT`` characters, then the shortest longer ones; what is
longer than ``LONGEST`` is not learned from.  Only these go to the driver and into the tasks.

Null text, and text without a letter, is ``und`` with score 0.  Rows without a
language are not learned from.  Where nothing can be learned from, every text is
``und``.  Repeated rows get equal answers.  The prediction is a column expression
on the text, so other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_name, long_texts, quoted, table
from .workers import released

#: Bounds of what is learned from, for each language: so many texts, whole; the first by hash of those up to
#: SHORT characters, then the shortest; none beyond LONGEST.
DOCS, SHORT, LONGEST = 32, 2_000, 100_000
STRETCH, SYNC = 1024, 128  # characters that are read side by side, and of these, kept to see where parses meet
LANES = 1 << 20  # normalised characters read at once
UNKNOWN = "und"
SPACE, ODD, _BREAK = 1, 0, 2
#: States of all languages times letters; beyond, steps are looked up by (state, letter).
DENSE = 1 << 25

RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``codes``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class _Steps:
    """Steps of automata that are too large to lay out: a hash table of (state, letter), with
    open places, that holds only the transitions there are."""

    def __init__(self, automata: list[list[dict[int, int]]], roots: list[int], width: int) -> None:
        total = sum(len(out) for moves in automata for out in moves)
        self.bits = max(4, (2 * total - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int64)
        #: [language, letter] where a phrase that begins with the letter stands after it.
        self.first = np.repeat(np.array(roots, np.int64)[:, None], width, 1)
        for i, (base, moves) in enumerate(zip(roots, automata, strict=True)):
            for c, to in moves[0].items():
                self.first[i, c] = base + to * width
            sizes = [len(out) for out in moves]
            letters = np.fromiter((c for out in moves for c in out), np.int64, sum(sizes))
            targets = np.fromiter((to for out in moves for to in out.values()), np.int64, sum(sizes))
            self._add(base + np.repeat(np.arange(len(moves)) * width, sizes) + letters, base + targets * width)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _add(self, keys: np.ndarray, to: np.ndarray) -> None:
        at = self._place(keys)
        while len(keys):
            # Of several for one open place the first takes it; the others look further.
            spots, one = np.unique(at, return_index=True)
            one = one[self.keys[spots] < 0]
            self.keys[at[one]], self.to[at[one]] = keys[one], to[one]
            left = np.ones(len(keys), bool)
            left[one] = False
            keys, to, at = keys[left], to[left], (at[left] + 1) & (len(self.keys) - 1)

    def step(self, state: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states [language, text], and whether a phrase ended."""
        keys = (state + letters).ravel()
        at = self._place(keys)
        held = self.keys.take(at)
        look = np.flatnonzero((held != keys) & (held >= 0))
        while len(look):
            at[look] = (at[look] + 1) & (len(self.keys) - 1)
            held[look] = now = self.keys.take(at[look])
            look = look[(now != keys[look]) & (now >= 0)]
        hit = (held == keys).reshape(state.shape)
        return np.where(hit, self.to.take(at).reshape(state.shape), self.first[:, letters]), ~hit


class CrossParser:
    """``sample``: language to its labelled texts."""

    def __init__(self, sample: dict[str, list[str]]) -> None:
        self.langs = sorted(sample)
        letters = sorted({c for texts in sample.values() for t in texts for c in t.lower() if c.isalpha()})
        width = len(letters) + 3
        self.unseen = width
        self.code = np.full(0x110000, self.unseen, np.min_scalar_type(self.unseen))
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 3
        automata, self.bits = [], []
        for lang in self.langs:
            codes: list[int] = []
            for t in sample[lang]:
                codes += [_BREAK, *self.normal(t).tolist()]
            automata.append(suffix_automaton(codes))
            self.bits.append(np.log2(max(2, len(codes))))
        # A state is the place of its row, were all rows of all languages laid end to end.
        ends = np.cumsum([0] + [len(moves) * width for moves in automata])
        self.roots = ends[:-1].tolist()
        self.table: _Steps | None = None
        if ends[-1] > DENSE:
            self.table = _Steps(automata, self.roots, width)
            self.steps = np.zeros(0, np.int64)
            return
        flat = []
        for base, moves in zip(self.roots, automata, strict=True):
            # A step holds the next state's row and, in the last bit, whether a phrase ended.
            steps = np.empty((len(moves), width), np.int64)
            steps[:] = base * 2 + 1
            for c, to in moves[0].items():
                steps[:, c] = (base + to * width) * 2 + 1
            for state, out in enumerate(moves):
                for c, to in out.items():
                    steps[state, c] = (base + to * width) * 2
            flat.append(steps.ravel())
        steps = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.steps = steps.astype(np.int32) if 2 * ends[-1] < 2**31 else steps

    def normal(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        if (fresh := codes == self.unseen).any():
            for p in np.unique(points[fresh]):
                self.code[p] = ODD if chr(p).isalpha() else SPACE
            codes = self.code[points]
        return codes[_keep(codes == SPACE)]

    def _step(self, state: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states [language, text], and whether a phrase ended."""
        if self.table:
            return self.table.step(state, letters)
        step = self.steps.take(state + letters)
        return step >> 1, step & 1

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[language, text] numbers of phrases.

        Texts are cut into stretches that are parsed side by side, each as if a phrase began there.
        Then all but first stretches are entered again with the state that the one before has left.
        Soon both ways are at the same point of the same phrase, and from there on they agree; where they do not and the
        stretch ends otherwise than before, the next one is entered once more."""
        first = np.cumsum([0] + [-(-len(t) // STRETCH) for t in texts])
        parts = [t[a : a + STRETCH] for t in texts for a in range(0, len(t), STRETCH)]
        order = np.argsort([-len(x) for x in parts], kind="stable")
        sizes = np.array([len(parts[i]) for i in order])
        lanes = np.zeros((sizes[0], len(parts)), np.int32)
        for j, i in enumerate(order.tolist()):
            lanes[: sizes[j], j] = parts[i]
        roots = np.array(self.roots, self.steps.dtype)[:, None]
        state = np.repeat(roots, len(parts), 1)
        count = np.zeros((len(self.langs), len(parts)), np.int32)
        trail = np.zeros((min(SYNC, sizes[0]), *state.shape), state.dtype)
        counts = np.zeros(trail.shape, np.int16)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # stretches longer than t
        for t, k in enumerate(active.tolist()):
            state[:, :k], ended = self._step(state[:, :k], lanes[t, :k])
            count[:, :k] += ended
            if t < len(trail):
                trail[t], counts[t] = state, count
        lane = np.empty(len(parts), np.int64)
        lane[order] = np.arange(len(parts))
        count, end, sizes = count[:, lane].astype(np.int64), state[:, lane], sizes[lane]
        left, whole = end.copy(), count.copy()
        heads = np.zeros(len(parts) + 1, bool)
        heads[first] = True
        todo = np.flatnonzero(~heads[:-1])
        while len(todo):
            now, seen = left[:, todo - 1], np.zeros((len(roots), len(todo)), np.int64)
            stop, live, own = now.copy(), np.ones(now.shape, bool), np.arange(len(todo))
            for t in range(int(sizes[todo].max())):
                own = own[live[:, own].any(axis=0) & (t < sizes[todo[own]])]
                if not len(own):
                    break
                part = todo[own]
                after, ended = self._step(now[:, own], lanes[t, lane[part]])
                now[:, own] = after
                going = live[:, own]
                more = np.where(going, ended, 0)
                if t < len(trail):
                    met = going & (after == trail[t][:, lane[part]])
                    more += np.where(met, count[:, part] - counts[t][:, lane[part]], 0)
                    stop[:, own] = np.where(met, end[:, part], stop[:, own])
                    live[:, own] = going & ~met
                seen[:, own] += more
            stop = np.where(live, now, stop)
            whole[:, todo] = seen
            other = todo[(stop != left[:, todo]).any(axis=0)]
            left[:, todo] = stop
            todo = other[~heads[other + 1]] + 1
        total = np.add.reduceat(whole, first[:-1], axis=1)
        return total + (left[:, first[1:] - 1] != roots)

    def costs(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
        """(which texts, [language, text] costs) in portions of about ``LANES`` characters."""
        kept: list[int] = []
        stretches: list[np.ndarray] = []
        load = 0
        for i, text in enumerate(texts):
            codes = self.normal(text) if text else np.zeros(0, np.uint8)
            if (codes != SPACE).any():
                stretches.append(codes)
                kept.append(i)
                load += len(codes)
            if load >= LANES or (i == len(texts) - 1 and kept):
                sizes = np.array([len(c) for c in stretches])
                yield kept, self.phrases(stretches) * np.array(self.bits)[:, None] / sizes
                kept, stretches, load = [], [], 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        for which, costs in self.costs(texts):
            best = costs.argmin(axis=0)
            two = np.sort(costs, axis=0)[:2]
            margin = 1 - two[0] / two[1] if len(self.langs) > 1 else np.ones(len(which))
            for k, i in enumerate(which):
                langs[i], scores[i] = self.langs[best[k]], float(margin[k])
        return langs, scores


def _keep(space: np.ndarray) -> np.ndarray:
    """All but the spaces that follow a space."""
    keep = np.ones(len(space), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return keep


def _answers(parts: Iterator[pa.Array], sample: dict[str, list[str]]) -> Iterator[pa.Array]:
    parser = CrossParser(sample)
    for texts in parts:
        langs: list[str] = []
        scores: list[float] = []
        for a in range(0, len(texts), 512):
            some = parser.predict(texts.slice(a, 512).to_pylist())
            langs += some[0]
            scores += some[1]
        yield pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"]
        )


def labelled_sample(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """At most ``DOCS`` texts, as they are, of each language of ``docs``."""
    size = F.char_length(text)
    chosen = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (size <= LONGEST)).select(
        F.col(lang).alias("lang"),
        F.col(text).alias("part"),
        F.greatest(size, F.lit(SHORT)).alias("size"),
        F.xxhash64("doc_id", text).alias("order"),
    )
    by_hash = Window.partitionBy("lang").orderBy("size", "order", "part")
    rows = chosen.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= DOCS)
    sample: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "place").collect():
        sample.setdefault(r.lang, []).append(r.part)
    return sample


def language_of(text: Column, sample: dict[str, list[str]]) -> Column:
    """struct(lang, score) of a text."""

    def answers(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(_answers(parts, sample))

    long_texts(SparkSession.active())
    return F.arrow_udf(answers, RESULT, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(text)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """``docs`` with lang_pred and score, in the place of columns of these names."""
    own = free_name(docs, "found")
    found = docs.withColumn(own, language_of(F.col("text"), sample))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return found.select(
        *map(quoted, kept), F.col(f"{own}.lang").alias("lang_pred"), F.col(f"{own}.score").alias("score")
    )


def known(docs: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """The documents whose language can be told."""
    return docs.filter(language_of(F.col("text"), sample)["lang"] != UNKNOWN)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    sample = labelled_sample(docs.filter(~is_held_out()))
    found = identify(docs.select("doc_id", "text"), sample)
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
