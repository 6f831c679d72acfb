"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the distinct 4-word shingles of its whole text (words as
in ``words.spaced``; with fewer words the whole sequence is the one shingle).  Two
documents are linked when their sets' similarity is ``SHARE`` percent or more.

1. Shingles are hashed in tasks over the documents.  Documents with equal sets in a
   chunk are led by one.  Shingles go, packed by range of hash, to the tasks that
   count in how many different sets each occurs, and what occurs in more than one
   comes back to its chunk.  A shingle that very many documents of a chunk have goes there
   once for all of them.
2. Tokens are ordered by that number, rare ones first.  A set of n tokens has to share
   ceil(0.85 n) of them, so one shared token is among its first
   p = n - ceil(0.85 n) + 1.  Tokens of no other set take up u of these places; with
   u >= p the set has no partner.
3. Prefix tokens that occur in at most ``FREQUENT`` sets are indexed one by one.  If two
   linked sets share none of these in their prefixes, all they share is frequent, and the first two
   tokens they share are both among the first p + 1: so pairs of the frequent tokens
   there are indexed.  Pairs grow with the square of a set's prefix: from ``LONG`` shingles on, frequent tokens are
   indexed one by one too, and sets whose partners may be on the other side of that size are indexed both ways.  A
   key carries its room: the most tokens two sets can share of which those of the key are the first.
4. Candidates are verified on their shared tokens, which hold every possible
   intersection.  First the set with the fewest unshared tokens on each index key is
   compared with the others there.  What is linked by then needs no more
   comparing; at last all pairs that share a key and are not yet linked together are
   compared, if sizes and unshared tokens let them be similar at all.

Equal sets are one class, whose id is its smallest doc_id; components are formed of
classes.  So copies are never expanded into pairs, and no link between different
texts is lost.  Hashes have 64 bits where sets are measured and 40 bits plus their
range where tokens are matched; a false match within a pair has a chance near 1e-8.

Null text and text without words have an empty set and are linked with nothing.
A row without doc_id links with nothing and has no component.  Rows with the same doc_id
count as one document for the component.  Repeated rows stay rows of the result.
Other columns are not read by ``join``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .components import components
from .tables import long_texts, table, written
from .words import mixed, spaced
from .workers import release, released

WORDS = 4
SHARE = 85
FREQUENT = 1024
#: Shingles from which on a set's frequent tokens are not paired: up to there they make some 2000 pairs at most.
LONG = 400
#: Bytes of text for each range of hashes: some 2 million shingles.
RANGE_BYTES = 12_000_000
CHUNK = 1_000_000  # shingles
#: From so many sets of a chunk on, a shingle is sent once for the chunk.
HEAVY = 16
#: Links and labels are written as a file for so many shared tokens of all sets, and ``FILES`` at least.
FILE_TOKENS = 20_000_000
FILES = 8
_LOW = np.uint64((1 << 40) - 1)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)

PACKED = (
    "range long, chunk long, kind int, ords binary, counts binary, sigs binary, tokens binary,"
    " heavy binary, numbers binary, head binary, own_chunk long"
)
SETS = (
    "doc_id long, n long, s1 long, s2 long, u long, shared binary,"
    " keys array<struct<key:long,room:long>>"
)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all shingles of one text, in order."""
    n = len(words)
    m = min(n, WORDS)
    if not m:
        return words
    total = np.zeros(n - m + 1, np.uint64)
    for k in range(m):
        total += words[k : n - m + 1 + k] * np.uint64(_FACTORS[k])
    return mixed(total + np.uint64(m))


def _five(tokens: np.ndarray) -> bytes:
    """The low 40 bits of each token."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


class _Chunk:
    def __init__(self, number: int, ranges: int) -> None:
        self.number, self.ranges = number, ranges
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.sigs: list[tuple[int, int]] = []
        self.leads: list[bool] = []
        self.seen: set[tuple[int, int, int]] = set()
        self.sets: list[np.ndarray] = []
        self.owners: list[int] = []
        self.load = 0

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        tokens = np.unique(tokens)
        s1 = int(np.add.reduce(mixed(tokens ^ np.uint64(_FACTORS[0])))) if len(tokens) else 0
        s2 = int(np.add.reduce(mixed(tokens ^ np.uint64(_FACTORS[1])))) if len(tokens) else 0
        key = (len(tokens), s1, s2)
        lead = doc_id is not None and len(tokens) > 0 and key not in self.seen
        if lead:
            self.seen.add(key)
            self.sets.append(tokens)
            self.owners.append(len(self.ids))
            self.load += len(tokens)
        self.ids.append(doc_id)
        self.sizes.append(len(tokens))
        self.sigs.append((s1, s2))
        self.leads.append(lead)

    def rows(self) -> Iterator[dict]:
        tokens = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.array(self.owners, np.uint32), [len(x) for x in self.sets])
        where = ((tokens >> np.uint64(40)) % np.uint64(self.ranges)).astype(
            np.uint16 if self.ranges <= 1 << 16 else np.uint32
        )
        low = tokens & _LOW
        # What very many sets of this chunk have is told apart first.
        full = (where.astype(np.uint64) << np.uint64(40)) | low
        order = np.argsort(full, kind="stable")
        ranked = full[order]
        begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
        size = np.diff(np.append(begin, len(ranked)))
        many = size >= HEAVY
        heavy, heavy_size = ranked[begin[many]], size[many]
        is_heavy = np.repeat(many, size)
        heavy_owner = owner[order[is_heavy]]
        light = np.zeros(len(tokens), bool)
        light[order[~is_heavy]] = True
        sig = np.array([s for s, _ in self.sigs], np.uint64)
        head = {
            "ids": np.array([x or 0 for x in self.ids], np.int64),
            "has_id": np.array([x is not None for x in self.ids], np.uint8),
            "sizes": np.array(self.sizes, np.int64),
            "s1": sig.view(np.int64),
            "s2": np.array([s for _, s in self.sigs], np.uint64).view(np.int64),
            "leads": np.array(self.leads, np.uint8),
            "heavy": heavy.view(np.int64),
            "heavy_size": heavy_size.astype(np.int64),
            "heavy_owner": heavy_owner.astype(np.int64),
        }
        yield {"range": self.number % self.ranges, "kind": 1, "head": _packed(head)}
        where, low, owner = where[light], low[light], owner[light]
        order = np.argsort(where, kind="stable")  # owners stay in order within a range
        where, low, owner = where[order], low[order], owner[order]
        heavy_range = (heavy >> np.uint64(40)).astype(np.int64)
        some = np.union1d(where, heavy_range)  # a chunk has no row for a range that it has nothing of
        cuts = np.stack([np.searchsorted(where, some, side) for side in ("left", "right")], axis=1).tolist()
        heavy_cuts = np.stack([np.searchsorted(heavy_range, some, side) for side in ("left", "right")], axis=1).tolist()
        for r, (a, b), (c, d) in zip(some.tolist(), cuts, heavy_cuts, strict=True):
            own = owner[a:b]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if b > a else np.zeros(0, int)
            yield {
                "range": r,
                "kind": 0,
                "ords": own[first].astype("<u4").tobytes(),
                "counts": np.diff(np.append(first, b - a)).astype("<u4").tobytes(),
                "sigs": sig[own[first]].tobytes(),
                "tokens": _five(low[a:b]),
                "heavy": _five(heavy[c:d] & _LOW),
                "numbers": heavy_size[c:d].astype("<u4").tobytes(),
            }


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    names = list(arrays)
    return pa.record_batch(
        [pa.array([v.tobytes() for v in arrays.values()], pa.binary()), pa.array(names)], ["data", "name"]
    ).serialize().to_pybytes()


_HEAD = pa.schema([("data", pa.binary()), ("name", pa.string())])


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    got = pa.ipc.read_record_batch(pa.py_buffer(raw), _HEAD)
    kinds = {"has_id": np.uint8, "leads": np.uint8}
    return {
        name: np.frombuffer(data, kinds.get(name, np.int64))
        for name, data in zip(got["name"].to_pylist(), got["data"].to_pylist(), strict=True)
    }


_BLOBS = ("ords", "counts", "sigs", "tokens", "heavy", "numbers", "head")


def _row(chunk: int, row: dict) -> pa.RecordBatch:
    values = [[row["range"]], [chunk], [row["kind"]], *[[row.get(k)] for k in _BLOBS], [chunk]]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * len(_BLOBS), pa.int64()]
    names = ["range", "chunk", "kind", *_BLOBS, "own_chunk"]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names
    )


def _chunks(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    hasher = spaced()
    base = TaskContext.get().partitionId() << 24
    chunk = _Chunk(base, ranges)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, j, words, at in hasher.pieces(texts):
            for k in range(i, j):
                chunk.add(ids[k], shingles(words[at[k - i] : at[k - i + 1]]))
                if chunk.load >= CHUNK:
                    for row in chunk.rows():
                        yield _row(chunk.number, row)
                    chunk = _Chunk(chunk.number + 1, ranges)
    if chunk.ids:
        for row in chunk.rows():
            yield _row(chunk.number, row)


def _shared(group: pa.Table) -> pa.Table:
    """Of one range: what each chunk has that occurs in more than one set, and in how many."""
    rows = group.to_pylist()
    light = [r for r in rows if r["kind"] == 0]
    tokens = [_from_five(r["tokens"]) for r in light]
    counts = [np.frombuffer(r["counts"], "<u4") for r in light]
    sigs = [np.frombuffer(r["sigs"], np.uint64) for r in light]
    heavy = [_from_five(r["heavy"]) for r in light]
    numbers = [np.frombuffer(r["numbers"], "<u4") for r in light]
    every = np.concatenate([*tokens, np.zeros(0, np.uint64)])
    ranked = np.sort(every)
    again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    hot, which = np.unique(np.concatenate([*heavy, np.zeros(0, np.uint64)]), return_inverse=True)
    hot_number = np.bincount(which, np.concatenate([*numbers, np.zeros(0)]), len(hot)).astype(np.int64)
    maybe = np.union1d(again, hot)
    # Different sets of each of these.
    places, owners = [], []
    picks = []
    for t, c, s in zip(tokens, counts, sigs, strict=True):
        at = np.searchsorted(maybe, t)
        at[at == len(maybe)] = 0
        pick = maybe[at] == t if len(maybe) else np.zeros(len(t), bool)
        picks.append(pick)
        places.append(at[pick])
        owners.append(np.repeat(s, c)[pick])
    place = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.concatenate([*owners, np.zeros(0, np.uint64)])
    order = np.lexsort((owner, place))
    place, owner = place[order], owner[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    number = np.bincount(place[new], minlength=len(maybe))
    number[np.searchsorted(maybe, hot)] += hot_number
    out = []
    for r, t, c, pick, h in zip(light, tokens, counts, picks, heavy, strict=True):
        df = np.zeros(len(t), np.int64)
        df[pick] = number[np.searchsorted(maybe, t[pick])]
        keep = df >= 2
        if not keep.any() and not len(h):
            continue
        first = np.cumsum(c, dtype=np.int64) - c
        per = np.add.reduceat(keep.astype(np.int64), first).astype("<u4") if len(c) else c
        some = per > 0
        out.append(
            r
            | {
                "ords": np.frombuffer(r["ords"], "<u4")[some].tobytes(),
                "counts": per[some].tobytes(),
                "sigs": df[keep].astype("<u4").tobytes(),
                "tokens": _five(t[keep]),
                "numbers": number[np.searchsorted(maybe, h)].astype("<u4").tobytes(),
            }
        )
    out += [r for r in rows if r["kind"] == 1]
    return pa.Table.from_pylist(out, group.schema)


def _sets(group: pa.Table) -> pa.Table:
    """Of one chunk: its documents, and of those that may have a partner the shared tokens and index keys."""
    rows = group.to_pylist()
    head = _unpacked(next(r["head"] for r in rows if r["kind"] == 1))
    owners, tokens, dfs, heavy, heavy_df = [], [], [], [], []
    for r in rows:
        if r["kind"] == 0:
            high = np.uint64(r["range"] << 40)
            ords = np.frombuffer(r["ords"], "<u4").astype(np.int64)
            owners.append(np.repeat(ords, np.frombuffer(r["counts"], "<u4")))
            tokens.append(_from_five(r["tokens"]) | high)
            dfs.append(np.frombuffer(r["sigs"], "<u4"))
            heavy.append(_from_five(r["heavy"]) | high)
            heavy_df.append(np.frombuffer(r["numbers"], "<u4"))
    none = np.zeros(0, np.uint64)
    heavy_all, heavy_all_df = np.concatenate([*heavy, none]), np.concatenate([*heavy_df, none.astype("<u4")])
    if len(heavy_all):
        order = np.argsort(heavy_all)
        own = head["heavy"].view(np.uint64)
        df = heavy_all_df[order][np.searchsorted(heavy_all[order], own)]
        owners.append(head["heavy_owner"])
        tokens.append(np.repeat(own, head["heavy_size"]))
        dfs.append(np.repeat(df, head["heavy_size"]))
    owner = np.concatenate([*owners, np.zeros(0, np.int64)])
    token = np.concatenate([*tokens, none])
    df = np.concatenate([*dfs, np.zeros(0, "<u4")]).astype(np.int64)
    m = len(head["ids"])
    n = head["sizes"]
    u = n - np.bincount(owner, minlength=m)
    p = n - (SHARE * n + 99) // 100 + 1
    may = (head["leads"] == 1) & (u < p)
    keep = may[owner]
    owner, token, df = owner[keep], token[keep], df[keep]
    order = np.lexsort((token, df, owner))
    owner, token, df = owner[order], token[order], df[order]
    cut = np.searchsorted(owner, np.arange(m + 1))
    shared: list[bytes | None] = [None] * m
    found: list[np.ndarray] = []
    found_rooms: list[np.ndarray] = []
    number = np.zeros(m + 1, np.int32)
    for i in np.flatnonzero(may):
        t, d = token[cut[i] : cut[i + 1]], df[cut[i] : cut[i + 1]]
        k = p[i] - u[i]
        rare = int(np.searchsorted(d[:k], FREQUENT, "right"))
        # Of two linked sets both or none have at least LONG shingles, or else both are near it.
        alone = min(k, len(t)) if 100 * n[i] >= SHARE * LONG else rare
        one, two = np.triu_indices(len(t[: k + 1]) - rare, 1) if SHARE * n[i] <= 100 * LONG else np.zeros((2, 0), np.int64)
        pairs = mixed(t[rare + one] * np.uint64(_FACTORS[2]) + mixed(t[rare + two]))
        rooms = np.concatenate([len(t) - np.arange(alone), len(t) - rare - two + 1])
        fits = 100 * rooms >= SHARE * n[i]  # a partner of the best size would do
        found.append(np.concatenate([t[:alone], pairs]).view(np.int64)[fits])
        found_rooms.append(rooms[fits])
        number[i + 1] = len(found[-1])
        shared[i] = np.sort(t).tobytes()
    flat = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), pa.int64()) for x in (found, found_rooms)]
    keys = pa.ListArray.from_arrays(
        pa.array(np.cumsum(number, dtype=np.int32)), pa.StructArray.from_arrays(flat, ["key", "room"]), mask=pa.array(~may)
    )
    return pa.table(
        {
            "doc_id": pa.array(head["ids"], pa.int64(), mask=head["has_id"] == 0),
            "n": pa.array(n),
            "s1": pa.array(head["s1"]),
            "s2": pa.array(head["s2"]),
            "u": pa.array(u),
            "shared": pa.array(shared, pa.binary()),
            "keys": keys,
        }
    )


def sets(docs: DataFrame) -> DataFrame:
    """All rows with the size and signature of their set; see ``SETS``."""
    long_texts(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, -(-size // RANGE_BYTES))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return released(_chunks(batches, ranges))

    def shared(group: pa.Table) -> pa.Table:
        try:
            return _shared(group)
        finally:
            release()

    def collected(group: pa.Table) -> pa.Table:
        try:
            return _sets(group)
        finally:
            release()

    packed = texts.mapInArrow(chunks, PACKED)
    counted = packed.groupBy("range").applyInArrow(shared, PACKED)
    return counted.groupBy("own_chunk").applyInArrow(collected, SETS)


def _overlap(a: Column, b: Column) -> Column:
    """Tokens that two sorted lists share."""

    def sizes(lists: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ones, twos in lists:
            yield pa.array(
                [
                    len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True))
                    for x, y in zip(ones.to_pylist(), twos.to_pylist(), strict=True)
                ],
                pa.int64(),
            )

    def count(lists: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return released(sizes(lists))

    return F.arrow_udf(count, T.LongType(), F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(a, b)


def _verified(pairs: DataFrame, classes: DataFrame, files: int) -> DataFrame:
    """The pairs (a, b) of ids that are linked."""
    side = lambda x: classes.select(
        F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"shared_{x}")
    )
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    both = joined.withColumn("both", _overlap(F.col("shared_a"), F.col("shared_b")))
    return written(
        both.filter(100 * F.col("both") >= SHARE * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"),
        "linked",
        files,
    )


def _possible(x: str, y: str) -> Column:
    """Whether two sets can be similar enough if the first tokens they share are the key's."""
    most = F.least(f"{x}.room", f"{y}.room")
    return 100 * most >= SHARE * (F.col(f"{x}.n") + F.col(f"{y}.n") - most)


def _star(index: DataFrame) -> DataFrame:
    """On each key, the set with the fewest unshared tokens with all others not yet linked to it."""
    centre = F.struct((F.col("u") / F.col("n")).alias("part"), "id", "n", "room", "label")
    centres = index.groupBy("key").agg(F.min(centre).alias("c")).select("key", "c.*").alias("c")
    return (
        index.alias("e")
        .join(centres, "key")
        .filter((F.col("e.label") != F.col("c.label")) & _possible("e", "c"))
        .select(F.least("e.id", "c.id").alias("a"), F.greatest("e.id", "c.id").alias("b"))
        .distinct()
    )


def links(classes: DataFrame, files: int) -> DataFrame:
    """Links (a, b) of classes that join all that are linked into the same components.

    ``classes``: id, n, u, shared, keys of the sets that may have a partner.  ``files``: of links and labels.
    """
    labelled = lambda index, labels: index.join(labels, "id", "left").withColumn(
        "label", F.coalesce("label", "id")
    )
    few = classes.select("id", "n", "u", F.inline(F.slice("keys", 1, 4)))
    found = _verified(_star(few.withColumn("label", F.col("id"))), classes, files)
    index = classes.select("id", "n", "u", F.inline("keys"))
    found = found.unionByName(_verified(_star(labelled(index, components(found, files))), classes, files))
    rest = written(labelled(index, components(found, files)), "index")
    open_keys = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    rest = rest.join(open_keys.select("key"), "key", "left_semi")
    x, y = rest.alias("x"), rest.alias("y")
    pairs = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & _possible("x", "y"))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )
    return found.unionByName(_verified(pairs, classes, files))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows = written(sets(docs), "sets")
    tokens = rows.agg(F.sum(F.col("n") - F.col("u"))).first()[0] or 0
    files = max(FILES, -(-tokens // FILE_TOKENS))
    slim = rows.select("doc_id", "n", "s1", "s2")
    kinds = (
        slim.filter("n > 0 AND doc_id IS NOT NULL")
        .groupBy("n", "s1", "s2")
        .agg(F.min("doc_id").alias("id"))
    )
    leaders = rows.filter("keys IS NOT NULL").groupBy("n", "s1", "s2").agg(
        *[F.first(c).alias(c) for c in ("u", "shared", "keys")]
    )
    classes = written(leaders.join(kinds, ["n", "s1", "s2"]).select("id", "n", "u", "shared", "keys"), "classes")
    placed = slim.join(kinds, ["n", "s1", "s2"], "left")
    # Rows with one doc_id and different texts bring their classes together.
    twice = (
        placed.filter("id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("id").alias("a"), F.collect_set("id").alias("all"))
        .filter(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .filter("a < b")
    )
    labels = components(links(classes, files).unionByName(twice), files)
    return placed.join(labels, "id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "id", "doc_id")).alias("component_id"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Of rows with that doc_id one stays, that with the smallest hash of its text and other
    columns, however rows are split or ordered; rows without a doc_id all do."""
    kept = join(docs).filter("doc_id = component_id").select("doc_id").distinct()
    stays = docs.join(kept, "doc_id", "left_semi")
    hashed = ["text"] + [c for c, kind in docs.dtypes if c not in ("text", "doc_id") and "map<" not in kind]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    by_hash = F.xxhash64(*[F.col(f"`{c}`") for c in hashed])
    one = stays.groupBy("doc_id").agg(F.min_by(row, by_hash).alias("row")).select("row.*")
    return one.unionByName(docs.filter("doc_id IS NULL"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return join(table(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents
), shingled AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM worded
), sizes AS (
    SELECT doc_id, len(s)::BIGINT AS n FROM shingled
), flat AS (
    SELECT doc_id, unnest(s) AS g FROM shingled
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), linked AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (
    SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sizes
    UNION
    SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other
)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id
FROM sizes s JOIN reached r USING (doc_id) GROUP BY ALL
"""
