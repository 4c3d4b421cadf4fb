"""Near duplicates: SimHash, small-world graphs over Hamming distance, verified edges.

A document is the set of its five-word shingles; two are near duplicates where
the sets' Jaccard similarity is 0.8 or more, and classes are the connected
components. Documents of equal sets are one. The others are dealt to shards of
about 1,000 by pairs of min-hashes (eight keys each, which all fail to bring
together a pair of similarity 0.8 with a chance of 0.0003). Each shard links its
documents' 128-bit SimHashes in a navigable small-world graph, and every
document of the shard is a query to it. A query whose beam is full of candidates
is asked again with a wider one, the widest being the whole shard. The recall of
the beams is audited against exact search of a sample in every shard; where it
falls short, the shard is searched again with wider beams. A pair counts only
once its sets are compared. Shards give the edges that join something, at most
one fewer than they have documents, and what their audits counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import words_of
from .shared import Scratch, claim, unused
from .smallworld import SmallWorld

SHINGLE, SIMILAR = 5, 0.8
KEYS, ROWS = 8, 2
#: Bits that may differ between candidates of 128. At similarity 0.8 about 19 do, with a deviation of 4; between strangers 64.
BITS = 44
#: Documents in a shard, as planned; a key of more than SHARD has shards of its own.
PLANNED, SHARD = 1024, 2048
#: The beams; queries audited in each shard, and the recall below which its beams widen.
BEAMS, AUDITED, GOAL = (16, 32, 64, 128), 16, 0.95
#: Bits of the maps that bound similarities from above, at most; about four times the mean set's size.
WIDEST = 1 << 17

_RNG = np.random.default_rng(20240501)
_MULTIPLY = _RNG.integers(1, 1 << 63, KEYS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, KEYS * ROWS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """x's values once each, in order; x is sorted in place."""
    x.sort()
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles, in lower case; of fewer words one of them all, of none nothing."""
    words = words_of((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return distinct(out)


def simhash(s: np.ndarray) -> bytes:
    both = np.stack([mix(s + np.uint64(1)), mix(s + np.uint64(2))], 1)
    ones = np.zeros(128, np.int64)
    for at in range(0, len(s), 4096):
        ones += np.unpackbits(both[at : at + 4096].view(np.uint8), axis=1).sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(s)).tobytes()


def keys(s: np.ndarray) -> list[int]:
    """One key for each pair of min-hashes."""
    low = np.stack([mix(s[at : at + 2048] * _MULTIPLY[:, None] + _ADD[:, None]).min(1) for at in range(0, len(s), 2048)]).min(0).reshape(KEYS, ROWS)
    mixed = mix(low[:, 0] * np.uint64(31) + low[:, 1] + np.arange(KEYS, dtype=np.uint64))
    return mixed.view(np.int64).tolist()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, the text's tag, and of its set the hash (null: no word), SimHash and keys of docs(doc_id, text); nothing of the text itself."""

    def make(batches):
        claim("simhash_dedup", lambda: None)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out: list[list] = [[], [], []]
                for text in part.column("text").to_pylist():
                    s = shingles(text)
                    row = (xxhash.xxh128_digest(s.tobytes()), simhash(s), keys(s)) if len(s) else (None, None, None)
                    for col, x in zip(out, row):
                        col.append(x)
                types = [pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), *[pa.array(x, t) for x, t in zip(out, types)]], names=["doc_id", "tag", "same", "bits", "keys"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(make, "doc_id long, tag long, same binary, bits binary, keys array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """The hash of each text's set, and the set as 32-bit hashes (sorted, little-endian), for comparing."""

    def make(batches):
        claim("simhash_dedup", lambda: None)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [shingles(t) for t in batch.column("text").slice(at, 256).to_pylist()]
                raw = [distinct((s >> np.uint64(32)).astype("<u4")).tobytes() for s in own]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(s.tobytes()) for s in own], pa.binary()), pa.array(raw, pa.binary())], names=["same", "set"])

    return docs.select("text").mapInArrow(make, "same binary, set binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(2, dtype=np.int64)


class Shard:
    """Documents of one shard: which belong together, by verified pairs only. Only the first `count` are in its graph; if not all are, the others ask."""

    def __init__(self, bits: np.ndarray, sets: list[np.ndarray], count: int | None = None):
        self.bits, self.sets, self.count = bits, sets, len(sets) if count is None else count
        self.root, self.edges, self.failed = np.arange(len(sets)), [], set()
        self.sizes = np.array([len(s) for s in sets])
        self.width = min(WIDEST, max(64, 1 << int(4 * self.sizes.mean()).bit_length()))
        self.maps, self.mapped = np.zeros((len(sets), self.width // 64), np.uint64), np.zeros(len(sets), bool)

    def possible(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether these pairs may be similar, by their maps; never false of a pair that is.

        In a map every element of a set flips the bit that its hash names, so that
        two maps differ in no more bits than the sets do in elements.
        """
        for side in (rows, others):
            for x in np.unique(side[~self.mapped[side]]) if not self.mapped[side].all() else ():
                self.maps[x] = np.packbits((np.bincount(self.sets[x] & np.uint32(self.width - 1), minlength=self.width) & 1).astype(bool)).view(np.uint64)
                self.mapped[x] = True
        apart, step = np.empty(len(rows), np.int64), max(1, (1 << 25) // self.width)
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            apart[part] = np.bitwise_count(self.maps[rows[part]] ^ self.maps[others[part]]).sum(1, dtype=np.int64)
        # Sets of s elements together that differ in d have a similarity of (s - d) / (s + d).
        return (1 + SIMILAR) * apart <= (1 - SIMILAR) * (self.sizes[rows] + self.sizes[others]) + 1e-3

    def try_pairs(self, rows: np.ndarray, others: np.ndarray, again: bool = True) -> None:
        """Compare the pairs that are not joined, in this order. again: they may come once more, so those that fail are remembered."""
        apart = self.root[rows] != self.root[others]
        rows, others = rows[apart], others[apart]
        some = self.possible(rows, others) if len(rows) else apart[:0]
        for a, b in zip(rows[some].tolist(), others[some].tolist()):
            if self.root[a] == self.root[b] or (pair := (min(a, b), max(a, b))) in self.failed:
                continue
            if similarity(self.sets[a], self.sets[b]) >= SIMILAR:
                self.root[self.root == self.root[b]] = self.root[a]
                self.edges.append(pair)
            elif again:
                self.failed.add(pair)

    def audit(self, world: SmallWorld, sample: np.ndarray, beam: int) -> tuple[int, int]:
        """Candidates that the sample's rows have by exact search, and how many of them a beam of this width finds; a full one is asked again."""
        exact = hamming(self.bits[sample][:, None], self.bits[None, : self.count]) <= BITS
        exact &= sample[:, None] != np.arange(self.count)
        ids, dist = self.ask(world, sample, beam)
        hit = np.zeros((len(sample), self.count + 1), bool)
        np.put_along_axis(hit, np.where(ids < 0, self.count, ids), True, 1)
        hit[(dist <= BITS).all(1)] = True
        return int(exact.sum()), int((exact & hit[:, :-1]).sum())

    def ask(self, world: SmallWorld, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return world.search(self.bits[rows], beam, rows if self.count == len(self.sets) else None)

    def link(self) -> tuple[list[tuple[int, int]], tuple[int, int]]:
        """Verified pairs that join the shard's documents as far as they belong together, and the audit's counts."""
        asking = np.arange(0 if self.count == len(self.sets) else self.count, len(self.sets))
        world = SmallWorld(self.bits[: self.count], hamming)
        sample = asking[np.unique(np.linspace(0, len(asking) - 1, AUDITED).astype(int))]
        for beam in BEAMS:
            want, got = self.audit(world, sample, beam)
            if got >= GOAL * want:
                break
        while len(asking):
            full = []
            for at in range(0, len(asking), 512):
                rows = asking[at : at + 512]
                ids, dist = self.ask(world, rows, beam)
                row, col = np.nonzero(dist <= BITS)
                order = np.argsort(dist[row, col], kind="stable")
                self.try_pairs(rows[row[order]], ids[row[order], col[order]])
                full.append(rows[(dist <= BITS).all(1)])
            asking, beam = np.concatenate(full), 4 * beam
            if beam > BEAMS[-1]:
                break
        # The widest beam, for queries that are still full: all nodes that are not joined to them yet, and were not compared with them as queries.
        left = np.ones(self.count, bool)
        for row in asking.tolist():
            near = np.flatnonzero(left & (self.root[: self.count] != self.root[row]))
            near = near[hamming(self.bits[None, None, row], self.bits[None, near])[0] <= BITS]
            self.try_pairs(np.full(len(near), row), near, again=False)
            if row < self.count:
                left[row] = False
        return self.edges, (want, got)


def edges(reps: DataFrame, docs: DataFrame, scratch: Scratch, shard: int = SHARD, planned: int = PLANNED) -> DataFrame:
    """Verified pairs (a, b) of sets' hashes that connect what is near, and with null hashes a row of each shard's audit: candidates wanted and got.

    reps has a row per distinct set, docs the texts by doc_id.
    """
    dealt = scratch.keep(reps.select("doc_id", "same", "bits", F.posexplode("keys").alias("k", "key")), "dealt")
    counts = dealt.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Merge joins are asked for, so that the plan (and what it writes) is the same at every size.
    shared = scratch.keep(dealt.join(counts.hint("merge"), ["k", "key"]), "shared")
    sets = sets_of(docs.join(shared.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
    shards = max(1, -(-shared.where(F.col("n") <= shard).count() // planned))
    # Keys share a shard, as they fall; one of more than `shard` documents is cut into blocks instead, and each document meets every block of it once.
    key = F.xxhash64("k", "key")
    blocks = F.ceil(F.col("n") / shard).cast("int")
    mine = F.pmod(F.xxhash64("same"), blocks).cast("int")
    name = F.when(F.col("n") <= shard, F.pmod(key, F.lit(shards))).otherwise(-1 - F.pmod(key, F.lit(1 << 62)))
    placed = shared.select("same", "bits", name.alias("shard"), mine.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("met"))
    # A document that several keys put into one shard is there once; so are texts whose sets are equal.
    once = placed.select("same", "bits", "shard", "own", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high")).repartition("same").dropDuplicates(["same", "shard", "low", "high"])
    full = once.join(sets.dropDuplicates(["same"]).hint("merge"), "same")
    ordered = full.select("shard", "low", "high", "own", "same", "bits", "set").repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high", "own", "same")

    def flush(rows: list[tuple]) -> list[tuple]:
        if not rows:
            return []
        (_, low, high), bits = rows[0][0], np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(-1, 2)
        # Of two blocks, the first is the graph and the second asks.
        count = sum(r[1] == low for r in rows) if low != high else len(rows)
        if not 0 < count or low != high and count == len(rows):
            return []
        found, (want, got) = Shard(bits, [np.frombuffer(r[4], "<u4") for r in rows], count).link()
        return [(rows[a][2], rows[b][2], None, None) for a, b in found] + [(None, None, want, got)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["a", "b", "want", "got"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for s, low, high, own, same, bits, raw in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if held and held[0][0] != (s, low, high):
                    out += flush(held)
                    held = []
                held.append(((s, low, high), own, same, bits, raw))
            yield table(out)
        yield table(flush(held))

    return ordered.mapInArrow(run, "a binary, b binary, want long, got long")


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """id and class (the smallest id connected) of all ids in pairs.

    Rounds of hooking every id to its smallest neighbour, following pointers,
    and contracting the pairs; each round is written, so lineage stays short.
    """
    pairs = scratch.keep(pairs.where("a <> b"), "pairs0")
    labels = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("class", F.col("id")), "labels0")
    step = 0
    while not pairs.isEmpty():
        step += 1
        both = pairs.union(pairs.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        for jump in range(3):
            far = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
            parent = scratch.keep(parent.join(far, "up", "left").select("id", F.coalesce("top", "up").alias("up")), f"parent{step}-{jump}")
        to = parent.select(F.col("id").alias("class"), "up")
        labels = scratch.keep(labels.join(to, "class", "left").select("id", F.coalesce("up", "class").alias("class")), f"labels{step}")
        up = lambda c: parent.select(F.col("id").alias(c), F.col("up").alias(f"{c}2"))
        moved = pairs.join(up("a"), "a").join(up("b"), "b").where("a2 <> b2")
        pairs = scratch.keep(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"pairs{step}")
    return labels


def labelled(docs: DataFrame, shard: int = SHARD, planned: int = PLANNED) -> tuple[DataFrame, DataFrame]:
    """A row per row of docs: doc_id, tag, root (the class: one of its sets' hashes; null: no word) and class_id; and the audits: shards, candidates wanted and got."""
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.keep(signatures(docs), "signatures")
    # The min of a struct is partial before the shuffle, so thousands of copies are no load; bits and keys are equal in all.
    reps = scratch.keep(signed.where("same IS NOT NULL AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"), F.first("keys").alias("keys")), "reps")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.keep(edges(reps, texts, scratch, shard, planned), "edges")
    pairs = found.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    joined = components(pairs, scratch).withColumnsRenamed({"id": "same", "class": "root"})
    rooted = scratch.keep(reps.select("same", "doc_id").join(joined, "same", "left").select("same", "doc_id", F.coalesce("root", "same").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("class"))
    named = rooted.select("same", "root").join(first, "root")
    out = signed.select("doc_id", "tag", "same").join(named, "same", "left").select("doc_id", "tag", "root", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"))
    return out, found.where("a IS NULL").agg(F.count("*").alias("shards"), F.sum("want").alias("wanted"), F.sum("got").alias("got"))


def classes(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id and class_id (the class's smallest doc_id), a row per row of docs(doc_id, text).

    Documents without a word, null texts included, are classes of their own;
    a null doc_id has a null class. Rows that share a doc_id are judged each by
    its own text. Other columns are left out, and an empty table stays empty.
    """
    return labelled(docs, shard)[0].select("doc_id", "class_id")


def keep_one(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """docs without all but one document of each class: that with the smallest doc_id (of texts that share it, the smallest hash), of equal rows one.

    Documents without a word stay, and so do those with a null doc_id.
    """
    found = labelled(docs, shard)[0].where("doc_id IS NOT NULL")
    best = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("x")).select("x.*")
    stay = best.union(found.where("root IS NULL").select("doc_id", "tag")).distinct().hint("merge")
    tag, here, there = (unused(docs.columns, x) for x in ("tag", "id", "with"))
    some = docs.where("doc_id IS NOT NULL").withColumns({tag: F.xxhash64("text"), here: F.col("doc_id").cast("long")})
    some = some.join(stay.select(F.col("doc_id").alias(there), F.col("tag").alias(f"{there}_tag")), F.expr(f"`{here}` = `{there}` AND `{tag}` = `{there}_tag`"), "left_semi")
    return some.dropDuplicates([here, tag]).drop(here, tag).unionByName(docs.where("doc_id IS NULL"))
