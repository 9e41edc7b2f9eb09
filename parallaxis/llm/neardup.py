"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Every document's set of word shingles is hashed (64 bits); the minima under HASHES functions give band keys of
   a few minima each (band_rows), and BITS low bits of every minimum are packed into four longs. Sets aren't kept.
2. Documents with equal sets are one class with a number (aggregated before the shuffle), so copies never meet as pairs.
   Buckets are rows of a band key and a class number; those with one class only go before anything else is known of them.
3. In each band bucket every class is paired with the first and the last class of the bucket; pairs that differ get
   their signatures, whose packed bits give the share of equal minima by counting bits, corrected for chance collisions. The TRIED
   likeliest pairs of a class are confirmed on full sets, which are made again from the texts of just these classes.
4. Where a bucket still holds different components, all pairs across them are decided too, within a join: those whose
   estimate is further below the threshold than SLACK standard errors are out, the others are compared by full sets.
   Only links come out. Pairs within a component can't change it and are left alone. So all pairs that share a
   bucket are either decided or connected already.

A pair at the threshold shares no band with a probability of at most MISSED, and less above it: at 0.85, 16 bands of 4
minima miss (1 - 0.85^4)^16 = 7e-6; at 0.8, 21 bands of 3 miss (1 - 0.8^3)^21 = 3e-7, where 16 of 4 would miss 2e-4.
The estimate's test (SLACK) loses another 3e-6 of the pairs at the threshold. Both are the method's own and no exact way is
beside it; the README says so. Sets are of 64-bit hashes of shingles, so "full" is up to their collisions, and classes are
told apart by 128 bits; their documents are found again by doc_id and a 64-bit hash of the text.
Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case. A document with fewer words than a
shingle has one shingle, the sequence; null and empty texts have none and are linked with nothing. Repeated rows
share a class. A null doc_id is never a component's id, unless the component has no other. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, discard, pick, resident, text_batches, written
from .graph import components

HASHES, BITS = 64, 4
#: The share of pairs at the threshold that may share no band.
MISSED = 1e-5
#: Standard errors below the threshold down to which a pair is decided on full sets, and is likely enough to be tried first.
SLACK, LIKELY = 5.0, 1.5
TRIED = 2
#: Classes whose sets are asked for by a broadcast of 24 bytes each; beyond it the texts are shuffled instead.
BROADCAST_CLASSES = 500_000
#: Hubs are dealt to so many partitions when their pairs are confirmed.
HUB_SALTS = 32
MEMO_WORDS = 300_000
AT_ONCE = 1 << 16

_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_W = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, k: int = 3) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text. bytes.split() and bytes.lower() know ASCII only, as it is asked for."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    memo = resident(("neardup",), _Words)
    w = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(w) < k:
        return _mixed(np.array([np.sum(w * _W[: len(w)]) + np.uint64(len(w))], dtype=np.uint64))
    n = len(w) - k + 1
    x = w[:n] * _W[0]
    for j in range(1, k):
        x += w[j : j + n] * _W[j]
    return np.unique(_mixed(x))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set (none empty), vectorised over runs of sets."""
    out = np.empty((len(sets), HASHES), dtype=np.uint64)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (last == first or n + len(sets[last]) <= AT_ONCE):
            n += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
        v = np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, _A[i], out=v)
            np.add(v, _B[i], out=v)
            out[first:last, i] = np.minimum.reduceat(v, starts)
        first = last
    return out


def band_rows(percent: int) -> int:
    """Minima in a band: as many as leave no more than MISSED of the pairs at the threshold without a common band."""
    return next((n for n in range(8, 1, -1) if (1 - (percent / 100) ** n) ** (HASHES // n) <= MISSED), 1)


def band_keys(m: np.ndarray, n: int) -> np.ndarray:
    """A key for each band of n minima, with the band's number in it."""
    bands = HASHES // n
    rows = m[:, : bands * n].reshape(len(m), bands, n)
    x = np.zeros((len(m), bands), dtype=np.uint64) + _mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(n):
        x = _mixed(x * _W[5] + rows[:, :, j])
    return x.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, BITS each, 16 to a long."""
    low = ((m >> np.uint64(20)) & np.uint64((1 << BITS) - 1)).reshape(len(m), HASHES // 16, 16)
    out = np.zeros(low.shape[:2], dtype=np.uint64)
    for j in range(16):
        out |= low[:, :, j] << np.uint64(BITS * j)
    return out.view(np.int64)


LONGS = HASHES // 16
MAP_LONGS = 32
SIG = [f"s{i}" for i in range(LONGS)]


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t (hash of the text), n, c (digest of the set; null if it is empty), packed signature, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t.as_py(), k) for t in batch.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                m = minima([sets[i] for i in full])
                keys, sig = band_keys(m, band_rows(percent)), packed(m)
                place = np.full(len(sets), -1)
                place[full] = np.arange(len(full))
                pick_ = lambda col: pa.array([None if p < 0 else int(col[p]) for p in place], pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0),
                    "t": batch.column(2),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "c": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    **{SIG[j]: pick_(sig[:, j]) for j in range(LONGS)},
                    "bands": pa.array([None if p < 0 else keys[p] for p in place], pa.list_(pa.int64())),
                })

    schema = "doc_id long, t long, n long, c binary, " + ", ".join(f"{s} long" for s in SIG) + ", bands array<long>"
    return text_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("t"))).mapInArrow(run, schema)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The shingles' low bits as a set of MAP_LONGS * 64. Each bit that two maps differ in is a shingle that only one set has."""
    bits = np.zeros(64 * MAP_LONGS, dtype=bool)
    bits[s & np.uint64(64 * MAP_LONGS - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def full_sets(rows: DataFrame, k: int) -> DataFrame:
    """k, set and bitmap out of text, k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t.as_py(), k) for t in batch.column(0)]
                yield pa.RecordBatch.from_pydict({"k": batch.column(1), "set": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), "map": pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))})

    return text_batches(rows.select("text", "k")).mapInArrow(run, "k long, set array<long>, map array<long>")


def equal_minima(a: str, b: str) -> Column:
    """How many of the packed low bits are equal: groups of BITS bits whose XOR is zero, by counting bits."""
    ones = sum(1 << (BITS * j) for j in range(16))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    same = F.lit(HASHES)
    for s in SIG:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones))
        same = same - F.bit_count(x)
    return same


def least_equal(percent: int, errors: float) -> int:
    """Equal low bits that a pair at the threshold has, less so many standard errors."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return int(HASHES * (p - errors * (p * (1 - p) / HASHES) ** 0.5))


def estimate(equal: Column) -> Column:
    """The similarity by the share of equal low bits, corrected for chance collisions."""
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (equal / float(HASHES) - chance) / (1 - chance))


def _candidate(percent: int, errors: float) -> Column:
    """Of rows with structs x and y: sizes that allow the similarity, and an estimate that does."""
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    return sizes & (equal_minima("x", "y") >= least_equal(percent, errors))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked for all pairs: 100 * intersection >= percent * union on full sets.

    The pairs get the set of b, which is in few pairs; a may be a hub, so its pairs are salted and its set is
    sent once for each salt that is in use.
    """
    sets = sets.select("k", "set")
    one = pairs.join(sets.withColumnRenamed("set", "set_b"), pairs["b"] == sets["k"]).drop("k")
    one = one.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(HUB_SALTS)))
    asked = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(HUB_SALTS)).alias("salt")).distinct()
    hubs = asked.join(sets.withColumnRenamed("set", "set_a"), asked["a"] == sets["k"]).select(F.col("a").alias("hub"), F.col("salt").alias("hub_salt"), "set_a")
    both = one.join(hubs, (one["a"] == hubs["hub"]) & (one["salt"] == hubs["hub_salt"]))
    inter = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - inter
    return both.select("a", "b", (inter.cast("long") * 100 >= union.cast("long") * percent).alias("linked"))


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int, repeated: bool) -> DataFrame:
    """Full sets of the wanted classes, from the text of one document each; repeated: whether rows repeat."""
    ids = written(classes.join(wanted, classes["k"] == wanted["w"], "left_semi").select("k", "r", "rt"), "wanted")
    small = F.broadcast(ids) if ids.count() <= BROADCAST_CLASSES else ids
    rows = docs.join(small, docs["doc_id"].eqNullSafe(ids["r"]) & (F.xxhash64(docs["text"]) == ids["rt"])).select("text", "k")
    sets = full_sets(rows, k)
    if repeated:
        sets = sets.groupBy("k").agg(F.first("set").alias("set"), F.first("map").alias("map"))
    sets = written(sets, "sets")
    discard(ids)
    return sets


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return _marked(docs, k, percent).drop("t")


def without_near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """The rows of docs, one of each component. Those that go are named by doc_id and a hash of their text; their
    names are broadcast up to BROADCAST_CLASSES of them, else the rows are shuffled. Of rows that repeat, one stays."""
    marked = written(_marked(docs, k, percent), "marked")
    key = lambda df: df.groupBy("doc_id", "t").agg(F.count("*").alias("times"))
    gone = written(marked.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct(), "gone")
    again = written(key(marked.where("kept")).where("times > 1").select(F.col("doc_id").alias("again_id"), F.col("t").alias("again_t")), "again")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df
    c = Carried(docs)
    same = lambda i, t: c["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(c["text"]) == F.col(t))
    rows = c.rows.join(small(gone), same("gone_id", "gone_t"), "left_anti")
    if not again.limit(1).count():
        return c.restored(rows)
    repeated = rows.join(small(again), same("again_id", "again_t"), "left_semi")
    once = repeated.groupBy(c["doc_id"].alias("i"), F.xxhash64(c["text"]).alias("t")).agg(F.first("row_").alias("row_")).select("row_")
    return c.restored(rows.join(small(again), same("again_id", "again_t"), "left_anti").unionByName(once))


def _marked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    docs = pick(docs, "doc_id", "text")
    rows = written(signatures(docs, k, percent), "signatures")
    repeated = bool(rows.groupBy("doc_id", "t").count().where("count > 1").limit(1).count())
    about, one = F.struct("n", *SIG, "bands"), F.max(F.struct("doc_id", "t"))
    classes = rows.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("m"), one.alias("one"), F.count("*").alias("copies"), F.first(about).alias("about"))
    # numbers are given once, as the table is written
    number = F.monotonically_increasing_id().alias("k")
    classes = written(classes.select(number, "c", "m", F.col("one.doc_id").alias("r"), F.col("one.t").alias("rt"), "copies", "about.*"), "classes")
    buckets = _buckets(classes)
    pairs = written(_with_heads(buckets, classes, percent), "pairs")
    wanted = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct()
    sets = _sets_of(docs, classes, wanted, k, repeated)
    linked = written(confirm(pairs, sets, percent).where("linked").select("a", "b"), "linked")
    discard(pairs, sets)
    labels = components(linked)
    across = _across(docs, classes, buckets, labels, k, percent, repeated)
    if across.limit(1).count():
        labels = components(linked.unionByName(across))
    out = _resolved(rows, classes, labels)
    discard(buckets, linked, across, classes, labels)
    return out


def _buckets(classes: DataFrame) -> DataFrame:
    """key, k, and the first and last class of the bucket (low, high), for buckets with more than one class."""
    every = classes.select(F.explode("bands").alias("key"), "k")
    ends = every.groupBy("key").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high")
    return written(every.join(ends.withColumnRenamed("key", "end_key"), F.col("key") == F.col("end_key")).select("key", "k", "low", "high"), "buckets")


def _with_heads(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of each bucket's ends with its other members that are likely similar: a few for each
    member, whatever a bucket's size. What repeats over the bands goes before signatures are looked up."""
    met = buckets.select("k", F.explode(F.array("low", "high")).alias("head")).where("head <> k").distinct()
    about = lambda name: classes.select(F.col("k").alias(f"{name}_k"), F.struct("n", *SIG).alias(name))
    met = met.join(about("x"), F.col("head") == F.col("x_k")).join(about("y"), F.col("k") == F.col("y_k")).where(_candidate(percent, LIKELY))
    # at most two heads of each band meet here
    met = met.groupBy(F.col("k").alias("b")).agg(F.sort_array(F.collect_set(F.struct(equal_minima("x", "y").alias("equal"), F.col("head").alias("a"))), asc=False).alias("met"))
    met = met.select("b", F.explode(F.slice("met", 1, TRIED)).alias("p")).select(F.col("p.a").alias("a"), "b")
    return met.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b")).dropDuplicates(["low", "high"]).select("a", "b")


def _across(docs: DataFrame, classes: DataFrame, buckets: DataFrame, labels: DataFrame, k: int, percent: int, repeated: bool) -> DataFrame:
    """Links a, b between classes of different components that share a bucket.

    A pair is decided in the first bucket that it shares. Buckets within one component go first, as numbers only; then rows
    of a bucket without a likely partner are left out by a semi-join. The others get a bitmap of their shingles, whose
    differing bits bound the sets' difference from below, and their shingles cut to 31 bits, with how many of these
    collide. What the join lets through is confirmed on full sets; so hardly anything but links comes out of it, whatever a
    bucket's size."""
    known = buckets.select("key", "k").join(labels.withColumnRenamed("c", "lc"), F.col("k") == F.col("lc"), "left").select("key", "k", F.coalesce("label", "k").alias("comp"))
    known = written(known, "known")
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(F.col("key").alias("mixed_key"))
    left = known.join(mixed, F.col("key") == F.col("mixed_key"), "left_semi")
    about = classes.select(F.col("k").alias("ck"), "n", *SIG, "bands")
    left = left.join(about, F.col("k") == F.col("ck")).select("key", F.struct("k", "n", *SIG, "comp", "bands").alias("y"))
    mixed_rows = written(left, "across")
    first = F.lit(None).cast("long")
    for i in reversed(range(HASHES // band_rows(percent))):
        first = F.when(F.get("x.bands", F.lit(i)) == F.get("y.bands", F.lit(i)), F.get("x.bands", F.lit(i))).otherwise(first)
    met = (F.col("xk") == F.col("key")) & _candidate(percent, SLACK) & (first == F.col("key"))
    as_x = lambda df: df.select(F.col("key").alias("xk"), F.col("y").alias("x"))
    left = written(mixed_rows.join(as_x(mixed_rows), met & (F.col("x.comp") != F.col("y.comp")), "left_semi"), "across")
    discard(known, mixed_rows)
    sets = _sets_of(docs, classes, left.select(F.col("y.k").alias("w")).distinct(), k, repeated)
    bits = F.transform("set", lambda s: s.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    cut = sets.select(F.col("k").alias("sk"), "map", bits.alias("cut")).withColumn("lost", F.size("cut") - F.size(F.array_distinct("cut")))
    full = left.join(cut, F.col("y.k") == F.col("sk")).select("key", F.struct("y.*", "map", "cut", "lost").alias("y"))
    full = written(full, "across")
    apart = F.lit(0)
    for i in range(MAP_LONGS):
        apart = apart + F.bit_count(F.get("x.map", F.lit(i)).bitwiseXOR(F.get("y.map", F.lit(i))))
    total = F.col("x.n") + F.col("y.n")
    # similar sets differ in (100 - percent) / (100 + percent) of their sizes at most
    may_be = (F.col("x.comp") < F.col("y.comp")) & met & (apart.cast("long") * (100 + percent) <= total * (100 - percent))
    inter = F.size(F.array_intersect("x.cut", "y.cut")) + F.least("x.lost", "y.lost")
    near = full.join(as_x(full), may_be & (inter.cast("long") * (100 + percent) >= total * percent))
    near = written(near.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")), "pairs")
    linked = written(confirm(near, sets, percent).where("linked").select("a", "b"), "linked")
    discard(left, sets, full, near)
    return linked


def _resolved(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Component ids of all rows. Only classes with copies or links are joined; the others are their own component."""
    known = classes.select("k", "c", "m", "copies").join(labels.withColumnRenamed("c", "lc"), F.col("k") == F.col("lc"), "left")
    linked = known.where("label IS NOT NULL")
    least = written(linked.groupBy("label").agg(F.min("m").alias("component_id")), "least")
    linked = linked.join(least.withColumnRenamed("label", "ll"), F.col("label") == F.col("ll")).select("c", "component_id")
    named = linked.unionByName(known.where("label IS NULL AND copies > 1").select("c", F.col("m").alias("component_id")))
    named = written(named.withColumnRenamed("c", "nc"), "named")
    discard(least)
    out = rows.select("doc_id", "t", "n", "c").join(named, F.col("c") == F.col("nc"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
