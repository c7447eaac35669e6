"""Near-duplicates: b-bit MinHash signatures under a multi-index Hamming join.

A text's signature has LANES minima of WIDTH bits. Two texts of similarity s
differ in a lane with probability 1 - s, so pairs to be found differ in at
most `radius` lanes but for a chance of about 1 in 10,000 at the threshold
itself. Lanes are split into so many chunks that by the pigeonhole principle
one chunk of any such pair differs in one lane at most. Leaving out each lane
of each chunk in turn, that is enumerating the chunk's allowed errors, gives
keys of which every such pair shares one. Links are confirmed on full sets.

Texts with equal sets are one class with one representative. A bucket (the
texts that share a key) never is expanded into pairs: its members are first
compared with its most connected member; once links are joined to components,
only pairs from different components of a bucket are left to compare, and of
these only pairs of sizes that can be similar. Such pairs may be very many, so
they are compared by arrays, a unit of bounded size at a time. A sketch with the
parity of a set's hashes by bit bounds the size of a symmetric difference from
below, common parts cancelling out, so pairs that it shows too far apart are
left there and no link is; a pair that shares several keys counts at the
first. A large group of near copies gives about as many rows as it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import anew, durable, forget, map_rows, prepare, table, tidy
from .components import components

LANES, WIDTH = 40, 12
#: Leaders that a text is compared with before components are first formed.
LEADERS = 2
#: Bits of a parity sketch.
BITS = 1024
#: Lanes of a chunk at most, so that a chunk is one long; members that one leader's set is sent for.
CHUNK, MEMBERS = 5, 256
#: Members of a bucket that are compared in one unit of work; pairs compared at a time.
UNIT, PAIRS = 4096, 1 << 15
CACHE_WORDS = 200_000
_MASK = (1 << 64) - 1
_random = np.random.default_rng(20240229)
SEEDS = _random.integers(1, 1 << 63, LANES, dtype=np.uint64)
ODD = _random.integers(1, 1 << 63, LANES, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.n, self.cache = words, {}

    def _hash(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Distinct shingles; of fewer words than a shingle has, all of them as one; of none, nothing."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.cache.get
        hashes = np.array([known(w) or self._hash(w) for w in words], dtype=np.uint64)
        n = min(self.n, len(words))
        rows = len(words) - n + 1
        out = np.full(rows, n, dtype=np.uint64)
        for i in range(n):
            out = _mixed(out * STEP + hashes[i : i + rows])
        return np.unique(out)


def signature(shingles: np.ndarray, r: int) -> np.ndarray:
    """LANES minima, the lanes of each chunk in a long."""
    low = np.full(LANES, _MASK, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, ((shingles[i : i + 2048, None] ^ SEEDS) * ODD).min(axis=0), out=low)
    lanes = _mixed(low) & np.uint64((1 << WIDTH) - 1)
    return np.array([np.bitwise_or.reduce(lanes[c] << (np.arange(len(c), dtype=np.uint64) * np.uint64(WIDTH))) for c in chunks(r)], dtype=np.uint64)


def radius(num: int, den: int, miss: float = 1e-4) -> int:
    """The least number of lanes that a pair at the threshold exceeds with a chance under `miss`."""
    p, below, term = 1 - num / den, 0.0, (num / den) ** LANES
    for r in range(LANES + 1):
        below += term
        if 1 - below < miss:
            return r
        term *= (LANES - r) / (r + 1) * p / (1 - p)
    return LANES


def chunks(r: int) -> list[np.ndarray]:
    """Lanes in as few chunks of CHUNK lanes or fewer as leave one of them at most one error in `r`."""
    return np.array_split(np.arange(LANES), max((r + 2) // 2, -(-LANES // CHUNK)))


def slots(r: int) -> list[tuple[int, int]]:
    """Chunk and lane left out of each key."""
    return [(c, skip) for c, chunk in enumerate(chunks(r)) for skip in range(len(chunk))]


def keys(r: int) -> Column:
    """For each chunk of `sig` and each lane of it left out, a key; a key's place is its slot."""
    lane, signed = (1 << WIDTH) - 1, lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[F.xxhash64(F.lit(k), F.col("sig")[c].bitwiseAND(F.lit(signed(_MASK ^ (lane << (WIDTH * skip)))))) for k, (c, skip) in enumerate(slots(r))])


def errors(x: np.ndarray) -> np.ndarray:
    """Lanes in which two chunks differ, for each long of `x`, the chunks' exclusive or."""
    for shift in (6, 3):  # gathers each lane of 12 bits in its lowest three
        x = x | (x >> np.uint64(shift))
    x = x | (x >> np.uint64(1)) | (x >> np.uint64(2))
    return np.bitwise_count(x & np.uint64(0x001001001001001))


def parity(shingles: np.ndarray) -> np.ndarray:
    """BITS bits, each the parity of how many hashes fall on it."""
    odd = np.bincount((shingles & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, words: int, r: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (a digest of the set), sig (a long for each chunk of lanes), bits (parity sketch)."""

    def make():
        sets = Shingler(words)

        def work(c):
            found = [sets.of(t) for t in c["text"]]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            return {
                "doc_id": c["doc_id"],
                "n_shingles": [len(s) for s in found],
                "d1": [int.from_bytes(d[:8], "little", signed=True) for d in digest],
                "d2": [int.from_bytes(d[8:], "little", signed=True) for d in digest],
                "sig": [signature(s, r).view(np.int64) for s in found],
                "bits": [parity(s) for s in found],
            }

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>, bits array<long>")


def units(n: Column, odd_n: Column) -> Column:
    """Units of work of a bucket's row: a number, and whether the row asks and is told (compared with those that ask).

    A bucket of up to UNIT members is one unit. A larger one is dealt out, those
    that ask by those that are told, each in parts of about UNIT, so that no
    unit outgrows a task and every pair still meets in exactly one.
    """
    odd, told, ask = F.col("ci") != F.col("cl"), F.ceil(n / UNIT), F.ceil(odd_n / UNIT)
    unit = lambda i, j, asks, is_told: F.struct((i * told + j).cast("long").alias("unit"), asks.alias("asks"), is_told.alias("told"))
    asking = F.transform(F.sequence(F.lit(0).cast("long"), told - 1), lambda j: unit(F.pmod(F.xxhash64("id", F.lit(1)), ask), j, F.lit(True), F.lit(False)))
    being_told = F.transform(F.sequence(F.lit(0).cast("long"), ask - 1), lambda i: unit(i, F.pmod(F.xxhash64("id"), told), F.lit(False), F.lit(True)))
    whole = F.array(unit(F.lit(0).cast("long"), F.lit(0).cast("long"), odd, F.lit(True)))
    return F.when(n <= UNIT, whole).when(odd, F.concat(asking, being_told)).otherwise(being_told)


def alike(c: dict[str, np.ndarray], num: int, den: int, r: int):
    """Places a, b of the pairs of one unit that may be linked, from columns whose rows come unit by unit.

    Sizes, sketches and signatures are compared for many units and pairs at a
    time, the cheapest test first.
    """
    chunk, skip = np.array(slots(r)).T
    n, ci, ids, odd, sig, few, bits = c["n_shingles"], c["ci"], c["id"], c["odd"], c["sig"], np.ascontiguousarray(c["bits"][:, :4]), np.ascontiguousarray(c["bits"][:, 4:])
    unit = np.cumsum(np.r_[0, (c["key"][1:] != c["key"][:-1]) | (c["unit"][1:] != c["unit"][:-1])])
    ask, told = np.flatnonzero(c["asks"]), np.flatnonzero(c["told"])
    told = told[np.lexsort((n[told], unit[told]))]
    span = int(n.max()) + 1
    place = unit[told] * span + n[told]
    low = np.searchsorted(place, unit[ask] * span - (-num * n[ask] // den))
    count = np.searchsorted(place, unit[ask] * span + np.minimum(den * n[ask] // num, span - 1), "right") - low
    ends = np.cumsum(count)
    at = 0
    while at < len(ask):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        k = count[at:to]
        a = np.repeat(ask[at:to], k)
        b = told[np.arange(len(a)) + np.repeat(low[at:to] - (ends[at:to] - k - before), k)]
        at = to
        near = (ci[a] != ci[b]) & (~odd[b] | (ids[a] < ids[b]))
        a, b = a[near], b[near]
        # a link has at most this many elements apart, times num + den; the first few longs settle most
        apart = (n[a] + n[b]) * (den - num)
        differ = np.bitwise_count(few[a] ^ few[b]).sum(axis=1, dtype=np.int64)
        near = differ * (num + den) <= apart
        a, b, apart, differ = a[near], b[near], apart[near], differ[near]
        near = (differ + np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)) * (num + den) <= apart
        a, b = a[near], b[near]
        x = sig[a] ^ sig[b]
        wrong, here = errors(x), np.arange(len(a))
        first = (wrong <= 1).argmax(axis=1)  # the chunk of the first key that both share
        near = (wrong.sum(axis=1, dtype=np.int64) <= r) & (wrong[here, first] <= 1) & (chunk[c["slot"][a]] == first) & ((skip[c["slot"][a]] == 0) | (x[here, first] != 0))
        yield a[near], b[near]


def candidates(rows: DataFrame, num: int, den: int, r: int) -> DataFrame:
    """u, v: pairs of different components that share a unit of a key and may be linked, each at the first key it shares.

    `rows` has key, unit, asks, told, id, slot, ci, odd, n_shingles, sig, bits. Only
    pairs of a row that asks are compared, each once.
    """
    prepare(rows.sparkSession)
    rows = rows.repartition("key", "unit").sortWithinPartitions("key", "unit")

    def run(batches):
        def compared(t):
            c = {k: t[k].combine_chunks() for k in t.column_names}
            flat = lambda x: x.flatten().to_numpy().view(np.uint64).reshape(len(t), -1)
            c = {k: flat(x) if k in ("sig", "bits") else x.to_numpy(zero_copy_only=False) for k, x in c.items()}
            for a, b in alike(c, num, den, r):
                u, v = c["id"][a], c["id"][b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], names=["u", "v"])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 4 * UNIT:
                continue
            t = pa.Table.from_batches(held)
            key, unit = (t[k].to_numpy() for k in ("key", "unit"))
            same = (key == key[-1]) & (unit == unit[-1])  # the last unit may go on
            whole = size - int(same.sum())
            if whole:
                yield from compared(t.slice(0, whole))
            held, size = t.slice(whole).combine_chunks().to_batches(), size - whole
        if size:
            yield from compared(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "u long, v long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """u, v, linked: whether the full sets have den * intersection >= num * union.

    A set `u` of many pairs is made once for about MEMBERS of them: its pairs
    are dealt out by a salt, and each part has the text of `u` first.
    """
    prepare(pairs.sparkSession)
    pairs = durable(pairs.select("u", "v"), "pairs")
    many = pairs.groupBy(F.col("u").alias("m_u")).agg(F.count("*").alias("m_n")).where(F.col("m_n") > MEMBERS).select(anew("m_u").alias("m_u"), "m_n")
    salt = F.coalesce(F.pmod(F.xxhash64("v"), F.ceil(F.col("m_n") / MEMBERS)), F.lit(0)).cast("long")
    dealt = pairs.join(many, F.col("u") == F.col("m_u"), "left").select("u", salt.alias("salt"), "v")
    own = texts.select(F.col("id").alias("t_id"), "text")
    members = dealt.join(own, F.col("v") == F.col("t_id")).select("u", "salt", "v", "text")
    leaders = dealt.select("u", "salt").distinct().join(own, F.col("u") == F.col("t_id")).select("u", "salt", F.lit(None).cast("long").alias("v"), "text")
    rows = members.union(leaders).repartition("u", "salt").sortWithinPartitions("u", "salt", F.asc_nulls_first("v"))

    def run(batches):
        sets, at, led = Shingler(words), None, {}
        for batch in batches:
            c, out = batch.to_pydict(), ([], [], [])
            for u, part, v, text in zip(c["u"], c["salt"], c["v"], c["text"], strict=True):
                if (u, part) != at:
                    at, led = (u, part), {}
                s = sets.of(text)
                if v is None:
                    led[s.tobytes()] = s  # more than one if rows of one id differ
                    continue
                common = [(len(np.intersect1d(s, t, assume_unique=True)), len(t)) for t in led.values()]
                for k, x in zip(out, (u, v, any(n and den * n >= num * (len(s) + m - n) for n, m in common)), strict=True):
                    k.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["u", "v", "linked"])

    return rows.mapInArrow(run, "u long, v long, linked boolean")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Groups of documents linked by shingle sets of similarity num / den or more.

    Words are runs without ASCII white space, A-Z lower-cased. Returns doc_id,
    n_shingles, component_id (the least doc_id that links reach), kept (whether
    it is the doc_id), one row per input row. A null or empty text has an
    empty set and no link, so it stays. Documents of one doc_id are one node.
    A null doc_id belongs to the component of texts with its very set, whose
    least id it reports; it is kept only if there is none. Repeated rows each
    get a row. Other columns are ignored.

    Intermediate tables go to the shared folder, so a lost executor costs what
    it was doing; but for two they are removed before the result is used.
    """
    spark, r = docs.sparkSession, radius(num, den)
    made = durable(signatures(docs, words, r), "signatures")
    n_sig, n_bits = len(chunks(r)), BITS // 64
    flat = lambda name, n: [F.first(F.col(name)[i]).alias(f"{name}{i}") for i in range(n)]
    packed = lambda name, n: F.array(*[F.col(f"{name}{i}") for i in range(n)]).alias(name)
    # the rows of a class have one set, so any one's signature is all of theirs
    reps = made.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), *flat("sig", n_sig), *flat("bits", n_bits))
    reps = durable(reps.where("id is not null").select("d1", "d2", "id", "copies", "n_shingles", packed("sig", n_sig), packed("bits", n_bits)), "classes")

    found = reps.select("id", F.posexplode(keys(r)).alias("slot", "key"))
    live = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(anew("key").alias("l_key"), "n")
    buckets = durable(found.join(live, F.col("key") == F.col("l_key")).select("key", "id", "slot", "n"), "buckets")
    # the most connected member of a bucket leads it
    ties = buckets.groupBy(F.col("id").alias("t_id")).agg(F.sum("n").alias("ties"))
    leads = buckets.select("key", "id").join(ties, F.col("id") == F.col("t_id")).groupBy("key").agg(F.max(F.struct("ties", "id")).alias("top"))
    leads = leads.select(anew("key").alias("k_key"), F.col("top.id").alias("leader"))
    led = durable(buckets.join(leads, F.col("key") == F.col("k_key")).select("key", "id", "slot", "leader"), "led")
    forget(buckets)
    near = led.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("shared"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "leader"))).where(F.col("r") <= LEADERS)
    first = best.select(F.col("leader").alias("u"), F.col("id").alias("v"))

    wanted = led.select(F.col("id").alias("w_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, F.col("id") == F.col("w_id"), "left_semi")
    texts = durable(texts, "texts")
    tidy(spark)
    links = durable(confirm(first, texts, words, num, den), "links")
    tidy(spark)
    group = components(links.where("linked").select("u", "v"))
    tidy(spark)

    # what is left: pairs of one bucket, in different components and within the radius
    of = lambda c, k: group.select(F.col("node").alias(f"{k}_node"), F.col("component").alias(k))
    marked = led.join(of("id", "ci"), F.col("id") == F.col("ci_node"), "left").join(of("leader", "cl"), F.col("leader") == F.col("cl_node"), "left")
    marked = marked.select("key", "id", "slot", F.coalesce("ci", "id").alias("ci"), F.coalesce("cl", "leader").alias("cl"))
    mixed = marked.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("ci") != F.col("cl")).alias("odd_n")).where("odd_n > 0").select(anew("key").alias("m_key"), "n", "odd_n")
    slim = reps.select(F.col("id").alias("s_id"), "n_shingles", "sig", "bits")
    rows = marked.join(mixed, F.col("key") == F.col("m_key")).select("key", "id", "slot", "ci", (F.col("ci") != F.col("cl")).alias("odd"), F.inline(units(F.col("n"), F.col("odd_n"))))
    rows = rows.join(slim, F.col("id") == F.col("s_id")).select("key", "unit", "asks", "told", "id", "slot", "ci", "odd", "n_shingles", "sig", "bits")
    rest = candidates(rows, num, den, r)
    done = links.select(F.least("u", "v").alias("f_u"), F.greatest("u", "v").alias("f_v"))
    more = confirm(rest.join(done, (F.col("u") == F.col("f_u")) & (F.col("v") == F.col("f_v")), "left_anti"), texts, words, num, den)
    more = durable(more.where("linked").select("u", "v"), "more")
    for x in (led, texts, links):
        forget(x)
    tidy(spark)

    # links between components join them; the smaller graph is that of the components
    between = more.join(of("u", "cu"), F.col("u") == F.col("cu_node"), "left").join(of("v", "cv"), F.col("v") == F.col("cv_node"), "left")
    over = components(between.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    named = reps.select("d1", "d2", "id", "copies").join(of("id", "ci"), F.col("id") == F.col("ci_node"), "left").select("d1", "d2", "id", "copies", F.coalesce("ci", "id").alias("ci"))
    named = named.join(over.select(F.col("node").alias("o_node"), "component"), F.col("ci") == F.col("o_node"), "left").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "id", "copies", F.coalesce("component", "ci").alias("component"))
    named = durable(named.where("copies > 1 or component <> id").select("c1", "c2", "component"), "named")
    for x in (reps, group, more, over):
        forget(x)
    tidy(spark)
    component = F.coalesce("component", "doc_id")
    same = (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n_shingles") > 0)
    return made.select("doc_id", "n_shingles", "d1", "d2").join(named, same, "left").select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`: shingles of 3 words, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, d.b FROM reach JOIN d ON d.a = reach.b)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, m.component_id = n.doc_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = n.doc_id
"""
