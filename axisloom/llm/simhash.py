"""SimHash near duplicates: fuzzy keys from the Golay code, joined and verified.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most 2 bits
agree in one whole segment (pigeonhole) and differ in at most 2 bits of the next one. Such a segment is taken as a word
of the perfect (23,12) Golay code and decoded, with each of its neighbours, to codeword indices: one index for words
near their codeword, six for the others. Words at distance 2 or less always share an index, that of a word between
them. A key is the number of the whole segment, its bits, and an index of the next: about 16 keys of 35 bits for each
different fingerprint, and no link is lost.

Keys that few fingerprints share give pairs, each verified by its bits. For a key that more than CROWD
fingerprints share no pairs are made: its fingerprints are dealt out by the words within one bit of the whole
fingerprint. Two fingerprints share such a word exactly if they differ in 2 bits or fewer, so all that share one are
linked to the smallest of them, exactly and in linear space.

Null and empty texts have fingerprint zero and are linked like any others; repeated rows and equal texts share a
fingerprint and are one node. Null ids keep their row; they never name a component unless all of its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, blank_words, components, free_name, lookup, map_arrow, saved

#: Fingerprints of one key up to which all pairs are verified.
CROWD = 32
#: Generator polynomial of the (23,12) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0xAE3
_SEGMENTS = ((42, 22), (21, 21), (0, 21))
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(words: list[bytes], k: int) -> Iterator[bytes]:
    """k neighbouring words each, joined by blanks; all words if there are fewer; none without words."""
    if len(words) <= k:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))


def fingerprint(text: bytes, k: int = 3) -> int:
    """Bits that are set in over half of the shingles' XXH64 (seed 42, repeats included), as a signed 64-bit number."""
    h = np.fromiter(map(_hash, shingles(blank_words(text), k)), np.uint64)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long"), binary("text").alias("text"))
    return map_arrow(plain, lambda b: {"doc_id": b.column(0), "fp": pa.array([fingerprint(t, k) for t in b.column(1).to_pylist()], pa.int64())}, "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.astype(np.int64)
    for i in range(22, 10, -1):
        rest = np.where(rest >> i & 1, rest ^ (_GENERATOR << (i - 11)), rest)
    return rest


@cache
def _near() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: error patterns (up to 6) that lead to the codewords of the word and of its 23
    neighbours, and how many there are."""
    bits = [0] + [1 << i for i in range(23)]
    patterns = np.array(sorted({a | b | c for a in bits for b in bits for c in bits}))  # weight up to 3: one for each syndrome
    error = np.zeros(2048, np.int64)
    error[_syndromes(patterns)] = patterns
    single = _syndromes(np.array(bits))
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s in range(2048):
        found = sorted({int(error[s ^ t]) ^ b for t, b in zip(single, bits, strict=True)})
        table[s, : len(found)], count[s] = found, len(found)
    return table, count


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in `words`, codeword index of 12 bits): all indices near each 23-bit word."""
    table, count = _near()
    s = _syndromes(words)
    at = np.repeat(np.arange(len(words)), count[s])
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
    return at, (words[at] ^ table[s[at], nth]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): keys so that fingerprints within 2 bits share one."""
    u = fps.view(np.uint64)
    cut = [(u >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in _SEGMENTS]
    ats, keys = [], []
    for i in range(3):
        at, index = golay_indices(cut[(i + 1) % 3])
        ats.append(at)
        keys.append((i << 34) | (cut[i][at] << 12) | index)
    return np.concatenate(ats), np.concatenate(keys)


def _close(a: str, b: str, bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b) of different fingerprints of `fps` (fp, no repeats), within `bits` (2 at most) bits: enough to join all that hang together."""
    if not 0 <= bits <= 2:
        raise ValueError("the keys find up to 2 differing bits")

    def keyed(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy()
        at, key = fuzzy_keys(fp)
        return {"key": key, "fp": fp[at]}

    keys = map_arrow(fps.select("fp"), keyed, "key long, fp long")
    shared = saved(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    twos = shared.where("n = 2").select("a", "b")
    more = keys.join(shared.where("n > 2").select("key", "n"), "key")
    few = more.where(F.col("n") <= CROWD)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b")
    found = twos.union(pairs).where(_close("a", "b", bits))
    crowd = more.where(F.col("n") > CROWD).select("fp").distinct()
    if bits < 2:  # a shared word may be 2 bits wide: only the word itself or one of its fingerprints will do
        ball = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("word")) if bits else None
        met = ball.join(crowd.select(F.col("fp").alias("word")), "word", "left_semi") if bits else None
        return found.union(met.select(F.col("fp").alias("a"), F.col("word").alias("b"))) if bits else found
    ball = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("word"))
    low = ball.groupBy("word").agg(F.count("*").alias("n"), F.min("fp").alias("b")).where("n > 1").drop("n")
    return found.union(ball.join(low, "word").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def classes(docs: DataFrame, k: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id: the smallest doc_id that links lead to."""
    fps = saved(fingerprints(docs, k))
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    groups = components(links(nodes, bits))
    named = saved(groups.join(nodes, groups["node"] == nodes["fp"]).select("fp", "doc_id", "component"))
    low = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = lookup(named, low, "component").select("fp", "component_id")
    of = nodes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    return lookup(fps, of, "fp").select("doc_id", "fp", "component_id")


def hex_digits(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def report(docs: DataFrame, k: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    return classes(docs, k, bits).select("doc_id", hex_digits().alias("fingerprint"), "component_id")


# --- near duplicates by similarity of whole texts ---------------------------------------------------------------

#: Bands of the MinHash signature and rows of a band: at similarity 0.8 a pair shares a band with probability 0.998.
BANDS, ROWS = 12, 4
#: Texts of one band up to which all pairs are verified; in larger ones each is verified against four pivots, and then
#: against all texts that a prefix filter leaves and the links found so far don't join it to.
GATHERING = 8
#: Shingles before one of a prefix that tell whether two texts have met already.
EARLIER = 4
_MULTIPLY = np.array([xxhash.xxh64_intdigest(f"minhash {i}") | 1 for i in range(BANDS * ROWS)], np.uint64)


def _shingle_hashes(text: bytes, k: int) -> np.ndarray:
    return np.unique(np.fromiter(map(_hash, shingles(blank_words(text), k)), np.uint64))


def signature(text: bytes, k: int) -> list[int]:
    """A key for each band of the MinHash signature of the text's set of shingles."""
    h = _shingle_hashes(text, k)
    if not len(h):
        return [0] * BANDS
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        part = h[i : i + 1024, None] * _MULTIPLY[None, :]
        low = np.minimum(low, (part ^ (part >> np.uint64(29))).min(0))
    return [_signed(xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i)) for i in range(BANDS)]


def _similarities(a: list[bytes], b: list[bytes], k: int) -> list[float]:
    known: dict[bytes, np.ndarray] = {}

    def of(text: bytes) -> np.ndarray:
        if text not in known:
            if len(known) > 256:
                known.clear()
            known[text] = _shingle_hashes(text, k)
        return known[text]

    out = []
    for x, y in zip(map(of, a), map(of, b), strict=True):
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / max(1, len(x) + len(y) - both))
    return out


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(digest, doc_id, copies, keeper) of every different text; keeper: the smallest doc_id of its group.

    Texts hang together if the Jaccard similarity of their sets of k-word shingles reaches `similarity`. Candidates
    come from the Golay keys of SimHash fingerprints (within 2 bits) and, since two texts of similarity 0.8 differ
    in about ten of 64 bits, where no fuzzy key is selective, from bands of a MinHash signature. Every candidate
    is verified on both whole texts. Equal texts are one node, so that copies cost one row.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.md5(binary("text")).alias("digest"), binary("text").alias("text"))
    schema = "doc_id long, digest string, fp long, bands array<long>"

    def signed(b: pa.RecordBatch) -> dict:
        texts = b.column(2).to_pylist()
        return {"doc_id": b.column(0), "digest": b.column(1), "fp": pa.array([fingerprint(t, k) for t in texts], pa.int64()), "bands": [signature(t, k) for t in texts]}

    rows = saved(map_arrow(plain, signed, schema))
    nodes = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    # All texts of a fingerprint in a row: links between fingerprints, and between the texts of one, are links of texts.
    fps = nodes.groupBy("fp").agg(F.min("digest").alias("digest"))
    fuzzy = links(fps, 2)
    one, other = fps.select(F.col("fp").alias("a"), F.col("digest").alias("x")), fps.select(F.col("fp").alias("b"), F.col("digest").alias("y"))
    fuzzy = fuzzy.join(one, "a").join(other, "b").select("x", "y").union(nodes.join(fps.withColumnRenamed("digest", "y"), "fp").select(F.col("digest").alias("x"), "y"))
    banded = nodes.select("digest", F.posexplode("bands").alias("band", "key"))
    pivots = [F.min("digest"), F.max("digest"), *(F.min_by("digest", F.xxhash64("digest", F.lit(s))) for s in (1, 2))]
    shared = saved(banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.array(*pivots).alias("pivots")).where("n > 1"))
    met = banded.join(shared, ["band", "key"])
    few = met.where(F.col("n") <= GATHERING).select("band", "key", "digest")
    pairs = few.withColumnRenamed("digest", "x").join(few.withColumnRenamed("digest", "y"), ["band", "key"]).select("x", "y")
    pairs = pairs.union(met.where(F.col("n") > GATHERING).select(F.col("digest").alias("x"), F.explode("pivots").alias("y")))
    pairs = saved(pairs.union(fuzzy).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct().join(nodes.select("digest", "doc_id"), "digest")
    texts = plain.withColumnRenamed("doc_id", "id").join(wanted.withColumnsRenamed({"digest": "of", "doc_id": "wanted"}), F.col("id").eqNullSafe(F.col("wanted")) & (F.col("digest") == F.col("of")))
    texts = saved(texts.groupBy("digest").agg(F.first("text").alias("text")))

    def verified(b: pa.RecordBatch) -> pa.RecordBatch:
        good = np.array(_similarities(b.column(2).to_pylist(), b.column(3).to_pylist(), k)) >= similarity
        return b.select(["a", "b"]).filter(pa.array(good))

    def similar(pairs: DataFrame) -> DataFrame:
        whole = pairs.join(texts.withColumnsRenamed({"digest": "a", "text": "left"}), "a").join(texts.withColumnsRenamed({"digest": "b", "text": "right"}), "b").select("a", "b", "left", "right")
        return saved(map_arrow(whole, verified, "a string, b string"))

    # Pivots join what is like them; for the texts of crowded bands that hang together by no link yet a prefix filter finds all pairs.
    edges = similar(pairs)
    groups = saved(components(edges))
    crowd = met.where(F.col("n") > GATHERING).select("band", "key", "digest").join(groups.withColumnRenamed("node", "digest"), "digest", "left")
    crowd = saved(crowd.withColumn("component", F.coalesce("component", "digest")))
    mixed = crowd.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "key")
    if not mixed.isEmpty():
        apart = crowd.join(mixed, ["band", "key"], "left_semi").select("digest", "component").distinct()
        more = prefix_pairs(apart.join(texts, "digest"), k, similarity).join(pairs, ["a", "b"], "left_anti")
        groups = components(edges.union(similar(more)))
    named = saved(groups.join(nodes, groups["node"] == nodes["digest"]).select("digest", "doc_id", "component"))
    low = named.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("keeper"))
    of = lookup(named, low, "component").select("digest", "keeper")
    return nodes.select("digest", "doc_id", "copies").join(of, "digest", "left").withColumn("keeper", F.coalesce("keeper", F.struct("doc_id", "digest")))


def prefix_pairs(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b) of all rows (digest, component, text) of different components that can reach `similarity`, exactly.

    Of two texts that reach it, each has more than the share `similarity` of its shingles in common with the other. So if the
    shingles are ordered by how many texts have them, the rarest 1 - `similarity` of the larger text (and one more) and the rarest
    (1 - `similarity`) / (1 + `similarity`) of the smaller one (and one more) share one. Shingles that one
    text has alone fill these places first and meet nothing: what thousands of texts hold makes no pairs of them. Two texts meet at
    the first shingle they share, and only if as many follow it in both as the similarity takes.
    """

    def parted(b: pa.RecordBatch) -> dict:
        found = [_shingle_hashes(t, k).view(np.int64) for t in b.column(2).to_pylist()]
        return {"digest": b.column(0), "component": b.column(1), "size": [len(x) for x in found], "shingles": found}

    held = saved(map_arrow(rows.select("digest", "component", "text"), parted, "digest string, component string, size long, shingles array<long>"))
    every = held.select("digest", F.explode("shingles").alias("s"))
    counts = saved(every.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"))
    common = lookup(every, counts, "s", counts).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("c"))  # no more than a text has
    place = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1
    rare = held.join(common, "digest").withColumn("alone", F.col("size") - F.size("c"))  # shingles of this text alone: the rarest
    rare = rare.select("digest", "component", "size", "alone", (place(similarity) - F.col("alone")).alias("room"), (place(2 * similarity / (1 + similarity)) - F.col("alone")).alias("less"), F.col("c.s").alias("s")).where("room > 0")
    rare = rare.select("digest", "component", "size", "alone", "less", "s", F.posexplode(F.slice("s", F.lit(1), F.col("room").cast("int"))).alias("at", "e"))
    before = f"slice(s, greatest(at - {EARLIER}, 0) + 1, least(at, {EARLIER})) before"
    rare = saved(rare.selectExpr("digest", "component", "size", "at < less first", "size - alone - at rest", before, "e s"))
    smaller = rare.where("first").drop("first").withColumnsRenamed({c: f"_{c}" for c in ("digest", "component", "size", "rest", "before")})
    met = rare.join(smaller, "s").where("component <> _component").where("_size < size or _size = size and _digest < digest").where(F.col("_size") >= F.col("size") * similarity - 1e-9)
    # At the first shingle that two texts share, what follows it (and itself) must be enough; at later ones they needn't meet again.
    met = met.where(F.least("rest", "_rest") >= (F.col("size") + F.col("_size")) * (similarity / (1 + similarity)) - 1e-9).where(~F.arrays_overlap("before", "_before"))
    return met.select(F.least("digest", "_digest").alias("a"), F.greatest("digest", "_digest").alias("b")).distinct()


def one_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of near duplicates: that of the smallest doc_id, with all its columns."""
    groups = near_duplicates(docs, k, similarity)
    digest, id_, again = (free_name(docs, x) for x in ("digest", "id", "copies"))
    keepers = groups.where("digest = keeper.digest").select(F.col("digest").alias(digest), F.col("doc_id").alias(id_), F.col("copies").alias(again))
    own = docs.withColumn(digest, F.md5(binary("text")))
    # By id as well as digest, so that the copies of one text don't meet in one task.
    kept = own.join(keepers.withColumnRenamed(digest, f"{digest}of"), (F.col(digest) == F.col(f"{digest}of")) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    single = kept.where(F.col(again) == 1).select(*docs.columns)
    repeated = kept.where(F.col(again) > 1).groupBy(digest).agg(F.first(whole).alias("row")).select("row.*")  # rows of one id and text
    return single.union(repeated)
