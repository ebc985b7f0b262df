"""SimHash near duplicates by bit-sliced comparison (operator 12).

A text (A-Z lower-cased) has a 64-bit fingerprint: a bit is 1 if it is set in over half of the XXH64 values of its shingles of
four words, repeats included (fewer words: the whole sequence as one; none: fingerprint zero).  Fingerprints that differ in
at most ``RADIUS`` bits are linked.

Equal fingerprints are searched as one.  A fingerprint is cut into chunks; of c chunks at least c - RADIUS are equal in two
linked fingerprints, so that every choice of so many chunks is an index and all linked pairs meet in a bucket.  c follows the
number of fingerprints, so that buckets stay small; any c finds the same links.

A bucket's members are held as bit planes: word k of plane b has bit b of 64 members.  A member meets 64 others at once: its
bit flips a plane, and the 64 distances are counted by carry-save adders in four words, the last of which tells which distances
are beyond the radius.  A block of 64 in which all are beyond is abandoned.  So is, beforehand, a block whose members have all
been found connected with the member that it would meet.  Of the links found only those that connect are kept, so a bucket
gives fewer links than it has members, however alike they are.

A bucket of more than ``BLOCK`` members is dealt in blocks to several tasks: each block is compared within itself and with
some landmarks of the bucket.  Once the links so found have been contracted to components, the blocks of those that are not in the
bucket's largest component meet all its blocks; members of one component need not meet again, so no link between two
components is left out.

Defined results: a null or empty text has the fingerprint zero, which is linked like any other; rows with equal ids are one node
that has the links of each of its texts; a row without an id has its fingerprint, no component, and links nothing; an empty table gives
an empty result; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.tables import Saved, components

WORDS, SEED, RADIUS = 4, 42, 4
#: Members of a bucket up to which one task compares them, and expected members for which more chunks are taken.
BLOCK, EXPECTED = 4096, 256
LANDMARKS = 32
#: Blocks of 64 comparisons at once, and shingles hashed at once.
AT_ONCE, HASHED = 1 << 15, 1 << 18
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None) -> int:
    """The 64 majority bits of the shingles of a text's bytes."""
    # of bytes, lower() and split() know A-Z and 0x20, 0x09-0x0D alone
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WORDS, len(words))
    n, counts, h = len(words) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, HASHED):
        upto = min(n, at + HASHED)
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])


def index_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that make up each index's key for n fingerprints."""
    chunks = radius + 1
    while chunks < radius + 4 and n / 2.0 ** (64 * (chunks - radius) // chunks) > EXPECTED:
        chunks += 1
    edges = [64 * k // chunks for k in range(chunks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(parts, chunks - radius)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 planes of len(fps) / 64 words: bit m of word k of plane b is bit b of member 64 * k + m."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T.reshape(64, -1, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0].astype(np.uint64)


def within(queries: np.ndarray, words: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks (queries[k] against the 64 members of word words[k]): the blocks that are left and the members within the radius, a bit each.

    Distances are counted from 15 - radius on, so that the carry out of the fourth word tells those beyond the radius."""
    at = np.arange(len(queries))
    start = 15 - radius
    ones, twos, fours, eights = (np.full(len(at), FULL if start >> k & 1 else 0, np.uint64) for k in range(4))
    over = np.zeros(len(at), np.uint64)
    for b in range(64):
        carry = planes[b][words] ^ (np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1)))
        ones, carry = ones ^ carry, ones & carry
        twos, carry = twos ^ carry, twos & carry
        fours, carry = fours ^ carry, fours & carry
        eights, carry = eights ^ carry, eights & carry
        over |= carry
        if b % 8 == 7:
            left = np.flatnonzero(over != FULL)
            if len(left) < len(at):
                at, queries, words = at[left], queries[left], words[left]
                ones, twos, fours, eights, over = ones[left], twos[left], fours[left], eights[left], over[left]
    return at, ~over


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b, pair by pair; in root every node points at the smallest of its tree."""
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def connected(group: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The root of each member, once the members of each group, which is a run of rows, have met.

    In a group of side 0 all members meet; where there are sides 1 and 2, in this order, those of side 1 meet those of side 2."""
    n = len(fps)
    root = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    # each group begins a word of its own, the last of which may have empty places
    word_at = np.concatenate([[0], np.cumsum((size + 63) // 64)])
    of = np.repeat(np.arange(len(first)), size)
    place = word_at[of] * 64 + np.arange(n) - first[of]
    member = np.full(word_at[-1] * 64, -1)
    member[place] = np.arange(n)
    member = member.reshape(-1, 64)
    filled = np.packbits(member >= 0, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)
    member = np.where(member >= 0, member, member[:, :1])
    planes = planes_of(fps[member.ravel()])
    # from its own word on, or from the first word of side 2: no two words meet twice
    ahead = np.bincount(of, weights=side != 2, minlength=len(first)).astype(np.int64)
    query = np.flatnonzero(side != 2)
    own = np.where(side[query] == 0, place[query] // 64, word_at[of[query]] + ahead[of[query]] // 64)
    count = np.maximum(word_at[of[query] + 1] - own, 0)
    ends = np.cumsum(count)
    blocks = int(ends[-1]) if len(ends) else 0
    for lo in range(0, blocks, AT_ONCE):
        k = np.arange(lo, min(lo + AT_ONCE, blocks))
        row = np.searchsorted(ends, k, side="right")
        q, word = query[row], own[row] + k - (ends[row] - count[row])
        # left out are words whose members are all connected with the query
        roots = root[member]
        one = np.where((roots == roots[:, :1]).all(axis=1), roots[:, 0], -1)
        new = np.flatnonzero(one[word] != root[q])
        q, word = q[new], word[new]
        at, hit = within(fps[q], word, planes, radius)
        hit &= filled[word[at]]
        some = np.flatnonzero(hit)
        r, m = np.nonzero(np.unpackbits(hit[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        _roots(root, q[at[some]][r], member[word[at[some]][r], m])
    return root


def _links(radius: int):
    """Of rows (key, side, id, fp) sorted by key and side: the links (a, b) that connect the members of each key.

    Whole keys are taken together; a batch's last key waits for the next batch."""

    def links(key: np.ndarray, side: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        # a key of blocks' pairs is another group than a bucket's, should their hashes be equal
        changed = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | ((side[1:] == 0) != (side[:-1] == 0))]))
        group = np.repeat(np.arange(len(changed)), np.diff(np.concatenate([changed, [len(key)]])))
        root = connected(group, side, fps.view(np.uint64), radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[root[moved]], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)])
            if held[0][0][0] == held[-1][0][-1]:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield links(*[c[:last] for c in rows])
            held = [[c[last:] for c in rows]]
        if held:
            yield links(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _found(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of rows (key, side, id, fp), all rows of a key in one task."""
    return rows.repartition("key").sortWithinPartitions("key", "side").select("key", "side", "id", "fp").mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits) and component_id, the smallest id reachable over links."""
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    told = Saved(texts.mapInArrow(_fingerprints, "id long, fp long"), "fingerprints").df
    named = told.where("id is not null")
    classes = Saved(named.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    masks = index_masks(classes.df.count(), radius)
    keyed = classes.df.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("of", "value"))
    # a key is a hash of its index and value: two buckets with equal hashes are compared as one, which adds no link
    keys = keyed.select(F.xxhash64("of", "value").alias("bucket"), "id", "fp")
    large = Saved(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("bucket", "n", F.ceil(F.col("n") * 2 / BLOCK).cast("int").alias("blocks")), "large-buckets")
    some = not large.df.isEmpty()
    plain = keys.join(large.df, "bucket", "left_anti") if some else keys
    rows = plain.select(F.col("bucket").alias("key"), F.lit(0).alias("side"), "id", "fp")
    if some:
        crowd = Saved(keys.join(large.df, "bucket"), "crowds")
        landmark = F.pmod(F.xxhash64("fp", "bucket"), F.col("n")) < LANDMARKS
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = crowd.df.withColumn("block", F.explode(F.when(landmark, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
        rows = rows.unionByName(dealt.select(F.xxhash64("bucket", "block", F.lit(1)).alias("key"), F.lit(0).alias("side"), "id", "fp"))
    # the classes of one id are linked: rows with equal ids are one node
    several = named.groupBy("id").agg(F.min("fp").alias("f0"), F.max("fp").alias("f1")).where("f0 <> f1").select("id")
    same = named.join(several, "id", "left_semi").join(classes.df.select("fp", F.col("id").alias("rep")), "fp").select("id", "rep")
    same = same.join(same.groupBy("id").agg(F.min("rep").alias("least")), "id").select(F.col("rep").alias("a"), F.col("least").alias("b")).where("a <> b")
    links = Saved(_found(rows, radius).unionByName(same), "links")
    comps = components(links.df)
    if some:
        rest = _rest(crowd.df, comps.df)
        more = Saved(_found(rest, radius), "links")
        if not more.df.isEmpty():
            comps.drop()
            comps = components(links.df.unionByName(more.df))
        more.drop()
        crowd.drop()
    links.drop()
    large.drop()
    of_class = classes.df.join(comps.df, "id", "left").select("fp", F.coalesce("comp", "id").alias("component_id"))
    out = told.join(of_class, "fp", "left")
    # bits of a long as 16 hex digits
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("id").cast(kind).alias(id_col), digits.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).cast(kind).alias("component_id"))


def _rest(crowd: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (key, side, id, fp) of the pairs of blocks of large buckets in which members of different components still have to meet.

    The bucket's most frequent component is dealt into blocks of its own; they are met by the blocks of the others, not by each other."""
    of = crowd.join(comps.select("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")).select("bucket", "id", "fp", "comp")
    counted = of.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
    half = BLOCK // 2
    placed = of.join(main, "bucket").withColumn("in", F.col("comp") == F.col("main"))
    placed = placed.withColumn("outer", F.ceil(F.col("outside") / half).cast("int")).withColumn("inner", F.ceil(F.col("inside") / half).cast("int"))
    placed = placed.withColumn("block", F.when(F.col("in"), F.col("outer") + F.pmod(F.xxhash64("fp"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("fp"), F.col("outer"))).cast("int"))
    # blocks 0 .. outer - 1 lie outside the main component; a row goes to every pair that has its block and one of those
    partners = F.when(F.col("in"), F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    sent = placed.withColumn("with", F.explode(partners)).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    return sent.select(F.xxhash64("bucket", "i", "j", F.lit(2)).alias("key"), F.when(F.col("i") == F.col("j"), 0).when(F.col("block") == F.col("i"), 1).otherwise(2).alias("side"), "id", "fp")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints of four-word shingles differ in at most 4 bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
