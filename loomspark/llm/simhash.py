"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints within ``RADIUS`` bits agree within t_i bits on some part i of any division of the bits into parts,
if the t_i sum up to RADIUS minus the number of parts plus one. Bits that go together are put into one part; the
division and its thresholds, unequal ones among them, are chosen by dynamic programming on the numbers of
candidates and probes that the corpus's own bit counts let expect. Each distinct fingerprint is put under its own
value of each part and probes the values within the part's threshold; what meets is verified by its full distance.

Groups of one value are not turned into pairs: a task links the members of a group as a forest, and values that
more than ``HOT`` fingerprints share are linked by way of what lies half the radius from each.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import arrow, id_and_text, sliced, through_table
from loomspark.llm.components import connected_components

RADIUS = 4
BITS = 64
#: Distinct fingerprints of one part's value that a task compares.
HOT = 1 << 14
#: Cost of a verified candidate, as a share of that of a shuffled probe.
CANDIDATE_COST = 0.05

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64())])
PROBES = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("probe", pa.bool_()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str, width: int, seed: int) -> list[int]:
    """XXH64 of each shingle of ``width`` words, of all words if there are fewer, of none if there are none."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def majority(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """For each run of hashes the bits set in over half of them; 0 for an empty run."""
    counts = np.array(sizes, np.int64)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[full]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > counts[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, digest (a hash of the text), fp (the 64 bits as a signed long) of each row."""

    def compute(batches):
        for batch in sliced(batches):
            ids, hashes, sizes, begin = batch.column(0), [], [], 0
            texts = batch.column(1).to_pylist()
            for k, text in enumerate(texts):
                found = shingle_hashes(text, width, seed)
                hashes += found
                sizes.append(len(found))
                if len(hashes) > 300_000 or k == len(texts) - 1:
                    yield arrow({"doc_id": ids[begin : k + 1], "digest": batch.column(2)[begin : k + 1], "fp": majority(hashes, sizes).view(np.int64)}, FINGERPRINTS)
                    hashes, sizes, begin = [], [], k + 1

    rows = id_and_text(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(compute, "doc_id long, digest long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and in how many of them each pair of bits is set: one aggregation of 64 x 64 sums."""

    def count(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"pair": np.arange(BITS * BITS, dtype=np.int32), "n": total.ravel()})

    sums = fps.select("fp").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    together = np.zeros(BITS * BITS, np.int64)
    for row in sums:
        together[row["pair"]] = row["n"]
    return fps.count(), together.reshape(BITS, BITS)


def divided(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in parts of nearly equal size; each takes, one by one, the bit most correlated with those it has."""
    share = together.diagonal() / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    correlation = np.abs(together / max(1, n) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        mine = [left.pop(int(np.argmax(correlation[np.ix_(left, left)].sum(1))))]
        while len(mine) < size:
            mine.append(left.pop(int(np.argmax(correlation[np.ix_(left, mine)].sum(1)))))
        out.append(sorted(mine))
    return out


def expected_share(share: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """The share of pairs that differ in at most 0, 1 … ``most`` of the bits, from how often each is set."""
    at = np.zeros(most + 1)
    at[0] = 1
    for b in bits:
        differ = 2 * share[b] * (1 - share[b])
        at[1:] = at[1:] * (1 - differ) + at[:-1] * differ
        at[0] *= 1 - differ
    return np.cumsum(at)


def allocated(n: int, share: np.ndarray, parts: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """The thresholds of least cost, -1 for a part that is not probed, whose sum is radius - parts + 1."""
    budget = radius - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        near, then = expected_share(share, bits, radius), {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                probes = 0 if t < 0 else n * (1 + sum(comb(len(bits), k) for k in range(1, t + 1)) / 2)
                pairs = 0 if t < 0 else n * n / 2 * near[t]
                new = cost + probes + CANDIDATE_COST * pairs
                if spent + t not in then or new < then[spent + t][0]:
                    then[spent + t] = new, [*chosen, t]
        best = then
    return best[budget]


def planned(n: int, together: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, of the division of least cost."""
    share = together.diagonal() / max(1, n)
    plans = []
    for m in range(1, radius + 2):
        parts = divided(together, n, m)
        cost, thresholds = allocated(n, share, parts, radius)
        plans.append((cost, m, [(p, t) for p, t in zip(parts, thresholds) if t >= 0]))
    return min(plans, key=lambda p: p[:2])[2]


def masks_of(bits: list[int], most: int) -> np.ndarray:
    """All ways to flip one to ``most`` of the bits."""
    return np.array([sum(1 << b for b in c) for k in range(1, most + 1) for c in combinations(bits, k)], np.uint64)


def near_links(fps: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal keys, which stand together: those between members at most 8 places apart in
    small groups, a spanning forest in others."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(edge, len(keys)))
    small = np.repeat(size <= 9, size)
    group = np.repeat(np.arange(len(edge)), size)
    left, right = [], []
    for gap in range(1, min(9, len(fps))):
        near = small[:-gap] & (group[gap:] == group[:-gap])
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(fps[at] ^ fps[at + gap]) <= radius]
        left.append(fps[at])
        right.append(fps[at + gap])
    for begin, n in zip(edge[size > 9].tolist(), size[size > 9].tolist()):
        waiting = np.unique(fps[begin : begin + n])
        while len(waiting):
            queue, waiting = [waiting[0]], waiting[1:]
            while queue and len(waiting):
                x = queue.pop()
                near = np.bitwise_count(waiting ^ x) <= radius
                found = waiting[near]
                if len(found):
                    left.append(np.full(len(found), x))
                    right.append(found)
                    queue += list(found)
                    waiting = waiting[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def linked(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """a, b: links by which all of the distinct fingerprints (fp) within ``radius`` bits are connected."""
    n, together = bit_counts(distinct)
    plan = [(k, sum(1 << b for b in bits), masks_of(bits, t)) for k, (bits, t) in enumerate(planned(n, together, radius))]

    def probe(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(every), 4096):
                fps = every[a : a + 4096]
                for part, mask, flips in plan:
                    own = fps & np.uint64(mask)
                    yield arrow({"part": np.full(len(fps), part), "key": own.view(np.int64), "probe": np.zeros(len(fps), bool), "fp": fps.view(np.int64)}, PROBES)
                    for c in range(0, len(flips), 64):
                        keys = own[:, None] ^ flips[None, c : c + 64]
                        row, col = np.nonzero(keys < own[:, None])  # of two values, the larger probes the smaller
                        yield arrow({"part": np.full(len(row), part), "key": keys[row, col].view(np.int64), "probe": np.ones(len(row), bool), "fp": fps[row].view(np.int64)}, PROBES)

    def verify(batches):
        kept = np.zeros(0, np.uint64)  # indexed fingerprints of the group that the last batch ended in
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            probes, fps = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            group = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | (key[1:] != key[:-1])]))
            if last != (part[0], key[0]):
                kept = kept[:0]
            a, b = near_links(np.concatenate([kept, fps]), np.concatenate([np.zeros(len(kept), group.dtype), group]), radius)
            if len(a):
                yield arrow({"a": np.minimum(a, b).view(np.int64), "b": np.maximum(a, b).view(np.int64)}, LINKS)
            tail = (group == group[-1]) & ~probes
            kept = np.concatenate([kept, fps[tail]]) if group[-1] == 0 else fps[tail]
            last = part[-1], key[-1]

    probes = distinct.select("fp").mapInArrow(probe, "part int, key long, probe boolean, fp long")
    own = distinct.select(F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m, _ in plan))).alias("x"), "fp").select("x.*", "fp")
    crowded = through_table(own.groupBy("part", "key").count().filter(F.col("count") > hot).select("part", "key"), "crowded")
    links = None
    if not crowded.isEmpty():
        links = by_middle(probes.join(crowded, ["part", "key"], "left_semi").select("fp").distinct(), radius)
        probes = probes.join(crowded, ["part", "key"], "left_anti")
    sorted_probes = probes.repartition("part", "key").sortWithinPartitions("part", "key", "probe")
    found = sorted_probes.mapInArrow(verify, "a long, b long")
    return found if links is None else found.union(links)


def by_middle(fps: DataFrame, radius: int) -> DataFrame:
    """a, b: links among all the fingerprints within ``radius``, by the words within half of it of each.

    Two are within an even radius if and only if some word lies within half of it of both. Those around a word are
    linked to the smallest of them: rows are as many as fingerprints times words near one, whatever the groups.
    """
    if radius % 2:
        raise ValueError("an even radius is needed")
    flips = [0, *masks_of(list(range(BITS)), radius // 2).view(np.int64).tolist()]
    words = fps.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: x.bitwiseXOR(F.col("fp")))).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return words.join(least.select("word", "a"), "word").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_groups(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, digest, fp, root (a group's smallest fingerprint), component_id of each row."""
    fps = through_table(fingerprints(docs, width, seed), "fingerprints")
    distinct = through_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = through_table(connected_components(linked(distinct, radius, hot)), "fingerprint-roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(smallest, "root"), "fp").select("doc_id", "digest", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of ``docs``.

    component_id is the smallest doc_id that links reach, itself included; null ids are passed over, and it is
    null where all ids are. A text without words has fingerprint zero and is linked as any other; null text is
    empty. Repeated rows and ids stay; other columns are ignored.
    """
    found = near_groups(docs, width, seed, radius, hot)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """One row of ``docs`` of each near-duplicate group, all columns unchanged: that of the smallest doc_id.

    Null ids come after all others; of a group's rows that share the id, one of the text with the least fingerprint
    stays. Null text is in the group of the empty one.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "digest")
    kept = near_groups(docs, width, seed, radius, hot).groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("kept_id"), F.col("x.digest").alias("kept_digest"))
    mine = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    rows = mine.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    return rows.dropDuplicates(["id", "digest"]).select("row.*")
