"""Removal of repeated strings: each byte covered by a string of ``LENGTH`` bytes that starts anywhere else too.

Suffixes are sorted to a depth of LENGTH by refining buckets. The first bucket of a place is its q-gram, ``GRAM``
bytes by a hash; a bucket is refined by sorting its places on (bucket, bucket of the place GRAM bytes later), which
gives new numbers that the next level uses for the later places as well. A place alone in its bucket is dropped at
once, and with it all that reach over it. Not all places need buckets: every string of LENGTH bytes has a least gram,
by a hash, at a place that only its own bytes decide, so that equal strings have equal grams at equal places. The
starts that share a least gram form a run; only places a multiple of GRAM from the least gram are bucketed.

1. Depth 50: grams that only one run has are dropped. A fixed-size bit map has those that are left.
2. Copies: of runs with equal bytes all are marks, and one or two stand for them in what follows.
3. Depth 100, then 150: the places -100, -50, 0 and 50 from the gram are refined by those 50 later. A string of LENGTH
   bytes has one of the three places -100, -50 and 0 in its first 51 bytes, and the 150 bytes from there, its core.
4. Depth 200: members of a core's bucket are compared by the bytes at both sides of it, for each number of bytes
   before the core. Members are compared in one task; a bucket of more than ``HOT`` members is dealt by whole
   strings, of which each task sends one of equal ones.

Buckets of depth 50 are 64-bit (the least gram) and 32-bit (the others) hashes, which can put too many places into a
bucket and never too few; the last step compares the refined bucket, a second hash of the core, and a 128-bit one of
the bytes around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import pretoken
from loomspark.llm.common import Concerned, bit_map, through_table
from loomspark.llm.pretoken import BASE, mixed, powers

LENGTH = 200
GRAM = 50
#: Bytes of a core, and the most bytes of a string before or after it.
CORE = LENGTH - GRAM
#: Where cores begin, from the least gram on.
PLACES = (-2 * GRAM, -GRAM, 0)
#: Bytes that a task holds at once, 2 ** 24 at most.
BLOCK = 1 << 19
NO_ID = -(1 << 63)
#: Members of a core's bucket that one task compares.
HOT = 1 << 12
#: Grams of more than HOT runs and of more than this part of all are dealt into SALTS parts; their list is broadcast.
SHARE = 1 << 16
SALTS = 64

RUN_SCHEMA = "a long, b long, lo int, hi int, at int, gram long, c1 long, c2 long, g0 int, g1 int, g3 int, g4 int, whole boolean, mark boolean, salt int"
LEFT_SCHEMA = "a long, b long, lo int, hi int, at int, gram long, g0 int, g1 int, g3 int, g4 int, whole boolean, mark boolean"
MEMBER_SCHEMA = "a long, b long, lo int, hi int, bucket long, check long, x0 int, x1 int, around binary, whole boolean, mark boolean"
MARK_SCHEMA = "a long, b long, lo int, hi int"


def byte_values(seed: int) -> np.ndarray:
    return mixed(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64) * BASE)


def gram_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(seed)[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * inverse[:n])


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima of blocks from both sides."""
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def runs_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of strings within a text, the place of their least gram, and its hash."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    grams = gram_hashes(data, GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = (least_in_windows((grams & ~low) | place, LENGTH - GRAM + 1) & low).astype(np.int64)
    whole = np.zeros(len(least) + 1, np.int32)
    long = ends - begins >= LENGTH
    np.add.at(whole, begins[long], 1)
    np.add.at(whole, ends[long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(whole[:-1]))
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    at = least[starts]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1], at[first], grams[at[first]]


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether another row has the same keys, and one row of each group."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort(keys)
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    again = np.zeros(n, bool)
    again[order] = np.repeat(size > 1, size)
    return again, order[first]


def table(schema: list[tuple[str, pa.DataType]], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n].astype(t.to_pandas_dtype()), t) if isinstance(columns[n], np.ndarray) else columns[n] for n, t in schema], names=[n for n, _ in schema])


KEY = [("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]
IDS = [("g0", pa.int32()), ("g1", pa.int32()), ("g3", pa.int32()), ("g4", pa.int32())]
RUN = [("at", pa.int32()), ("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), *IDS, ("whole", pa.bool_()), ("mark", pa.bool_()), ("salt", pa.int32())]
MEMBER = [("bucket", pa.int64()), ("check", pa.int64()), ("x0", pa.int32()), ("x1", pa.int32()), ("around", pa.binary()), ("whole", pa.bool_()), ("mark", pa.bool_())]


def text_blocks(ids: np.ndarray, hashes: np.ndarray, texts: list[str]):
    """(a, b, bytes, offset of the bytes in the text) of pieces of up to BLOCK bytes. A longer text comes in pieces of
    that size that overlap by LENGTH - 1, so that each of its strings is in one of them."""
    for a, b, text in zip(ids.tolist(), hashes.tolist(), texts):
        data = text.encode()
        for begin in range(0, max(1, len(data) - LENGTH + 1), BLOCK):
            yield a, b, data[begin : begin + BLOCK + LENGTH - 1], begin


def held(pieces, most: int = BLOCK):
    """Lists of pieces of about ``most`` bytes together."""
    waiting, total = [], 0
    for piece in pieces:
        if waiting and total + len(piece[2]) > most:
            yield waiting
            waiting, total = [], 0
        waiting.append(piece)
        total += len(piece[2])
    if waiting:
        yield waiting


def blocks_of(batches):
    """(a, b, offset in its text of each piece; begin and end of each in the bytes; the bytes) of blocks of text."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            ids, hashes = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for pieces in held(text_blocks(ids, hashes, part.column(2).to_pylist())):
                data = b"".join(p[2] for p in pieces)
                ends = np.cumsum([len(p[2]) for p in pieces])
                a, b, shift = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1, 3))
                yield a, b, shift, np.concatenate([[0], ends[:-1]]), ends, data


def count_grams(batches):
    """gram, n: the least grams of each block's runs, and how many runs have each."""
    for *_, begins, ends, data in blocks_of(batches):
        grams, n = np.unique(runs_of(np.frombuffer(data, np.uint8), begins, ends)[3], return_counts=True)
        yield pa.RecordBatch.from_pydict({"gram": grams.view(np.int64), "n": n.astype(np.int64)})


def find_runs(batches, there, hot: np.ndarray):
    """Runs of each task's texts whose gram is shared (there: says so of each of an array of grams): repeated ones in
    the same block are marks, one of each goes on. hot: the sorted grams of too many runs, which are salted."""
    for a, b, shift, begins, ends, data in blocks_of(batches):
        raw = np.frombuffer(data, np.uint8)
        lo, hi, at, gram = runs_of(raw, begins, ends)
        known = there(gram.view(np.int64))
        lo, hi, at, gram = lo[known], hi[known], at[known], gram[known].view(np.int64)
        if not len(lo):
            continue
        owner = np.searchsorted(ends, lo, side="right")
        digest = xxhash.xxh3_128_digest
        names = np.frombuffer(b"".join([digest(data[i:j], s) for i, j, s in zip(lo.tolist(), (hi + LENGTH).tolist(), (at - lo).tolist())]), "<i8").reshape(-1, 2)
        ids = gram_hashes(raw, GRAM, 1).view(np.int64).astype(np.int32)
        a, b, shift, begin = a[owner], b[owner], shift[owner] - begins[owner], begins[owner]
        columns = {"a": a, "b": b, "lo": lo + shift, "hi": hi + shift, "at": at + shift, "gram": gram, "c1": names[:, 0], "c2": names[:, 1]}
        # a place outside the text has no start that needs it
        columns |= {n: ids[np.clip(at + d, 0, len(ids) - 1)] for (n, _), d in zip(IDS, (-2 * GRAM, -GRAM, GRAM, 2 * GRAM))}
        columns["salt"] = np.where(np.isin(gram, hot), names[:, 0] & (SALTS - 1), 0)
        again, one = grouped(gram, names[:, 0], names[:, 1])
        yield from marked(np.flatnonzero(again), a, b, lo + shift, hi + shift, RUN, "gram")
        yield table([*KEY, *RUN], **{n: x[one] for n, x in columns.items()}, whole=again[one], mark=np.zeros(len(one), bool))


def marked(rows: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, schema: list, key: str):
    """The rows as marks, those that follow one another in a text as one; the key, of no meaning, spreads them."""
    if not len(rows):
        return
    rows = rows[np.lexsort((lo[rows], b[rows], a[rows]))]
    a, b, lo, hi = a[rows], b[rows], lo[rows], hi[rows]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (lo[1:] > hi[:-1] + 1)]))
    a, b, lo, hi = a[first], b[first], lo[first], np.maximum.reduceat(hi, first)
    rest = {n: np.zeros(len(first), t.to_pandas_dtype()) if not pa.types.is_binary(t) else pa.array([b""] * len(first), t) for n, t in schema}
    rest |= {key: mixed(b.astype(np.int64).view(np.uint64) + lo.astype(np.uint64)).view(np.int64), "mark": np.ones(len(first), bool)}
    yield table([*KEY, *schema], a=a, b=b, lo=lo, hi=hi, **rest)


def with_neighbours(batches, keys: list[int]):
    """Batches of sorted rows, each row with whether the row before and the row after have the same of each key."""
    waiting, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        if rows.num_rows > 1:
            yield _compared(rows, keys, before, False)
            before = rows.slice(rows.num_rows - 2, 1)
        waiting = rows.slice(rows.num_rows - 1, 1)
    if waiting is not None:
        yield _compared(waiting, keys, before, True)


def _compared(rows: pa.RecordBatch, keys: list[int], before: pa.RecordBatch | None, last: bool):
    """(rows but the last unless it is the last of all, same as before, same as after), the latter two by key."""
    n = rows.num_rows - (not last)
    prior, after = [], []
    for k in keys:
        x = rows.column(k).to_numpy(zero_copy_only=False)
        same = x[1:] == x[:-1]
        start = before is not None and before.column(k)[0].as_py() == x[0]
        prior.append(np.concatenate([[start], same])[:n])
        after.append(np.concatenate([same, [False]])[:n])
    return rows.slice(0, n), prior, after


def unmarked(batches, mark: int, marks: list[pa.RecordBatch]):
    """The rows that are no marks; those that are go into the list."""
    for batch in batches:
        is_mark = batch.column(mark)
        found = batch.filter(is_mark)
        if found.num_rows:
            marks.append(found)
        yield batch.filter(pc.invert(is_mark))


def refine_runs(batches, hot: np.ndarray):
    """Of runs sorted by gram and bytes: marks of those whose bytes are there again, and runs that share their gram
    with others (whole: known to be repeated), as all of hot grams do. Of equal runs the first and the last stand for
    all."""
    marks: list[pa.RecordBatch] = []
    out = ["a", "b", "lo", "hi", "at", "gram", *(n for n, _ in IDS), "whole", "mark"]
    for rows, (g0, x0, y0), (g1, x1, y1) in with_neighbours(unmarked(batches, 13, marks), [5, 6, 7]):
        yield from (m.select(out) for m in marks)
        marks.clear()
        shared = np.isin(rows.column(5).to_numpy(zero_copy_only=False), hot)
        same_before, same_after = g0 & x0 & y0, g1 & x1 & y1
        known = rows.column(12).to_numpy(zero_copy_only=False)
        again = same_before | same_after
        for at, mark in ((np.flatnonzero(again & ~known), True), (np.flatnonzero((~same_before & (g0 | shared)) | (~same_after & (g1 | shared))), False)):
            if len(at):
                own = rows.take(pa.array(at)).select(out[:-2])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array((again | known)[at]), pa.array(np.full(len(at), mark))], names=out)
    yield from (m.select(out) for m in marks)


def sums_around(around: np.ndarray) -> list[np.ndarray]:
    """For two seeds, hashes of the first 0 … GRAM bytes before a core, from it on, and after it."""
    power, out = powers(GRAM)[0], []
    for seed in (3, 4):
        values = byte_values(seed)
        sums = np.zeros((2, len(around), GRAM + 1), np.uint64)
        np.cumsum(values[around[:, :GRAM][:, ::-1]] * power, axis=1, out=sums[0, :, 1:])
        np.cumsum(values[around[:, GRAM:]] * power, axis=1, out=sums[1, :, 1:])
        out.append(sums)
    return out


def strings_around(sums: list[np.ndarray], at: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of the x bytes before and the GRAM - x bytes after each core."""
    return [mixed(before[at, x] * np.uint64(0xD6E8FEB86659FD93) + after[at, GRAM - x] + x.astype(np.uint64)) for before, after in sums]


def names_around(around: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of all the bytes around each core."""
    words = np.ascontiguousarray(np.pad(around, ((0, 0), (0, -2 * GRAM % 8)))).view(np.uint64)
    place = np.arange(1, words.shape[1] + 1, dtype=np.uint64) * BASE
    return [mixed(words + seed * place).sum(1, dtype=np.uint64) for seed in np.array([1, 3], np.uint64)]


def find_members(batches, hot: int):
    """Members of the buckets of cores, from texts (a, b, text, cores), with the bytes around them and the range of how
    many bytes before the core the starts have: equal ones in the same block are marks, one of each goes on."""

    def flush(waiting):
        a, b, pos, x0, x1, bucket, n, whole = (np.concatenate([w[i] for w in waiting]) for i in range(8))
        check = np.concatenate([w[8] for w in waiting])
        around = np.concatenate([w[9] for w in waiting])
        many = n > hot
        # members of large buckets, by start: a string is then a bucket of its own
        row = np.repeat(np.flatnonzero(many), (x1 - x0 + 1)[many])
        for k in range(0, len(row), 1 << 16):
            part = row[k : k + (1 << 16)]
            x = x0[part] + k + np.arange(len(part)) - np.searchsorted(row, part)
            mine = np.unique(part)
            one, two = strings_around(sums_around(around[mine]), np.searchsorted(mine, part), x)
            key = mixed(one + mixed(bucket[part].view(np.uint64) * BASE + check[part].view(np.uint64)))
            yield from sent(a[part], b[part], pos[part], x, x, key.view(np.int64), two.view(np.int64), np.zeros((len(part), 2 * GRAM), np.uint8), whole[part])
        yield from sent(*(c[~many] for c in (a, b, pos, x0, x1, bucket, check, around, whole)))

    def sent(a, b, pos, x0, x1, bucket, check, around, whole):
        if not len(a):
            return
        again, one = grouped(bucket, check, *names_around(around), x0, x1)
        yield from marked(np.flatnonzero(again & ~whole), a, b, pos - x1, pos - x0, MEMBER, "bucket")
        yield table(
            [*KEY, *MEMBER], a=a[one], b=b[one], lo=(pos - x1)[one], hi=(pos - x0)[one], bucket=bucket[one], check=check[one], x0=x0[one], x1=x1[one],
            around=fixed(around[one]), whole=(again | whole)[one], mark=np.zeros(len(one), bool),
        )

    waiting, total = [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            text, cores = batch.column(2)[row].as_py(), pc.list_flatten(batch.column(3).slice(row, 1))
            raw = np.frombuffer(b"\0" * GRAM + text + b"\0" * GRAM, np.uint8)
            at, place, lo, hi, n, bucket = (cores.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6))
            whole = cores.field(6).to_numpy(zero_copy_only=False)
            for k in range(0, len(at), 1 << 12):
                part = slice(k, k + (1 << 12))
                pos = at[part] + place[part]
                x0, x1 = np.maximum(0, pos - hi[part]), np.minimum(np.where(place[part] == PLACES[0], GRAM, GRAM - 1), pos - lo[part])
                sides = np.concatenate([np.arange(GRAM), np.arange(GRAM + CORE, 2 * GRAM + CORE)])
                check = np.array([xxhash.xxh3_64_intdigest(text[p : p + CORE]) for p in pos.tolist()], np.uint64).view(np.int64)
                m = len(pos)
                ids = (np.full(m, batch.column(i)[row].as_py(), np.int64) for i in (0, 1))
                waiting.append((*ids, pos, x0, x1, bucket[part], n[part], whole[part], check, raw[pos[:, None] + sides]))
                total += m
                if total >= 1 << 14:
                    yield from flush(waiting)
                    waiting, total = [], 0
    if waiting:
        yield from flush(waiting)


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of equal size, as a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def compared(rows: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
    """Marks of the starts of members, in whole buckets or a part of one, whose string is there again; and one of each
    of equal members."""
    a, b, lo, hi, bucket, check, x0, x1 = (rows.column(i).to_numpy() for i in range(8))
    around = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint8).reshape(-1, 2 * GRAM)
    whole = rows.column(9).to_numpy()
    sums, again = sums_around(around), np.zeros((len(a), GRAM + 2), bool)
    core = mixed(bucket.view(np.uint64) * BASE + mixed(check.view(np.uint64)))
    for x in range(int(x0.min()), int(x1.max()) + 1):
        at = np.flatnonzero((x0 <= x) & (x <= x1))
        one, two = strings_around(sums, at, np.full(len(at), x))
        again[at, x] = grouped(two, mixed(one + core[at]))[0]
    again[whole] = False
    edge = np.diff(np.pad(again, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    pos = hi.astype(np.int64) + x0
    marks = table(KEY, a=a[row], b=b[row], lo=pos[row] - last, hi=pos[row] - first)
    twice, one_of = grouped(bucket, check, *names_around(around), x0, x1)
    one_of = np.sort(one_of)
    return marks, rows.take(pa.array(one_of)).set_column(9, "whole", pa.array((whole | twice)[one_of]))


def refine_members(batches):
    """Marks of members sorted by bucket, check and bytes around; those that are marks already pass."""
    marks: list[pa.RecordBatch] = []
    out = [n for n, _ in KEY]
    waiting: pa.Table | None = None
    for batch in unmarked(batches, 10, marks):
        yield from (m.select(out) for m in marks)
        marks.clear()
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
        if waiting.num_rows < HOT:
            continue
        waiting = waiting.combine_chunks()
        bucket = waiting.column("bucket").to_numpy()
        end = int(np.flatnonzero(bucket == bucket[-1])[0])  # the last bucket may go on
        if end:
            yield compared(waiting.slice(0, end))[0]
            waiting = waiting.slice(end)
        elif waiting.num_rows > 4 * HOT:  # rows of equal documents, of which one goes on
            found, waiting = compared(waiting)
            yield found
    yield from (m.select(out) for m in marks)
    if waiting is not None and waiting.num_rows:
        yield compared(waiting.combine_chunks())[0]


def merge_spans(batches):
    """a, b, start, end: the maximal runs of bytes that marks cover; these are sorted by text and first start."""
    last: tuple[int, int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, lo, hi = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        end = hi + LENGTH
        if last is not None:
            a, b, lo, end = (np.concatenate([[x], y]) for x, y in zip(last, (a, b, lo, end)))
        new_text = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        # the furthest end so far within a text, by offsets that put later texts beyond earlier ones
        shift = np.repeat(np.arange(len(new_text), dtype=np.int64), np.diff(np.append(new_text, len(a)))) << 33
        reach = np.maximum.accumulate(end + shift)
        first = np.flatnonzero(np.concatenate([[True], lo[1:] + shift[1:] > reach[:-1]]))
        stop = np.append(first[1:], len(a)) - 1
        spans = a[first], b[first], lo[first], (reach - shift)[stop]
        last = tuple(int(x[-1]) for x in spans)
        yield table(SPAN, **{n: x[:-1] for (n, _), x in zip(SPAN, spans)})
    if last is not None:
        yield table(SPAN, **{n: np.array([x]) for (n, _), x in zip(SPAN, last)})


SPAN = [("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]


def refined(rows: DataFrame, name: str) -> DataFrame:
    """Rows (place, x, y, …), x and y being the buckets of a place and of that GRAM bytes later, with the number of
    their joint bucket, and how many rows it has; rows alone in theirs are gone."""
    sizes = rows.groupBy("place", "x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    numbered = through_table(sizes.withColumn("bucket", F.monotonically_increasing_id()), name)
    return rows.join(numbered, ["place", "x", "y"]).drop("x", "y")


def refined_cores(left: DataFrame) -> DataFrame:
    """a, b, at, place, lo, hi, whole, bucket, n of the cores whose bucket of depth CORE has others."""
    run = ["a", "b", "at", "lo", "hi", "whole"]
    # starts of a run whose core is at a place: those up to GRAM before it
    has = {p: (F.col("hi") >= F.col("at") + p - (GRAM if p == PLACES[0] else GRAM - 1)) & (F.col("lo") <= F.col("at") + p) for p in PLACES}
    ids = {-2 * GRAM: "g0", -GRAM: "g1", 0: "gram", GRAM: "g3", 2 * GRAM: "g4"}

    def places(buckets: dict, needed: dict) -> DataFrame:
        entry = [F.when(needed[p], F.struct(F.lit(p).alias("place"), F.col(buckets[p]).cast("long").alias("x"), F.col(buckets[p + GRAM]).cast("long").alias("y"))) for p in needed]
        return F.explode(F.filter(F.array(*entry), lambda s: s["x"].isNotNull() & s["y"].isNotNull()))

    needed = {p: has.get(p, F.lit(False)) | has.get(p - GRAM, F.lit(False)) for p in (-2 * GRAM, -GRAM, 0, GRAM)}
    depth_100 = refined(left.select(*run, places(ids, needed).alias("s")).select(*run, "s.*"), "depth-100")
    names = {p: f"b{k}" for k, p in enumerate((-2 * GRAM, -GRAM, 0, GRAM))}
    by_run = through_table(depth_100.groupBy(*run).agg(*(F.max(F.when(F.col("place") == p, F.col("bucket"))).alias(n) for p, n in names.items())), "runs-100")
    return refined(by_run.select(*run, places(names, has).alias("s")).select(*run, "s.*"), "depth-150")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes), kept (binary): one row for each row of ``docs``.

    Strings are compared in the input as it is, overlaps in one document included; kept is what no repeated string
    covers, which may cut a character in two. Null text is empty, and a text of fewer than LENGTH bytes stays as it
    is. Repeated rows are documents of their own, and so repeat each other; null ids stay; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # rows of the same id and text share a key, and have the same strings repeated
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("a", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("b", F.xxhash64("text"))
    key = F.xxhash64("a", "b")
    texts = keyed.filter(F.octet_length("text") >= LENGTH).select("a", "b", "text")
    grams = texts.mapInArrow(count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    shared = through_table(grams.filter("n > 1"), "shared-grams")
    least = max(HOT, (shared.agg(F.sum("n")).first()[0] or 0) // SHARE)
    many = np.sort(shared.filter(F.col("n") > least).select("gram").toArrow().column(0).to_numpy())  # SHARE at most
    there = bit_map(shared.select("gram"))

    runs = texts.mapInArrow(lambda batches: find_runs(batches, there, many), RUN_SCHEMA)
    ordered = runs.repartition("gram", "salt").sortWithinPartitions("gram", "c1", "c2")
    compared_runs = through_table(ordered.mapInArrow(lambda batches: refine_runs(batches, many), LEFT_SCHEMA), "compared-runs")
    cores = through_table(refined_cores(compared_runs.filter("not mark")), "cores")
    # at most three cores for each run of a text
    by_text = cores.groupBy("a", "b").agg(F.collect_list(F.struct("at", "place", "lo", "hi", "n", "bucket", "whole")).alias("cores"))
    of = Concerned(cores.select(key).distinct(), texts, key).some().join(by_text, ["a", "b"])
    members = of.select("a", "b", F.col("text").cast("binary"), "cores").mapInArrow(lambda batches: find_members(batches, HOT), MEMBER_SCHEMA)
    ordered = members.repartition("bucket").sortWithinPartitions("bucket", "check", "around")
    found = through_table(ordered.mapInArrow(refine_members, MARK_SCHEMA), "marked-members")

    marks = compared_runs.filter("mark").select("a", "b", "lo", "hi").union(found)
    spans = marks.repartition("a", "b").sortWithinPartitions("a", "b", "lo").mapInArrow(merge_spans, "a long, b long, start long, end long")
    # spans are LENGTH bytes apart or longer: far less than the text itself
    spans = through_table(spans.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")

    def cut(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sizes, found, kept = [], [], []
                for t, mine in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    data = t.encode()
                    at = [0, *(x for s in mine or () for x in (s["start"], s["end"])), len(data)]
                    sizes.append(len(data))
                    found.append(mine or [])
                    kept.append(b"".join(data[a:b] for a, b in zip(at[::2], at[1::2])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, schema.field(2).type), pa.array(kept, pa.binary())], schema=schema)

    concerned = Concerned(spans.select(key), keyed, key)
    joined = concerned.some().join(spans, ["a", "b"], "left").select("doc_id", "text", "spans")
    cut_schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    rest = concerned.others().select("doc_id", F.col("text").cast("binary").alias("kept"))
    no_spans = F.array().cast("array<struct<start: long, end: long>>")
    return joined.mapInArrow(cut, cut_schema).union(rest.select("doc_id", F.octet_length("kept").cast("long"), no_spans, "kept"))


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what without_repeats gives."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
