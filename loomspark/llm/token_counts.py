"""Token counts: each distinct pre-token's pieces are counted once, and joined to per-document frequencies.

The vocabulary of all pre-tokens is one aggregation over the corpus. Its most frequent part, of a fixed number of
entries, is broadcast as hash and count; documents add those up where they are read. Only occurrences of rarer
pre-tokens are shuffled to meet their counts, so a frequent pre-token is never the key of a shuffle.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from loomspark.llm import pretoken
from loomspark.llm.common import arrow, id_and_text, one_core, sliced, through_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Entries of the broadcast part of the vocabulary at most: 12 bytes each.
HEAD = 1 << 18


@cache
def loaded(path: str) -> tuple[Tokenizer, tuple[str, ...]]:
    """A tokenizer that takes each text as one pre-token, and the strings of the file's added tokens."""
    one_core()
    whole = Tokenizer.from_file(path)
    added = tuple(sorted(t.content for t in whole.get_added_tokens_decoder().values()))
    whole.encode_special_tokens = True
    whole.no_truncation()
    whole.no_padding()
    whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return whole, added


def piece_counts(words: list[str], path: str) -> np.ndarray:
    return pretoken.encoded_words(loaded(path)[0], words)[1] if words else np.zeros(0, np.int64)


VOCABULARY = pa.schema([("pretoken", pa.string()), ("freq", pa.int64())])
COUNTED = pa.schema([("pretoken", pa.string()), ("freq", pa.int64()), ("hash", pa.int64()), ("n_pieces", pa.int32())])
PARTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.int64()), ("n_known", pa.int64()), ("pretoken", pa.string()), ("freq", pa.int64())])


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """pretoken, freq, hash, n_pieces: one row for each distinct pre-token of the corpus."""

    def distinct(batches):
        specials = loaded(path)[1]
        for batch in sliced(batches):
            for _, texts in pretoken.part_blocks(batch.column(0).to_pylist()):
                found = pretoken.split(pretoken.cut_specials(texts, specials)[0], True)
                yield arrow({"pretoken": found.words(), "freq": np.bincount(found.code, minlength=len(found.hashes))}, VOCABULARY)

    def count(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            hashes = [h for a, b in pretoken.blocks(words) for h in hash_of(words[a:b])]
            yield arrow({"pretoken": batch.column(0), "freq": batch.column(1), "hash": np.array(hashes, np.uint64).view(np.int64), "n_pieces": piece_counts(words, path)}, COUNTED)

    found = docs.select("text").mapInArrow(distinct, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return through_table(found.mapInArrow(count, "pretoken string, freq long, hash long, n_pieces int"), "pretokens")


def hash_of(words: list[str]) -> np.ndarray:
    """The hash that pretoken.split gives each of these pre-tokens, none of which is empty."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    return pretoken.span_hashes(pretoken.symbol_values()[points], starts, ends)


def head_of(words: DataFrame, most: int) -> pd.DataFrame:
    """hash and n_pieces of the most frequent pre-tokens: at most ``most`` rows, whatever the corpus.

    The lowest frequency of those is a power of two taken from the counts by power, at most 64 rows.
    """
    powers = words.groupBy(F.floor(F.log2("freq")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    least, total = None, 0
    for row in powers:
        if (total := total + row["count"]) > most:
            break
        least = 1 << row["power"]
    chosen = words.filter(F.lit(False) if least is None else F.col("freq") >= least)
    return chosen.select("hash", "n_pieces").toPandas()


def token_counts(docs: DataFrame, path: str = TOKENIZER, limit: int = 512, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs`` (doc_id, text).

    n_tokens is what the library's encoder gives without tokens added at the ends; special strings inside a text
    are one token each. Null text counts as empty: 0 bytes, 0 tokens. Equal rows stay as many rows, a null doc_id
    stays null, and columns of other names are ignored. Long texts are counted in parts cut between pre-tokens. No rows:
    no rows.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs)
    words = vocabulary(docs, path)
    top = head_of(words, head).sort_values("hash")
    shared = spark.sparkContext.broadcast((top["hash"].to_numpy(np.int64), np.append(top["n_pieces"].to_numpy(np.int64), 0)))

    def parts(batches):
        keys, pieces = shared.value
        specials = loaded(path)[1]
        for batch in sliced(batches):
            whole = batch.column(1).to_pylist()
            empty = [k for k, t in enumerate(whole) if not t]
            told = np.zeros(len(whole), bool)
            for rows, texts in [(empty, [""] * len(empty)), *pretoken.part_blocks(whole)]:
                ids, digests = (batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 2))
                # a text's size is told with the first of its parts
                sizes = [None if told[r] or k and rows[k - 1] == r else len(whole[r].encode()) for k, r in enumerate(rows)]
                told[rows] = True
                cut, owner, after = pretoken.cut_specials(texts, specials)
                found = pretoken.split(cut, True)
                hashes = found.hashes.view(np.int64)
                at = np.searchsorted(keys, hashes)
                known = (keys[np.minimum(at, len(keys) - 1)] == hashes) if len(keys) else np.zeros(len(hashes), bool)
                number = np.where(known, pieces[np.where(known, at, len(keys))], 0)
                of = owner[found.text] if len(found.text) else found.text
                total = np.bincount(of, weights=number[found.code], minlength=len(texts)).astype(np.int64) if len(of) else np.zeros(len(texts), np.int64)
                np.add.at(total, owner[list(after)], 1) if after else None
                n = len(texts)
                yield arrow({"doc_id": ids, "n_bytes": sizes, "digest": digests, "n_known": total, "pretoken": pa.nulls(n, pa.string()), "freq": pa.nulls(n, pa.int64())}, PARTS)
                rare = ~known[found.code]
                pairs, freq = np.unique(of[rare] * len(hashes) + found.code[rare], return_counts=True)
                who, which = pairs // max(1, len(hashes)), pairs % max(1, len(hashes))
                spelt, back = np.unique(which, return_inverse=True)
                n = len(pairs)
                if n:
                    strings = pa.array(found.words(spelt), pa.string()).take(pa.array(back))
                    yield arrow({"doc_id": ids.take(pa.array(who)), "n_bytes": pa.nulls(n, pa.int64()), "digest": digests.take(pa.array(who)), "n_known": pa.nulls(n, pa.int64()), "pretoken": strings, "freq": freq}, PARTS)

    # equal rows of one id count together: each has the same tokens
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest"))
    schema = "doc_id long, n_bytes long, digest long, n_known long, pretoken string, freq long"
    found = through_table(rows.mapInArrow(parts, schema), "token-parts")
    own = found.filter("pretoken is null").select("doc_id", "digest", "n_bytes", "n_known")
    rare = found.filter("pretoken is not null").join(words.select("pretoken", "n_pieces"), "pretoken")
    rare = rare.select("doc_id", "digest", F.lit(None).cast("long").alias("n_bytes"), (F.col("freq") * F.col("n_pieces")).alias("n_known"))
    total = (
        own.unionByName(rare)
        .groupBy("doc_id", "digest")
        .agg(F.max("n_bytes").alias("n_bytes"), F.sum("n_known").alias("total"), F.count("n_bytes").alias("copies"))
        .withColumn("n_tokens", F.expr("total div copies"))
    )
    each = total.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
