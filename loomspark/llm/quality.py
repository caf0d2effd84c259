"""Quality rules: a few plain counts, and a hashed n-gram log-likelihood ratio. Built-in functions only.

Tokens are words and runs of ASCII punctuation. Their uni- and bigrams are hashed into ``BUCKETS``; the ratio is that
of two multinomials over the buckets, one of trusted documents, one of the whole corpus. A document's mean weight
decides: it is dropped if its grams are, on average, markedly rarer among the trusted than in the corpus at large.
Weights are whole numbers, so that sums do not depend on the order of tasks. They are a constant array of the plan, in
which each document looks its grams up: scoring and filtering move no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import through_table

BUCKETS = 1 << 14
#: Trusted documents at most: those of the lowest hash of doc_id. Corpus counts cover all documents.
TRUSTED = 20_000
#: Added to each bucket's counts.
SMOOTHING = 0.5
#: Weights are rounded to this part of a nat.
UNIT = 1 << 20
#: Mean weight in nats from which a document is kept.
THRESHOLD = -0.25
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """The number of words in three-word windows that the text has twice or more, by the windows' 64-bit hashes."""
    n = F.size(words)
    windows = F.arrays_zip(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), F.slice(words, 2, F.greatest(n - 2, F.lit(0))), F.slice(words, 3, F.greatest(n - 2, F.lit(0))))
    hashes = F.transform(windows, lambda x: F.xxhash64(x))

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(F.sort_array(F.transform(again, lambda x: x["i"])), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(pairs, places))

    return bound(hashes, covered).cast("long")


def words_of(text: Column | str) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def tokens_of(text: Column | str) -> Column:
    return words_of(F.regexp_replace(text, r"([!-/:-@\[-`{-~]+)", " $1 "))


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"\S"))
    return (
        docs.select(F.col("doc_id").cast("long"), text.alias("text"))
        .withColumn("words", words_of("text"))
        .select(
            "doc_id",
            "text",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("words")).alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def grams(docs: DataFrame, buckets: int) -> DataFrame:
    """docs with a row for each token: place, and the buckets of the token (one) and of it and the next (two)."""
    rows = docs.withColumn("tokens", tokens_of("text")).withColumn("pairs", F.arrays_zip(F.col("tokens"), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))).alias("next")))
    rows = rows.select(*docs.columns, F.posexplode_outer("pairs").alias("place", "pair"))
    in_bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    return rows.select(
        *docs.columns,
        "place",
        F.when(F.col("place").isNotNull(), in_bucket(F.col("pair.tokens"))).alias("one"),
        F.when(F.col("pair.next").isNotNull(), in_bucket(F.col("pair.tokens"), F.col("pair.next"))).alias("two"),
    )


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED) -> DataFrame:
    """bucket, weight: the log of the ratio of smoothed shares, trusted over corpus, in whole UNITs.

    Trusted are documents of quality 1, of these ``trusted`` at most, by the hash of doc_id; a document labelled
    twice counts once. Without any, no weight says anything and all are 0. Buckets without a token have no row.
    """
    ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted).withColumn("target", F.lit(1))
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = text.join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("target", F.lit(0)).alias("target"))
    found = grams(marked, buckets).select("target", F.explode(F.array("one", "two")).alias("bucket")).filter("bucket is not null")
    counts = through_table(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").cast("long").alias("target")), "gram-counts")
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    base = math.log(raw + SMOOTHING * buckets) - math.log(target + SMOOTHING * buckets) if target else 0.0
    ratio = F.log((F.col("target") + SMOOTHING) / (F.col("raw") + SMOOTHING)) + base if target else F.lit(0.0)
    return counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("weight"))


def weighed(tokens: Column, table: list[int]) -> Column:
    """The sum of the weights of the uni- and bigrams of an array of tokens; table: the weight of each bucket."""
    array = F.from_json(F.lit(str(table)), "array<bigint>")  # folded into one constant
    weight = lambda *c: F.get(array, F.pmod(F.xxhash64(*c), F.lit(len(table))).cast("int"))

    def total(t: Column) -> Column:
        both = F.transform(t, lambda x, i: weight(x) + F.when(i < F.size(t) - 1, weight(x, F.get(t, i + 1))).otherwise(F.lit(0)))
        return F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x)

    return bound(tokens, total)


def weight_table(docs: DataFrame, labels: DataFrame, buckets: int, trusted: int) -> list[int]:
    """The weight of each bucket, 0 for one without a token."""
    out = [0] * buckets
    for row in weights(docs, labels, buckets, trusted).collect():  # at most one row for each bucket
        out[row["bucket"]] = row["weight"]
    return out


def n_grams(tokens: Column) -> Column:
    return (F.size(tokens) + F.greatest(F.size(tokens) - 1, F.lit(0))).cast("long")


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and mean_weight: one
    row for each row of ``docs``.

    mean_weight is in nats a gram; null for a text without words, which has failed the base rules. Null text has no
    words. Empty and very long texts are judged as any other, and an empty table gives no rows. Repeated rows and null
    ids stay; other columns are ignored, and nothing is kept or dropped by doc_id.
    """
    table = weight_table(docs, labels, buckets, trusted)
    rows = base_columns(docs).withColumn("tokens", tokens_of("text"))
    total = rows.withColumn("weight", weighed(F.col("tokens"), table)).withColumn("grams", n_grams(F.col("tokens")))
    verdict = total.withColumn("mean_weight", F.expr(f"try_divide(cast(weight as double), grams * cast({UNIT} as double))"))
    verdict = verdict.withColumn("kept", ~F.col("base_failed") & (F.col("weight") >= F.col("grams") * F.lit(round(threshold * UNIT))))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_weight")


def kept_documents(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged whatever their names, that the quality rules keep.

    A filter: no row is moved. Null, empty and short texts fail the base rules and go; repeated rows share a verdict.
    An empty table gives no rows.
    """
    table = weight_table(docs, labels, buckets, trusted)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    enough = bound(words_of(text), lambda w: (F.size(w) >= 50) & (100 * repeated_words(w) <= 50 * F.size(w).cast("long")))
    liked = bound(tokens_of(text), lambda t: weighed(t, table) >= n_grams(t) * F.lit(round(threshold * UNIT)))
    return docs.filter(enough & liked)
