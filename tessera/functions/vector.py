"""Vector arithmetic on array<double> columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where either vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def negative_distance(a: Column | str, b: Column | str) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalized(a: Column | str) -> Column:
    n = norm(a) + F.lit(1e-8)
    return F.transform(_c(a), lambda x: x / n)


def blended(a: Column | str, b: Column | str, alpha: float) -> Column:
    """alpha parts of a and the rest of b, brought to length 1."""
    return normalized(F.zip_with(_c(a), _c(b), lambda x, y: x * alpha + y * (1 - alpha)))


def relevance(similarity: Column) -> Column:
    """A cosine brought to [0, 1]; 0.5 where there is none."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1) / 2)), F.lit(0.5))


def word_bucket(word: Column, size: int = 64) -> Column:
    """The place in a bag of hashed words: by the first 4 hex digits of the word's md5."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 4), 16, 10).cast("int") % size


def hashed_words(words: Column, size: int = 64) -> Column:
    """A bag of words as a vector: each word counts in its bucket. For short texts: operators.vectors.hashed_counts() counts over rows."""
    runs = F.sort_array(F.transform(words, lambda w: word_bucket(w, size)))
    # one pass over the sorted buckets: the counts so far, and the bucket that is being counted
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0).alias("at"), F.lit(0.0).alias("n"))

    def closed(acc, upto):
        return F.concat(acc.done, F.array(acc.n), F.array_repeat(F.lit(0.0), upto - acc.at - 1))

    def step(acc, b):
        return F.when(b == acc.at, F.struct(acc.done.alias("done"), acc.at.alias("at"), (acc.n + 1).alias("n"))).otherwise(F.struct(closed(acc, b).alias("done"), b.alias("at"), F.lit(1.0).alias("n")))

    return F.aggregate(runs, start, step, lambda acc: closed(acc, F.lit(size)))
