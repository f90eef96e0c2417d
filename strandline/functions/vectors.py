"""Vector and score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import fixed


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null where a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def idf(df, n) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)); an empty corpus counts as one document."""
    n = F.when(n <= 0, 1).otherwise(n)
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf, length, average, df, n) -> Column:
    """A term's weight in a document; 0 and less are no weights."""
    average = F.when(average > 0, average).otherwise(length)
    saturated = tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * length / average))
    return idf(df, n) * saturated


def jaccard(a, b) -> Column:
    """Shared part of the union of two arrays; null for an empty union."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def boost(score, same_project, by: float = fixed.PROJECT_BOOST) -> Column:
    return F.least(F.lit(1.0), score + F.when(same_project, by).otherwise(0.0))


def gate(score) -> Column:
    """What becomes of a record whose nearest neighbour has this similarity."""
    return F.when(score >= fixed.DUPLICATE, "duplicate").when(score >= fixed.SIMILAR, "similar").otherwise("created")


def bucket(ts, width: int) -> Column:
    """The start of the bucket of milliseconds that ts lies in."""
    return F.floor(ts / width).cast("long") * width


def ratio(part, whole, digits: int = 6) -> Column:
    """part of whole, null for 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def sampled(key, rate: float, always=None) -> Column:
    """Bernoulli sample by a hash of the key: the same rows each time. always: rows kept in any case."""
    chosen = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000)
    return chosen if always is None else chosen | F.coalesce(always, F.lit(False))
