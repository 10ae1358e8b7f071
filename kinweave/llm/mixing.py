"""Mixing sources to target shares of a total size in tokens, by hash-seeded Poisson replication.

Each document's number of copies is drawn by inverting a Poisson distribution, truncated at the source's cap, at a number hashed from
its id and text; its mean is the source's repetition rate, so that the expected size of a source is its share of the total. The draw depends on
nothing but the row, the seed and the rates, so a lost task repeats it exactly. Copies are then shuffled globally by a second hash.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators.skew import skew_join
from kinweave.plans.staging import stage

#: Bytes up to which a vocabulary file is sent to the executors.
VOCABULARY_BYTES = 32 << 20
#: Fixed value: the public split pattern of byte-level vocabularies of 50,000 tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, object] = {}


def read_vocabulary(path: str) -> bytes:
    """A file of base64 tokens and ranks, one a line, read once by the driver."""
    with open(path, "rb") as f:
        found = f.read(VOCABULARY_BYTES + 1)
    if len(found) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {VOCABULARY_BYTES} bytes")
    return found


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary, once a process."""
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        _encoders[key] = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def count_tokens(text: str | None, vocabulary: bytes) -> int:
    return len(encoder(vocabulary).encode_ordinary(text)) if text else 0


def with_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``n_tokens``, the size of the whole text; 0 for NULL and empty texts. ``vocabulary`` is a path that the driver reads and sends to the executors."""
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # at most VOCABULARY_BYTES

    @F.pandas_udf(T.LongType())
    def size(texts: pd.Series) -> pd.Series:
        encode = encoder(sent.value).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return documents.withColumn("n_tokens", size(F.col("text")))


def clean_source(c: Column) -> Column:
    """Source names without capitals and outer blanks; NULL stays NULL."""
    return F.lower(F.trim(c))


def truncated_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson number with mean ``rate``, cut off at ``cap``."""
    below, mean = 0.0, 0.0
    for k, p in enumerate(_poisson(rate, cap)):
        mean += k * p
        below += p
    return mean + cap * (1 - below)


def _poisson(rate: float, cap: int) -> Iterator[float]:
    """Poisson probabilities of 0 .. cap - 1, carried as logarithms: those of large rates begin below the smallest float."""
    log, step = -rate, math.log(rate) if rate > 0 else -math.inf
    for k in range(cap):
        yield math.exp(log)
        log += step - math.log(k + 1)


def thresholds(mean: float, cap: int) -> list[float]:
    """The distribution function at 0 .. cap - 1 of the truncated Poisson with this mean; a draw u has as many copies as thresholds below it."""
    if cap <= 0 or mean <= 0:
        return []
    if mean >= cap:
        return [-1.0] * cap
    lo, hi = 0.0, 1.0
    while truncated_mean(hi, cap) < mean:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if truncated_mean(mid, cap) < mean else (lo, mid)
    return list(accumulate(_poisson(hi, cap)))


def rates(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per source of either table: ``source``, ``target_share``, ``max_repeats``, ``n_docs``, ``n_tokens`` (available), ``rate``, ``draw``.

    Without ``total_tokens`` the total is the largest at which every source that has both documents and a target reaches its part of
    the shares present; with it, sources that cannot reach theirs are repeated as often as they may.
    """
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    want = targets.groupBy(clean_source(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(1)).cast("int").alias("max_repeats")
    )
    both = stage(want.withColumnRenamed("source", "_s").join(have, F.col("_s").eqNullSafe(F.col("source")), "full").select(
        F.coalesce("source", "_s").alias("source"), "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")
    ), "sources")
    present = both.where("target_share > 0 and n_tokens > 0 and max_repeats > 0")
    share, most = present.agg(F.sum("target_share"), F.min(F.col("max_repeats") * F.col("n_tokens") / F.col("target_share"))).first()
    total = float(total_tokens) if total_tokens is not None else (most or 0.0) * (share or 0.0)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean = [
                min(float(c), s / share * total / n) if s == s and s > 0 and n > 0 and c == c and c > 0 else 0.0
                for s, c, n in zip(pdf["target_share"], pdf["max_repeats"], pdf["n_tokens"])
            ]
            yield pdf.assign(rate=mean, draw=[thresholds(m, int(c) if c == c else 0) for m, c in zip(mean, pdf["max_repeats"].astype("float64"))])

    return both.mapInPandas(draw, "source string, target_share double, max_repeats int, n_docs long, n_tokens long, rate double, draw array<double>")


def _unit(*of) -> Column:
    """A number in (0, 1) hashed from columns."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str, seed: int = 0, total_tokens: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """The mixed corpus: one row per copy with all columns of the document, its cleaned ``source``, ``n_tokens``, ``copy`` (from 1) and ``order_key``.

    Rows are spread over partitions and ordered within them by ``order_key``. Sources without a target, or with a share or cap of
    NULL, 0 or less (a NULL cap counts as 1), are left out. Rows with equal id and text get equally many copies. NULL and empty texts have size 0 and are drawn like
    others of their source. Where the target table has a source twice, its shares add up and the smaller cap holds. Columns of the input named like the
    added ones are replaced.
    """
    sized = sized if sized is not None else sizes(documents, vocabulary)
    r = rates(sized, targets, total_tokens).where("rate > 0").select("source", "draw")
    rows = skew_join(sized, r, "source", "inner", ["doc_id"])
    u = _unit(F.lit(seed), F.col("doc_id"), F.col("text"))
    copies = F.size(F.filter("draw", lambda t: t < u))
    out = rows.withColumn("_n", copies).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    out = out.drop("_n", "draw").withColumn("order_key", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text"), F.col("copy")))
    return out.repartition("order_key").sortWithinPartitions("order_key")


def sizes(documents: DataFrame, vocabulary: str) -> DataFrame:
    """The documents with cleaned sources and their sizes, written once."""
    return stage(with_tokens(documents.drop("n_tokens", "copy", "order_key", "draw").withColumn("source", clean_source(F.col("source"))), vocabulary), "sized")


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str, seed: int = 0, total_tokens: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """The shares reached, for every source of either table: ``source``, ``target_share``, ``max_repeats``, ``n_docs``, ``n_tokens``, ``rate``, ``mixed_docs``, ``mixed_tokens``, ``actual_share``."""
    sized = sized if sized is not None else sizes(documents.select("doc_id", "source", "text"), vocabulary)
    r = stage(rates(sized, targets, total_tokens), "rates")
    u = _unit(F.lit(seed), F.col("doc_id"), F.col("text"))
    drawn = skew_join(sized, r.where("rate > 0").select("source", "draw"), "source", "inner", ["doc_id"]).withColumn("_n", F.size(F.filter("draw", lambda t: t < u)).cast("long"))
    got = stage(drawn.groupBy("source").agg(F.sum("_n").alias("mixed_docs"), F.sum(F.col("_n") * F.col("n_tokens")).alias("mixed_tokens")), "mixed")
    total = got.agg(F.sum("mixed_tokens")).first()[0] or 1
    zero = F.lit(0).cast("long")
    return r.drop("draw").join(got, "source", "left").select(
        *[c for c in r.columns if c != "draw"], F.coalesce("mixed_docs", zero).alias("mixed_docs"), F.coalesce("mixed_tokens", zero).alias("mixed_tokens"),
        (F.coalesce("mixed_tokens", zero) / F.lit(float(total))).alias("actual_share"),
    )
