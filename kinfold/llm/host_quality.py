"""Quality rules with host verdicts.

Every document is measured and held against the rules; failures are summed by host; a host's rate of
each rule is shrunk towards the rate of all hosts with a beta prior fitted to the hosts (method of
moments); a host whose shrunk rate of some rule passes that rule's limit is rejected, and its documents
with it. Small hosts stay near the common rate, so a few bad pages never condemn them.

Measures: `n_words` (`[^\\x20\\x09-\\x0D]+`), `word_chars` (code points in words), `n_symbols`
(`[#*$%&|<>]`), `n_dup_lines` (lines with a word, equal to an earlier line of the text),
`n_repeat_words` (words inside 5-word windows that the text has at least twice).

Defined results: null text counts as empty (no words, so it fails). A null host has no verdict; its
documents are judged by their own rules. An empty table gives an empty result. Repeated rows count
once each. Other columns of the input pass through unread, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import tokens as TK
from .common import free_name

WINDOW = 5
PIECE_BYTES = 512 << 10
#: Fewer words than this, or a larger share of words in repeated windows, fails a document.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Shrunk failure rates above which a host is rejected.
HOST_LIMITS = {"short": 0.5, "repeats": 0.5, "dup_lines": 0.6, "symbols": 0.6}
#: Hosts are fetched by broadcast up to this many rejected ones, else joined by shuffle.
BROADCAST_HOSTS = 100_000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DOC = np.uint64(0xD6E8FEB86659FD93)

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(texts: pa.Array) -> list[np.ndarray]:
    w = K.Words(texts)
    data, offsets = w.data, w.offsets
    chars = K.per_doc(w.inside & ((data & 0xC0) != 0x80), offsets)
    symbols = K.per_doc(_SYMBOL[data], offsets)
    # Lines: from each text's start and from behind each line feed, to the next feed or the text's end.
    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    begin = begin[begin < len(data)]
    doc = np.searchsorted(offsets, begin, side="right") - 1
    ends = np.append(feeds, len(data))[np.searchsorted(feeds, begin)]
    ends = np.minimum(ends, offsets[doc + 1])
    seen = np.concatenate([[0], np.cumsum(w.inside, dtype=np.int64)])
    full = seen[ends] > seen[begin]
    begin, ends, doc = begin[full], ends[full], doc[full]
    key = K.mix(w.bytes.hash(begin, ends) + doc.astype(np.uint64) * _DOC)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    dup_lines = np.bincount(doc[order[again]], minlength=w.docs)
    # Repeated 5-word windows.
    at, doc = K.windows(w.first, WINDOW)
    key = K.Prefix(w.hashes()).hash(at, at + WINDOW)
    twice = K.repeated(K.mix(key + doc.astype(np.uint64) * _DOC))
    repeats = K.per_doc(K.covered(len(w.start), at[twice], WINDOW), w.first)
    return [w.counts, chars, symbols, dup_lines, repeats]


def measures(text: Column) -> Column:
    """The five measures of a text as one struct."""

    @F.arrow_udf(f"struct<{','.join(f'{f}:bigint' for f in FIELDS)}>")
    def udf(t: pa.Array) -> pa.Array:
        TK.forget()
        parts = [_measure(t[a:b]) for a, b in K.pieces(t, PIECE_BYTES)]
        cols = [
            np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]).astype(np.int64)
            for i in range(len(FIELDS))
        ]
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], FIELDS)

    return udf(text)


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words")
    )


def rules(m: str) -> dict[str, Column]:
    """The rules whose failures are counted by host."""
    words = F.col(f"{m}.n_words")
    return {
        "short": words < MIN_WORDS,
        "repeats": 100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * words,
        "dup_lines": 100 * F.col(f"{m}.n_dup_lines") > 3 * words,
        "symbols": 10 * F.col(f"{m}.n_symbols") > words * 3,
    }


def host_rates(measured: DataFrame, host: str, m: str) -> DataFrame:
    """One row per host: documents, and for each rule the failures and the shrunk rate.

    The prior of a rule has the hosts' mean rate p and precision s = p(1-p)/v - 1, with v the hosts'
    variance; without spread between hosts the precision is the mean host size times 100. The sums over
    hosts are one row, joined back as a one-row broadcast.
    """
    names = list(HOST_LIMITS)
    tests = rules(m)
    hosts = (
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(tests[r].cast("long")).alias(f"k_{r}") for r in names],
        )
    )
    prior = hosts.agg(
        F.avg("n").alias("mean_n"),
        *[F.avg(F.col(f"k_{r}") / F.col("n")).alias(f"p_{r}") for r in names],
        *[F.var_pop(F.col(f"k_{r}") / F.col("n")).alias(f"v_{r}") for r in names],
    )
    joined = hosts.join(F.broadcast(prior))  # one row: an aggregate without keys
    for r in names:
        p, v = F.col(f"p_{r}"), F.col(f"v_{r}")
        s = F.when(v > 1e-12, F.greatest(p * (1 - p) / v - 1, F.lit(1.0))).otherwise(100 * F.col("mean_n"))
        joined = joined.withColumn(f"rate_{r}", (F.col(f"k_{r}") + p * s) / (F.col("n") + s))
    reject = F.lit(False)
    for r in names:
        reject = reject | (F.col(f"rate_{r}") > HOST_LIMITS[r])
    return joined.select(
        "host", "n", *[f"k_{r}" for r in names], *[f"rate_{r}" for r in names], reject.alias("rejected")
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source") -> tuple[DataFrame, str, str, str]:
    """`docs` with the measures, `failed` and `kept` columns (their names are returned, as they avoid
    names that `docs` has)."""
    m, failed, kept = (free_name(docs, c) for c in ("measures", "base_failed", "kept"))
    gone = free_name(docs, "rejected_host")
    narrow = docs.select(F.col(host).alias("__host"), measures(F.col(text)).alias("__m"))
    rejected = (
        host_rates(narrow, "__host", "__m").where("rejected").select(F.col("host").alias(gone))
    )
    few = rejected.limit(BROADCAST_HOSTS + 1).toArrow()
    out = docs.withColumn(m, measures(F.col(text))).withColumn(failed, base_failed(m))
    if few.num_rows == 0:
        return out.withColumn(kept, ~F.col(failed)), m, failed, kept
    if few.num_rows <= BROADCAST_HOSTS:
        side = F.broadcast(docs.sparkSession.createDataFrame(few))
    else:
        side = rejected
    out = out.join(side, out[host] == F.col(gone), "left")
    return (
        out.withColumn(kept, ~F.col(failed) & F.col(gone).isNull()).drop(gone),
        m,
        failed,
        kept,
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    out, _, _, kept = judge(docs, text, host)
    return out.where(F.col(kept)).select(*docs.columns)
