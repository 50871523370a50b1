"""Toxicity by compression distance: how much better a text compresses with a dictionary of toxic text.

Fitting (on the driver, over a bounded sample of the labelled rows that may be learned from):

* Texts are cut into windows of `WINDOW_WORDS` words. One zstandard dictionary is trained on ordinary windows.
* Words that toxic texts use in clearly more different surroundings than ordinary ones do are its marks; the
  other dictionary is trained on the toxic texts' runs of marks. Counting surroundings rather than
  occurrences keeps copies of one text from making marks of its accidental words.
* The toxic side compresses with ordinary + toxic dictionary, the ordinary side with ordinary dictionary + as
  many bytes that no text holds. Everything else alike, the two lengths of a window differ only by what the
  toxic dictionary explains.
* From a text's windows come a few features (mean and largest saving, shares of windows that save). A
  logistic model is calibrated on texts that trained no dictionary, weighted back to the true class shares.

Scoring reads every whole text, window by window, in Arrow batches. Labels, language, source and id are never
inputs of a score. Limits of the sample are parameters: at most `FIT_TEXTS` texts a class and purpose, of at
most `FIT_BYTES` bytes each; which ones is decided by a hash of the text.

Defined results: null and empty text have no window that saves and get the model's score for that; without
labels, or with one class only, all scores are the share of toxic labels (0 without labels); rows with a null
id are scored, never learned from, and count as held out; a repeated row gets the same score each time;
an id labelled both ways counts as toxic; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW_WORDS = 10
LEVEL = 19
#: Tables much smaller than the level's own: they are cleared for each window.
TABLES = {"hash_log": 14, "chain_log": 16}
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 4_096
FIT_TEXTS, FIT_BYTES = 2_000, 65_536
#: A mark is used in at least this share of the toxic texts' number of surroundings (3 at least), and this
#: many times as often as in ordinary text.
MARK_SHARE, MARK_RATIO = 0.004, 20
HELD_OUT = (5, 0)

# Characters at which words end, besides white space; the rest of ASCII is lower-cased.
_TABLE = bytes(
    32 if chr(i) in ".,;:!?\"'()[]{}<>|\t\n\r\v\f" else i + 32 if 65 <= i <= 90 else i for i in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(ws: list[bytes], size: int = WINDOW_WORDS) -> list[bytes]:
    return [b" " + b" ".join(ws[i : i + size]) + b" " for i in range(0, len(ws), size)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=32 if size > 8192 else 16, d=8 if size > 8192 else 6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves are the dictionary
        return b"".join(samples)[-size:]


def marks(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Words of toxic text by the number of different surroundings."""

    def surroundings(texts):
        seen = defaultdict(set)
        for t in texts:
            ws = [b"", *words(t), b""]
            for before, word, after in zip(ws, ws[1:], ws[2:], strict=False):
                seen[word].add((before, after))
        return seen, max(1, sum(map(len, seen.values())))

    (t, all_t), (o, all_o) = surroundings(toxic), surroundings(ordinary)
    least = max(3, MARK_SHARE * len(toxic))
    return {
        w
        for w, s in t.items()
        if len(s) >= least and len(s) * all_o >= MARK_RATIO * (len(o.get(w, ())) + 1) * all_t
    } or {w for w, s in t.items() if w not in o}


class Compressors:
    def __init__(self, plain: bytes, toxic: bytes):
        import zstandard

        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            source_size=90,
            dict_size=ORDINARY_BYTES + TOXIC_BYTES,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
            **TABLES,
        )

        def make(data):
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)

        # Bytes that UTF-8 never uses, in no order.
        filler = np.random.default_rng(0).integers(248, 256, len(toxic), dtype=np.uint8).tobytes()
        self.sides = make(plain + toxic), make(plain + filler)
        self.toxic, self.plain = (side.compress for side in self.sides)

    def features(self, text: str | None) -> list[float]:
        parts = windows(words(text))
        plain, toxic = self.plain, self.toxic
        s = np.array([len(plain(p)) - len(toxic(p)) for p in parts] or [0], dtype=np.float64)
        gain = np.maximum(s, 0)
        return [
            gain.mean(),
            np.maximum(s - 3, 0).mean(),
            (s >= 3).mean(),
            (s >= 5).mean(),
            min(gain.max(), 12.0),
            np.log1p(len(parts)),
        ]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic model (the first is the constant), by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2 * len(x) / 1000 + 1e-3)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """`score(text)`: the probability that the label is 1."""

    def __init__(self, plain=b"", toxic=b"", centre=None, scale=None, weights=None, constant=0.0):
        self.plain, self.toxic, self.constant = plain, toxic, constant
        self.centre, self.scale, self.weights = centre, scale, weights

    def scorer(self):
        if self.weights is None:
            return lambda texts: np.full(len(texts), self.constant)
        features = Compressors(self.plain, self.toxic).features

        def score(texts):
            x = np.array([features(t) for t in texts]).reshape(len(texts), -1)
            z = self.weights[0] + ((x - self.centre) / self.scale) @ self.weights[1:]
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


def held_out(id_col: str) -> Column:
    mod, rest = HELD_OUT
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the labelled rows that aren't held out."""
    marked = labels.where(F.col(label).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("y"))
    # Chosen by key and hash; the texts themselves are fetched only for what is chosen.
    t = F.coalesce(F.col(text), F.lit(""))
    keys = docs.select(F.col(id_col), F.xxhash64(t).alias("h"), F.octet_length(t).alias("size"))
    rows = materialise(keys.join(marked, id_col).select(id_col, "h", "size", (F.col("y") > 0).alias("y")), "labelled")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model(constant=float(counts.get(True, 0) > 0))
    train = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(3)) > 0  # two thirds train the dictionaries, one third calibrates
    chosen = None
    for y in (True, False):
        for use in (True, False):
            part = rows.where((F.col("y") == y) & (train == use) & (F.col("size") <= FIT_BYTES))
            part = part.groupBy("h").agg(F.min(id_col).alias("id"))
            part = part.orderBy(F.xxhash64("h"), "h").limit(FIT_TEXTS).select("id", "h", F.lit(y).alias("y"), F.lit(use).alias("use"))
            chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialise(chosen, "fit-sample")  # at most 4 x FIT_TEXTS rows
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))
    found = texts.join(F.broadcast(chosen), ["id", "h"]).select("t", "h", "y", "use").dropDuplicates(["h", "y", "use"])
    sample = {(y, use): [] for y in (True, False) for use in (True, False)}
    for r in found.orderBy("h").collect():
        sample[r["y"], r["use"]].append(r["t"])
    ordinary, toxic = sample[False, True], sample[True, True]
    own = marks(toxic, ordinary)
    plain = _dictionary([w for t in ordinary for w in windows(words(t))], ORDINARY_BYTES)
    runs = [w for t in toxic for w in windows([x for x in words(t) if x in own], 8)]
    special = _dictionary(runs, TOXIC_BYTES)
    features = Compressors(plain, special).features
    tune = [(t, y) for y in (True, False) for t in (sample[y, False] or sample[y, True])]
    if not tune or not own:
        return Model(constant=counts[True] / total)
    x = np.array([features(t) for t, _ in tune])
    y = np.array([y for _, y in tune], dtype=np.float64)
    weight = np.where(y > 0, counts[True] / total / y.mean(), counts[False] / total / (1 - y.mean()))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(plain, special, centre, scale, _logistic((x - centre) / scale, y, weight))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document: id, `held_out`, `score`, `predicted`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(t: pa.Array) -> pa.Array:
        own = shared.value
        if not hasattr(own, "_ready"):
            own._ready = own.scorer()
        return pa.array(own._ready(t.to_pylist()), pa.float64())

    return docs.select(id_col, held_out(id_col).alias("held_out"), scored(F.col(text)).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
