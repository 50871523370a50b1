"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. An item's windows are its
runs of `window` words; an item with fewer words, but not none, is one window of its own length. A document
word inside any occurrence of a window is hit.

1. Fingerprints: of the hashes of `GRAM`-word grams, each run of `window - GRAM + 1` neighbouring grams keeps
   its smallest one (the first of equals). A window shared by text and item holds one whole such run, so both
   sides keep the same gram at the same place in it: no shared window can be missed.
2. Join: fingerprints of the documents meet those of the items. The item side is broadcast only when its row
   count was found to be at most `BROADCAST_ROWS`; beyond, the join is shuffled.
3. Extend: around a matching gram the (at most `window - GRAM + 1`) windows holding it are compared word by
   word with the items' windows; the spans that agree are the hits, and overlapping ones add up.

Items shorter than `window` are looked up by all grams of their own length, which costs nothing where there
is no such item.

Defined results: null or wordless text has no words and no hits; null or wordless items have no window;
items with a null id mark words but aren't counted; repeated rows of documents get one result each, repeated
items count once; an empty table on either side gives no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, row_key

WINDOW = 10
GRAM = 5
BROADCAST_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, before lower-casing (so A-Z belong to words).
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), ""))


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _GAP), "")


def _places(count: Column) -> Column:
    """0 .. count-1, or none."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def _gram_hashes(ws: Column, k: int) -> Column:
    return F.transform(
        _places(F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i + 1, F.lit(k)))
    )


def _winnowed(h: Column, run: int) -> Column:
    """Places of the smallest hash of every run of `run` neighbours."""

    def least(i: Column) -> Column:
        return let(F.slice(h, i + 1, F.lit(run)), lambda part: i + F.array_position(part, F.array_min(part)).cast("int") - 1)

    return F.array_distinct(F.transform(_places(F.size(h) - (run - 1)), least))


def _fingerprints(ws: Column, window: int) -> Column:
    """The kept grams of a text: `k`, `h`, `pos`."""
    return let(
        _gram_hashes(ws, GRAM),
        lambda h: F.transform(
            _winnowed(h, window - GRAM + 1),
            lambda p: F.struct(F.lit(GRAM).alias("k"), F.get(h, p).alias("h"), p.alias("pos")),
        ),
    )


def _short_grams(ws: Column, k: int) -> Column:
    """All grams of `k` words, for items of `k` words."""
    return F.transform(
        _gram_hashes(ws, k),
        lambda h, i: F.struct(F.lit(-k).alias("k"), h.alias("h"), i.alias("pos")),
    )


def _spans(window: int, k: Column, ws: Column, pos: Column) -> Column:
    """Start, length and words of the windows that hold the gram at `pos` (a short gram is its own)."""
    size = F.when(k < 0, -k).otherwise(window)
    low = F.when(k < 0, pos).otherwise(F.greatest(pos - (window - GRAM), F.lit(0)))
    high = F.when(k < 0, pos).otherwise(F.least(pos, F.size(ws) - window))
    return F.transform(
        F.sequence(low, high),
        lambda s: F.struct(
            s.alias("start"), size.alias("len"), F.array_join(F.slice(ws, s + 1, size), " ").alias("span")
        ),
    )


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per shared window: `__id`, `__th` (see `row_key`), `start`, `len`, `item`."""
    it = materialise(
        items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("ws"))
        .where(F.size("ws") > 0)
        .distinct(),
        "items",
    )
    short = sorted(
        r[0] for r in it.where(F.size("ws") < window).select(F.size("ws")).distinct().collect()
    )  # at most window - 1 numbers
    full = it.where(F.size("ws") >= window)
    prints = full.select(F.inline(_fingerprints(F.col("ws"), window))).select("k", "h")
    spans = full.select(
        "item",
        F.explode(
            F.transform(
                _places(F.size("ws") - (window - 1)),
                lambda s: F.array_join(F.slice("ws", s + 1, F.lit(window)), " "),
            )
        ).alias("span"),
        F.lit(window).alias("len"),
    )
    if short:
        small = it.where(F.size("ws") < window)
        prints = prints.unionByName(
            small.select((-F.size("ws")).alias("k"), F.xxhash64("ws").alias("h"))
        )
        spans = spans.unionByName(
            small.select("item", F.array_join("ws", " ").alias("span"), F.size("ws").alias("len"))
        )
    prints = materialise(prints.distinct(), "item-prints")
    spans = materialise(spans.distinct(), "item-spans")
    fits = max(prints.count(), spans.count()) <= broadcast_rows
    small_side = F.broadcast if fits else (lambda x: x)

    d = docs.select(*row_key(id_col, text), F.col(text).alias("t"))

    def grams(t: Column) -> Column:
        return let(
            words(t),
            lambda ws: F.concat(_fingerprints(ws, window), *[_short_grams(ws, k) for k in short]),
        )

    if fits:
        # The text stays in the row until the join has dropped the grams that no item has.
        met = d.select("*", F.inline(grams(F.col("t")))).join(small_side(prints), ["k", "h"], "left_semi")
    else:
        keys = d.select("__id", "__th", F.inline(grams(F.col("t"))))
        keys = keys.join(prints, ["k", "h"], "left_semi").distinct()
        met = d.dropDuplicates(["__id", "__th"]).join(keys, ["__id", "__th"])
    found = met.select(
        "__id",
        "__th",
        F.inline(let(words(F.col("t")), lambda ws: _spans(window, F.col("k"), ws, F.col("pos")))),
    ).distinct()
    return found.join(small_side(spans), ["span", "len"]).select("__id", "__th", "start", "len", "item")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """One row per document with a hit: `__id`, `__th`, `n_hit` words and the sorted `items` hit."""
    hits = find_hits(docs, items, id_col, text, **options)
    by_doc = hits.groupBy("__id", "__th").agg(
        F.collect_set(F.struct("start", "len")).alias("spans"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    places = F.array_distinct(
        F.flatten(
            F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))
        )
    )
    return by_doc.select("__id", "__th", F.size(places).cast("long").alias("n_hit"), "items")


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every document: id, `n_words`, `n_hit`, `items`."""
    found = contamination(docs, items, id_col, text, **options)
    every = docs.select(*row_key(id_col, text), count_words(F.col(text)).cast("long").alias("n_words"))
    same = every["__id"].eqNullSafe(found["__id"]) & (every["__th"] == found["__th"])
    return every.join(found, same, "left").select(
        every["__id"].alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The documents without any hit, with the columns they came with."""
    found = contamination(docs, items, id_col, text, **options).select("__id", "__th")
    th = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(found, docs[id_col].eqNullSafe(found["__id"]) & (th == found["__th"]), "left_anti")
