"""Benchmark decontamination by winnowing (operator 3); DataFrame functions only.

Both sides keep the smallest k-gram hash of every ``w`` consecutive ones.  With k + w - 1 words to
a window, a window that a document shares with an item has at least one kept fingerprint, the same on both sides.
Fingerprints are rows of both sides and are joined; a hit is extended to the windows that could hold it, and these are compared word
for word.  Each distinct fingerprint and window of the benchmark is joined once, however many items have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, hinted, let, maybe_broadcast, scratch, stored

WINDOW = 10
GRAM = 5
#: Characters between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a whole text (no nulls, no empties); a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _gram_hashes(hashes: Column, k: int) -> Column:
    """Hashes of all k-grams of an array of word hashes (a bound variable or column), in order; empty if there are fewer words."""
    n = F.size(hashes)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _tagged(grams: Column) -> Column:
    """k-gram hashes whose last four bits are those of their places: they tell the places of a window apart."""
    return F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(~15)).bitwiseOR(i.bitwiseAND(F.lit(15)).cast("bigint")))


def _least(tagged: Column, w: int) -> Column:
    """The smallest of each ``w`` (up to 16) consecutive tagged hashes; empty if there are fewer."""
    n = F.size(tagged)
    found = F.transform(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: F.array_min(F.slice(tagged, i, w)))
    return F.when(n >= w, found).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(hashes: Column, k: int, w: int) -> Column:
    """The kept k-gram hashes (h, without their tags) of an array of word hashes and their places (at, from 0), each place once."""

    def kept(tagged: Column) -> Column:
        at = F.transform(_least(tagged, w), lambda m, j: j + F.pmod(m.bitwiseAND(F.lit(15)).cast("int") - j, F.lit(16)))
        return F.transform(F.array_distinct(at), lambda p: F.struct(F.get(tagged, p).bitwiseAND(F.lit(~15)).alias("h"), p.alias("at")))

    return let(_tagged(_gram_hashes(hashes, k)), kept)


def _shape(length: int) -> tuple[int, int]:
    """(k, w) that guarantee a common fingerprint for windows of ``length`` words."""
    k = min(GRAM, length)
    return k, length - k + 1


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every window of every item: item (as a string), length, words (joined by a space), hashes (of the words)."""
    parts = items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    length = lambda w: F.least(F.size(w), F.lit(window))
    runs = let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - length(w) + 1), lambda i: F.slice(w, i, length(w))))
    out = parts.select("item", F.explode(F.array_distinct(runs)).alias("run"))
    return out.select("item", F.size("run").alias("length"), F.array_join("run", " ").alias("words"), F.transform("run", lambda x: F.xxhash64(x)).alias("hashes")).distinct()


def contaminated_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The words of each document that some item's window covers.

    Returns ``key``, n_words, spans (array of start and stop, in words, merged and in order), n_hit, items (their
    ids as sorted strings).  A window is ``window`` consecutive words of an item, all of them if it has fewer.  Null and empty
    texts have no words; an item without words has no window; a null item id joins as no item but its windows
    count; an empty benchmark gives documents without hits.  Rows that repeat are a document each.
    Other columns of either table aren't read.
    """
    windows = stored(benchmark_windows(items, item_key, item_text, window), "windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # as many as a window has words at most
    shapes = [(n, *_shape(n)) for n in lengths]
    prints_of = lambda h, n, k, w: F.transform(_fingerprints(h, k, w), lambda x: F.struct(F.lit(n).alias("length"), x["h"].alias("h"), x["at"].alias("at")))
    none = F.array().cast("array<struct<length:int,h:bigint,at:int>>")

    # The documents' fingerprints, and those of the benchmark's windows.
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    of_text = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).alias("n_words"), let(hashed(w), lambda h: F.concat(none, *(prints_of(h, *shape) for shape in shapes))).alias("prints")))
    keyed = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text"))
    parts = stored(keyed.select("doc", "copy", of_text.alias("t")).select("doc", "copy", "t.*"), "fingerprints")
    theirs = F.concat(none, *(F.when(F.col("length") == n, prints_of(F.col("hashes"), n, k, w)).otherwise(none) for n, k, w in shapes))
    theirs = stored(windows.select(F.explode(theirs).alias("p")).select("p.length", "p.h").distinct(), "benchmark-fingerprints")
    met = parts.select("doc", "copy", F.explode("prints").alias("p")).select("doc", "copy", "p.*").join(maybe_broadcast(theirs, 24 * theirs.count()), ["length", "h"])
    places = stored(met.groupBy("doc", "copy").agg(F.collect_set(F.struct("length", "at")).alias("places")), "hits")

    # Hits are extended: a window of n words holds the k-gram at any of w places.
    def candidates_of(words: Column) -> Column:
        found = [F.array().cast("array<struct<start:int,length:int,words:string>>")]
        for n, _, w in shapes:
            own = F.transform(F.filter("places", lambda p: p["length"] == n), lambda p: p["at"])  # noqa: B023
            starts = F.flatten(F.transform(own, lambda x: F.sequence(F.greatest(x - (w - 1), F.lit(0)), x)))  # noqa: B023
            starts = F.filter(F.array_distinct(starts), lambda s: s + n <= F.size(words))  # noqa: B023
            found.append(F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(words, s + 1, n), " ").alias("words"))))  # noqa: B023
        return F.concat(*found)

    hit = places.select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), "places")
    same = (F.col("copy") == F.col("_copy")) & F.col("doc").eqNullSafe(F.col("_doc"))
    held = keyed.join(hit.hint("merge"), same)  # hits grow with the texts: shuffled at every size
    candidates = held.select("doc", "copy", F.explode(let(words_of(F.col("text")), candidates_of)).alias("c")).select("doc", "copy", "c.*").distinct()
    listed = stored(windows.groupBy("length", "words").agg(F.array_sort(F.collect_set("item")).alias("items")), "distinct-windows")
    size = listed.agg(F.sum(F.length("words") + 40 + 24 * F.size("items"))).first()[0] or 0
    hits = candidates.join(maybe_broadcast(listed, size), ["length", "words"])
    hits = hits.select("doc", "copy", F.struct("start", (F.col("start") + F.col("length")).alias("stop")).alias("span"), "items")
    per_doc = hits.groupBy("doc", "copy").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= x["start"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    found = per_doc.select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), merged.alias("spans"), "items")
    out = parts.select("doc", "copy", "n_words").join(found, (F.col("copy") == F.col("_copy")) & F.col("doc").eqNullSafe(F.col("_doc")), "left")
    out = out.select(F.col("doc").alias(key), "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, x: n + x["stop"] - x["start"])
    return out.select(key, F.col("n_words").cast("long").alias("n_words"), "spans", n_hit.cast("long").alias("n_hit"), "items")


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold any window of an item; all columns stay, and all rows of a key go with one of them."""
    with scratch():
        hit = contaminated_spans(docs, items, key, text).filter("n_hit > 0").select(F.col(key).alias("_hit")).distinct()
        hit = stored(hit, "contaminated", kept=True)
    return docs.join(hinted(hit), docs[key].eqNullSafe(hit["_hit"]), "left_anti")
