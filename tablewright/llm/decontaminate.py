"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

A record is one distinct window of the items (``WINDOW`` consecutive words, or the whole of a shorter item),
and a document matches it only by holding all of it. Its tokens are shingles of two words (the word itself in a
window of one), ordered by rarity over all documents. For full containment the necessary prefix under any order
is one token, so each window is indexed by its rarest shingle. A document shingle that equals it is a candidate
at one place only: its position in the window says where the window must lie, which must be inside the document
(length and positional bounds), and there the words are compared. Windows held by the same items share an item
class, so a passage common to many items is found once and their names join the documents that hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, fits, sized, stored, table, text_print

WINDOW = 10
#: Everything but digits, a-z and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(column) -> F.Column:
    """The words of a text, in order; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(column), BETWEEN), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, item_class) for each distinct window of all items, and (item_class, item_id).

    Windows that the same items hold have one class: the items' number and two XORs of 64-bit hashes of their
    ids. Items without an id are in no class; a window of such items alone has none.
    """
    worded = items.select("item_id", words("text").alias("item_words")).where(F.size("item_words") > 0)
    width = F.least(F.size("item_words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("item_words") - width + 1)
    held = stored(worded.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("item_words", s, width))).alias("window")).distinct(), "item-windows")
    name = F.col("item_id").cast("string")
    signed = held.groupBy("window").agg(F.count("item_id").alias("n"), F.bit_xor(F.xxhash64(name)).alias("a"), F.bit_xor(F.xxhash64(name, F.lit("again"))).alias("b"))
    windows = stored(signed.select("window", F.when(F.col("n") > 0, F.concat_ws("/", "n", "a", "b")).alias("item_class")), "windows")
    return windows, stored(held.where("item_id is not null").join(sized(windows), "window").select("item_class", "item_id").distinct(), "item-classes")


def item_index(windows: DataFrame, worded: DataFrame) -> DataFrame:
    """token (the hash of a window's rarest shingle), at (its place), size (of the window), window, item_class.

    Rarity is the number of occurrences over all documents; ties go to the lesser hash, then to the first place.
    """
    pair = lambda i: F.xxhash64(F.get("window", i), F.get("window", i + 1))
    shingles = F.when(F.size("window") == 1, F.array(F.xxhash64(F.get("window", F.lit(0))))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size("window") - 2, F.lit(0))), pair))
    placed = windows.select("window", F.posexplode(shingles).alias("at", "token"))
    vocabulary = stored(placed.select("token").distinct(), "item-shingles")
    found = _tokens(worded, _single(windows)).where("token is not null").select("token").join(sized(vocabulary), "token", "left_semi")
    counts = stored(found.groupBy("token").agg(F.count("*").alias("n")), "item-shingle-counts")
    rarest = placed.join(sized(counts), "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("best"))
    index = windows.join(rarest, "window").select(F.col("best.token").alias("token"), F.col("best.at").alias("at"), F.size("window").alias("size"), "window", "item_class")
    return stored(index, "item-index")


def _single(windows: DataFrame) -> bool:
    """Are there windows of one word, whose tokens are words?"""
    return windows.where(F.size("window") == 1).limit(1).count() > 0


def _tokens(worded: DataFrame, single: bool) -> DataFrame:
    """doc_id, print, words, pos, token: the hashed shingle of each place, and its word if ``single``.

    A row without a token closes each document: its place is the number of words.
    """
    placed = worded.select("doc_id", "print", "words", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    pair, word = F.xxhash64("word", F.get("words", F.col("pos") + 1)), F.xxhash64("word")
    here = F.col("word").isNotNull()
    token = F.explode(F.when(here, F.array(pair, word)).otherwise(F.array(F.lit(None).cast("long")))) if single else F.when(here, pair)
    return placed.select("doc_id", "print", "words", "pos", token.alias("token"))


def _inside(n_words) -> F.Column:
    """Length and positional bounds: the window lies inside the document."""
    return (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("size") <= n_words)


def _holds() -> F.Column:
    return F.slice("words", F.greatest(F.col("pos") - F.col("at"), F.lit(0)) + 1, F.col("size")) == F.col("window")


def _beside(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """Windows in documents by a broadcast index: no document word is shuffled.

    Generation, join, bounds and verification run in one generated stage, which hands on hits and closing rows alone.
    """
    index = F.broadcast(index.withColumnRenamed("token", "rare"))
    found = tokens.join(index, (F.col("token") == F.col("rare")) & _inside(F.size("words")) & _holds(), "left")
    return _hits(found.where("token is null or rare is not null"), F.col("token").isNull())


def _shuffled(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """The same by a shuffle of (document, place, token, length) by token; the texts join the candidates only."""
    light = tokens.where("token is not null").select("doc_id", "print", "pos", "token", F.size("words").alias("n_words"))
    near = light.join(index, "token").where(_inside(F.col("n_words"))).distinct()
    closed = tokens.where("token is null")
    texts = closed.dropDuplicates(["doc_id", "print"]).select(F.col("doc_id").alias("d"), F.col("print").alias("p"), "words")
    held = near.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))).where(_holds())
    kinds = dict(index.dtypes)
    ends = closed.select("doc_id", "print", "words", "pos", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("at", "size", "item_class")])
    return _hits(held, F.lit(False)).unionByName(_hits(ends, F.lit(True)))


def _hits(found: DataFrame, close: F.Column) -> DataFrame:
    """doc_id, print, close, pos, span (of words; null on closing rows), item_class."""
    start = F.col("pos") - F.col("at")
    span = F.when(~close, F.struct(start.alias("start"), (start + F.col("size")).alias("end")))
    return found.select("doc_id", "print", close.alias("close"), "pos", span.alias("span"), "item_class")


def _covered(spans) -> F.Column:
    """How many words the union of spans covers."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    upto = lambda x, s: F.greatest(x["upto"], s["end"]).alias("upto")
    more = lambda x, s: (x["n"] + F.greatest(s["end"] - F.greatest(x["upto"], s["start"]), F.lit(0))).alias("n")
    return F.aggregate(F.array_sort(spans), zero, lambda x, s: F.struct(upto(x, s), more(x, s)), lambda x: x["n"])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row for every row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    print (a hash of the text).

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. A null or empty
    text has no words and no hits; an item without words is never found, and one without an id marks
    words but isn't named. Rows that repeat an id are judged apart if their texts differ, and repeated
    rows get equal results. Empty tables give an empty result or documents without hits. The index is
    broadcast only after a count of its rows and bytes; beyond the bound the same join shuffles by token.
    Very long texts are compared whole.
    """
    worded = docs.select("doc_id", text_print().alias("print"), words("text").alias("words"))
    windows, classes = item_windows(items, size)
    index = item_index(windows, worded)
    found = (_beside if fits(index) else _shuffled)(_tokens(worded, _single(windows)), index)
    key = ["doc_id", "print"]
    # Repeated rows find the same spans, each kept once; their closing rows are counted.
    judged = found.groupBy(*key).agg(
        F.max(F.when(F.col("close"), F.col("pos"))).cast("long").alias("n_words"),
        F.count_if("close").cast("int").alias("copies"),
        _covered(F.collect_set("span")).alias("n_hit"),
        F.collect_set("item_class").alias("held"),
    )
    judged = stored(judged, "judged")
    named = judged.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), F.explode("held").alias("item_class")).join(sized(classes), "item_class")
    named = stored(named.groupBy("d", "p").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")), "named")
    whole = judged.join(sized(named), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "print",
        F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every row of documents against all of benchmark."""
    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("print")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
held AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS k FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS p)),
hits AS (SELECT doc_id, item_id, p, m FROM held JOIN win USING (m, k)),
marked AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS word FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
