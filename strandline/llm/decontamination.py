"""Benchmark passages in training documents, by a positional inverted index of the documents.

The index holds a posting (term, document, position) for every word of a document that occurs in some
benchmark phrase, in shards of documents that are sorted by term. Phrases are looked up from their rarest term:
its postings, less the term's offset, are the places where the phrase may start, and the lists of the other terms,
adjusted by their offsets, are intersected with them. Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.common import ascii_lower, shared_folder
from strandline.plans.sizing import fits_broadcast, hinted, lookup_side, settle

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END, END_TERM = "\0", -1
DOC = ["doc_id", "mark"]


class Index(NamedTuple):
    """``terms``: ``word`` and its number ``term``. ``postings``: ``term``, ``doc_id``, ``mark``, ``pos``.

    ``mark`` is a hash of the document's text, so that rows of one id and different texts stay apart. The posting of the term
    ``END_TERM``, one for each row, has the number of the document's words for its position.
    """

    terms: DataFrame
    postings: DataFrame


def words(text: Column) -> Column:
    """The words of a text in lower case: runs of 0-9, a-z and everything beyond ASCII; none in a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(items: DataFrame, size: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct phrases of ``size`` consecutive words: ``window``, ``phrase``, ``n`` and the ``items`` they occur in, as sorted strings.

    An item of fewer words, but not none, is one phrase. Items without id give phrases without items.
    """
    found = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    phrases = found.select("item", "words", F.explode(starts).alias("at")).select(
        "item", F.slice("words", F.col("at") + 1, size).alias("phrase"))
    return settle(phrases.groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.monotonically_increasing_id().alias("window"), "phrase", F.size("phrase").alias("n"), "items"))


def terms_of(phrases: DataFrame) -> DataFrame:
    """The distinct words of phrases, numbered."""
    return settle(phrases.select(F.explode("phrase").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()))


def index_texts(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> Index:
    """Write the postings of the words in ``terms`` below the checkpoint folder, or to ``folder``.

    Each shard holds the documents of one scan partition, sorted by term, so that no posting is shuffled and row groups
    of other terms can be skipped.
    """
    end = terms.sparkSession.createDataFrame([(END, END_TERM)], "word string, term long")
    known = lookup_side(terms.unionByName(end))
    placed = docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"),
        F.posexplode(F.array_append(words(F.col(text)), F.lit(END))).alias("pos", "word"))
    postings = placed.join(known, "word").select("term", "doc_id", "mark", "pos").sortWithinPartitions("term", "doc_id", "pos")
    folder = folder or shared_folder(docs.sparkSession, "postings")
    postings.write.parquet(folder)
    return Index(terms, docs.sparkSession.read.schema(postings.schema).parquet(folder))


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with null equal to null; the left side's keys stay."""
    other = {k: f"__right_{k}" for k in keys}
    condition = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    return left.join(right.withColumnsRenamed(other), condition, how).drop(*other.values())


def _ranked(index: Index, phrases: DataFrame) -> DataFrame:
    """Each phrase's places: ``window``, ``n``, ``offset``, ``term`` and ``rank``, 1 for the rarest term.

    Phrases with a term that no document has are left out.
    """
    counts = lookup_side(index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("rows")))
    numbers = index.terms.join(counts, "term").select("word", "term", "rows")
    places = phrases.select("window", "n", F.posexplode("phrase").alias("offset", "word")).join(lookup_side(numbers), "word")
    own = Window.partitionBy("window")
    return settle(places.withColumns({"__known": F.count(F.lit(1)).over(own),
                                      "rank": F.row_number().over(own.orderBy("rows", "offset"))})
                  .where(F.col("__known") == F.col("n")).select("window", "n", "offset", "term", "rank"))


def _intersected(index: Index, found: DataFrame, places: DataFrame, slop: int) -> DataFrame:
    """The candidates that have a posting for each of ``places`` at its offset, or at most ``slop`` words from it."""
    wanted = found.join(hinted(places), ["window", "n"]).withColumn("pos", F.col("start") + F.col("offset"))
    if slop:
        wanted = wanted.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    # Only documents with a candidate matter; their postings alone are looked at where the list of them may be broadcast.
    docs = settle(found.select(*DOC).distinct())
    postings = index.postings
    if fits_broadcast(docs):
        postings = _on(postings, F.broadcast(docs), DOC, "left_semi")
    met = _on(wanted, postings, ["term", *DOC, "pos"], "left_semi")
    needed = places.groupBy("window").agg(F.count(F.lit(1)).alias("needed"))
    distinct = F.count_distinct("offset") if slop else F.count(F.lit(1))
    return met.groupBy("window", "n", *DOC, "start").agg(distinct.alias("had")).join(hinted(needed), "window").where(
        "had = needed").drop("had", "needed")


def occurrences(index: Index, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Where phrases occur: ``window``, ``n``, ``doc_id``, ``mark``, ``start`` (from 0), each once.

    With ``slop``, proximity matches: the rarest term stands in its place, and each other one at most ``slop`` words
    from where the phrase would have it. ``phrases`` holds ``window``, ``phrase`` (words) and ``n``, its length.

    The rarest term's list comes first, then that of the second rarest; what is left is intersected with all others at once.
    """
    places = _ranked(index, phrases)
    first = places.where("rank = 1").select("window", "n", "offset", "term")
    found = index.postings.join(hinted(first), "term").select(
        "window", "n", *DOC, (F.col("pos") - F.col("offset")).alias("start")).where(F.col("start") >= -slop).distinct()
    for rest in (places.where("rank = 2"), places.where("rank > 2")):
        rest = settle(rest.drop("rank"))
        short = found = settle(found)
        if not rest.isEmpty():
            has = hinted(rest.select("window").distinct())
            short = found.join(has, "window", "left_anti")
            found = short.unionByName(_intersected(index, found.join(has, "window", "left_semi"), rest, slop))
    return settle(found)


def _named(found: DataFrame, windows: DataFrame) -> DataFrame:
    """The items behind each document's windows: ``doc_id``, ``mark``, ``n_items``, ``items_sha256``.

    Windows of the same items are one class. Items are listed once for each distinct set of classes, not for each document, so
    a passage that many items and many documents share doesn't multiply.
    """
    classes = settle(windows.groupBy("items").agg(F.min("window").alias("class")))
    class_of = windows.join(classes, "items").select("window", "class")
    sets = settle(found.select(*DOC, "window").distinct().join(lookup_side(class_of), "window").groupBy(*DOC).agg(
        F.sort_array(F.collect_set("class")).alias("classes")).withColumn(
        "set", F.sha2(F.array_join(F.col("classes").cast("array<string>"), ","), 256)))
    names = sets.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class")).join(
        hinted(classes), "class").select("set", F.explode("items").alias("item")).distinct().groupBy("set").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    return sets.select(*DOC, "set").join(lookup_side(names), "set", "left").drop("set")


def _covered(found: DataFrame) -> DataFrame:
    """Words of each document inside any occurrence: ``doc_id``, ``mark``, ``n_hit``."""
    stop = F.col("start") + F.col("n")
    earlier = Window.partitionBy(*DOC).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(stop - F.greatest(F.col("start"), F.coalesce(F.max(stop).over(earlier), F.lit(0))), F.lit(0))
    return found.select(*DOC, new.alias("new")).groupBy(*DOC).agg(F.sum("new").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Which benchmark items the whole texts of ``docs`` hold ``size`` consecutive words of.

    Returns for every row ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence), ``n_items``, ``items_sha256`` (of the ids,
    sorted as strings, comma-joined) and ``contaminated``. Null and empty texts have no words. Rows of a null id are
    documents like others; repeated rows get a row each; rows of one id with different texts are judged apart.
    Items of a null id hit words but are not named; repeated items count once. An empty table on either side gives no hits.
    Other columns are not read.
    """
    windows = windows_of(benchmark, size)
    index = index_texts(docs, terms_of(windows))
    found = occurrences(index, windows)
    hits = lookup_side(_on(_covered(found), _named(found, windows), DOC, "left").select(*DOC, "n_hit", "n_items", "items_sha256"))
    every = index.postings.where(F.col("term") == END_TERM).select(*DOC, F.col("pos").cast("long").alias("n_words"))
    joined = _on(every, hits, DOC, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                         F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
