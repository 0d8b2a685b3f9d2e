"""Benchmark decontamination: short test items inside long documents, by min-hash containment.

Method: the distinct word shingles of a test item are hashed; items are partitioned by the size of that set
(powers of two), and an item's sketch is its smallest hashes (bottom-k), with k set per partition to
``floor((1 - threshold) * largest size) + 1``. A document that contains ``threshold`` of an item's shingles
lacks too few of them to miss the whole sketch, so looking the document's shingle hashes up in the sketches
finds every pair. Candidate pairs are verified by exact containment of the shingles themselves, as text.

DataFrame functions only. The lookup is a plain equi-join of document shingles with the sketch table:
Spark broadcasts that table while its written size is below the session's threshold and shuffles otherwise.
A shingle that occurs in many documents is one row on the item side, and such joins split where skewed.

Items of fewer than ``width`` words are one shingle of their own length if ``short_items`` is set: documents are
then also looked up by their runs of the lengths that occur among the items. Else such items match nothing.

Edge cases: null and empty texts have no shingle and match nothing, and documents with fewer than ``width``
words hold only short items; rows equal in id and text are one document; repeated items are one item; a null id stays
null in the pairs; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.keys import KEY, id_back, id_of, keyed
from docframe.plans.stage import stage


def word_array(text: str) -> Column:
    """The words of a lower-cased text."""
    spaced = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def _steps(words: str, width: int) -> Column:
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: str, width: int) -> Column:
    """Hash of every run of ``width`` words, repeats included."""
    return F.transform(_steps(words, width), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)]))


def shingle_texts(words: str, width: int) -> Column:
    """Every distinct run of ``width`` words, joined by spaces."""
    return F.array_distinct(
        F.transform(_steps(words, width), lambda i: F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(width)]))
    )


def item_shingles(shingles: Callable[[str, int], Column], words: str, width: int, short_items: bool) -> Column:
    """Shingles of an item; a short one is a single shingle of all its words."""
    out = shingles(words, width)
    for n in range(1, width) if short_items else ():
        out = F.when(F.size(words) == n, shingles(words, n)).otherwise(out)
    return out


def item_sketches(items: DataFrame, item_id: str, text: str, width: int, threshold: float, short_items: bool = False) -> DataFrame:
    """``h, item, __it``: the bottom-k sketch of every item, k by size partition."""
    words = items.select(id_of(item_id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__it"), word_array(text).alias("w"))
    sets = words.select("__id", "__it", F.array_sort(F.array_distinct(item_shingles(shingle_hashes, "w", width, short_items))).alias("s")).filter(F.size("s") > 0)
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("s").cast("double"))))
    k = (F.floor((1 - threshold) * largest + 1e-9) + 1).cast("int")
    return sets.select(F.col("__id").alias("item"), "__it", F.explode(F.slice("s", F.lit(1), k)).alias("h")).distinct()


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    keep_key: bool = False,
    short_items: bool = False,
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment``: documents holding at least ``threshold`` of an
    item's distinct shingles. ``keep_key`` adds the row key of the document."""
    sketches = stage(item_sketches(items, item_id, item_text, width, threshold, short_items), "sketches")
    lengths = [width]
    if short_items:
        sizes = items.select(F.size(word_array(item_text)).alias("n")).filter((F.col("n") > 0) & (F.col("n") < width)).distinct()
        lengths += sorted(r["n"] for r in sizes.collect())
    rows = keyed(docs, doc_id, text)
    hashes = rows.select(*KEY, word_array("__text").alias("w")).select(*KEY, F.explode(F.concat(*[shingle_hashes("w", n) for n in lengths])).alias("h"))
    pairs = stage(hashes.join(sketches, "h").select(*KEY, "item", "__it").distinct(), "candidates")

    full = items.select(id_of(item_id), F.xxhash64(F.coalesce(F.col(item_text), F.lit(""))).alias("__it"), word_array(item_text).alias("w"))
    short = (F.size("w") < width).alias("short")
    full = full.select(F.col("__id").alias("item"), "__it", short, item_shingles(shingle_texts, "w", width, short_items).alias("wanted")).dropDuplicates(["item", "__it"])
    asked = pairs.select(*KEY).distinct()
    found = rows.join(asked, KEY).dropDuplicates(KEY).select(*KEY, word_array("__text").alias("w"))
    spaced = [F.concat(F.lit(" "), F.concat_ws(" ", "w"), F.lit(" ")).alias("spaced")] if len(lengths) > 1 else []
    found = found.select(*KEY, shingle_texts("w", width).alias("held"), *spaced)
    both = found.join(pairs, KEY).join(full, ["item", "__it"])
    shared = F.size(F.array_intersect("held", "wanted")).cast("long")
    if spaced:
        whole = F.contains(F.col("spaced"), F.concat(F.lit(" "), F.get("wanted", F.lit(0)), F.lit(" ")))
        shared = F.when(F.col("short"), whole.cast("long")).otherwise(shared)
    both = both.select(*KEY, "item", shared.alias("n_shared"), F.size("wanted").cast("long").alias("n_item"))
    both = both.filter(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    extra = KEY if keep_key else []
    return both.select(
        id_back(doc_id), id_back(item_id, "item"), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"), *extra
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **named) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    from docframe.llm.keys import with_key

    bad = contaminated(docs, items, keep_key=True, **named).select(*KEY).distinct()
    rows = with_key(docs, named.get("doc_id", "doc_id"), named.get("text", "text"))
    return rows.join(bad, KEY, "left_anti").drop(*KEY)


def contaminated_sql(width: int = 5, threshold: float = 0.8) -> str:
    """The pairs as SQL for DuckDB, over whole tables, items shorter than a shingle included."""
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    cut = f"unnest(list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: {shingle})))"
    return f"""
WITH dw AS (SELECT doc_id, {words} AS w FROM documents),
bw AS (SELECT item_id, {words} AS w FROM benchmark),
d AS (SELECT doc_id, {cut} AS s FROM dw WHERE len(w) >= {width}),
b AS (SELECT item_id, {cut} AS s FROM bw WHERE len(w) >= {width}),
n AS (SELECT item_id, count(*)::BIGINT AS n_item FROM b GROUP BY item_id),
short AS (SELECT item_id, len(w) AS k, array_to_string(w, ' ') AS s FROM bw WHERE len(w) BETWEEN 1 AND {width - 1}),
runs AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM short)))
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= {threshold} * n_item - 1e-9
UNION ALL SELECT doc_id, item_id, 1::BIGINT, 1::BIGINT, 1::DOUBLE FROM runs JOIN short USING (k, s)"""
