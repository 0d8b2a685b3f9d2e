"""N-gram Jaccard join: a grouped prefix join on word shingles.

Method: a document's set of distinct shingle hashes is ordered by (frequency class, hash), common ones
last. Two sets with Jaccard similarity of at least t share a hash among the first ``n - ceil(t n) + 1``.
Equal sets are one *class*; classes with equal prefix and size are one *group*. Groups that share a prefix
hash and whose sizes allow the similarity are paired, pairs are expanded to members, and members are
verified exactly on their texts' sets.

For components not every pair of a group is needed. First each group and each prefix hash links its members
to one of them (stars, linear in the postings); components of those links are formed; then all pairs of
members that are still in different components are verified, each starting from outside the largest
component of its key. No pair that could change a component is left out, and a group of thousands of near
copies costs one verification each. ``jaccard_links`` verifies every candidate pair instead.

The frequency classes (powers of two) come from a count over all documents, in which a block of
``COUNT_BYTES`` reports the shingles that it holds twice and in one of a thousand documents or more; they
decide the order only, never the result. At most ``COMMON`` hashes are sent to the workers.

Edge cases: ASCII capitals are lowered; a text with fewer words than a shingle is one shingle; null and empty
texts have no shingle and link with nothing; repeated rows and ids are separate documents of one class; a
null id takes part and comes last; empty tables give empty results; other columns are kept or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrays import WORD_BASES, Texts, list_array, mix, owners, rolling, signed, text_slices, windows
from docframe.llm.components import connected_components
from docframe.llm.keys import KEY, LAST, keyed, with_key
from docframe.plans.stage import release, stage

COMMON = 100_000
COUNT_BYTES = 16_000_000
CENTRES = 3
SPARE = 4
"""One more shared hash is asked for by this many guaranteed ones, and one more place of both prefixes paired.
A small number means fewer pairs to verify, a large one fewer joined rows; results do not depend on it."""
BITMAP = 8
"""64-bit words of a set's parity bitmap."""
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the lower-cased texts, sorted by (text, hash), and the text of each."""
    t = t.lower()
    starts, ends, first = t.words()
    words = t.hashes(starts, ends)
    _, hashed, per_text = windows(words, first, width, WORD_BASES[0])
    owner = owners(per_text)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    if len(short):
        whole = rolling(words, first[short], first[short + 1], WORD_BASES[0])
        whole = mix(whole + np.diff(first)[short].astype(np.uint64))
        hashed, owner = np.concatenate((hashed, whole)), np.concatenate((owner, short))
    # Sorting by text and the upper bits of the hash brings equal ones together and is much faster.
    order = np.argsort((owner.astype(np.uint64) << np.uint64(48)) | (hashed >> np.uint64(16)))
    hashed, owner = hashed[order], owner[order]
    fresh = np.ones(len(hashed), dtype=bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[fresh], owner[fresh]


def common_shingles(rows: DataFrame, width: int) -> list:
    """The most frequent shingles ``(hash, count)``, at most ``COMMON``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = [], 0, 0

        def often() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n = np.diff(np.append(at, len(h)))
            keep = n >= max(2, docs / 1000)
            return pa.RecordBatch.from_arrays([pa.array(signed(h[at[keep]])), pa.array(n[keep].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for _, _, t in text_slices(batch.column(0)):
                held.append(shingle_sets(t, width)[0])
                docs, size = docs + len(t), size + len(t.data)
                if size >= COUNT_BYTES:
                    yield often()
                    held, docs, size = [], 0, 0
        if held:
            yield often()

    counts = rows.select("__text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.col("n").desc(), "h").limit(COMMON).collect()


_SET = T.StructType(
    [
        T.StructField("n", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("gid", T.LongType()),
        T.StructField("prefix", T.ArrayType(T.LongType())), *[T.StructField(f"bit{i}", T.LongType()) for i in range(BITMAP)],
    ]
)


def described(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``__id, __th, n, cid, gid, prefix, bit0..``: size, class, group, prefix and bitmap of every document."""
    common = common_shingles(rows, width)
    order = sorted((r["h"] & ((1 << 64) - 1), r["n"]) for r in common)
    keys = np.array([h for h, _ in order], dtype=np.uint64)
    classes = np.array([int(n).bit_length() for _, n in order], dtype=np.int64)
    maybe = np.zeros(1 << 20, dtype=bool)
    maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
    sent = rows.sparkSession.sparkContext.broadcast((keys, classes, maybe))

    @F.arrow_udf(_SET)
    def describe(texts: pa.Array) -> pa.Array:
        keys, classes, maybe = sent.value
        sizes, cids, gids, prefixes, lengths, bits = [], [], [], [], [], []
        for _, _, t in text_slices(texts):
            h, owner = shingle_sets(t, width)
            n = np.bincount(owner, minlength=len(t))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ _ODD), dtype=np.uint64)))
            off = np.concatenate(([0], np.cumsum(n)))
            cid = mix(sums[off[1:]] - sums[off[:-1]] + n.astype(np.uint64) * _ODD)
            places = BITMAP * 64
            parity = np.bincount(owner * places + (mix(h) % np.uint64(places)).astype(np.int64), minlength=len(t) * places) & 1
            bits.append(np.packbits(parity.astype(np.uint8).reshape(len(t), places), axis=1).view(np.int64))
            look = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
            if len(look):
                at = np.minimum(np.searchsorted(keys, h[look]), len(keys) - 1)
                frequency = np.zeros(len(h), dtype=np.int64)
                frequency[look] = np.where(keys[at] == h[look], classes[at], 0)
                h = h[np.argsort(owner * 64 + frequency, kind="stable")]
            p = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            first = np.concatenate(([0], np.cumsum(p)))
            take = np.arange(first[-1]) + np.repeat(off[:-1] - first[:-1], p)
            head = h[take]
            gid = mix(rolling(head, first[:-1], first[1:], WORD_BASES[1]) + n.astype(np.uint64) * _ODD)
            sizes.append(n), cids.append(cid), gids.append(gid), prefixes.append(head), lengths.append(p)
        if not sizes:
            whole = [pa.array([], pa.int64())]
            return pa.StructArray.from_arrays([*whole * 3, pa.array([], pa.list_(pa.int64())), *whole * BITMAP], names=_SET.names)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        return pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(signed(np.concatenate(cids))), pa.array(signed(np.concatenate(gids))),
                list_array(signed(np.concatenate(prefixes)), offsets, pa.int64()),
                *[pa.array(np.ascontiguousarray(x)) for x in np.concatenate(bits).T],
            ],
            names=_SET.names,
        )

    return rows.select(*KEY, describe("__text").alias("s")).select(*KEY, "s.*")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` (class ids) whose sets reach the similarity; ``texts`` is ``cid, __text``."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = [np.zeros(0, dtype=bool)]
        for i, j, a in text_slices(left):
            for k, m, b in text_slices(right.slice(i, j - i)):
                part = Texts(a.data[a.offsets[k] : a.offsets[m]], a.offsets[k : m + 1] - a.offsets[k])
                (ha, oa), (hb, ob) = shingle_sets(part, width), shingle_sets(b, width)
                keys = np.concatenate((mix(ha + oa.astype(np.uint64) * _ODD), mix(hb + ob.astype(np.uint64) * _ODD)))
                order = np.argsort(keys)
                same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
                shared = np.bincount(np.concatenate((oa, ob))[order[same]], minlength=m - k)
                union = np.bincount(oa, minlength=m - k) + np.bincount(ob, minlength=m - k) - shared
                out.append((100 * shared >= percent * union) & (union > 0))
        return pa.array(np.concatenate(out))

    left = texts.select(F.col("cid").alias("a"), F.col("__text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("__text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").filter(similar("ta", "tb")).select("a", "b")


def _ceil_share(n, percent: int):
    return F.floor((F.lit(percent) * n + 99) / 100)


def _possible(left: DataFrame, right: DataFrame, on: list[str], condition: Column, percent: int, every: int) -> DataFrame:
    """Pairs ``a < b`` of the members in ``left`` and ``right`` that share keys and can be similar.

    Sizes must fit, and the parity bitmaps must not differ in more places than the sets may: every different
    place takes an element that only one set has. Let x be the set whose prefix ends first in the common
    order: what its prefix shares with the other set is in the other's prefix too, so similar sets share at
    least ``least`` prefix hashes, and ``1 + spare`` of these lie before the last ``least - 1 - spare``
    places of both prefixes. Only those places are paired, and so many shared hashes are asked for. Sets of
    one group share their whole prefix and need no count.
    """
    n, m = F.col("n"), F.col("m")
    needed = F.floor((F.lit(percent) * (n + m) + (99 + percent)) / (100 + percent))
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(BITMAP)), F.lit(0))
    least = needed - F.greatest(_ceil_share(n, percent), _ceil_share(m, percent)) + 1
    spare = F.greatest(F.floor((least - 1) / every), F.lit(0))
    behind = least - spare - 1
    early = (F.col("pa") <= n - _ceil_share(n, percent) - behind) & (F.col("pb") <= m - _ceil_share(m, percent) - behind)
    fits = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & early & (differ <= n + m - 2 * needed)
    rows = left.join(right, on).filter((F.col("a") != F.col("b")) & condition & fits)
    each = rows.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.count(F.lit(1)).alias("c"), F.max(spare + 1).alias("asked"), F.min("pa").alias("first")
    )
    return each.filter("c >= asked OR first < 0").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _prepare(rows: DataFrame, width: int, percent: int):
    """Described documents, class representatives, and members by key (prefix hash or group)."""
    docs = stage(described(rows, width, percent), "sets")
    bits = [f"bit{i}" for i in range(BITMAP)]
    classes = docs.filter("n > 0").groupBy("cid", "n", "gid", *bits).agg(F.min(F.struct(*KEY)).alias("rep"))
    classes = stage(classes, "classes")
    groups = classes.groupBy("gid", "n").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("members"))
    # One posting per group: the prefixes of its members are equal, so its first document's will do.
    lead = groups.join(classes.select("cid", "rep.*"), F.col("head") == F.col("cid")).select("gid", *KEY)
    postings = docs.join(lead, [*KEY, "gid"]).dropDuplicates(["gid"]).select("gid", "n", F.posexplode("prefix").alias("p", "h"))
    postings = stage(postings, "postings")
    several = postings.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    shared = postings.join(several, "h")
    own = groups.filter("members > 1").select("gid", "n", F.lit(-1).alias("p"), F.col("gid").alias("h"))
    keys = shared.unionByName(own)
    members = keys.join(classes.select("gid", "cid", *bits), "gid").select("h", "p", "cid", "n", *bits)
    members = stage(members, "members")
    release(postings)
    return docs, classes, members


def _left() -> list:
    return ["h", F.col("cid").alias("a"), "n", F.col("p").alias("pa"), *[F.col(f"bit{i}").alias(f"a{i}") for i in range(BITMAP)]]


def _right() -> list:
    return ["h", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("p").alias("pb"), *[F.col(f"bit{i}").alias(f"b{i}") for i in range(BITMAP)]]


def _texts(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cid, __text`` of one document of every class in ``pairs``; written once.

    The list of wanted documents grows with the corpus, so it is never broadcast.
    """
    used = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    used = stage(classes.join(used, "cid", "left_semi").select("cid", "rep.*"), "used")
    return stage(rows.join(used.hint("merge"), KEY).select("cid", "__text"), "texts")


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, spare: int = SPARE):
    """All links between different sets: ``(links, documents)``.

    ``links`` has ``a, b`` (class ids, a < b); ``documents`` has ``doc_id, n_shingles, cid``. The result
    grows with the number of similar pairs of different texts.
    """
    rows = keyed(docs, doc_id, text)
    described_docs, classes, members = _prepare(rows, width, percent)
    pairs = _possible(members.select(_left()), members.select(_right()), ["h"], F.col("a") < F.col("b"), percent, spare)
    pairs = stage(pairs, "pairs")
    links = verified(pairs, _texts(rows, classes, pairs), width, percent)
    return links, described_docs.select(F.when(F.col("__id") != LAST, F.col("__id")).alias(doc_id), F.col("n").alias("n_shingles"), "cid")


def _stars(members: DataFrame, percent: int, spare: int) -> DataFrame:
    """Possible pairs of every member and its key's first class in each of ``CENTRES`` orders of classes."""
    orders = [F.min(F.struct(F.xxhash64(F.lit(i), "cid").alias("o"), "cid")).alias(f"c{i}") for i in range(CENTRES)]
    centres = members.groupBy("h").agg(*orders)
    centres = centres.select("h", F.explode(F.array_distinct(F.array(*[F.col(f"c{i}.cid") for i in range(CENTRES)]))).alias("cid"))
    centres = members.join(centres, ["h", "cid"]).select(_right())
    return _possible(members.select(_left()), centres, ["h"], F.lit(True), percent, spare)


def _across(placed: DataFrame, percent: int, spare: int) -> DataFrame:
    """Possible pairs that share a key and ``part`` but not ``root``.

    Of two members with different roots one is outside the key's largest root, so pairs start there.
    """
    sizes = placed.groupBy("h", "part", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("h", "part").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "root")).alias("top")).filter("k > 1")
    open_ = placed.join(mixed.select("h", "part", F.col("top.root").alias("top")), ["h", "part"])
    few = open_.filter("root <> top").select(*_left(), "part", "root")
    many = open_.select(*_right(), "part", F.col("root").alias("other"), "top")
    once = (F.col("root") != F.col("other")) & ((F.col("other") == F.col("top")) | (F.col("a") < F.col("b")))
    return _possible(few, many, ["h", "part"], once, percent, spare)


def _with_roots(members: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    found = roots.select(F.col("node").alias("cid"), F.col("root").alias(name))
    return members.join(found, "cid", "left").withColumn(name, F.coalesce(name, "cid"))


def _rooted(rows: DataFrame, width: int, percent: int, spare: int) -> DataFrame:
    """``__id, __th, n, cid, root``: the component of every document, by its smallest class.

    The pairs verified first are the stars and all pairs across the components that the stars would give;
    if stars fail, the pairs across what is left of such a component follow.
    """
    docs, classes, members = _prepare(rows, width, percent)
    ends = [F.col("a").alias("u"), F.col("b").alias("v")]
    stars = stage(_stars(members, percent, spare), "stars")
    likely = _with_roots(members, connected_components(stars.select(ends)), "likely")
    likely = stage(likely, "likely")
    release(members)
    across = _across(likely.select("*", F.lit(0).alias("part"), F.col("likely").alias("root")), percent, spare)
    pairs = stage(stars.unionByName(across).distinct(), "pairs")
    release(stars)
    texts = _texts(rows, classes, pairs)
    links = stage(verified(pairs, texts, width, percent), "links")
    roots = connected_components(links.select(ends))
    rest = _across(_with_roots(likely.withColumnRenamed("likely", "part"), roots, "root"), percent, spare)
    rest = stage(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
    release(likely, pairs)
    if rest.take(1):
        # Both ends have a star in their component, so their texts are there already.
        more = stage(verified(rest, texts, width, percent), "links")
        roots = connected_components(links.unionByName(more).select(ends))
    return docs.join(roots, F.col("cid") == F.col("node"), "left").select(*KEY, "n", "cid", F.coalesce("root", "cid").alias("root"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, spare: int = SPARE) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id that links reach, the document's own included."""
    found = _rooted(keyed(docs, doc_id, text), width, percent, spare)
    lowest = found.filter("n > 0").groupBy("root").agg(F.min("__id").alias("low"))
    out = found.join(lowest, "root", "left")
    component = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("__id"))
    return out.select(
        F.when(F.col("__id") != LAST, F.col("__id")).alias(doc_id), F.col("n").alias("n_shingles"), F.when(component != LAST, component).alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, spare: int = SPARE) -> DataFrame:
    """``docs`` with one document of every component: the smallest (id, text hash), one row of it.
    Documents without words all stay."""
    rows = with_key(docs, doc_id, text)
    found = _rooted(keyed(docs, doc_id, text), width, percent, spare)
    stay = found.filter("n > 0").groupBy("root").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    empty = found.filter("n = 0").select(*KEY).distinct()
    one = rows.join(stay, KEY).dropDuplicates(KEY)
    return one.unionByName(rows.join(empty, KEY, "left_semi")).drop(*KEY)
