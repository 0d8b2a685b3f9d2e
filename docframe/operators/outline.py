"""Ordered, hierarchical and graph operators for outlines, styles, parts and slides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.js import trim
from docframe.functions.numbering import auto_number
from docframe.plans.scan import attach, bucket_of, ordered_scan
from docframe.plans.stage import stage

# Deepest outline level and longest style chain.
MAX_LEVEL = 8
CHAIN_LIMIT = 20


def outline_numbers(outline: DataFrame, levels: int = MAX_LEVEL + 1, strict: bool = True) -> DataFrame:
    """Number automatic paragraphs: adds ``number`` and ``marker``; others get null.

    ``outline``: ``doc_id, ord, level, kind (auto/char/none), auto_type, start_at, text``. A
    shallower paragraph ends deeper runs, a non-automatic one ends the run of its own level, and a
    blank automatic one neither counts nor ends it. A run is one more than the number of endings
    seen so far, so it is a running count. ``strict`` keeps the rule that a counter of 0 is unset:
    items starting at 0 repeat 0 until one starts elsewhere.
    """
    level = F.least(F.lit(levels - 1), F.col("level"))
    counted = (F.col("kind") == "auto") & (F.length("text") > 0)
    ends = {
        f"__run{k}": F.when((level < k) | ((level == k) & (F.col("kind") != "auto")), F.lit(1)).otherwise(F.lit(0)).cast("long")
        for k in range(levels)
    }
    runs = ordered_scan(outline, ["doc_id"], ["ord"], bucket_of("ord"), running=ends)
    own = F.lit(None).cast("long")
    for k in range(levels):
        own = F.when(level == k, F.col(f"__run{k}")).otherwise(own)
    tagged = runs.withColumns({"__level": level, "__run": own, "__auto": counted}).drop(*ends)
    autos = tagged.filter("__auto").select("doc_id", "ord", "__level", "__run", "start_at", "auto_type")
    # The scans below read the counted paragraphs several times: keep these narrow rows once.
    autos = stage(autos, "outline")
    keys = ["doc_id", "__level", "__run"]
    if strict:
        # Leading items that start at 0 do not open the counter.
        autos = ordered_scan(
            autos, keys, ["ord"], bucket_of("ord"),
            running={"__open": F.when(F.col("start_at") != 0, F.lit(1)).otherwise(F.lit(0)).cast("long")},
        )
    else:
        autos = autos.withColumn("__open", F.lit(1).cast("long"))
    opened = ordered_scan(
        autos.filter("__open > 0"), keys, ["ord"], bucket_of("ord"), row_number="__n", first={"__start": F.col("start_at")}
    ).select("doc_id", "ord", "auto_type", (F.col("__start") + F.col("__n") - 1).alias("number"))
    zero = autos.filter("__open = 0").select("doc_id", "ord", "auto_type", F.lit(0).cast("long").alias("number"))
    numbers = opened.unionByName(zero).select(
        "doc_id", "ord", "number", auto_number(F.col("auto_type"), F.col("number")).alias("marker")
    )
    return outline.join(numbers, ["doc_id", "ord"], "left")


def cascade(df: DataFrame, layers: Sequence[tuple[DataFrame, str]], props: Sequence[str]) -> DataFrame:
    """Take every property from the first layer that defines it.

    ``layers`` lists ``(table, key)`` from near to far; ``key`` is a column of ``df`` or of an
    earlier layer. Layer tables are one row per key. An explicit "none" is a value, not null.
    """
    out = df
    found: dict[str, list[Column]] = {p: [F.col(p)] for p in props if p in df.columns}
    for i, (table, key) in enumerate(layers):
        renamed = table
        for p in props:
            if p in table.columns:
                renamed = renamed.withColumnRenamed(p, f"__{i}_{p}")
                found.setdefault(p, []).append(F.col(f"__{i}_{p}"))
        out = out.join(renamed, key, "left")
    extra = [f"__{i}_{p}" for i, (t, _) in enumerate(layers) for p in props if p in t.columns]
    return out.withColumns({p: F.coalesce(*cols) for p, cols in found.items()}).drop(*extra)


def inherit_chain(styles: DataFrame, limit: int = CHAIN_LIMIT, default: object = False) -> DataFrame:
    """``style_id, effective``: first defined ``value`` along ``based_on`` within ``limit`` styles.

    Chains are followed by doubling: walks of 1, 2, 4 … styles are composed, so twenty steps need
    five joins; each doubling is written once, else its plan would double too. Unknown ids, ends of
    chains and cycles give ``default``.
    """
    one = styles.select("style_id", F.col("based_on").alias("next"), "value")

    def compose(near: DataFrame, far: DataFrame) -> DataFrame:
        tail = far.select(F.col("style_id").alias("__id"), F.col("next").alias("__next"), F.col("value").alias("__value"))
        # A finished walk needs no partner; it joins on its own id so that null keys do not pile up.
        done = F.col("value").isNotNull() | F.col("next").isNull()
        key = F.when(done, F.col("style_id")).otherwise(F.col("next"))
        joined = near.withColumn("__done", done).withColumn("__key", key).join(tail, F.col("__key") == F.col("__id"), "left")
        return joined.select(
            "style_id",
            F.when(~F.col("__done"), F.col("__next")).alias("next"),
            F.when(F.col("__done"), F.col("value")).otherwise(F.col("__value")).alias("value"),
        )

    walk, powers = None, one
    rest = limit
    while rest:
        if rest & 1:
            walk = powers if walk is None else compose(powers, walk)
        rest >>= 1
        if rest:
            powers = stage(compose(powers, powers), "chain")
    return walk.select("style_id", F.coalesce("value", F.lit(default)).alias("effective"))


def adjacent_rule(paras: DataFrame) -> DataFrame:
    """``space_after``/``space_before`` become 0 between neighbours of one style that both ask for it.

    ``paras``: ``doc_id, ord, style, contextual, space_before, space_after``.
    """
    me = F.struct("style", "contextual")
    scanned = ordered_scan(paras, ["doc_id"], ["ord"], bucket_of("ord"), lag={"__p": me}, lead={"__n": me})

    def joined(other: str) -> Column:
        same = F.col(f"{other}.style").eqNullSafe(F.col("style"))
        return F.coalesce(same & F.col(f"{other}.contextual") & F.col("contextual") & F.col(other).isNotNull(), F.lit(False))

    return (
        scanned.withColumn("space_before", F.when(joined("__p"), F.lit(0.0)).otherwise(F.col("space_before")))
        .withColumn("space_after", F.when(joined("__n"), F.lit(0.0)).otherwise(F.col("space_after")))
        .drop("__p", "__n")
    )


def resolve_target(part: Column, target: Column) -> Column:
    """Path of a relationship target, relative to the part that owns it."""
    folder = F.split(part, "/")
    folder = F.slice(folder, F.lit(1), F.size(folder) - 1)

    def step(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(seg == "..", up).when(seg.isin("", "."), acc).otherwise(F.concat(acc, F.array(seg)))

    relative = F.array_join(F.aggregate(F.split(target, "/"), folder, step), "/")
    return F.when(target.startswith("/"), F.substring(target, 2, 2_147_483_647)).otherwise(relative)


def resolve_rels(rels: DataFrame) -> DataFrame:
    """Adds ``resolved``; external targets are kept as they are."""
    return rels.withColumn(
        "resolved", F.when(F.col("external"), F.col("target")).otherwise(resolve_target(F.col("part"), F.col("target")))
    )


def follow_rels(resolved: DataFrame, kinds: Sequence[str] = ("slideLayout", "slideMaster", "theme")) -> DataFrame:
    """Follow typed edges from every part that has the first kind: ``part, <kind> ...``.

    The last relationship of a kind wins.
    """

    def edges(kind: str) -> DataFrame:
        return (
            resolved.filter(F.col("type").endswith(kind))
            .groupBy("part")
            .agg(F.max_by("resolved", "ord").alias(kind))
        )

    out = edges(kinds[0])
    for prev, kind in zip(kinds, kinds[1:]):
        out = out.join(edges(kind).withColumnRenamed("part", prev), prev, "left")
    return out.select("part", *kinds)


def ordered_visible(slides: DataFrame) -> DataFrame:
    """Visible slides in presentation order; a deck without any keeps all in part order.

    ``slides``: ``deck, ord, part, hidden``. Adds ``hidden_count`` and ``out_no``.
    """
    decks = slides.groupBy("deck").agg(
        F.sum((~F.col("hidden")).cast("long")).alias("__shown"), F.sum(F.col("hidden").cast("long")).alias("hidden_count")
    )
    kept = attach(slides, decks, ["deck"], bucket_of("ord")).filter((F.col("__shown") == 0) | ~F.col("hidden"))
    part_no = F.coalesce(F.regexp_extract("part", r"(\d+)\.xml$", 1).try_cast("long"), F.lit(0).cast("long"))
    ranked = kept.withColumn("__rank", F.when(F.col("__shown") == 0, part_no).otherwise(F.col("ord")))
    return ordered_scan(ranked, ["deck"], ["__rank", "ord"], bucket_of("__rank"), row_number="out_no").drop("__shown", "__rank")


def interleave_notes(slides: DataFrame) -> DataFrame:
    """Slides and their non-blank notes as one page list: ``deck, ord, kind, body, out_no``.

    ``slides``: ``deck, ord, part, note``.
    """
    pages = slides.select("deck", "ord", F.lit(0).alias("sub"), F.lit("slide").alias("kind"), F.col("part").alias("body"))
    notes = slides.filter(trim(F.regexp_replace(F.coalesce("note", F.lit("")), "<[^>]*>", "")) != "").select(
        "deck", "ord", F.lit(1).alias("sub"), F.lit("note").alias("kind"), F.col("note").alias("body")
    )
    return ordered_scan(
        pages.unionByName(notes), ["deck"], ["ord", "sub"], bucket_of("ord"), row_number="out_no"
    ).drop("sub")


def normal_type(c: Column) -> Column:
    """Placeholder type with titles and bodies folded together."""
    return F.when(c == "ctrTitle", "title").when(c.isin("subTitle", "obj"), "body").otherwise(c)


def priority_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Match placeholders to layout shapes: by ``idx``, else by type, else by folded type.

    ``a``: ``item, layout, idx, type``; ``b``: ``layout, ord, idx, type, shape``. The first shape in
    document order wins. Shapes are reduced to one per key before joining, so no pairs are formed.
    Adds ``shape`` and ``matched_by``.
    """

    def firsts(key: Column, name: str, keep: Column | None = None) -> DataFrame:
        rows = b if keep is None else b.filter(keep)
        return rows.groupBy("layout", key.alias(f"__{name}_key")).agg(F.min_by("shape", "ord").alias(f"__{name}"))

    out = a.withColumns({"__idx_key": F.col("idx"), "__type_key": F.col("type"), "__fold_key": normal_type(F.col("type"))})
    out = out.join(firsts(F.col("idx"), "idx", F.col("idx").isNotNull()), ["layout", "__idx_key"], "left")
    out = out.join(firsts(F.col("type"), "type"), ["layout", "__type_key"], "left")
    out = out.join(firsts(normal_type(F.col("type")), "fold"), ["layout", "__fold_key"], "left")
    by = F.when(F.col("__idx").isNotNull(), "idx").when(F.col("__type").isNotNull(), "type").when(F.col("__fold").isNotNull(), "folded type")
    return out.select(*a.columns, F.coalesce("__idx", "__type", "__fold").alias("shape"), by.alias("matched_by"))
