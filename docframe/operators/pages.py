"""Page-table operators: selections, splitting, reordering, merging, labels and render plans.

Pages are ``doc_id, page_no`` (1..n without gaps) plus payload columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.js import WS, let, trim
from docframe.plans.scan import attach, bucket_of, explode_span, ordered_scan

# Reference limits.
MAX_RANGES = 20
MAX_LABEL = 1_000_000
MAX_MARKUPS = 500
MAX_MARKUP_TEXT = 500
_MAX_SAFE_INTEGER = 9_007_199_254_740_991

# Paper sizes in points.
PAPER = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}

# Placeholders for the page number and the page total inside page text.
PAGE_MARK = "\ue000"
PAGES_MARK = "\ue001"


def page_counts(pages: DataFrame) -> DataFrame:
    """``doc_id, page_count``."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))


def ranges_of(sel: Column, page_count: Column, max_ranges: Column | int = MAX_RANGES) -> Column:
    """Parse ``"1, 3-5"`` into ``struct(error, ranges array<struct(range_no, first, last)>)``."""
    limit = max_ranges if isinstance(max_ranges, Column) else F.lit(max_ranges)
    shape = rf"^(\d+)(?:{WS}*-{WS}*(\d+))?$"
    tokens = F.transform(F.split(sel, ",", -1), lambda t: trim(t))

    def number(token: Column, group: int) -> Column:
        n = F.regexp_extract(token, shape, group).try_cast("long")
        return F.when(n <= F.lit(_MAX_SAFE_INTEGER), n)

    def parse(token: Column, i: Column) -> Column:
        first = number(token, 1)
        last = F.when(F.regexp_extract(token, shape, 2) == "", first).otherwise(number(token, 2))
        bad = ~token.rlike(shape) | first.isNull() | last.isNull() | (first < 1) | (last < first)
        code = F.when(bad, "invalid-selection").when(last > page_count, "page-out-of-range")
        return F.struct(
            (i + 1).alias("range_no"), first.alias("first"), last.alias("last"), code.alias("code")
        )

    def overlap(parsed: Column) -> Column:
        spans = F.array_sort(F.transform(parsed, lambda r: F.struct(r["first"], r["last"])))
        pairs = F.arrays_zip(
            F.slice(spans, 1, F.size(spans) - 1).alias("a"), F.slice(spans, 2, F.size(spans) - 1).alias("b")
        )
        return F.exists(pairs, lambda p: p["a"]["last"] >= p["b"]["first"])

    def verdict(tokens: Column) -> Column:
        blank = F.exists(tokens, lambda t: F.length(t) == 0)
        return let(
            F.transform(tokens, parse),
            lambda parsed: let(
                F.when(blank, F.lit("invalid-selection"))
                .when(F.size(tokens) > limit, F.lit("too-many-ranges"))
                .otherwise(
                    F.coalesce(
                        F.try_element_at(F.filter(F.transform(parsed, lambda r: r["code"]), lambda c: c.isNotNull()), F.lit(1)),
                        F.when((F.size(parsed) > 1) & overlap(parsed), F.lit("overlapping-ranges")),
                    )
                ),
                lambda error: F.struct(
                    error.alias("error"),
                    F.when(
                        error.isNull(),
                        F.transform(
                            parsed,
                            lambda r: F.struct(
                                r["range_no"].alias("range_no"), r["first"].alias("first"), r["last"].alias("last")
                            ),
                        ),
                    ).alias("ranges"),
                ),
            ),
        )

    return let(tokens, verdict)


def parse_ranges(
    selections: DataFrame, counts: DataFrame, max_ranges: int | None = MAX_RANGES
) -> DataFrame:
    """``doc_id, sel, page_count, error, ranges``; ``max_ranges=None`` allows one per page."""
    limit = F.col("page_count") if max_ranges is None else F.lit(max_ranges)
    parsed = selections.join(counts, "doc_id").withColumn(
        "__p", ranges_of(F.col("sel"), F.col("page_count"), limit)
    )
    return parsed.select(
        "doc_id", "sel", "page_count", F.col("__p.error").alias("error"), F.col("__p.ranges").alias("ranges")
    )


def _selected(parsed: DataFrame) -> DataFrame:
    """One row per selected page: ``doc_id, range_no, first, last, out_no, page_no``."""

    def with_offset(ranges: Column) -> Column:
        return F.transform(
            ranges,
            lambda r: F.struct(
                r["range_no"].alias("range_no"),
                r["first"].alias("first"),
                r["last"].alias("last"),
            ),
        )

    spans = parsed.filter("error IS NULL").select("doc_id", F.inline(with_offset(F.col("ranges"))))
    # Pages before a range in selection order = running length; ranges of one document are in
    # one array, so the scan key is (doc_id) with the range ordinal as order.
    placed = ordered_scan(
        spans, ["doc_id"], ["range_no"], bucket_of("range_no"), before={"skip": F.col("last") - F.col("first") + 1}
    )
    return explode_span(placed, "first", "last", "page_no").withColumn(
        "out_no", F.col("skip") + F.col("page_no") - F.col("first") + 1
    )


def split_pages(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """One output per range: adds ``range_no`` and ``output_name`` (``pages-a-b``)."""
    wanted = parsed.filter("error IS NULL").select("doc_id", F.inline("ranges"))
    rows = explode_span(wanted, "first", "last", "page_no").select(
        "doc_id",
        "page_no",
        "range_no",
        F.concat_ws("-", F.lit("pages"), F.col("first").cast("string"), F.col("last").cast("string")).alias("output_name"),
    )
    return pages.join(rows, ["doc_id", "page_no"])


def extract_pages(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """Selected pages, numbered in the order they were typed (``out_no``)."""
    return pages.join(_selected(parsed).select("doc_id", "page_no", "out_no"), ["doc_id", "page_no"])


def remove_pages(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """Pages outside the selection, renumbered (``out_no``), for selections without an error."""
    gone = explode_span(
        parsed.filter("error IS NULL").select("doc_id", F.inline("ranges")), "first", "last", "page_no"
    ).select("doc_id", "page_no")
    valid = attach(
        pages, parsed.filter("error IS NULL").select("doc_id"), ["doc_id"], bucket_of("page_no"), "inner"
    )
    left = valid.join(gone, ["doc_id", "page_no"], "left_anti")
    return ordered_scan(left, ["doc_id"], ["page_no"], bucket_of("page_no"), row_number="out_no")


def remove_errors(parsed: DataFrame) -> DataFrame:
    """``doc_id, error`` for removals that fail, including ``no-pages-left``."""
    removed = F.aggregate(
        "ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"] + 1
    )
    code = F.coalesce("error", F.when(removed >= F.col("page_count"), F.lit("no-pages-left")))
    return parsed.select("doc_id", code.alias("error")).filter("error IS NOT NULL")


def order_errors(order: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, valid``: order is non-empty, unique, in range and turns by 0/90/180/270."""
    turn = (F.col("rotation") >= 0) & (F.col("rotation") <= 270) & (F.col("rotation") % 90 == 0)
    per_page = order.groupBy("doc_id", "page_no").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(turn).alias("turn")
    )
    per_doc = per_page.groupBy("doc_id").agg(
        F.max("n").alias("n"), F.bool_and("turn").alias("turn"), F.min("page_no").alias("lo"), F.max("page_no").alias("hi")
    )
    ok = (F.col("n") == 1) & F.col("turn") & (F.col("lo") >= 1) & (F.col("hi") <= F.col("page_count"))
    return counts.join(per_doc, "doc_id", "left").select("doc_id", F.coalesce(ok, F.lit(False)).alias("valid"))


def organize_pages(pages: DataFrame, order: DataFrame, counts: DataFrame) -> DataFrame:
    """Pages in the requested order (``out_no``) with turned ``rotation``; invalid orders give
    one row with ``error``."""
    verdict = order_errors(order, counts)
    moves = attach(order, verdict.filter("valid").select("doc_id"), ["doc_id"], bucket_of("pos"), "inner").select(
        "doc_id", "page_no", F.col("pos").alias("out_no"), F.col("rotation").alias("turn")
    )
    payload = [c for c in pages.columns if c not in ("doc_id", "page_no", "rotation")]
    turned = F.pmod(F.col("rotation") + F.col("turn"), F.lit(360)).cast("int")
    good = pages.join(moves, ["doc_id", "page_no"]).select(
        "doc_id", "out_no", "page_no", turned.alias("rotation"), *payload, F.lit(None).cast("string").alias("error")
    )
    bad = verdict.filter("NOT valid").select("doc_id", F.lit("invalid-page-order").alias("error"))
    return good.unionByName(bad, allowMissingColumns=True)


def merge_docs(pages: DataFrame, file_order: DataFrame) -> DataFrame:
    """Concatenate documents per ``batch`` in ``ord`` order; adds ``merged_no``.

    ``file_order``: ``batch, ord, doc_id``. Offsets come from the small per-document counts.
    """
    sized = file_order.join(page_counts(pages), "doc_id")
    offsets = ordered_scan(
        sized, ["batch"], ["ord"], bucket_of("ord"), before={"offset": F.col("page_count")}
    ).select("doc_id", "batch", "ord", "offset")
    # A document may be listed twice; the attach key stays (doc_id, bucket).
    return attach(pages, offsets, ["doc_id"], bucket_of("page_no"), "inner").withColumn(
        "merged_no", F.col("offset") + F.col("page_no")
    )


def number_pages(pages: DataFrame, start: int = 1, style: str = "number") -> DataFrame:
    """Adds ``label`` (``N``, ``Page N`` or ``N of total``) and ``error``."""
    numbered = attach(pages, page_counts(pages), ["doc_id"], bucket_of("page_no"))
    number = (F.lit(start) + F.col("page_no") - 1).cast("string")
    last = F.lit(start) + F.col("page_count") - 1
    label = {
        "number": number,
        "page": F.concat(F.lit("Page "), number),
        "of": F.concat(number, F.lit(" of "), last.cast("string")),
    }[style]
    ok = F.lit(1 <= start <= MAX_LABEL) & (last <= MAX_LABEL)
    return numbered.select(
        *pages.columns, F.when(ok, label).alias("label"), F.when(~ok, F.lit("invalid-edit")).alias("error")
    )


def stamp_range(pages: DataFrame, stamps: DataFrame) -> DataFrame:
    """Apply each stamp to its pages; ``end_page`` 0 means the last page.

    ``stamps``: ``doc_id, start_page, end_page, label``. Invalid ranges give one row with
    ``error = 'invalid-page-range'`` and no page.
    """
    resolved = stamps.join(page_counts(pages), "doc_id").withColumn(
        "stop", F.when(F.col("end_page") == 0, F.col("page_count")).otherwise(F.col("end_page"))
    )
    bad = (F.col("start_page") < 1) | (F.col("stop") < F.col("start_page")) | (F.col("stop") > F.col("page_count"))
    hits = explode_span(resolved.filter(~bad), "start_page", "stop", "page_no").select("doc_id", "page_no", "label")
    good = pages.join(hits, ["doc_id", "page_no"]).withColumn("error", F.lit(None).cast("string"))
    errors = resolved.filter(bad).select("doc_id", "label", F.lit("invalid-page-range").alias("error"))
    return good.unionByName(errors, allowMissingColumns=True)


def markup_ok() -> Column:
    """Per-item rule of :func:`validate_children`; expects the page size as ``pw, ph``."""
    finite = F.lit(True)
    for c in ("x", "y", "w", "h", "font_size"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    inside = (
        (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") > 0) & (F.col("h") > 0)
        & (F.col("font_size") >= 6) & (F.col("font_size") <= 96)
        & (F.col("x") <= F.col("pw")) & (F.col("y") <= F.col("ph"))
        & (F.col("w") <= F.col("pw")) & (F.col("h") <= F.col("ph"))
    )
    colour = F.col("color").rlike("^#[0-9a-fA-F]{6}$")
    text = F.substring(trim("text"), 1, MAX_MARKUP_TEXT) != ""
    kind = (F.col("kind") == "rectangle") | (F.col("kind").isin("text", "note") & text)
    return F.coalesce(finite & inside & colour & kind, F.lit(False))


def validate_children(pages: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_items, error``: one bad item, or more than 500, rejects the document."""
    sizes = pages.select("doc_id", "page_no", F.col("width").alias("pw"), F.col("height").alias("ph"))
    checked = items.join(sizes, ["doc_id", "page_no"], "left").withColumn("ok", markup_ok())
    per_doc = checked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.bool_and("ok").alias("ok"))
    bad = (F.col("n_items") > MAX_MARKUPS) | ~F.col("ok")
    return per_doc.select("doc_id", "n_items", F.when(bad, F.lit("invalid-edit")).alias("error"))


def render_plan(
    pages: DataFrame,
    dpi: float = 150.0,
    page_pixels: float = 24_000_000,
    total_pixels: float = 180_000_000,
    max_edge: float | None = None,
    fit_pixels: float | None = None,
    rounding: str = "ceil",
) -> DataFrame:
    """Pixel size per page and the page that breaks the document's budget.

    Adds ``scale, px_w, px_h, pixels, first_bad`` and ``error`` (``page-too-large`` from the first
    page that passes a cap). ``max_edge``/``fit_pixels`` shrink the scale instead of failing.
    """
    area = F.col("width") * F.col("height")
    options = [F.lit(dpi / 72.0)]
    if max_edge is not None:
        options += [F.lit(float(max_edge)) / F.col("width"), F.lit(float(max_edge)) / F.col("height")]
    if fit_pixels is not None:
        options.append(F.sqrt(F.lit(float(fit_pixels)) / area))
    scale = F.least(*options) if len(options) > 1 else options[0]
    whole = F.ceil if rounding == "ceil" else F.floor
    sized = pages.withColumn("scale", scale)
    sized = sized.withColumn("px_w", F.greatest(F.lit(1), whole(F.col("width") * F.col("scale")))).withColumn(
        "px_h", F.greatest(F.lit(1), whole(F.col("height") * F.col("scale")))
    ).withColumn("pixels", F.col("px_w") * F.col("px_h"))
    spent = ordered_scan(
        sized, ["doc_id"], ["page_no"], bucket_of("page_no"), running={"used_pixels": F.col("pixels")}
    )
    bad = (F.col("pixels") > page_pixels) | (F.col("used_pixels") > total_pixels)
    first_bad = spent.filter(bad).groupBy("doc_id").agg(F.min("page_no").alias("first_bad"))
    return attach(spent, first_bad, ["doc_id"], bucket_of("page_no"), buckets_from=pages).withColumn(
        "error", F.when(F.col("page_no") >= F.col("first_bad"), F.lit("page-too-large"))
    )


def paper_fit(images: DataFrame, paper: str = "a4", margin: float = 0.0) -> DataFrame:
    """Place an image on a page: adds ``page_w, page_h, draw_w, draw_h, x, y`` (points)."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    if paper == "fit":
        shrink = F.least(F.lit(1.0), F.lit(1440.0) / F.greatest(w, h)) * F.lit(72.0 / 150.0)
        page_w, page_h, inset = w * shrink, h * shrink, 0.0
    else:
        short, long_ = PAPER[paper]
        wide = (w / h) > F.lit(short / long_)
        page_w = F.when(wide, F.lit(long_)).otherwise(F.lit(short))
        page_h = F.when(wide, F.lit(short)).otherwise(F.lit(long_))
        inset = float(margin)
    scale = F.least((F.col("page_w") - 2 * inset) / w, (F.col("page_h") - 2 * inset) / h)
    return (
        images.withColumns({"page_w": page_w, "page_h": page_h})
        .withColumns({"draw_w": w * scale, "draw_h": h * scale})
        .withColumns({"x": (F.col("page_w") - F.col("draw_w")) / 2, "y": (F.col("page_h") - F.col("draw_h")) / 2})
    )


def field_marker(instruction: Column) -> Column:
    """Placeholder for a page-number or page-total field instruction, else null."""
    code = F.upper(F.regexp_extract(trim(instruction), r"^(\S+)", 1))
    return F.when(code == "PAGE", F.lit(PAGE_MARK)).when(code.isin("NUMPAGES", "SECTIONPAGES"), F.lit(PAGES_MARK))


def fill_page_markers(pages: DataFrame, page_mark: str = PAGE_MARK, pages_mark: str = PAGES_MARK) -> DataFrame:
    """Replace the page and total placeholders in ``text``."""
    counted = attach(pages, page_counts(pages), ["doc_id"], bucket_of("page_no"))
    text = F.replace("text", F.lit(page_mark), F.col("page_no").cast("string"))
    text = F.replace(text, F.lit(pages_mark), F.col("page_count").cast("string"))
    return counted.withColumn("text", text).select(*pages.columns)


def header_sections(
    code: Column, page: Column, total: Column, file: Column, sheet: Column, date: Column, time: Column
) -> Column:
    """Expand one header/footer code into ``struct(l, c, r)``; style codes are dropped."""
    amp = "\ue010"
    # Style codes: quoted font, colour (six characters follow), size, and single letters.
    text = F.replace(code, F.lit("&&"), F.lit(amp))
    text = F.regexp_replace(text, r'&"[^"]*("|$)', "")
    text = F.regexp_replace(text, r"(?s)&K.{0,6}", "")
    text = F.regexp_replace(text, r"&\d+", "")
    text = F.regexp_replace(text, r"&[BIUEGSXYOHZ]", "")
    values = {"P": page, "N": total, "D": date, "T": time, "F": file, "A": sheet}
    marks = {letter: chr(0xE020 + i) for i, letter in enumerate(values)}
    for letter, mark in marks.items():
        text = F.replace(text, F.lit(f"&{letter}"), F.lit(mark))
    text = F.regexp_replace(text, r"&([^LCR])", "$1")

    def section(pieces: Column, letter: str) -> Column:
        own = F.filter(pieces, lambda p: p.startswith(letter))
        out = F.array_join(F.transform(own, lambda p: F.substring(p, 2, 2_147_483_647)), "")
        for key, mark in marks.items():
            out = F.replace(out, F.lit(mark), values[key])
        return F.replace(out, F.lit(amp), F.lit("&"))

    pieces = F.split(F.concat(F.lit("C"), text), "&", -1)
    return let(
        pieces,
        lambda p: F.struct(section(p, "L").alias("l"), section(p, "C").alias("c"), section(p, "R").alias("r")),
    )


def header_footer(
    pages: DataFrame,
    prefix: str = "header",
    date: str = "",
    time: str = "",
    first_page_number: int = 1,
) -> DataFrame:
    """Choose the first/even/odd template per page and expand it.

    ``pages`` carries ``doc_id, page_no, page_count, file, sheet`` and the templates
    ``first_t, even_t, odd_t`` (null = not defined). Adds ``<prefix>_l/_c/_r``.
    """
    template = (
        F.when((F.col("page_no") == 1) & F.col("first_t").isNotNull(), F.col("first_t"))
        .when((F.col("page_no") % 2 == 0) & F.col("even_t").isNotNull(), F.col("even_t"))
        .otherwise(F.coalesce("odd_t", F.lit("")))
    )
    number = (F.col("page_no") + F.lit(first_page_number - 1)).cast("string")
    parts = header_sections(
        template, number, F.col("page_count").cast("string"), F.col("file"), F.col("sheet"), F.lit(date), F.lit(time)
    )
    return pages.withColumn("__s", parts).select(
        *pages.columns, *[F.col(f"__s.{k}").alias(f"{prefix}_{k}") for k in "lcr"]
    )


def inherit_headers(sections: DataFrame) -> DataFrame:
    """``doc_id, kind, type, section_no, ref``: a missing ``ref`` takes the latest earlier one."""
    scanned = ordered_scan(
        sections, ["doc_id", "kind", "type"], ["section_no"], bucket_of("section_no"), carry={"effective": F.col("ref")}
    )
    return scanned
