"""Text operators: comparison, field extraction, cleaning, search, masking and error codes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.js import NOT_WS, WS, collapse, first_or_empty, let, nfc, nfkd, stem, trim
from docframe.functions.refs import parse_range
from docframe.plans.ship import ship

# Reference limits.
SNIPPET = 360
VISUAL_THRESHOLD = 0.2
CHANNEL_THRESHOLD = 20
MIN_BOX_SIDE = 0.004
PASSWORD_MIN, PASSWORD_MAX = 8, 128
MAX_NAME = 90

LINES_AT_ONCE = 256
TEXT_AT_ONCE = 1_048_576
_WORD = re.compile(NOT_WS + "+")
_IS_WS = np.zeros(0x10001, dtype=bool)
_IS_WS[[m.start() for m in re.finditer(WS, "".join(map(chr, range(0x10000))))]] = True


# -- comparison --------------------------------------------------------------------------------


def normalize_text(c: Column | str) -> Column:
    """Canonical composition, whitespace runs to one space, trimmed."""
    return collapse(nfc(c))


def snippet(c: Column) -> Column:
    """Display text of a difference: the first 360 characters and an ellipsis."""
    return F.when(F.length(c) <= SNIPPET, c).otherwise(F.concat(F.substring(c, 1, SNIPPET), F.lit("…")))


def array_diff_pct(a: Column | str, b: Column | str, threshold: int = CHANNEL_THRESHOLD) -> Column:
    """Percentage of four-channel pixels whose largest colour difference exceeds ``threshold``."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    pixels = F.floor(F.least(F.size(a), F.size(b)) / F.lit(4)).cast("int")

    def differs(i: Column) -> Column:
        gaps = [F.abs(F.get(a, i * 4 + k) - F.get(b, i * 4 + k)) for k in range(3)]
        return F.greatest(*gaps) > threshold

    changed = F.size(F.filter(F.sequence(F.lit(0), pixels - 1), differs))
    return F.when(pixels > 0, changed / pixels * 100).otherwise(F.lit(100.0))


def compare_docs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences between two page tables, joined on ``doc_id, page_no``.

    Output: ``doc_id, page_no, kind (added/removed/changed), text_changed, visual_pct,
    original_text, revised_text``; equal pages are left out. Pages with ``width``/``height`` of
    different size count as fully changed; a ``pixels`` column on both sides is compared with
    :func:`array_diff_pct`. Whole texts are compared, by SHA-256 and length, so that the join moves a
    digest and the reported snippet of every page instead of both corpora.
    """
    sized = {"width", "height"} <= set(a.columns) & set(b.columns)
    imaged = "pixels" in a.columns and "pixels" in b.columns

    def side(df: DataFrame, p: str) -> DataFrame:
        whole = F.col("__whole")
        digest = F.struct(F.unhex(F.sha2(whole, 256)).alias("sha"), F.length(whole).alias("n"))
        cols = [snippet(whole).alias(f"{p}_text"), digest.alias(f"{p}_digest"), F.lit(True).alias(f"{p}_there")]
        cols += [F.col(c).alias(f"{p}_{c}") for c in ("width", "height") if sized]
        cols += [F.col("pixels").alias(f"{p}_pixels")] if imaged else []
        # Normalised once in its own projection; the columns below all read it.
        return df.withColumn("__whole", normalize_text("text")).select("doc_id", "page_no", *cols)

    both = side(a, "a").join(side(b, "b"), ["doc_id", "page_no"], "full_outer")
    visual = array_diff_pct("a_pixels", "b_pixels") if imaged else F.lit(None).cast("double")
    if sized:
        same = (F.abs(F.col("a_width") - F.col("b_width")) < 0.5) & (F.abs(F.col("a_height") - F.col("b_height")) < 0.5)
        visual = F.when(same, visual).otherwise(F.lit(100.0))
    paired = F.col("a_there").isNotNull() & F.col("b_there").isNotNull()
    kind = F.when(F.col("a_there").isNull(), "added").when(F.col("b_there").isNull(), "removed").otherwise("changed")
    both = both.withColumns(
        {
            "kind": kind,
            "text_changed": ~F.col("a_digest").eqNullSafe(F.col("b_digest")),
            "visual_pct": F.when(paired, visual),
        }
    )
    differs = F.col("text_changed") | (F.coalesce("visual_pct", F.lit(0.0)) >= VISUAL_THRESHOLD)
    return both.filter(differs).select(
        "doc_id",
        "page_no",
        "kind",
        "text_changed",
        "visual_pct",
        F.when(F.col("text_changed"), F.col("a_text")).alias("original_text"),
        F.when(F.col("text_changed"), F.col("b_text")).alias("revised_text"),
    )


# -- fields and names --------------------------------------------------------------------------

# Label words, date shapes and amount shapes of a receipt.
_LABEL = r"(?i)^(receipt|invoice|tax invoice|sales receipt)$"
_DATE = (
    r"(?i)\b(?:20\d{2}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-](?:20)?\d{2}"
    r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+20\d{2})\b"
)
_TOTAL = r"(?i)(?:grand\s+total|amount\s+due|balance\s+due|total|amount\s+paid|paid)"
_AMOUNT = r"(?:[$€£₹]\s*)?\b\d{1,3}(?:,\d{3})*(?:\.\d{2})\b|\b\d+\.\d{2}\b"


def _clean_lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n", -1), collapse)


def extract_receipt(text: Column | str) -> Column:
    """``struct(merchant, date, total, merchant_conf, date_conf, total_conf)`` from a receipt text."""
    text = F.col(text) if isinstance(text, str) else text

    def fields(lines: Column) -> Column:
        merchant = first_or_empty(
            F.filter(lines, lambda s: s.rlike("[A-Za-z]") & ~s.rlike(_LABEL) & (F.length(s) < 100))
        )
        date_line = first_or_empty(F.filter(lines, lambda s: s.rlike(_DATE)))
        total_line = F.coalesce(
            F.try_element_at(F.filter(lines, lambda s: s.rlike(_TOTAL) & s.rlike(r"\d")), F.lit(-1)), F.lit("")
        )
        total = F.coalesce(
            F.try_element_at(F.regexp_extract_all(total_line, F.lit(_AMOUNT), F.lit(0)), F.lit(-1)), F.lit("")
        )

        def conf(found: Column) -> Column:
            return F.when(found != "", F.lit("candidate")).otherwise(F.lit("review"))

        return F.struct(
            merchant.alias("merchant"),
            F.regexp_extract(date_line, _DATE, 0).alias("date"),
            total.alias("total"),
            conf(merchant).alias("merchant_conf"),
            conf(date_line).alias("date_conf"),
            conf(total).alias("total_conf"),
        )

    return let(F.filter(_clean_lines(text), lambda s: s != ""), fields)


def sanitize_name(c: Column) -> Column:
    """File-name-safe text, at most 90 characters."""
    out = F.regexp_replace(nfkd(c), r"[\u0300-\u036F]", "")
    out = F.regexp_replace(out, r'[\\/:*?"<>|]', " ")
    out = F.regexp_replace(out, r"[\u0000-\u001f]", " ")
    out = F.regexp_replace(out, r"[. ]+$", "")
    return F.substring(collapse(out), 1, MAX_NAME)


def suggest_name(df: DataFrame, text: str = "text", file_name: str = "file_name", number: str | None = None) -> DataFrame:
    """Adds ``suggested`` (with the original extension) and ``note``.

    ``number`` names the 1-based position used for the last fallback ``scan-<n>``.
    """
    lines = _clean_lines(F.col(text))
    usable = F.filter(
        lines,
        lambda s: (F.length(s) >= 3)
        & (F.length(s) <= MAX_NAME)
        & s.rlike("[A-Za-z0-9]")
        & ~s.rlike(r"(?i)^(scan|document|receipt|invoice|page)\b"),
    )
    n = F.col(number).cast("string") if number else F.lit("1")
    # The line and the stem are cleaned in one pass each, so the rare Python step runs twice at most.
    staged = df.withColumn("__line", sanitize_name(first_or_empty(usable))).withColumn(
        "__stem", sanitize_name(stem(F.col(file_name)))
    )
    blank = F.lit("")
    base = F.coalesce(F.nullif("__line", blank), F.nullif("__stem", blank), F.concat(F.lit("scan-"), n))
    # The base is clean already; cleaning it again can only strip dots and spaces left by the cut.
    tidy = collapse(F.regexp_replace(base, r"[. ]+$", ""))
    ext = F.regexp_extract(F.col(file_name), r"\.[^.]+$", 0)
    note = F.when(trim(F.col(text)) != "", F.lit("suggested")).otherwise(F.lit("original"))
    return staged.withColumn(
        "suggested", F.concat(F.when(tidy == "", F.lit("scan")).otherwise(tidy), ext)
    ).withColumn("note", note).drop("__line", "__stem")


# -- metadata and form fields ------------------------------------------------------------------


def scrub_metadata(
    df: DataFrame, info: str, keys: Sequence[str] | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    """Remove all (or the given) keys of the ``info`` map and clear the ``drop`` columns."""
    kept = F.map_filter(info, lambda k, _: ~k.isin(list(keys))) if keys is not None else F.map_filter(info, lambda k, _: F.lit(False))
    return df.withColumn(info, kept).drop(*drop)


def flatten_fields(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """Form fields as plain rows: ``key, field, value, n_fields, error`` (``no-form-fields``)."""
    parsed = df.select(key, F.from_json(F.col(json_col), "map<string,string>").alias("m"))
    n = F.coalesce(F.when(F.col("m").isNotNull(), F.size("m")), F.lit(0))
    return (
        parsed.withColumn("n_fields", n.cast("long"))
        .select(key, "n_fields", F.explode_outer("m").alias("field", "value"))
        .withColumn("error", F.when(F.col("n_fields") == 0, F.lit("no-form-fields")))
    )


# -- html --------------------------------------------------------------------------------------

# Tags kept by the sanitizer.
ALLOWED_TAGS = ("p", "span", "a", "br", "sub", "sup", "strong", "em", "b", "i", "u", "s", "ol", "ul", "li", "div")
_PIECES = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^>]*>|[^<]+|<"
_SAFE_LINK = r"(?i)^(https?:|mailto:)"


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return F.regexp_replace(raw, r"""^["']|["']$""", "")


def sanitize_html(c: Column | str, drop_script: bool = True) -> Column:
    """Keep an allow-list of formatting tags; unwrap the rest; keep safe styles and links only.

    ``drop_script=False`` keeps the text of ``script``/``style`` elements, escaped.
    """
    c = F.col(c) if isinstance(c, str) else c
    html = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    allowed = [F.lit(t) for t in ALLOWED_TAGS]

    def escape(text: Column) -> Column:
        out = F.replace(text, F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def rewrite(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        style = _attribute(piece, "style")
        href = _attribute(piece, "href")
        unsafe = style.rlike(r"(?i)url\s*\(|expression\s*\(|@import")
        opened = F.concat(
            F.lit("<"),
            name,
            F.when((style != "") & ~unsafe, F.concat(F.lit(' style="'), F.replace(style, F.lit('"'), F.lit("&quot;")), F.lit('"'))).otherwise(""),
            F.when((name == "a") & href.rlike(_SAFE_LINK), F.concat(F.lit(' href="'), F.replace(href, F.lit('"'), F.lit("&quot;")), F.lit('"'))).otherwise(""),
            F.lit(">"),
        )
        inner = F.regexp_replace(F.regexp_replace(piece, r"(?is)^<(script|style)\b[^>]*>", ""), r"(?is)</(script|style)\s*>$", "")
        return (
            F.when(~piece.startswith("<"), piece)
            .when(name.isin("script", "style") & ~piece.startswith("</"), F.lit("") if drop_script else escape(inner))
            .when(piece == "<", F.lit("&lt;"))
            .when(~F.array_contains(F.array(*allowed), name), F.lit(""))
            .when(piece.startswith("</"), F.when(name == "br", F.lit("")).otherwise(F.concat(F.lit("</"), name, F.lit(">"))))
            .otherwise(opened)
        )

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(_PIECES), F.lit(0)), rewrite), "")


def extract_links(df: DataFrame, html: str = "html") -> DataFrame:
    """One row per anchor with an allowed target: adds ``link_no, href``; drops ``html``."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    hrefs = F.filter(F.transform(tags, lambda t: _attribute(t, "href")), lambda h: h.rlike(_SAFE_LINK))
    keep = [c for c in df.columns if c != html]
    return df.select(*keep, F.posexplode(hrefs).alias("pos", "href")).select(
        *keep, (F.col("pos") + 1).alias("link_no"), "href"
    )


def cell_links(cells: DataFrame, links: DataFrame, rels: DataFrame) -> DataFrame:
    """Web and mail links of sheet cells: ``sheet, row, col, href``.

    ``links``: ``sheet, ord, ref, rel_id``; ``rels``: ``sheet, rel_id, target, external``, one row per id. A link
    belongs to the first cell of its range; links to missing cells, inner targets and other schemes are dropped. Of
    several links of one cell the last allowed one stays.
    """
    allowed = rels.filter(F.col("external") & F.col("target").rlike(_SAFE_LINK)).select("sheet", "rel_id", "target")
    # Generated rows are parsed once; a filter on a computed column would be pushed below it with a second copy.
    placed = links.select("sheet", "ord", "rel_id", F.inline(F.array_compact(F.array(parse_range(F.col("ref"))))))
    chosen = (
        placed.join(allowed, ["sheet", "rel_id"])
        .groupBy("sheet", F.col("r1").alias("row"), F.col("c1").alias("col"))
        .agg(F.max(F.struct("ord", "target")).alias("last"))
        .select("sheet", "row", "col", F.col("last.target").alias("href"))
    )
    return chosen.join(cells.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_semi")


# -- catalogue ---------------------------------------------------------------------------------


def dedup_first(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    """Keep the first row per ``key``; a partial aggregate, so a hot key shuffles one row per task."""
    rest = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.min_by(rest, F.col(ord_col)).alias("r")).select("r.*")


def search_topk(df: DataFrame, text: str, k: int = 8) -> DataFrame:
    """Rows matching every term, best ``k`` first: ``rank`` and ``score`` added.

    ``df``: ``ord, title, description, grp, keywords``.
    """
    terms = text.lower().split()
    title = F.lower("title")
    hay = F.lower(F.concat_ws(" ", title, "description", "grp", F.coalesce("keywords", F.lit(""))))
    hit = F.lit(bool(terms))
    for term in terms:
        hit = hit & F.contains(hay, F.lit(term))
    lead = F.lit(terms[0] if terms else "")
    grade = F.when(F.startswith(title, lead), F.lit(0.0)).when(F.contains(title, lead), F.lit(1.0)).otherwise(F.lit(2.0))
    best = df.filter(hit).withColumn("score", grade + F.length("title") / 100).orderBy("score", "ord").limit(k)
    # Only the k reported rows are left here, so numbering them in one task is bounded by k.
    return best.withColumn("rank", F.row_number().over(Window.orderBy("score", "ord")))


def substring_filter(items: DataFrame, groups: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Items containing ``text`` and the groups that still have one.

    ``items``: ``grp, title, description``; ``groups``: ``grp, ...``.
    """
    hay = F.lower(F.concat_ws(" ", "title", "description", "grp"))
    left = items.filter(F.contains(hay, F.lit(text.strip().lower())))
    return left, groups.join(left.select("grp").distinct(), "grp", "left_semi")


def ordered_lookup(spark: SparkSession, keys: Sequence[str], df: DataFrame, key: str, ord_col: str) -> DataFrame:
    """Rows of ``df`` for a list of keys, numbered in list order (``pos``); misses are dropped.

    The list is a call argument; how it is joined is left to the optimizer.
    """
    wanted = spark.createDataFrame([(i + 1, k) for i, k in enumerate(keys)], f"pos int, {key} string")
    hits = df.join(wanted.select(key).distinct(), key, "left_semi")
    return dedup_first(hits, key, ord_col).join(wanted, key)


# -- scripts and coverage ----------------------------------------------------------------------

# Ranges of characters that need shaping or bidirectional layout.
COMPLEX_SCRIPT = (
    r"[\u0590-\u08FF\u0900-\u0DFF\u0E00-\u0EFF\u0F00-\u0FFF\u1000-\u109F\u1780-\u18AF"
    r"\u200C-\u200F\u202A-\u202E\u2066-\u2069\uFB1D-\uFDFF\uFE70-\uFEFF]"
)


def script_profile(text: Column | str, charset: Sequence[tuple[int, int]]) -> Column:
    """``struct(complex, covered)``: needs shaping; all code points inside ``charset`` ranges."""
    text = F.col(text) if isinstance(text, str) else text
    inside = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in charset)
    return F.struct(text.rlike(COMPLEX_SCRIPT).alias("complex"), (~text.rlike(f"[^{inside}]")).alias("covered"))


def parse_unicode_ranges(faces: DataFrame) -> DataFrame:
    """``face, spec`` with specs like ``U+0-FF, U+131`` to ``face, first, last``; no spec = all."""
    parts = F.transform(F.split("spec", ","), lambda s: F.regexp_replace(trim(s), r"(?i)^U\+", ""))
    spans = F.transform(
        parts,
        lambda s: F.struct(
            F.conv(F.split_part(s, F.lit("-"), F.lit(1)), 16, 10).cast("long").alias("first"),
            F.conv(
                F.when(F.contains(s, F.lit("-")), F.split_part(s, F.lit("-"), F.lit(2))).otherwise(s), 16, 10
            ).cast("long").alias("last"),
        ),
    )
    everything = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0x10FFFF).cast("long").alias("last")))
    return faces.select("face", F.inline(F.when(F.coalesce("spec", F.lit("")) == "", everything).otherwise(spans)))


def code_points(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct code points per key: ``key, cp``; repeats inside one text are removed in place."""
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda ch: ch != ""))

    def point(ch: Column) -> Column:
        b = F.encode(ch, "UTF-32")
        return F.conv(F.hex(b), 16, 10).cast("long")

    return docs.select(key, F.explode(chars).alias("ch")).distinct().select(key, point(F.col("ch")).alias("cp"))


def coverage_join(points: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Faces hit by any used character: distinct ``key, face``.

    A code point's faces are one row, so the join has one row per character on that side; whether it is
    broadcast is left to the optimizer's size estimate, and a shuffled join splits frequent characters.
    """
    block = 256
    spread = ranges.withColumn(
        "blk", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block)))
    )
    used = points.select("cp").distinct().withColumn("blk", F.floor(F.col("cp") / block))
    faces = (
        used.join(spread, "blk")
        .filter("cp BETWEEN first AND last")
        .groupBy("cp")
        .agg(F.collect_set("face").alias("faces"))
    )
    return points.join(faces, "cp").select(key, F.explode("faces").alias("face")).distinct()


# -- tokens and masking ------------------------------------------------------------------------


def _page_words(texts: list[str]) -> tuple[dict[str, np.ndarray], pa.Array]:
    """Words of pages: per word its page, ``line_no, n_lines, n_cols, tok_no, x``, and the words as text.

    All pages are taken as one array of code points: ends of words and lines are places in it, and the words are
    what is left of it without white space.
    """
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
    page_from = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    # Line ends, also behind every page; a line starts behind the end before it.
    ends = np.append(np.flatnonzero(codes == 10), len(codes))
    line_from = np.concatenate(([0], ends[:-1] + 1))
    line_page = np.searchsorted(page_from, line_from, side="right") - 1
    first_line = np.searchsorted(line_from, page_from)
    n_lines = np.diff(np.append(first_line, len(ends)))
    n_cols = np.maximum(1, np.maximum.reduceat(ends - line_from, first_line))
    word = ~_IS_WS[np.minimum(codes, len(_IS_WS) - 1)]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(line_from, starts, side="right") - 1
    page = line_page[line]
    first_word = np.searchsorted(line, np.arange(len(ends)))
    left = codes[word]
    width = 1 + (left >= 0x80).astype(np.int64) + (left >= 0x800) + (left >= 0x10000)
    bounds = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(stops - starts)))]
    data = left.tobytes().decode("utf-32-le").encode("utf-8")
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
    columns = {
        "line_no": line - first_line[page] + 1, "n_lines": n_lines[page], "n_cols": n_cols[page],
        "tok_no": np.arange(len(starts)) - first_word[line] + 1, "x": starts - line_from[line],
    }
    return {"page": page, **columns}, words


def tokens(pages: DataFrame) -> DataFrame:
    """Words with their grid position: ``doc_id, page_no, line_no, tok_no, x, token`` and the page's
    ``n_cols, n_lines``. ``x`` is the 0-based column of the first character. No shuffle."""
    ship(pages.sparkSession)
    keys = ["doc_id", "page_no"]
    some = pages.filter("text IS NOT NULL").select(*keys, F.col("text").cast("binary").alias("text"))
    ints = ["line_no", "n_lines", "n_cols", "tok_no", "x"]
    result = T.StructType([*[some.schema[k] for k in keys], *[T.StructField(c, T.IntegerType()) for c in ints], T.StructField("token", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # Pages of about ``TEXT_AT_ONCE`` bytes, one at least.
                until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_AT_ONCE, side="right")))
                part = batch.slice(at, until - at)
                found, words = _page_words([t.decode("utf-8", "replace") for t in part.column("text").to_pylist()])
                of = pa.array(found["page"])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(of) for k in keys], *[pa.array(found[c].astype(np.int32)) for c in ints], words], names=result.names
                )
                at = until

    return some.mapInArrow(cut, result)


def clean_boxes(boxes: DataFrame) -> DataFrame:
    """Corners ordered and clamped to the page; boxes under 0.004 on a side are dropped."""
    return boxes.select(
        "doc_id",
        "page_no",
        F.greatest(F.lit(0.0), F.least("x1", "x2")).alias("left"),
        F.greatest(F.lit(0.0), F.least("y1", "y2")).alias("top"),
        F.least(F.lit(1.0), F.greatest("x1", "x2")).alias("right"),
        F.least(F.lit(1.0), F.greatest("y1", "y2")).alias("bottom"),
    ).filter((F.col("right") - F.col("left") >= MIN_BOX_SIDE) & (F.col("bottom") - F.col("top") >= MIN_BOX_SIDE))


def _masked(text: str, left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, mask: str) -> tuple[str, int]:
    """One page with the words under its boxes masked, and how many.

    A box becomes whole columns of the lines it touches. Lines lie one behind another on one axis, so overlapping
    spans merge in one ordered pass and every word looks up the last span that starts before its end.
    """
    lines = text.split("\n")
    n, width = len(lines), max(1, *map(len, lines))
    first = np.minimum(n, np.floor(top * n).astype(np.int64) + 1)
    last = np.minimum(n, np.floor(bottom * n).astype(np.int64) + 1)
    c1, c2 = np.floor(left * width).astype(np.int64), np.ceil(right * width).astype(np.int64)
    step = width + 1
    done, total = [], 0
    for low in range(1, n + 1, LINES_AT_ONCE):
        high = min(n, low + LINES_AT_ONCE - 1)
        box = np.flatnonzero((first <= high) & (last >= low))
        begin = np.maximum(first[box], low)
        count = np.minimum(last[box], high) - begin + 1
        line = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
        box = np.repeat(box, count)
        real = (top[box] < line / n) & (bottom[box] > (line - 1) / n)
        box, line = box[real], line[real]
        starts, ends = line * step + c1[box], line * step + c2[box]
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends
        opens = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1]))) if len(order) else order
        starts, ends = starts[opens], np.append(ends[opens[1:] - 1], ends[-1:])
        words = [[(m.start(), m.group()) for m in _WORD.finditer(s)] for s in lines[low - 1 : high]]
        at = np.array([(low + i) * step + x for i, ws in enumerate(words) for x, _ in ws], dtype=np.int64)
        size = np.array([len(w) for ws in words for _, w in ws], dtype=np.int64)
        span = np.searchsorted(starts, at + size, side="left") - 1
        gone = (span >= 0) & (np.append(ends, 0)[span] > at)
        total += int(gone.sum())
        hidden = iter(gone.tolist())
        done += [" ".join(mask * len(w) if next(hidden) else w for _, w in ws) for ws in words]
    return "\n".join(done), total


def redact(pages: DataFrame, boxes: DataFrame, mask: str = "█") -> DataFrame:
    """Page text with every word under a box replaced by ``mask`` (one per character).

    Words are joined by single spaces. Output: ``doc_id, page_no, text, n_masked``. Boxes are gathered per page and
    joined once; pages without boxes stay in the JVM. Pages without text are dropped.
    """
    sides = ["left", "top", "right", "bottom"]
    found = clean_boxes(boxes).groupBy("doc_id", "page_no").agg(*[F.collect_list(x).alias(f"__{x}") for x in sides])
    joined = pages.filter("text IS NOT NULL").select("doc_id", "page_no", "text").join(found, ["doc_id", "page_no"], "left")

    @F.pandas_udf("text string, n_masked long")
    def cover(text: pd.Series, left: pd.Series, top: pd.Series, right: pd.Series, bottom: pd.Series) -> pd.DataFrame:
        rows = [
            (None, 0) if t is None else _masked(t, *[np.asarray(v, dtype=np.float64) for v in box], mask)
            for t, *box in zip(text, left, top, right, bottom, strict=True)
        ]
        return pd.DataFrame(rows, columns=["text", "n_masked"])

    boxed = F.col("__left").isNotNull()
    plain = F.array_join(F.transform(F.split("text", "\n", -1), collapse), "\n")
    covered = joined.withColumn("__c", cover(F.when(boxed, F.col("text")), *[F.col(f"__{x}") for x in sides]))
    return covered.select(
        "doc_id", "page_no", F.when(boxed, F.col("__c.text")).otherwise(plain).alias("text"),
        F.when(boxed, F.col("__c.n_masked")).otherwise(F.lit(0)).cast("long").alias("n_masked"),
    )


# -- locking -----------------------------------------------------------------------------------


def _key(password: Column) -> Column:
    return F.unhex(F.sha2(password, 256))


def lock_column(df: DataFrame, col: str, password: Column, confirmation: Column) -> DataFrame:
    """Encrypt ``col`` to binary ``locked``; policy failures give ``error`` and no payload."""
    n = F.length(password)
    error = (
        F.when(n == 0, F.lit("password-required"))
        .when(n < PASSWORD_MIN, F.lit("password-too-short"))
        .when(n > PASSWORD_MAX, F.lit("password-too-long"))
        .when(password != confirmation, F.lit("password-mismatch"))
    )
    locked = F.aes_encrypt(F.encode(F.col(col), "UTF-8"), _key(password), F.lit("GCM"))
    return df.withColumn("error", error).withColumn("locked", F.when(F.col("error").isNull(), locked)).drop(col)


def unlock_column(df: DataFrame, col: str, password: Column, out: str = "text") -> DataFrame:
    """Decrypt; a wrong password gives ``error = 'wrong-password'`` and null, never garbage."""
    n = F.length(password)
    plain = F.try_aes_decrypt(F.col(col), _key(password), F.lit("GCM"))
    staged = df.withColumn("__plain", F.when((n > 0) & (n <= PASSWORD_MAX), plain))
    error = (
        F.when(n == 0, F.lit("password-required"))
        .when(n > PASSWORD_MAX, F.lit("password-too-long"))
        .when(F.col(col).isNotNull() & F.col("__plain").isNull(), F.lit("wrong-password"))
    )
    prior = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return staged.withColumn(out, F.decode("__plain", "UTF-8")).withColumn("error", F.coalesce(prior, error)).drop("__plain")


# -- error codes -------------------------------------------------------------------------------

# Ordered rules "any of these texts -> code"; the first hit wins.
RULES: Mapping[str, tuple[tuple[tuple[str, ...], str], ...]] = {
    "pages": (
        (("wrong-type",), "wrong-type"),
        (("empty-file",), "empty-file"),
        (("input-too-large",), "input-too-large"),
        (("total-input-too-large",), "total-input-too-large"),
        (("too-many-files",), "too-many-files"),
        (("not-enough-files",), "not-enough-files"),
        (("too-many-pages",), "too-many-pages"),
        (("empty-document",), "empty-document"),
        (("invalid-selection",), "invalid-selection"),
        (("page-out-of-range",), "page-out-of-range"),
        (("overlapping-ranges",), "overlapping-ranges"),
        (("too-many-ranges",), "too-many-ranges"),
        (("no-pages-left",), "no-pages-left"),
        (("invalid-page-order",), "invalid-page-order"),
        (("output-too-large",), "output-too-large"),
        (("password", "encrypted"), "encrypted"),
        (("memory", "allocation", "array buffer", "heap out of memory"), "memory"),
        (("invalid pdf", "invalid object", "corrupt", "unexpected end"), "damaged-pdf"),
    ),
    "office": (
        (("cancel",), "cancelled"),
        (("memory", "allocation", "heap", "rangeerror: array buffer"), "memory"),
        (("zip", "central directory", "end of data", "corrupt", "can't find end", "invalid", "not a valid"), "damaged-file"),
    ),
    "document": (
        (("empty-file",), "empty-file"),
        (("input-too-large",), "input-too-large"),
        (("password", "encrypted"), "password-protected"),
        (("unsupported-text",), "unsupported-text"),
        (("invalid-crop",), "invalid-crop"),
        (("invalid-edit",), "invalid-edit"),
        (("output-too-large",), "output-too-large"),
        (("too-many-pages",), "too-many-pages"),
        (("empty-document",), "damaged-pdf"),
        (("memory", "allocation", "heap"), "memory"),
        (("invalid pdf", "invalid object", "corrupt", "xref"), "damaged-pdf"),
    ),
    "edit": (
        (("password", "encrypted"), "password-protected"),
        (("too-many-pages",), "too-many-pages"),
        (("invalid-page-range",), "invalid-page-range"),
        (("empty-document",), "empty-document"),
        (("output-too-large",), "output-too-large"),
        (("memory", "allocation", "array buffer", "heap out of memory"), "memory"),
        (("invalid pdf", "invalid object", "corrupt"), "damaged-pdf"),
    ),
    "render": (
        (("password", "encrypted"), "encrypted"),
        (("memory", "allocation", "heap"), "memory"),
        (("invalid pdf", "damaged", "xref", "trailer", "unexpected end", "formaterror"), "damaged-pdf"),
        (("worker", "fetch", "wasm", "loading"), "engine-unavailable"),
    ),
    "receipt": (
        (("password", "encrypted"), "encrypted"),
        (("network", "fetch", "worker", "wasm", "tesseract"), "engine-unavailable"),
        (("invalid pdf", "damaged", "xref", "trailer", "unexpected end"), "damaged-pdf"),
        (("memory", "allocation", "heap"), "memory"),
        (("too-many-pages",), "too-many-pages"),
    ),
    "image": (
        (("out of memory", "array buffer allocation failed", "memory access out of bounds", "memory.grow"), "memory"),
    ),
}

# Result when no rule matches; None keeps the message itself.
FALLBACK = {
    "pages": "processing-failed", "office": "processing-failed", "document": "processing-failed",
    "edit": "processing-failed", "render": None, "receipt": "extraction-failed", "image": "invalid-image",
}
# Messages that must match as a whole before the substring rules.
EXACT = {
    "image": {
        "image-too-large": "image-too-large", "too-many-pixels": "too-many-pixels",
        "unsupported-canvas": "processor-unavailable", "unsupported-enhancement": "processor-unavailable",
    }
}


def classify_error(message: Column | str, ruleset: str, strict: bool = False) -> Column:
    """Code for a failure message, as one CASE chain.

    With ``strict`` a message containing ``total-input-too-large`` is reported as
    ``input-too-large`` because the shorter rule comes first; by default the longer rule wins.
    """
    raw = F.col(message) if isinstance(message, str) else message
    low = F.lower(raw)
    rules = list(RULES[ruleset])
    if not strict:
        # A rule whose text contains an earlier rule's text is moved before it.
        longer = [r for r in rules if any(e is not r and e[0][0] in r[0][0] and rules.index(e) < rules.index(r) for e in rules if len(r[0]) == 1 and len(e[0]) == 1)]
        rules = longer + [r for r in rules if r not in longer]
    chain = None
    for exact, code in EXACT.get(ruleset, {}).items():
        hit = low == exact
        chain = F.when(hit, code) if chain is None else chain.when(hit, code)
    for texts, code in rules:
        hit = F.contains(low, F.lit(texts[0]))
        for t in texts[1:]:
            hit = hit | F.contains(low, F.lit(t))
        chain = F.when(hit, code) if chain is None else chain.when(hit, code)
    fallback = FALLBACK[ruleset]
    return chain.otherwise(raw if fallback is None else F.lit(fallback))

