"""Admission of file batches: name checks, fail-fast verdicts and greedy selection.

Files are ``batch, ord, name, size`` (and ``pages`` or ``width, height`` where needed).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.js import extension
from docframe.plans.packing import whole_groups
from docframe.plans.scan import BUCKET_ROWS, attach, bucket_of
from docframe.plans.stage import stage

MIB = 1024 * 1024

# File name extensions per document kind (current, older).
EXTENSIONS = {
    "word": ([".docx", ".docm", ".dotx", ".dotm"], [".doc", ".dot", ".rtf", ".odt"]),
    "excel": ([".xlsx", ".xlsm", ".xltx", ".xltm", ".csv"], [".xls", ".xlsb", ".ods"]),
    "powerpoint": ([".pptx", ".pptm", ".ppsx", ".ppsm", ".potx", ".potm"], [".ppt", ".pps", ".pot", ".odp"]),
}
OFFICE_BYTES = 50 * MIB


@dataclass(frozen=True)
class Caps:
    """Limits of one batch; the defaults are the reference limits."""

    min_files: int = 2
    max_files: int = 20
    total_bytes: int = 200 * MIB
    file_bytes: int = 200 * MIB
    total_pages: int = 2_000


@dataclass(frozen=True)
class ImageCaps:
    """Limits of one image batch; the defaults are the reference limits."""

    max_files: int = 100
    total_bytes: int = 200 * MIB
    image_pixels: int = 40_000_000
    total_pixels: int = 120_000_000
    side: int = 16_000


def check_manifest(name: Column | str, size: Column | str, kind: str, max_bytes: int = OFFICE_BYTES) -> Column:
    """First failing name or size rule of an office file, or null."""
    size = F.col(size) if isinstance(size, str) else size
    current, older = EXTENSIONS[kind]
    ext = extension(name)
    return (
        F.when(ext.isin(older), "legacy-format")
        .when(~ext.isin(current), "wrong-type")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty-file")
        .when(size > max_bytes, "input-too-large")
    )


def is_pdf(name: Column | str, mime: Column | None = None) -> Column:
    """Accepted as PDF by type or by name."""
    by_name = F.endswith(F.lower(name), F.lit(".pdf"))
    return by_name if mime is None else (mime == "application/pdf") | by_name


def _bounded(files: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Batch counts, and the files of batches with ``low..high`` files (so at most ``high`` each)."""
    counts = files.groupBy("batch").agg(F.count(F.lit(1)).alias("n_files"))
    fits = counts.filter(F.col("n_files").between(low, high)).select("batch")
    return counts, attach(files, fits, ["batch"], bucket_of("ord"), "inner")


def admit_batch(files: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Accept or reject whole batches: ``batch, n_files, error, at_ord``.

    Rules in order: file count, then per file type, emptiness and running size, then running
    pages. Only batches with an allowed file count are scanned, so a window holds at most
    ``max_files`` rows; larger batches are decided by their count alone.
    """
    counts, small = _bounded(files, caps.min_files, caps.max_files)
    upto = Window.partitionBy("batch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    code = (
        F.when(~is_pdf("name"), "wrong-type")
        .when(F.col("size") == 0, "empty-file")
        .when(F.sum("size").over(upto) > caps.total_bytes, "total-input-too-large")
    )
    pages = F.when(F.sum("pages").over(upto) > caps.total_pages, "too-many-pages")
    first = small.select("batch", "ord", code.alias("code"), pages.alias("pages")).groupBy("batch").agg(
        F.min(F.when(F.col("code").isNotNull(), F.struct("ord", F.col("code").alias("c")))).alias("a"),
        F.min(F.when(F.col("pages").isNotNull(), F.struct("ord", F.col("pages").alias("c")))).alias("b"),
    )
    hit = F.coalesce("a", "b")
    return counts.join(first, "batch", "left").select(
        "batch",
        "n_files",
        F.when(F.col("n_files") < caps.min_files, "not-enough-files")
        .when(F.col("n_files") > caps.max_files, "too-many-files")
        .otherwise(hit["c"])
        .alias("error"),
        hit["ord"].alias("at_ord"),
    )


def admit_images(files: DataFrame, caps: ImageCaps = ImageCaps()) -> DataFrame:
    """Verdict per image batch: ``batch, n_files, error, at_ord``.

    File count, then empty files and total size of the batch, then the first image over a side,
    pixel or running pixel limit.
    """
    counts, small = _bounded(files, 1, caps.max_files)
    upto = Window.partitionBy("batch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    pixels = F.col("width") * F.col("height")
    side = (F.least("width", "height") <= 0) | (F.greatest("width", "height") > caps.side)
    code = F.when(side | (pixels > caps.image_pixels), "image-too-large").when(
        F.sum(pixels).over(upto) > caps.total_pixels, "too-many-pixels"
    )
    first = small.select("batch", "ord", "size", code.alias("code")).groupBy("batch").agg(
        (F.bool_or(F.col("size") == 0) | (F.sum("size") > caps.total_bytes)).alias("sizes"),
        F.min(F.when(F.col("code").isNotNull(), F.struct("ord", F.col("code").alias("c")))).alias("a"),
    )
    counted = counts.join(first, "batch", "left")
    error = (
        F.when(F.col("n_files") > caps.max_files, "invalid-file-count").when(F.col("sizes"), "invalid-file-size").otherwise(F.col("a.c"))
    )
    return counted.select(
        "batch", "n_files", error.alias("error"), F.when(error == F.col("a.c"), F.col("a.ord")).alias("at_ord")
    )


def admit_greedy(files: DataFrame, caps: Caps = Caps(), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Skip unusable files and keep going: adds ``status``.

    ``accepted``, ``wrong-type``, ``empty-file``, ``input-too-large`` (single file),
    ``total-input-too-large`` (no room left, costs nothing), ``too-many-files`` (first usable file
    after the count cap) and ``not-considered`` after that.

    A file can only be taken if fewer than ``max_files`` earlier usable files are as small: with
    room for it there was room for each of those. Buckets of growing width keep just such files,
    as a rule a short list however large the batch is (all of them only where sizes keep falling). That list
    streams through one task per batch, which remembers the files taken and nothing else. No cap on files
    is involved: every file that could be taken is kept.
    """
    code = (
        F.when(~is_pdf("name"), "wrong-type")
        .when(F.col("size") == 0, "empty-file")
        .when(F.col("size") > caps.file_bytes, "input-too-large")
    )
    coded = files.withColumn("__code", code)
    small = coded.filter("__code IS NULL").select("batch", "ord", "size")
    fields = [small.schema[c] for c in ("batch", "ord", "size")]
    most = caps.max_files

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in whole_groups(batches, ["batch", "b"]):
            sizes, keep = pdf["size"].tolist(), [False] * len(pdf)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                smallest: list[int] = []  # negated sizes of the `most` smallest files so far
                for k in range(i, j):
                    s = sizes[k]
                    if len(smallest) < most:
                        heapq.heappush(smallest, -s)
                        keep[k] = True
                    elif s < -smallest[0]:
                        heapq.heapreplace(smallest, -s)
                        keep[k] = True
            yield pdf.loc[keep, ["batch", "ord", "size"]]

    rest = small
    for scale in (1, 256, 65_536):
        rest = (
            rest.withColumn("b", bucket_of("ord", bucket_rows * scale))
            .repartition("batch", "b")
            .sortWithinPartitions("batch", "b", "ord")
            .mapInPandas(thin, T.StructType(fields))
        )

    out = T.StructType(
        [fields[0], T.StructField("took", T.ArrayType(T.StructType([fields[1], fields[2]])))]
    )

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per batch; files stream through, only what was taken is remembered."""
        current, used, chosen = None, 0, []
        for pdf in batches:
            done = []
            for batch, ord_, size in zip(pdf["batch"].tolist(), pdf["ord"].tolist(), pdf["size"].tolist()):
                if batch != current:
                    if current is not None:
                        done.append((current, chosen))
                    current, used, chosen = batch, 0, []
                if len(chosen) < most and used + size <= caps.total_bytes:
                    used += size
                    chosen.append({"ord": ord_, "size": size})
            yield pd.DataFrame(done, columns=["batch", "took"])
        if current is not None:
            yield pd.DataFrame([(current, chosen)], columns=["batch", "took"])

    # At most `max_files` entries per batch; kept because three steps below read them.
    chosen = stage(rest.repartition("batch").sortWithinPartitions("batch", "ord").mapInPandas(take, out), "chosen")
    placed = attach(coded, chosen, ["batch"], bucket_of("ord", bucket_rows), buckets_from=files)
    full_at = F.when(F.size("took") >= most, F.array_max(F.transform("took", lambda t: t["ord"])))
    usable_after = F.col("__code").isNull() & (F.col("ord") > F.col("__full"))
    stops = (
        placed.withColumn("__full", full_at).filter(usable_after).groupBy("batch").agg(F.min("ord").alias("__stop"))
    )
    marked = attach(placed, stops, ["batch"], bucket_of("ord", bucket_rows), buckets_from=files)
    mine = F.exists(F.coalesce("took", F.array().cast(out["took"].dataType)), lambda t: t["ord"] == F.col("ord"))
    status = (
        F.when(F.col("ord") > F.col("__stop"), "not-considered")
        .when(F.col("ord") == F.col("__stop"), "too-many-files")
        .when(F.col("__code").isNotNull(), F.col("__code"))
        .when(mine, "accepted")
        .otherwise("total-input-too-large")
    )
    return marked.select(*files.columns, status.alias("status"))


def smaller_of(original: DataFrame, rewritten: DataFrame, key: str, payload: str) -> DataFrame:
    """Keep the rewritten payload only if it is smaller in bytes: ``key, payload, kept``."""
    new = rewritten.select(key, F.col(payload).alias("__new"))
    shrunk = F.octet_length("__new") < F.octet_length(payload)
    return original.join(new, key, "left").select(
        key,
        F.when(shrunk, F.col("__new")).otherwise(F.col(payload)).alias(payload),
        F.when(shrunk, F.lit("rewritten")).otherwise(F.lit("original")).alias("kept"),
    )
