"""File readers and writers: magic bytes, delimited text of unknown dialect, one output per name."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.js import extension, trim
from docframe.plans.scan import gathered
from docframe.plans.ship import ship
from docframe.plans.stage import stage

# Header bytes and stream names.
_ZIP = ("504B03", "504B05")
_OLE = "D0CF11E0"
_ENCRYPTED = ("EncryptedPackage", "EncryptionInfo")
OLE_HEAD = 65_536
PDF_HEAD = 1_024
SNIFF_CHARS = 5_000
HEADS_AT_ONCE = 16_777_216
FILES_AT_ONCE = 2_000
FOLDERS = 1_024
DELIMITERS = (",", ";", "\t", "|")

_C1 = "".join(map(chr, range(0x80, 0xA0)))
# Characters of windows-1252 in place of the Latin-1 control range; its five undefined bytes stand for themselves.
_CP1252 = "".join(bytes([ord(c)]).decode("cp1252", errors="ignore") or c for c in _C1)


def sniff_magic(name: Column, content: Column, kind: str) -> Column:
    """Code for office bytes that do not match the name (``encrypted``, ``legacy-format``,
    ``wrong-type``, ``damaged-file``) or null."""
    head = F.hex(F.substring(content, 1, 4))
    is_zip = F.substring(head, 1, 6).isin(*_ZIP)
    is_ole = head == _OLE
    # Two-byte characters start at even positions, i.e. after whole groups of four hex digits.
    wide = "|".join("".join(f"{b:02X}" for b in w.encode("utf-16-le")) for w in _ENCRYPTED)
    locked = F.hex(F.substring(content, 1, OLE_HEAD)).rlike(f"^(?:[0-9A-F]{{4}})*?(?:{wide})")
    office = F.when(is_ole, F.when(locked, "encrypted").otherwise("legacy-format")).when(~is_zip, "damaged-file")
    if kind != "excel":
        return office
    return F.when(extension(name) == ".csv", F.when(is_zip | is_ole, "wrong-type")).otherwise(office)


def has_pdf_header(content: Column) -> Column:
    """``%PDF-`` within the first 1,024 bytes."""
    return F.contains(F.substring(content, 1, PDF_HEAD), F.lit(bytearray(b"%PDF-")))


def read_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Binary files as ``path, length, modificationTime, content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path if isinstance(path, str) else list(path))


@lru_cache(maxsize=64)
def _store(scheme: str, authority: str) -> fs.FileSystem:
    if scheme == "file":
        return fs.LocalFileSystem()
    return fs.FileSystem.from_uri(f"{re.sub('^s3[an]$', 's3', scheme)}://{authority}/")[0]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path names, and the path inside it."""
    scheme, rest = path.split(":", 1)
    authority, inside = ("", rest) if not rest.startswith("//") else rest[2:].split("/", 1)
    local = "/" + inside.lstrip("/")
    return _store(scheme, authority), f"{authority}{local}" if scheme.startswith("s3") or scheme == "gs" else local


def _head(path: str, size: int) -> bytes:
    """The first bytes of a file, from the store that its path names."""
    store, at = _opened(path)
    with store.open_input_file(at) as source:
        return source.read(size)


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's readers understand it."""
    context = spark.sparkContext
    given = context._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(given).toString()


def _glob_pattern(glob: str) -> str:
    """A file name pattern of Spark's readers (``* ? [a-z] [^a] {a,b} \\``) as a regular expression."""
    plain, out, depth = re.compile(r"\\.|\[\^?\]?[^\]]*\]|.", re.S), [], 0
    for m in plain.finditer(glob):
        c = m[0]
        if c == "{" or c == "}" and depth:
            depth += 1 if c == "{" else -1
            out.append("(?:" if c == "{" else ")")
        elif len(c) > 1:
            out.append(re.escape(c[1:]) if c[0] == "\\" else c)
        else:
            out.append({"*": ".*", "?": "."}.get(c) or ("|" if c == "," and depth else re.escape(c)))
    return "".join(out)


def _dealt(rows: DataFrame, count: int) -> DataFrame:
    """Paths dealt to tasks of about ``FILES_AT_ONCE``; a few paths still go to all cores."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // FILES_AT_ONCE)), F.xxhash64("path"))


def list_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """``path, length`` of every file under ``path`` but hidden ones (``_`` or ``.`` first), listed in executors.

    Folders are listed level by level, each by one task; the driver learns two numbers per level, no names.
    """
    ship(spark)
    wanted = re.compile(_glob_pattern(glob) if glob else ".*", re.S)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column("path").to_pylist():
                store, at = _opened(top)
                info = store.get_file_info(at)
                if info.type == fs.FileType.NotFound:
                    raise FileNotFoundError(top)
                one = info.type == fs.FileType.File
                found = [info] if one else [i for i in store.get_file_info(fs.FileSelector(at)) if i.base_name[:1] not in "_."]
                found = [i for i in found if i.type == fs.FileType.Directory or wanted.fullmatch(i.base_name)]
                for k in range(0, len(found), FILES_AT_ONCE):
                    part = found[k : k + FILES_AT_ONCE]
                    paths = [top if one else f"{top.rstrip('/')}/{i.base_name}" for i in part]
                    folders = [i.type == fs.FileType.Directory for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(paths, pa.string()), pa.array([0 if d else i.size for i, d in zip(part, folders)], pa.int64()), pa.array(folders, pa.bool_())],
                        names=["path", "length", "folder"],
                    )

    tops = [path] if isinstance(path, str) else list(path)
    frontier, out = spark.createDataFrame([(_qualified(spark, p),) for p in tops], "path string"), None
    while True:
        level = stage(frontier.mapInArrow(entries, "path string, length long, folder boolean"), "listing")
        files, folders = level.agg(F.count_if(~F.col("folder")), F.count_if("folder")).first()
        here = _dealt(level.filter("NOT folder").select("path", "length"), files)
        out = here if out is None else out.unionByName(here) if files else out
        if not folders:
            return out
        frontier = _dealt(level.filter("folder").select("path"), folders)


def read_heads(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, head: int = OLE_HEAD) -> DataFrame:
    """The first ``head`` bytes of every file under ``path``: ``path, length, head``.

    Files are listed in executors (:func:`list_files`; a path with a pattern in it by Spark's reader) and dealt to tasks;
    each task opens its files and reads their heads only, so the bytes read do not depend on file sizes. Empty files give no row.
    """
    patterns = any(re.search(r"[*?\[{]", p) for p in ([path] if isinstance(path, str) else path))
    listed = (read_files if patterns else list_files)(spark, path, glob).select("path", "length").filter("length > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = max(1, HEADS_AT_ONCE // head)
        for batch in batches:
            for i in range(0, batch.num_rows, few):
                part = batch.slice(i, few)
                heads = [_head(p, head) for p in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.binary())], names=["path", "length", "head"])

    return listed.mapInArrow(read, "path string, length long, head binary")


def write_files(files: DataFrame, path: str, name: str = "name", content: str = "content") -> DataFrame:
    """Every row as a file of its own (null: empty), dealt by a hash of its name to ``FOLDERS`` folders: ``path, length`` as written.

    Names must be unique. Tasks write their files themselves under a hidden name and move them when they are whole, so a
    task may run twice, and no committer goes through all files once more.
    """
    spark = files.sparkSession
    ship(spark)
    folder = F.lpad(F.pmod(F.xxhash64(name), F.lit(FOLDERS)).cast("string"), 4, "0")
    placed = files.select(F.concat(F.lit(_qualified(spark, path).rstrip("/") + "/"), folder).alias("folder"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, mark = set(), uuid.uuid4().hex
        for batch in batches:
            folders, names = batch.column("folder").to_pylist(), batch.column("name").to_pylist()
            lengths = []
            for folder, name, content in zip(folders, names, batch.column("content")):
                store, at = _opened(folder)
                if at not in made:
                    store.create_dir(at, recursive=True)
                    made.add(at)
                data = content.as_py() or b""
                with store.open_output_stream(f"{at}/.{mark}", compression=None) as sink:
                    sink.write(data)
                store.move(f"{at}/.{mark}", f"{at}/{name}")
                lengths.append(len(data))
            paths = [f"{f}/{n}" for f, n in zip(folders, names)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

    return stage(placed.mapInArrow(write, "path string, length long"), "written")


def sniff_dialect(head: bytes, utf8: bool) -> tuple[str, str]:
    """``(encoding, delimiter)`` of a delimited file: its first bytes, and whether all of it is UTF-8."""
    if head[:2] == b"\xff\xfe":
        encoding, codec = "UTF-16LE", "utf-16-le"
    elif head[:2] == b"\xfe\xff":
        encoding, codec = "UTF-16BE", "utf-16-be"
    else:
        encoding, codec = ("UTF-8", "utf-8") if utf8 else ("windows-1252", "latin-1")
    # A cut multi-byte character at the end of the sample is left out.
    sample = head.decode(codec, errors="ignore").lstrip("\ufeff")[:SNIFF_CHARS]
    # max() keeps the first of equals, i.e. the listed order.
    return encoding, max(DELIMITERS, key=sample.count)


def _decoded(content: Column, encoding: Column) -> Column:
    """Bytes as text by the file's encoding, without a byte order mark."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), _C1, _CP1252)
    return F.when(encoding == "UTF-8", content.cast("string")).otherwise(latin)


def _decoded_wide(content: bytes, encoding: str) -> str:
    """UTF-16 bytes as text; a last line feed byte was taken for a line end and is put back."""
    data = bytes(content) + (b"\n" if len(content) % 2 else b"")
    return data.decode(encoding, errors="replace")


def line_steps(text: str, sep: str) -> Iterator[tuple[int, bool]]:
    """Places in a line, entered outside quotes, where a quoted part begins or ends, and lone returns that end a record."""
    at, quoted, fresh = 0, False, True
    for m in re.finditer(f'["\\r{re.escape(sep)}]', text):
        c, i = m[0], m.start()
        if i < at:
            continue
        if quoted:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    at = i + 2
                else:
                    quoted, fresh, at = False, False, i + 1
                    yield i, False
            continue
        fresh = fresh and i == at
        if c == '"':
            if fresh:
                quoted = True
                yield i, True
            at = i + 1
        else:
            fresh, at = True, i + 1


def _leaves_quoted(text: str, sep: str, quoted: bool) -> bool:
    """Whether the line ends inside a quoted field. A quote opens a field only at the field's start."""
    if '"' not in text:
        return quoted
    for _, quoted in line_steps('"' + text if quoted else text, sep):
        pass
    return quoted


def _cut_returns(text: str, sep: str) -> list[str]:
    """A whole record and its line end, cut at returns outside quotes."""
    if "\r" not in text:
        return [text]
    out, start, quoted, marks = [], 0, False, dict(line_steps(text, sep))
    for m in re.finditer('["\r]', text):
        quoted = marks.get(m.start(), quoted)
        if m[0] == "\r" and not quoted:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def physical_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, block, seq, line`` (bytes): files cut at line feeds, a large file read by many tasks."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("line"),
    )


def file_dialects(lines: DataFrame) -> DataFrame:
    """``path, encoding, sep`` of every file, found in executors from its first lines and from all of its bytes."""
    found = F.udf(lambda head, utf8: sniff_dialect(bytes(head), utf8), "encoding string, sep string")
    valid = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("utf8"))
    order = Window.partitionBy("path", "block").orderBy("seq")
    head = lines.filter("block = 0").select("path", "block", "seq", F.substring("line", 1, 4 * SNIFF_CHARS).alias("line"))
    head = head.withColumn("n", F.row_number().over(order)).withColumn("size", F.sum(F.length("line") + 1).over(order) - F.length("line"))
    head = head.filter(f"n <= {SNIFF_CHARS + 1} AND size <= {4 * SNIFF_CHARS}").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    joined = F.aggregate("l.line", F.lit(bytearray(b"")), lambda all_, x: F.concat(all_, F.when(F.length(all_) > 0, F.lit(bytearray(b"\n"))).otherwise(F.lit(bytearray(b""))), x))
    both = head.select("path", joined.alias("head")).join(valid, "path")
    return both.select("path", found("head", "utf8").alias("d")).select("path", "d.*")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of a batch by ``(path, block)``; a block may go on in the next batch."""
    for pdf in batches:
        for key, part in pdf.groupby(["path", "block"], sort=False):
            yield key, part


def csv_records(lines: DataFrame) -> DataFrame:
    """``path, block, no, sep, record``: records whose quoted fields may hold line breaks, in the order ``path, block, no``.

    ``lines``: ``path, block, seq, line, sep`` with decoded lines. Whether a line starts inside quotes depends on all
    lines before it, but a block of lines only maps two states (outside, inside) to two: blocks are reduced to
    such maps in parallel, the maps of a file are composed in order, and every block is then cut on its own.
    Only records that cross a block border are put together by a shuffle.
    """
    keys = ["path", "block"]
    ordered = gathered(lines, keys, ["seq"])

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ends = None, (False, True)
        for key, part in _blocks(batches):
            if key != current:
                if current is not None:
                    yield pd.DataFrame([(*current, *ends)], columns=["path", "block", "outside", "inside"])
                current, ends = key, (False, True)
            for text, sep in zip(part["line"], part["sep"]):
                if '"' in text:
                    ends = tuple(_leaves_quoted(text, sep, e) for e in ends)
        if current is not None:
            yield pd.DataFrame([(*current, *ends)], columns=["path", "block", "outside", "inside"])

    maps = ordered.mapInPandas(reduced, "path string, block long, outside boolean, inside boolean")
    steps = F.array_sort(F.collect_list(F.struct("block", "outside", "inside")).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    enters = maps.select(*keys, F.aggregate(steps, F.lit(False), lambda state, b: F.when(state, b["inside"]).otherwise(b["outside"])).alias("enters"))
    met = gathered(lines.join(enters, keys), keys, ["seq"])
    schema = "path string, block long, no long, sep string, record string, opens boolean, closes boolean"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, quoted, no, sep, held, opens = None, False, 0, ",", [], True

        def close(closes: bool) -> list[tuple]:
            nonlocal no, held, opens
            text, whole, held = "\n".join(held), opens and closes, []
            rows = [(*current, no + k, sep, t, opens, closes) for k, t in enumerate(_cut_returns(text, sep) if whole else [text])]
            no, opens = no + len(rows), True
            return rows

        for key, part in _blocks(batches):
            out: list[tuple] = []
            if key != current:
                if held:
                    out += close(False)
                current, quoted, no, held = key, bool(part["enters"].iat[0]), 0, []
                opens = not quoted
            for text, sep in zip(part["line"], part["sep"]):  # noqa: B007
                held.append(text)
                quoted = _leaves_quoted(text, sep, quoted)
                if not quoted:
                    out += close(True)
            yield pd.DataFrame(out, columns=["path", "block", "no", "sep", "record", "opens", "closes"])
        if held:
            yield pd.DataFrame(close(False), columns=["path", "block", "no", "sep", "record", "opens", "closes"])

    pieces = stage(met.mapInPandas(cut, schema), "records")
    whole = pieces.filter("opens AND closes").select("path", "block", "no", "sep", "record")
    # Pieces of records across borders: what goes on belongs to the latest block that opened a record.
    torn = pieces.filter("NOT (opens AND closes)")
    since = Window.partitionBy("path").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, 0)
    torn = torn.withColumn("of", F.last(F.when(F.col("opens"), F.struct("block", "no")), ignorenulls=True).over(since))
    parts = F.array_sort(F.collect_list(F.struct("block", "no", "record")))
    mended = torn.groupBy("path", F.col("of.block").alias("block"), F.col("of.no").alias("no"), "sep").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"))
    cuts = F.udf(_cut_returns, "array<string>")
    mended = mended.select("path", "block", "no", "sep", F.explode(cuts("record", "sep")).alias("record"))
    return whole.unionByName(mended)


def read_delimited_auto(spark: SparkSession, paths: Sequence[str], header: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Delimited text whose delimiter and encoding are found per file (``paths``: files or directories).

    Files are read in byte blocks by many tasks, also one file with quoted line breaks (:func:`csv_records`); no
    name or dialect of a file reaches the driver. Quoted fields may hold the delimiter, doubled quotes and line
    breaks; a line break is a line feed, a return, or both. Blank lines are dropped. Files that are not UTF-8 as a
    whole are read as windows-1252. Only a UTF-16 file is taken as one value, and must be below 2 GB.
    Without ``columns`` the names come from the first record of each delimiter (``header``) or are ``_c0, _c1, ...``.
    """
    ship(spark)
    lines = stage(physical_lines(spark, paths), "lines")
    found = stage(file_dialects(lines), "dialects")
    met = lines.join(found, "path")
    narrow = met.filter("encoding NOT LIKE 'UTF-16%'").select("path", "block", "seq", _decoded(F.col("line"), F.col("encoding")).alias("line"), "sep")
    # A line feed byte is no line end in UTF-16, so such files are put together again before they are decoded.
    wide = met.filter("encoding LIKE 'UTF-16%'").groupBy("path", "encoding", "sep").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "line"))).alias("l"))
    glue = F.aggregate(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))), F.get("l", F.lit(0))["line"], lambda a, x: F.concat(a, F.lit(bytearray(b"\n")), x["line"]))
    wide = wide.select("path", F.lit(0).cast("long").alias("block"), F.posexplode(F.split(F.udf(_decoded_wide, "string")(glue, F.col("encoding")), "\n")).alias("seq", "line"), "sep")
    records = csv_records(narrow.unionByName(wide.select("path", "block", F.col("seq").cast("long").alias("seq"), "line", "sep")))
    records = records.withColumn("record", F.regexp_replace("record", "^\ufeff", "")).filter("record <> ''")
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    place = F.struct("path", "block", "no")
    firsts = {r["sep"]: r["record"] for r in records.groupBy("sep").agg(F.min_by("record", place).alias("record")).collect()}  # one row per delimiter
    out = None
    for sep, first in sorted(firsts.items()):
        here = {**options, "sep": sep}
        names = list(columns) if columns is not None else None
        if names is None:
            shape = spark.range(1).select(F.schema_of_csv(F.lit(first), {**here, "inferSchema": "false"}).alias("s")).first()["s"]
            width = len(T._parse_datatype_string(shape).fields)
            flat = ", ".join(f"_c{k} string" for k in range(width))
            names = [f"_c{k}" for k in range(width)]
            if header:
                names = list(spark.range(1).select(F.from_csv(F.lit(first), flat, here).alias("r")).first()["r"])
        part = records.filter(F.col("sep") == sep)
        if header:
            heads = part.groupBy("path").agg(F.min(place).alias("head"))
            part = part.join(heads, "path").filter(place != F.col("head"))
        fields = ", ".join(f"`{c}` string" for c in names)
        part = part.select(F.from_csv("record", fields, here).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (columns or ["_c0"])))
    return out


def safe_base_name(name: Column, suffix: str = "") -> Column:
    """File name without ``.pdf``, path characters replaced, blank = ``document``; plus suffix."""
    base = trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r'[\\/:*?"<>|]', "_"))
    base = F.when(base == "", F.lit("document")).otherwise(base)
    return F.concat(base, F.lit(f"-{suffix}.pdf")) if suffix else base


def output_name(name: Column) -> Column:
    """Name of a converted file: extension replaced by ``.pdf``, blank = ``document.pdf``."""
    base = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.concat(F.when(base == "", F.lit("document")).otherwise(base), F.lit(".pdf"))


def write_outputs(df: DataFrame, path: str, name_col: str = "output_name", fmt: str = "parquet") -> None:
    """One folder per output name. Rows are written where they are, so a large output is many files."""
    df.write.partitionBy(name_col).format(fmt).save(path)


def reviewed_json(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The given fields and ``reviewed: true`` as one JSON text per row (``json``)."""
    return df.withColumn("json", F.to_json(F.struct(*fields, F.lit(True).alias("reviewed"))))
