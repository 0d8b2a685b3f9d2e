"""Source, sink and block-packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.operators.blocks import blocks_sql, pack_blocks
from docframe.operators.text import extract_receipt
from docframe.plans.registry import query
from docframe.plans.stage import fresh_path
from docframe.sources import files as S
from docframe.sources.fixtures import Fixtures


def _payloads(f: Fixtures):
    """Documents behind six kinds of header bytes."""

    def raw(hexed: str):
        return F.unhex(F.lit(hexed))

    body = F.encode("text", "UTF-8")
    content = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(raw("504B0304"), body))
        .when(F.col("doc_id") % 6 == 1, F.concat(raw("D0CF11E0"), body))
        .when(F.col("doc_id") % 6 == 2, F.concat(raw("D0CF11E0"), F.encode(F.lit("EncryptedPackage"), "UTF-16LE"), body))
        .when(F.col("doc_id") % 6 == 3, F.concat(raw("D0CF11E000"), F.encode(F.lit("EncryptionInfo"), "UTF-16LE"), body))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.encode(F.repeat(F.lit(" "), (F.col("doc_id") % 1200).cast("int")), "UTF-8"), F.encode(F.lit("%PDF-1.7"), "UTF-8"), body))
        .otherwise(body)
    )
    name = F.concat(F.lit("f"), F.when(F.col("doc_id") % 5 == 0, F.lit(".CSV")).otherwise(F.lit(".xlsx")))
    return f.t("documents").select("doc_id", name.alias("name"), content.alias("content"))


@query(
    "sniff_magic",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 6 < 4 THEN 'wrong-type' END
                WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 2 THEN 'encrypted' WHEN doc_id % 6 IN (1, 3) THEN 'legacy-format' ELSE 'damaged-file' END AS excel,
              doc_id % 6 = 4 AND doc_id % 1200 <= 1019 AS pdf FROM documents""",
)
def _sniff(f: Fixtures):
    p = _payloads(f)
    return p.select(
        "doc_id", S.sniff_magic(F.col("name"), F.col("content"), "excel").alias("excel"), S.has_pdf_header(F.col("content")).alias("pdf")
    )


@query(
    "sniff_files",
    """SELECT doc_id, least(65536, strlen(text) + 1 + CASE doc_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 36 WHEN 3 THEN 33 WHEN 4 THEN doc_id % 1200 + 8 ELSE 0 END) AS n_head,
              CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 6 < 4 THEN 'wrong-type' END
                WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 2 THEN 'encrypted' WHEN doc_id % 6 IN (1, 3) THEN 'legacy-format' ELSE 'damaged-file' END AS excel,
              doc_id % 6 = 4 AND doc_id % 1200 <= 1019 AS pdf FROM documents""",
)
def _sniff_files(f: Fixtures):
    """Every document written as a file of its own; only the heads of the files are read back."""
    out = fresh_path(f.spark, "files")
    named = F.concat(F.lit("doc-"), F.col("doc_id"), F.regexp_extract("name", r"\.\w+$", 0))
    line = F.concat(F.coalesce("content", F.lit(bytearray(b""))), F.lit(bytearray(b"\n")))
    S.write_files(_payloads(f).select(named.alias("name"), line.alias("content")), out)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return S.read_heads(f.spark, out).select(
        F.regexp_extract(name, "[0-9]+", 0).cast("long").alias("doc_id"), F.octet_length("head").cast("long").alias("n_head"),
        S.sniff_magic(name, F.col("head"), "excel").alias("excel"), S.has_pdf_header(F.col("head")).alias("pdf"),
    )


@query(
    "read_delimited_auto",
    """SELECT c_custkey, concat(c_name, '; "', c_mktsegment, '"') AS label, c_acctbal FROM customer WHERE c_custkey % 2 = 0
       UNION ALL SELECT c_custkey, concat(c_name, ', ', chr(10), c_mktsegment), c_acctbal FROM customer WHERE c_custkey % 2 = 1""",
)
def _delimited(f: Fixtures):
    """Customers written in two dialects and read back."""
    c = f.t("customer")
    one, two = fresh_path(f.spark, "semicolon"), fresh_path(f.spark, "tab")
    even = c.filter("c_custkey % 2 = 0").selectExpr("c_custkey", "concat(c_name, '; \"', c_mktsegment, '\"') AS label", "c_acctbal")
    odd = c.filter("c_custkey % 2 = 1").selectExpr("c_custkey", "concat(c_name, ', \\n', c_mktsegment) AS label", "c_acctbal")
    even.write.option("sep", ";").option("quoteAll", True).option("escape", '"').csv(one)
    odd.write.option("sep", "\t").option("quoteAll", True).option("escape", '"').csv(two)
    back = S.read_delimited_auto(f.spark, [one, two], columns=["c_custkey", "label", "c_acctbal"])
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "label", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query(
    "write_outputs",
    """SELECT concat(source, '-split.pdf') AS output_name, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1""",
)
def _outputs(f: Fixtures):
    out = fresh_path(f.spark, "outputs")
    docs = f.t("documents").select(S.safe_base_name(F.concat("source", F.lit(".PDF")), "split").alias("output_name"), "doc_id", "n_chars")
    S.write_outputs(docs, out)
    return f.spark.read.parquet(out).groupBy("output_name").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query(
    "output_names",
    """SELECT doc_id, concat('a_b_', source, '-ocr.pdf') AS safe, concat('a:b/', source, '.pdf') AS converted FROM documents""",
)
def _names(f: Fixtures):
    name = F.concat(F.lit("a:b/"), F.col("source"))
    return f.t("documents").select(
        "doc_id", S.safe_base_name(F.concat(name, F.lit(".Pdf")), "ocr").alias("safe"), S.output_name(F.concat(name, F.lit(".docx"))).alias("converted")
    )


@query(
    "reviewed_json",
    """SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '{"total":"","reviewed":true}'
         ELSE concat('{"total":"$', regexp_extract(text, 'TOTAL  \\$([0-9.,]+)', 1), '","reviewed":true}') END AS json FROM receipts""".replace("\\\\", "\\"),
)
def _reviewed(f: Fixtures):
    got = f.receipts().select("doc_id", extract_receipt("text").alias("r")).select("doc_id", "r.total")
    return S.reviewed_json(got, ["total"]).select("doc_id", "json")


_BLOCKS_SQL = """SELECT doc_id, 0 AS section, line_no AS ord,
  CASE WHEN line_no % 9 IN (1, 2) THEN 'heading' WHEN line_no % 9 = 5 THEN 'table' WHEN line_no % 9 = 7 THEN 'other' ELSE 'para' END AS kind,
  1 + length(text) // 60 AS units, 12.0::DOUBLE * CASE WHEN line_no % 9 = 5 THEN 1 + line_no % 4 ELSE 1 END AS unit_height,
  line_no % 3 AS header_rows, CASE WHEN line_no % 9 = 5 THEN 1 + line_no % 4 ELSE 1 END AS row_lines, line_no % 2 = 0 AS cant_split FROM lines"""


@query("pack_blocks", blocks_sql(_BLOCKS_SQL, 240.0))
def _pack_blocks(f: Fixtures):
    """Every document is one section; small buckets, so that long documents are chained."""
    blocks = f.lines().selectExpr(
        "doc_id", "0 AS section", "CAST(line_no AS BIGINT) AS ord",
        "CASE WHEN line_no % 9 IN (1, 2) THEN 'heading' WHEN line_no % 9 = 5 THEN 'table' WHEN line_no % 9 = 7 THEN 'other' ELSE 'para' END AS kind",
        "CAST(1 + floor(length(text) / 60) AS BIGINT) AS units", "12.0D * CASE WHEN line_no % 9 = 5 THEN 1 + line_no % 4 ELSE 1 END AS unit_height",
        "CAST(line_no % 3 AS BIGINT) AS header_rows", "CAST(CASE WHEN line_no % 9 = 5 THEN 1 + line_no % 4 ELSE 1 END AS BIGINT) AS row_lines",
        "line_no % 2 = 0 AS cant_split",
    )
    return pack_blocks(blocks, 240.0, bucket_blocks=32)
