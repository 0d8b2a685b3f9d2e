"""Document, grid, chart and event tables derived from the star-schema test tables.

Every derivation is deterministic and reads whole tables. ``VIEWS`` holds the same derivations
as SQL for the side-by-side check; ``with_views`` prefixes a query with the ones it needs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.plans.scan import bucket_of, ordered_scan, time_bucket
from docframe.plans.stage import stage

LINES_PER_PAGE = 5


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fixtures:
    """Lazy access to the input tables and the derived ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._ranked: DataFrame | None = None
        self._points: DataFrame | None = None

    def t(self, name: str) -> DataFrame:
        return load(self.spark, self.dir, name)

    # -- files ---------------------------------------------------------------------------------

    def files(self) -> DataFrame:
        return self.t("documents").selectExpr(
            "CAST(floor(sqrt(doc_id)) AS BIGINT) AS batch",
            "doc_id AS ord",
            "concat(source, '_', CAST(doc_id AS STRING), CASE doc_id % 7 WHEN 0 THEN '.docx' WHEN 1 THEN '.DOCX'"
            " WHEN 2 THEN '.doc' WHEN 3 THEN '.xlsx' WHEN 4 THEN '' WHEN 5 THEN '.csv' ELSE '.pptx' END) AS name",
            "CASE WHEN doc_id % 31 = 0 THEN CAST(0 AS BIGINT) ELSE n_chars END AS size",
        )

    def pdf_files(self) -> DataFrame:
        return self.t("documents").selectExpr(
            "CAST(floor(sqrt(doc_id)) AS BIGINT) AS batch",
            "doc_id AS ord",
            "concat(source, '_', CAST(doc_id AS STRING), CASE WHEN doc_id % 97 = 3 THEN '.txt'"
            " WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END) AS name",
            "CASE WHEN doc_id % 131 = 5 THEN CAST(0 AS BIGINT) ELSE n_chars END AS size",
            "CAST(1 + floor(n_chars / 1500) AS BIGINT) AS pages",
            "CAST(200 + n_chars % 3000 AS BIGINT) AS width",
            "CAST(300 + doc_id % 1000 AS BIGINT) AS height",
        )

    # -- documents -----------------------------------------------------------------------------

    def _paged(self) -> DataFrame:
        n = LINES_PER_PAGE
        return (
            self.t("documents")
            .select("doc_id", F.split("text", "\n").alias("lines"))
            .withColumn("page_count", F.ceil(F.size("lines") / F.lit(n)).cast("int"))
            .select(
                "doc_id",
                "page_count",
                F.transform(
                    F.sequence(F.lit(1), F.col("page_count")),
                    lambda k: F.struct(
                        k.alias("page_no"),
                        F.array_join(F.slice("lines", (k - 1) * n + 1, F.lit(n)), "\n").alias("text"),
                    ),
                ).alias("pages"),
            )
        )

    @staticmethod
    def _with_box(df: DataFrame) -> DataFrame:
        even = F.col("doc_id") % 2 == 0
        return df.select(
            "doc_id",
            "page_no",
            (F.lit(90) * (F.col("page_no") % 4)).cast("int").alias("rotation"),
            "text",
            F.when(even, F.lit(595.28)).otherwise(F.lit(612.0)).alias("width"),
            F.when(even, F.lit(841.89)).otherwise(F.lit(792.0)).alias("height"),
        )

    def lines(self) -> DataFrame:
        return (
            self.t("documents")
            .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
            .select("doc_id", (F.col("pos") + 1).alias("line_no"), "text")
        )

    def doc_pages(self) -> DataFrame:
        return self._with_box(self._paged().select("doc_id", F.inline("pages")))

    def doc_pages_rev(self) -> DataFrame:
        doc = F.col("doc_id")
        edited = F.filter(
            "pages", lambda p: ~((doc % 5 == 0) & (p["page_no"] == F.col("page_count")))
        )
        edited = F.transform(
            edited,
            lambda p: F.struct(
                p["page_no"].alias("page_no"),
                F.when(doc % 3 == 0, F.concat(F.lit("rev "), p["text"]))
                .when(doc % 11 == 0, F.replace(p["text"], F.lit(" "), F.lit("  ")))
                .otherwise(p["text"])
                .alias("text"),
            ),
        )
        extra = F.when(
            (doc % 7 == 0) & (doc % 5 != 0),
            F.array(
                F.struct(
                    (F.col("page_count") + 1).alias("page_no"),
                    F.concat(F.lit("appendix "), doc.cast("string")).alias("text"),
                )
            ),
        )
        pages = F.when(extra.isNull(), edited).otherwise(F.concat(edited, extra))
        return self._with_box(self._paged().select("doc_id", F.inline(pages)))

    def page_counts(self) -> DataFrame:
        return self._paged().select("doc_id", F.col("page_count").cast("long").alias("page_count"))

    def selections(self) -> DataFrame:
        return self.t("documents").selectExpr(
            "doc_id",
            "CASE doc_id % 8 WHEN 0 THEN '1' WHEN 1 THEN '1-2' WHEN 2 THEN '2, 1' WHEN 3 THEN '1,,2'"
            " WHEN 4 THEN '3-1' WHEN 5 THEN '1-999' WHEN 6 THEN '1-2,2' ELSE '' END AS sel",
        )

    def page_order(self) -> DataFrame:
        pages = self._paged().select("doc_id", "page_count", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("k"))
        return pages.selectExpr(
            "doc_id",
            "CAST(page_count - k + 1 AS BIGINT) AS pos",
            "CAST(CASE WHEN doc_id % 13 = 0 AND k = 1 THEN page_count ELSE k END AS BIGINT) AS page_no",
            "CASE WHEN doc_id % 29 = 0 THEN 45 ELSE 90 * (k % 4) END AS rotation",
        )

    def stamps(self) -> DataFrame:
        return self.t("documents").selectExpr(
            "doc_id",
            "CASE WHEN doc_id % 9 = 0 THEN CAST(0 AS BIGINT) ELSE 1 + doc_id % 3 END AS start_page",
            "CASE WHEN doc_id % 4 = 0 THEN CAST(0 AS BIGINT) ELSE 2 + doc_id % 3 END AS end_page",
            "concat('stamp ', CAST(doc_id AS STRING)) AS label",
        )

    def markups(self) -> DataFrame:
        return self.doc_pages().selectExpr(
            "doc_id",
            "doc_id * 1000 + page_no AS item_id",
            "CASE WHEN doc_id % 23 = 0 THEN page_no + 1000 ELSE page_no END AS page_no",
            "CASE (doc_id + page_no) % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'note' ELSE 'rectangle' END AS kind",
            "CAST(10 * page_no AS DOUBLE) AS x",
            "CAST(20 AS DOUBLE) AS y",
            "CAST(100 AS DOUBLE) AS w",
            "CAST(40 AS DOUBLE) AS h",
            "CAST(CASE WHEN doc_id % 9 = 0 THEN 100 ELSE 12 END AS DOUBLE) AS font_size",
            "CASE WHEN doc_id % 19 = 0 THEN '   ' ELSE concat('  note ', CAST(page_no AS STRING)) END AS text",
            "CASE WHEN doc_id % 17 = 0 THEN 'red' ELSE '#12aBcF' END AS color",
        )

    def vec_pairs(self) -> DataFrame:
        e = self.t("embeddings")

        def ints(c: str) -> Column:
            return F.transform(c, lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("int"))

        a = e.select("vec_id", ints("embedding").alias("a"))
        b = e.select((F.col("vec_id") - 1).alias("vec_id"), ints("embedding").alias("b"))
        return a.join(b, "vec_id")

    def receipts(self) -> DataFrame:
        o = self.t("orders").selectExpr(
            "o_orderkey AS doc_id",
            "o_custkey",
            "CAST(round(o_totalprice * 100) AS BIGINT) AS cents",
            "CAST(year(o_orderdate) AS STRING) AS y",
            "month(o_orderdate) AS m",
            "day(o_orderdate) AS d",
        )
        c = self.t("customer").selectExpr("c_custkey AS o_custkey", "c_name")
        money = "concat(CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING), '.', lpad(CAST(cents % 100 AS STRING), 2, '0'))"
        grouped = (
            "CASE WHEN cents >= 100000 THEN concat(CAST(CAST(floor(cents / 100000) AS BIGINT) AS STRING), ',',"
            " lpad(CAST(CAST(floor(cents / 100) AS BIGINT) % 1000 AS STRING), 3, '0'), '.',"
            f" lpad(CAST(cents % 100 AS STRING), 2, '0')) ELSE {money} END"
        )
        date = (
            "CASE doc_id % 3 WHEN 0 THEN concat(y, '-', lpad(CAST(m AS STRING), 2, '0'), '-', lpad(CAST(d AS STRING), 2, '0'))"
            " WHEN 1 THEN concat(CAST(d AS STRING), '/', CAST(m AS STRING), '/', y)"
            " ELSE concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', (m - 1) * 3 + 1, 3), ' ', CAST(d AS STRING), ', ', y) END"
        )
        return o.join(c, "o_custkey").selectExpr(
            "doc_id",
            "CASE WHEN doc_id % 8 = 0 THEN concat('12345\\n', 'INVOICE', '\\n', '----')"
            f" ELSE concat('Receipt\\n', c_name, '\\nissued on  ', {date}, '\\nSubtotal: $', {money},"
            f" '\\nTax 1.00\\nTOTAL  $', {grouped}, '\\n\\nthank you') END AS text",
            "concat('scan ', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '' END) AS file_name",
        )

    def boxes(self) -> DataFrame:
        pages = self.doc_pages().select("doc_id", "page_no")
        return pages.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(
            "doc_id",
            "page_no",
            "CASE WHEN k = 0 THEN 0.1 + (doc_id % 10) * 0.05 ELSE 0.9 END AS x1",
            "CASE WHEN k = 0 THEN -0.2 ELSE 0.5 + (page_no % 4) * 0.1 END AS y1",
            "CASE WHEN k = 0 THEN 0.4 + (doc_id % 10) * 0.05"
            " ELSE CASE WHEN doc_id % 6 = 0 THEN 0.899 ELSE 0.6 END END AS x2",
            "CASE WHEN k = 0 THEN 0.25 ELSE 0.45 END AS y2",
        ).selectExpr(
            "doc_id", "page_no", "CAST(x1 AS DOUBLE) AS x1", "CAST(y1 AS DOUBLE) AS y1",
            "CAST(x2 AS DOUBLE) AS x2", "CAST(y2 AS DOUBLE) AS y2",
        )

    def failures(self) -> DataFrame:
        return self.t("events").filter("event_type = 'error'").selectExpr("event_id", f"{FAILURE_CASE} AS message")

    def catalog(self) -> DataFrame:
        return self.t("part").selectExpr(
            "p_brand AS grp", "p_partkey AS ord", "p_name AS title", "p_type AS description",
            "concat('size ', CAST(p_size AS STRING)) AS keywords",
        )

    # -- sheets --------------------------------------------------------------------------------

    def sheet_rows(self) -> DataFrame:
        if self._ranked is not None:
            return self._ranked
        li = self.t("lineitem").selectExpr(
            "l_suppkey AS sheet", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
            "l_quantity", "l_discount", "l_shipdate", "l_returnflag",
        )
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate", "l_returnflag"]
        ranked = ordered_scan(li, ["sheet"], order, bucket_of("l_orderkey"), row_number="row")
        # Sheets are read by several branches of every grid query: rank the lines once.
        self._ranked = stage(ranked, "sheet-rows")
        return self._ranked

    def cells(self) -> DataFrame:
        """Raw cells: ``sheet, row, col, tag, raw``."""
        return self.sheet_rows().selectExpr(
            "sheet",
            "row",
            "inline(array("
            "named_struct('col', 1, 'tag', 'n', 'raw', CAST(CAST(l_quantity AS BIGINT) AS STRING)),"
            "named_struct('col', 2, 'tag', 'n', 'raw', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)),"
            "named_struct('col', 3, 'tag', 'd', 'raw', date_format(l_shipdate, 'yyyy-MM-dd')),"
            "named_struct('col', 4, 'tag', 's', 'raw', CAST(l_partkey AS STRING)),"
            "named_struct('col', 5, 'tag', 'str', 'raw',"
            " CASE WHEN l_linenumber = 5 THEN '' ELSE concat('status of the line: ', l_returnflag) END)))",
        )

    def valued(self) -> DataFrame:
        """Cells that hold a value, as text: ``sheet, row, col, text``."""
        return self.cells().filter("raw <> ''").selectExpr("sheet", "row", "col", "raw AS text")

    def axis(self) -> DataFrame:
        sheets = self.sheet_rows().groupBy("sheet").agg(F.max("row").alias("n"))
        rows = self.sheet_rows().selectExpr(
            "sheet", "'row' AS dim", "row AS idx",
            "CAST(CASE WHEN row % 10 = 0 THEN 40 ELSE 20 END AS DOUBLE) AS size", "row % 17 = 0 AS hidden",
        )
        cols = sheets.selectExpr("sheet", "'col' AS dim", "explode(sequence(1L, 5L)) AS idx").selectExpr(
            "sheet", "dim", "idx", "CAST(64 + 10 * idx AS DOUBLE) AS size", "(sheet % 13 = 0 AND idx = 3) AS hidden",
        )
        return rows.unionByName(cols)

    def merges(self) -> DataFrame:
        return self.sheet_rows().filter("row % 50 = 1").selectExpr(
            "sheet", "row AS r1", "1L AS c1", "row + 1 AS r2", "2L AS c2"
        )

    def breaks(self) -> DataFrame:
        return self.sheet_rows().filter("row % 100 = 0 AND sheet % 2 = 0").selectExpr("sheet", "'row' AS dim", "row AS idx")

    def titles(self) -> DataFrame:
        return self.t("supplier").selectExpr(
            "s_suppkey AS sheet",
            "CASE WHEN s_suppkey % 3 = 0 THEN 1L END AS tr1", "CASE WHEN s_suppkey % 3 = 0 THEN 2L END AS tr2",
            "CASE WHEN s_suppkey % 4 = 0 THEN 1L END AS tc1", "CASE WHEN s_suppkey % 4 = 0 THEN 1L END AS tc2",
        )

    def sheets(self) -> DataFrame:
        return self.t("supplier").selectExpr(
            "CAST(s_nationkey AS BIGINT) AS workbook", "s_suppkey AS sheet", "s_suppkey % 6 = 0 AS hidden",
            "s_suppkey % 9 = 0 AS active",
        )

    # -- charts --------------------------------------------------------------------------------

    def chart_points(self) -> DataFrame:
        if self._points is not None:
            return self._points
        li = self.t("lineitem").selectExpr(
            "l_orderkey AS o_orderkey", "CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS cents"
        )
        orders = self.t("orders").selectExpr("o_orderkey", "o_custkey AS c_custkey", "year(o_orderdate) AS y")
        cust = self.t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
        # Sum per order first: it halves the rows that reach the joins.
        per_order = li.groupBy("o_orderkey").agg(F.sum("cents").alias("cents"))
        per_nation = (
            orders.join(per_order, "o_orderkey")
            .join(cust, "c_custkey")
            .groupBy("n_nationkey", "y")
            .agg(F.sum("cents").alias("cents"))
        )
        nations = self.t("nation").join(self.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        points = per_nation.join(nations, "n_nationkey").selectExpr(
            "r_name AS chart", "n_nationkey AS series_idx", "n_name AS series", "y - 1995 AS idx",
            "CAST(y AS STRING) AS category",
            "CAST(CASE WHEN (n_nationkey + y) % 5 = 0 THEN -cents ELSE cents END AS DOUBLE) / 100 AS value",
        )
        # A few points per nation and year; every chart query reads them more than once.
        self._points = stage(points, "chart-points")
        return self._points

    # -- outlines and decks --------------------------------------------------------------------

    def outline(self) -> DataFrame:
        return self.t("conversations").selectExpr(
            "conv_id AS doc_id", "turn AS ord", "CAST((turn * 7 + conv_id) % 3 AS INT) AS level",
            "CASE (turn + conv_id) % 7 WHEN 0 THEN 'char' WHEN 6 THEN 'none' ELSE 'auto' END AS kind",
            "CASE conv_id % 6 WHEN 0 THEN 'arabicPeriod' WHEN 1 THEN 'alphaLcParenR' WHEN 2 THEN 'romanUcPeriod'"
            " WHEN 3 THEN 'alphaUcParenBoth' WHEN 4 THEN 'romanLcMinus' ELSE 'arabicPlain' END AS auto_type",
            "CAST(CASE WHEN conv_id % 10 = 0 THEN turn % 2 ELSE 1 + conv_id % 40 END AS BIGINT) AS start_at",
            "CASE WHEN turn % 6 = 5 THEN '' ELSE text END AS text",
        )

    def styles(self) -> DataFrame:
        return self.t("part").selectExpr(
            "p_partkey AS style_id",
            "CASE WHEN p_partkey % 61 = 0 THEN NULL ELSE p_partkey - 1 END AS based_on",
            "CASE WHEN p_partkey % 61 = 3 THEN TRUE WHEN p_partkey % 61 = 12 THEN FALSE END AS value",
        )

    def slides(self) -> DataFrame:
        return self.t("orders").selectExpr(
            "o_custkey AS deck", "o_orderkey AS ord",
            "concat('ppt/slides/slide', CAST(o_orderkey AS STRING), '.xml') AS part",
            "(o_orderkey % 6 = 0 OR o_custkey % 15 = 0) AS hidden",
            "CASE o_orderkey % 4 WHEN 0 THEN concat('<p>note ', CAST(o_orderkey AS STRING), '</p>')"
            " WHEN 1 THEN '<p>  </p>' END AS note",
        )

    def rels(self) -> DataFrame:
        o = self.t("orders")
        slide = o.selectExpr(
            "concat('ppt/slides/slide', CAST(o_orderkey AS STRING), '.xml') AS part", "1L AS ord",
            "concat('../slideLayouts/./slideLayout', CAST(o_orderkey % 11 AS STRING), '.xml') AS target",
            "'http://x/slideLayout' AS type", "FALSE AS external",
        )
        link = o.selectExpr(
            "concat('ppt/slides/slide', CAST(o_orderkey AS STRING), '.xml') AS part", "2L AS ord",
            "'https://example.org/../a' AS target", "'http://x/hyperlink' AS type", "TRUE AS external",
        )
        layout = o.selectExpr("o_orderkey % 11 AS k").distinct().selectExpr(
            "concat('ppt/slideLayouts/slideLayout', CAST(k AS STRING), '.xml') AS part", "1L AS ord",
            "concat('/ppt/slideMasters/slideMaster', CAST(k % 3 AS STRING), '.xml') AS target",
            "'http://x/slideMaster' AS type", "FALSE AS external",
        )
        master = o.selectExpr("o_orderkey % 11 % 3 AS k").distinct().selectExpr(
            "concat('ppt/slideMasters/slideMaster', CAST(k AS STRING), '.xml') AS part", "1L AS ord",
            "concat('../theme/theme', CAST(k AS STRING), '.xml') AS target", "'http://x/theme' AS type", "FALSE AS external",
        )
        return slide.unionByName(link).unionByName(layout).unionByName(master)

    # -- jobs ----------------------------------------------------------------------------------

    def job_events(self) -> DataFrame:
        ev = self.t("events").selectExpr(
            "user_id AS job_id", "event_id", "ts",
            "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'cancel'"
            " WHEN 'purchase' THEN 'success' ELSE 'error' END AS kind",
            "CASE WHEN event_type = 'error' THEN concat('code-', CAST(event_id % 5 AS STRING)) END AS code",
            "CAST(value * 10 AS BIGINT) AS completed",
        )
        return ordered_scan(
            ev, ["job_id"], ["ts", "event_id"], time_bucket("ts"),
            running={"op_id": F.when(F.col("kind") == "start", F.lit(1)).otherwise(F.lit(0)).cast("long")},
        )

    def responses(self) -> DataFrame:
        return self.t("events").filter("event_type = 'purchase'").selectExpr("user_id AS source", "event_id AS response_id", "ts")

    def errors(self) -> DataFrame:
        return self.t("events").filter("event_type = 'error'").selectExpr(
            "user_id AS source", "event_id AS error_id", "ts", "concat('failure ', CAST(event_id AS STRING)) AS message"
        )


FAILURE_CASE = (
    "CASE event_id % 12 WHEN 0 THEN 'Error: TOTAL-INPUT-TOO-LARGE' WHEN 1 THEN 'input-too-large'"
    " WHEN 2 THEN 'the file needs a password' WHEN 3 THEN 'Out of memory: array buffer allocation failed'"
    " WHEN 4 THEN 'Invalid PDF structure' WHEN 5 THEN 'overlapping-ranges' WHEN 6 THEN 'unexpected end of data'"
    " WHEN 7 THEN 'worker could not fetch wasm' WHEN 8 THEN 'Cancelled by user' WHEN 9 THEN 'empty-document'"
    " WHEN 10 THEN 'no-pages-left' ELSE 'something else' END"
)

_PAGE = LINES_PER_PAGE

VIEWS: dict[str, str] = {
    "files": """
        SELECT CAST(floor(sqrt(doc_id)) AS BIGINT) AS batch, doc_id AS ord,
               concat(source, '_', CAST(doc_id AS VARCHAR), CASE doc_id % 7 WHEN 0 THEN '.docx' WHEN 1 THEN '.DOCX'
                 WHEN 2 THEN '.doc' WHEN 3 THEN '.xlsx' WHEN 4 THEN '' WHEN 5 THEN '.csv' ELSE '.pptx' END) AS name,
               CASE WHEN doc_id % 31 = 0 THEN CAST(0 AS BIGINT) ELSE n_chars END AS size
        FROM documents""",
    "pdf_files": """
        SELECT CAST(floor(sqrt(doc_id)) AS BIGINT) AS batch, doc_id AS ord,
               concat(source, '_', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 97 = 3 THEN '.txt'
                 WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END) AS name,
               CASE WHEN doc_id % 131 = 5 THEN CAST(0 AS BIGINT) ELSE n_chars END AS size,
               1 + n_chars // 1500 AS pages, 200 + n_chars % 3000 AS width, 300 + doc_id % 1000 AS height
        FROM documents""",
    "doc_lists": "SELECT doc_id, string_split(text, chr(10)) AS l FROM documents",
    "lines": """
        SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS text FROM doc_lists""",
    "page_counts": f"SELECT doc_id, CAST((len(l) + {_PAGE - 1}) // {_PAGE} AS BIGINT) AS page_count FROM doc_lists",
    "page_texts": f"""
        SELECT doc_id, CAST(k AS INTEGER) AS page_no,
               array_to_string(l[(k - 1) * {_PAGE} + 1 : k * {_PAGE}], chr(10)) AS text, page_count
        FROM (SELECT doc_id, l, page_count, unnest(range(1, page_count + 1)) AS k
              FROM doc_lists JOIN page_counts USING (doc_id))""",
    "doc_pages": """
        SELECT doc_id, page_no, 90 * (page_no % 4) AS rotation, text,
               CASE WHEN doc_id % 2 = 0 THEN 595.28::DOUBLE ELSE 612.0::DOUBLE END AS width,
               CASE WHEN doc_id % 2 = 0 THEN 841.89::DOUBLE ELSE 792.0::DOUBLE END AS height
        FROM page_texts""",
    "doc_pages_rev": """
        SELECT doc_id, page_no, 90 * (page_no % 4) AS rotation, text,
               CASE WHEN doc_id % 2 = 0 THEN 595.28::DOUBLE ELSE 612.0::DOUBLE END AS width,
               CASE WHEN doc_id % 2 = 0 THEN 841.89::DOUBLE ELSE 792.0::DOUBLE END AS height
        FROM (
          SELECT doc_id, page_no, CASE WHEN doc_id % 3 = 0 THEN concat('rev ', text)
                 WHEN doc_id % 11 = 0 THEN replace(text, ' ', '  ') ELSE text END AS text
          FROM page_texts WHERE NOT (doc_id % 5 = 0 AND page_no = page_count)
          UNION ALL
          SELECT doc_id, CAST(page_count + 1 AS INTEGER), concat('appendix ', CAST(doc_id AS VARCHAR))
          FROM page_counts WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0)""",
    "selections": """
        SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '1' WHEN 1 THEN '1-2' WHEN 2 THEN '2, 1' WHEN 3 THEN '1,,2'
               WHEN 4 THEN '3-1' WHEN 5 THEN '1-999' WHEN 6 THEN '1-2,2' ELSE '' END AS sel FROM documents""",
    "page_order": """
        SELECT doc_id, CAST(page_count - page_no + 1 AS BIGINT) AS pos,
               CAST(CASE WHEN doc_id % 13 = 0 AND page_no = 1 THEN page_count ELSE page_no END AS BIGINT) AS page_no,
               CASE WHEN doc_id % 29 = 0 THEN 45 ELSE 90 * (page_no % 4) END AS rotation
        FROM page_texts""",
    "stamps": """
        SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 1 + doc_id % 3 END AS start_page,
               CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 + doc_id % 3 END AS end_page,
               concat('stamp ', CAST(doc_id AS VARCHAR)) AS label
        FROM documents""",
    "markups": """
        SELECT doc_id, doc_id * 1000 + page_no AS item_id,
               CASE WHEN doc_id % 23 = 0 THEN page_no + 1000 ELSE page_no END AS page_no,
               CASE (doc_id + page_no) % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'note' ELSE 'rectangle' END AS kind,
               CAST(10 * page_no AS DOUBLE) AS x, 20::DOUBLE AS y, 100::DOUBLE AS w, 40::DOUBLE AS h,
               CAST(CASE WHEN doc_id % 9 = 0 THEN 100 ELSE 12 END AS DOUBLE) AS font_size,
               CASE WHEN doc_id % 19 = 0 THEN '   ' ELSE concat('  note ', CAST(page_no AS VARCHAR)) END AS text,
               CASE WHEN doc_id % 17 = 0 THEN 'red' ELSE '#12aBcF' END AS color
        FROM doc_pages""",
    "vec_ints": """
        SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(abs(v::DOUBLE) * 1000) AS BIGINT) % 256) AS a
        FROM embeddings""",
    "vec_pairs": "SELECT p.vec_id, p.a AS a, q.a AS b FROM vec_ints p JOIN vec_ints q ON q.vec_id = p.vec_id + 1",
    "receipt_parts": """
        SELECT o_orderkey AS doc_id, c_name, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
               CAST(year(o_orderdate) AS VARCHAR) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "receipts": """
        SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN concat('12345', chr(10), 'INVOICE', chr(10), '----')
               ELSE concat('Receipt', chr(10), c_name, chr(10), 'issued on  ', dt, chr(10), 'Subtotal: $', money, chr(10),
                 'Tax 1.00', chr(10), 'TOTAL  $', grouped, chr(10), chr(10), 'thank you') END AS text,
               concat('scan ', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '' END) AS file_name
        FROM (SELECT *, CASE WHEN cents >= 100000 THEN concat(CAST(cents // 100000 AS VARCHAR), ',',
                 lpad(CAST(cents // 100 % 1000 AS VARCHAR), 3, '0'), '.', lpad(CAST(cents % 100 AS VARCHAR), 2, '0'))
                 ELSE money END AS grouped
              FROM (SELECT *, concat(CAST(cents // 100 AS VARCHAR), '.', lpad(CAST(cents % 100 AS VARCHAR), 2, '0')) AS money,
                 CASE doc_id % 3 WHEN 0 THEN concat(y, '-', lpad(CAST(m AS VARCHAR), 2, '0'), '-', lpad(CAST(d AS VARCHAR), 2, '0'))
                 WHEN 1 THEN concat(CAST(d AS VARCHAR), '/', CAST(m AS VARCHAR), '/', y)
                 ELSE concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', (m - 1) * 3 + 1, 3), ' ', CAST(d AS VARCHAR), ', ', y)
                 END AS dt FROM receipt_parts))""",
    "boxes": """
        SELECT doc_id, page_no,
               CAST(CASE WHEN k = 0 THEN 0.1 + (doc_id % 10) * 0.05 ELSE 0.9 END AS DOUBLE) AS x1,
               CAST(CASE WHEN k = 0 THEN -0.2 ELSE 0.5 + (page_no % 4) * 0.1 END AS DOUBLE) AS y1,
               CAST(CASE WHEN k = 0 THEN 0.4 + (doc_id % 10) * 0.05
                    ELSE CASE WHEN doc_id % 6 = 0 THEN 0.899 ELSE 0.6 END END AS DOUBLE) AS x2,
               CAST(CASE WHEN k = 0 THEN 0.25 ELSE 0.45 END AS DOUBLE) AS y2
        FROM doc_pages CROSS JOIN (VALUES (0), (1)) v(k)""",
    "failures": f"SELECT event_id, {FAILURE_CASE} AS message FROM events WHERE event_type = 'error'",
    "catalog": """
        SELECT p_brand AS grp, p_partkey AS ord, p_name AS title, p_type AS description,
               concat('size ', CAST(p_size AS VARCHAR)) AS keywords FROM part""",
    "sheet_rows": """
        SELECT l_suppkey AS sheet, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount,
               l_shipdate, l_returnflag,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice,
                 l_quantity, l_discount, l_shipdate, l_returnflag) AS "row"
        FROM lineitem""",
    "cells": """
        SELECT sheet, "row", 1 AS col, 'n' AS tag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS raw FROM sheet_rows
        UNION ALL SELECT sheet, "row", 2, 'n', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) FROM sheet_rows
        UNION ALL SELECT sheet, "row", 3, 'd', strftime(l_shipdate, '%Y-%m-%d') FROM sheet_rows
        UNION ALL SELECT sheet, "row", 4, 's', CAST(l_partkey AS VARCHAR) FROM sheet_rows
        UNION ALL SELECT sheet, "row", 5, 'str', CASE WHEN l_linenumber = 5 THEN ''
                  ELSE concat('status of the line: ', l_returnflag) END FROM sheet_rows""",
    "valued": """SELECT sheet, "row", col, raw AS text FROM cells WHERE raw <> ''""",
    "axis": """
        SELECT sheet, 'row' AS dim, "row" AS idx, CAST(CASE WHEN "row" % 10 = 0 THEN 40 ELSE 20 END AS DOUBLE) AS size,
               "row" % 17 = 0 AS hidden FROM sheet_rows
        UNION ALL
        SELECT sheet, 'col', idx, CAST(64 + 10 * idx AS DOUBLE), sheet % 13 = 0 AND idx = 3
        FROM (SELECT DISTINCT sheet FROM sheet_rows) CROSS JOIN (SELECT unnest(range(1, 6)) AS idx)""",
    "merges": """
        SELECT sheet, "row" AS r1, CAST(1 AS BIGINT) AS c1, "row" + 1 AS r2, CAST(2 AS BIGINT) AS c2
        FROM sheet_rows WHERE "row" % 50 = 1""",
    "breaks": """SELECT sheet, 'row' AS dim, "row" AS idx FROM sheet_rows WHERE "row" % 100 = 0 AND sheet % 2 = 0""",
    "titles": """
        SELECT s_suppkey AS sheet, CASE WHEN s_suppkey % 3 = 0 THEN 1 END AS tr1, CASE WHEN s_suppkey % 3 = 0 THEN 2 END AS tr2,
               CASE WHEN s_suppkey % 4 = 0 THEN 1 END AS tc1, CASE WHEN s_suppkey % 4 = 0 THEN 1 END AS tc2 FROM supplier""",
    "sheets": """
        SELECT CAST(s_nationkey AS BIGINT) AS workbook, s_suppkey AS sheet, s_suppkey % 6 = 0 AS hidden,
               s_suppkey % 9 = 0 AS active FROM supplier""",
    "chart_points": """
        SELECT r_name AS chart, n_nationkey AS series_idx, n_name AS series, CAST(y - 1995 AS INTEGER) AS idx,
               CAST(y AS VARCHAR) AS category,
               CAST(CASE WHEN (n_nationkey + y) % 5 = 0 THEN -cents ELSE cents END AS DOUBLE) / 100 AS value
        FROM (SELECT c_nationkey, year(o_orderdate) AS y,
                     CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS cents
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "outline": """
        SELECT conv_id AS doc_id, turn AS ord, CAST((turn * 7 + conv_id) % 3 AS INTEGER) AS level,
               CASE (turn + conv_id) % 7 WHEN 0 THEN 'char' WHEN 6 THEN 'none' ELSE 'auto' END AS kind,
               CASE conv_id % 6 WHEN 0 THEN 'arabicPeriod' WHEN 1 THEN 'alphaLcParenR' WHEN 2 THEN 'romanUcPeriod'
                 WHEN 3 THEN 'alphaUcParenBoth' WHEN 4 THEN 'romanLcMinus' ELSE 'arabicPlain' END AS auto_type,
               CAST(CASE WHEN conv_id % 10 = 0 THEN turn % 2 ELSE 1 + conv_id % 40 END AS BIGINT) AS start_at,
               CASE WHEN turn % 6 = 5 THEN '' ELSE text END AS text
        FROM conversations""",
    "styles": """
        SELECT p_partkey AS style_id, CASE WHEN p_partkey % 61 = 0 THEN NULL ELSE p_partkey - 1 END AS based_on,
               CASE WHEN p_partkey % 61 = 3 THEN TRUE WHEN p_partkey % 61 = 12 THEN FALSE END AS value FROM part""",
    "slides": """
        SELECT o_custkey AS deck, o_orderkey AS ord, concat('ppt/slides/slide', CAST(o_orderkey AS VARCHAR), '.xml') AS part,
               (o_orderkey % 6 = 0 OR o_custkey % 15 = 0) AS hidden,
               CASE o_orderkey % 4 WHEN 0 THEN concat('<p>note ', CAST(o_orderkey AS VARCHAR), '</p>')
                 WHEN 1 THEN '<p>  </p>' END AS note
        FROM orders""",
    "job_events": """
        SELECT user_id AS job_id, event_id, ts,
               CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'cancel'
                 WHEN 'purchase' THEN 'success' ELSE 'error' END AS kind,
               CASE WHEN event_type = 'error' THEN concat('code-', CAST(event_id % 5 AS VARCHAR)) END AS code,
               CAST(trunc(value * 10) AS BIGINT) AS completed,
               CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS op_id
        FROM events""",
    "responses": "SELECT user_id AS source, event_id AS response_id, ts FROM events WHERE event_type = 'purchase'",
    "errors": """
        SELECT user_id AS source, event_id AS error_id, ts, concat('failure ', CAST(event_id AS VARCHAR)) AS message
        FROM events WHERE event_type = 'error'""",
}


def with_views(sql: str, extra: str = "") -> str:
    """Prefix ``sql`` with the derived views it mentions; ``extra`` holds further CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(body)
                needed.append(name)

    visit(extra)
    visit(sql)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in needed]
    if extra:
        ctes.append(extra)
    return f"WITH RECURSIVE {', '.join(ctes)} {sql}" if ctes else sql
