"""Admission and job-event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.operators import admission as A
from docframe.operators import jobs as J
from docframe.plans.registry import query
from docframe.sources.fixtures import Fixtures


def _manifest_sql(kind: str) -> str:
    now, old = (", ".join(f"'{e}'" for e in group) for group in A.EXTENSIONS[kind])
    ext = "regexp_extract(lower(name), '\\.[^.]+$')"
    return f"""CASE WHEN {ext} IN ({old}) THEN 'legacy-format' WHEN {ext} NOT IN ({now}) THEN 'wrong-type'
               WHEN size = 0 THEN 'empty-file' WHEN size > 20000 THEN 'input-too-large' END"""


@query("check_manifest", "SELECT ord, name, " + ", ".join(f"{_manifest_sql(k)} AS {k}" for k in A.EXTENSIONS) + " FROM files")
def _manifest(f: Fixtures):
    return f.files().select("ord", "name", *[A.check_manifest("name", "size", k, 20_000).alias(k) for k in A.EXTENSIONS])


_CAPS = A.Caps(max_files=40, total_bytes=60_000, file_bytes=20_000, total_pages=45)


@query(
    "admit_batch",
    """SELECT batch, count(*) AS n_files,
         CASE WHEN count(*) < 2 THEN 'not-enough-files' WHEN count(*) > 40 THEN 'too-many-files'
              ELSE coalesce(min_by(code, ord) FILTER (WHERE code IS NOT NULL), CASE WHEN bool_or(pg > 45) THEN 'too-many-pages' END) END AS error,
         CASE WHEN count(*) BETWEEN 2 AND 40 THEN coalesce(min(ord) FILTER (WHERE code IS NOT NULL), min(ord) FILTER (WHERE pg > 45)) END AS at_ord
       FROM (SELECT *, CASE WHEN NOT lower(name) LIKE '%.pdf' THEN 'wrong-type' WHEN size = 0 THEN 'empty-file'
               WHEN sum(size) OVER w > 60000 THEN 'total-input-too-large' END AS code, sum(pages) OVER w AS pg
             FROM pdf_files WINDOW w AS (PARTITION BY batch ORDER BY ord))
       GROUP BY batch""",
)
def _batch(f: Fixtures):
    return A.admit_batch(f.pdf_files(), _CAPS)


@query(
    "admit_images",
    """SELECT batch, count(*) AS n_files, CASE WHEN count(*) > 50 THEN 'invalid-file-count'
         WHEN bool_or(size = 0) OR sum(size) > 100000 THEN 'invalid-file-size' ELSE min_by(code, ord) FILTER (WHERE code IS NOT NULL) END AS error,
         CASE WHEN count(*) <= 50 AND NOT (bool_or(size = 0) OR sum(size) > 100000) THEN min(ord) FILTER (WHERE code IS NOT NULL) END AS at_ord
       FROM (SELECT *, CASE WHEN greatest(width, height) > 3150 OR width * height > 3600000 THEN 'image-too-large'
               WHEN sum(width * height) OVER (PARTITION BY batch ORDER BY ord) > 15000000 THEN 'too-many-pixels' END AS code FROM pdf_files)
       GROUP BY batch""",
)
def _images(f: Fixtures):
    caps = A.ImageCaps(max_files=50, total_bytes=100_000, image_pixels=3_600_000, total_pixels=15_000_000, side=3150)
    return A.admit_images(f.pdf_files(), caps)


@query(
    "admit_greedy",
    """SELECT batch, ord, name, size, CASE WHEN ord > stop THEN 'not-considered' WHEN ord = stop THEN 'too-many-files'
           WHEN code IS NOT NULL THEN code WHEN took THEN 'accepted' ELSE 'total-input-too-large' END AS status
       FROM (SELECT *, min(CASE WHEN code IS NULL AND n >= 12 AND NOT took THEN ord END) OVER (PARTITION BY batch) AS stop FROM walk)""",
    """pf AS (SELECT batch, ord, name, size, CASE WHEN NOT lower(name) LIKE '%.pdf' THEN 'wrong-type' WHEN size = 0 THEN 'empty-file'
                WHEN size > 9000 THEN 'input-too-large' END AS code, row_number() OVER (PARTITION BY batch ORDER BY ord) AS rn FROM pdf_files),
       walk AS (
         SELECT batch, ord, name, size, code, rn, code IS NULL AND size <= 15000 AS took,
                CASE WHEN code IS NULL AND size <= 15000 THEN 1 ELSE 0 END AS n, CASE WHEN code IS NULL AND size <= 15000 THEN size ELSE 0 END AS used
         FROM pf WHERE rn = 1
         UNION ALL
         SELECT p.batch, p.ord, p.name, p.size, p.code, p.rn, p.code IS NULL AND w.n < 12 AND w.used + p.size <= 15000,
                w.n + CASE WHEN p.code IS NULL AND w.n < 12 AND w.used + p.size <= 15000 THEN 1 ELSE 0 END,
                w.used + CASE WHEN p.code IS NULL AND w.n < 12 AND w.used + p.size <= 15000 THEN p.size ELSE 0 END
         FROM walk w JOIN pf p ON p.batch = w.batch AND p.rn = w.rn + 1)""",
)
def _greedy(f: Fixtures):
    caps = A.Caps(max_files=12, total_bytes=15_000, file_bytes=9_000)
    return A.admit_greedy(f.pdf_files().select("batch", "ord", "name", "size"), caps)


@query(
    "smaller_of",
    """SELECT page_id, CASE WHEN octet_length(encode(n)) < octet_length(encode(html)) THEN n ELSE html END AS html,
              CASE WHEN octet_length(encode(n)) < octet_length(encode(html)) THEN 'rewritten' ELSE 'original' END AS kept
       FROM (SELECT page_id, html, CASE WHEN page_id % 4 = 0 THEN concat(html, ' ') ELSE regexp_replace(html, '>[ \\t\\n]+<', '><', 'g') END AS n FROM pages)""",
)
def _smaller(f: Fixtures):
    pages = f.t("pages").select("page_id", "html")
    shrunk = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit(" "))).otherwise(F.regexp_replace("html", r">[ \t\n]+<", "><"))
    return A.smaller_of(pages, pages.select("page_id", shrunk.alias("html")), "page_id", "html")


_OPS = """
ops AS (SELECT job_id, op_id, min(ts) FILTER (WHERE kind = 'start') AS start_ts,
          min(ts) FILTER (WHERE kind IN ('success', 'error', 'cancel')) AS d,
          arg_min(kind, ts) FILTER (WHERE kind IN ('success', 'error', 'cancel')) AS k,
          arg_min(coalesce(code, ''), ts) FILTER (WHERE kind IN ('success', 'error', 'cancel')) AS c
        FROM job_events GROUP BY 1, 2 HAVING count(*) FILTER (WHERE kind = 'start') > 0),
timed AS (SELECT *, lead(start_ts) OVER (PARTITION BY job_id ORDER BY op_id) AS nxt, start_ts + INTERVAL 36000 SECOND AS deadline FROM ops)
"""


@query(
    "job_status",
    """SELECT job_id, op_id, outcome, CASE WHEN outcome IN ('success', 'error', 'cancel') THEN nullif(c, '') END AS code,
              epoch_us(start_ts) AS start_us, epoch_us(CASE WHEN outcome = 'superseded' THEN nxt WHEN outcome = 'timeout' THEN deadline ELSE d END) AS end_us
       FROM (SELECT *, CASE WHEN nxt < CASE WHEN d <= deadline THEN d ELSE deadline END THEN 'superseded'
                            WHEN d <= deadline THEN k ELSE 'timeout' END AS outcome FROM timed)""",
    _OPS,
)
def _status(f: Fixtures):
    out = J.job_status(f.job_events(), timeout=36_000)
    return out.select(
        "job_id", "op_id", "outcome", "code",
        F.unix_micros(F.col("start_ts").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end_ts").cast("timestamp")).alias("end_us"),
    )


@query(
    "attach_error",
    """SELECT source, response_id, CASE WHEN taken THEN error_id END AS error_id, CASE WHEN taken THEN message END AS message
       FROM (SELECT *, error_id IS NOT NULL AND row_number() OVER (PARTITION BY source, error_id ORDER BY ts, response_id) = 1
                       AND epoch_us(ts) - epoch_us(error_ts) <= 14400000000 AS taken
             FROM (SELECT r.source, r.response_id, r.ts, e.error_id, e.message, e.ts AS error_ts
                   FROM responses r ASOF LEFT JOIN errors e ON e.source = r.source AND e.ts <= r.ts))""",
)
def _attach_error(f: Fixtures):
    return J.attach_error(f.responses(), f.errors(), ttl=14_400).select("source", "response_id", "error_id", "message")


@query(
    "job_progress",
    """SELECT job_id, arg_max(completed, (ts, event_id)) AS completed, epoch_us(max(ts)) AS us FROM job_events WHERE kind = 'progress' GROUP BY 1""",
)
def _progress(f: Fixtures):
    return J.job_progress(f.job_events()).select("job_id", "completed", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
