"""Text queries: comparison, extraction, cleaning, search, masking and error codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.operators import text as X
from docframe.plans.registry import query
from docframe.sources.fixtures import Fixtures

_WS = r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NORM = f"trim(regexp_replace(nfc_normalize(text), '{_WS}+', ' ', 'g'))"

_COMPARE = f"""
ta AS (SELECT doc_id, page_no, {_NORM} AS t FROM doc_pages),
tb AS (SELECT doc_id, page_no, {_NORM} AS t FROM doc_pages_rev),
diffs AS (
  SELECT coalesce(ta.doc_id, tb.doc_id) AS doc_id, coalesce(ta.page_no, tb.page_no) AS page_no,
         CASE WHEN ta.doc_id IS NULL THEN 'added' WHEN tb.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS kind,
         ta.t AS t_old, tb.t AS t_new
  FROM ta FULL OUTER JOIN tb ON ta.doc_id = tb.doc_id AND ta.page_no = tb.page_no
  WHERE ta.t IS DISTINCT FROM tb.t)
"""


@query("normalize_text", f"SELECT doc_id, page_no, {_NORM} AS text FROM doc_pages_rev")
def _normalize(f: Fixtures):
    return f.doc_pages_rev().select("doc_id", "page_no", X.normalize_text("text").alias("text"))


@query(
    "compare_docs",
    """SELECT doc_id, page_no, kind, TRUE AS text_changed, NULL::DOUBLE AS visual_pct,
              CASE WHEN length(t_old) <= 360 THEN t_old ELSE substr(t_old, 1, 360) || '…' END AS original_text,
              CASE WHEN length(t_new) <= 360 THEN t_new ELSE substr(t_new, 1, 360) || '…' END AS revised_text
       FROM diffs""",
    _COMPARE,
)
def _compare(f: Fixtures):
    return X.compare_docs(f.doc_pages(), f.doc_pages_rev())


@query("compare_summary", "SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM diffs GROUP BY kind", _COMPARE)
def _compare_summary(f: Fixtures):
    diffs = X.compare_docs(f.doc_pages(), f.doc_pages_rev())
    # Counting per (kind, doc) first keeps the distinct count free of an expand.
    per_doc = diffs.groupBy("kind", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(
    "array_diff_pct",
    """SELECT vec_id, CASE WHEN px = 0 THEN 100.0 ELSE len(list_filter(range(px), lambda i:
              greatest(abs(a[i*4+1] - b[i*4+1]), abs(a[i*4+2] - b[i*4+2]), abs(a[i*4+3] - b[i*4+3])) > 20)) / px * 100 END AS pct
       FROM (SELECT *, least(len(a), len(b)) // 4 AS px FROM vec_pairs)""",
)
def _array_diff(f: Fixtures):
    return f.vec_pairs().select("vec_id", X.array_diff_pct("a", "b").alias("pct"))


_DATE = r"(?i)\b(?:20\d{2}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-](?:20)?\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+20\d{2})\b"
_AMOUNT = r"(?:[$€£₹]\s*)?\b\d{1,3}(?:,\d{3})*(?:\.\d{2})\b|\b\d+\.\d{2}\b"
_LINES = r"list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"


@query(
    "extract_receipt",
    f"""SELECT doc_id, merchant, regexp_extract(date_line, '{_DATE}') AS date, total,
               CASE WHEN merchant <> '' THEN 'candidate' ELSE 'review' END AS merchant_conf,
               CASE WHEN date_line <> '' THEN 'candidate' ELSE 'review' END AS date_conf,
               CASE WHEN total <> '' THEN 'candidate' ELSE 'review' END AS total_conf
        FROM (SELECT *, coalesce(regexp_extract_all(total_line, '{_AMOUNT}')[-1], '') AS total FROM (
          SELECT doc_id,
            coalesce(list_filter(ls, lambda s: regexp_matches(s, '[A-Za-z]') AND length(s) < 100
              AND NOT regexp_matches(s, '(?i)^(receipt|invoice|tax invoice|sales receipt)$'))[1], '') AS merchant,
            coalesce(list_filter(ls, lambda s: regexp_matches(s, '{_DATE}'))[1], '') AS date_line,
            coalesce(list_filter(ls, lambda s: regexp_matches(s, '(?i)(grand\\s+total|amount\\s+due|balance\\s+due|total|amount\\s+paid|paid)')
              AND regexp_matches(s, '\\d'))[-1], '') AS total_line
          FROM (SELECT doc_id, {_LINES} AS ls FROM receipts)))""",
)
def _extract_receipt(f: Fixtures):
    return f.receipts().select("doc_id", X.extract_receipt("text").alias("r")).select("doc_id", "r.*")


def _sanitize_sql(c: str) -> str:
    inner = f"regexp_replace(strip_accents({c}), '[\\\\/:*?\"<>|]', ' ', 'g')"
    inner = f"regexp_replace(regexp_replace({inner}, '[\\x00-\\x1f]', ' ', 'g'), '[. ]+$', '')"
    return f"substr(trim(regexp_replace({inner}, '\\s+', ' ', 'g')), 1, 90)"


def _suggest_sql(table: str, text: str, name: str) -> str:
    return f"""
      SELECT doc_id, concat(CASE WHEN b = '' THEN 'scan' ELSE b END, regexp_extract({name}, '\\.[^.]+$')) AS suggested,
             CASE WHEN trim({text}) <> '' THEN 'suggested' ELSE 'original' END AS note
      FROM (SELECT *, trim(regexp_replace(coalesce(nullif(ln, ''), nullif(st, ''), concat('scan-', doc_id)), '[. ]+$', '')) AS b
        FROM (SELECT *, {_sanitize_sql('l0')} AS ln, {_sanitize_sql(f"regexp_replace({name}, '[.][^.]+$', '')")} AS st
          FROM (SELECT *, coalesce(list_filter({_LINES}, lambda s: length(s) BETWEEN 3 AND 90 AND regexp_matches(s, '[A-Za-z0-9]')
             AND NOT regexp_matches(s, '(?i)^(scan|document|receipt|invoice|page)\\b'))[1], '') AS l0 FROM {table})))"""


@query("suggest_name", _suggest_sql("receipts", "text", "file_name"))
def _suggest_name(f: Fixtures):
    return X.suggest_name(f.receipts(), number="doc_id").select("doc_id", "suggested", "note")


@query("suggest_name_documents", _suggest_sql("(SELECT doc_id, text, concat(source, '.tiff') AS fname FROM documents)", "text", "fname"))
def _suggest_docs(f: Fixtures):
    docs = f.t("documents").select("doc_id", "text", F.concat("source", F.lit(".tiff")).alias("fname"))
    return X.suggest_name(docs, file_name="fname", number="doc_id").select("doc_id", "suggested", "note")


@query(
    "scrub_metadata",
    """SELECT doc_id, concat('{"lang":"', lang, '"}') AS info, text FROM documents""",
)
def _scrub(f: Fixtures):
    docs = f.t("documents").select(
        "doc_id",
        "text",
        F.create_map(
            F.lit("author"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("title"), F.col("doc_id").cast("string")
        ).alias("info"),
        F.sha2("text", 256).alias("document_id"),
    )
    return X.scrub_metadata(docs, "info", ["author", "title"], ["document_id"]).withColumn("info", F.to_json("info"))


# The same piece-by-piece rewrite over a list of tags and texts.
_TAGS = "['" + "','".join(X.ALLOWED_TAGS) + "']"


def _attr_sql(piece: str, name: str) -> str:
    raw = f"""regexp_extract({piece}, '(?is)\\s{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', 1)"""
    return f"""regexp_replace(regexp_replace({raw}, '^["'']', ''), '["'']$', '')"""


_NAME = "lower(regexp_extract(p, '^</?([A-Za-z][A-Za-z0-9]*)', 1))"
_STYLE = _attr_sql("p", "style")
_HREF = _attr_sql("p", "href")
_REWRITE = f"""
  CASE WHEN p NOT LIKE '<%' THEN p
       WHEN {_NAME} IN ('script', 'style') AND p NOT LIKE '</%' THEN ''
       WHEN p = '<' THEN '&lt;'
       WHEN NOT list_contains({_TAGS}, {_NAME}) THEN ''
       WHEN p LIKE '</%' THEN CASE WHEN {_NAME} = 'br' THEN '' ELSE concat('</', {_NAME}, '>') END
       ELSE concat('<', {_NAME},
         CASE WHEN {_STYLE} <> '' AND NOT regexp_matches({_STYLE}, '(?i)url\\s*\\(|expression\\s*\\(|@import')
              THEN concat(' style="', replace({_STYLE}, '"', '&quot;'), '"') ELSE '' END,
         CASE WHEN {_NAME} = 'a' AND regexp_matches({_HREF}, '(?i)^(https?:|mailto:)')
              THEN concat(' href="', replace({_HREF}, '"', '&quot;'), '"') ELSE '' END, '>') END"""
_PIECES = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^>]*>|[^<]+|<"


@query(
    "sanitize_html",
    f"""SELECT page_id, array_to_string(list_transform(
          regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '{_PIECES}'), lambda p: {_REWRITE}), '') AS html
        FROM pages""",
)
def _sanitize(f: Fixtures):
    return f.t("pages").select("page_id", X.sanitize_html("html").alias("html"))


@query(
    "extract_links",
    f"""SELECT page_id, CAST(generate_subscripts(h, 1) AS INTEGER) AS link_no, unnest(h) AS href
        FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*>'), lambda p: {_HREF}),
                lambda h: regexp_matches(h, '(?i)^(https?:|mailto:)')) AS h
              FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html ELSE
                      replace(html, 'href="/', concat('href="', regexp_extract(url, '^https?://[^/]*'), '/')) END AS html FROM pages))""",
)
def _links(f: Fixtures):
    """Links of two pages in three are made absolute first; the raw pages only hold relative ones."""
    base = F.regexp_extract("url", "^https?://[^/]*", 0)
    full = F.replace("html", F.lit('href="/'), F.concat(F.lit('href="'), base, F.lit("/")))
    pages = f.t("pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(full).alias("html"))
    return X.extract_links(pages)


@query(
    "cell_links",
    """SELECT sheet, "row", CAST(col AS BIGINT) AS col, arg_max(target, ord) AS href FROM (
         SELECT l.sheet, l."row", l.col, l.ord, r.target FROM (
           SELECT sheet, "row", CASE "row" % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 26 END AS col, "row" AS ord, l_partkey FROM sheet_rows
           UNION ALL SELECT sheet, "row" - 1, 5, 1000000 + "row", l_partkey FROM sheet_rows WHERE "row" % 20 IN (1, 2)) l
         JOIN (SELECT DISTINCT l_partkey, CASE l_partkey % 3 WHEN 0 THEN concat('https://parts.example/', l_partkey)
                 WHEN 1 THEN concat('MAILTO:part', l_partkey, '@parts.example') ELSE concat('ftp://parts.example/', l_partkey) END AS target,
                 l_partkey % 7 <> 0 AS external FROM sheet_rows) r USING (l_partkey)
         WHERE r.external AND r.l_partkey % 3 < 2 AND l.col <= 5 AND l."row" > 0) GROUP BY ALL""",
)
def _cell_links(f: Fixtures):
    """One link per row of a sheet, some to a missing cell, and later links to cells that may have one."""
    rows = f.sheet_rows()
    rel = F.concat(F.lit("rId"), "l_partkey")
    r = F.col("row").cast("string")
    ref = F.when(F.col("row") % 4 == 0, F.concat(F.lit("e"), r)).when(F.col("row") % 4 == 1, F.concat(F.lit("$E$"), r, F.lit(":D"), r))
    ref = ref.when(F.col("row") % 4 == 2, F.concat(F.lit("'Sheet'!A"), r)).otherwise(F.concat(F.lit("Z"), r))
    one = rows.select("sheet", F.col("row").cast("long").alias("ord"), ref.alias("ref"), rel.alias("rel_id"))
    again = rows.filter((F.col("row") % 20).isin(1, 2)).select(
        "sheet", (F.col("row") + 1_000_000).alias("ord"), F.concat(F.lit("E"), (F.col("row") - 1).cast("string")).alias("ref"), rel.alias("rel_id")
    )
    key = F.col("l_partkey")
    target = F.when(key % 3 == 0, F.concat(F.lit("https://parts.example/"), key)).when(
        key % 3 == 1, F.concat(F.lit("MAILTO:part"), key, F.lit("@parts.example"))
    ).otherwise(F.concat(F.lit("ftp://parts.example/"), key))
    rels = rows.select("sheet", rel.alias("rel_id"), target.alias("target"), (key % 7 != 0).alias("external")).distinct()
    return X.cell_links(f.cells(), one.unionByName(again), rels)


_HIT = """lower(concat_ws(' ', title, description, grp, keywords)) LIKE '%red%'
          AND lower(concat_ws(' ', title, description, grp, keywords)) LIKE '%o%'"""


@query(
    "search_topk",
    f"""SELECT ord, title, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score, ord) AS INTEGER) AS "rank" FROM (
          SELECT *, CASE WHEN lower(title) LIKE 'red%' THEN 0.0 WHEN lower(title) LIKE '%red%' THEN 1.0 ELSE 2.0 END
                    + length(title)::DOUBLE / 100 AS score
          FROM catalog WHERE {_HIT} ORDER BY score, ord LIMIT 25)""",
)
def _search(f: Fixtures):
    return X.search_topk(f.catalog(), " Red  o ", 25).select("ord", "title", F.round("score", 6).alias("score"), "rank")


_SUB = "lower(concat_ws(' ', title, description, grp)) LIKE '%widget economy%'"


@query(
    "substring_filter",
    f"""SELECT 'item' AS what, CAST(ord AS VARCHAR) AS id FROM catalog WHERE {_SUB}
        UNION ALL SELECT DISTINCT 'group', grp FROM catalog WHERE {_SUB}""",
)
def _substring(f: Fixtures):
    items, groups = X.substring_filter(f.catalog(), f.catalog().select("grp").distinct(), " Widget Economy ")
    return items.select(F.lit("item").alias("what"), F.col("ord").cast("string").alias("id")).unionByName(
        groups.select(F.lit("group").alias("what"), F.col("grp").alias("id"))
    )


@query("dedup_first", "SELECT title, min(ord) AS ord, arg_min(grp, ord) AS grp FROM catalog GROUP BY title")
def _dedup(f: Fixtures):
    return X.dedup_first(f.catalog(), "title", "ord").select("title", "ord", "grp")


@query(
    "ordered_lookup",
    """SELECT CAST(pos AS INTEGER) AS pos, title, min(ord) AS ord FROM catalog
       JOIN (VALUES (1, 'blue bolt'), (2, 'missing'), (3, 'red widget'), (4, 'small ring')) v(pos, title) USING (title)
       GROUP BY 1, 2""",
)
def _lookup(f: Fixtures):
    wanted = ["blue bolt", "missing", "red widget", "small ring"]
    return X.ordered_lookup(f.spark, wanted, f.catalog(), "title", "ord").select("pos", "title", "ord")


@query(
    "script_profile",
    r"""SELECT doc_id, regexp_matches(text, '[\x{0590}-\x{0DFF}\x{0E00}-\x{109F}\x{1780}-\x{18AF}\x{200C}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]') AS complex,
               NOT regexp_matches(text, '[^\x{00}-\x{E8}]') AS covered FROM documents""",
)
def _script(f: Fixtures):
    return f.t("documents").select("doc_id", X.script_profile("text", [(0, 0xE8)]).alias("p")).select("doc_id", "p.*")


@query(
    "coverage_join",
    """SELECT DISTINCT doc_id, face FROM cps JOIN (
         SELECT r_name AS face, 224 + 4 * r_regionkey AS a, 226 + 4 * r_regionkey AS b FROM region
         UNION ALL SELECT r_name, 48 + r_regionkey, 48 + r_regionkey FROM region) r ON cp BETWEEN a AND b""",
    """cps AS (SELECT DISTINCT doc_id, unicode(ch) AS cp FROM (
         SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?s).'))) AS ch FROM documents))""",
)
def _coverage(f: Fixtures):
    faces = f.t("region").selectExpr(
        "r_name AS face",
        "concat('U+', hex(224 + 4 * r_regionkey), '-', hex(226 + 4 * r_regionkey), ', u+', hex(48 + r_regionkey)) AS spec",
    )
    return X.coverage_join(X.code_points(f.t("documents")), X.parse_unicode_ranges(faces))


_TOKENS = r"""
page_lines AS (
  SELECT doc_id, page_no, len(ls) AS n_lines, greatest(1, list_max(list_transform(ls, lambda s: length(s)))) AS n_cols,
         generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, page_no, string_split(text, chr(10)) AS ls FROM doc_pages)),
pieces AS (
  SELECT *, generate_subscripts(ps, 1) AS tok_no, unnest(ps) AS piece
  FROM (SELECT *, regexp_extract_all(line, '\s*\S+') AS ps FROM page_lines)),
toks AS (
  SELECT doc_id, page_no, line_no, n_lines, n_cols, tok_no, ltrim(piece) AS token,
         sum(length(piece)) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY tok_no) - length(ltrim(piece)) AS x
  FROM pieces),
clean AS (
  SELECT * FROM (
    SELECT doc_id, page_no, greatest(0, least(x1, x2)) AS l, greatest(0, least(y1, y2)) AS t,
           least(1, greatest(x1, x2)) AS r, least(1, greatest(y1, y2)) AS b FROM boxes)
  WHERE r - l >= 0.004::DOUBLE AND b - t >= 0.004::DOUBLE),
masked AS (
  SELECT *, EXISTS (SELECT 1 FROM clean c WHERE c.doc_id = toks.doc_id AND c.page_no = toks.page_no
      AND c.l * n_cols < x + length(token) AND c.r * n_cols > x
      AND c.t < line_no / n_lines AND c.b > (line_no - 1) / n_lines) AS gone
  FROM toks)
"""


@query(
    "tokens",
    """SELECT doc_id, page_no, CAST(line_no AS INTEGER) AS line_no, CAST(tok_no AS INTEGER) AS tok_no, CAST(x AS INTEGER) AS x, token FROM toks""",
    _TOKENS,
)
def _tokens(f: Fixtures):
    return X.tokens(f.doc_pages()).select("doc_id", "page_no", "line_no", "tok_no", "x", "token")


@query(
    "redact",
    """SELECT p.doc_id, p.page_no, string_agg(coalesce(s, ''), chr(10) ORDER BY p.line_no) AS text, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_masked
       FROM page_lines p LEFT JOIN (
         SELECT doc_id, page_no, line_no, string_agg(CASE WHEN gone THEN repeat('█', length(token)) ELSE token END, ' ' ORDER BY tok_no) AS s,
                count(*) FILTER (WHERE gone) AS n FROM masked GROUP BY 1, 2, 3) m
         ON m.doc_id = p.doc_id AND m.page_no = p.page_no AND m.line_no = p.line_no
       GROUP BY 1, 2""",
    _TOKENS,
)
def _redact(f: Fixtures):
    return X.redact(f.doc_pages(), f.boxes())


@query(
    "lock_unlock",
    """SELECT doc_id, CASE WHEN error IS NULL AND doc_id % 5 <> 0 THEN text END AS text,
              coalesce(error, CASE WHEN doc_id % 5 = 0 THEN 'wrong-password' END) AS error
       FROM (SELECT doc_id, text, CASE WHEN length(pw) < 8 THEN 'password-too-short' WHEN length(pw) > 128 THEN 'password-too-long'
               WHEN doc_id % 11 = 0 THEN 'password-mismatch' END AS error
             FROM (SELECT doc_id, text, concat('pw', doc_id, repeat('x', CAST(doc_id % 7 * 21 AS INTEGER))) AS pw FROM documents))""",
)
def _lock(f: Fixtures):
    docs = f.t("documents").select("doc_id", "text").withColumn(
        "pw", F.expr("concat('pw', CAST(doc_id AS STRING), repeat('x', CAST(doc_id % 7 * 21 AS INT)))")
    )
    again = F.when(F.col("doc_id") % 11 == 0, F.concat("pw", F.lit("?"))).otherwise(F.col("pw"))
    locked = X.lock_column(docs, "text", F.col("pw"), again)
    tried = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("no"), F.col("pw"))).otherwise(F.col("pw"))
    tried = F.when(F.col("locked").isNull(), F.lit("irrelevant")).otherwise(tried)
    return X.unlock_column(locked, "locked", F.substring(tried, 1, 128)).select("doc_id", "text", "error")


@query(
    "flatten_fields",
    """SELECT event_id, key AS field, CAST(value AS VARCHAR) AS value, CAST(len(ks) AS BIGINT) AS n_fields, NULL::VARCHAR AS error
       FROM (SELECT event_id, json_keys(props) AS ks, unnest(json_keys(props)) AS key, props FROM events),
            LATERAL (SELECT json_extract_string(props, concat('$.', key)) AS value)
       UNION ALL SELECT event_id, NULL, NULL, 0, 'no-form-fields' FROM events WHERE len(json_keys(props)) = 0""",
)
def _flatten(f: Fixtures):
    return X.flatten_fields(f.t("events"), "props", "event_id").select("event_id", "field", "value", "n_fields", "error")


def _rules_sql(ruleset: str, strict: bool) -> str:
    low = "lower(message)"
    rules = list(X.RULES[ruleset])
    if ruleset == "pages" and not strict:
        rules.sort(key=lambda r: r[0][0] != "total-input-too-large")
    whens = [f"WHEN {low} = '{m}' THEN '{c}'" for m, c in X.EXACT.get(ruleset, {}).items()]
    for texts, code in rules:
        cond = " OR ".join("contains({}, '{}')".format(low, t.replace("'", "''")) for t in texts)
        whens.append(f"WHEN {cond} THEN '{code}'")
    other = "message" if X.FALLBACK[ruleset] is None else f"'{X.FALLBACK[ruleset]}'"
    return f"CASE {' '.join(whens)} ELSE {other} END"


@query(
    "classify_error",
    "SELECT event_id, "
    + ", ".join(f"{_rules_sql(r, False)} AS {r}" for r in X.RULES)
    + f", {_rules_sql('pages', True)} AS pages_strict FROM failures",
)
def _classify(f: Fixtures):
    cols = [X.classify_error("message", r).alias(r) for r in X.RULES]
    return f.failures().select("event_id", *cols, X.classify_error("message", "pages", strict=True).alias("pages_strict"))
