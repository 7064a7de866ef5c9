"""Resolution of not-modified revisits in web captures.

A revisit is joined to the latest strictly earlier full response of the same canonical URL. If a
validator confirms it (equal entity tags in the weak sense; without one on either side, equal
modification dates), the revisit takes that response's body and headers, with those
headers replaced that a not-modified answer may update.

The as-of join has no row of one URL meet in one task: rows are dealt by ranges of URL and
time, each range looks back in itself, and the last response of a URL's earlier
ranges, at most two rows per range, comes by a broadcast of that bound.

Defined cases: a null or empty URL, or a null time, never matches; of responses at the same time the
largest id counts; repeated rows are each resolved; a null header is absent and replaces nothing; an
empty table gives no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.session import materialise

# Headers that a 304 answer may send to update the stored response.
PERMITTED = ("cache_control", "content_location", "date", "etag", "expires", "vary", "last_modified")
# Query parameters that do not change the resource.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host in lower case without ``www.`` and default port, no
    fragment, tracking parameters or last slash. Null if nothing is left.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    rest = F.regexp_replace(rest, f"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?&]$", ""), "/$", "")
    whole = F.concat(host, rest)
    return F.when(F.length(whole) > 0, whole)


def canonical_url_sql(url: str) -> str:
    """The same in DuckDB."""
    u = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[^/?]*', 0)), '^www\\.', ''), ':(80|443)$', '')"
    rest = f"regexp_replace(regexp_replace({u}, '^[^/?]*', ''), '([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+', '\\1', 'g')"
    rest = f"regexp_replace(regexp_replace({rest}, '[?&]$', ''), '/$', '')"
    return f"nullif(concat({host}, {rest}), '')"


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(captures: DataFrame, headers: tuple[str, ...]) -> DataFrame:
    """Every capture with its canonical URL, the response it stands for and its headers.

    ``captures``: ``capture_id, url, ts, status, body`` (any identifier of the body) and
    one column per name in ``headers``, which include ``etag`` and ``last_modified``.
    Returns ``capture_id, canonical, ts, status, target_id, outcome, body`` and the headers;
    ``outcome`` is ``full``, ``resolved``, ``mismatch`` or ``orphan``.
    """
    rows = captures.select("capture_id", canonical_url(F.col("url")).alias("canonical"), "ts", "status", "body", *headers)
    rows = rows.repartitionByRange("canonical", "ts").withColumn("range", F.spark_partition_id())
    rows = materialise(rows, "captures")
    full = (F.col("status") != 304) & F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    answer = F.when(full, F.struct("ts", "capture_id", "body", *headers))
    look = Window.partitionBy("range", "canonical").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("local", F.max(answer).over(look))
    # URLs that reach over several ranges are the first or last of each: two a range at most.
    per_range = rows.where(F.col("canonical").isNotNull()).groupBy("canonical", "range").agg(F.max(answer).alias("last"))
    wide = per_range.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("canonical")
    back = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.join(wide, "canonical", "left_semi").select("canonical", "range", F.max("last").over(back).alias("carried"))
    inside = inside.join(F.broadcast(carried), ["canonical", "range"], "left")
    inside = inside.withColumn("target", F.when(F.col("status") == 304, F.coalesce("local", "carried")))
    tags = F.col("etag").isNotNull() & F.col("target.etag").isNotNull()
    agrees = F.when(tags, _weak(F.col("etag")) == _weak(F.col("target.etag"))).otherwise(F.col("last_modified") == F.col("target.last_modified"))
    outcome = (
        F.when(F.col("status").isNull() | (F.col("status") != 304), "full")
        .when(F.col("target").isNull(), "orphan")
        .when(agrees, "resolved")
        .otherwise("mismatch")
    )
    inside = inside.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"

    def merged(name: str) -> Column:
        kept = F.coalesce(name, f"target.{name}") if name in PERMITTED else F.col(f"target.{name}")
        return F.when(done, kept).otherwise(F.col(name)).alias(name)

    return inside.select(
        "capture_id", "canonical", "ts", "status",
        F.when(done, F.col("target.capture_id")).alias("target_id"), "outcome",
        F.when(done, F.col("target.body")).otherwise(F.col("body")).alias("body"), *map(merged, headers),
    )


HEADERS = ("etag", "last_modified", "cache_control", "content_type", "expires")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl derived from the pages: each is fetched in full and visited again later.

    The later visit may use another form of the URL. A quarter of the entities
    changed meanwhile by their tag, an eighth are known by their date alone, and
    as many were visited again before they were first fetched.
    """
    kind = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 1)) % 8
    day = F.col("page_id") % 28 + 1
    date = F.concat(F.lit("2024-01-"), F.lpad(day.cast("string"), 2, "0"))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit(""))), 1, 16), F.lit('"'))
    text = lambda c: F.lit(c).cast("string")
    first = pages.select(
        (F.col("page_id") * 2).alias("capture_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit(200).alias("status"),
        F.md5(F.coalesce(F.col("html"), F.lit(""))).alias("body"),
        F.when(kind != 7, tag).alias("etag"), date.alias("last_modified"), text("max-age=60").alias("cache_control"),
        text("text/html").alias("content_type"), text(None).alias("expires"),
    )
    other = F.when(kind == 3, F.concat(F.lit("HTTP://"), F.regexp_replace("url", "^https?://", ""))).otherwise(F.concat(F.col("url"), F.lit("#again")))
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("capture_id"), other.alias("url"),
        (F.col("page_id") * 10 + F.when(kind == 6, -5).otherwise(5000)).alias("ts"), F.lit(304).alias("status"), text(None).alias("body"),
        F.when(kind < 2, F.lit('"changed"')).when(kind == 2, F.concat(F.lit("W/"), tag)).when(kind != 7, tag).alias("etag"),
        date.alias("last_modified"), text("max-age=300").alias("cache_control"), text("text/plain").alias("content_type"),
        F.when(kind == 4, F.lit("2025-01-01")).alias("expires"),
    )
    return first.unionByName(again)


PAGES_SQL = f"""
WITH p AS (
    SELECT page_id, url, html, md5(coalesce(html, '')) AS hash,
           '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS day FROM pages
), kinds AS (
    SELECT *, strpos('0123456789abcdef', md5(coalesce(url, ''))[1:1]) % 8 AS kind FROM p
), captures AS (
    SELECT page_id * 2 AS capture_id, url, page_id * 10 AS ts, 200 AS status, hash AS body,
           CASE WHEN kind <> 7 THEN '"' || hash[1:16] || '"' END AS etag, day AS last_modified,
           'max-age=60' AS cache_control, 'text/html' AS content_type, CAST(NULL AS VARCHAR) AS expires FROM kinds
    UNION ALL
    SELECT page_id * 2 + 1, CASE WHEN kind = 3 THEN 'HTTP://' || regexp_replace(url, '^https?://', '') ELSE url || '#again' END,
           page_id * 10 + CASE WHEN kind = 6 THEN -5 ELSE 5000 END, 304, NULL,
           CASE WHEN kind < 2 THEN '"changed"' WHEN kind = 2 THEN 'W/"' || hash[1:16] || '"' WHEN kind <> 7 THEN '"' || hash[1:16] || '"' END,
           day, 'max-age=300', 'text/plain', CASE WHEN kind = 4 THEN '2025-01-01' END FROM kinds
), c AS (
    SELECT *, {canonical_url_sql("url")} AS canonical FROM captures
), best AS (
    SELECT r.capture_id AS id, max(struct_pack(ts := f.ts, cid := f.capture_id)) AS t
    FROM c r JOIN c f ON f.canonical = r.canonical AND f.ts < r.ts AND f.status <> 304 WHERE r.status = 304 GROUP BY 1
), joined AS (
    SELECT c.*, f.capture_id AS fid, f.body AS fbody, f.etag AS fetag, f.last_modified AS fmod, f.cache_control AS fcache,
           f.content_type AS ftype, f.expires AS fexp,
           CASE WHEN c.status <> 304 THEN 'full' WHEN f.capture_id IS NULL THEN 'orphan'
                WHEN CASE WHEN c.etag IS NOT NULL AND f.etag IS NOT NULL THEN regexp_replace(c.etag, '^W/', '') = regexp_replace(f.etag, '^W/', '')
                     ELSE c.last_modified = f.last_modified END THEN 'resolved' ELSE 'mismatch' END AS outcome
    FROM c LEFT JOIN best b ON b.id = c.capture_id LEFT JOIN c f ON f.capture_id = b.t.cid
)
SELECT capture_id, canonical, ts, status, CASE WHEN outcome = 'resolved' THEN fid END AS target_id, outcome,
       CASE WHEN outcome = 'resolved' THEN fbody ELSE body END AS body,
       CASE WHEN outcome = 'resolved' THEN coalesce(etag, fetag) ELSE etag END AS etag,
       CASE WHEN outcome = 'resolved' THEN coalesce(last_modified, fmod) ELSE last_modified END AS last_modified,
       CASE WHEN outcome = 'resolved' THEN coalesce(cache_control, fcache) ELSE cache_control END AS cache_control,
       CASE WHEN outcome = 'resolved' THEN ftype ELSE content_type END AS content_type,
       CASE WHEN outcome = 'resolved' THEN coalesce(expires, fexp) ELSE expires END AS expires
FROM joined
"""
