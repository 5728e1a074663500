"""Not-modified revisit records resolved to the full response they stand for.

A revisit holds no body: the server said that what an earlier capture of the URL holds is still right. Each
revisit is joined as of its time with the latest earlier full response of the same canonical URL. If the
validators of both agree, the resolved record takes that response's body and headers and replaces those headers
that a not-modified answer may update by the revisit's own.

As of a time, per URL: responses are first reduced to their latest per URL and day, a running maximum over a
URL's days carries the latest one into each later day, and only records of the same URL and day are ordered
among themselves. So a URL with very many captures is spread over its days. Bodies move once, in the last join.

Defined results: a response needs status 200 to 299, a URL and a time; earlier means a strictly smaller time,
and of responses at the same time the larger record_id counts (then the larger row key, null ids before all). A revisit without an earlier response is
`no_earlier_response`; one whose etag (else last-modified, else payload digest) differs from the response's, or
where no such pair is there to compare, is `validator_mismatch`; both keep their own headers and no body. Weak
and strong forms of an etag compare equal. A row is known by a digest of all that is read of it, so rows that agree in
everything count once, and rows that share a record_id but differ, or have none, are revisits or responses of their
own. Null url or time gives `no_earlier_response`. Columns other than those named are not read; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlab.llm import common

# Headers that a not-modified answer may update in the stored response.
UPDATABLE = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that don't change what a URL names.
IGNORED_PARAMETERS = "^(utm_[a-z]+|ref|sessionid|phpsessid)="
DAY = 86_400
# Seconds between the versions of a page in the registered query's captures.
VERSION_GAP = 172_801

_ORIGIN = "^[a-zA-Z][a-zA-Z0-9+.-]*://"


def canonical_url(url: str = "url") -> Column:
    """Host without www and default port, path without closing slash, sorted parameters that matter."""
    whole = F.regexp_replace(F.col(url), "#.*$", "")
    host = F.lower(F.regexp_extract(whole, _ORIGIN + "([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(whole, _ORIGIN + "[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    kept = F.filter(
        F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(IGNORED_PARAMETERS))
    )
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolved(records: DataFrame) -> DataFrame:
    """One row for each revisit of `records`.

    `records`: record_id, url, ts (seconds), type (`response` or `revisit`), status, etag, last_modified, digest,
    headers (map of lower-case names), body.
    """
    read = F.struct(
        F.col("record_id").cast("long").alias("record_id"), "url", F.col("ts").cast("long").alias("ts"), "type", "status",
        "etag", "last_modified", "digest", F.array_sort(F.map_entries("headers")).alias("headers"),
        F.md5("body").alias("body"),
    )
    keyed = records.withColumns(
        {
            "record_id": F.col("record_id").cast("long"), "ts": F.col("ts").cast("long"),
            "key": F.unhex(F.md5(F.to_json(read))),
        }
    )
    day = F.floor(F.col("ts") / DAY)
    answers = keyed.where("type = 'response' and status between 200 and 299 and url is not null and ts is not null")
    # Rows without bodies, read several times below.
    narrow = common.saved(
        keyed.where("type = 'revisit'")
        .select("key", "record_id", "url", "ts", "etag", "last_modified", "digest", "headers", F.lit(True).alias("asks"))
        .unionByName(answers.select("key", "record_id", "url", "ts", F.lit(False).alias("asks")), allowMissingColumns=True)
        .withColumn("canonical", canonical_url())
        .drop("url")
    )
    full = narrow.where("not asks")
    revisits = narrow.where("asks").dropDuplicates(["key"])

    latest = F.struct("ts", "record_id", "key")
    times = full.select("canonical", day.alias("day"), "ts", "record_id", "key")
    daily = times.groupBy("canonical", "day").agg(F.max(latest).alias("latest"))
    asked = revisits.where("canonical is not null and ts is not null").select(
        "canonical", day.alias("day"), "ts", F.col("key").alias("of")
    )
    # The latest response of all earlier days, for each day that a URL is asked about or answered on.
    none = F.lit(None).cast("struct<ts:bigint,record_id:bigint,key:binary>")
    days = daily.unionByName(asked.groupBy("canonical", "day").agg(none.alias("latest")))
    days = days.groupBy("canonical", "day").agg(F.max("latest").alias("latest"))
    before = Window.partitionBy("canonical").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("carried", F.max("latest").over(before)).select("canonical", "day", "carried")
    events = times.unionByName(asked, allowMissingColumns=True)
    earlier = Window.partitionBy("canonical", "day").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    same_day = F.max(F.when(F.col("key").isNotNull(), latest)).over(earlier)
    matched = events.withColumn("same_day", same_day).where("of is not null")
    matched = matched.join(carried, ["canonical", "day"], "left").select(
        F.col("of").alias("key"), F.coalesce("same_day.key", "carried.key").alias("response_key")
    )

    needed = matched.where("response_key is not null").select("response_key").distinct()
    bodies = answers.join(needed, F.col("key") == F.col("response_key"), "left_semi").dropDuplicates(["key"])
    bodies = bodies.select(
        F.col("key").alias("response_key"),
        F.struct("record_id", "ts", "etag", "last_modified", "digest", "headers", "body").alias("r"),
    )
    joined = revisits.join(matched, "key", "left").join(bodies, "response_key", "left")
    same = F.coalesce(
        _strong(F.col("etag")) == _strong(F.col("r.etag")),
        F.col("last_modified") == F.col("r.last_modified"),
        F.col("digest") == F.col("r.digest"),
        F.lit(False),
    )
    outcome = (
        F.when(F.col("response_key").isNull(), "no_earlier_response").when(same, "resolved").otherwise("validator_mismatch")
    )
    joined = joined.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    updates = F.map_filter(own, lambda name, value: name.isin(UPDATABLE))
    stored = F.coalesce("r.headers", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(stored, lambda name, value: ~F.map_contains_key(updates, name))
    return joined.select(
        "record_id", F.col("canonical").alias("canonical_url"), "ts", "outcome",
        F.when(good, F.col("r.record_id")).alias("response_id"), F.when(good, F.col("r.ts")).alias("response_ts"),
        F.when(good, F.map_concat(kept, updates)).otherwise(own).alias("headers"), F.when(good, F.col("r.body")).alias("body"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures of a crawl derived from the pages table, five of each page over a month and some days more.

    Three are full responses, on different days and with different etags: the page, its first half, and a short
    notice. Two came back as not modified, some of them before any response. They name the version of their time by
    etag, last-modified or digest; every seventh page's etags are others.
    """
    id_, first = F.col("page_id"), F.col("page_id") * 7919 % 2_592_000
    kind, version, ts = F.col("kind"), F.col("version"), F.col("ts")
    rows = pages.select("page_id", "url", "html", F.explode(F.array(*map(F.lit, range(5)))).alias("kind"))
    since = F.when(kind == 3, (id_ % 5 - 1) * 43_200).when(kind == 4, id_ % 9 * 43_200 + 7).otherwise(kind * VERSION_GAP)
    rows = rows.withColumn("ts", first + since)
    at_time = F.greatest(F.lit(0), F.least(F.lit(2), F.floor((ts - first - 1) / VERSION_GAP)))
    rows = rows.withColumn("version", F.when(kind < 3, kind).otherwise(at_time).cast("long"))
    half = F.substring("html", F.lit(1), F.floor(F.length("html") / 2).cast("int"))
    notice = F.concat(F.lit("moved "), id_.cast("string"))
    rows = rows.withColumn("held", F.when(version == 0, F.col("html")).when(version == 1, half).otherwise(notice))
    full, named_by = kind < 3, (id_ + kind) % 4
    etag = F.concat(F.lit('"'), id_.cast("string"), F.lit("-"), version.cast("string"), F.lit('"'))
    seen = F.when(id_ % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), etag))
    modified = (first + version * VERSION_GAP).cast("string")
    date = [F.lit("date"), ts.cast("string")]
    answered = F.create_map(
        *date, F.lit("content-type"), F.lit("text/html"), F.lit("etag"), etag, F.lit("last-modified"), modified,
        F.lit("server"), F.lit("origin"),
    )
    return rows.select(
        (id_ * 5 + kind).alias("record_id"),
        F.concat("url", F.when(kind > 1, F.lit("#again")).otherwise("")).alias("url"), "ts",
        F.when(full, "response").otherwise("revisit").alias("type"), F.when(full, 200).otherwise(304).alias("status"),
        F.when(full, etag).when(named_by < 2, seen).alias("etag"),
        F.when(full | (named_by == 2), modified).alias("last_modified"),
        F.when(full | (named_by == 3), F.md5("held")).alias("digest"),
        F.when(full, answered).otherwise(
            F.create_map(*date, F.lit("server"), F.lit("edge"), F.lit("vary"), F.lit("accept"))
        ).alias("headers"),
        F.when(full, F.col("held")).alias("body"),
    )


def revisit_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query over all pages: every revisit with its response, merged headers and a digest of the body."""
    found = resolved(records_of_pages(common.table(spark, sf_dir, "pages")))
    named = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select(
        "record_id", "canonical_url", "ts", "outcome", "response_id", "response_ts",
        F.array_join(named, ";").alias("headers"), F.md5("body").alias("body_md5"),
        F.length("body").cast("long").alias("body_chars"),
    )


SQL = r"""
WITH kinds AS (
  SELECT page_id AS p, url, html, page_id * 7919 % 2592000 AS t0, unnest([0, 1, 2, 3, 4]) AS kind FROM pages
), timed AS (
  SELECT *, t0 + CASE kind WHEN 3 THEN (p % 5 - 1) * 43200 WHEN 4 THEN p % 9 * 43200 + 7 ELSE kind * 172801 END AS ts
  FROM kinds
), versions AS (
  SELECT *, CASE WHEN kind < 3 THEN kind
    ELSE greatest(0, least(2, CAST(floor((ts - t0 - 1) / 172801.0) AS BIGINT))) END AS v FROM timed
), held AS (
  SELECT *, CASE v WHEN 0 THEN html WHEN 1 THEN substr(html, 1, length(html) // 2) ELSE 'moved ' || p END AS body,
    '"' || p || '-' || v || '"' AS version_etag, (p + kind) % 4 AS named_by
  FROM versions
), captures AS (
  SELECT p * 5 + kind AS record_id, url || CASE WHEN kind > 1 THEN '#again' ELSE '' END AS url, ts,
    CASE WHEN kind < 3 THEN 'response' ELSE 'revisit' END AS type,
    CASE WHEN kind < 3 THEN version_etag WHEN named_by < 2 AND p % 7 = 0 THEN '"other"'
      WHEN named_by < 2 THEN 'W/' || version_etag END AS etag,
    CASE WHEN kind < 3 OR named_by = 2 THEN CAST(t0 + v * 172801 AS VARCHAR) END AS last_modified,
    CASE WHEN kind < 3 OR named_by = 3 THEN md5(body) END AS digest, body
  FROM held
), parts AS (
  SELECT *, regexp_replace(url, '#.*$', '') AS whole FROM captures
), split AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(whole, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)', 1)),
      '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(whole, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*', '') AS rest
  FROM parts
), named AS (
  SELECT *, host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '')
    || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url
  FROM (
    SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|sessionid|phpsessid)='))), '&') AS query
    FROM split
  ) AS q
), matched AS (
  SELECT v.record_id, v.canonical_url, v.ts, v.etag, v.last_modified, v.digest, r.record_id AS rid, r.ts AS rts,
    r.etag AS retag, r.last_modified AS rmodified, r.digest AS rdigest, r.body AS rbody,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC NULLS LAST) AS n
  FROM (SELECT * FROM named WHERE type = 'revisit') AS v
  LEFT JOIN (SELECT * FROM named WHERE type = 'response') AS r
    ON r.canonical_url = v.canonical_url AND r.ts < v.ts
), judged AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_earlier_response'
    WHEN coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', ''), last_modified = rmodified,
      digest = rdigest, false) THEN 'resolved'
    ELSE 'validator_mismatch' END AS outcome
  FROM matched WHERE n = 1
)
SELECT record_id, canonical_url, ts, outcome,
  CASE WHEN outcome = 'resolved' THEN rid END AS response_id,
  CASE WHEN outcome = 'resolved' THEN rts END AS response_ts,
  CASE WHEN outcome = 'resolved'
    THEN 'content-type=text/html;date=' || ts || ';etag=' || retag || ';last-modified=' || rmodified || ';server=origin;vary=accept'
    ELSE 'date=' || ts || ';server=edge;vary=accept' END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(rbody) END AS body_md5,
  CASE WHEN outcome = 'resolved' THEN length(rbody) END AS body_chars
FROM judged
"""
