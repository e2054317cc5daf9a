"""The training-data operators as named queries over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, decontam, importance, jaccard, lines, lm, neighbours, packing, quality, repeats, urls, warc, wavelet
from .storage import read_documents, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    @wraps(run)
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = shipped
    return shipped


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_wavelet_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_documents(spark, folder)
    manifest = wavelet.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"))
    read = wavelet.read_shards(manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_warc_zstd(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_archives(read_documents(spark, folder, "pages"))
    read = warc.read_archives(manifest)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op8_warc_zstd"] = """
with pages_ as (
    select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages
), last as (
    select hex, max(page_id) as response from pages_ group by hex
)
select
    page_id,
    strlen(body) as payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 +
        ((cast('0x' || substr(hex, cast(1 + 10 * (i // 8) as int), 10) as bigint) >> cast(35 - 5 * (i % 8) as int)) & 31)
        as int), 1)), 'string_agg', '') as payload_digest,
    case when page_id is not distinct from response then 'response' else 'revisit' end as record_type,
    case when page_id is not distinct from response then null else response end as refers_to
from pages_ join last using (hex)
"""


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetching in 2024, which follows from their number."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("day"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries over the pages' own hosts: spam hosts, adult domains, allowed sections.

    What is listed and when follows from a hash of the pattern, so SQL can make the same lists.
    """
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c)
    section = F.regexp_extract(urls.place("url"), r"^[^/]+/[^/]+", 0)
    patterns = pages.select(urls.host("url").alias("host"), section.alias("section")).distinct()
    patterns = patterns.where("host is not null")
    hosts = patterns.select(F.col("host").alias("pattern")).distinct().withColumn("h", number("pattern"))
    domains = patterns.select(F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1).alias("pattern")).distinct()
    domains = domains.where("pattern <> ''").withColumn("h", number("pattern"))
    sections = patterns.select(F.col("section").alias("pattern")).distinct().where("pattern <> ''")
    sections = sections.withColumn("h", number("pattern"))
    entry = lambda rows, name, allows, at, action: rows.select(
        F.lit(name).alias("list"), F.lit(allows).alias("allows"), "pattern", day(at).alias("day"), F.lit(action).alias("action")
    )
    h = F.col("h")
    parts = [
        entry(hosts.where("h % 4 = 0"), "spam", False, h % 200, "add"),
        entry(hosts.where("h % 12 = 0"), "spam", False, h % 200 + 40, "remove"),
        entry(hosts.where("h % 24 = 0"), "spam", False, h % 200 + 90, "add"),
        entry(domains.where("h % 5 = 1"), "adult", False, h % 365, "add"),
        entry(sections.where("h % 3 = 0"), "sections", True, h % 300, "add"),
        entry(sections.where("h % 6 = 0"), "sections", True, h % 300 + 60, "remove"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def op6_url_lists_as_of(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_documents(spark, folder, "pages").select("page_id", "url")
    return urls.as_of(page_captures(pages), urls.intervals(page_lists(pages)))


ORACLES["op6_url_lists_as_of"] = r"""
with parsed as (
    select page_id, url, date '2024-01-01' + cast(page_id % 366 as int) as day,
        nullif(regexp_replace(lower(regexp_replace(regexp_replace(
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\.$', ''), '') as host,
        regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path
    from pages
), hosts as (
    select pattern, cast('0x' || substr(md5(pattern), 1, 6) as int) as h
    from (select distinct host as pattern from parsed where host is not null)
), domains as (
    select pattern, cast('0x' || substr(md5(pattern), 1, 6) as int) as h
    from (select distinct regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1) as pattern from parsed where host is not null)
    where pattern <> ''
), sections as (
    select pattern, cast('0x' || substr(md5(pattern), 1, 6) as int) as h
    from (select distinct regexp_extract(host || path, '^[^/]+/[^/]+') as pattern from parsed where host is not null)
    where pattern <> ''
), entries as (
    select 'spam' as list, false as allows, pattern, date '2024-01-01' + h % 200 as day, 0 as off from hosts where h % 4 = 0
    union all select 'spam', false, pattern, date '2024-01-01' + (h % 200 + 40), 1 from hosts where h % 12 = 0
    union all select 'spam', false, pattern, date '2024-01-01' + (h % 200 + 90), 0 from hosts where h % 24 = 0
    union all select 'adult', false, pattern, date '2024-01-01' + h % 365, 0 from domains where h % 5 = 1
    union all select 'sections', true, pattern, date '2024-01-01' + h % 300, 0 from sections where h % 3 = 0
    union all select 'sections', true, pattern, date '2024-01-01' + (h % 300 + 60), 1 from sections where h % 6 = 0
), latest as (
    -- as of each capture: the last entry of every list and pattern that covers it
    select p.page_id, p.url, p.day, e.list, e.allows, e.pattern,
        arg_max(e.off, (e.day, e.off)) as off,
        max(e.day) filter (where e.off = 1) as removed
    from parsed p join entries e
        on e.day <= p.day
        and (p.host = e.pattern
            or (suffix(p.host, '.' || e.pattern) and not regexp_matches(p.host, '^[0-9.]+$|^\['))
            or p.host || p.path = e.pattern or starts_with(p.host || p.path, e.pattern || '/'))
    group by all
), active as (
    select l.*, (select min(e.day) from entries e where e.list = l.list and e.pattern = l.pattern and e.off = 0
        and e.day <= l.day and (l.removed is null or e.day > l.removed)) as since
    from latest l where off = 0
), ranked as (
    select *, row_number() over (partition by page_id, url, day order by length(pattern) desc, allows desc, list desc, pattern desc, since desc) as place
    from active
)
select p.page_id, p.url, p.day, case when r.allows then 'allow' when not r.allows then 'block' end as verdict,
    r.list, r.pattern, r.since
from parsed p left join ranked r on r.place = 1 and p.page_id = r.page_id and p.url = r.url and p.day = r.day
"""


@query
def op2_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.judged(read_documents(spark, folder), ["doc_id"])
    return rows.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query
def op10_pigeonhole_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.matches(read_documents(spark, folder), read_documents(spark, folder, "benchmark"))


@query
def op5_partition_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked(read_documents(spark, folder))


@query
def op4_segment_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.deduplicated(read_documents(spark, folder), graded=True)
    kept = F.col("kept_text")
    return rows.select(
        "row.doc_id", "n_lines", "n_near", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256")
    )


@query
def op7_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    rows = repeats.removed(read_documents(spark, folder), keep="none")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select(
        "row.doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op3_elias_fano_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scored(read_documents(spark, folder), lm.seventh())


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.interactions(read_documents(spark, folder), read_documents(spark, folder, "labels"))


ORACLES["op13_filter_audit"] = r"""
with words as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents
), flags as (
    select part, text,
        cast(len(words) < 200 as int) as a,
        cast(100 * len(list_distinct(words)) < 50 * len(words) as int) as b,
        cast(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) as int) as c,
        cast(regexp_matches(text, '[#$%&*|]') as int) as d,
        coalesce(cast(doc_id > min(doc_id) over (partition by text) as int), 0) as e,
        doc_id in (select doc_id from labels where quality = 1) is true as good,
        doc_id in (select doc_id from labels where toxic = 1) is true as toxic
    from words
), masked as (
    select part, a + 2 * b + 4 * c + 8 * d + 16 * e as mask, count(*) as n, count_if(good) as good, count_if(toxic) as toxic
    from flags group by all
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as bit
), orders as (
    select v.letter || w.letter || x.letter || y.letter || z.letter as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits
    from letters v, letters w, letters x, letters y, letters z
    where v.bit + w.bit + x.bit + y.bit + z.bit = 31 and (v.bit | w.bit | x.bit | y.bit | z.bit) = 31
), steps as (
    select filter_order, cast(step as int) as step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0) as before
    from orders, range(1, 6) r(step)
), counted as (
    select p.part, s.filter_order, s.step, s.bit,
        coalesce(sum(n) filter (where mask & cast(s.before + s.bit as int) = 0), 0) as kept,
        coalesce(sum(n) filter (where mask & s.bit <> 0 and mask & cast(s.before as int) = 0), 0) as removed,
        coalesce(sum(n) filter (where mask & s.bit <> 0 and mask & cast(s.before as int) <> 0), 0) as redundant,
        coalesce(sum(n) filter (where mask = s.bit), 0) as unique_fails,
        coalesce(sum(good) filter (where mask & s.bit <> 0 and mask & cast(s.before as int) = 0), 0) as good_lost,
        coalesce(sum(toxic) filter (where mask & s.bit <> 0 and mask & cast(s.before as int) = 0), 0) as toxic_lost
    from steps s, (select distinct part from masked) p left join masked m on m.part = p.part
    group by all
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
    cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
    cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from counted
"""


@query
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resampled(read_documents(spark, folder), read_documents(spark, folder, "benchmark"))


ORACLES["op12_importance_resampling"] = r"""
with crcs as (
    select list(c order by i) as crcs from (
        select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from range(256) r(i))
), texts as (
    select 'corpus' as kind, doc_id, text from documents union all select 'target', null, text from benchmark
), words as (
    select row_number() over () as n, kind, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from texts
), features as (
    select n, kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f
    from words
), coded as (
    select f, xor(list_reduce(
            list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: cast('0x' || h[i:i + 1] as bigint))),
            lambda c, x: xor(c >> 8, crcs[xor(c & 255, x) + 1])), 4294967295) % 10000 as bucket
    from (select f, hex(encode(f)) as h from (select distinct f from features)), crcs
), placed as (
    select n, kind, bucket from features join coded using (f)
), buckets as (
    select b as bucket, count_if(kind = 'corpus') as s, count_if(kind = 'target') as t
    from range(10000) r(b) left join placed on placed.bucket = b group by all
), gains as (
    select bucket, cast(floor(1000 * ln(cast(t + 1 as double) * (sum(s) over () + 10000) / (cast(s + 1 as double) * (sum(t) over () + 10000)))) as bigint) as gain
    from buckets
), weights as (
    select n, count(*) as n_features, sum(gain) as weight from placed join gains using (bucket) where kind = 'corpus' group by n
), scored as (
    select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
        cast(coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
    from words left join weights using (n) where kind = 'corpus'
), ranked as (
    select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as place, count(*) over (partition by n_words >= 20) as everyone
    from scored
)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * everyone // 100 then place end as rank, n_words from ranked
"""


@query
def op11_neighbour_quality(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.scored(read_documents(spark, folder), read_documents(spark, folder, "labels"))
