"""The contract queries of this package, each a thin cover of its operator, and their SQL where SQL can tell the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, jaccard, line_dedup, mixing, quality, sharding, tokens, toxicity, warc
from millrace.operators.shared import settle
from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op1_sharding(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, d, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, d, "documents")).select("doc_id", "line_no", "kept")


def capture_records(pages: DataFrame) -> DataFrame:
    """Eight captures of each page's URL, since the table has no revisits: responses and not-modified answers over time,
    the URL in several spellings, validators that change or are missing, headers. A hash of page and capture decides."""
    k, h = F.col("k"), F.col("h")
    digit = lambda at, base: F.pmod(F.shiftright(h, at), F.lit(base))
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("md5")).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    rows = rows.withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("-", "page_id", "k").cast("binary")), 1, 7), 16, 10).cast("bigint"))
    # captures overlap in time: the order of ts isn't that of record_id
    rows = rows.withColumn("ts", F.when(digit(0, 41) > 0, k * 10 + digit(3, 25)).cast("bigint"))
    version = F.floor(F.coalesce("ts", F.lit(0)) / 30).cast("string")
    head = F.regexp_extract("url", "^[^:]*://[^/?#]*", 0)
    rest = F.col("url").substr(F.length(head) + 1, F.length("url"))
    port = F.when(head.startswith("https:"), ":443").otherwise(":80")
    spelt = F.when(digit(6, 4) == 0, F.concat(F.upper(head), rest)).when(digit(6, 4) == 1, F.concat(head, port, rest))
    spelt = spelt.when(digit(6, 4) == 2, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#c"), k.cast("string"))).otherwise(F.col("url"))
    etag = F.when(digit(8, 5) > 0, F.concat("md5", F.lit("-"), version))
    pairs = {"content-type": F.concat(F.lit("text/html;v="), version), "date": F.col("ts").cast("string"), "etag": etag, "cache-control": F.when(digit(11, 2) > 0, F.concat(F.lit("max-age="), k.cast("string")))}
    # no higher-order function, which would take the projection out of code generation
    none = F.create_map().cast("map<string,string>")
    headers = F.map_concat(*[F.when(v.isNotNull(), F.create_map(F.lit(name), v)).otherwise(none) for name, v in pairs.items()])
    return rows.select(
        (F.col("page_id") * 8 + k).alias("record_id"), spelt.alias("url"), "ts", F.when(digit(13, 3) == 0, "response").otherwise("revisit").alias("kind"),
        etag.alias("etag"), F.when(digit(15, 3) > 0, version).alias("last_modified"), F.when(digit(17, 6) > 0, headers).alias("headers"),
    )


def op3_revisits(spark: SparkSession, d: str) -> DataFrame:
    """Headers as JSON, sorted by name. The derived records are written first, as a table that the operator reads."""
    found = warc.resolve_revisits(settle(capture_records(table(spark, d, "pages")), "captures"))
    headers = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers"))))
    return found.select("record_id", "response_id", "resolved", "checked", headers.alias("headers"))


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    n_items = F.size("items").cast("bigint")
    return found.select(
        "doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"),
    )


def op8_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_table(table(spark, d, "documents"))


def token_table(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = tokens.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.documents_of(tokens.read_tokens(docs.sparkSession, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, d, "documents"))


QUERIES |= {f.__name__: f for f in (op1_sharding, op2_line_dedup, op3_revisits, op4_mixing, op5_quality, op6_toxicity, op7_decontamination, op8_jaccard, op9_tokens, op10_exact_dedup)}

SQL["op10_exact_dedup"] = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents),
g as (select doc_id, sha256(n) as text_sha256, min(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
""".strip()

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op7_decontamination"] = rf"""
with b as (select coalesce(cast(item_id as varchar), 'null') as id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct id, least(len(w), 8) as n, w[i : i + least(len(w), 8) - 1] as g from b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as t(i) where len(w) > 0),
d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
places as (select doc_id, i, n, w[i : i + n - 1] as g from d, (select distinct n from win), unnest(range(1, len(w) - n + 2)) as t(i) where len(w) >= n),
hit as (select doc_id, i, n, id from places join win using (n, g)),
words as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(i, i + n)) as t(p) group by 1),
items as (select doc_id, count(distinct id) as n_items, string_agg(distinct id, ',' order by id) as ids from hit group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
coalesce(n_items, 0) >= 2 as contaminated from d left join words using (doc_id) left join items using (doc_id)
""".strip()

SQL["op8_jaccard"] = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (g) where x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from n union select r.a, e.b from r join e on r.b = e.a)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(m, doc_id) as component_id
from d left join n using (doc_id) left join (select a as doc_id, min(b) as m from r group by 1) using (doc_id)
""".strip()

SQL["op2_line_dedup"] = r"""
with l as (select doc_id, pos - 1 as no, line from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents) where line <> ''),
o as (select *, row_number() over (order by doc_id nulls first, no) as r from l),
d as (select line, length(line) as n, min(r) as r from o group by line),
k as (select line, n, r, m, left(line, m // 2) as part, 0 as side from (select *, unnest([n, n - 1]) as m from d) where m > 0
union all select line, n, r, m, right(line, m - m // 2), 1 from (select *, unnest([n, n - 1]) as m from d) where m > 0),
p as (select distinct x.line as x, y.line as y from k x join k y using (m, part, side) where y.r < x.r and least(x.n, y.n) = m),
s as (select x, if(length(x) < length(y), x, y) as a, if(length(x) < length(y), y, x) as b from p),
near as (select distinct x from s where len(list_filter(range(length(b)), lambda i: left(b, i) = left(a, i)
and substr(b, i + 2) = if(length(a) = length(b), substr(a, i + 2), substr(a, i + 1)))) > 0)
select doc_id, cast(no as int) as line_no, o.r = d.r and near.x is null as kept from o join d using (line) left join near on near.x = o.line
""".strip()

SQL["op3_revisits"] = r"""
with p as (select page_id, url, md5(coalesce(html, '')) as md, unnest(range(8)) as k from pages),
h as (select *, cast('0x' || substr(md5(page_id || '-' || k), 1, 7) as bigint) as h, regexp_extract(url, '^[^:]*://[^/?#]*') as head from p),
t as (select *, if(h % 41 > 0, k * 10 + (h >> 3) % 25, null) as ts, substr(url, length(head) + 1) as rest from h),
v as (select *, cast(coalesce(ts, 0) // 30 as varchar) as ver from t),
c as (select page_id * 8 + k as record_id, ts, (h >> 13) % 3 = 0 as response, if((h >> 8) % 5 > 0, md || '-' || ver, null) as etag, if((h >> 15) % 3 > 0, ver, null) as modified,
(h >> 17) % 6 > 0 as has, 'text/html;v=' || ver as kind, cast(ts as varchar) as date, if((h >> 11) % 2 > 0, 'max-age=' || k, null) as cache,
case (h >> 6) % 4 when 0 then upper(head) || rest when 1 then head || if(starts_with(head, 'https:'), ':443', ':80') || rest
when 2 then regexp_replace(url, '#.*$', '') || '#c' || k else url end as url from v),
b as (select *, regexp_replace(trim(url), '#.*$', '') as bare from c),
s as (select *, regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*') as site from b),
u as (select *, regexp_replace(regexp_replace(lower(site), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || if(substr(bare, length(site) + 1, 1) = '/', '', '/') || substr(bare, length(site) + 1) as page,
row_number() over (order by ts, record_id) as at from s),
j as (select x.*, y.record_id as response_id, y.etag as e, y.modified as m, y.has as h, y.kind as k, y.date as d, y.cache as a from (select * from u where not response) x
asof left join (select * from u where response and url is not null and ts is not null) y on x.page = y.page and x.ts is not null and x.at > y.at),
r as (select *, coalesce(etag = e, modified = m) as agree from j)
select record_id, response_id, coalesce(agree, false) as resolved, agree is not null as checked,
if(agree, '{' || concat_ws(',', '"cache-control":"' || coalesce(if(has, cache, null), if(h, a, null)) || '"', '"content-type":"' || if(h, k, null) || '"', '"date":"' || coalesce(if(has, date, null), if(h, d, null)) || '"',
'"etag":"' || coalesce(if(has, etag, null), if(h, e, null)) || '"') || '}', null) as headers from r
""".strip()
