"""One query for each operator over its whole table, with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bottomk, bpe, chat, jaccard, langid, negatives, packing, pages, quality, url_filter, variants, warc
from .common import materialize

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN

#: Rules of op2: the site rules, and general patterns that speak where no site rule does.
URL_RULES = [
    url_filter.host_path_rule("allow", "com", "/"),
    url_filter.host_path_rule("block", "example.com", "/en/"),
    url_filter.host_path_rule("allow", "www.example.com", "/en/"),
    url_filter.host_path_rule("block", "net", "/es/"),
    url_filter.host_path_rule("block", "net", "/fr/"),
]
PAGE_PATTERNS = [
    url_filter.pattern_rule("block", r"(?s)[?&](?:session|sid|phpsessid)=", ["session"]),
    url_filter.pattern_rule("block", r"(?s)/(?:wp-)?login(?:[./?#]|$)", ["login"]),
    url_filter.pattern_rule("block", r"(?s)/cgi-bin/", ["cgi", "bin"]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def damaged() -> Column:
    """What a faulty replica holds: by the hash of its id, one record in 64 begins with another character, one in 64 is gone."""
    mark = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    text = F.coalesce("text", F.lit(""))
    return F.when(mark.isin("07", "0b", "17", "2a"), F.concat(F.lit("~"), F.substring(text, 2, 2**31 - 1))).when(~mark.isin("3c", "5d", "7e", "9f"), text)


def op1_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    primary, replica = warc.sides(materialize(warc.manifest(docs, stored=damaged()), "manifest"))
    return warc.audit(primary, replica).select("archive", "doc_id", "copy", "offset", "length", "status")


OP1_SQL = """
with docs as (select doc_id, coalesce(text, '') as t, left(md5(coalesce(doc_id::varchar, '')), 2) as mark from documents),
a as (select doc_id, mark, sha256(t) as digest, case when mark in ('07', '0b', '17', '2a') then sha256('~' || substring(t, 2)) when mark not in ('3c', '5d', '7e', '9f') then sha256(t) end as held, strlen(t) + strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:doc:' || coalesce(doc_id::varchar, '') || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(t)::varchar || chr(13) || chr(10) || chr(13) || chr(10)) + 4 as length from docs),
b as (select *, coalesce(floor(doc_id / 256.0)::bigint, -1 - ('0x' || left(digest, 4))::bigint) as archive from a),
m as (select *, sum(length) over (partition by archive order by doc_id nulls first, digest, length, held nulls first rows unbounded preceding) - length as offset_, row_number() over (partition by archive, doc_id order by digest, length, held nulls first) as copy from b)
select archive, doc_id, copy::int as copy, offset_::bigint as "offset", length::bigint as length, case when held is null then 'missing' else 'changed' end as status from m where held is distinct from digest"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(urls, URL_RULES + PAGE_PATTERNS)
    site = F.col("rule").isin([r.text for r in URL_RULES])
    return judged.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict")


_FITS = "(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')"
OP2_SQL = (
    "with u as (select page_id, coalesce(url, '') as url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) as raw, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages), "
    "h as (select *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from u), "
    "j as (select *, case "
    + " ".join(f"when {_FITS.format(h=h, p=p)} then '{h}{p}'" for h, p in (("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("com", "/")))
    + " end as rule from h) select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' when rule is not null then 'allow' "
    "when contains(url, '://') and (regexp_matches(url, '[?&](session|sid|phpsessid)=') and regexp_matches(url, '(^|[^A-Za-z0-9])session([^A-Za-z0-9]|$)') or regexp_matches(url, '/(wp-)?login([./?#]|$)') or contains(url, '/cgi-bin/')) then 'block' else 'allow' end as verdict from j"
)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.expr("vec_id % 20 = 0"), 20)


OP4_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) as score from v as q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as "rank" from p)
select query_id, "rank"::int as "rank", vec_id, score from r where "rank" <= 20"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN), RANKS, PATTERN))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(materialize(chat.format_conversations(rows, RANKS, PATTERN), "windows"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


#: All pairs that share a shingle: fast enough for the tables that SQL is run on.
OP9_SQL = r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w),
e as (select doc_id, unnest(sh) as g from s), n as (select doc_id, len(sh) as n from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n as nx on nx.doc_id = x join n as ny on ny.doc_id = y where 100 * c >= 90 * (nx.n + ny.n - c)),
b as (select x, y from l union select y, x from l),
r(d, c) as (select doc_id, doc_id from n union select r.d, b.y from r join b on r.c = b.x)
select n.doc_id, n.n as n_shingles, min(r.c) as component_id from n join r on r.d = n.doc_id group by 1, 2"""


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.word_counts(table(spark, sf_dir, "documents"), damage=31)
    return variants.variants(materialize(words, "counts"))


#: CRC-32 by half bytes, as DuckDB has none; near words share what is left when one letter is struck out.
OP11_SQL = r"""with recursive r as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) as w from documents),
d as (select w, count(*) as k, hex(encode(id || ':' || w)) as x from r group by w, id),
t as (select w, k, list_prepend(4294967295::bigint, flatten(list_transform(range(1, len(x), 2), lambda i: [strpos('0123456789ABCDEF', x[i + 1]) - 1, strpos('0123456789ABCDEF', x[i]) - 1]))) as nibbles from d),
h as (select w, k, xor(list_reduce(nibbles, lambda a, b: xor((a >> 4), case xor(a, b) & 15 when 0 then 0 when 1 then 498536548 when 2 then 997073096 when 3 then 651767980 when 4 then 1994146192 when 5 then 1802195444 when 6 then 1303535960 when 7 then 1342533948 when 8 then 3988292384 when 9 then 4027552580 when 10 then 3604390888 when 11 then 3412177804 when 12 then 2607071920 when 13 then 2262029012 when 14 then 2685067896 else 3183342108 end)), 4294967295) as crc from t),
c as (select case when crc % 31 = 0 then substring(w, 1, (crc % length(w))::int) || substring(w, (crc % length(w))::int + 2) else w end as word, k from h),
v as (select word, sum(k)::bigint as n from c where length(word) >= 7 group by word having sum(k) >= 2),
z as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
s as (select word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) as rest from z),
p as (select a.word, b.word as near, b.n as near_n from s a join s b on a.rest = b.rest and a.i = b.i and a.word <> b.word and length(a.word) = length(b.word)
union select s.word, v.word, v.n from s join v on v.word = s.rest union select v.word, s.word, s.n from s join v on v.word = s.rest),
b as (select v.word, v.n, count(p.near) as n_near, first(p.near order by p.near_n desc, p.near) as best, max(p.near_n) as best_n from v left join p on p.word = v.word group by 1, 2),
f as (select word, n, n_near, case when best_n >= 10 * n then best end as form, case when best_n >= 10 * n then best_n end as form_n from b),
g(word, root) as (select word, word from f union all select g.word, f.form from g join f on f.word = g.root where f.form is not null),
l as (select g.word, g.root from g join f on f.word = g.root where f.form is null)
select f.word, f.form, l.root, f.n::bigint as n, f.n_near::bigint as n_near, f.form_n::bigint as form_n from f join l on l.word = f.word"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, label, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256.0)


OP12_SQL = """
with v as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r as ar, a.vec_id as anchor_id, a.label as al, b.r as br, b.vec_id as other, b.label as bl, list_inner_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.r <> b.r),
p as (select *, row_number() over (partition by ar order by score desc, other, br) as k from s where al = bl),
n as (select p.anchor_id, p.other as positive_id, p.score as positive_score, s.other as negative_id, s.score as negative_score, row_number() over (partition by p.ar, p.k order by s.score desc, s.other, s.br) as "rank"
  from p join s on p.ar = s.ar and p.k <= 5 and s.al <> s.bl and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, "rank"::int as "rank", negative_id, positive_score, negative_score from n where "rank" <= 3"""


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottomk.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP13_SQL = OP9_SQL.replace("100 * c >= 90 *", "100 * c >= 85 *").replace("min(r.c) as component_id from", "min(r.c) as component_id, min(r.c) = n.doc_id as kept from")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_fixity_audit,
        op2_url_filter,
        op3_best_fit_packing,
        op4_nearest_neighbours,
        op5_quality_rules,
        op6_language_id,
        op7_bpe,
        op8_chat_windows,
        op9_ngram_jaccard_join,
        op10_main_text,
        op11_spelling_variants,
        op12_hard_negatives,
        op13_minhash_near_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_warc_fixity_audit": OP1_SQL, "op2_url_filter": OP2_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_minhash_near_dedup": OP13_SQL}
