"""The queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runsift.llm.common import stored
from runsift.llm.decontam import leaks
from runsift.llm.hard_negatives import hard_negatives
from runsift.llm.html_extract import extract
from runsift.llm.jaccard import near_duplicates
from runsift.llm.language import language_id
from runsift.llm.line_dedup import MIN_SITES, MIN_WORDS, without_shared_lines
from runsift.llm.mixing import mix
from runsift.llm.packing import pack
from runsift.llm.prefix_trie import prefix_trie
from runsift.llm.quality import quality_scores
from runsift.llm.secrets import secret_scan
from runsift.llm.topk import top_k
from runsift.llm.toxicity import toxicity_scores
from runsift.workload.registry import Entry

ENTRIES: dict[str, Entry] = {}


def entry(name: str, sql: str | None = None):
    def add(query):
        ENTRIES[name] = Entry(query, sql)
        return query

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@entry("op10_best_fit_packing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(spark, sf_dir, "documents"), tokenizer_path())


@entry("op9_ngram_jaccard_join")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(stored(spark, sf_dir, "documents"))


SQL_LINE_DEDUP = f"""
with lines as (
  select doc_id, source, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as raw from documents),
counted as (
  select *, trim(raw, ' ') as line, len(trim(raw, ' ')) - len(replace(trim(raw, ' '), ' ', '')) + 1 >= {MIN_WORDS} and trim(raw, ' ') <> '' as long from lines),
shared as (
  select line, min(row(doc_id, pos)) as first from counted where long group by line having count(distinct source) >= {MIN_SITES}),
judged as (
  select c.doc_id, c.pos, c.raw, s.line is not null and row(c.doc_id, c.pos) <> s.first as gone from counted c left join shared s on c.long and c.line = s.line)
select doc_id, coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '') as text, count(*) filter (where gone) as n_removed
from judged group by doc_id"""


@entry("op4_line_dedup", SQL_LINE_DEDUP)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_shared_lines(stored(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_line_removed").cast("long").alias("n_removed"))


SQL_TOKENS = r"""list_transform(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: hash(w))"""

#: Thirteen tokens with at most two exchanged hold four in a row that are the same: another way to all places.
SQL_LEAKS = f"""
with d as (select doc_id, {SQL_TOKENS} as w from documents), b as (select item_id, {SQL_TOKENS} as w from benchmark),
df as (select doc_id, i, hash(w[i], w[i + 1], w[i + 2], w[i + 3]) as h from (select *, unnest(range(1, len(w) - 2)) as i from d)),
bf as (select item_id, i, hash(w[i], w[i + 1], w[i + 2], w[i + 3]) as h from (select *, unnest(range(1, len(w) - 2)) as i from b where len(w) >= 9)),
met as (select distinct doc_id, item_id, df.i - bf.i as shift from df join bf using (h)),
beside as (
  select doc_id, item_id, least(len(b.w), 13) as compared,
    list_transform(range(greatest(1, 1 - shift), least(len(b.w), len(d.w) - shift) + 1), lambda k: case when d.w[k + shift] = b.w[k] then 1 else 0 end) as same
  from met join d using (doc_id) join b using (item_id)),
best as (
  select doc_id, item_id, compared, list_max(list_transform(range(1, len(same) - compared + 2), lambda k: list_sum(same[k:k + compared - 1]))) as matched
  from beside where len(same) >= compared)
select doc_id, item_id, cast(max(matched) as integer) as matched, cast(max(compared) as integer) as compared from best
where compared - matched <= floor(compared * 2 / 13) group by doc_id, item_id"""


@entry("op6_benchmark_decontamination", SQL_LEAKS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(stored(spark, sf_dir, "documents"), stored(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "matched", "compared")


@entry("op2_quality_classifier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(stored(spark, sf_dir, "documents"), stored(spark, sf_dir, "labels"))


SQL_TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings),
scored as (
  select q.vec_id as query_id, d.vec_id, cast(list_inner_product(q.v, d.v) as bigint) as score
  from v q join v d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5"""


@entry("op1_voronoi_top_k", SQL_TOP_K)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(stored(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@entry("op5_secret_ownership")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(stored(spark, sf_dir, "documents"))


@entry("op8_weak_toxicity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(stored(spark, sf_dir, "documents"), stored(spark, sf_dir, "labels"))


@entry("op7_crf_language_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(stored(spark, sf_dir, "documents"))


@entry("op3_crf_html_extraction")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(stored(spark, sf_dir, "pages"))


SQL_MIX = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as w from d group by source),
o as (select *, row_number() over (order by source_size::double / w, w, encode(source) nulls last) as place from s),
p as (
  select *, (select sum(source_size) from s) - coalesce(sum(3 * source_size) over (order by place rows between unbounded preceding and 1 preceding), 0) as share,
    sum(w) over (order by place rows between current row and unbounded following) as among from o),
f as (select place as first_place, share, among from p where 3 * source_size * among >= share * w order by place limit 1),
t as (select source, source_size, case when place < first_place then (3 * source_size)::double else f.share::double * w / f.among::double end as target from o, f),
g as (
  select d.*, t.source_size, t.target, sum(d.size) over (partition by d.source order by h range between unbounded preceding and current row) as upto,
    sum(d.size) over (partition by d.source, h) as there from d join t on d.source is not distinct from t.source),
r as (select *, round(target)::bigint // greatest(source_size, 1) as rounds, round(target)::bigint % greatest(source_size, 1) as rest from g)
select doc_id, source, size, source_size, target,
  (case when size = 0 then 0 else size * rounds + case when upto <= rest then size when upto - there <= rest then size * (rest - (upto - there)) // there else 0 end end)::bigint as taken
from r"""


@entry("op11_hash_threshold_mix", SQL_MIX)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(stored(spark, sf_dir, "documents"))


SQL_HARD_NEGATIVES = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (select * from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
mined as (
  select p.anchor_id, p.vec_id as positive_id, cast(row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as integer) as rank,
    n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
  from positives p join scored n on p.anchor_id = n.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select * from mined where rank <= 3"""


@entry("op12_rns_hard_negatives", SQL_HARD_NEGATIVES)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(stored(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)


#: The checksum goes bit by bit over the digits, each followed by seven zero steps.
SQL_PREFIX_TRIE = """
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, encode(coalesce(role, '')), encode(coalesce(text, ''))) as place
  from conversations where conv_id is not null),
steps as (
  select conv_id, list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))) as s
  from (select distinct conv_id from own)),
conv as (select conv_id, xor(list_reduce(s, lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 9 as h from steps),
rebuilt as (
  select c.conv_id, 0 as part, o.place, o.role, o.text from conv c join own o on o.conv_id = c.conv_id - c.conv_id % 5 and o.place <= c.h
  union all select c.conv_id, 1, o.place, o.role, o.text from conv c join own o on o.conv_id = c.conv_id and o.place > c.h),
marked as (select *, md5(strlen(role)::varchar || ':' || role || text) as m, strlen(text) as bytes from rebuilt),
begun as (
  select conv_id, row_number() over w as depth, string_agg(m, '') over w as key, bytes from marked window w as (partition by conv_id order by part, place)
  union all select conv_id, 0, '', 0 from conv),
lengths as (select conv_id, max(depth) as length from begun group by conv_id),
nodes as (
  select key, any_value(depth) as depth, min(b.conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(b.conv_id::varchar, ',' order by b.conv_id) filter (where depth = length), '')) as ends_sha256
  from begun b join lengths using (conv_id) group by key),
children as (select left(key, strlen(key) - 32) as key, count(*) as n from nodes where depth > 0 group by 1),
whole as (
  select v.key, count(*) filter (where c.n is null) as n_leaves, sum((u.n_convs - 1) * u.bytes) as saved_tokens
  from nodes v join nodes u on starts_with(u.key, v.key) left join children c on c.key = u.key group by v.key)
select v.conv_id, v.depth::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, coalesce(c.n, 0) as n_children, w.n_leaves, w.saved_tokens::bigint as saved_tokens, v.ends_sha256
from nodes v join whole w using (key) left join children c using (key) left join nodes p on v.depth > 0 and p.key = left(v.key, strlen(v.key) - 32)"""


@entry("op13_zfast_prefix_trie", SQL_PREFIX_TRIE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(stored(spark, sf_dir, "conversations"))
