"""The registered queries of the text operators and their DuckDB twins, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    bpe,
    collocations,
    decontaminate,
    extract,
    line_dedup,
    line_rules,
    ngram_join,
    prefix_trie,
    quality_gam,
    simhash,
    substring_dedup,
    token_counts,
    warc,
)
from tablewright.llm.common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = _table(spark, sf_dir, "pages"), shared_folder(spark)
    warc.write_warc(pages, folder)
    read = warc.read_warc(spark, folder)
    own = F.col("warc_type") == "response"
    id_type = pages.schema["page_id"].dataType
    number = lambda urn: warc.page_of(urn, id_type)
    return read.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1))
        .alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256)
        .alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_gam": op1_quality_gam,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_counts": op3_token_counts,
    "op4_line_rules": op4_line_rules,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_extract": op8_extract,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_bpe": op10_bpe,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ngram_join": op13_ngram_join,
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "op4_line_rules": rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, source from documents),
w as (select rid, {_WORDS.format('text')} as ws from d),
p as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
win as (select rid, pos, word, lead(word, 1) over o as b, lead(word, 2) over o as c from p
        window o as (partition by rid order by pos)),
rep as (select rid, pos from win where c is not null
        qualify count(*) over (partition by rid, word, b, c) >= 2),
nrep as (select rid, count(distinct pos + k)::bigint as n from rep, (values (0), (1), (2)) t(k) group by rid),
l as (select rid, unnest(string_split(text, chr(10))) as line from d),
lw as (select * from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select rid, (count(*) - count(distinct line))::bigint as n from lw group by rid),
norm as (select rid, {_WORDS.format("translate(lower(line), '123456789', '000000000')")} as line from lw),
held as (select source, line, count(distinct coalesce(doc_id::varchar, '') || '|' || md5(text)) as held
         from norm join d using (rid) group by 1, 2),
hosts as (select source, count(distinct coalesce(doc_id::varchar, '') || '|' || md5(text)) as docs from d
          where regexp_matches(text, '[^\x20\x09-\x0D]') group by 1),
common as (select h.source, line from held h join hosts o on h.source is not distinct from o.source
           where held > 20 and held > docs * 0.02::double),
lost as (select n.rid, sum(len(n.line))::bigint as n from norm n join d using (rid)
         join common c on c.source is not distinct from d.source and c.line = n.line group by 1),
base as (select d.rid, doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(dup.n, 0) as n_dup_lines, coalesce(nrep.n, 0) as n_repeat_words, coalesce(lost.n, 0) as n_common_words
  from d join w using (rid) left join dup using (rid) left join nrep using (rid) left join lost using (rid)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words,
  not base_failed and n_words - n_common_words >= n_words * 0.5::double as kept from failed""",
    "op5_warc": """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
g as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest,
      case when octet_length(payload) >= 100
           then min(page_id) over (partition by sha256(payload)) end as first from p)
select page_id, payload_bytes, payload_digest,
  case when first < page_id or (first is not null and page_id is null) then 'revisit' else 'response' end as record_type,
  case when first < page_id or (first is not null and page_id is null) then first end as refers_to from g""",
    "op7_line_dedup": r"""
with d as (select row_number() over () as rid, doc_id, text from documents),
l as (select rid, doc_id, unnest(string_split(text, chr(10))) as line,
      generate_subscripts(string_split(text, chr(10)), 1) as k from d),
s as (select *, trim(line) as a, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n,
      row_number() over (partition by rid order by k) as s from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
near as (select rid, doc_id, s, a, lead(a, 1) over o as b, lead(a, 2) over o as c, n,
         lead(n, 1) over o as n1 from s window o as (partition by rid order by s)),
win as (select rid, doc_id, s, 3 as size, [a, b, c] as run from near where c is not null
        union all select rid, doc_id, s, 2, [a, b] from near where b is not null and n + n1 >= 50
        union all select rid, doc_id, s, 1, [a] from near where n >= 50),
later as (select rid, s, size from win where doc_id is not null
          qualify row(doc_id, s) > min(row(doc_id, s)) over (partition by run)),
gone as (select distinct rid, s + i as s from later, (values (0), (1), (2)) t(i) where i < size),
numbers as (select rid, k from s join gone using (rid, s)),
kept as (select l.rid, string_agg(line, chr(10) order by l.k) filter (n.k is null) as text, count(n.k) as n
         from l left join numbers n on n.rid = l.rid and n.k = l.k group by l.rid)
select doc_id, n::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d join kept using (rid)""",
    "op8_extract": r"""
with a as (select page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as body from pages),
b as (select page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'),
      '</?[a-z]+>', ' ', 'g'), chr(1)) as blocks from a),
c as (select page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(
      replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '')
      as blocks from b)
select page_id, url, array_to_string(blocks, chr(10) || chr(10)) as text,
  length(array_to_string(blocks, chr(10) || chr(10)))::bigint as n_chars from c""",
    "op9_substring_dedup": rf"""
with d as (select row_number() over () as rid, doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
win as (select rid, doc_id, unnest(range(len(ws) - 49)) as pos,
        unnest([array_to_string(ws[k + 1:k + 50], ' ') for k in range(len(ws) - 49)]) as w
        from d where len(ws) >= 50),
later as (select rid, pos from win qualify min(doc_id) over (partition by md5(w)) < doc_id),
spans as (select rid, pos, lag(pos) over (partition by rid order by pos) as before from later),
gone as (select rid, unnest(range(greatest(pos, coalesce(before + 50, 0)), pos + 50)) as k from spans),
lists as (select rid, list(k) as ks from gone group by rid),
words as (select d.rid, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as k from d join lists using (rid)),
left_over as (select w.rid, string_agg(word, ' ' order by w.k) as kept from words w
         left join gone g on g.rid = w.rid and g.k = w.k where g.rid is null group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(len(ks), 0)::bigint as n_removed,
  sha256(case when ks is null then array_to_string(ws, ' ') else coalesce(kept, '') end) as kept_sha256
from d left join lists using (rid) left join left_over using (rid)""",
    "op11_collocations": r"""
with p as (select row_number() over () as pid, lang, piece from (
      select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
w as (select pid, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
o as (select pid, lang, unnest(ws) as w1, generate_subscripts(ws, 1) as pos from w),
q as (select lang, w1, lead(w1, 1) over s as w2, lead(w1, 2) over s as w3 from o
      window s as (partition by pid order by pos)),
one as (select lang, w1, count(*) as f from q group by 1, 2),
two as (select lang, w1, w2, count(*) as f from q where w2 is not null group by 1, 2, 3 having count(*) >= 10),
three as (select lang, w1, w2, w3, count(*) as f from q where w3 is not null group by 1, 2, 3, 4
          having count(*) >= 10),
total as (select lang, sum(f)::bigint as n from one group by 1),
s2 as (select t.lang, t.w1, t.w2, t.f as a, x.f as l, y.f as r from two t
       join one x on x.lang = t.lang and x.w1 = t.w1 join one y on y.lang = t.lang and y.w1 = t.w2),
s3 as (select t.*, x.f as l1, y.f as r1, u.f as l2, v.f as r2,
       (1000000::hugeint * t.f * t.f) // (x.f::hugeint * y.f) as c1,
       (1000000::hugeint * t.f * t.f) // (u.f::hugeint * v.f) as c2 from three t
       join one x on x.lang = t.lang and x.w1 = t.w1
       join two y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
       join two u on u.lang = t.lang and u.w1 = t.w1 and u.w2 = t.w2
       join one v on v.lang = t.lang and v.w1 = t.w3),
around as (select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from three union all
           select lang, w2, w3, f from three) group by 1, 2, 3),
cand as (select s.lang, s.w1 || ' ' || s.w2 as phrase, a, l, r, (1000000::hugeint * a * a) // (l::hugeint * r) as score
         from s2 s left join around b on b.lang = s.lang and b.w1 = s.w1 and b.w2 = s.w2
         where b.f is null or 100 * b.f < 50 * a
         union all
         select lang, w1 || ' ' || w2 || ' ' || w3, f, case when c2 < c1 then l2 else l1 end,
         case when c2 < c1 then r2 else r1 end, least(c1, c2) from s3),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from cand)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000""",
    "op12_prefix_trie": """
with o as (select conv_id, list(md5(length(role)::varchar || ':' || role || text) order by turn nulls first,
           md5(length(role)::varchar || ':' || role || text)) as ids,
           list(length(text) order by turn nulls first, md5(length(role)::varchar || ':' || role || text)) as lens
           from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           where conv_id is not null) group by 1),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''),
      lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i:
      case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 6 as h from o),
r as (select h.conv_id, list_concat(list_slice(coalesce(b.ids, []), 1, h), list_slice(h.ids, h + 1, len(h.ids))) as ids,
      list_concat(list_slice(coalesce(b.lens, []), 1, h), list_slice(h.lens, h + 1, len(h.lens))) as lens
      from h left join o b on b.conv_id = h.conv_id - h.conv_id % 100),
pre as (select conv_id, ids, lens, unnest(range(len(ids) + 1)) as d from r),
node as (select list_slice(ids, 1, d) as key, d, min(conv_id) as conv_id, count(*) as n,
         coalesce(max(lens[d]), 0) as len, sha256(coalesce(string_agg(case when len(ids) = d then conv_id::varchar end,
         ',' order by conv_id), '')) as ends from pre group by 1, 2),
kids as (select list_slice(key, 1, d - 1) as key, d - 1 as d, count(*) as n from node where d > 0 group by 1, 2),
each as (select node.*, coalesce(kids.n, 0) as n_children from node left join kids using (key, d)),
sub as (select list_slice(key, 1, e) as key, e as d, sum((n - 1) * len) as saved, count(*) filter (n_children = 0) as leaves
        from (select *, unnest(range(d + 1)) as e from each) group by 1, 2)
select e.conv_id, e.d::bigint as depth, p.conv_id as parent_conv_id, e.n::bigint as n_convs,
  e.n_children::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, e.ends as ends_sha256
from each e join sub using (key, d) left join node p on p.key = list_slice(e.key, 1, e.d - 1) and p.d = e.d - 1""",
    "op13_ngram_join": rf"""
with recursive d as materialized (select row_number() over () as rid, doc_id, {_WORDS.format(
      "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
g as materialized (select distinct rid, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then
      [array_to_string(ws, ' ')] else [array_to_string(ws[k:k + 2], ' ') for k in range(1, len(ws) - 1)] end) as g from d),
n as materialized (select rid, count(*) as n from g group by 1),
met as (select a.rid as x, b.rid as y, count(*) as n from g a join g b on a.g = b.g and a.rid < b.rid group by 1, 2),
link as materialized (select x, y from met join n a on a.rid = x join n b on b.rid = y
         where 100 * met.n >= 90 * (a.n + b.n - met.n)),
edge as materialized (select x, y from link union all select y, x from link),
reach as (select x, y from edge union select r.x, e.y from reach r join edge e on e.x = r.y),
low as (select r.x as rid, min(d.doc_id) as low from reach r join d on d.rid = r.y group by 1)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least(low, doc_id), doc_id) as component_id
from d left join n using (rid) left join low using (rid)""",
}
