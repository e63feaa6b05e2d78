"""The queries of the training-data operators and their SQL, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.llm import decontamination, fingerprints, html_text, jaccard_join, langid, lm_scoring, mixing, pii, quality, suffix_dedup, tokenstore, vector_codes, whitening
from seqlattice.llm.common import fold, table


def held_out(n: int, rest: int):
    return F.coalesce(fold("doc_id", n) == rest, F.lit(False))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, then components by walking the links.
OP1_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents where text is not null),
grams as (
  select distinct doc_id, unnest(case when len(w) < 4 then [array_to_string(w, ' ')] else [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] end) as g
  from words where len(w) > 0),
size as (select doc_id, count(*) as n from grams group by 1),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from pairs join size x on x.doc_id = a join size y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from reach r join both_ways l on l.a = r.b)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, r.component_id
from documents d left join size s using (doc_id) join (select a, min(b) as component_id from reach group by 1) r on r.a = d.doc_id
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = quality.train(docs, labels.where(fold("doc_id", 5) != 0))
    found = quality.score(docs, chain)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"), "bad_lines")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 5) != 0))
    return langid.identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.language_model_scores(table(spark, sf_dir, "documents"), held_out(7, 2))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum_mix(table(spark, sf_dir, "documents"))
    first = F.coalesce(F.floor(F.try_element_at("positions", F.lit(1)) * 1e6), F.lit(-1)).alias("first_position_ppm")
    return mixing.training_order(mixed.select("doc_id", "size", "source_size", "target", "taken", first), "first_position_ppm")


OP5_SQL = r"""
with sized as (
  select doc_id, case when source is null then '~' else '=' || source end as source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '')) as key from documents),
src as (select source_key, sum(size)::bigint as source_size from sized group by 1),
ranked as (
  select *, row_number() over (order by source_key) as rank from src),
weighted as (
  select *, [5, 2, 1][((rank - 1) % 3 + 1)::int] as weight, source_size * 2 as cap from ranked),
levels as (
  select *, cap / weight as ratio,
         (1.5::double * sum(source_size) over () - (sum(cap) over w - cap)) / (sum(weight) over () - sum(weight) over w + weight) as level
  from weighted window w as (order by cap / weight, source_key)),
open as (select arg_min(level, (ratio, source_key)) as level from levels where level < ratio),
targets as (
  select l.source_key, l.source_size, l.rank,
         least(l.cap::double, coalesce(o.level * l.weight, l.cap::double)) as target
  from levels l left join open o on true),
dealt as (
  select s.*, t.source_size, t.target, t.rank,
         (sum(size) over (partition by s.source_key order by s.key, s.doc_id, s.size rows unbounded preceding) - size)::bigint as used,
         case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as full_passes
  from sized s join targets t using (source_key)),
taken as (
  select *, least(greatest(floor(target - full_passes * source_size + 0.5)::bigint - used, 0), size) as part from dealt),
shaped as (
  select *, case when target > 0 then used::double / target else 0.0::double end as share,
         (rank - 1) % 3 as turn from taken),
seg as (
  select *,
    case when turn = 2 and share >= 0.5 then 0.5::double else 0.0::double end as t0,
    case turn when 0 then 0.5::double when 1 then 1.5::double else case when share >= 0.5 then 2.0::double / 1.5 else 1.0::double / 1.5 end end as w,
    case turn when 0 then 1.0::double when 1 then -1.0::double else case when share >= 0.5 then -2.0::double / 1.5 else 2.0::double / 1.5 end end as slope,
    case when turn = 2 and share >= 0.5 then share - 0.5 else share end as rest
  from shaped)
select doc_id, size, source_size, target, (full_passes * size + part)::bigint as taken,
       case when size > 0 and (full_passes > 0 or part > 0) then
         floor(least(t0 + 2 * rest / (w + sqrt(greatest(w * w + 2 * slope * rest, 0))), 1.0) * 1e6)::bigint else -1 end as first_position_ppm
from seg
"""

def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_files(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_shingles", "shared_shingles", F.floor(F.col("containment") * 1e6).alias("containment_ppm"))


#: Words, then distinct 5-word shingles (fewer words: the whole sequence) of documents and items.
OP10_SQL = r"""
with raw as (
  select 'd' as side, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
words as (
  select side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from raw where text is not null),
grams as (
  select side, id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] end) as g
  from words where len(w) > 0),
sets as (select distinct side, id, g from grams),
size as (select id, count(*) as n from sets where side = 'i' group by 1)
select d.id as doc_id, i.id as item_id, any_value(s.n)::bigint as item_shingles, count(*)::bigint as shared_shingles,
       floor(count(*)::double / any_value(s.n) * 1e6)::bigint as containment_ppm
from sets d join sets i on d.g = i.g and d.side = 'd' and i.side = 'i' join size s on s.id = i.id
group by d.id, i.id having 100 * count(*) >= 80 * any_value(s.n)
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, book = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(found).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(book)).alias("codebooks_sha256"))


def _assigned(name: str, book: str) -> str:
    return f"""
{name} as materialized (
  select p.row, p.part, arg_min(b.entry, (list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) as entry
  from parts p join {book} b on p.part = b.part group by 1, 2)"""


def _moved(name: str, codes: str, book: str) -> str:
    return f"""
{name}_mean as (
  select part, entry, list(m order by i) as v from (
    select part, entry, i, floor(sum(x)::double / count(*))::bigint as m from (
      select a.part, a.entry, unnest(p.v) as x, unnest(range(len(p.v))) as i from {codes} a join parts p on a.row = p.row and a.part = p.part)
    group by 1, 2, 3) group by 1, 2),
{name} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from {book} b left join {name}_mean m on m.part = b.part and m.entry = b.entry)"""


#: Every part of every vector against every entry, three times.
OP12_SQL = f"""
with kept as (
  select row_number() over () as row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as materialized (
  select row, part, v[part * w + 1 : (part + 1) * w] as v from (select row, v, len(v) // 16 as w, unnest(range(16)) as part from kept)),
firsts as (select row, row_number() over (order by vec_id, v) - 1 as entry from kept where vec_id is not null qualify entry < 64),
book0 as materialized (select p.part, f.entry, p.v from firsts f join parts p using (row)),
{_assigned("codes0", "book0")}, {_moved("book1", "codes0", "book0")}, {_assigned("codes1", "book1")}, {_moved("book2", "codes1", "book1")}, {_assigned("codes2", "book2")},
own as (
  select c.row, string_agg(printf('%02x', c.entry), '' order by c.part) as code, sum(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::bigint as error
  from codes2 c join parts p on p.row = c.row and p.part = c.part join book2 b on b.part = c.part and b.entry = c.entry group by 1)
select k.vec_id, o.code, o.error, (sum(o.error) over (partition by k.label))::bigint as label_error,
       (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) from book2) as codebooks_sha256
from kept k join own o using (row)
"""


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {"op1_jaccard_join": op1_jaccard_join, "op2_quality": op2_quality, "op3_language": op3_language, "op4_lm_scoring": op4_lm_scoring, "op5_mixing": op5_mixing, "op6_fingerprints": op6_fingerprints, "op7_pii": op7_pii, "op8_token_files": op8_token_files, "op9_suffix_dedup": op9_suffix_dedup, "op10_decontamination": op10_decontamination,
           "op11_whitening": op11_whitening, "op12_vector_codes": op12_vector_codes, "op13_html_text": op13_html_text}
ORACLE = {"op1_jaccard_join": OP1_SQL, "op5_mixing": OP5_SQL, "op10_decontamination": OP10_SQL, "op12_vector_codes": OP12_SQL}
