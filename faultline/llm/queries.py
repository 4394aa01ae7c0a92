"""One query per operator on the shared tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    alignment,
    contamination,
    html_text,
    language,
    language_model,
    lines,
    mixing,
    prefix_trie,
    quality,
    sharding,
    simhash,
    tokens,
    toxicity,
)
from faultline.llm.common import held_out, remainder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

QUALITY_MODULUS, QUALITY_SAMPLE, QUALITY_CUT = 5, 4000, 0.3
LANGUAGE_MODULUS, LANGUAGE_REST = 4, 2
TOXICITY_MODULUS, TOXICITY_CUT = 5, 0.5
MODEL_MODULUS, MODEL_ORDER, MODEL_STRENGTH, MODEL_ADD = 10, 2, 300.0, 0.1
TRIE_FAMILY, TRIE_SPAN = 5, 9
MAX_TOKENS = 4096
SHARDS = 16


def query(function):
    QUERIES[function.__name__] = function
    return function


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.RuleModel:
    learn = remainder(F.col("doc_id"), QUALITY_MODULUS) != 0
    return quality.train(docs, labels, learn, QUALITY_SAMPLE)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), QUALITY_MODULUS, 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


@query
def op2_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "lost_chars",
    )


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        contamination.hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        contamination.items_digest().alias("items_sha256"),
        contamination.is_contaminated().alias("contaminated"),
    )


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, tokenizer_path())
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit")
    )


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = remainder(F.col("doc_id"), LANGUAGE_MODULUS) != LANGUAGE_REST
    model = language.train(docs, learn)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id"), LANGUAGE_MODULUS, LANGUAGE_REST).alias("held_out"),
        "lang_pred",
        "score",
    )


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sizes(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


@query
def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.byte_shards(docs, SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, 3, 3).select(
        "doc_id", simhash.hex_print().alias("fingerprint"), "component_id"
    )


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = remainder(F.col("doc_id"), TOXICITY_MODULUS) != 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.with_score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id"), TOXICITY_MODULUS, 0).alias("held_out"),
        "score",
        (F.col("score") >= TOXICITY_CUT).cast("int").alias("predicted"),
    )


@query
def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = remainder(F.col("doc_id"), MODEL_MODULUS) != 0
    scored = language_model.with_scores(docs, learn, MODEL_ORDER, MODEL_STRENGTH, MODEL_ADD)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), MODEL_MODULUS, 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        F.round("base_score", 6).alias("base_score"),
        F.round("score", 6).alias("score"),
    )


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = alignment.PairIndex(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path())
    return index.scored().select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lists = prefix_trie.turn_lists(conversations, TRIE_FAMILY)
    return prefix_trie.prefix_trie(prefix_trie.with_family_start(lists, TRIE_SPAN))


SQL["op2_clean_lines"] = r"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), parts as (
  select rid, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    string_split(text, chr(10)) as all_lines
  from docs
), windows as (
  select rid, i, array_to_string(words[i:i + 4], ' ') as gram
  from (select rid, words, unnest(generate_series(1, len(words) - 4)) as i from parts where len(words) >= 5)
), twice as (
  select rid, gram from windows group by rid, gram having count(*) > 1
), covered as (
  select rid, count(distinct p) as n
  from (select w.rid, unnest(generate_series(w.i, w.i + 4)) as p
        from windows w join twice t on w.rid = t.rid and w.gram = t.gram)
  group by rid
), base as (
  select parts.rid, doc_id, len(words)::bigint as n_words,
    length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    len(list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words,
    list_filter(all_lines, lambda x: not regexp_matches(x, '[^\x20\x09-\x0D]') or (
      regexp_matches(x, '__END__')
      and not (length(regexp_replace(x, '[^|»›•·>]+', '', 'g')) >= 2
               and len(regexp_extract_all(x, '__SEP__')) >= 2)
      and not regexp_matches(x, '__NAV__')
      and not regexp_matches(x, '__BOIL__'))) as good
  from parts left join covered c on parts.rid = c.rid
), measured as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    word_chars - length(regexp_replace(array_to_string(good, chr(10)), '[\x20\x09-\x0D]+', '', 'g')) as lost_chars
  from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * lost_chars <= 50 * word_chars as kept, lost_chars::bigint as lost_chars
from measured
""".replace("__END__", lines.SENTENCE_END.replace("'", "''")).replace("__SEP__", lines.SEPARATORS).replace(
    "__NAV__", lines.NAVIGATION
).replace("__BOIL__", lines.BOILERPLATE)

SQL["op3_decontaminate"] = r"""
with docs as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), items as (
  select item_id::varchar as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark
), grams as (
  select distinct item, least(13, len(words)) as width, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') as gram
  from (select *, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) as i from items where len(words) > 0)
), widths as (select distinct width from grams
), windows as (
  select rid, width, i, array_to_string(words[i:i + width - 1], ' ') as gram
  from (select rid, words, width, unnest(generate_series(1, len(words) - width + 1)) as i
        from docs, widths where len(words) >= width)
), hits as (
  select w.rid, w.i, w.width, g.item from windows w join grams g on w.width = g.width and w.gram = g.gram
), covered as (
  select rid, count(distinct p) as n_hit
  from (select rid, unnest(generate_series(i, i + width - 1)) as p from hits) group by rid
), found as (
  select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by rid
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from docs left join covered using (rid) left join found using (rid)
"""

SQL["op7_mix_sources"] = r"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix-1|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as key
  from documents
), sources as (
  select source, sum(size)::bigint as size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from docs group by source
), ranked as (
  select *, sum(size) over (order by size::double / weight, source nulls last rows unbounded preceding) - size as clamped_size,
    sum(weight) over () - sum(weight) over (order by size::double / weight, source nulls last rows unbounded preceding) + weight as open_weight,
    sum(size) over () as total
  from sources
), level as (
  -- a source is clamped if its share, once all those before it are, reaches three times its size
  select min(case when (total - 3 * clamped_size)::hugeint * weight < 3 * open_weight::hugeint * size then clamped_size end) as clamped_size,
    max(case when (total - 3 * clamped_size)::hugeint * weight < 3 * open_weight::hugeint * size then open_weight end) as open_weight
  from ranked
), targets as (
  select source, size, weight,
    case when l.open_weight is null or (total - 3 * l.clamped_size)::hugeint * weight >= 3 * l.open_weight::hugeint * size
      then size::double * 3
      else (total - 3 * l.clamped_size)::double * weight / l.open_weight::double end as target
  from ranked, level l
), plan as (
  select source, size as source_size, target,
    case when size > 0 then least(floor(target / size), 3) else 0 end::bigint as whole
  from targets
), ordered as (
  select d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as extra,
    sum(d.size) over (partition by d.source order by d.key) as upto,
    sum(d.size) over (partition by d.source, d.key) as together
  from docs d join plan p on d.source is not distinct from p.source
), last as (
  select source, max(key) filter (where size >= 0 and 2 * upto - together <= 2 * extra) as key from ordered group by source
)
select o.doc_id, o.size, o.source_size::bigint as source_size, o.target,
  (o.size * (o.whole + case when o.extra > 0 and l.key is not null and o.key <= l.key then 1 else 0 end))::bigint as taken
from ordered o join last l on o.source is not distinct from l.source
"""


#: CRC-32 of a decimal number, and its table, made by the rule of the polynomial.
CRC_TABLE = """
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc_table
"""
CRC = """xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split({0}::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"""

SQL["op11_language_model"] = rf"""
with crc as ({CRC_TABLE}), docs as (
  select row_number() over () as rid, doc_id, {CRC.format("doc_id")} % 10 = 0 as held_out,
    list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[ 	-
]+'), lambda w: w <> '') as words
  from documents, crc
), tokens as (  -- an empty word is the end, and what stands before the first word
  select rid, doc_id, held_out, unnest(list_concat([''], words)) as before,
    unnest(list_concat(words, [''])) as word
  from docs
), single as (
  select word, count(*) as c from tokens where not held_out group by word
), pairs as (
  select before, word, count(*) as c from tokens where not held_out group by before, word
), whole as (
  select coalesce(sum(c), 0) as n, count(*) as v from single
), weighed as (
  select t.rid, t.doc_id, t.held_out, s.c as c, coalesce(b.c, 0) as c_before, coalesce(p.c, 0) as c_pair,
    n as train_tokens, (coalesce(s.c, 0) + 0.1::double) / (n + 0.1::double * (v + 1)) as p1
  from tokens t cross join whole left join single s on t.word = s.word
    left join single b on t.before = b.word
    left join pairs p on t.before = p.before and t.word = p.word
)
select doc_id, held_out, count(*)::bigint as n_tokens, count(c)::bigint as n_known,
  max(train_tokens)::bigint as train_tokens, round(sum(log10(p1)), 6) as base_score,
  round(sum(log10((c_pair + 300.0::double * p1) / (c_before + 300.0::double))), 6) as score
from weighed group by rid, doc_id, held_out
"""

SQL["op13_prefix_trie"] = f"""
with crc as ({CRC_TABLE}), turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first) as p
  from conversations where conv_id is not null
), convs as (
  select conv_id, count(*) as n, {CRC.format("conv_id")} % 9 as h
  from turns, crc group by conv_id, crc_table
), placed as (
  select c.conv_id, t.p, t.role, t.text
  from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 5 and t.p <= c.h
  union all
  select c.conv_id, c.h + t.p, t.role, t.text
  from convs c join turns t on t.conv_id = c.conv_id and t.p > c.h
), lists as (
  select conv_id, list(struct_pack(r := role, t := text) order by p) as path from placed group by conv_id
), prefixes as (
  select conv_id, len(path) as n, unnest(range(len(path) + 1)) as depth, path from lists
  union all
  select conv_id, 0, 0, [] from convs where conv_id not in (select conv_id from lists)
), nodes as (
  select depth, sha256(path[1:depth]::varchar) as node, case when depth > 0 then sha256(path[1:depth - 1]::varchar) end as over,
    min(conv_id) as conv_id, count(*) as n_convs,
    string_agg(case when n = depth then conv_id::varchar end, ',' order by conv_id) as ends,
    max(case when depth = 0 then 0 else octet_length(encode(path[depth].t)) end) as size
  from prefixes group by all
), grown as (
  select a.*, (select count(*) from nodes b where b.depth = a.depth + 1 and b.over = a.node) as n_children
  from nodes a
), chains as (
  select p.depth as d, sha256(p.path[1:p.depth]::varchar) as node, q.depth as e,
    sha256(q.path[1:q.depth]::varchar) as under
  from prefixes p join prefixes q on p.conv_id = q.conv_id and p.depth <= q.depth
  group by all
)
select a.conv_id, a.depth::bigint as depth, b.conv_id as parent_conv_id, a.n_convs::bigint as n_convs,
  a.n_children::bigint as n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(a.ends, '')) as ends_sha256
from grown a
left join nodes b on a.depth > 0 and b.depth = a.depth - 1 and b.node = a.over
join (
  select c.d, c.node, sum(case when g.n_children = 0 then 1 else 0 end)::bigint as n_leaves,
    sum((g.n_convs - 1) * g.size)::bigint as saved_tokens
  from chains c join grown g on g.depth = c.e and g.node = c.under
  group by c.d, c.node
) s on s.d = a.depth and s.node = a.node
"""
