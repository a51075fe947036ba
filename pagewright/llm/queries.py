"""One query an operator, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bm25, bpe, interpolation, line_dedup, line_quality, mixing, quality_nn, simhash, suffix_dedup, url_templates

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
RANKS = "byte_bpe_50k.tiktoken"


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; digests of the ids and of the decoded bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures every text, drops its bad lines and judges what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality.clean(docs, with_text=False).drop("text")


ORACLE_SQL["op5_line_quality"] = r"""
with d as (
  select doc_id, coalesce(text, '') as t from documents
), w as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d
), grams as (
  select doc_id, unnest(range(1, len(ws) - 3)) as i, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) as g from w where len(ws) >= 5
), twice as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from grams) where n > 1
), covered as (
  select doc_id, count(distinct i + k) as n from twice, range(5) r(k) group by doc_id
), parts as (
  select doc_id, string_split(t, chr(10)) as lines from d
), numbered as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as line_no from parts
), own as (
  select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw from numbered
), measured as (
  select doc_id, line_no, line, len(lw) as n, array_to_string(lw, '') as solid, lw,
    row_number() over (partition by doc_id, line order by line_no) > 1 and len(lw) > 0 as again,
    length(regexp_replace(line, '[^A-Za-z]', '', 'g')) as letters, length(regexp_replace(line, '[^A-Z]', '', 'g')) as upper,
    len(lw) between 1 and 3 and right(lw[len(lw)], 1) not in ('.', '!', '?', ';', ':', ',', '…', '。', '！', '？', '；', '：', '，') as stub
  from own
), full_lines as (
  select doc_id, line_no, stub, row_number() over (partition by doc_id order by line_no) - row_number() over (partition by doc_id, stub order by line_no) as island from measured where n > 0
), runs as (
  select doc_id, line_no, stub and count(*) over (partition by doc_id, stub, island) >= 3 as menu from full_lines
), judged as (
  select m.doc_id, m.n, m.again, m.n > 0 and (m.again
    or length(regexp_replace(m.line, '[^#*$%&|<>]', '', 'g')) > 0.3::double * m.n
    or (m.n >= 3 and 2 * len(list_filter(m.lw, lambda x: x like '%!!')) >= m.n)
    or (m.letters >= 20 and m.upper >= 0.7::double * m.letters)
    or (length(m.solid) >= 8 and length(regexp_replace(m.solid, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) < 0.5 * length(m.solid))
    or 4 * length(regexp_replace(m.line, '[^|>»›·•]', '', 'g')) >= m.n
    or 3 * ((length(m.line) - length(replace(m.line, '://', ''))) // 3 + (length(m.line) - length(replace(m.line, 'www.', ''))) // 4 + (length(m.line) - length(replace(m.line, '](', ''))) // 2) >= m.n
    or contains(m.line, '©') or coalesce(r.menu, false)) as bad
  from measured m left join runs r on m.doc_id = r.doc_id and m.line_no = r.line_no
), lines as (
  select doc_id, count(*) as n_lines, count(*) filter (again) as n_dup_lines, count(*) filter (bad) as n_bad_lines, coalesce(sum(n) filter (bad), 0)::bigint as lost_words from judged group by doc_id
), joined as (
  select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    n_dup_lines, coalesce(c.n, 0) as n_repeat_words, n_lines, n_bad_lines, lost_words
  from w join lines l on w.doc_id = l.doc_id left join covered c on w.doc_id = c.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  n_lines, n_bad_lines, lost_words, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lost_words <= 0.5 * n_words as kept from joined
"""


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text by a model that saw no row of the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(quality_nn.remainder(4) != 2)
    model = quality_nn.fit(docs, labels)
    held = F.coalesce(quality_nn.remainder(4) == 2, F.lit(False))
    return quality_nn.score(docs.withColumn("held_out", held), model).drop("text")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and near-duplicate class of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every exact repeat of an earlier line that is not blank, and long lines within one edit of an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup(docs)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL["op6_line_dedup"] = r"""
with parts as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), numbered as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as line_no from parts
), flagged as (
  select *, regexp_matches(line, '[^\x20\x09-\x0D]') as takes_part,
    length(line) >= 16 as near_too from numbered
), firsts as (
  select line, min((doc_id, line_no)) as pos, length(line) as n, any_value(near_too) as near_too from flagged where takes_part group by line
), gone as (
  select distinct a.line from firsts a join firsts b
  on a.near_too and b.near_too and b.n between a.n - 1 and a.n + 1 and b.pos < a.pos
    and (left(a.line, (a.n - 1) // 2) = left(b.line, (a.n - 1) // 2) or right(a.line, (a.n - 1) // 2) = right(b.line, (a.n - 1) // 2))
    and levenshtein(a.line, b.line) <= 1
), kept as (
  select f.doc_id, f.line_no, f.line from flagged f
  where not f.takes_part
    or ((f.doc_id, f.line_no) = (select pos from firsts where firsts.line = f.line) and f.line not in (select line from gone))
)
select p.doc_id, len(p.lines) as n_lines, len(p.lines) - count(k.line_no) as n_removed,
  sha256(coalesce(string_agg(k.line, chr(10) order by k.line_no), '')) as kept_sha256
from parts p left join kept k on p.doc_id = k.doc_id group by p.doc_id, p.lines
"""


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and position of every document in the mixture."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query
def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text by the model of the training folds; a tenth of those is deleted to learn the weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = quality_nn.remainder(7)
    part = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0, interpolation.DELETED).otherwise(interpolation.TRAIN)
    docs = docs.withColumn("fold", F.when(fold == 2, interpolation.OTHER).otherwise(part))
    held = F.coalesce(quality_nn.remainder(7) == 2, F.lit(False))
    return interpolation.score(docs, order=3).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The rules that the pages query fixes.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url by the rules, else by its path template."""
    return url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op 2: host, path, and the longest rule that fits with its verdict."""
    url = F.coalesce("url", F.lit(""))
    host, path = url_templates.host_of(url), url_templates.path_of(url)
    rule, said = url_templates.matching_rule(URL_RULES, host, path)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), said.alias("said"))


ORACLE_SQL["url_rules"] = r"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path from u
), rules(name, start, said) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits as (
  select page_id, arg_max(name || start, length(name || start)) as rule, arg_max(said, length(name || start)) as said
  from h, rules where (host = name or ends_with(host, '.' || name)) and starts_with(path, start) group by page_id
)
select h.page_id, host, path, rule, said from h left join fits on h.page_id = fits.page_id
"""


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every byte of a 100-byte string that also starts earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs, with_text=False)


@query
def op3_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every twentieth document's whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))
