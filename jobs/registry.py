"""The jobs as queries over the given tables, and the same in SQL. A query runs its job twice into a new folder of the shared one and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell import shared_folder
from chunkwell.queries import PIECES, sql_bm25

from . import evidence, mentions


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def job1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job1-evidence")
    for _ in range(2):
        found = evidence.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return found


ID = "doc_id || '::' || lpad(n::varchar, greatest(3, length(n::varchar))::integer, '0')"
SQL_JOB1 = f"""
select x.qid, x.rank, x.score, x.id, p.doc_id, p.source, length(p.piece) as char_count, left(p.piece, 500) as text, coalesce(p.lang, 'und') as lang
from ({sql_bm25("select item_id as qid, text as query from benchmark", 5)}) x
join (select * from ({PIECES} select {ID} as id, * from pieces)) p using (id)"""


def job2_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2-mentions")
    for _ in range(2):
        edges = mentions.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/pages.parquet", out, f"{out}/checkpoint")
    return edges.select("src", "dst", "weight", F.array_join(F.transform("citations", lambda c: c["id"]), " ").alias("cited"))


LETTER = "[\\p{L}\\p{N}_]"
SQL_JOB2 = f"""{PIECES}, v as (
  select distinct trim(a) as name from (select unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) as a from pages) where trim(a) <> ''
), c as (select doc_id, n, {ID} as id, piece from pieces),
words as (select distinct doc_id, n, unnest(regexp_extract_all(lower(piece), '{LETTER}+')) as word from c),
found as (
  select doc_id, n, name from words join v on lower(name) = word
  union all select doc_id, n, name from (
    select doc_id, n, name, string_split(lower(piece), lower(name)) as around from c join (select name from v where not regexp_full_match(lower(name), '{LETTER}+')) on contains(lower(piece), lower(name))
  ) where list_bool_or(list_transform(range(1, len(around)), lambda i: not regexp_full_match(right(around[i], 1), '{LETTER}') and not regexp_full_match(left(around[i + 1], 1), '{LETTER}')))
), m as (
  select doc_id, n, name, lower(trim(name)) as key, row_number() over (partition by doc_id, n order by length(name) desc, name) as pos from found qualify pos <= 25
), h as (select a.doc_id, a.n, a.key as a, b.key as b from m a join m b on a.doc_id = b.doc_id and a.n = b.n and a.pos < b.pos and a.key <> b.key),
e as (select doc_id, n, a as src, b as dst from h union all select doc_id, n, b, a from h),
r as (select *, row_number() over (partition by src, dst order by doc_id, n) as k from e)
select src, dst, count(*) as weight, string_agg({ID}, ' ' order by doc_id, n) filter (where k <= 10) as cited from r group by 1, 2"""


def queries() -> dict:
    return {"job1_evidence": job1_evidence, "job2_mentions": job2_mentions}


def oracle_sql() -> dict[str, str]:
    return {"job1_evidence": SQL_JOB1, "job2_mentions": SQL_JOB2}
