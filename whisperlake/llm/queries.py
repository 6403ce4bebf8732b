"""The operators of this package as queries over the test tables: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.llm import (
    clustering, decontaminate, line_dedup, lm_scores, packing, periodic, quality_model, quality_rules, simhash,
    substring_dedup, toxicity, url_filter, wavelet,
)
from whisperlake.session import configure_session, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Queries that SQL can express.
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure_session(spark), sf)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op2_packing")
def _(spark, sf):
    """Pieces of all documents in sequences of 4096 tokens."""
    return packed(table(spark, sf, "documents")).drop("ids")


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


@query("op3_token_files")
def _(spark, sf):
    """All documents as wavelet matrices of token ids, read back."""
    path = work_dir(spark, "token-files")
    wavelet.write_shards(table(spark, sf, "documents"), path)
    return wavelet.read_documents(spark, path)


@query("op8_quality_model")
def _(spark, sf):
    """Every document's quality score."""
    return quality_model.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_quality_rules")
def _(spark, sf):
    """Counts, distances and verdict of every document."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", quality_rules.verdict(docs).alias("v")).select("doc_id", "v.*")


@query("op7_simhash")
def _(spark, sf):
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op10_decontamination")
def _(spark, sf):
    """Benchmark items that leak into documents."""
    return decontaminate.leaked_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_url_filter")
def _(spark, sf):
    """Host, path, rule and verdict of every page's URL."""
    return url_filter.judge(table(spark, sf, "pages"))


@query("op6_toxicity")
def _(spark, sf):
    """Every document's toxicity score."""
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_lm_scores")
def _(spark, sf):
    """Every document's stupid-backoff score under the bigram counts of all documents."""
    out = lm_scores.score(table(spark, sf, "documents"))
    return out.withColumn("log_score", F.round("log_score", 3)).withColumn("score", F.round("score", 6))


ORACLES["op5_lm_scores"] = r"""
with w as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') if x <> ''] as words
  from documents),
p as (select doc_id, unnest(words) as b, unnest(list_concat([null], words[:-2])) as a, len(words) as n from w),
one as (select b, count(*) as n from p group by b),
two as (select a, b, count(*) as n from p where a is not null group by a, b),
total as (select count(*) as n from p),
s as (
  select p.doc_id, coalesce(p.a is not null and two.n < 2, false) as given_up,
    case when two.n >= 2 then ln(two.n / c.n) when p.a is null then ln(one.n / total.n) else ln(0.4) + ln(one.n / total.n) end as log_s
  from p cross join total join one on one.b = p.b left join one as c on c.b = p.a left join two on two.a = p.a and two.b = p.b)
select w.doc_id, len(w.words) as n_words, cast(coalesce(g.n_backoff, 0) as bigint) as n_backoff,
  round(coalesce(g.log_score, 0), 3) as log_score, round(g.log_score / len(w.words), 6) as score
from w left join (
  select doc_id, count(*) filter (where given_up) as n_backoff, sum(log_s) as log_score from s group by doc_id) g using (doc_id)"""


@query("op1_line_dedup")
def _(spark, sf):
    """Class, links and removal of every line of all documents."""
    return line_dedup.similar_lines(table(spark, sf, "documents"))


@query("op13_periodic_runs")
def _(spark, sf):
    """Periodic runs of words of every document, and the text without their repeats."""
    out = periodic.periodic_runs(table(spark, sf, "documents"), plant=True)
    return out.select("*", *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("runs", "collapsed"))).drop("runs", "collapsed")


@query("op12_centroid_clusters")
def _(spark, sf):
    """Cluster and distance of every vector after five rounds."""
    return clustering.clusters(table(spark, sf, "embeddings"))


def _cluster_sql(rounds: int) -> str:
    """One assignment and one move a round; ids are unique in the test tables."""
    steps = [r"""
with kept as materialized (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(cast(x as double))]) = 64),
p as materialized (select vec_id, unnest(range(64)) as i, unnest(v) as x from kept),
c0 as materialized (
  select c, unnest(range(64)) as i, unnest(v) as x from (
    select row_number() over (order by sha256('2:' || vec_id)) - 1 as c, v from kept order by c limit 40))"""]
    for t in range(rounds + 1):
        steps.append(f"""
d{t} as (select p.vec_id, c.c, sum((p.x - c.x) * (p.x - c.x)) as d from p join c{t} as c on c.i = p.i group by p.vec_id, c.c),
a{t} as materialized (select vec_id, c, d from d{t} qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if t < rounds:
            steps.append(f"""
s{t} as (select c, i, sum(x) as s, count(*) as n from a{t} join p using (vec_id) group by c, i),
c{t + 1} as materialized (
  select c.c, c.i, case when s.n is null then c.x else cast((s.s - ((s.s % s.n) + s.n) % s.n) // s.n as bigint) end as x
  from c{t} as c left join s{t} as s on s.c = c.c and s.i = c.i)""")
    return ",".join(steps) + f"""
select a.vec_id, cast(a.c as integer) as cluster, cast(a.d as bigint) as distance,
  cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, h.centroid_sha256
from a{rounds} as a join (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from c{rounds} group by c) as h using (c)"""


ORACLES["op12_centroid_clusters"] = _cluster_sql(5)


@query("op11_substring_dedup")
def _(spark, sf):
    """Words of every document that lie in repeated passages, and a digest of the others."""
    out = substring_dedup.repeated_passages(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


# Windows by hashes of 1, 2, 4, ..., 32 words and the three words behind them.
ORACLES["op11_substring_dedup"] = (
    r"""
with w as (
  select row_number() over () as r, doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as words from documents),
h1 as (select r, unnest(range(len(words))) as i, unnest(words) as word, md5(unnest(words)) as h, len(words) as n from w)"""
    + "".join(f""",
h{2 * k} as (select * exclude (h{k if k > 1 else ''}), md5(h{k if k > 1 else ''} || lead(h{k if k > 1 else ''}, {k}, '') over (partition by r order by i)) as h{2 * k}{', h' if k == 1 else ''} from h{k})"""
              for k in (1, 2, 4, 8, 16)) + """,
g as (select r, i, word, case when i + 35 <= n then md5(h32 || lead(h, 32) over p || lead(h, 33) over p || lead(h, 34) over p) end as g
  from h32 window p as (partition by r order by i)),
t as (select g from g where g is not null group by g having count(*) > 1),
c as (select r, i, word, max(cast(t.g is not null as int)) over (partition by r order by i rows between 34 preceding and current row) = 1 as gone
  from g left join t using (g))
select w.doc_id, len(w.words) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join (
  select r, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from c group by r) as k using (r)""")
