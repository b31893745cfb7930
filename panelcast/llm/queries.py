"""The registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import (
    chat_format, decontaminate, html_wrapper, pieces, prefix_join, ptolemaic, quality, resampling, secret_ledger,
    toxicity, url_filter, vector_index, warc,
)
from panelcast.llm.common import held_out, table, text_batches
from panelcast.session import scratch_path

QUERIES, ORACLES = {}, {}

#: Host labels whose pages make up the list of blocked urls.
LISTED_HOSTS = r"(?i)://([^/?#]*\.)?(cheap-pills|casino-win|free-bets)\."


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_html_wrapper")
def op1_html_wrapper(spark, sf):
    """The main text of every page."""
    return html_wrapper.main_text(table(text_batches(spark), sf, "pages"))


_SETS = r"""
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
    group by 1, 2),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared))"""


@query("op2_prefix_join", f"""with recursive {_SETS},
r(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from r join l on l.x = r.y)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.y) as component_id
from documents d join r on r.x = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n""")
def op2_prefix_join(spark, sf):
    """Set size and component of every document."""
    return prefix_join.near_duplicates(table(text_batches(spark), sf, "documents"))


@query("op3_secret_ledger")
def op3_secret_ledger(spark, sf):
    """Secrets in every document, from a ledger of its blobs."""
    return secret_ledger.scanned(table(spark, sf, "documents").select("doc_id", "text"))


_URL = "coalesce(url, '')"
_HOST = (f"translate(regexp_extract(case when instr({_URL}, '://') > 0 then substr({_URL}, instr({_URL}, '://') + 3)"
         " else '' end, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_PATH = (f"regexp_extract(case when instr({_URL}, '://') > 0 then substr({_URL}, instr({_URL}, '://') + 3)"
         " else '' end, '(?s)^[^/?#]*([^?#]*)', 1)")


@query("op4_url_filter", f"""
with p as (select page_id, url, {_HOST} as host, {_PATH} as path from pages),
j as (select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule,
  coalesce(regexp_matches(url, '{LISTED_HOSTS}'), false) as listed from p)
select page_id, host, path, rule, case
    when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
    when listed then 'block' else 'allow' end as verdict, listed from j""")
def op4_url_filter(spark, sf):
    """Rules over every page, then the list of urls on listed hosts."""
    pages = table(spark, sf, "pages")
    return url_filter.judged(pages, pages.where(F.col("url").rlike(LISTED_HOSTS)))


@query("op6_warc", """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(html), 1 + 10 * (i // 8)::int, 10))::bigint
      >> (35 - 5 * (i % 8))::int) & 31)::int, 1)), '') as payload_digest from p),
m as (select payload_digest, max(page_id) as top from d group by 1)
select page_id, payload_bytes, payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to,
  case when page_id = top then true end as payload_ok
from d join m using (payload_digest)""")
def op6_warc(spark, sf):
    """Archives of every page, written to the shared folder, read back and assembled."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.captures(warc.assemble(warc.read_records(spark, path)))


@query("op5_toxicity")
def op5_toxicity(spark, sf):
    """Every document scored by its nearest labelled examples."""
    docs = table(text_batches(spark), sf, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), "toxicity.neighbours", "toxicity.terms")


@query("op7_vector_index", """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null),
l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from r join l on l.x = r.y),
c as (select x as vec_id, min(y) as component_id from r group by 1),
n as (select x as vec_id, count(*) as n from l group by 1)
select c.vec_id, coalesce(n, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept
from c left join n using (vec_id)""")
def op7_vector_index(spark, sf):
    """Links and component of every vector."""
    return vector_index.near_duplicates(table(spark, sf, "embeddings"))


@query("op8_decontaminate")
def op8_decontaminate(spark, sf):
    """Every leaked test item of every document."""
    return decontaminate.leaked_pairs(table(text_batches(spark), sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_pieces")
def op9_pieces(spark, sf):
    """The ids of every whole text, and the test that they decode to it."""
    return pieces.encoded(table(text_batches(spark), sf, "documents"), pieces.load())


@query("op10_quality")
def op10_quality(spark, sf):
    """Every document scored by the network over its word vectors."""
    docs = table(text_batches(spark), sf, "documents").select("doc_id", "text")
    scored = quality.scored(docs, quality.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


_CONTROLS = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in chat_format.CONTROLS)


@query("op11_chat_parts", rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) as chars from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text))
    as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(chat_format.TURN + chat_format.END) + 2} + length(role) + chars)::bigint as formatted_chars
from e group by conv_id""")
def op11_chat_parts(spark, sf):
    """Every conversation formatted and read back, with one that is made of control strings."""
    rows = table(text_batches(spark), sf, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.formatted(rows.unionByName(own)))


@query("op12_resample")
def op12_resample(spark, sf):
    """Every document weighted towards the benchmark's texts, a twentieth drawn and ranked."""
    return resampling.resampled(table(text_batches(spark), sf, "documents"), table(spark, sf, "benchmark"))


def _clusters_sql(k=ptolemaic.CENTROIDS, rounds=ptolemaic.ROUNDS):
    """The rounds written out one after the other."""
    size, scale = ptolemaic.SIZE, ptolemaic.SCALE
    steps = [f"""v as materialized (select vec_id, list_transform(embedding::double[], lambda x: floor({scale} * x)::bigint) as v
        from embeddings where len(embedding) = {size}
        and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})""",
        f"""c0 as materialized (select (row_number() over (order by h) - 1)::int as c, v from
        (select sha256('{ptolemaic.SEED}:' || vec_id) as h, v from v order by h limit {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select vec_id, any_value(v) as v, min(struct_pack(d := d, c := c)) as m from
            (select vec_id, v.v as v, c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint
             as d from v, c{i}) group by vec_id)""")
        if i < rounds:
            steps.append(f"""c{i + 1} as materialized (select c{i}.c, coalesce(n.v, c{i}.v) as v from c{i} left join
                (select c, list(floor(s / n)::bigint order by p) as v from (select m.c as c, p, sum(v[p])::double as s, count(*) as n
                 from a{i}, range(1, {size + 1}) as r(p) group by 1, 2) group by c) n on n.c = c{i}.c)""")
    return f"""with {", ".join(steps)}
select vec_id, m.c as cluster, m.d as distance, (sum(m.d) over (partition by m.c))::bigint as cluster_inertia,
  (sum(m.d) over ())::bigint as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c{rounds}.c = m.c"""


@query("op13_ptolemaic", _clusters_sql())
def op13_ptolemaic(spark, sf):
    """Every vector with its cluster after five rounds."""
    return ptolemaic.clustered(table(spark, sf, "embeddings")).drop("centroid")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    """All stages over all documents."""
    return corpus_pipeline.run(spark, sf)
