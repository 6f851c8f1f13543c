"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, fingerprint, html, langid, licenses, lines, minhash, packing, quality, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_main_text": html.op2_main_text,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_near_duplicates": minhash.op5_near_duplicates,
        "op6_pack": packing.op6_pack,
        "op7_near_vectors": vectors.op7_near_vectors,
        "op8_quality": quality.op8_quality,
        "op9_fingerprints": fingerprint.op9_fingerprints,
        "op10_repeated_passages": lines.op10_repeated_passages,
    }


#: Smallest reachable id over the links (x, y) of ``ways``, which has each link in both directions.
_REACHED = """reached(id, c) as (select id, id from nodes union select ways.y, reached.c from reached join ways on ways.x = reached.id),
parts as (select id, min(c) as component_id from reached group by id)"""

#: All pairs that share a shingle, counted; fine for the test tables.
OP5_SQL = f"""with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') as w from documents),
sets as (select distinct doc_id, unnest(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as n from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * common.n >= 80 * (a.n + b.n - common.n)),
ways as (select x, y from links union all select y, x from links),
nodes as (select doc_id as id from documents),
{_REACHED}
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from words left join sizes using (doc_id) join parts on id = doc_id"""

#: All pairs of a label.
OP7_SQL = f"""with recursive vectors as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from vectors a join vectors b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.98),
ways as (select x, y from links union all select y, x from links),
nodes as (select vec_id as id from embeddings),
{_REACHED},
degrees as (select x, count(*) as n from ways group by x)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings left join degrees on x = vec_id join parts on id = vec_id"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express at the size of the test tables."""
    return {"op5_near_duplicates": OP5_SQL, "op7_near_vectors": OP7_SQL}
