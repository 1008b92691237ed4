"""Registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackpool.llm import bpe, brown, dualtree, lines, merkle, minmax, packing, quality, rpforest, secrets, shards, unigram, whitening
from stackpool.llm.common import id_crc, small_batches, table
from stackpool.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``."""
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            small_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[key] = run
        if oracle:
            ORACLES[key] = oracle
        return fn
    return add


@query("op1_quality")
def op1(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op2_shards")
def op2(spark, sf):
    out = shards.shard_rows(table(spark, sf, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_viterbi")
def op3(spark, sf):
    return unigram.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_brown")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    out = brown.held_out(2, 7)
    scored = brown.score_texts(docs, docs.filter(~out))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_secrets")
def op5(spark, sf):
    return secrets.digest(secrets.scan_secrets(table(spark, sf, "documents")))


@query("op6_packing")
def op6(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


@query("op7_bpe")
def op7(spark, sf):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.round_trip(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# all pairs that share a shingle, then everything that links reach
@query("op8_minmax", f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    t as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w where len(w) >= 4),
    g as (select doc_id, x, lead(x, 1) over o as x1, lead(x, 2) over o as x2, lead(x, 3) over o as x3 from t window o as (partition by doc_id order by i)),
    e as (select distinct doc_id, hash(x, x1, x2, x3) as x from g where x3 is not null union all select doc_id, hash(w) from w where len(w) between 1 and 3),
    n as (select doc_id, count(e.x) as n from w left join e using (doc_id) group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
    l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
    r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, l.b from r join l on r.other = l.a)
    select doc_id, any_value(n.n)::bigint as n_shingles, min(r.other) as component_id, min(r.other) = doc_id as kept from n join r using (doc_id) group by doc_id""")
def op8(spark, sf):
    return minmax.near_duplicates(table(spark, sf, "documents"))


_INTEGER = "floor(256 * x::double)::bigint"


@query("op9_dualtree", f"""with v as (select vec_id, list_transform(embedding, lambda x: {_INTEGER}) as e from embeddings
        where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e::double[], c.e::double[])::bigint as score
        from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, rank::int as rank, vec_id, score from r where rank <= 5""")
def op9(spark, sf):
    rows = table(spark, sf, "embeddings")
    return dualtree.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


@query("op10_rpforest")
def op10(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rpforest.nearest(rows, rows.filter("vec_id % 100 = 0"), k=10)


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op11_lines", f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
    k as (select *, translate(trim(line, {_STRIP}), '{_UPPER}', '{_UPPER.lower()}') as key from l),
    g as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
    select doc_id, count(*) as n_lines, count(g.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (g.key is null), '')) as kept_sha256
    from k left join g on k.key = g.key group by doc_id""")
def op11(spark, sf):
    docs = table(spark, sf, "documents")
    return lines.digest(lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_chars=1, min_docs=10)))


def _h(*fields: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}::varchar) || ':' || {f}::varchar, '-')" for f in fields) + "))"


# levels of both kinds of trees, then every leaf climbs them; crc32 from its table of remainders
@query("op13_merkle", f"""with recursive tab as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
    d as (select *, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 7 = 0 as hit from documents, tab),
    l as (select doc_id, lang, {_h("doc_id", "source", "lang", "n_chars", "text")} as leaf,
        case when hit then {_h("doc_id", "source", "lang", "(n_chars + 1)", "text")} else {_h("doc_id", "source", "lang", "n_chars", "text")} end as seen from d),
    a as (select *, row_number() over (partition by lang order by doc_id nulls first) - 1 as pos, count(*) over (partition by lang) as n from l),
    t as (select lang, 0 as lvl, pos, leaf as h, n from a
        union all select lang, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from t where n > 1 group by lang, lvl, pos // 2, n),
    s as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as spot, count(*) over () as n from t where n = 1),
    u as (select 0 as lvl, spot as pos, subroot as h, n from s
        union all select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from u where n > 1 group by lvl, pos // 2, n),
    c as (select doc_id, lang, 0 as lvl, pos, n, seen as h, '' as proof from a
        union all select c.doc_id, c.lang, c.lvl + 1, c.pos // 2, (c.n + 1) // 2, sha256(case when c.pos % 2 = 0 then c.h || coalesce(t.h, '') else t.h || c.h end), proof || coalesce(t.h, '')
        from c left join t on t.lang is not distinct from c.lang and t.lvl = c.lvl and t.pos = xor(c.pos, 1) where c.n > 1),
    e as (select doc_id, c.lang, 0 as lvl, spot as pos, s.n, h, proof, subroot from c join s on s.lang is not distinct from c.lang where c.n = 1
        union all select e.doc_id, e.lang, e.lvl + 1, e.pos // 2, (e.n + 1) // 2, sha256(case when e.pos % 2 = 0 then e.h || coalesce(u.h, '') else u.h || e.h end), proof || coalesce(u.h, ''), subroot
        from e left join u on u.lvl = e.lvl and u.pos = xor(e.pos, 1) where e.n > 1),
    r as (select h as root from u where n = 1)
    select e.doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from e join l on l.doc_id is not distinct from e.doc_id, r where e.n = 1""")
def op13(spark, sf):
    docs = table(spark, sf, "documents")
    hit = id_crc() % 7 == 0
    out = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@query("op12_whitening")
def op12(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"), components=16)
