"""The thirteen operators applied to the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annlinks, bpe, exact, filteraudit, fingerprints, jaccard, mixing, quality, substring, token_counts, toxicity, urlrank, veccodes
from .sampling import fold

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrank.filter_urls(table(spark, sf_dir, "pages"))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annlinks.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit_toxicity(docs, labels, ~held)
    return judged(toxicity.score_toxicity(docs, model, ["doc_id"]), held)


def held_out(doc_id: Column, folds: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def older_half(docs: DataFrame) -> Column:
    """The older half of the range of ids is the snapshot, the newer half the incoming batch."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= ((low or 0) + (high or 0)) // 2


def judged(scored: DataFrame, held: Column) -> DataFrame:
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), ["doc_id"])
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.exact_dedup(docs, older_half(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 3, 1)
    model = quality.fit_quality(docs, labels, ~held)
    return judged(quality.score_quality(docs, model, ["doc_id"]), held)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, their errors and the codebooks' digest."""
    return veccodes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole texts and of their edited texts, and how alike they are."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on whole documents: every language's every order and step."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and k[2].isdigit() and callable(v)]
    return {f.__name__: f for f in found}


OP1_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
x as (select doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w)),
m as (select h, min(doc_id) as lo from x group by h having min(doc_id) < max(doc_id)),
r as (select distinct doc_id, unnest(range(p, p + 50)) as i from x join m using (h) where lo < doc_id),
g as (select doc_id, list(i) as gone from r group by doc_id),
k as (select doc_id, list(ws[i] order by i) as kept from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w join g using (doc_id)) a anti join r using (doc_id, i) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(array_to_string(case when gone is null then ws else coalesce(kept, []) end, ' ')) as kept_sha256
from w left join g on w.doc_id = g.doc_id left join k on w.doc_id = k.doc_id
"""

OP2_SQL = f"""
with d as (select doc_id, source, {WORDS}::bigint as size, md5('0:' || coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from d group by source),
c as (select *, (source_size * 3)::double as cap, (source_size * 3)::double / w as ratio from s),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over o, 0.0)) / (sum(w) over () - coalesce(sum(w) over o, 0.0)) as level from c
      window o as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
v as (select first(level order by ratio, source nulls last) as level from l where level <= ratio),
t as (select l.*, least(cap, coalesce(v.level * w, cap)) as target from l left join v on true),
p as (select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as e,
      coalesce(sum(size) over (partition by d.source order by k, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (e * size + greatest(0, least(size, floor(target)::bigint - e * source_size - before)))::bigint as taken from p
"""

#: The smallest id that each one reaches over links e (a, b), of all ids v (id).
REACH_SQL = "u as (select a, b from e union all select b, a from e), r(id, least) as (select id, id from v union select u.b, r.least from r join u on r.id = u.a where r.least < u.b), c as (select id, min(least) as component_id from r group by id)"

OP4_SQL = f"""
with recursive v as (select vec_id as id, embedding::double[] as x from embeddings where vec_id is not null),
g as (select id, len(x) as dim, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) as x from v
      where len(x) > 0 and len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0 and list_sum(list_transform(x, lambda z: z * z)) > 0),
e as (select a.id as a, b.id as b from g a join g b on a.dim = b.dim and a.id < b.id where list_dot_product(a.x, b.x) >= 0.95),
{REACH_SQL}, k as (select a as id, count(*) as n from u group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, false) as kept from embeddings left join c on c.id = vec_id left join k on k.id = vec_id
"""

OP6_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' '))) when len(ws) > 0 then [md5(array_to_string(ws, ' '))] else [] end) as h from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
v as (select doc_id as id from documents), {REACH_SQL}
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from documents d left join n on n.doc_id = d.doc_id left join c on c.id = d.doc_id
"""

OP9_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as n from d group by t)
select doc_id, keep_id, n as group_size, doc_id is not distinct from keep_id as kept, sha256(d.t) as text_sha256 from d join g using (t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_mixing_sources": OP2_SQL, "op3_url_filters": urlrank.filter_sql(), "op4_embedding_neardup": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_vector_codes": veccodes.codes_sql(), "op13_filter_audit": filteraudit.audit_sql()}
