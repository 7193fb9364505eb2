"""The corpus operators as registered queries over the whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, embed_dedup, html_extract, license_scan, near_dedup, pii, quality, secrets, toxicity
from .common import cut, discard, fold, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark)
    found = secrets.findings(table(spark, sf_dir, "documents"), ledger)
    ledger.forget()  # the findings are written; only a ledger that is kept (secrets_second_run) has a second run
    return secrets.digest(found)


def secrets_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that is kept: after a run over all documents, a second one over two versions of each, under one changed rule.

    ``pairs``: how many (blob, rule version) pairs of the row's blob the second run had to scan: the changed rule alone, or all for a new blob.
    """
    ledger, docs = secrets.Ledger(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    discard(secrets.update(docs, ledger))
    before = cut(ledger.read().select("blob"), "seen")
    versions = docs.withColumn("version", F.lit(1)).unionByName(docs.withColumn("text", F.replace("text", F.lit("token"), F.lit("tolkien"))).withColumn("version", F.lit(2)))
    versions = versions.select(F.struct("doc_id", "version").alias("path"), "text")
    found = secrets.findings(versions, ledger, "path", rules=CHANGED)
    ledger.forget()
    pairs = found.join(before.withColumn("old", F.lit(1)), "blob", "left").withColumn("pairs", F.when(F.col("old").isNull(), len(CHANGED)).otherwise(1))
    return secrets.digest(pairs, "path", CHANGED, ("pairs",)).select("path.doc_id", "path.version", "n_assign", "n_access", "n_hex", "pairs")


#: The rules with a changed one: values of eight characters or more.
CHANGED = (secrets.Rule("assign", secrets.RULES[0].regex, 2, 8), *secrets.RULES[1:])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.Tokenizer(spark)
    return bpe.digest(tokenizer.encode(table(spark, sf_dir, "documents")), tokenizer)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(html_extract.extract(table(spark, sf_dir, "pages")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.digest(embed_dedup.links(table(spark, sf_dir, "embeddings")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(near_dedup.groups(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "secrets_second_run": secrets_second_run,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_html_extraction": op5_html_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_near_dedup": op10_near_dedup,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _secrets_sql(rules=secrets.RULES, docs: str = "select doc_id, coalesce(text, '') t from documents") -> str:
    parts = []
    for n, r in enumerate(rules):
        regex = r.regex.replace("'", "''")
        parts.append(f"""select doc_id, {n} k, '{r.kind}' kind, regexp_extract_all(t, '{regex}', 0) m, regexp_extract_all(t, '{regex}', {r.group}) c,
            string_split_regex(t, '{regex}') g, {r.least} least from d where regexp_matches(t, '{regex}')""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.RULES if r.base)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') n_{r.kind}" for r in secrets.RULES if r.base)
    columns = ", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in secrets.RULES if r.base)
    return f"""with d as ({docs}), f as ({' union all '.join(parts)}),
        i as (select *, unnest(range(1, len(m) + 1)) i from f),
        s as (select doc_id, k, kind, len(c[i]) size, least, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) a, length(m[i]) n from i),
        o as (select *, kind || ':' || a || ':' || (a + n) x from s where size >= least),
        r as (select doc_id, {counts}, coalesce(string_agg(x, ',' order by a, k) filter (kind in ({base})), '') b, string_agg(x, ',' order by a, k) spans from o group by doc_id)
        select d.doc_id, {columns}, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans from d left join r using (doc_id)"""


_DECONTAM = f"""with dw as (select doc_id, {_words('text')} w from documents),
    iw as (select cast(item_id as varchar) item, {_words('text')} w from benchmark),
    p as (select distinct item, l, array_to_string(w[i:i+l-1], ' ') t from (select item, w, least({decontam.WINDOW}, len(w)) l, unnest(range(1, len(w) - least({decontam.WINDOW}, len(w)) + 2)) i from iw where len(w) > 0)),
    o as (select doc_id, i, l, item from (select doc_id, i, l, array_to_string(w[i:i+l-1], ' ') t from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from dw, (select distinct l from p))) join p using (l, t)),
    h as (select doc_id, count(distinct j) n_hit from (select distinct doc_id, unnest(range(i, i + l)) j from o) group by doc_id),
    n as (select doc_id, count(item) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from o) group by doc_id)
    select dw.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, n_hit is not null contaminated
    from dw left join h using (doc_id) left join n using (doc_id)"""

_EMBEDDING = """with recursive v as (select vec_id, cast(embedding as double[]) e from embeddings
      where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l as materialized (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
    r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
    c as (select a vec_id, min(b) low from r group by a), n as (select a vec_id, count(*) n_links from l group by a)
    select e.vec_id, coalesce(n_links, 0) n_links, least(e.vec_id, coalesce(low, e.vec_id)) component_id, least(e.vec_id, coalesce(low, e.vec_id)) = e.vec_id kept
    from embeddings e left join c using (vec_id) left join n using (vec_id)"""

_VERSIONS = "select {'d': doc_id, 'v': v} doc_id, case v when 1 then coalesce(text, '') else replace(coalesce(text, ''), 'token', 'tolkien') end t from documents, (values (1), (2)) w(v)"
_SECOND = f"""select s.doc_id.d doc_id, s.doc_id.v as version, n_assign, n_access, n_hex, case when t in (select coalesce(text, '') from documents) then 1 else {len(CHANGED)} end pairs
    from ({_secrets_sql(CHANGED, _VERSIONS)}) s join ({_VERSIONS}) x on s.doc_id = x.doc_id"""

SQL: dict[str, str] = {"secrets_second_run": _SECOND, "op7_embedding_dedup": _EMBEDDING, "op1_secrets": _secrets_sql(), "op6_decontamination": _DECONTAM}
