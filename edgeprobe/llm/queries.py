"""The queries of the training-data operators, and SQL for those that SQL can express.

Those are decontamination (windows as joined words), archives (digests by five bits) and near duplicates
(shingles joined, links followed), fill-in-middle.  The others need a trained model, a tokenizer or positions of matches; ``tests/llm`` holds
them against plain versions or held-out labels.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, jaccard, language, minhash, packing, pii, quality, suffix_tree, toxicity, urls, warc, whiten
from .common import read_table

TOKENIZER = "word_bpe_49k.json"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.report(marked).drop("places")


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end, passage): where in the original text (code points) the hits of operator 1 are."""
    marked = decontaminate.mark(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    found = marked.select("doc_id", "text", F.explode("bm_places").alias("p")).select("doc_id", "text", F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    return found.select("doc_id", "start", "end", F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))").alias("passage"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summaries(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_quality(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept", "p_good")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.by_component(read_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_warc": op2_warc,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_language_id": op4_language_id,
        "op5_toxicity": op5_toxicity,
        "op6_url_filter": op6_url_filter,
        "op7_pii": op7_pii,
        "op8_quality_rules": op8_quality_rules,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_minhash_near_dedup": op11_minhash_near_dedup,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_fill_in_middle": op13_fill_in_middle,
        "benchmark_passages": benchmark_passages,
        "pipeline": pipeline,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_OP1 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
iu AS (SELECT item_id, rn, unnest(w) AS x, unnest(range(len(w))) AS k, len(w) AS n FROM (SELECT *, row_number() OVER () AS rn FROM i) WHERE len(w) > 0),
ig AS (SELECT item_id, n, k, list(x) OVER (PARTITION BY rn ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM iu),
iw AS (SELECT DISTINCT item_id, array_to_string(g, ' ') AS g, len(g) AS n FROM ig WHERE len(g) = least(10, n) AND (n >= 10 OR k = 0)),
du AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS k FROM d WHERE len(w) > 0),
dg AS (SELECT doc_id, k, list(x) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM du),
dw AS (SELECT doc_id, k, n, array_to_string(g[1:n], ' ') AS g FROM dg, (SELECT DISTINCT n FROM iw) WHERE len(g) >= n),
hits AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (g, n)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id"""

_BITS = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
_OP2 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS root FROM p GROUP BY 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, concat({_BITS}) AS payload_digest, CASE WHEN page_id = root THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> root THEN root END AS refers_to FROM p JOIN f USING (h)"""

_LINKED = f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS k, len(w) AS n FROM d WHERE len(w) > 0),
g AS (SELECT doc_id, n, k, list(x) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM u),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS g FROM g WHERE len(g) = least(5, n) AND (n >= 5 OR k = 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * i.n >= {{share}} * (x.n + y.n - i.n)),
r AS (SELECT doc_id AS a, doc_id AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a WHERE r.root < l.b)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id{{more}} FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN (SELECT a, min(root) AS root FROM r GROUP BY 1) m ON m.a = d.doc_id"""
_OP9 = _LINKED.format(share=75, more="")
_OP11 = _LINKED.format(share=85, more=", coalesce(m.root, d.doc_id) = d.doc_id AS kept")

_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_OP13 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, {", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM s),
c AS (SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:n], '') AS x FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(CASE form WHEN 'plain' THEN t ELSE p || m || x END) AS restored_sha256 FROM c"""


def oracle_sql():
    return {"op1_benchmark_decontamination": _OP1, "op2_warc": _OP2, "op9_ngram_jaccard_join": _OP9, "op11_minhash_near_dedup": _OP11, "op13_fill_in_middle": _OP13}
