"""Registered queries of the subpackage: name -> callable, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kinfold.llm import word_bpe

    ranks = word_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return word_bpe.encode_decode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


@query
def op9_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import suffix_merge

    return suffix_merge.remove_repeats(documents(spark, sf_dir))


@query
def op10_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import partenum

    return partenum.near_duplicates(documents(spark, sf_dir))


ORACLES["op10_partenum_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id
FROM documents d JOIN reached r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query
def op7_nce_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import nce_lm

    return nce_lm.score_texts(documents(spark, sf_dir))


@query
def op3_piecewise_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import fuzzy_hash

    return fuzzy_hash.fingerprints(documents(spark, sf_dir))


@query
def op4_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import gru_langid

    return gru_langid.identify(documents(spark, sf_dir))


@query
def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import secret_links

    return secret_links.find(documents(spark, sf_dir))


@query
def op6_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import mixing

    return mixing.taken_words(documents(spark, sf_dir))


@query
def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import weak_rules

    return weak_rules.judged(documents(spark, sf_dir))


@query
def op1_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kinfold.llm import token_counts, word_bpe

    pieces = word_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_counts.count_tokens(documents(spark, sf_dir), pieces)


@query
def op13_chunk_memo_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import fill_middle

    return fill_middle.digests(documents(spark, sf_dir))


# Units are cut at \n by position; a DuckDB list of the line ends gives both cuts.
ORACLES["op13_chunk_memo_fim"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
p AS (
  SELECT doc_id, t, n, array_to_string(l[:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query
def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import positional_index

    return positional_index.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_positional_index"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i:i + 9])) AS w FROM b WHERE len(w) > 0),
win AS (SELECT item_id, w, len(w) AS k, array_to_string(w, ' ') AS s FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
ds AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw),
hit AS (SELECT DISTINCT ds.doc_id, ds.i, ds.k, win.item_id FROM ds JOIN win ON ds.s = win.s AND ds.k = win.k),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
n_item AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
here AS (SELECT * FROM pos WHERE t IN (SELECT DISTINCT unnest(w) FROM win)),
freq AS (SELECT t, count(*) AS n FROM here GROUP BY t),
wt AS (SELECT DISTINCT s, unnest(w) AS t FROM win),
first AS (SELECT s, arg_min(wt.t, (freq.n, wt.t)) AS t, count(*) AS m FROM wt JOIN freq ON wt.t = freq.t GROUP BY s
  HAVING count(*) = (SELECT count(*) FROM wt x WHERE x.s = wt.s)),
cand AS (SELECT first.s, first.m, here.doc_id, here.p FROM first JOIN here ON here.t = first.t),
around AS (SELECT s, m, doc_id, p, p + unnest(range(-16, 17)) AS q FROM cand),
near AS (
  SELECT a.s, a.doc_id, a.p FROM around a JOIN here h ON h.doc_id = a.doc_id AND h.p = a.q JOIN wt ON wt.s = a.s AND wt.t = h.t
  GROUP BY a.s, a.doc_id, a.p, a.m HAVING count(DISTINCT h.t) = a.m),
n_near AS (SELECT near.doc_id, count(DISTINCT win.item_id) AS n FROM near JOIN win ON win.s = near.s GROUP BY near.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(n_item.n, 0)::BIGINT AS n_items,
  sha256(coalesce(n_item.ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated, coalesce(n_near.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN n_item USING (doc_id) LEFT JOIN n_near USING (doc_id)
"""


@query
def op11_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import turn_repair

    return turn_repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
