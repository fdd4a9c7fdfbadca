"""The operators as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.base import derive, duck, table
from .decontamination import leaks
from .html_text import extract, learn_weights
from .jaccard_join import jaccard_classes
from .language_id import language_report
from .merkle import verified_manifest, without_line_ends
from .quality import quality_scores
from .quotations import linked_conversations
from .sentencepiece_codec import encoded_documents
from .surrogates import with_surrogates
from .token_counts import token_counts
from .token_shards import write_shards
from .topk import top_k
from .whitening import whiten

#: A public vocabulary of the installed tokenizer files.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def public_model(name: str) -> str:
    """Where the installed vocabulary files have the one of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The key of the surrogates; a deployment passes its own secret.
KEY = "driftkit"

_SQL: dict[str, str] = {}


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the shards that are written, a row per sequence."""
    return write_shards(table(spark, sf_dir, "documents"), MODEL)[0]


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


_SQL["op6_topk"] = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


#: The conversations as mail: each message quotes the one that it answers, and that one's answer in turn.
MAIL = """
SELECT c.conv_id, c.turn, c.role,
  coalesce(c.text, '') || CASE WHEN p.turn IS NULL THEN '' ELSE chr(10) || chr(10) || 'On turn ' || CAST(p.turn AS VARCHAR(20)) || ' '
    || p.role || ' wrote:' || chr(10) || '> ' || replace(coalesce(p.text, ''), chr(10), chr(10) || '> ') END
  || CASE WHEN q.turn IS NULL THEN '' ELSE chr(10) || '>> ' || replace(coalesce(q.text, ''), chr(10), chr(10) || '>> ') END AS text
FROM {conversations} c
LEFT JOIN {conversations} p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 - (c.conv_id + c.turn) % 2
LEFT JOIN {conversations} q ON q.conv_id = p.conv_id AND q.turn = p.turn - 1 - (p.conv_id + p.turn) % 2
"""


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_conversations(derive(spark, sf_dir, MAIL))


_SQL["op8_quotations"] = rf"""
WITH RECURSIVE mail AS {duck(MAIL)},
lines AS (
  SELECT conv_id, turn, n, length(replace(replace(regexp_extract(x, '^(?:[ \t]*>)+'), ' ', ''), chr(9), '')) AS level,
    trim(regexp_replace(x, '^(?:[ \t]*>)+', '')) AS body
  FROM (SELECT conv_id, turn, unnest(l) AS x, generate_subscripts(l, 1) AS n
        FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM mail))
), kept AS (
  SELECT * FROM (SELECT *, lead(level, 1, 0) OVER (PARTITION BY conv_id, turn ORDER BY n) AS next FROM lines)
  WHERE NOT (regexp_matches(body, '(?i)(?:wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|escribe) ?:$') AND next > level)
), levels AS (SELECT DISTINCT conv_id, turn, level FROM kept
), joined AS (
  SELECT l.conv_id, l.turn, l.level, string_agg(CASE WHEN k.level = l.level THEN k.body ELSE chr(1) END, ' ' ORDER BY k.n) AS t
  FROM levels l JOIN kept k ON k.conv_id = l.conv_id AND k.turn = l.turn GROUP BY ALL
), passages AS (
  SELECT DISTINCT conv_id, turn, level, p FROM (
    SELECT conv_id, turn, level, lower(trim(regexp_replace(u, '\s+', ' ', 'g'))) AS p FROM (
      SELECT conv_id, turn, level, unnest(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS u FROM joined))
  WHERE p <> ''
), linked AS (
  SELECT q.conv_id, q.turn, q.level, q.p, max(w.turn) AS source
  FROM passages q LEFT JOIN passages w ON w.conv_id = q.conv_id AND w.level = 0 AND w.p = q.p AND w.turn < q.turn
  WHERE q.level > 0 GROUP BY ALL
), votes AS (SELECT conv_id, turn, level, source, count(*) AS n FROM linked GROUP BY ALL
), counts AS (
  SELECT conv_id, turn, max(CASE WHEN level = 1 AND source IS NOT NULL THEN {{'n': n, 'source': source}} END).source AS reply_to,
    sum(n) AS n_quoted, sum(CASE WHEN source IS NOT NULL THEN n END) AS n_linked
  FROM votes GROUP BY ALL
), replies AS (SELECT m.conv_id, m.turn, c.reply_to FROM mail m LEFT JOIN counts c USING (conv_id, turn)
), threads AS (
  SELECT conv_id, turn, turn AS thread, 0 AS depth FROM replies WHERE reply_to IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, t.thread, t.depth + 1 FROM replies r JOIN threads t ON r.conv_id = t.conv_id AND r.reply_to = t.turn
), own AS (
  SELECT conv_id, turn, regexp_replace(string_agg(body, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS text
  FROM kept WHERE level = 0 GROUP BY ALL
)
SELECT m.conv_id, m.turn, m.role, c.reply_to, t.thread, t.depth, CAST(coalesce(c.n_quoted, 0) AS BIGINT) AS n_quoted,
  CAST(coalesce(c.n_linked, 0) AS BIGINT) AS n_linked, coalesce(o.text, '') AS text
FROM mail m LEFT JOIN counts c USING (conv_id, turn) LEFT JOIN threads t USING (conv_id, turn) LEFT JOIN own o USING (conv_id, turn)
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and a checksum of the ids, and whether parity and the round trip hold."""
    out = encoded_documents(table(spark, sf_dir, "documents"), MODEL)
    return out.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc"), "parity", "round_trip")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data; ``n_replaced`` counts the mentions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, KEY, counted="n_replaced")[0]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and which rows still prove against it once line ends are lost."""
    docs = table(spark, sf_dir, "documents")
    return verified_manifest(docs, without_line_ends(docs))


_VALUE = "coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
_LEAF = " || ".join(_VALUE.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
#: Parity of the crc32 of doc_id: the reflected polynomial, a bit at a time.
_CRC = """list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295)"""


def _tree(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (tree, i, n, d), and their siblings."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, n, d FROM {leaves}
  UNION ALL
  SELECT tree, any_value(level) + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY tree, i // 3
), {name}_siblings AS (
  SELECT a.tree, a.level, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name} a JOIN {name} b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.i // 3 = b.i // 3
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.i
), {name}_paths AS (
  SELECT a.tree, a.i, coalesce(list({{'l': s.l, 'r': s.r}} ORDER BY s.level) FILTER (s.level IS NOT NULL), []) AS path
  FROM {leaves} a LEFT JOIN {name}_siblings s
    ON a.tree IS NOT DISTINCT FROM s.tree AND s.i = a.i // CAST(pow(3, s.level) AS BIGINT) GROUP BY a.tree, a.i
)"""


_SQL["op11_merkle"] = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source AS tree, sha256({_LEAF}) AS d,
    CASE WHEN {_CRC} % 2 = 1 THEN sha256({_LEAF.replace("text", "replace(text, chr(10), '')")}) ELSE sha256({_LEAF}) END AS claimed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows
), {_tree("lower_tree", "leaves")}, subroots AS (
  SELECT tree AS source, CAST(NULL AS VARCHAR) AS tree, d, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM lower_tree WHERE n = 1
), {_tree("upper_tree", "subroots")}, whole AS (
  SELECT a.doc_id, a.d AS leaf, a.claimed, s.d AS subroot, list_concat(p.path, q.path) AS path,
    (SELECT d FROM upper_tree WHERE n = 1) AS root
  FROM leaves a JOIN lower_tree_paths p ON a.tree IS NOT DISTINCT FROM p.tree AND a.i = p.i
  JOIN subroots s ON a.tree IS NOT DISTINCT FROM s.source JOIN upper_tree_paths q ON q.i = s.i
), folded AS (
  SELECT *, list_reduce(list_transform(path, lambda x: {{'l': x.l, 'own': '', 'r': x.r}}),
    lambda a, x: {{'l': '', 'own': sha256(x.l || a.own || x.r), 'r': ''}}, {{'l': '', 'own': claimed, 'r': ''}}).own AS folded_root
  FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public piece model."""
    return token_counts(table(spark, sf_dir, "documents"), public_model("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_shards, op2_language_id, op3_html_text, op4_quality, op5_decontamination, op6_topk, op7_jaccard_join,
        op8_quotations, op9_sentencepiece, op10_surrogates, op11_merkle, op12_whitening, op13_token_counts,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
