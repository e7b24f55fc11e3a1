"""Every operator of this subpackage as a query on the test tables, with its SQL if any.

The contracts fix the columns; each query takes them from what its operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.llm import (
    bpe,
    language,
    merkle,
    negatives,
    packing,
    pages,
    quality,
    secrets,
    simhash,
    substrings,
    suffixes,
    tokenfiles,
    vectors,
)
from lakemart.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id",
        *[f"quality.{name}" for name in quality.COUNTS[:5]],
        "quality.base_failed",
        "quality.kept",
        "quality.probability",
    )


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op3_substring_dedup",
    r"""
    WITH words AS (
        SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word
        FROM (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        )
    ), windows AS (
        SELECT doc_id, i, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS n
        FROM words
        WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
    ), later AS (
        SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS r
            FROM windows WHERE n = 20
        ) WHERE r > 1
    ), judged AS (
        SELECT w.doc_id, w.i, w.word, max(l.i) OVER (
            PARTITION BY w.doc_id ORDER BY w.i ROWS UNBOUNDED PRECEDING
        ) AS last_start
        FROM words w LEFT JOIN later l ON w.doc_id = l.doc_id AND w.i = l.i
    ), totals AS (
        SELECT doc_id, count(*) AS n_words,
            count(*) FILTER (WHERE last_start > i - 20) AS n_removed,
            string_agg(word, ' ' ORDER BY i) FILTER (WHERE last_start IS NULL OR last_start <= i - 20) AS kept
        FROM judged GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
        sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN totals t ON d.doc_id = t.doc_id
    """,
)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substrings.remove_repeats(docs)
    words = F.btrim(F.regexp_replace(F.coalesce("repeats.kept", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query(
    "op2_suffix_array_dedup",
    """
    WITH bytes AS (
        SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n
        FROM documents
    ), strings AS (
        SELECT doc_id, i, b[i:i + 49] AS s
        FROM (SELECT doc_id, b, unnest(generate_series(1, n - 49)) AS i FROM bytes)
    ), firsts AS (
        SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING count(*) > 1
    ), starts AS (
        SELECT t.doc_id, t.i,
            CASE WHEN t.i <= lag(t.i) OVER (PARTITION BY t.doc_id ORDER BY t.i) + 50 THEN 0 ELSE 1 END AS new
        FROM strings t JOIN firsts f ON t.s = f.s WHERE t.doc_id > f.least
    ), numbered AS (
        SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts
    ), runs AS (
        SELECT doc_id, min(i) AS first, max(i) + 49 AS last FROM numbered GROUP BY doc_id, run
    ), gaps AS (
        SELECT doc_id, first, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) + 1 AS a,
            first - 1 AS z
        FROM runs
        UNION ALL SELECT b.doc_id, b.n + 1, coalesce(max(r.last), 0) + 1, b.n
        FROM bytes b LEFT JOIN runs r ON b.doc_id = r.doc_id GROUP BY b.doc_id, b.n
    ), kept AS (
        SELECT g.doc_id, string_agg(hex(b.b[g.a:g.z]), '' ORDER BY g.first) AS h
        FROM gaps g JOIN bytes b ON g.doc_id = b.doc_id WHERE g.z >= g.a GROUP BY g.doc_id
    ), totals AS (
        SELECT doc_id, sum(last - first + 1) AS removed, count(*) AS spans FROM runs GROUP BY doc_id
    )
    SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed,
        coalesce(t.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
    FROM bytes b LEFT JOIN totals t ON b.doc_id = t.doc_id LEFT JOIN kept k ON b.doc_id = k.doc_id
    """,
)
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffixes.remove_shared(docs)
    digest = F.sha2("shared.kept", 256).alias("kept_sha256")
    return cut.select("doc_id", "shared.n_bytes", "shared.n_removed", "shared.n_spans", digest)


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_ids(table(spark, sf_dir, "documents")))


@query("op10_bpe_round_trip")
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.decode(coded).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_secret_scans")
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.scan(docs)
    base = [kind.name for kind in secrets.KINDS if kind.base]

    def only(*names: str):
        return F.filter("secrets", lambda x: x["kind"].isin(*names))

    return found.select(
        "doc_id",
        *[F.size(only(name)).cast("bigint").alias(f"n_{name}") for name in base],
        F.sha2(secrets.as_text(only(*base)), 256).alias("base_sha256"),
        secrets.as_text(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda x: x["live"])).cast("bigint").alias("n_live"),
    )


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars")
    )


@query("op8_embedding_near_dedup")
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op12_merkle_manifest",
    """
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, n_chars,
            coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
                || coalesce(octet_length(encode(source)) || ':' || source, '-')
                || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
            coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
            list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda crc, b:
                list_reduce([xor(crc, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda r, i:
                    xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT) AS crc
        FROM documents
    ), hashed AS (
        SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
            CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(
                head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS claim
        FROM leaves
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
    ), levels AS (
        SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
        UNION ALL
        SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2),
            lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], '')))
        FROM levels WHERE len(nodes) > 1
    ), subroots AS (
        SELECT lang, level AS height, nodes[1] AS subroot,
            row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos
        FROM levels WHERE len(nodes) = 1
    ), tops AS (
        SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
        UNION ALL
        SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2),
            lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], '')))
        FROM tops WHERE len(nodes) > 1
    ), paths AS (
        SELECT p.doc_id, p.leaf, l.level, (p.pos >> l.level) % 2 = 1 AS is_left,
            coalesce(l.nodes[xor(p.pos >> l.level, 1) + 1], '') AS sibling
        FROM placed p JOIN levels l ON l.lang IS NOT DISTINCT FROM p.lang WHERE len(l.nodes) > 1
        UNION ALL
        SELECT p.doc_id, p.leaf, s.height + t.level, (s.pos >> t.level) % 2 = 1,
            coalesce(t.nodes[xor(s.pos >> t.level, 1) + 1], '')
        FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN tops t WHERE len(t.nodes) > 1
    ), folds AS (
        SELECT doc_id, leaf, 0 AS level, coalesce(claim, leaf) AS node FROM placed
        UNION ALL
        SELECT f.doc_id, f.leaf, f.level + 1,
            sha256(CASE WHEN is_left THEN sibling || node ELSE node || sibling END)
        FROM folds f JOIN paths p ON p.doc_id = f.doc_id AND p.leaf = f.leaf AND p.level = f.level
    ), proofs AS (
        SELECT doc_id, leaf, sha256(string_agg(sibling, '' ORDER BY level)) AS proof FROM paths GROUP BY doc_id, leaf
    ), ends AS (
        SELECT doc_id, leaf, arg_max(node, level) AS folded FROM folds GROUP BY doc_id, leaf
    )
    SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(f.proof, sha256('')) AS proof_sha256,
        e.folded AS folded_root, e.folded = r.root AS verified
    FROM placed p
    JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    CROSS JOIN (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1) r
    JOIN ends e ON e.doc_id = p.doc_id AND e.leaf = p.leaf
    LEFT JOIN proofs f ON f.doc_id = p.doc_id AND f.leaf = p.leaf
    """,
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proved = merkle.prove(
        table(spark, sf_dir, "documents"),
        claims={"n_chars": F.col("n_chars") + 1},
        when=F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
    )
    siblings = F.array_join(F.transform("path", lambda s: s["sibling"]), "")
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified"
    )


@query(
    "op13_hard_negatives",
    """
    WITH points AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
            list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM points a JOIN points c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, positive_id,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
        s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
        AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfiles.write(table(spark, sf_dir, "documents"))
    return tokenfiles.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
