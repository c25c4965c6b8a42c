"""The registered queries of the numbered problems and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import abuse, leakage, mixing, neardup, provenance, secrets, splitting, truncation
from quarrylens.session import table


def _stored_texts(spark: SparkSession, d: str) -> DataFrame:
    fields = (("vulns", "vuln_id", "poc_code", True), ("da_results", "da_id", "rebuttal", False), ("poc_results", "run_id", "stdout", False))
    parts = [
        table(spark, d, t).select(
            F.lit(t).alias("tbl"), F.col(i).alias("row_id"), "source", F.col(c).alias("text"), F.lit(code).alias("code")
        )
        for t, i, c, code in fields
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(_stored_texts(spark, d)).where("cut").select("tbl", "row_id")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    values = _stored_texts(spark, d)
    return truncation.cut_shares(values, truncation.judge(values))


def p1_evidence(spark: SparkSession, d: str) -> DataFrame:
    return truncation.evidence(truncation.judge(_stored_texts(spark, d)))


def _vuln_duplicates(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    """Three words and 0.6, as the data description fixes them for this table; 32 coordinates are enough for 3.3 standard deviations."""
    text = neardup.joined_fields("description", "root_cause", "affected_file")
    return neardup.NearDuplicates(table(spark, d, "vulns"), "vuln_id", text, width=3, similarity=0.6, coordinates=32)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _vuln_duplicates(spark, d).pairs().select(
        F.col("id_a").alias("vuln_id_a"), F.col("id_b").alias("vuln_id_b")
    )


def p2_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Representatives of classes of equal texts that are alike, with their exact similarity; copies are not expanded."""
    return _vuln_duplicates(spark, d).class_pairs().select(
        F.col("rep_a").alias("vuln_id_a"), F.col("rep_b").alias("vuln_id_b"), F.round("similarity", 6).alias("similarity")
    )


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return _vuln_duplicates(spark, d).groups().select(
        F.col("id").alias("vuln_id"), "group_id", "links"
    )


def _code(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").select(F.lit("nodes").alias("tbl"), F.col("id").alias("row_id"), F.col("code").alias("text"))
    return nodes.unionByName(
        table(spark, d, "vulns").select(F.lit("vulns").alias("tbl"), F.col("vuln_id").alias("row_id"), F.col("poc_code").alias("text"))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(_code(spark, d))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_secrets(_code(spark, d))


def _files(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").select(F.lit("nodes").alias("tbl"), "repo", F.col("file").alias("file_path"), "code")
    return nodes.unionByName(table(spark, d, "func_nodes").select(F.lit("func_nodes").alias("tbl"), "repo", "file_path", "code"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.judge_files(_files(spark, d)).select("tbl", "repo", "file_path")


def p4_hand_written(spark: SparkSession, d: str) -> DataFrame:
    """Rows of hand-written files, with their table and repo."""
    files = _files(spark, d).where("file_path is not null")
    odd = p4_found(spark, d).select(F.col("tbl").alias("t"), F.col("repo").alias("r"), F.col("file_path").alias("p"))
    kept = files.join(odd, (F.col("tbl") == F.col("t")) & F.col("repo").eqNullSafe(F.col("r")) & (F.col("file_path") == F.col("p")), "left_anti")
    return kept.groupBy("tbl", "repo", "file_path").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("code")).alias("chars"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").select(F.lit("nodes").alias("tbl"), F.col("id").alias("row_id"), F.col("code").alias("text"))
    chunks = table(spark, d, "code_chunks").select(
        F.lit("code_chunks").alias("tbl"), F.col("chunk_id").alias("row_id"), F.col("code").alias("text")
    )
    return nodes.unionByName(chunks)


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_sized(spark, d), table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value that was cut, by its second piece."""
    return p5_pieces(spark, d).where("piece_no = 1").select("tbl", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "holdout_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "holdout_items")
    return leakage.leaked_items(leakage.leaks(table(spark, d, "documents"), items), items)


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).chosen().select("doc_id", "source", "tokens", "repeats")


def p7_quality(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).quality()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def _abuse(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).select("doc_id", "score", "direct_score", "quoted_score")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_abuse(spark, d))


QUERIES = {
    "p1_found": p1_found, "p1_shares": p1_shares, "p1_evidence": p1_evidence,
    "p2_found": p2_found, "p2_groups": p2_groups, "p2_class_pairs": p2_class_pairs,
    "p3_found": p3_found, "p3_redacted": p3_redacted,
    "p4_found": p4_found, "p4_hand_written": p4_hand_written,
    "p5_found": p5_found, "p5_pieces": p5_pieces,
    "p6_found": p6_found, "p6_items": p6_items,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_quality": p7_quality,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
}

_WORDS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
_RUNS = "list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' '))"

_SHINGLES = f"""w AS (SELECT vuln_id, {_WORDS.format(c="concat_ws(' ', coalesce(description, ''), coalesce(root_cause, ''), coalesce(affected_file, ''))")} AS w FROM vulns),
        s AS (SELECT DISTINCT vuln_id, unnest({_RUNS.format(k=3)}) AS s FROM w WHERE len(w) >= 3),
        n AS (SELECT vuln_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.vuln_id AS a, b.vuln_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.vuln_id < b.vuln_id GROUP BY 1, 2),
        p AS (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM c JOIN n x ON x.vuln_id = a JOIN n y ON y.vuln_id = b WHERE c >= 0.6 * (x.n + y.n - c))"""

ORACLE = {
    "p2_class_pairs": f"""
        WITH {_SHINGLES}, k AS (SELECT vuln_id, list_sort(list(s)) AS key FROM s GROUP BY 1), r AS (SELECT min(vuln_id) AS rep FROM k GROUP BY key)
        SELECT a AS vuln_id_a, b AS vuln_id_b, round(similarity, 6) AS similarity FROM p WHERE a IN (SELECT rep FROM r) AND b IN (SELECT rep FROM r)
    """,
    "p2_groups": f"""
        WITH RECURSIVE {_SHINGLES}, e AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p),
        reach AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v)
        SELECT n.vuln_id, coalesce((SELECT min(v) FROM reach WHERE u = n.vuln_id), n.vuln_id) AS group_id, (SELECT count(*) FROM e WHERE u = n.vuln_id) AS links FROM n
    """,
    "p6_items": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM holdout_items),
        dr AS (SELECT doc_id, p, array_to_string(w[p : p + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
        ir AS (SELECT item_id, p, array_to_string(w[p : p + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12)),
        m AS (SELECT DISTINCT doc_id, item_id, dr.p - ir.p AS shift, ir.p AS p FROM dr JOIN ir USING (run)),
        g AS (SELECT doc_id, item_id, shift, p - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS island FROM m),
        r AS (SELECT doc_id, item_id, count(*) + 11 AS run FROM g GROUP BY doc_id, item_id, shift, island),
        t AS (SELECT item_id, count(DISTINCT doc_id) AS documents, max(run) AS longest FROM r GROUP BY 1)
        SELECT h.item_id, h.task, h.lang, coalesce(t.documents, 0) AS documents, coalesce(t.longest, 0)::INT AS longest_run,
          round(coalesce(t.longest / len(i.w), 0.0), 4)::DOUBLE AS covered
        FROM holdout_items h JOIN i USING (item_id) LEFT JOIN t USING (item_id)
    """,
    "p2_found": f"WITH {_SHINGLES} SELECT a AS vuln_id_a, b AS vuln_id_b FROM p",
    "p5_found": """
        SELECT t.tbl, t.row_id FROM (
            SELECT 'nodes' AS tbl, id AS row_id, code FROM nodes
            UNION ALL SELECT 'code_chunks', chunk_id, code FROM code_chunks
        ) t JOIN size_limits l ON l.tbl = t.tbl WHERE length(t.code) > l.max_chars
    """,
    "p6_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM holdout_items),
        dr AS (SELECT DISTINCT doc_id, unnest({_RUNS.format(k=12)}) AS run FROM d WHERE len(w) >= 12),
        ir AS (SELECT DISTINCT item_id, unnest({_RUNS.format(k=12)}) AS run FROM i WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)
    """,
}
