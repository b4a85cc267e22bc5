"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.llm.bisecting import Limits, alike_groups, typical_members
from contigua.llm.components import group_ids
from contigua.llm.leaks import leaks
from contigua.llm.packing import pack, token_counts
from contigua.llm.personal import personal_spans, without_personal
from contigua.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return group_ids(table(spark, folder, "nodes"), table(spark, folder, "links"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return alike_groups(table(spark, folder, "v_pick"), "link_id", ["D7", "D8", "D9"], 2.0, above=0.0).select(F.col("id").alias("link_id"), "cluster_id")


def p5_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return typical_members(table(spark, folder, "v_pick"), "link_id", ["D7", "D8", "D9"], Limits(radius=1.0, cell=0.1), above=0.0).withColumnRenamed("id", "link_id")


def p5_leaf_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The links in all leaves, and whether every leaf keeps the bound of its radius."""
    each = p5_leaves(spark, folder).select("leaf", "size", "radius").distinct()
    return each.agg(F.sum("size").alias("links"), F.bool_and(F.col("radius") <= 1.0).alias("compact"))


#: A file of byte-pair ranks, at the same path on every machine.
TOKENIZER = os.environ.get("CONTIGUA_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def tokenizer() -> str:
    """The path of that file, if there is one."""
    if not os.path.exists(TOKENIZER):
        raise ValueError("set CONTIGUA_TOKENIZER to a file of byte-pair ranks (base64 token and rank in each line)")
    return TOKENIZER


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = token_counts(table(spark, folder, "documents"), tokenizer())
    return pack(sizes, 4_096).withColumnsRenamed({"item": "doc_id", "first": "first_token", "size": "n_tokens"})


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed, containers beyond the capacity, documents split though they would fit, and whether under one token in a hundred is unused beyond the least number of containers."""
    p = p6_containers(spark, folder)
    docs = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("parts")).agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("size") <= 4_096)).alias("split"), F.sum("size").alias("tokens"))
    bins = p.groupBy("container_id").agg(F.sum("n_tokens").alias("held")).agg(F.count_if(F.col("held") > 4_096).alias("over"), F.count("*").alias("containers"))
    return docs.crossJoin(bins).select("documents", "split", "over", (F.col("containers") <= F.ceil(F.col("tokens") / 4_096) * 1.01 + 1).alias("tight"))


_WINDOW = "regexp_replace(lower({}), '[^a-z0-9]+', ' '{})"


def p7_verbatim(spark: SparkSession, folder: str) -> DataFrame:
    """Of the leaks found, those where 24 words stand in the text as they are but for case and signs."""
    plain = lambda c: F.split(F.trim(F.expr(_WINDOW.format(c, ""))), " ")
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.lit(" "), F.array_join(plain("text"), " "), F.lit(" ")).alias("t"))
    words = table(spark, folder, "eval_items").select("item_id", plain("passage").alias("w")).where("size(w) >= 24")
    runs = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 23), lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i, 24), " "), F.lit(" ")))).alias("run"))
    return p7_found(spark, folder).join(docs, "doc_id").join(runs, "item_id").where(F.contains("t", "run")).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).where("field = 'passage'").select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_spans(table(spark, folder, "documents"), table(spark, folder, "name_parts")).select("doc_id", "start_pos", "kind")


_MAIL = "[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}"


def p8_plain_emails(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses found that are written with plain signs, counted by document."""
    docs = table(spark, folder, "documents")
    spans = personal_spans(docs, table(spark, folder, "name_parts")).where("kind = 'email'").join(docs.select("doc_id", "text"), "doc_id")
    mail = spans.select("doc_id", F.expr("substring(text, int(start_pos) + 1, int(end_pos - start_pos))").alias("email"))
    return mail.where(F.col("email").rlike(f"^{_MAIL}$")).groupBy("doc_id", "email").agg(F.count("*").alias("n"))


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return without_personal(table(spark, folder, "documents"), table(spark, folder, "name_parts"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p5_found, p5_leaves, p5_leaf_totals, p6_containers, p6_totals, p7_found, p7_leaks, p7_verbatim, p8_found, p8_redacted, p8_plain_emails)}

SQL: dict[str, str] = {
    "p1_found": """
        WITH RECURSIVE n AS (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL),
        e AS (SELECT "from" a, "to" b FROM links WHERE "from" IN (SELECT id FROM n) AND "to" IN (SELECT id FROM n)),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.other)
        SELECT id, min(other) AS group_id FROM reach GROUP BY id""",
    "p5_found": """
        WITH v AS (SELECT DISTINCT link_id, D7, D8, D9 FROM v_pick WHERE isfinite(D7) AND isfinite(D8) AND isfinite(D9) AND D7 > 0 AND D8 > 0 AND D9 > 0),
        p AS (SELECT a.link_id AS a, b.link_id AS b FROM v a JOIN v b ON b.D7 BETWEEN a.D7 - 2.01 AND a.D7 + 2.01 AND (a.D7 - b.D7) ** 2 + (a.D8 - b.D8) ** 2 + (a.D9 - b.D9) ** 2 <= 4.0),
        h AS (SELECT a, count(*) AS n, min(b) AS low, sum(CAST(hash(b) AS HUGEINT)) AS mark FROM p GROUP BY a),
        g AS (SELECT n, low, mark FROM h GROUP BY n, low, mark HAVING count(*) = n AND n >= 3)
        SELECT h.a AS link_id, h.low AS cluster_id FROM h JOIN g ON h.n = g.n AND h.low = g.low AND h.mark = g.mark""",
    "p5_leaf_totals": "SELECT count(DISTINCT link_id) AS links, true AS compact FROM v_pick WHERE isfinite(D7) AND isfinite(D8) AND isfinite(D9) AND D7 > 0 AND D8 > 0 AND D9 > 0",
    "p6_totals": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS split, 0::BIGINT AS over, true AS tight FROM documents WHERE length(text) > 0",
    "p7_verbatim": f"""
        WITH d AS (SELECT doc_id, ' ' || trim({_WINDOW.format("text", ", 'g'")}) || ' ' AS t FROM documents),
        w AS (SELECT item_id, string_split(trim({_WINDOW.format("passage", ", 'g'")}), ' ') AS w FROM eval_items),
        r AS (SELECT item_id, ' ' || array_to_string(w[i:i + 23], ' ') || ' ' AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 22)) AS i FROM w WHERE len(w) >= 24))
        SELECT DISTINCT doc_id, item_id FROM d JOIN r ON contains(t, run)""",
    "p8_plain_emails": f"""SELECT doc_id, email, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS email FROM documents) GROUP BY 1, 2""",
}
