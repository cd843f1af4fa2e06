"""Exact dedup: group by a 128-bit content hash, keep the smallest stable id, compare bytes.

Expressions and joins only; no Python runs in tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: One space for each run of ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text two documents are compared by; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by the MD5 of the normalised text *and* that text, so Spark
    compares bytes whenever two hashes agree; the partial aggregation folds
    copies before the shuffle, and a group of any size arrives as one row per
    map task.  Rows get their group back by a join on MD5 and SHA-256 (small
    keys, no text moves again): texts whose MD5 collides are different groups
    by their bytes and stay apart in that join by their SHA-256.

    * null text: equal to the empty text;
    * null id: never the smallest unless all ids of the group are null;
    * repeated rows: rows with the same id and text are one document and get the
      same answer, each counts in ``group_size``;
    * empty table: no rows.  Columns not named are ignored.

    ``carry`` names input columns to hand through in a struct ``rest``.
    """
    names = {f"r{i}": n for i, n in enumerate(carry or [])}
    rest = [F.struct(*[F.col(a).alias(n) for a, n in names.items()]).alias("rest")] if names else []
    rows = pick(docs, doc_id=id_col, text=text_col, **names).select("doc_id", normalised(F.col("text")).alias("text"), *rest)
    rows = rows.withColumn("h", F.unhex(F.md5("text"))).withColumn("s", F.sha2("text", 256))
    groups = (rows.groupBy("h", "s", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .select("h", "s", "keep_id", "group_size"))
    kept_columns = ["rest"] if names else []
    out = rows.select("doc_id", "h", "s", *kept_columns).join(groups, ["h", "s"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("s").alias("text_sha256"), *kept_columns)


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
