"""op11: periodic runs of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import periodic
from undula.llm.catalogue import query, table

_WORD = "[^\\x20\\x09-\\x0D]+"
SQL = f"""WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
  xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS bent, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
x AS (SELECT doc_id, n, CASE WHEN bent THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM g),
u AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM x),
e AS (SELECT l.doc_id, r.i - l.i AS p, l.i AS i FROM u l JOIN u r ON l.doc_id = r.doc_id AND l.w = r.w AND r.i > l.i AND r.i - l.i <= l.n // 4),
s AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e),
t AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM s GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM t GROUP BY doc_id, start, length),
a AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
  first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best FROM r GROUP BY doc_id),
c AS (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM u ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)"""


def bent(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which every tenth document, by crc32 of its id, goes on in a period from some word on.

    A null id has the crc32 of no bytes, which is 0.
    """
    d = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)).alias("h"))
    d = d.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({_WORD})"))))
    d = d.withColumn("n", F.when(F.size("w") > 0, F.size("w")).cast("bigint")).withColumn("g", F.expr("h div 10"))
    d = d.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    words = F.expr("transform(sequence(0L, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))])")
    return d.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", SQL)
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.periodic_runs(bent(table(spark, sf, "documents")))
    longest = F.expr("reduce(runs, CAST(null AS struct<start: bigint, length: bigint, period: bigint>), (m, r) -> if(m IS NULL OR r.length > m.length, r, m))")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    d = found.withColumn("best", longest).withColumn("lines", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return d.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )
