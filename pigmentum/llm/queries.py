"""The subpackage's queries, one per operator over its whole table, and their SQL where there is any."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, langid, licenses, lm, mtree, packing, quality, repair, simhash, token_counts, urls, windows
from .common import bucket, docs, map_batches


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(docs(spark, sf_dir)).drop("spans")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(docs(spark, sf_dir))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's ids and decoded texts as digests, taken in the same pass: only digests leave the workers."""

    def digests(batches):
        for b in bpe.encoded(batches):
            ids = b.column(1)
            flat, ends = ids.values.to_pylist(), ids.offsets.to_pylist()
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            own = [sha(",".join(map(str, flat[s:e]))) for s, e in zip(ends, ends[1:], strict=False)]
            n = pa.array([e - s for s, e in zip(ends, ends[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(own, pa.string()), pa.array(map(sha, b.column(2).to_pylist()), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs(spark, sf_dir), ["doc_id", "text"], digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = docs(spark, sf_dir)
    held_out = bucket(F.col("doc_id"), 4) == 2
    out = langid.predict(table, langid.fit(table.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(docs(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(docs(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(docs(spark, sf_dir))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(mtree.whole_vectors(docs(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, 10)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(docs(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(docs(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the repaired conversations, with those that the damage left without rows."""
    table = docs(spark, sf_dir, "conversations")
    found = repair.summaries(repair.parse(repair.damage(table))).withColumnRenamed("conv_id", "of")
    ids = table.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), nothing)


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack(docs(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's codes, with the codebooks' digest in every row."""
    coded, books = codes.compress(codes.vectors(docs(spark, sf_dir, "embeddings")))
    digest = hashlib.sha256((books.text() if books else "").encode()).hexdigest()
    return codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_lm_scores, op3_bpe_roundtrip, op4_language_id, op5_url_filter, op6_quality_rules, op7_token_counts, op8_top_k, op9_simhash, op10_packing, op11_conversation_repair, op12_window_packing, op13_vector_codes)
}

def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """Rounds of nearest entries and floored means, one pair of tables a round."""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda n: f"a{n} AS MATERIALIZED (SELECT part, rid, min(struct_pack(d := {far}, e := e)) AS b FROM p JOIN c{n} USING (part) GROUP BY part, rid)"
    floor = "CAST((s - (s % n + n) % n) // n AS BIGINT)"
    move = lambda n: f"""m{n} AS (SELECT part, e, list({floor} ORDER BY i) AS c FROM (SELECT part, b.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN p USING (part, rid) CROSS JOIN (SELECT unnest(range(1, 9)) AS i) GROUP BY part, b.e, i) GROUP BY part, e),
        c{n + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (part, e))"""  # noqa: E731
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        p AS MATERIALIZED (SELECT rid, k AS part, q[k * 8 + 1 : k * 8 + 8] AS x FROM v CROSS JOIN (SELECT unnest(range(8)) AS k)),
        c0 AS (SELECT part, rid - 1 AS e, x AS c FROM p WHERE rid <= {codes.ENTRIES}),
        {", ".join(f"{near(n)}, {move(n)}" for n in range(rounds))}, {near(rounds)},
        f AS (SELECT rid, string_agg(printf('%02x', b.e), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
          (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256 FROM v JOIN f USING (rid)"""


#: The other operators have no SQL; tests hold them against brute force, round trips or held-out data.
SQL: dict[str, str] = {
    "op8_top_k": """
        WITH v AS (
          SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
          SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
          FROM v q JOIN v c ON c.rid <> q.rid WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_vector_codes": _codes_sql(),
}
