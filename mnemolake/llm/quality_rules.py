"""Quality rules by host: failures are counted per domain, the rates are shrunk by an
empirical beta prior, and the hosts' verdicts go back to the documents.

A document fails the base rule by being short or by repeating itself. Of a host with
f failures in n documents the shrunk rate is (f + a) / (n + a + b); a and b are
fitted to all hosts' rates by moments. A host whose shrunk rate reaches the limit
loses all its documents: small hosts stay near the prior, so it takes many failures
to condemn one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import SPACES, stage, tune, utf8
from mnemolake.llm.flat_words import coded, window_groups, words

LIMIT = 0.5
MIN_WORDS = 50
#: Bytes of texts measured together.
PIECE = 1 << 21


def _measures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, raw = utf8(batch.column("text"))
        n = len(at) - 1
        out = np.zeros((5, n), np.int64)
        a = 0
        while a < n:
            b = a + 1
            while b < n and at[b + 1] - at[a] <= PIECE:
                b += 1
            out[:, a:b] = measure(at[a : b + 1] - at[a], raw[at[a] : at[b]])
            a = b
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *[pa.array(x) for x in out]], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(SPACES)] = True


def measure(at: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Five counts of each text: words, their code points, symbols, lines (with a
    word) equal to an earlier one, words in 3-word windows found twice or more. Words,
    windows and lines are compared themselves, not by hashes."""
    n = len(at) - 1
    first, last, text = words(at, raw)
    code, _ = coded(raw, first, last)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    starts = (raw & 0xC0) != 0x80
    chars = sums(starts & ~_BLANK[raw])
    symbols = sums(_SYMBOL[raw])
    win, group = window_groups(code, text, 3)
    repeated = np.zeros(len(code) + 1, np.int64)
    if len(win):
        again = win[np.bincount(group)[group] > 1]
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + 3, -1)
    covered = np.cumsum(repeated)[:-1] > 0
    dup = np.zeros(n, np.int64)
    data = raw.tobytes()
    for k in np.nonzero(sums(raw == 10))[0].tolist():  # texts of one line repeat none
        lines = [x for x in data[at[k] : at[k + 1]].split(b"\n") if x.strip()]
        dup[k] = len(lines) - len(set(lines))
    return np.stack([np.bincount(text, minlength=n), chars, symbols, dup, np.bincount(text, covered, n).astype(np.int64)])


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Null, empty and blank texts have no words and fail. A null host is a host. Texts are
    measured whole, however long. Rows that repeat count each; rows that tie in doc_id are
    judged one by one. With fewer than two hosts, or all rates alike, the prior is the mean
    rate with the weight of one document. An empty table gives an empty result; other
    columns of docs, whatever their names, are ignored.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    counted = rows.mapInArrow(_measures, f"doc_id {kinds['doc_id']}, host {kinds['host']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    slim = stage(counted.withColumn("base_failed", failed), "measures")
    hosts = slim.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    # by moments over hosts: mean m, variance v, a + b = m (1 - m) / v - 1
    prior = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(rate).alias("s"), F.sum(rate * rate).alias("q"))
    m, v = F.col("s") / F.col("k"), F.col("q") / F.col("k") - (F.col("s") / F.col("k")) * (F.col("s") / F.col("k"))
    prior = prior.select(m.alias("m"), F.when(v > 1e-12, F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(1.0).alias("weight")).first()
    mean, weight = prior["m"] or 0.0, prior["weight"]  # two numbers of the whole corpus
    # stored: its size is then known, so it is broadcast if small and a hot host is split if not
    judged = stage(hosts.select(F.col("host").alias("name"), ((F.col("f") + F.lit(mean) * weight) / (F.col("n") + F.lit(weight)) < limit).alias("host_ok")), "hosts")
    out = slim.join(judged, F.col("host").eqNullSafe(F.col("name")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


#: DuckDB, over whole tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
a AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM a, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT)::BIGINT AS f, sum(base_failed::INT)::BIGINT / count(*) AS rate FROM f GROUP BY source),
p AS (SELECT sum(rate) / count(*) AS m, sum(rate * rate) / count(*) - (sum(rate) / count(*)) * (sum(rate) / count(*)) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END AS weight FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (h.f + m * weight) / (h.n + weight) < 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, q
"""
