"""URL filter: rules first, else logistic regression on hashed character n-grams.

The features of a URL are the n-grams (3 to 5 bytes) of its host and of its
path, each marked with its part, hashed into 2**BITS slots, present or not. The
model is trained on the driver from a small labelled URL table; the threshold is
the one that tells the table's held-out rows apart best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import mix64, tune, utf8
from mnemolake.llm.url_examples import urls

BITS = 18
GRAMS = (3, 4, 5)
ROUNDS = 200
#: Fixed values of the contract: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_K = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones, of
    the first given. A rule fits its host and all subdomains, where the path starts with
    the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(tuple(rules)), key=lambda r: len(r[0] + r[1])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _edged(part: pa.Array) -> pa.Array:
    return pa.array(["^" + (x or "") + "$" for x in part.to_pylist()], pa.large_string())


def slots(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct slots of each URL's n-grams, and of the bias, the last slot."""
    found = [np.arange(len(hosts)) << (BITS + 1) | 1 << BITS]
    for mark, part in enumerate((hosts, paths)):
        at, raw = utf8(_edged(part))
        row = np.repeat(np.arange(len(hosts)), np.diff(at))
        for n in GRAMS:
            if len(raw) < n:
                continue
            h = np.full(len(raw) - n + 1, np.uint64(n * 2 + mark))
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = mix64(h * _K + raw[k : len(raw) - n + 1 + k])
            own = row[: len(h)] == row[n - 1 :]  # n-grams of one URL
            found.append(row[: len(h)][own] << (BITS + 1) | (h[own] & np.uint64((1 << BITS) - 1)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> (BITS + 1), both & ((1 << (BITS + 1)) - 1)


def score(weights: np.ndarray, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """The model's estimate that each URL may pass."""
    row, slot = slots(hosts, paths)
    size = np.bincount(row, minlength=len(hosts))
    return 1 / (1 + np.exp(-np.bincount(row, weights[slot], len(hosts)) / np.sqrt(size)))


def train(labelled: list[tuple[str, str, bool]], decay: float = 1e-4) -> np.ndarray:
    """Weights, the last of which is the bias, from (host, path, allowed); all zero
    (allow) without examples. Full-batch gradient steps with momentum; each example
    is scaled to unit length, and both labels weigh alike."""
    weights = np.zeros((1 << BITS) + 1)
    if not labelled:
        return weights
    row, flat = slots(pa.array([x[0] for x in labelled]), pa.array([x[1] for x in labelled]))
    value = 1 / np.sqrt(np.bincount(row))[row]
    y = np.array([x[2] for x in labelled], float)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    moving = np.zeros_like(weights)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.bincount(row, weights[flat] * value, len(labelled))))
        slope = np.bincount(flat, ((p - y) * share)[row] * value, len(weights)) + decay * weights
        moving = 0.9 * moving - 5.0 * slope
        weights = weights + moving
    return weights


def calibrate(weights: np.ndarray, held: list[tuple[str, str, bool]]) -> float:
    """The threshold at which most held-out rows, both labels weighing alike, are told
    rightly; of equally good ones the middle. One half where a label is missing."""
    y = np.array([x[2] for x in held], bool)
    if not len(held) or y.all() or not y.any():
        return 0.5
    s = score(weights, pa.array([x[0] for x in held]), pa.array([x[1] for x in held]))
    order = np.argsort(s)
    s, y = s[order], y[order]
    # cut before place k: the k lowest are blocked
    right = np.append(0, np.cumsum(~y)) / (~y).sum() + np.append(y.sum(), y.sum() - np.cumsum(y)) / y.sum()
    best = np.nonzero(right == right.max())[0]
    k = int(best[len(best) // 2])
    return float((s[max(k - 1, 0)] + s[min(k, len(s) - 1)]) / 2)


def _scorer(shared: object) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value  # type: ignore[attr-defined]
        for batch in batches:
            told = score(weights, batch.column("host"), batch.column("path"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, most_labels: int = 4000, threshold: float | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score.

    labelled (url, allowed) trains the model, url_examples by default. The table is small
    by contract: of it the most_labels rows with the smallest hash count; every third is
    held out to set the threshold, if none is given. score is the model's estimate that
    the URL may pass; a verdict is the rule's, else allow from the threshold on. A null URL,
    or one without ://, has empty host and path, no rule, and the model's verdict on those.
    Of equally long rules the first given wins. URLs count whole, however long. Rows are
    judged one by one, so repeats get equal answers; an empty table gives an empty result;
    other columns of pages, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    tune(spark)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        examples = urls()
    else:
        taught = labelled.filter(F.col("allowed").isNotNull()).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "allowed")
        examples = [(*r, i % 3) for i, r in enumerate(taught.orderBy(F.xxhash64("host", "path"), "host", "path", "allowed").limit(most_labels).collect())]
    weights = train([r[:3] for r in examples if r[3]])
    least = calibrate(weights, [r[:3] for r in examples if not r[3]]) if threshold is None else threshold
    shared = spark.sparkContext.broadcast(weights)
    kind = rows.schema["page_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(shared), f"page_id {kind}, host string, path string, rule string, ruled string, score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= least, "allow").otherwise("block")).alias("verdict"), "score")
