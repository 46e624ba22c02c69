"""Language ID by prediction by partial matching (PPM) over bytes.

Per language, a variable-order context tree of byte counts, up to ORDER bytes of
context. A byte costs ``-log2 p``: from the longest context that saw the byte, after
the escapes of the longer ones (method C: of n bytes and d kinds seen after a
context, a seen byte has c / (n + d), an escape d / (n + d); below order 0 all 256
bytes are alike). No exclusions: probabilities then sum to at most 1. The
statistics are frozen, so a byte's cost depends on ORDER + 1 bytes only and a
text's exact code length is a sum of table entries, in units of 2**-16 bits.

The trees of all languages share one union trie, walked for all bytes of a batch
at once: node k of a byte is the child of node k-1 of the byte before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.common import tune, utf8, with_fields

ORDER = 3
#: Stands before every text, so that first bytes have a context as well.
LEAD = b"\n" * ORDER
UNIT = 1 << 16
#: Bytes walked at once, for up to four languages, and fewer for more: some 30 bytes of
#: scratch for each, and 16 a language.
PIECE = 1 << 18


@dataclass
class Model:
    """languages; symbol of each byte; children[node, symbol] (0: none, node 0 is
    void, node 1 the root); cost[node, language] of the last byte of the node's
    string; escape[node, language] of a byte not seen after it; void[language]."""

    languages: list[str]
    symbol: np.ndarray
    children: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]
    floor: np.ndarray
    width: int = 1


def train(samples: dict[str, list[bytes]]) -> Model:
    """From whole texts of each language."""
    languages = sorted(samples)
    joined = {k: np.frombuffer(LEAD + LEAD.join(samples[k]), np.uint8) for k in languages}
    seen = np.unique(np.concatenate([*joined.values(), np.frombuffer(LEAD, np.uint8)]))
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    width, n_lang = len(seen) + 1, len(languages)
    flat = {k: symbol[v] for k, v in joined.items()}
    # strings of depth 1..ORDER+1 over the alphabet, as numbers in base width
    children, counts, keys_by_depth = [], [], []
    codes = {k: np.zeros(len(v) - ORDER, np.int64) for k, v in flat.items()}
    # depth d string of position i: the d symbols that end at i
    parents = {k: np.zeros(len(v) - ORDER, np.int64) for k, v in flat.items()}
    for depth in range(1, ORDER + 2):
        for k, v in flat.items():
            codes[k] = np.zeros(len(v) - ORDER, np.int64)
            for back in range(depth - 1, -1, -1):
                codes[k] = codes[k] * width + v[ORDER - back : len(v) - back]
        union = np.unique(np.concatenate([codes[k] for k in languages]))
        count = np.zeros((len(union) + 1, n_lang), np.int64)
        for j, k in enumerate(languages):
            at = np.searchsorted(union, codes[k]) + 1
            count[:, j] = np.bincount(at, minlength=len(union) + 1)
            parents[k] = at
        keys_by_depth.append(union)
        counts.append(count)
    for depth in range(ORDER + 1):  # children of depth-d nodes are depth-(d+1) nodes, by the last symbol
        above = keys_by_depth[depth - 1] if depth else np.zeros(0, np.int64)
        table = np.zeros(((len(above) + 1 if depth else 1) * width,), np.int32)
        union = keys_by_depth[depth]
        prefix, last = union // width, union % width
        node = np.searchsorted(above, prefix) + 1 if depth else np.zeros(len(union), np.int64)
        if depth:  # a string may end where no context begins: its prefix then is not a node
            found = above[np.minimum(node - 1, len(above) - 1)] == prefix
        else:
            found = np.ones(len(union), bool)
        table[(node * width + last)[found]] = (np.arange(len(union)) + 1)[found]
        children.append(table)
    bits = lambda x: np.round(x * UNIT).astype(np.int32)
    cost: list[np.ndarray] = []
    escape: list[np.ndarray] = []
    floor = np.full(n_lang, 8.0)
    for depth in range(ORDER + 1):  # context of length depth, string of length depth + 1
        union, count = keys_by_depth[depth], counts[depth]
        if depth:
            above = keys_by_depth[depth - 1]
            ctx = np.minimum(np.searchsorted(above, union // width), len(above) - 1)
            ctx = np.where(above[ctx] == union // width, ctx + 1, 0)
            size = len(above) + 1
        else:
            ctx, size = np.zeros(len(union), np.int64), 1
        total, kinds = np.zeros((size, n_lang)), np.zeros((size, n_lang))
        np.add.at(total, ctx, count[1:])
        np.add.at(kinds, ctx, count[1:] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            esc = np.where(total > 0, -np.log2(np.where(total > 0, kinds / (total + kinds), 1)), 0.0)
            own = -np.log2(np.where(count[1:] > 0, count[1:] / (total[ctx] + kinds[ctx]), 1))
        if depth == 0:
            lower = np.broadcast_to(floor, own.shape)
        else:  # the same byte after a context shorter by its first symbol
            short = np.searchsorted(keys_by_depth[depth - 1], union % width**depth)
            lower = cost[depth - 1][short + 1]
        here = np.where(count[1:] > 0, own, esc[ctx] + lower)
        cost.append(np.vstack([np.zeros((1, n_lang)), here]))
        escape.append(esc)
    return Model(languages, symbol, children, [bits(c) for c in cost], [bits(e) for e in escape], bits(floor), width)


def costs(model: Model, data: np.ndarray) -> np.ndarray:
    """cost[i, language] of each byte of data but the first ORDER, in UNITs."""
    width = int(model.width)
    s = model.symbol[data]
    n = len(s) - ORDER
    # node[d][i]: of the d symbols that end at byte i of data
    node = [np.zeros(len(s), np.int64)]
    for depth in range(1, ORDER + 2):
        prev = node[depth - 1]
        up = np.zeros(len(s), np.int64)
        if depth == 1:
            up[:] = model.children[0][s]
        else:
            at = model.children[depth - 1][prev[:-1] * width + s[1:]]
            up[1:] = np.where(prev[:-1] > 0, at, 0)
        node.append(up)
    out = model.cost[ORDER][node[ORDER + 1][ORDER:]].astype(np.int64)
    miss = np.nonzero(node[ORDER + 1][ORDER:] == 0)[0]
    depth = ORDER
    while len(miss):  # the string is new to all languages: escape to one context less
        at = miss + ORDER
        out[miss] += model.escape[depth][node[depth][at - 1] if depth else np.zeros(len(at), np.int64)]
        if depth == 0:
            out[miss] += model.floor
            break
        known = node[depth][at]
        out[miss] += model.cost[depth - 1][known]
        miss = miss[known == 0]
        depth -= 1
    assert len(out) == n
    return out


def code_lengths(model: Model, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """bits[text, language], in UNITs, of texts laid end to end; exact sums."""
    sizes = np.diff(at)
    total = np.zeros((len(sizes), len(model.languages)), np.int64)
    first, piece = 0, max(1 << 10, PIECE * 4 // max(4, len(model.languages)))
    lead = np.frombuffer(LEAD, np.uint8)
    while first < len(sizes):
        last = first + 1
        while last < len(sizes) and at[last + 1] - at[first] <= piece:
            last += 1
        if last == first + 1 and sizes[first] > piece:  # a long text, piece by piece
            text = raw[at[first] : at[last]]
            for a in range(0, len(text), piece):
                head = lead if a == 0 else text[a - ORDER : a]
                total[first] += costs(model, np.concatenate([head, text[a : a + piece]])).sum(axis=0)
        elif at[last] > at[first]:
            k = last - first
            padded = np.repeat(np.uint8(LEAD[0]), at[last] - at[first] + ORDER * k).astype(np.uint8)
            starts = at[first:last] - at[first] + ORDER * np.arange(1, k + 1)
            room = np.ones(len(padded), bool)
            for j in range(ORDER):
                room[starts - 1 - j] = False
            padded[room] = raw[at[first] : at[last]]
            each = costs(model, padded)
            own = room[ORDER:]
            sums = np.vstack([np.zeros((1, each.shape[1]), np.int64), np.cumsum(np.where(own[:, None], each, 0), axis=0)])
            begin = starts - ORDER
            total[first:last] = sums[begin + sizes[first:last]] - sums[begin]
        first = last
    return total


def _predictor(shared: object) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value  # type: ignore[attr-defined]
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            at, raw = utf8(batch.column("__text"))
            has_letter = np.asarray(batch.column("__lettered").to_numpy(zero_copy_only=False), bool)
            if model.languages:
                bits = code_lengths(model, at, raw) / UNIT
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                per_byte = bits.min(axis=1) / np.maximum(np.diff(at), 1)
            else:
                best, share, per_byte = np.zeros(len(at) - 1, int), np.zeros(len(at) - 1), np.zeros(len(at) - 1)
                has_letter = np.zeros(len(at) - 1, bool)
            best = np.where(has_letter, best, len(model.languages))
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("__text", "__lettered")]
            names_kept = [n for n in batch.schema.names if n not in ("__text", "__lettered")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names[best].tolist(), pa.string()), pa.array(np.where(has_letter, share, 0.0)), pa.array(np.where(has_letter, per_byte, 0.0))],
                names=[*names_kept, "lang_pred", "score", "bits_per_byte"],
            )

    return run


def fit(labelled: DataFrame, texts_per_language: int = 400, usual_bytes: int = 1 << 14, cells: int = 1 << 27, most_languages: int = 256) -> Model:
    """From (doc_id, text, lang). The sample is bounded, and no language is left out: of each,
    whole texts are taken, up to texts_per_language and cells / languages**2 bytes (so
    that all trees together stay within cells numbers), one text at least; of one that is
    longer than that, as many characters. Texts of up to usual_bytes come first, by the
    hash of doc_id; longer ones follow, the shortest first. Where lang has more values than
    most_languages, the most frequent of them are learned (ties: the first by name), so
    what the driver gathers has a bound. Rows without text or lang teach nothing; rows that
    repeat teach once each; an empty table gives an empty model. Other columns are ignored."""
    size = F.octet_length("text")
    ok = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (size > 0))
    names = [r["lang"] for r in labelled.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages + 1).collect()]
    if len(names) > most_languages:
        ok = ok.filter(F.col("lang").isin(names[:most_languages]))
    key = F.xxhash64(F.lit("train"), "doc_id")
    slim = ok.select("doc_id", "lang", F.greatest(size, F.lit(usual_bytes)).alias("long"), size.alias("bytes"), key.alias("key"), F.xxhash64("text").alias("th"))
    order = ("long", "key", "th")
    # ranked within eighths first, so no task ranks a whole language
    for by in (["lang", "eighth"], ["lang"]):
        slim = slim.withColumn("eighth", F.pmod("key", F.lit(8))).withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= texts_per_language)
    before = F.sum("bytes").over(W.partitionBy("lang").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = slim.withColumn("so_far", before).select("doc_id", "lang", "th", "rank", "so_far")
    # at most texts_per_language rows of each language, without their texts
    told = [tuple(r) for r in ranked.collect()]
    most = cells // max(1, len({r[1] for r in told})) ** 2
    chosen = [(r[0], r[1], r[2]) for r in told if r[3] == 1 or r[4] <= most]
    kind = T.StructType([T.StructField("mid", ok.schema["doc_id"].dataType), T.StructField("mlang", T.StringType()), T.StructField("mth", T.LongType())])
    picked = labelled.sparkSession.createDataFrame(chosen, kind).distinct()
    rows = ok.join(F.broadcast(picked), F.col("mid").eqNullSafe(F.col("doc_id")) & (F.col("mlang") == F.col("lang")) & (F.col("mth") == F.xxhash64("text"))).select("lang", F.when(size > most, F.left("text", F.lit(max(most, 1)))).otherwise(F.col("text")).alias("text"))
    samples: dict[str, list[bytes]] = {}
    for r in rows.collect():
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return train({k: sorted(v) for k, v in samples.items()}) if samples else Model([], np.zeros(256, np.int64), [], [], [], np.zeros(0))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """doc_id, the carried columns, lang_pred, score, bits_per_byte.

    lang_pred is `und`, with score 0, for texts that are null or have no letter, and
    for all if the model is empty. score is the winner's posterior under equal
    priors. Whole texts count, however long, in pieces; rows that repeat get equal answers;
    of languages with equal lengths the first by name wins. An empty table gives an empty
    result. Columns that are not carried may have any name; a carried one may not be named
    as those that are added.
    """
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, text.alias("__text"), text.rlike(r"\p{L}").alias("__lettered"))
    fields = with_fields(rows, ("__text", "__lettered"), "lang_pred string, score double, bits_per_byte double")
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_predictor(shared), fields)
