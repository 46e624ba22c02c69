"""Content search by a trigram index: most files are told apart without being read.

The index lists, for every run of three bytes, the files that hold it (ASCII letters in
lower case). What a pattern's matches must hold is read off its parsed form: literals that
stand together, all parts of a sequence, one of the branches. Files whose trigrams allow a
match are then searched as the plain scan does it, so the hits are the same.
"""

from __future__ import annotations

import itertools
import re
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from re import _constants as C
from re import _parser as P

from mnemolake.session import ship
from mnemolake.sources.readers import found_lines, text_files

#: Strings that a run of literals may stand for, alternatives of a plan, and files that a search lists by name, at most.
STRINGS, ALTERNATIVES, FILES = 8, 16, 10_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Escapes and sets that Spark's patterns read otherwise than Python's parser.
_OTHER = re.compile(r"\\(?:[vVhHRXGecNpPQEkz0]|x\{)|&&|\(\?[a-z]*[dUuLa]")

Clause = list[frozenset[int]]


def trigrams(data: bytes) -> frozenset[int]:
    return frozenset(a << 16 | b << 8 | c for a, b, c in zip(data, data[1:], data[2:], strict=False))


def _clauses(parsed: Iterable, flags: int) -> list[Clause]:
    """What must hold for a match: of every clause one alternative, all of its trigrams."""
    out: list[Clause] = []
    run: list[bytes] = [b""]

    def flush() -> None:
        nonlocal run
        sets = [trigrams(s) for s in run]
        if all(sets):
            out.append(sets)
        run = [b""]

    def extend(choices: list[bytes]) -> None:
        nonlocal run
        if len(run) * len(choices) > STRINGS:
            flush()
        run = [a + b for a in run for b in choices]

    def letter(code: int) -> bytes | None:
        if code >= 128 and flags & re.IGNORECASE or 0xD800 <= code < 0xE000:
            return None
        return chr(code).encode().translate(_LOWER)

    def walk(parsed: Iterable, flags_now: int) -> None:
        nonlocal flags
        for op, arg in parsed:
            if op is C.LITERAL and (one := letter(arg)) is not None:
                extend([one])
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= STRINGS and None not in (some := [letter(c) for _, c in arg]):
                extend(sorted(set(some)))
            elif op is C.AT:
                pass  # takes no letters
            elif op is C.SUBPATTERN:
                _, add, drop, inner = arg
                before, flags = flags, (flags | add) & ~drop
                walk(inner, flags)
                flags = before
            elif op is C.BRANCH:
                flush()
                each = [_clauses(b, flags) for b in arg[1]]
                if all(each):  # of a branch the clause with the most trigrams speaks for it
                    out.append([s for clauses in each for s in max(clauses, key=lambda c: min(map(len, c)))])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
                flush()
                out.extend(_clauses(arg[2], flags))
            elif op is C.ATOMIC_GROUP:
                walk(arg, flags)
            else:
                flush()

    walk(parsed, flags)
    flush()
    return out


def plan(pattern: str, fixed: bool = False) -> list[frozenset[int]] | None:
    """Sets of trigrams: a text that matches holds all of one of them. None: any text may match."""
    if fixed:
        return [trigrams(pattern.encode().translate(_LOWER))] if len(pattern.encode()) >= 3 else None
    if _OTHER.search(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = P.parse(pattern)
    except (re.error, FutureWarning, DeprecationWarning, OverflowError):
        return None
    clauses = sorted(_clauses(parsed, parsed.state.flags), key=lambda c: (len(c), -min(map(len, c))))
    kept: list[frozenset[int]] = [frozenset()]
    for c in clauses:  # clauses that would make too many alternatives ask for nothing
        if len(kept) * len(c) <= ALTERNATIVES:
            kept = [a | b for a, b in itertools.product(kept, c)]
    return sorted(set(kept), key=sorted) if all(kept) else None


def _posted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8).astype(np.int32)
            found = np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), ident, np.int64)), pa.array(found, pa.int32())], names=["id", "trigram"])


def build(spark: SparkSession, path: str, root: str, glob: str = "*", most_bytes: int = 2 << 20) -> None:
    """Writes the index of the text files at path to root: postings sorted by trigram, and the
    files with their times. Postings bear a hash of the file's name; files of equal hashes
    are candidates where one of them is."""
    ship(spark)
    files = text_files(spark, path, glob, most_bytes).withColumn("id", F.xxhash64("file"))
    # a scan deals some 32 small files to a task; a shuffle's blocks are as many as tasks times ranges
    tasks = max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // 32)
    postings = files.select("id", "text").coalesce(tasks).mapInArrow(_posted, "id long, trigram int")
    postings.repartitionByRange("trigram", "id").sortWithinPartitions("trigram", "id").write.mode("overwrite").parquet(f"{root}/postings")
    files.select("file", "at", "id").write.mode("overwrite").parquet(f"{root}/files")


def candidates(spark: SparkSession, root: str, pattern: str, fixed: bool = False) -> DataFrame:
    """(file, at): indexed files whose trigrams allow a match."""
    known = spark.read.parquet(f"{root}/files")
    files = known.select("file", "at")
    asked = plan(pattern, fixed)
    if asked is None:
        return files
    every = sorted(set().union(*asked))
    rows = [(i, t, len(s)) for i, s in enumerate(asked) for t in sorted(s)]
    own = F.broadcast(spark.createDataFrame(rows, "alternative int, trigram int, n int"))  # the plan: a row a trigram of it
    held = spark.read.parquet(f"{root}/postings").filter(F.col("trigram").isin(every)).join(own, "trigram")
    able = held.groupBy("id", "alternative", "n").agg(F.count_distinct("trigram").alias("found")).filter("found = n").select("id").distinct()
    return known.join(able, "id", "left_semi").select("file", "at")


def indexed_grep(spark: SparkSession, root: str, path: str, pattern: str, glob: str = "*", most_bytes: int = 2 << 20, fixed: bool = False, context: int = 0) -> DataFrame:
    """What ``grep`` finds in the files that were indexed, reading those alone that the index
    leaves; with more than FILES of them, all files are scanned and the others left out."""
    left = candidates(spark, root, pattern, fixed).select("file")
    names = [r["file"] for r in left.limit(FILES + 1).collect()]  # FILES names at most
    if len(names) <= FILES:
        if not names:
            return found_lines(text_files(spark, path, glob, most_bytes).limit(0), pattern, fixed, context)
        texts = text_files(spark, names, "*", most_bytes)
    else:
        texts = text_files(spark, path, glob, most_bytes).join(left, "file", "left_semi")
    return found_lines(texts, pattern, fixed, context)
