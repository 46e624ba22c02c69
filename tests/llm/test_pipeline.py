"""The pipeline against a brute-force version of its five stages."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import pytest

import corpus_pipeline
from mnemolake.llm import common


def tokens(t: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def alike(a: str, b: str) -> bool:
    """Sets of lower-case five-word shingles with a Jaccard similarity of 0.8 or more."""
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (tokens(a.lower()), tokens(b.lower())))
    return 5 * len(x & y) >= 4 * len(x | y)


def make() -> list[tuple[int, str | None, str, str | None, int]]:
    rng = random.Random(12)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(2, 7)))
    out = []
    for i in range(120):
        out.append([i, " ".join(word("abcdeé" if i % 3 else "vwxyzü") for _ in range(rng.randint(60, 160))), "aa" if i % 3 else "zz", f"s{i % 4}"])
    for i, of in enumerate((3, 5, 5, 9)):
        out.append([200 + i, out[of][1].replace(" ", "\n") + " ", "aa" if of % 3 else "zz", "s1"])  # equal but for white space
    for i, of in enumerate((10, 10, 11)):
        w = out[of][1].split(" ")
        w[len(w) // 2] = "abe"
        out.append([300 + i, " ".join(w), "aa", None])
    out += [[400, None, "aa", "s0"], [401, "123 456", "zz", "s0"]]
    return [(a, t, b, c, len(t or "")) for a, t, b, c in out]


def brute(rows: list) -> list[tuple]:
    rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    links = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and alike(a[1], b[1])]
    root = {r[0]: r[0] for r in rows}
    for _ in range(5):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    rows = [r for r in rows if root[r[0]] == r[0]]
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(tokens(r[1]))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in size if x not in full) for s in size if s not in full}
        over = {s for s in share if share[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s in names:
        budget = int(2 * size[s] if s in full else share[s] + 1e-9)
        own = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"{r[0]}:mix:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest())
        while budget > 0:
            for r in own:
                w = tokens(r[1])
                if budget <= 0:
                    break
                out.append((r[0], r[1] if budget >= len(w) else " ".join(w[:budget])))
                budget -= min(budget, len(w))
    return out


def test_pipeline(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rows = make()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    ref = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    want = []
    for i, t in brute(rows):
        ids = ref.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame(make(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5


def test_repeats_nulls_and_shared_ids(spark, tmp_path):
    words = " ".join(f"ab{chr(97 + i % 26)}c{chr(97 + i % 7)}" for i in range(80))
    rows = [(1, words, "aa", "s0", 0), (1, words, "aa", "s0", 0), (1, "other " + words[::-1], "aa", "s0", 0), (None, "null id " + words[5:200], "aa", None, None), (None, None, None, None, None), (2, words + " ", "aa", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.exact_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"] or "")) for r in kept) == sorted([(False, 1, len(rows[2][1])), (True, 0, len(rows[3][1])), (True, 0, 0), (False, 2, len(words) + 1)])
    near = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sum(r["text"] == words for r in near) == 2 and not any(r["doc_id"] == 2 for r in near)
    mix = corpus_pipeline.mixed(spark, docs, "").collect()
    assert {r["doc_id"] for r in mix} == {1, 2, None}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_of_any_name(spark, tmp_path):
    """Columns named as the stages name theirs come through every stage, with their values."""
    names = ["score", "lang_pred", "size", "taken", "n", "id", "th", "__text", "__th", "TEXT", "extra_0", "a.b", "root", "mid"]
    rows = [(*r, *[f"{c}{r[0]}" for c in names]) for r in make()]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *names]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in columns)).write.parquet(str(tmp_path / "documents.parquet"))
        plain, docs = None, spark.read.parquet(str(tmp_path / "documents.parquet"))
        for k, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
            plain = step(spark, docs, str(tmp_path))
            assert plain.columns == columns
            plain.write.parquet(str(tmp_path / f"s{k}"))
            docs = spark.read.parquet(str(tmp_path / f"s{k}"))
            assert all(r[i] == f"{c}{r[0]}" for r in docs.collect() for i, c in enumerate(columns) if i > 4)
        assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_runs_leave_other_results_alone(spark, tmp_path):
    from mnemolake.llm import exact_dedup

    spark.createDataFrame(make(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first, second = exact_dedup.exact_dedup(docs), corpus_pipeline.run(spark, str(tmp_path))
    third = corpus_pipeline.run(spark, str(tmp_path))
    assert first.count() == docs.count() and sorted(second.collect()) == sorted(third.collect())


def _table(spark, folder):
    df = spark.createDataFrame(make(), "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "named_struct('a b', doc_id, 'c', array(named_struct('d-e', lang))) as `odd one`")
    df.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_called_apart_keep_theirs(spark, tmp_path):
    """A stage's result outlives the call of a later stage on the same table, not one on its own result."""
    docs = _table(spark, tmp_path)
    steps = dict(corpus_pipeline.STAGES)
    told = steps["language_id"](spark, docs, str(tmp_path))
    a = steps["exact_dedup"](spark, docs, str(tmp_path))
    b = steps["near_dedup"](spark, docs, str(tmp_path))
    assert told.count() and a.count() and b.count() and "odd one" in told.columns
    a.write.parquet(f"{tmp_path}/stored")
    gone = [scope for place, _, scope in corpus_pipeline._apart[str(tmp_path)] if place == 1]
    assert gone and any(x[2] in gone for x in common._staged)
    steps["near_dedup"](spark, spark.read.parquet(f"{tmp_path}/stored"), str(tmp_path)).count()
    assert not any(x[2] in gone for x in common._staged)


def test_two_runs_at_once(spark, tmp_path):
    """Each thread's run deletes only what it has set aside itself."""
    folders = [tmp_path / "a", tmp_path / "b"]
    for f in folders:
        _table(spark, f)
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(lambda f=f: sorted(map(tuple, corpus_pipeline.run(spark, str(f)).select("doc_id", "n_tokens").collect()))) for f in folders]
        first, second = (r.result() for r in runs)
    assert first == second and first
