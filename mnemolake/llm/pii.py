"""PII by candidate gradient boosting, in DataFrame and SQL functions only.

Base spans follow fixed patterns and validators. Beside them, looser generators
propose spans of any kind, which may overlap; each candidate becomes a mask of format
and context features of its kind. Boosted trees are fitted to a small labelled table
(pii_examples, or one given), whose labels owe nothing to the base rules: a candidate
is right where it lies on a marked span of its kind. A threshold per kind is calibrated
on the held-out third of that table to the asked precision. Candidates that pass are
added, unless a base span holds them; base spans stay.

A pattern's matches are located without a UDF: the pieces between them (split) and
the matches (regexp_extract_all) are folded into running places. All patterns run in
one pass: repeats are possessive or of one character class, never nested groups.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import stage
from mnemolake.llm.pii_examples import examples

#: Kinds with base rules, as the contract lists them.
KINDS = ("email", "ip", "card", "phone")
#: What the method looks for besides: keys, tokens, passwords.
ALL_KINDS = (*KINDS, "secret")
#: The contract's patterns in one-pass form. A match begins where a run
#: of its first class begins, or where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?!\.?[A-Za-z0-9-])",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|\((?i:at)\)|\[(?i:at)\])", r"(?:\.|\((?i:dot)\)|\[(?i:dot)\])"
_SPOT = r"(?:[.,]|\[\.\]|\(\.\))"
#: Cheap looks back come first: most places have no = or : before them.
_ASSIGNED = r"(?<=[=:\x20\x22\x27])(?<=[=:]\x20?[\x22\x27]?)(?<=(?i:password|passwd|pwd|secret|token|key)[\x22\x27]?\x20?[=:]\x20?[\x22\x27]?)"
_TOKEN = "A-Za-z0-9_/+-"
#: Looser: what a text must hold for a generator to run at all, and the generator.
LOOSE = {
    "email": (_AT, rf"(?:(?<![{_LOCAL}])[{_LOCAL}]++\x20?)?{_AT}\x20?[A-Za-z0-9-]++\x20?{_DOT}\x20?[A-Za-z0-9.-]++"),
    "ip": (rf"[0-9]{_SPOT}[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{{1,4}}:", rf"(?<![0-9.])[0-9]{{1,3}}{_SPOT}[0-9]{{1,3}}{_SPOT}[0-9]{{1,3}}{_SPOT}[0-9]{{1,3}}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Za-z:])"),
    "card": (r"[0-9](?:[\x20.-]?[0-9]){12}", r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])"),
    "phone": (r"[0-9]{2}", r"(?<![0-9A-Za-z])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}(?:[\x20./-]?[0-9]{3,4})?(?![0-9A-Za-z])"),
    # of any length: a token of three dotted parts, a run of a token's letters with a digit, a value that is assigned
    "secret": (
        rf"(?<![{_TOKEN}])(?=[{_TOKEN}]{{16}})[A-Za-z_/+-]*+[0-9]|(?<![{_TOKEN}])eyJ|[=:](?<=(?i:password|passwd|pwd|secret|token|key)[\x22\x27]?\x20?[=:])",
        rf"(?<![{_TOKEN}])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+|(?<![{_TOKEN}])(?=[{_TOKEN}]{{16}})(?=[A-Za-z_/+-]*+[0-9])[{_TOKEN}]++(?:={{1,2}}+(?![={_TOKEN}]))?|{_ASSIGNED}(?![\x22\x27=:\x20])[^\x20\x09-\x0D\x22\x27,;|)]{{6,}}+",
    ),
}
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Candidates of a text are folded in blocks, so that appending stays cheap.
BLOCK = 256
ROUNDS, RATE = 30, 0.5


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    """The digits of x, doubled at every second place from the right, sum to a ten."""
    d = f"reverse({_digits(x)})"
    digit = f"cast(substr({d}, i, 1) as int)"
    return f"(aggregate(sequence(1, length({_digits(x)})), 0, (t, i) -> t + if(i % 2 = 0, {digit} * 2 - if({digit} > 4, 9, 0), {digit})) % 10 = 0)"


def valid(kind: str, x: str) -> str:
    """SQL: the base validator of a match x."""
    if kind == "ip":
        return f"{x} rlike {_q(rf'^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$')}"
    if kind == "card":
        return f"(length({_digits(x)}) between 14 and 19 and {_luhn(x)})"
    if kind == "phone":
        return f"(length({_digits(x)}) between 10 and 15)"
    return f"({x} is not null)"


def located(pieces: str, hits: str, keep: str, fields: str, kinds: str) -> Column:
    """array<struct> of the matches x.hit (x.before, x.after: the texts around) that
    pass keep; fields (s, e: places) and kinds name the struct's contents and types."""
    empty = f"cast(array() as array<struct<{kinds}>>)"
    place = "(a.at + length(x.before))"
    item = f"named_struct({fields})".replace("{s}", place).replace("{e}", f"({place} + length(x.hit))")
    step = f"(a, x) -> named_struct('at', a.at + length(x.before) + coalesce(length(x.hit), 0), 'out', if(x.hit is not null and {keep}, concat(a.out, array({item})), a.out))"
    rows = f"zip_with(zip_with({pieces}, {hits}, (p, h) -> named_struct('before', p, 'hit', h)), slice({pieces}, 2, 2147483647), (x, n) -> named_struct('before', x.before, 'hit', x.hit, 'after', n))"
    inner = f"aggregate(block, named_struct('at', o.at, 'out', {empty}), {step})"
    blocks = f"transform(sequence(0, cast((size({pieces}) - 1) / {BLOCK} as int)), b -> slice({rows}, b * {BLOCK} + 1, {BLOCK}))"
    outer = f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<array<struct<{kinds}>>>)), (o, block) -> element_at(transform(array({inner}), y -> named_struct('at', y.at, 'out', concat(o.out, array(y.out)))), 1), o -> flatten(o.out))"
    return F.expr(f"case when size({hits}) > 0 then {outer} else {empty} end")


def _matches(text: str, pattern: str, needs: str) -> tuple[Column, Column]:
    """(pieces, hits); empty where the text cannot match."""
    some = F.col(text).rlike(needs)
    none = F.array().cast("array<string>")
    return F.when(some, F.split(F.col(text), pattern, -1)).otherwise(none), F.when(some, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none)


_LEAD = "right(x.before, 40)"
_COUNT = f"length({_digits('x.hit')})"


def _lead(words: str, gap: str = r"[^0-9A-Za-z]{0,8}") -> str:
    """SQL: the words end right before the candidate."""
    return f"{_LEAD} rlike {_q(f'(?i)(?:{words}){gap}$')}"


#: Features of a candidate (SQL over x.hit, x.before, x.after), a bit each, by kind.
FEATURES = {
    "email": (
        "x.hit rlike r'^[^ ]+$'",
        "x.hit like '%@%'",
        "x.hit rlike r'(?i)(?:\\(dot\\)|\\[dot\\])'",
        "x.hit rlike r'[A-Za-z]{2,}$'",
        "x.hit rlike r'\\. ?[A-Z]'",
        "x.hit rlike r'\\. [A-Za-z]+$'",
        r"x.hit rlike r'^[@(\[ ]'",
        r"x.hit rlike r'(?i)\.(?:png|jpe?g|gif|svg|webp|js|css|pdf)$'",
        "x.hit rlike r'@[0-9 ]+[.]'",
        _lead("mail|contact|write to|von|from"),
    ),
    "ip": (
        valid("ip", "x.hit"),
        "x.hit like '%,%'",
        "x.hit like '%:%'",
        "x.hit rlike r'[(\\[]'",
        f"regexp_replace(x.hit, '[^0-9,.]', '') rlike {_q(rf'^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$')}",
        _lead("ip|addr|address|host|server|from"),
        _lead("v|version|release|section|chapter|no|nr", r"[^0-9A-Za-z]{0,4}"),
        f"regexp_replace(x.hit, '[0-9]', '') = '...' and {_COUNT} >= 7",
        "x.before rlike r'[0-9A-Za-z.,+-]$' or x.after rlike r'^(?:[0-9A-Za-z]|[.,][0-9])'",
    ),
    "card": (
        f"{_luhn('x.hit')}",
        f"{_COUNT} = 13",
        f"{_COUNT} = 15",
        f"{_COUNT} = 16",
        f"{_COUNT} >= 17",
        "x.hit rlike r'^[0-9]+$'",
        r"x.hit rlike r'^[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$'",
        f"{_digits('x.hit')} rlike r'^(?:4|5[1-5]|2[2-7]|3[47]|6)'",
        f"{_digits('x.hit')} rlike r'^(?:19|20)[0-9]{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])'",
        f"{_digits('x.hit')} rlike r'^97[89]' and {_COUNT} = 13",
        "x.hit rlike r'0{8}$'",
        _lead("card|visa|credit|iban|account|konto"),
        _lead("id|order|order no|no|nr|ticket|sku|parcel|isbn|isbn-13|log"),
        "x.before rlike r'[0-9A-Za-z.,+-]$' or x.after rlike r'^[0-9A-Za-z]'",
    ),
    "phone": (
        "x.hit like '%(%'",
        "x.hit like '+%'",
        "x.hit like '00%'",
        f"{_COUNT} < 9",
        f"{_COUNT} between 9 and 11",
        "x.hit rlike r'^[0-9]+$'",
        "x.hit rlike r'^[0-9]{3}-[0-9]{3}-[0-9]{4}$'",
        "x.hit rlike r'^(?:1[0-9]|20)[0-9]{2}[ -]'",
        "x.hit rlike r'^0[1-9]'",
        r"x.hit rlike r'\.'",
        _lead("tel|phone|fon|call|fax|mobile|cell"),
        _lead("[$]|eur|usd|cost|about|some|no|nr|pages|pp|page|years|from|between|id|isbn|isbn-13|on|at"),
        "x.before rlike r'[0-9A-Za-z.,+:/-]$|[0-9] $' or x.after rlike r'^(?:[0-9A-Za-z/]|[ .:-][0-9])'",
    ),
    "secret": (
        "x.hit rlike r'^[0-9a-fA-F]{32,}$'",
        "x.hit rlike r'[a-z]' and x.hit rlike r'[A-Z]' and x.hit rlike r'[0-9]'",
        "x.hit rlike r'[0-9]'",
        "length(x.hit) >= 20",
        "x.hit rlike r'^(?:gh[pos]_|sk_|pk_|xox[bap]-|AKIA|AIza|eyJ)'",
        "x.hit rlike r'^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'",
        "x.hit like '%/%'",
        "x.hit rlike r'[-_][A-Za-z0-9]*[-_]'",
        _lead(r"(?:token|secret|passw(?:or)?d|passwd|pwd|key|auth|credential)[A-Za-z_]{0,8}[\x22\x27]?\x20?[=:]\x20?[\x22\x27]?|bearer\x20", ""),
        _lead("sha-?1|sha-?256|md5|commit|checksum|hash|digest|etag|uuid|guid|revision|isbn|order|on|log"),
        "x.before rlike r'[/.]$'",
    ),
}


def boost(table: list[tuple[int, int, int]], features: int, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple[int, int, tuple[float, float, float, float]]]]:
    """Logistic boosting of depth-2 trees on (mask, n, positives): a start, and trees
    (feature, feature, leaf values by the two bits)."""
    n, p = sum(r[1] for r in table), sum(r[2] for r in table)
    start = math.log((p + 0.5) / (n - p + 0.5))
    score = {m: start for m, _, _ in table}
    trees = []
    for _ in range(rounds):
        best = None
        slope = {m: (pos - k / (1 + math.exp(-score[m])), k * (q := 1 / (1 + math.exp(-score[m]))) * (1 - q)) for m, k, pos in table}
        for a in range(features):
            for b in range(a):
                g, h = [0.0] * 4, [0.0] * 4
                for m, (x, y) in slope.items():
                    leaf = (m >> a & 1) * 2 + (m >> b & 1)
                    g[leaf] += x
                    h[leaf] += y
                gain = sum(x * x / (y + 1) for x, y in zip(g, h, strict=True))
                if best is None or gain > best[0] + 1e-9:
                    best = gain, a, b, tuple(round(rate * x / (y + 1), 6) for x, y in zip(g, h, strict=True))
        if best is None or best[0] < 1e-6:
            break
        _, a, b, leaves = best
        trees.append((a, b, leaves))
        for m in score:
            score[m] += leaves[(m >> a & 1) * 2 + (m >> b & 1)]
    return start, trees


def raw_score(mask: int, start: float, trees: list) -> float:
    return start + sum(leaves[(mask >> a & 1) * 2 + (mask >> b & 1)] for a, b, leaves in trees)


def calibrate(table: list[tuple[int, int, int]], start: float, trees: list, precision: float) -> float:
    """The lowest score from which on candidates hold the asked precision."""
    by: dict[float, list[int]] = defaultdict(lambda: [0, 0])
    for m, n, p in table:
        s = round(raw_score(m, start, trees), 6)
        by[s][0] += n
        by[s][1] += p
    found, n, p = math.inf, 0, 0
    for s in sorted(by, reverse=True):
        n, p = n + by[s][0], p + by[s][1]
        if p >= precision * n:
            found = s
    return found


def candidates(rows: DataFrame) -> DataFrame:
    """rows (text and others) lose text and gain b_KIND, the base spans of each kind (s, k, e),
    and candidates (s, k, e, mask)."""
    wide = rows
    for k in ALL_KINDS:
        if k in BASE:
            pieces, hits = _matches("text", BASE[k], _NEEDS[k])
            wide = wide.withColumns({f"bp_{k}": pieces, f"bh_{k}": hits})
        pieces, hits = _matches("text", LOOSE[k][1], LOOSE[k][0])
        wide = wide.withColumns({f"cp_{k}": pieces, f"ch_{k}": hits})
    out = [F.col(c) for c in rows.columns if c != "text"]
    for no, k in enumerate(ALL_KINDS):
        if k in BASE:
            out.append(located(f"bp_{k}", f"bh_{k}", valid(k, "x.hit"), f"'s', {{s}}, 'k', {no}, 'e', {{e}}", "s: int, k: int, e: int").alias(f"b_{k}"))
        mask = " + ".join(f"if({f}, {1 << i}, 0)" for i, f in enumerate(FEATURES[k]))
        out.append(located(f"cp_{k}", f"ch_{k}", "true", f"'s', {{s}}, 'k', {no}, 'e', {{e}}, 'mask', {mask}", "s: int, k: int, e: int, mask: int").alias(f"c_{k}"))
    held = wide.select(*out)
    return held.withColumn("candidates", F.concat(*[F.col(f"c_{k}") for k in ALL_KINDS])).drop(*[f"c_{k}" for k in ALL_KINDS])


def fit(spark: SparkSession, labelled: list[tuple[str, str | None, int, int, int]], precision: float) -> dict[int, tuple[float, list, float]]:
    """Kind's number: (start, trees, least score) of labelled (text, kind, start, end, fold).
    Fold 0 calibrates, the others train. A kind without right candidates has no entry. The
    features are the corpus's own expressions; what comes back is one row per kind and mask."""
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([dict(zip(("text", "kind", "a", "z", "fold"), r, strict=True)) for r in labelled])), "array<struct<text string, kind string, a int, z int, fold int>>")).alias("r")).select("r.*")
    found = candidates(table).select("kind", "a", "z", "fold", F.explode("candidates").alias("c"))
    name = F.element_at(F.array(*map(F.lit, ALL_KINDS)), F.col("c.k") + 1)
    # right: of the marked kind, and on the marked span but for an edge
    right = name.eqNullSafe(F.col("kind")) & (2 * (F.least("c.e", "z") - F.greatest("c.s", "a")) > F.greatest(F.col("c.e") - F.col("c.s"), F.col("z") - F.col("a")))
    counts = found.groupBy("c.k", "c.mask", (F.col("fold") == 0).alias("held")).agg(F.count(F.lit(1)).alias("n"), F.sum(right.cast("int")).alias("p")).collect()
    models = {}
    for no, k in enumerate(ALL_KINDS):
        part = lambda held: sorted((r["mask"], r["n"], r["p"]) for r in counts if r["k"] == no and r["held"] == held)  # noqa: E731, B023
        if any(p for _, _, p in part(False)):
            start, trees = boost(part(False), len(FEATURES[k]))
            if (least := calibrate(part(True), start, trees, precision)) < math.inf:
                models[no] = start, trees, least
    return models


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98, labelled: list[tuple[str, str | None, int, int, int]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (kind:start:end by start, then kind; code points, end exclusive),
    n_added, n_spans.

    labelled (text, kind, start, end, fold) trains the model, pii_examples by default; it is
    small by contract, as it is fitted on the driver. Null texts count as empty, and have no
    spans. Texts are searched whole, however long. Rows are judged one by one, so repeats
    and rows that share a doc_id get equal answers; spans that start alike are ordered by
    kind, then end; a candidate inside a base span is not added. An empty table gives an
    empty result; other columns of docs, whatever their names, are ignored. Where nothing
    labelled is right for a kind, nothing is added for it.
    """
    models = fit(docs.sparkSession, examples() if labelled is None else labelled, precision)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = stage(candidates(rows), "spans")
    passes = "false"
    for no, (start, trees, least) in models.items():
        leaf = lambda a, b, v: f"case when c.mask & {1 << a} <> 0 and c.mask & {1 << b} <> 0 then {v[3]} when c.mask & {1 << a} <> 0 then {v[2]} when c.mask & {1 << b} <> 0 then {v[1]} else {v[0]} end"
        total = " + ".join([f"{start:.6f}D", *[f"cast({leaf(*t)} as double)" for t in trees]])
        passes = f"case when c.k = {no} then {total} >= {least - 2e-6:.6f}D else {passes} end"
    base = F.array_sort(F.concat(*[F.col(f"b_{k}") for k in KINDS]))
    added = F.expr(f"array_distinct(transform(filter(candidates, c -> {passes} and not exists(base, b -> b.s <= c.s and c.e <= b.e)), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e)))")
    name = "element_at(array('" + "', '".join(ALL_KINDS) + "'), x.k + 1)"
    joined = lambda c: F.expr(f"array_join(transform({c}, x -> concat({name}, ':', x.s, ':', x.e)), ',')")
    told = held.withColumn("base", base).withColumn("added", added).withColumn("every", F.array_sort(F.concat("base", "added")))
    sizes = [F.size("added").cast("long").alias("n_added"), F.size("every").cast("long").alias("n_spans")]
    return told.select("doc_id", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("every").alias("spans"), *sizes)
