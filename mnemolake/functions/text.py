"""Text expressions: queries, scores, snippets, redaction, signatures."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.session import ship

#: What splits a query into terms, and the words that carry nothing.
TERM_SPLIT = r"[\s,.;:!?()\[\]{}\"'`|/\\]+"
STOP_WORDS = ("a", "an", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "you", "your")
#: Names of secret fields, and the ordered replacements.
SECRET_FIELD = r"(?:api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|token|password|passwd|pwd|secret|client[_-]?secret|private[_-]?key|credential)"
REDACTIONS = (
    (r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]"),
    (r"(?i)\bsk-[A-Za-z0-9._-]+\b", "[redacted]"),
    (rf'(?i)(\\")({SECRET_FIELD})(\\")\s*:\s*(\\")(.*?)(\\")', "$1$2$3:$4[redacted]$6"),
    (rf'(?i)(")({SECRET_FIELD})(")\s*:\s*(")([^"]*)(")', "$1$2$3:$4[redacted]$6"),
    (r"(?i)([?&](?:key|api_key|access_token|refresh_token|token|password|secret)=)[^&\s]+", "$1[redacted]"),
    (rf"""(?i)\b({SECRET_FIELD})\s*[:=]\s*(?:\\?["'])(.*?)(?:\\?["'])""", "$1=[redacted]"),
    (rf"""(?i)\b({SECRET_FIELD})\s*[:=]\s*([^\s,;}}"']+)""", "$1=[redacted]"),
)
PUNCTUATION = r"""["“”'’(){}\[\]<>«»《》【】（）\\^~!@#$%&*+/=:;,.，。、；：!?？]+"""
CJK = "一-鿿㐀-䶿豈-﫿"


def terms(query: str) -> list[str]:
    """In order, repeats kept."""
    found = [t.strip() for t in re.split(TERM_SPLIT, query)]
    return [t for t in found if t] or [query]


def needles(query: str) -> list[str]:
    """The whole query and its terms of two or more characters, once each."""
    whole = query.strip().lower()
    return list(dict.fromkeys([whole, *[t for t in terms(whole) if len(t) >= 2]])) if whole else []


def fts_terms(text: str) -> list[str]:
    out: list[str] = []
    for token in re.sub(PUNCTUATION, " ", text).split():
        runs = re.findall(f"[{CJK}]+", token)
        out += [r for r in runs if len(r) >= 3]
        out += [s for s in re.sub(f"[{CJK}]+", " ", token).split() if len(s) >= 3]
    return list(dict.fromkeys(out))[:5]


def pattern_terms(text: str) -> list[str]:
    clean, out = re.sub(PUNCTUATION, " ", text), {}
    for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_-]*", clean):
        if len(t) == 2:
            out[t.lower()] = None
    for run in re.findall(f"[{CJK}]+", clean):
        if 2 <= len(run) <= 6:
            out[run] = None
        if len(run) > 2:
            out.update(dict.fromkeys(map("".join, itertools.pairwise(run))))
    return list(out)[:16]


def hits(words: list[str], text: Column) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def fts_score(words: list[str], text: Column) -> Column:
    """Share of the terms found, if at least three are (all, of up to two)."""
    words = list(dict.fromkeys(w.lower() for w in words if len(w) >= 3))
    n = hits(words, text)
    return F.when(n >= (len(words) if len(words) <= 2 else 3), n / len(words)).otherwise(0.0) if words else F.lit(0.0)


def pattern_score(words: list[str], text: Column) -> Column:
    words = list(dict.fromkeys(w.lower() for w in words if w))
    return hits(words, text) / len(words) if words else F.lit(0.0)


def _any_holds(texts: Column, part: Column) -> Column:
    return F.exists(texts, lambda x: F.contains(F.lower(x), part))


def _any_held(texts: Column, whole: Column) -> Column:
    return F.exists(texts, lambda x: F.contains(whole, F.lower(x)))


def structural_score(fragments: list[str], text: Column, signatures: Column) -> Column:
    """0.9 for one fragment found in the text or, either way round, in a signature;
    the rest of 1.0 in proportion to the others."""
    low, n = F.lower(text), F.lit(0)
    for f in fragments:
        f = f.lower()
        if f:
            n = n + (F.contains(low, F.lit(f)) | _any_holds(signatures, F.lit(f)) | _any_held(signatures, F.lit(f))).cast("int")
    return F.when(n > 0, F.least(F.lit(1.0), 0.9 + 0.1 * ((n - 1) / max(1, len(fragments) - 1)))).otherwise(0.0)


def keyword_score(query: str, ident: Column, key: Column, value: Column, tags: Column, weight: Column) -> Column:
    """5 for the whole query; for each term of two or more characters 2 in the body, 2
    in the id, 1.5 in the key, 1 in a tag; times the layer's weight."""
    whole = query.strip().lower()
    if not whole:
        return weight
    low_id, low_key = F.lower(ident), F.lower(F.coalesce(key, F.lit("")))
    body = F.lower(F.concat_ws("\n", ident, F.coalesce(key, F.lit("")), value, F.array_join(tags, " ")))
    score = F.when(F.contains(body, F.lit(whole)), 5.0).otherwise(0.0)
    for t in terms(whole):
        if len(t) >= 2:
            n = F.lit(t)
            score = score + F.contains(body, n).cast("double") * 2 + F.contains(low_id, n).cast("double") * 2 + F.contains(low_key, n).cast("double") * 1.5 + _any_holds(tags, n).cast("double")
    return F.round(score * weight, 3)


def contains_any(words: list[str], columns: list[Column]) -> Column:
    found = F.lit(False)
    for w in words:
        for c in columns:
            found = found | F.contains(F.lower(c), F.lit(w))
    return found


def clip(text: Column, most: int) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, 1, most - 3), F.lit("...")))


def first_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.coalesce(F.get(lines, 0), F.lit(""))


def snippet(text: Column, query: str) -> Column:
    clean, n = F.trim(F.regexp_replace(text, r"\s+", " ")), query.strip().lower()
    at = F.instr(F.lower(clean), n) - 1 if n else F.lit(-1)
    start, end = F.greatest(at - 80, F.lit(0)), F.least(F.length(clean), at + len(n) + 160)
    around = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(clean, start + 1, end - start), F.when(end < F.length(clean), "...").otherwise(""))
    return F.when(F.length(clean) <= 240, clean).when(at < 0, F.concat(F.substring(clean, 1, 237), F.lit("..."))).otherwise(around)


def redacted(text: Column) -> Column:
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def agent_key(agent: Column) -> Column:
    """The stored side: each character of '-' and ' ' becomes '_'."""
    return F.lower(F.translate(F.trim(agent), "- ", "__"))


def agent_key_of(value: str) -> str:
    """The asked side: runs collapse, so 'a--b' can never be found; kept as it is."""
    return re.sub(r"[\s-]+", "_", value.strip().lower())


def like_escaped(value: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", value)


def keyword_tokens(text: Column, most: int = 5) -> Column:
    """Distinct words but stop words, in order, lower-cased for comparison."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}_-]*"), F.lit(0))
    kept = F.filter(found, lambda t: ~F.lower(t).isin(*STOP_WORDS) & ((F.length(t) >= 2) | t.rlike("[0-9]")))
    return F.slice(F.array_distinct(F.transform(kept, F.lower)), 1, most)


def error_code(text: Column) -> Column:
    named = F.regexp_extract(text, r"\b([A-Z][A-Z0-9_]{2,}_[A-Z0-9_]+)\b", 1)
    left = F.regexp_extract(text, r"(?i)exit\s*(?:code)?\s*[:=]?\s*([1-9]\d*)", 1)
    return F.when(named != "", F.substring(named, 1, 48)).when(left != "", F.concat(F.lit("EXIT_"), left)).otherwise("_")


def signature(tags: Column, tool: Column, code: Column) -> Column:
    clean = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    name = F.substring(F.lower(F.trim(F.coalesce(tool, F.lit("")))), 1, 64)
    blank = lambda c: F.when(c.isNull() | (c == ""), "_").otherwise(c)
    return F.concat_ws("|", blank(F.get(clean, 0)), blank(F.get(clean, 1)), blank(name), blank(code))


def signature_parts(sig: Column) -> Column:
    parts = F.split(sig, r"\|")
    part = lambda i: F.when(F.coalesce(F.get(parts, i), F.lit("")) == "", "_").otherwise(F.get(parts, i))
    return F.struct(*[part(i).alias(n) for i, n in enumerate(("primary_tag", "secondary_tag", "tool", "err_code"))])


def shared_parts(a: Column, b: Column) -> Column:
    return sum((((a[n] != "_") & (a[n] == b[n])).cast("int") for n in ("primary_tag", "secondary_tag", "tool")), F.lit(0))


def djb2_base36(text: Column) -> Column:
    """hash * 33 + code over the characters (of the basic plane), in 32 bits."""
    step = lambda h, c: (h * 33 + F.ascii(c)) % (1 << 32)
    value = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(5381).cast("long"), lambda h, c: step(h, c).cast("long"))
    return F.lower(F.conv(value.cast("string"), 10, 36))


def candidate_id(sig: Column, trace: Column) -> Column:
    return F.concat(F.lit("cand_"), djb2_base36(sig), F.lit("_"), F.substring(F.regexp_replace(trace, "[^a-zA-Z0-9_-]+", ""), 1, 24))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return F.ceil(units / 4)


def mixed_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{IsHan}")) + F.regexp_count(text, F.lit("[A-Za-z0-9]+"))


#: Shapes of error fragments.
ERROR_SHAPES = (
    r"\b([A-Z][A-Za-z0-9]*(?:Error|Exception)):\s*([^\n]{4,160})",
    r"\b(?:error|Error|fatal|FATAL|ERROR)\s*:\s*([^\n]{4,160})",
    r"\b([A-Za-z0-9_\-./]+):\s*[^\n]{0,40}\b(not found|no such (?:file|directory)|permission denied|undefined reference|command not found)\b[^\n]*",
    r"\b([A-Za-z0-9_\-./]{3,80})\s+[^\n]{0,40}\b(not found|no such (?:file|directory)|permission denied|undefined reference|command not found)\b[^\n]*",
    r"\b([A-Za-z0-9_]{3,40})\s+(is required|must be|cannot|could not|failed to)\s+[^\n]{3,120}",
    r"\bexit (?:code|status)\s*[:=]?\s*(\d{1,4})\b[^\n]{0,80}",
    r"\b(4\d\d|5\d\d)\s+([A-Za-z][A-Za-z ]{2,30})\b",
    r"\b([A-Z][A-Z0-9_]{2,}_[A-Z0-9_]+)\b",
)
_SPECIFIC = ((r"\b[A-Z][a-zA-Z]*Error\b", 3), (r"\b[A-Z][a-zA-Z]*Exception\b", 3), (r"(\b|_)E[A-Z]{3,}\b", 2), (r"/[a-zA-Z0-9._\-/]+", 2), (r"\bcode\s*=\s*\d+", 1), (r"\b\d{3}\b", 1), (r"_", 1))


#: Words that alone make no fragment.
ERROR_STOP_WORDS = {"the", "for", "this", "that", "your", "from", "with", "have", "has", "not", "a", "an", "of", "to", "is", "in", "on", "by"}
MOST_FRAGMENTS = 32


def error_signatures_of(text: str, most: int = 4) -> list[str]:
    """The most specific error fragments; earlier ones win ties."""
    found: list[str] = []
    for shape in ERROR_SHAPES:
        for m in re.finditer(shape, text, re.ASCII):
            found.append(m.group())
            if len(found) >= MOST_FRAGMENTS:
                break
    seen: dict[str, list] = {}
    for f in found:
        f = re.sub("[\u200b\u00a0]", "", re.sub(r"\s+", " ", f)).strip()
        short = f[:160]
        words = [w for w in re.split("[^a-z0-9_]+", short.lower()) if w]
        if len(f) >= 6 and len(re.sub("[^A-Za-z]", "", short)) >= 4 and not (words and all(w in ERROR_STOP_WORDS for w in words)):
            seen.setdefault(" ".join(short.lower().split()), [short, 0])[1] += 1
    scored = [(f, sum(w for p, w in _SPECIFIC if re.search(p, f, re.ASCII)) + min(2, n - 1) - (len(f) > 120)) for f, n in seen.values()]
    return [f for f, _ in sorted(scored, key=lambda x: -x[1])[:most]]


def _error_signatures(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: error_signatures_of(t or ""))


def error_signatures(text: Column) -> Column:
    ship()
    return F.pandas_udf(_error_signatures, "array<string>")(text)
