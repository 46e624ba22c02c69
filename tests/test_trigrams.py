"""Search by the trigram index against the scan."""

from __future__ import annotations

import random
import re

import pytest

from mnemolake.sources import readers as D
from mnemolake.sources import trigrams as G

PATTERNS = [
    "hello", "HELLO", "(?i)HeLLo", "hel+o", "he(l|m)lo", "(abc|xyz)foo", "(abc|x)foo", "foo.*bar", "foo\\.bar", "^def ", "\\bimport\\b", "[ab]cdef", "[a-z]+", "x{3,}y", "(foo)?bar", "(?:foo|bar|baz)qux", "naïve", "(?i)NAÏVE", "数据库", "a.b", "ab",
    "colou?r", "(one)(two)three", "(?i:FOO)bar", "foo(?=bar)", "foo(?!bar)", "\\d{3}-\\d{4}", "end$", "(a|b)(c|d)(e|f)(g|h)(i|j)xyz", "[^a]bcd", "ab\\Q.c\\E", "[a-c&&[bc]]def", "\\p{L}oo", "f\\x6fo", "(fo)+o", "a++bcd", "w(?>or)ld", "tab\\tsep", "(((deep)))er", "|empty", "(foo|)bar",
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("texts")
    rng = random.Random(1)
    words = ["hello", "Hello", "HELLO", "helo", "hemlo", "abcfoo", "xyzfoo", "xfoo", "foo bar", "foo.bar", "def f", "import x", "acdef", "xxxy", "bar", "fooqux", "naïve", "NAÏVE", "数据库", "a.b", "ab", "color", "colour", "onetwothree", "FOObar", "foobar", "foobaz", "555-1234", "the end", "acegixyz", "bdfhjxyz", "zbcd", "ab.c", "bdef", "foo", "fofofoo", "aabcd", "world", "tab\tsep", "deeper", "plain", "nothing", ""]
    for i in range(120):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 4))]
        (root / f"f{i}.{rng.choice(('py', 'txt'))}").write_text("\n".join(lines), encoding="utf-8")
    (root / "binary.py").write_bytes(b"hello\0hello")
    (root / "large.py").write_text("hello\n" * 1000)
    (root / "empty.py").write_text("")
    (root / "latin.py").write_bytes(b"hello \xff\xfe abc")
    return root


def test_same_hits_and_fewer_files(spark, files, tmp_path):
    G.build(spark, str(files), str(tmp_path / "index"), most_bytes=4000)
    every = D.text_files(spark, str(files), most_bytes=4000).count()
    kept = {}
    for pattern in PATTERNS:
        want = sorted(map(str, D.grep(spark, str(files), pattern, most_bytes=4000).select("file", "line_no", "line").collect()))
        got = sorted(map(str, G.indexed_grep(spark, str(tmp_path / "index"), str(files), pattern, most_bytes=4000).select("file", "line_no", "line").collect()))
        assert got == want, pattern
        kept[pattern] = G.candidates(spark, str(tmp_path / "index"), pattern).count()
    assert all(kept[p] < every / 2 for p in ("hello", "foo\\.bar", "(abc|xyz)foo", "(one)(two)three", "数据库", "\\bimport\\b", "(?:foo|bar|baz)qux", "naïve"))
    assert all(kept[p] == every for p in ("a.b", "ab", "[a-z]+", "\\d{3}-\\d{4}", "[a-c&&[bc]]def", "\\p{L}oo", "|empty"))


def test_fixed_strings_context_and_many_files(spark, files, tmp_path, monkeypatch):
    G.build(spark, str(files), str(tmp_path / "index"), glob="*.py")
    for limit in (10_000, 3):
        monkeypatch.setattr(G, "FILES", limit)
        for pattern in ("foo.bar", "Hello", "ab", "absent words", "a.b"):
            want = sorted(map(str, D.grep(spark, str(files), pattern, "*.py", fixed=True, context=1).select("file", "line_no", "context").collect()))
            got = sorted(map(str, G.indexed_grep(spark, str(tmp_path / "index"), str(files), pattern, "*.py", fixed=True, context=1).select("file", "line_no", "context").collect()))
            assert got == want, pattern


def test_plans_hold_for_every_match():
    """Whatever Python's own matcher finds holds one of the plan's sets."""
    rng = random.Random(2)
    pieces = ["abc", "d", ".", "[xy]", "(e|fgh)", "(ij|klm)+", "n?", "o*", "(?i:PQR)", "st{2}u", "\\b", "^", "(?:vw|x(?:y|z)z)", "é"]
    for _ in range(400):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        asked = G.plan(pattern)
        for _ in range(30):
            text = "".join(rng.choice(["abc", "d", "x", "y", "e", "fgh", "ij", "klm", "n", "o", "pqr", "PQR", "sttu", "vw", "xyz", "xzz", "é", " "]) for _ in range(rng.randint(1, 7)))
            m = re.search(pattern, text)
            if m and asked is not None:
                assert any(s <= G.trigrams(text.encode().translate(G._LOWER)) for s in asked), (pattern, text)
