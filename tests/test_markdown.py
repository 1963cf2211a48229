"""Cases derived by hand from the note format's rules."""

import pytest

import markdown_rules as m
from marginalia.schema import BLOCK_END, BLOCK_START


def points(text, path="x/My Note.md"):
    return m.keypoints(text, m.title_of(path, text))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# A\n\n- one\n- two\n", ["A: one", "A: two"]),
        ("- [ ] buy milk", ["[ ] buy milk"]),
        ("Go. Stop!", ["Go.", "Stop!"]),
        ("wait...", ["wait.", "."]),
        ("# A\n## B\ntext", ["A / B: text"]),
        ("# A\n## B\nt\n# C\nu", ["A / B: t", "C: u"]),
        ("# A\n## B", ["A / B: A B"]),
        ("```\nhi there\n```", ["hi there"]),
        ("---", ["---"]),
        ("", ["My Note"]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["a | b", "1 | 2"]),
        ("> quoted words", ["quoted words"]),
        ("1. first\n2) second", ["first", "second"]),
        ("x\n```\ncode\n```\ny", ["x", "y"]),
        ("same\n\nsame", ["same"]),
    ],
)
def test_keypoints(text, want):
    assert points(text) == want


def test_limits():
    assert len(points("\n".join(f"- item {i}" for i in range(129)))) == 128
    long = points("# H\n- " + "a" * 500)[0]
    assert long == "H: " + "a" * 420


def test_blank_title_gives_nothing():
    assert m.keypoints("", "_") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("[[Target|Alias]]", "Alias"), ("![[T]]", "T"), ("[a](u)", "a"), ("snake_case", "snake case"), ("![a](u)", "!a"), ("`x` **b**", "x b"), ("[[T| ]]", "T")],
)
def test_inline(text, want):
    assert m.inline(text) == want


def test_front_matter_and_titles():
    assert m.title_of("a.md", "---\ntitle: X\n---\n# Y") == "X"
    assert m.front_matter("---\ntitle: X\n# Y") == ({}, "---\ntitle: X\n# Y")
    assert m.front_matter("---\nA: 1\na: 2\nb:\n---\nrest") == ({"a": "2"}, "rest")
    assert m.title_of("d/e.md", "```\n# In code\n```") == "In code"
    assert m.title_of("d/e.f.md", "no heading") == "e.f"


def test_block_of_related_notes():
    assert m.with_block("# hello", []) == "# hello\n"
    once = m.with_block("# hello", ["b.md", "b.md"])
    assert once == f"# hello\n\n{BLOCK_START}\n## Related Notes\n- [[b]]\n{BLOCK_END}\n"
    assert m.with_block(once, ["b.md"]) == once
    assert m.with_block("", ["d\\c.md"]) == f"{BLOCK_START}\n## Related Notes\n- [[d/c]]\n{BLOCK_END}\n"
    assert m.without_block(f"a\n\n{BLOCK_START}x") == f"a\n\n{BLOCK_START}x"
