"""Values of YAML texts with their places, what is refused, and the rules of whole files."""

import time

import pytest

from siftline.sources.rule_yaml import Refused, rules, values, yaml_values

TEXT = """\
# a head
---
rules:
- id: "a \\"b\\" \\u0041"   # a list at its key's indent
  languages: [python, 'it''s', "x, y",
    go]
  severity: ERROR # loud
  message: one
    two

    three#3
  patterns:
    - pattern-either:
        - pattern: os.system($CMD)
        - pattern: |
            if x:
              f(1)

        -   pattern-not: >-
              a
              b

              c
    -
      pattern-inside: |+
        def $F(...):

  metadata:
    cwe: 'CWE-78: x'
    url: https://a.b/c#d
    none:
    a/b~c: ~
- id: second
  languages:
  - java
  - kotlin
  pattern: "eval"
- severity: INFO
"""

WANT = [
    ("/rules/0/id", 'a "b" A'), ("/rules/0/languages/0", "python"), ("/rules/0/languages/1", "it's"), ("/rules/0/languages/2", "x, y"), ("/rules/0/languages/3", "go"),
    ("/rules/0/severity", "ERROR"), ("/rules/0/message", "one two\nthree#3"), ("/rules/0/patterns/0/pattern-either/0/pattern", "os.system($CMD)"),
    ("/rules/0/patterns/0/pattern-either/1/pattern", "if x:\n  f(1)\n"), ("/rules/0/patterns/0/pattern-either/2/pattern-not", "a b\nc"),
    ("/rules/0/patterns/1/pattern-inside", "def $F(...):\n\n"), ("/rules/0/metadata/cwe", "CWE-78: x"), ("/rules/0/metadata/url", "https://a.b/c#d"), ("/rules/0/metadata/none", None),
    ("/rules/0/metadata/a~1b~0c", None), ("/rules/1/id", "second"), ("/rules/1/languages/0", "java"), ("/rules/1/languages/1", "kotlin"), ("/rules/1/pattern", "eval"), ("/rules/2/severity", "INFO"),
]


def test_values_have_their_places():
    assert list(values(TEXT)) == WANT
    assert list(values(TEXT.replace("\n", "\r\n"))) == WANT


def test_small_texts():
    assert list(values("")) == list(values("# only\n\n")) == []
    assert list(values("- 1\n- - a\n  - b\n- c: d\n  e: []\n-")) == [("/0", "1"), ("/1/0", "a"), ("/1/1", "b"), ("/2/c", "d"), ("/3", None)]
    assert list(values("a:\n  b:\nc: -x")) == [("/a/b", None), ("/c", "-x")]
    assert list(values("a: |\n  x\n\n\nb: 'q\n  r'")) == [("/a", "x\n"), ("/b", "q r")]
    depth = 3000
    text = "\n".join(" " * k + f"k{k}:" for k in range(depth)) + " end"
    assert list(values(text)) == [("".join(f"/k{k}" for k in range(depth)), "end")]


@pytest.mark.parametrize("text", ["a: &x 1", "a: *x", "a: !t 1", "a: {b: 1}", "a:\n\tb: 1", "a: 1\n---\nb: 2", "a: 1\n b: 2", "a: 1\na: 2", "<<: x", 'a: "x', "a: [b, [c]]", "a: 1\n- b", "x"[:0] + 'a: "\\q"'])
def test_refused(text):
    with pytest.raises(Refused):
        list(values(text))


def test_long_texts_take_linear_time():
    many = 100_000
    begin = time.process_time()
    assert list(values("a" + " " * many + "b: x")) == [("/a" + " " * many + "b", "x")]
    assert list(values("k: [a" + " " * many + "b,\n" + " c,\n" * many + " d]"))[-1] == (f"/k/{many + 1}", "d")
    assert len(next(values('k: "' + "x\\\n " * many + ' y"'))[1]) > many
    assert len(next(values("k: '" + "x\n " * many + " y'"))[1]) == 2 * many + 1
    assert len(next(values("k: " + "x\n " * many))[1]) == 2 * many - 1
    assert len(next(values("k: >\n" + "  x\n" * many))[1]) == 2 * many
    assert len(list(values("- x: [1, 2]\n  y:\n  - z\n" * many))) == 3 * many
    assert time.process_time() - begin < 60


def test_rules_of_files(spark):
    single = "id: one\nlanguages: [go]\npattern: f(1)\n"
    listed = "- id: x\n  severity: INFO\n- rules:\n    - id: y\n      pattern-regex: abc\n- other: 1\n"
    files = spark.createDataFrame([("a", TEXT), ("b", single), ("c", listed), ("d", "a: *x"), ("e", None), ("f", "other: 1")], "path string, content string")
    found = yaml_values(files)
    assert [(r.path, r.pointer) for r in found.where("refused is not null").collect()] == [("d", None)]
    got = sorted(tuple(r) for r in rules(found).collect())
    assert got == sorted(
        [
            ("a", "/rules/0", 'a "b" A', "ERROR", "python,it's,x, y,go", 2, "valid"), ("a", "/rules/1", "second", None, "java,kotlin", 1, "literal_only"),
            ("a", "/rules/2", None, "INFO", "", 0, "invalid_structure"), ("b", "", "one", None, "go", 1, "valid"), ("c", "/0", "x", "INFO", "", 0, "literal_only"), ("c", "/1/rules/0", "y", None, "", 1, "literal_only"),
        ]
    )


def test_values_are_those_of_a_plain_loader():
    yaml = pytest.importorskip("yaml")
    import random

    draw = random.Random(3)
    words = ["f($X)", "a: b", "it's", 'say "x"', "# no", "x #y", "-", "- a", "two\nlines\n", "\n\nlate", "deep\n  er\nend", "tail  ", "  head", "[a]", "{b}", "&c", "long " * 30, "null", "~", "yes", "7", "\u00e9 x", "trail\n\n\n", "a\\b", ""]

    def tree(depth):
        kind = draw.random()
        if depth == 0 or kind < 0.4:
            return draw.choice(words)
        if kind < 0.7:
            return [tree(depth - 1) for _ in range(draw.randrange(1, 4))]
        return {draw.choice(["id", "a b", "x/y", "q'", "-k", "p:q", "k#1"]) + str(i): tree(depth - 1) for i in range(draw.randrange(1, 4))}

    def leaves(node, at=""):
        if isinstance(node, dict):
            return [row for k, v in node.items() for row in leaves(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")]
        if isinstance(node, list):
            return [row for i, v in enumerate(node) for row in leaves(v, f"{at}/{i}")]
        return [(at, node)]

    for k in range(600):
        node = {"top": tree(4)} if k % 2 else [tree(4)]
        text = yaml.safe_dump(node, default_flow_style=False, sort_keys=False, indent=2 + k % 3, width=20 + k % 90, allow_unicode=k % 5 > 0, default_style=[None, None, '"', "|", ">"][k % 5])
        if "? " in text or "!!" in text:
            continue
        assert list(values(text)) == leaves(node), text
