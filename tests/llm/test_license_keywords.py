"""The keyword of a license rule is in every text that the rule matches."""

from itertools import islice, product
from re import _parser

import pytest

from turnstile.llm import licenses

SCANNER = licenses.Scanner()


def forms(parsed):
    """Texts that a parsed regex matches: every branch, optional parts with and without, one letter per class."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([{"RANGE": lambda a: chr(a[0]), "LITERAL": chr}.get(str(o), lambda a: "1")(a) for o, a in arg])
        elif name == "BRANCH":
            parts.append([f for branch in arg[1] for f in forms(branch)])
        elif name == "SUBPATTERN":
            parts.append(forms(arg[-1]))
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            parts.append([f * n for n in range(low, min(low + 1, high) + 1) for f in forms(inner)])
        else:
            assert name in ("ASSERT_NOT", "AT"), name
    return list(dict.fromkeys("".join(p) for p in islice(product(*parts), 100_000)))


def test_every_form_has_its_keyword():
    for rule in SCANNER.rules:
        for text in forms(_parser.parse(rule.pattern.pattern.decode())):
            assert rule.pattern.fullmatch(text.encode()), (rule.pattern, text)
            assert rule.keyword.decode() in text, (rule.label, rule.keyword, text)


@pytest.mark.parametrize("version", ["2", "2.1"])
def test_library_license_without_lesser(version):
    found = SCANNER.scan(f"under the GNU Library General Public License version {version} here")
    assert found["labels"].split(",") == ["gpl", f"lgpl-{version}"]  # gpl is the base place


@pytest.mark.parametrize("text", ["It may not be redistributed.", "redistribution is forbidden", "No redistribution!"])
def test_no_redistribution(text):
    assert SCANNER.scan(text)["labels"] == "no-redistribution"
