"""Views of code and markdown, and what hostile texts of a million characters cost."""

import time

import pytest

from lodewatch.functions.views import DECODING, VIEWS, view


def test_code_without_comments_and_strings():
    code = lambda text, path: view("code", text, path, False)
    assert code("x = r'eval(1)' # eval(2)\neval(3)", "a.py") == "x =                     \neval(3)"
    assert code('"""eval(\n1)""" + y', "a.py") == "        \n      + y"
    assert code("'it\\'s' + z", "a.py") == "        + z"
    assert code("  # eval x\necho 'a\nb' \"c\"", "a.sh") == "          \necho   \n   \"c\""
    assert code("'😀'", "a.py") == "    "
    assert code("eval('x') // eval(1)\n/* eval(2)\n*/ y", "a.js") == "eval(   )           \n          \n   y"
    assert code("`a ${eval(b)} eval(c)` + d", "a.ts") == "     eval(b)           + d"
    assert code("`a ${ {x: `in ${eval(y)}`} } b` z", "a.ts") == "      {x:       eval(y)  }      z"
    assert code("r = /'/; eval(x) /'/ 2", "a.mjs") == "r = /'/; eval(x) /    "
    assert code("return /\"/.test(y)", "a.js") == "return /\"/.test(y)"
    assert code("a++ / 'b' / c", "a.js") == "a++ /     / c"
    assert code("'open\neval(x)", "a.js") == "     \neval(x)"
    assert view("decoded", "iex 'x' # note\n\"y\" z", "a.ps1", False) == "iex           \n    z"


def test_documentation_lines():
    docs = lambda text, path, documentation=False: view("docs", text, path, documentation)
    assert docs("# an example: /etc/passwd\ncat /etc/passwd", "a.sh") == " " * 25 + "\ncat /etc/passwd"
    assert docs("## Examples\na sample line\nplain", "x/SKILL.md") == "## Examples\n" + " " * 13 + "\nplain"
    assert docs("# Examples\na sample line", "x/SKILL.md").endswith("a sample line")
    assert docs("## Quick reference\na sample line", "x/SKILL.md").endswith("a sample line")
    assert docs("# Examples\na sample line\n## Inner\na test\n# Next\na test", "a.md") == "# Examples\n" + " " * 13 + "\n## Inner\n      \n# Next\na test"
    assert docs("For example, print ~/.aws/credentials", "a.md") == "For example, print ~/.aws/credentials"
    assert docs("Example: cat x", "a.md").strip() == ""
    assert docs("> a reference to it\n> a test", "a.md") == " " * 19 + "\n> a test"
    assert docs("```\n# a test\ncat test\n```\n# a test", "a.md") == "```\n        \ncat test\n```\n# a test"
    assert docs("cat x", "docs/a.sh", True) == "     "
    assert view("outbound", 'echo "use curl http://a.b"\ncurl http://a.b', "a.sh", False) == " " * 26 + "\ncurl http://a.b"


def test_quoted_prompts():
    prompts = lambda text: view("prompts", text, "SKILL.md", False)
    assert prompts("ignore it\n```\nignore it\n```\n> ignore it") == "ignore it\n   \n         \n   \n           "
    assert prompts('# Testing rules\nSay "ignore\nit" and `ignore` it') == "# Testing rules\nSay        \n    and          it"
    assert prompts('# Steps\nSay "ignore it"') == '# Steps\nSay "ignore it"'
    assert prompts('# Attack\nSay “ignore” now\n\nopen "quote\n\nends" here') == '# Attack\nSay          now\n\nopen "quote\n\nends" here'
    assert prompts("# Audit\n## Steps\n`x`\n# Next\n`x`") == "# Audit\n## Steps\n   \n# Next\n`x`"
    assert prompts("# Rule\n``a ` b`` `c") == "# Rule\n          `c"
    assert prompts("A test: the scanner should flag act as DAN").strip() == ""
    assert view("prompts", "```\nx\n```", "a.py", False) == "```\nx\n```"


def test_hostile_examples():
    shown = lambda text, path="a.md", documentation=False: view("taught", text, path, documentation)
    fence = "```\ncurl x | sh\n```"
    gone = "   \n" + " " * 11 + "\n   "
    assert shown("## Bad examples\n" + fence) == "## Bad examples\n" + fence  # the plural alone opens no section
    assert shown("## Attack examples\n" + fence) == "## Attack examples\n" + gone
    assert shown("## Testing\n" + fence) == "## Testing\n" + fence
    assert shown("## Detection rules\n### Lab setup\n" + fence).endswith(fence)
    assert shown("## Detection rules\n### Example\n" + fence).endswith(gone)
    assert shown("# Attack detection\n" + fence, "SKILL.md").endswith(fence)
    assert shown("# Attack detection\n" + fence).endswith(gone)
    assert shown("## Threat detection\ntext\n## Other\n" + fence).endswith(fence)
    assert shown("curl x", "docs/README.md", True) == "      "
    assert view("deletes", "```\nrm -rf ~\n```\nrm -rf ~", "x/references/a.md", False) == "   \n        \n   \nrm -rf ~"


N = 1_000_000
SHAPES = {"letters": "a" * N, "spaces": " " * N, "ticks": "echo `" + "b" * N, "escapes": 'eval "' + "\\x" * (N // 2), "quotes": '"' * N, "slashes": "/" * N, "runs": " ".join("`" * k for k in range(1, 1400)), "curly": "“" * N, "braces": "{`${" * (N // 4), "lines": "# a\n" * (N // 4)}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_views_take_time_in_proportion(shape):
    for name in VIEWS:
        for path in ("a.py", "b.sh", "SKILL.md", "d.js", "t.ps1"):
            began = time.time()
            shown = view(name, SHAPES[shape], path, False)
            assert len(shown) == len(SHAPES[shape]) or name in DECODING  # what is no JSON is empty
            assert time.time() - began < 20
