"""Linear forms of patterns: they find what the catalog's forms find, and no pattern takes more than time in proportion to the text."""

import random
import re
import time

import pytest
import regex

from lodewatch.functions.patterns import java_pattern, required
from lodewatch.operators.matching import first_per_line, match_all
from lodewatch.plans.catalog import RULES
from lodewatch.plans.linear import linear_forms

REWRITTEN = [(r.rule_id, i, p) for r in RULES for i, p in enumerate(r.patterns) if linear_forms(p) != (p,)]

#: Pieces that the rewritten patterns are made of, whole and cut short.
PIECES = {
    "GIT-HISTORY-SCAN": ["git log ", "git  log", "git\nlog ", "-p ", "--all ", "| grep ", "|", "grep x", "\n", "x" * 70 + " ", " "],
    "DEPS-INSTALL-SCRIPT-HOOKS": ['"postinstall": "', '"preinstall" :"', "npm i ", "npm install", "pip install", "curl ", "wget", '"', "subprocess.run(['pip'", "subprocess.call(", "install", ")", "\n", ", "],
    "OBFS-HOMOGLYPH": ["http://", "https://", "α", "ο", "a.b", "ignοre", "bypαss", " ", "/", "x", "<", '"', "\n"],
    "PI-WHITE-ON-WHITE": ["<div ", "<p ", "<span", "style=", "style = '", 'style="', "color: white", "color:#fff", "display:none", "background: white", ";", '"', "'", ">", "</div>", "</p>", "ignore all ", "rules ", "secret", "\n", "x", '<div class=a style="color: white; background:white">', "<p style='opacity: 0'>", 'style="color:white;background: #fff>"', 'style="display:none>"', "obey the system"],
    "PI-METADATA-MISMATCH": ["---", "name:", "description :", "\n", "never tell the user about this skill", "keep the instructions secret", "x ", "never share this skill\n"],
    "PI-PRIV-ESCALATE-INSTRUCTION": ["you must ", "escalate your privileges", "elevate its access", "gain root access", "try to ", "use x to ", "\n", " ", "\t", ".", "*", "-", ": ", "word ", "\r", " "],
    "SKILL-MEMORY-WRITE": ["write ", "Append ", "echo", "cat >> ", "tee -a ", "CLAUDE.md", "~/.cursor/", ".cursorrules", " AGENTS.md", "#", "\n", " x ", "never ", ".windsurfrules"],
}


def engine(pattern):
    java = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", java_pattern(pattern))
    return regex.compile(java.replace("(?<finding>", "(?P<finding>"))


def places(pattern, text):
    """The first place on each line, as the matcher takes it."""
    out = {}
    for m in engine(pattern).finditer(text):
        at = m.start()
        if "finding" in m.groupdict():
            at += m.group(0).index(m.group("finding"))
        line = text.count("\n", 0, at)
        out[line] = min(out.get(line, len(text)), at)
    return out


@pytest.mark.parametrize(("rule_id", "nr", "pattern"), REWRITTEN, ids=[f"{r}-{i}" for r, i, _ in REWRITTEN])
def test_same_places(rule_id, nr, pattern):
    deal = random.Random(f"{rule_id}{nr}")
    hits = 0
    for _ in range(4000):
        text = "".join(deal.choices(PIECES[rule_id], k=deal.randrange(1, 16)))
        if rule_id == "PI-METADATA-MISMATCH" and deal.random() < 0.8:
            text = "---" + text.replace("---", "name: ---", 1)
        wanted, found = places(pattern, text), {}
        for form in linear_forms(pattern):
            for line, at in places(form, text).items():
                found[line] = min(found.get(line, len(text)), at)
        if rule_id == "GIT-HISTORY-SCAN" and "git\nlog" in text:  # a match across a line's end doesn't hide one behind it
            assert wanted.items() <= found.items(), text
        else:
            assert found == wanted, text
        hits += bool(wanted)
    assert hits > 20


SHAPES = {
    "spaces": " ", "lines of spaces": " " * 40 + "\n", "letters": "a", "line ends": "\n", "tag": '<div style="color:white">', "open tag": '<div style="color:white" ',
    "front matter": "---\nname: x\n", "addresses": "https://a.b/c?d=", "run of addresses": "https://", "quotes": '"', "folders": "../", "comments": "<!-- x ", "calls": "f(",
    "assignments": "x = y\n", "piped logs": "git log --all -p | ", "list": "- ", "digits": "0123456789", "words": "word ", "verbs": "write ", "file and verbs": "CLAUDE.md write ",
    "installs": "npm install ", "pip": "subprocess.run(['pip' ", "escalation": "escalate your ",
}


@pytest.mark.parametrize("rule", RULES, ids=[r.rule_id for r in RULES])
def test_cost_is_linear(spark, rule):
    jvm = spark._jvm.java
    for pattern in rule.patterns:
        words = required(pattern)[:1]
        shapes = SHAPES | {f"{w!r} repeated": w + end for w in words for end in (" ", "\n")}
        for form in (forms := linear_forms(pattern)):
            compiled = jvm.util.regex.Pattern.compile(java_pattern(form))
            for name, unit in shapes.items():
                took = []
                rewritten = forms != (pattern,)
                for n in (2000, 20_000, 100_000) if rewritten else (2000, 20_000):  # a small text tells before a large one would hang
                    text = jvm.nio.CharBuffer.wrap((unit * (n // len(unit) + 1))[:n] + " ".join(words))
                    best = 9.0
                    began = time.perf_counter()
                    compiled.matcher(text).results().count()
                    took.append(time.perf_counter() - began)
                    assert took[-1] < {2000: 0.2, 20_000: 1, 100_000: 2}[n], (rule.rule_id, name, took)
                # a hundred times the time for ten times the text if that were its square
                assert took[1] < 0.3 or took[1] < 40 * took[0], (rule.rule_id, name, took)


def test_hostile_lines_in_two_seconds(spark):
    text = "escalate gain access write CLAUDE.md\n" + (" " * 40 + "\n") * 8000
    files = spark.createDataFrame([("t", "SKILL.md", text)], "target_id string, path string, content string")
    match_all(files).count()
    began = time.perf_counter()
    assert first_per_line(match_all(files)).filter("rule_id = 'SKILL-MEMORY-WRITE'").count() == 1
    assert time.perf_counter() - began < 8
