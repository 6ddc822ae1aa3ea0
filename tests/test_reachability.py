"""Named paths, roles of files and demoted findings."""

import pytest

from lodewatch.operators.reachability import INERT, demoted, file_roles, manifests_of, references
from lodewatch.operators.scoring import score_targets

NAMED = [
    ("See [a](docs/a.md) and [b](./docs/b.md \"title\").", {("docs/a.md", False), ("docs/b.md", False)}),
    ("[x](https://e.example/a.md) [y](/abs.md) [z](../up.md) [w](#part) [v](mailto:a@b)", set()),
    ("Read `references/api.md`, then docs/guide.md.", {("references/api.md", False), ("docs/guide.md", False)}),
    ("All of docs/*.md and examples/{a,b}.md\n", {("docs/", True), ("examples/", True)}),
    ("Look in the docs or under References", {("docs/", True), ("References/", True)}),
    ("run scripts/tools/ or bin/tool now", {("scripts/tools/", True), ("bin/tool/", True)}),
    ("(notes.md) \"setup.sh\" .env.md a.md#part b.md?x=1", {("notes.md", False), ("setup.sh", False), (".env.md", False)}),
    ("[win](docs\\\\win.md) [q](<docs/q.md>) [dot](docs/.hidden)", {("docs/win.md", False), ("docs/q.md", False), ("docs/.hidden/", True)}),
    (None, set()),
]


@pytest.mark.parametrize("nr", range(len(NAMED)))
def test_references(spark, nr):
    text, wanted = NAMED[nr]
    rows = spark.createDataFrame([("t", "", text.replace("\\\\", "\\") if text else None)] * 2, "target_id string, below string, content string")
    assert {(r.ref, r.folder) for r in references(rows).collect()} == wanted


def test_references_from_above(spark):
    text = "[a](helper/docs/a.md) [b](other/b.md) [h](helper/) and [c](help.md) [d](helper/docs/)"
    rows = spark.createDataFrame([("t", "helper/", text), ("u", "helper/inner/", text)], "target_id string, below string, content string")
    got = {(r.target_id, r.ref, r.folder) for r in references(rows).collect()}
    assert got == {("t", "docs/a.md", False), ("t", "docs/", True), ("u", "", True)} | {("t", "", True)}


FILES = {
    "a/SKILL.md": "Start with [one](docs/one.md). See references/api/ too.",
    "a/docs/one.md": "x", "a/docs/two.md": "x", "a/docs/README.md": "x", "a/docs/tool.py": "x", "a/notes.md": "x",
    "a/references/api/deep/x.mdc": "x", "a/references/other.md": "x", "a/Tests/t.md": "x", "a/docs/linked.md": "x",
    "b/docs/free.md": "no manifest here",
    "c/SKILL.md": "Use all docs.", "c/docs/any.md": "x",
    "d/SKILL.md": "The helper has [its own](inner/docs/named.md).", "d/inner/SKILL.md": "nothing", "d/inner/docs/named.md": "x", "d/inner/docs/unnamed.md": "x",
}


def tables(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    roots = spark.createDataFrame([(r, r, True) for r in ("a", "b", "c", "d", "d/inner")], "target_id string, root string, own boolean")
    own = [("d/inner" if p.startswith("d/inner/") else p.split("/")[0], p) for p in FILES]
    listed = spark.createDataFrame([(t, p[len(t) + 1 :]) for t, p in own] * 2, "target_id string, path string")
    return listed, manifests_of(roots, files)


def test_roles(spark):
    listed, manifests = tables(spark)
    inert = {f"{r.target_id}/{r.path}" for r in file_roles(listed, manifests).filter(f"role = '{INERT}'").collect()}
    assert inert == {"a/docs/two.md", "a/references/other.md", "a/Tests/t.md", "a/docs/linked.md", "d/inner/docs/unnamed.md"}
    aliases = spark.createDataFrame([("a", "docs/linked.md", "live/linked.md"), ("a", "docs/two.md", "tests/two.md")], "target_id string, path string, alias string")
    again = {f"{r.target_id}/{r.path}" for r in file_roles(listed, manifests, aliases).filter(f"role = '{INERT}'").collect()}
    assert inert - again == {"a/docs/linked.md"}


def test_findings_of_inert_files_are_notes(spark):
    listed, manifests = tables(spark)
    rows = [("a", "docs/two.md", 1, "NET-WEBHOOK-KNOWN", "critical", "m", 7), ("a", "docs/one.md", 2, "PI-X", "high", "m", 8)]
    findings = spark.createDataFrame(rows, "target_id string, path string, line int, rule_id string, severity string, message string, more int")
    roles = file_roles(listed, manifests)
    got = {r.path: r for r in demoted(findings, roles).collect()}
    assert (got["docs/two.md"].severity, got["docs/two.md"].message, got["docs/two.md"].ignored_for_verdict, got["docs/two.md"].file_role, got["docs/two.md"].more) == ("info", "Inert supporting docs: m", True, INERT, 7)
    assert (got["docs/one.md"].severity, got["docs/one.md"].message, got["docs/one.md"].ignored_for_verdict, got["docs/one.md"].file_role) == ("high", "m", False, None)
    targets = spark.createDataFrame([("a", "")], "target_id string, tree_sha256 string")
    scored = score_targets(targets, demoted(findings, roles)).first()
    assert (scored.verdict, scored.mandatory_fail, scored.high) == ("PASS", [], 1) and score_targets(targets, findings).first().verdict == "FAIL"


def test_a_manifest_with_very_many_references(spark):
    text = "\n".join(f"[{i}](docs/n{i}.md)" for i in range(100_000))
    rows = spark.createDataFrame([("t", "", text)], "target_id string, below string, content string")
    files = spark.range(100_001).selectExpr("'t' AS target_id", "concat('docs/n', id, '.md') AS path")
    assert [r.path for r in file_roles(files, rows).filter(f"role = '{INERT}'").collect()] == ["docs/n100000.md"]
