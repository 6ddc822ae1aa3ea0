"""Places of agents met with listings."""

import re

import pytest

from lodewatch.operators.discovery import discovered, glob_regex, installed_agents, roots, split_glob
from lodewatch.plans.places import PLACES

HOME, CWD = "/home/u", "/home/u/w/p/app"


def tables(spark, paths, machine="m", cwd=CWD):
    return spark.createDataFrame([(machine, p, 1) for p in paths], "machine string, path string, folder int"), spark.createDataFrame([(machine, HOME, cwd)], "machine string, home string, cwd string")


def found(spark, *paths, **more):
    cwd = more.pop("cwd", CWD)
    return sorted((r.agent_id, r.scope, r.path, r.scan_name) for r in discovered(*tables(spark, paths, cwd=cwd), **more).collect())


@pytest.mark.parametrize(("glob", "yes", "no"), [("*/SKILL.md", ["a/SKILL.md"], ["SKILL.md", "a/b/SKILL.md", "a/SKILL-md"]), ("**/SKILL.md", ["SKILL.md", "a/b/SKILL.md"], ["aSKILL.md"]), ("*.[jt]s", ["x.js", "y.ts"], ["x.jss", "a/x.js"]), ("AGENTS.md", ["AGENTS.md"], ["AGENTSxmd"])])
def test_globs(glob, yes, no):
    pattern = glob_regex(glob).replace(r"\z", r"\Z")
    assert all(re.match(pattern, x) for x in yes) and not any(re.match(pattern, x) for x in no)


def test_places_are_few_and_once():
    assert len(PLACES) == len({p[:3] for p in PLACES}) < 200
    assert split_glob(".claude/skills/*/SKILL.md")[0] == "/.claude/skills" and split_glob("AGENTS.md")[0] == "" and split_glob("**/.windsurf/rules/*.md")[0] == ""


def test_roots_end_at_the_repository(spark):
    listing, machines = tables(spark, ["/home/u/w/p/.git/HEAD", "/home/u/w/.git", "/x/.git/a"])
    kinds = {}
    for r in roots(listing, machines).collect():
        kinds.setdefault(r.root, set()).add(r.folder)
    assert kinds["parents"] == kinds["inner parents"] == {CWD, "/home/u/w/p"} and kinds["project"] == {CWD} and kinds["home"] == {HOME}
    assert kinds["above"] == {"", "/home", HOME, "/home/u/w", "/home/u/w/p", CWD}
    listing, machines = tables(spark, ["/other"])
    kinds = {}
    for r in roots(listing, machines).collect():
        kinds.setdefault(r.root, set()).add(r.folder)
    assert kinds["parents"] == kinds["above"] and kinds["inner parents"] == {"/home/u/w", "/home/u/w/p", CWD}


def test_only_installed_agents_load(spark):
    assert found(spark, CWD + "/.cursor/rules/a.mdc") == []
    assert found(spark, CWD + "/.cursor/rules/a.mdc", HOME + "/.cursor/x") == [("cursor", "project", CWD + "/.cursor/rules/a.mdc", "a.mdc")]
    listing, machines = tables(spark, [HOME + "/Documents/Cline/x/y"])
    assert {r.agent_id for r in installed_agents(listing, machines).collect()} == {"cline", "cross-agent"}


def test_shared_skills_are_given_once_for_each_reader(spark):
    rows = found(spark, HOME + "/.agents/skills/a/b/SKILL.md", HOME + "/.codex/x", HOME + "/.gemini/x", HOME + "/.claude/x", HOME + "/.openclaw/x")
    assert [(a, p) for a, _, p, _ in rows] == [(a, HOME + "/.agents/skills/a/b") for a in ("codex", "gemini", "openclaw")]


def test_sweep_of_instructions(spark):
    rows = found(spark, CWD + "/AGENTS.md", "/home/u/w/p/CLAUDE.md", "/home/u/w/GEMINI.md", "/home/u/w/p/.git/HEAD", CWD + "/sub/AGENTS.md")
    assert [(a, p) for a, _, p, _ in rows] == [("cross-agent", CWD + "/AGENTS.md"), ("cross-agent", "/home/u/w/p/CLAUDE.md")][::-1]


def test_caches_marketplaces_and_active_plugins(spark):
    cache, market = HOME + "/.claude/plugins/cache/m/p/1", HOME + "/.claude/plugins/marketplaces/m/x"
    paths = [cache + "/skills/s/SKILL.md", cache + "/hooks/hooks.json", market + "/SKILL.md", HOME + "/.claude/plugins/.trash/t/SKILL.md"]
    assert found(spark, *paths) == []
    assert [p for _, _, p, _ in found(spark, *paths, marketplaces=True)] == [market]
    plugins = spark.createDataFrame([("m", cache)], "machine string, folder string")
    assert [p for _, _, p, _ in found(spark, *paths, plugins=plugins)] == [cache + "/hooks/hooks.json", cache + "/skills/s"]


def test_scan_names_one_agent_and_nothing(spark):
    paths = [HOME + "/.copilot/hooks/x.json", HOME + "/.codex/hooks.json", HOME + "/.copilot/hooks/x.json"]
    assert found(spark, *paths, agent="copilot") == [("copilot", "user", paths[0], "hooks.json")]
    assert found(spark, *paths, agent="amp") == found(spark) == []
