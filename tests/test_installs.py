"""Install records and layers of settings."""

import json

from lodewatch.operators.installs import LOCAL, PROJECT, USER, active_installs, enabled_plugins, install_records


def test_documents_become_rows(spark):
    record = {"version": 2, "plugins": {"a@m": [{"scope": "user", "installPath": "/c/a/1"}, {"scope": "project", "installPath": "/c/a/2", "projectPath": "/w"}, "odd", {"installPath": 3}], "b@m": {"installPath": "/c/b"}}}
    files = spark.createDataFrame([(json.dumps(record),), ("{broken",), ("[1]",), (None,), ('{"plugins": 3}',)], "content string")
    assert sorted(map(tuple, install_records(files).collect())) == [("a@m", "project", "/c/a/2", "/w"), ("a@m", "user", "/c/a/1", None)]
    rows = [(USER, None, '{"enabledPlugins": {"a@m": false, "b@m": "no", "c.d@m": true}}'), (LOCAL, "/w", '{"enabledPlugins": []}'), (PROJECT, "/w", "{")]
    settings = spark.createDataFrame(rows, "layer int, project string, content string")
    assert sorted(map(tuple, enabled_plugins(settings).collect())) == [(USER, None, "a@m", False), (USER, None, "c.d@m", True)]


def test_the_last_layer_wins(spark):
    records = [("p", "user", "/c/p", None), ("q", "project", "/c/q", "/w"), ("q", "user", "/c/q2", None), ("r", "managed", "/c/r", None), ("s", None, "/c/s", None), ("t", "user", "/d/t", None), ("u", "user", "/c/../u", None), ("p", "user", "/c/p", None)]
    settings = [(USER, None, "p", False), (USER, None, "q", False), (PROJECT, "/w", "q", False), (LOCAL, "/w", "q", True), (PROJECT, "/here", "q", False), (USER, None, "r", False), (LOCAL, "/else", "p", True), (USER, None, "u", True)]
    found = active_installs(spark.createDataFrame(records, "plugin_id string, scope string, install_path string, project_path string"), spark.createDataFrame(settings, "layer int, project string, plugin_id string, enabled boolean"), "/c", "/here")
    assert sorted(r.install_path for r in found.collect()) == ["/c/q", "/c/r", "/c/s"]
