"""Files that manifests tell to run."""

import time

import pytest

from lodewatch.operators.run_targets import run_targets

FILES = ["docs/setup.sh", "examples/loader.js", "references/install.py", "tools/deep/go.sh", "docs/my file.sh", "docs/a.sh", "solo.sh"]
CASES = [
    ("Run docs/setup.sh first.", {"docs/setup.sh"}),
    ("Running the tests needs nothing. See docs/setup.sh for more.", set()),
    ("See examples/loader.js", set()),
    ("bash -e docs/setup.sh && python3 references/install.py", {"docs/setup.sh", "references/install.py"}),
    ("```\n./docs/setup.sh --init\nDEBUG=1 \"docs/a.sh\"\ncat examples/loader.js\n```\ndocs/a.sh x", {"docs/setup.sh", "docs/a.sh"}),
    ("```sh\ncd x && ./docs/setup.sh\n```\n", {"docs/setup.sh"}),
    ("docs/setup.sh\n", set()),
    ("Execute `${ROOT}/tools/deep/go.sh`, then stop", {"tools/deep/go.sh"}),
    ("launch deep/go.sh now", {"tools/deep/go.sh"}),
    ("run go.sh or xdocs/setup.sh or docs/setup.shx", set()),
    ("run 'docs/my file.sh'", {"docs/my file.sh"}),
    ("Never run solo.sh!", set()),
    ("never run solo.sh today", {"solo.sh"}),
    ("source docs/a.sh. Then read docs/setup.sh.", {"docs/a.sh"}),
    ("run " + "x" * 210 + " docs/a.sh", set()),
    (None, set()),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(f"t{i}", p) for i in range(len(CASES)) for p in FILES] * 2, "target_id string, path string")
    manifests = spark.createDataFrame([(f"t{i}", c[0]) for i, c in enumerate(CASES)], "target_id string, content string")
    out = {}
    for r in run_targets(files, manifests).collect():
        out.setdefault(r.target_id, []).append(r.path)
    return out


@pytest.mark.parametrize("nr", range(len(CASES)))
def test_manifests(found, nr):
    got = found.get(f"t{nr}", [])
    assert len(got) == len(set(got)) and set(got) == CASES[nr][1]


def test_commands_of_settings(spark):
    files = spark.createDataFrame([("t", p) for p in FILES], "target_id string, path string")
    none = spark.createDataFrame([], "target_id string, content string")
    commands = spark.createDataFrame([("t", 'bash "${ROOT}"/docs/setup.sh'), ("u", "docs/a.sh"), ("t", None), ("t", "x=deep/go.sh; y")], "target_id string, command string")
    assert {r.path for r in run_targets(files, none, commands).collect()} == {"docs/setup.sh", "tools/deep/go.sh"}


def test_a_long_line_and_many_files(spark):
    """No row holds a word with its whole line, and no row all names of a target."""
    names = [f"d/f{i}.sh" for i in range(1500)]
    line = " ".join(f"word d/f{i % 1500}.sh" for i in range(12_000)) + ". Then run d/f7.sh or a word. So d/f8.sh `sh d/f1400.sh`"
    files = spark.createDataFrame([("t", p) for p in [*names, "d/odd file.sh"]], "target_id string, path string")
    manifests = spark.createDataFrame([("t", f"{line}\n{'d/odd file.sh ' * 5_000}. exec 'd/odd file.sh'")], "target_id string, content string")
    began = time.time()
    assert {r.path for r in run_targets(files, manifests).collect()} == {"d/f7.sh", "d/f1400.sh", "d/odd file.sh"}
    assert time.time() - began < 60
