"""Loads of remote code: shapes that must be found, and shapes that must not."""

import time

import pytest

from lodewatch.operators.remote_loads import remote_loads

#: (name, text, lines that load remote code)
CASES = [
    ("a.mjs", "const a = await import('https://x.example/a.js');\nimport 'https://x.example/b.ts';\nexport * from \"https://x.example/c.js\";\nconst d = await import(\n  'https://x.example/d.js'\n);\nimport(/* ' */ `https://${host}/e.js`);\n", [1, 2, 3, 4, 7]),
    ("b.mjs", "const BASE = 'https://x.example';\nexport const NEXT = `${BASE}/p.js`;\nlet n = 3, LAST = NEXT;\nawait import(BASE + '/i.js');\nawait import(NEXT);\nawait import(LAST);\nawait import(n);\n", [4, 5, 6]),
    ("c.ts", "const u: string = 'https://x.example/t.ts';\nasync function f() { return import(u); }\nfunction g() { return import(v); }\nlet v;\nfunction h() {\n  return v = 'http://x.example/v.js';\n}\n", [2, 3]),
    ("d.cjs", "const { execSync } = require('child_process');\nexecSync('curl -sSL https://x.example/format.js -o lib/format.js');\nconst f = require('./lib/format');\nconst g = require('./lib/other');\n", [3]),
    ("e.cjs", "fetch(url).then(r => r.text()).then(t => fs.writeFileSync('x.js', t)); require('./x.js');\n", [1]),
    ("f.cjs", "run(['a', (1), {b: 'wget https://x.example/m.mjs'}]);\nrequire('./m.mjs');\n", [2]),
    ("g.py", "import httpimport\nfrom httpimport import load\n", [1, 2]),
    ("h.py", "import importlib\na = importlib.import_module(r'https://x.example/raw.py')\nb = importlib.import_module(F\"https://x.example/{n}.py\")\n", [2, 3]),
    ("i.py", "import urllib.request\nurllib.request.urlretrieve(URL, 'net_helper.py')\nimport net_helper\nfrom pkg.net_helper import x\nimport os, net_helper as h\n", [3, 4, 5]),
    ("j.py", "with open('stage.py', 'wb') as f:\n    f.write(requests.get(U).content)\nspec = importlib.util.spec_from_file_location('s', 'stage.py')\nimportlib.import_module('a.stage')\n", [3, 4]),
    ("k.py", "subprocess.run(['curl', '-o', '/tmp/three.py', U], check=True)\nrunpy.run_path('/tmp/three.py')\n", [2]),
    ("l.py", "os.system('cd /tmp && wget https://x.example/four.py')\n__import__('four')\n", [2]),
    ("m.mjs", "const url = 'https://a.example';\nfunction f(c) {\n  const url = `${c}?t=1`;\n  return import(url);\n}\n", []),
    ("n.jsx", "const src = './help.js';\nconst x = <iframe title=\"h\" src=\"https://h.example/p\" />;\nawait import(src);\n", []),
    ("o.cjs", "// require('https://x.example/h.js')\nconst w = \"Don't call require('https://x.example/h.js').\";\nfs.writeFileSync('gen.js', code);\nrequire('./gen.js');\n", []),
    ("p.cjs", "console.log('curl https://x.example/hint.js -o hint.js');\nrequire('./hint.js');\n", []),
    ("q.py", "raise RuntimeError(\"Run `wget https://x.example/pb2.py` first.\")\nimport pb2\n", []),
    ("r.py", "urllib.request.urlretrieve(API, 'report.json')\nimport report\nwith open('mod.py') as f:\n    pass\nimport mod\n", []),
    ("s.mjs", "const API = 'https://x.example';\nawait fetch(`${API}/s.json`);\nconst c = await import('./status.json');\nobj.API = 'https://y';\nloader.require(API);\nArray.from(API);\n", []),
    ("t.py", "note = '''\nimport httpimport\n'''\nprint('importlib.import_module(\"https://x.example\")')\n", []),
    ("u.js", "a == 'https://x';\nimport(a);\nconst f = () => b => 'https://x';\nimport(f);\n", []),
    ("v.cjs", "execSync('ls'); log('wget https://x.example/after.js');\nrequire('./after.js');\n", []),
    ("w.md", "import 'https://x.example/b.ts'", []),
    ("x.js", None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("t", n, t) for n, t, _ in CASES], "target_id string, path string, content string")
    out = {}
    for r in remote_loads(files.union(files)).collect():
        out.setdefault(r.path, []).append((r.line, r.column, r.snippet))
    return out


@pytest.mark.parametrize(("name", "text", "lines"), CASES, ids=[c[0] for c in CASES])
def test_shapes(found, name, text, lines):
    got = sorted(found.get(name, []))
    assert [x[0] for x in got] == lines
    for line, column, snippet in got:
        own = text.split("\n")[line - 1]
        assert snippet == own.strip()[:120]
        assert own[column - 1 :].startswith(("import", "require", "from", "run_path", "spec_from", "__import__"))


def test_long_chains_take_few_rounds(spark):
    n = 20_000
    text = "let v0 = 'https://x.example/a.js';\n" + "".join(f"let v{i} = v{i - 1};\n" for i in range(1, n)) + f"import(v{n - 1});\nimport(w);\n"
    files = spark.createDataFrame([("t", "a.js", text)], "target_id string, path string, content string")
    began = time.perf_counter()
    assert [r.line for r in remote_loads(files).collect()] == [n + 1]
    assert time.perf_counter() - began < 60
