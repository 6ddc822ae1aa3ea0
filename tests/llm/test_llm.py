"""The training-data operators against SQL, brute force, exact round trips and held-out labels; and on awkward tables."""

import re
import zlib
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from lodewatch.llm import licenses, linededup, mixing, neardup, packing, quality, revisits, sharding, topk, toxicity
from lodewatch.llm.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")
LONG = "Many words stand in this rather long text. " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, lw_content long"
AWKWARD = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "b", 0, None, None), (3, LONG, "en", "a", 9, "x", 1), (3, LONG, "en", "a", 9, "x", 1),
    (None, "a text without an id but with words in it", "en", "a", 1, "x", 1), (5, "same words here as there are", "de", "b", 1, "x", 1),
    (6, "same words here as there are", "de", "b", 1, "x", 1), (7, " \t\n \x0b", "de", "b", 1, "x", 1), (8, "one\nüber 😀 word", None, "b", 1, "x", 1),
]


@pytest.fixture(params=["awkward", "empty"])
def docs(spark, request):
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield spark.createDataFrame(AWKWARD if request.param == "awkward" else [], SCHEMA)
    spark.conf.unset("spark.sql.caseSensitive")


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    wanted = con.execute(ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    rows = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(SF)).collect()]
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, wanted))


def test_awkward_tables(docs, spark):
    n = docs.count()
    labels = spark.createDataFrame([(3, None), (5, 1)], "doc_id long, toxic int")
    assert linededup.dedup_lines(docs).count() == n
    assert neardup.near_duplicates(docs).count() == n
    assert mixing.sample(docs).count() == n
    assert licenses.scan(docs).count() == n
    assert quality.judge(docs).count() == n
    assert {r.copies for r in mixing.sample(docs.filter("doc_id IS NULL")).collect()} <= {1}
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == n
    tokens = packing.pack(docs, packing.public_tokenizer()).agg({"length": "sum"}).first()[0] or 0
    assert tokens >= n
    rows = docs.selectExpr("doc_id", "coalesce(source, '') AS source", "coalesce(n_chars, 0) AS size")
    assert sharding.shards(rows, ["source", "size"], 4, tie=("doc_id",)).count() == n


def sets_of(texts):
    out = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def components_of(texts, percent=85):
    sets, parent = sets_of(texts), {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(60):  # a chain of edits whose neighbours are linked, edits of one text that mostly aren't, copies, short texts
        texts[i] = " ".join(words[i : i + 90])
        texts[100 + i] = " ".join("x%d" % (i * 7 + j) if j in (i, (i * 13) % 90) else words[j] for j in range(90))
    texts |= {300: texts[3].upper(), 301: "a b", 302: "A  b", 303: "", 304: None, 305: "a b c"}
    wanted, sizes = components_of(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == wanted[i]) for i, r in got.items())


def test_targets_are_filled_like_water(spark):
    sizes = {"a": 100, "b": 1, "c": 50, "d": 4, "e": 900}
    docs = spark.createDataFrame([(i * 1000 + j, "w " * 1, s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)], "doc_id long, text string, source string")
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    target, left = dict.fromkeys(sizes, 0.0), float(sum(sizes.values()))
    while left > 1e-9:
        free = [s for s in sizes if target[s] < 3 * sizes[s] - 1e-9]
        total = sum(weight[s] for s in free)
        add = {s: min(left * weight[s] / total, 3 * sizes[s] - target[s]) for s in free}
        for s, x in add.items():
            target[s] += x
        left -= sum(add.values())
    rows = mixing.sample(docs).collect()
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 1.5 for s in sizes)
    assert mixing.mix(docs).count() == sum(taken.values())


def test_license_places_match_brute_force(spark):
    texts = {1: "Released under the MIT License.\nunder the mit license", 2: "Apache-License, version 2; CC BY-NC 4.0", 3: "under the mit", 4: "This work is licensed under the GNU General Public License, version 3.", 5: "licensed under CC BY 4.0", 6: None}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, text in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        places = [(j, label) for label, p in licenses.BASE_PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].base_labels) == (len(w), len(places), ",".join(sorted({x[1] for x in places})))
        assert (got[i].first_word, got[i].last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert [got[i].labels for i in range(1, 7)] == ["mit", "apache-2,cc-by-nc", "", "gpl-3", "cc-by", ""]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = {i: " ".join(f"Word{(i * j) % 97}, ünï{j % 13}. it's <|endoftext|> " if j % 50 == 0 else f"tok{j % 31}" for j in range(i * 40)) for i in range(30)} | {90: None, 91: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    model = Tokenizer.from_file(packing.public_tokenizer())
    pieces = packing.pack(docs, packing.public_tokenizer(), capacity=256, with_ids=True).collect()
    import numpy as np

    sequences = {}
    for i, text in texts.items():
        want = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == want
        assert all(zlib.crc32(p.ids) == p.ids_crc32 and p.doc_tokens == len(want) for p in own)
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 256 and (end == 256 or end & (end - 1) == 0)


def test_shards_are_even_and_follow_the_curve(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "id % 37 AS size", "CAST(id % 5 AS string) AS source")
    got = sharding.shards(rows, ["source", "size", "doc_id"], 24, tie=("doc_id",)).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert len(got) == 1000 and {len(v) for v in by.values()} == {41, 42}
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    last = -1
    for s in sorted(by):
        curve = [r.curve for r in sorted(by[s], key=lambda r: r.slot)]
        assert curve == sorted(curve) and curve[0] >= last
        last = curve[-1]


def test_curve_visits_neighbours():
    for n in (2, 3):
        digit, inside = sharding.curve_tables(n)
        for frame in range(n << n):
            order = sorted(range(1 << n), key=lambda c: digit[(frame << n) + c])
            assert all((a ^ b).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


def test_top_k_ties_and_own_row(spark):
    rows = spark.createDataFrame([(i, [i % 3, 1, -(i % 2)]) for i in range(50)], "vec_id long, vector array<long>")
    got = topk.top_k(rows, rows["vec_id"] % 20 == 0, 4, shard_rows=16, block_rows=2).collect()
    vec = {i: (i % 3, 1, -(i % 2)) for i in range(50)}
    for q in (0, 20, 40):
        want = sorted(((-sum(a * b for a, b in zip(vec[q], vec[c], strict=True)), c) for c in vec if c != q))[:4]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_toxic_words_are_learned_and_held_out_rows_found(spark):
    word = lambda i: f"w{i * 2654435761 % 211}"
    rows = [(i, " ".join([*(word(i * 31 + j) for j in range(40)), *(["vile", "nasty"] if i % 8 == 0 else [])]), int(i % 8 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    out = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert out and all(a == b for a, b in out)


def test_revisits_take_the_latest_earlier_response(spark):
    rows = [(1, "http://www.A.com/x/?utm_source=f#t", 10, 200, "e1", None), (2, "https://a.com:443/x", 20, 200, "e2", None), (3, "a.com/x/", 25, 304, "e2", None), (4, "http://a.com/x", 15, 304, "e9", None), (5, "http://a.com/x", 5, 304, "e1", None), (6, None, 5, 304, "e1", None), (7, "http://a.com/x", 30, 304, None, None)]
    records = spark.createDataFrame(rows, "record_id long, url string, at long, status int, etag string, modified long")
    got = {r.record_id: (r.outcome, r.base_id) for r in revisits.resolve(records).collect()}
    assert got == {1: ("full", None), 2: ("full", None), 3: ("resolved", 2), 4: ("mismatch", 1), 5: ("orphan", None), 6: ("orphan", None), 7: ("unverified", 2)}
    full = spark.createDataFrame([(r[0], r[1], r[2], r[3], {"etag": f"own{r[0]}", "content-length": "7", "date": str(r[2])}, f"body{r[0]}", *r[4:]) for r in rows], "record_id long, url string, at long, status int, headers map<string,string>, body string, etag string, modified long")
    done = {r.record_id: r for r in revisits.materialise(full, revisits.resolve(records)).collect()}
    assert (done[3].status, done[3].body, done[3].headers["date"]) == (200, "body2", "25") and len(done) == 7


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) == docs.count()
    found, _ = components_of(texts)
    assert all(i == c for i, c in found.items())  # no two near copies are left
    assert corpus_pipeline.run(spark, str(SF)).count() > 0


def test_near_copies_of_the_stage_match_brute_force_at_80(spark):
    texts = {}
    for i in range(12):  # two edits that leave 78 of 94 shingles, two that leave 76 of 96
        words = [f"w{i}x{j}" for j in range(90)]
        for nr, edits in enumerate([(), (40, 87), (20, 60)]):
            texts[3 * i + nr] = " ".join("new" if j in edits else w for j, w in enumerate(words))
    wanted, _ = components_of(texts, 80)
    assert len(set(wanted.values())) == 24 and len(set(components_of(texts)[0].values())) == 36
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    left = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(left) == sorted(set(wanted.values()))


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_no_near_copies_at_80_are_left_by_the_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted, _ = components_of({r.doc_id: r.text for r in docs.collect()}, 80)
    left = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(SF)).collect()]
    assert sorted(left) == sorted(set(wanted.values()))


def test_near_copies_of_the_stage_go_by_row_where_ids_repeat(spark):
    a, b, c = (" ".join(f"{x}{j}" for j in range(60)) for x in "abc")
    texts = [(1, a), (1, b), (2, b + " end"), (None, a + " end"), (None, c), (None, c), (None, c + " end"), (3, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(x for x in left if x[0]) == sorted([(1, a), (1, b), (3, ""), (4, None)], key=lambda x: (x[0], x[1] or ""))
    assert [i for i, _ in left].count(None) == 1 and {t for i, t in left if i is None} <= {c, c + " end"}


def test_only_status_200_is_a_base(spark):
    rows = [(1, 10, 200, "e1", "page"), (2, 20, 404, None, "not found"), (3, 25, None, "e1", "?"), (4, 26, 206, "e1", "pa"), (5, 30, 304, "e1", None)]
    records = spark.createDataFrame([(i, "a.com/x", at, status, etag, None, {"date": str(at)}, body) for i, at, status, etag, body in rows], "record_id long, url string, at long, status int, etag string, modified long, headers map<string,string>, body string")
    resolved = revisits.resolve(records)
    assert {r.record_id: (r.full, r.outcome, r.base_id) for r in resolved.collect()} == {1: (True, "full", None), **dict.fromkeys((2, 3, 4), (False, "other", None)), 5: (False, "resolved", 1)}
    done = {r.record_id: (r.status, r.body) for r in revisits.materialise(records, resolved).collect()}
    assert done == {1: (200, "page"), 2: (404, "not found"), 3: (None, "?"), 4: (206, "pa"), 5: (200, "page")}
