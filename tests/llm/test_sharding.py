"""Hilbert shards against a brute-force order, with strings that share a prefix, nulls, ties and repeated rows."""

import itertools

import pytest

from lodewatch.llm import sharding


def walk(n, bits):
    """The cells of an n-dimensional grid in the order of the curve, by the digit tables alone."""
    digit, inside = sharding.curve_tables(n)

    def place(cell):
        frame, out = 0, 0
        for level in reversed(range(bits)):
            corner = sum((x >> level & 1) << j for j, x in enumerate(cell))
            out, frame = (out << n) + digit[(frame << n) + corner], inside[(frame << n) + corner]
        return out

    return {cell: place(cell) for cell in itertools.product(range(1 << bits), repeat=n)}


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_once_by_unit_steps(n, bits):
    places = walk(n, bits)
    assert sorted(places.values()) == list(range(1 << n * bits))
    cells = sorted(places, key=places.get)
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in itertools.pairwise(cells))


def test_shards_match_brute_force(spark):
    names = [None, *(f"https://example.com/a/very/long/common/prefix/{i:03}" for i in range(8))]
    rows = [(i if i % 50 else None, names[i * 4 % 9], (i * 7919) % 400) for i in range(400)] + [(5, names[3], 9)] * 5
    table = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(3)
    got = sharding.shards(table, ["source", "size"], 7, bits=3, tie=("size", "doc_id")).collect()
    # each of eight names has a rank of its own; sizes are cut at the same quantiles that percentile_approx gives
    sizes = sorted(r[2] for r in rows)
    cuts = sorted({sizes[-(-k * len(sizes) // 8) - 1] for k in range(1, 8)})
    places = walk(2, 3)
    cell = lambda r: (sum(n < r[1] for n in names[1:-1]) if r[1] else 0, sum(c < r[2] for c in cuts))
    order = sorted(rows, key=lambda r: (places[cell(r)], r[2], r[0] is not None, r[0] or 0))
    n = len(rows)
    wanted = [(*r, i * 7 // n, i - -(-(i * 7 // n) * n // 7)) for i, r in enumerate(order)]
    assert sorted(map(repr, ((r.doc_id, r.source, r["size"], r.shard, r.slot) for r in got))) == sorted(map(repr, wanted))


def test_query_on_awkward_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, `shard` string, `place` int"
    rows = [(1, None, None, None, "x", 1), (2, "", "en", "b", None, None), (2, "", "en", "b", None, None), (None, "é" * 50_000, "en", "a", "x", 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    got = sharding.op7_hilbert_shards(spark, str(tmp_path / "some")).collect()
    assert sorted((r["size"], r.text_crc32) for r in got)[:3] == [(8, 0)] * 3 and max(r["size"] for r in got) == 100_008
    assert len({r.shard for r in got}) == 4 and {r.slot for r in got} == {0} and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert sharding.op7_hilbert_shards(spark, str(tmp_path / "none")).count() == 0
