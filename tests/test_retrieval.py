"""The search by cells against all distances, and pages with odd markup."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import retrieval


def plain(points, sources, asked, k, wanted=None):
    found = {}
    for q, v in asked.items():
        d = ((points - v) ** 2).sum(1).round(9)
        own = [i for i in range(len(points)) if wanted is None or sources[i] == wanted[q]]
        found[q] = [(i, sources[i], pytest.approx(d[i], rel=1e-9, abs=1e-8), r + 1) for r, i in enumerate(sorted(own, key=lambda i: (d[i], i))[:k])]
    return found


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.source, r.distance, r["rank"]))
    return out


def tables(spark, points, sources, asked, wanted=None):
    chunks = spark.createDataFrame([(i, s, p.tolist(), "x") for i, (p, s) in enumerate(zip(points, sources, strict=True))], "chunk_id long, source string, embedding array<double>, cell string").repartition(3)
    rows = [(q, v.tolist(), *([wanted[q]] if wanted else [])) for q, v in asked.items()]
    return spark.createDataFrame(rows, "query_id long, embedding array<double>" + (", source_filter string" if wanted else "")), chunks


@pytest.mark.parametrize("blocks", [(1 << 16, 8192), (1 << 16, 500), (3, 40)])
def test_cells_find_all_that_all_distances_find(spark, blocks):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 20
    points = np.vstack([centres[i % 12] + rng.normal(size=8) * (0.1 + i % 5) for i in range(1500)] + [centres[0]] * 100)  # a hundred copies of one vector
    sources = [f"s{i % 7 if i % 97 else 'rare'}" for i in range(len(points))]
    asked = {q: points[q] + rng.normal(size=8) * (q % 3) for q in range(0, 1600, 41)} | {9999: np.full(8, 1e4), 9998: centres[0]}
    wanted = {q: ("srare" if q % 2 else "s1") if q != 9999 else "nobody" for q in asked}
    queries, chunks = tables(spark, points, sources, asked)
    assert by_query(retrieval.nearest(queries, chunks, 7, *blocks)) == plain(points, sources, asked, 7)
    queries, chunks = tables(spark, points, sources, asked, wanted)
    assert by_query(retrieval.nearest(queries, chunks, 7, *blocks)) == {q: v for q, v in plain(points, sources, asked, 7, wanted).items() if v}


def test_fewer_chunks_than_asked_for_and_none(spark):
    points, asked = np.array([[0.0, 0], [3, 4], [0, 1]]), {1: np.zeros(2)}
    queries, chunks = tables(spark, points, ["a", "b", "a"], asked)
    assert [x[0] for x in by_query(retrieval.nearest(queries, chunks, 10))[1]] == [0, 2, 1]
    assert retrieval.nearest(queries, chunks.limit(0)).count() == 0 and retrieval.nearest(queries.limit(0), chunks).count() == 0
    odd = chunks.unionByName(spark.createDataFrame([(7, "a", None, "x")], chunks.schema))
    assert retrieval.nearest(queries, odd, 10).count() == 3


def test_most_cells_are_not_visited(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 6)) * 50
    points = np.vstack([centres[i % 40] + rng.normal(size=6) for i in range(4000)])
    asked = {q: points[q] + 0.01 for q in range(0, 4000, 50)}
    queries, chunks = tables(spark, points, ["s"] * 4000, asked)
    places = retrieval._centres(chunks, 4000, 256)
    held = retrieval._in_cells(chunks.drop("cell"), places)
    cells = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).agg(F.collect_list(F.struct("cell", "n", "radius")).alias("cells"))
    known = queries.select("query_id", F.lit("s").alias("source"), "embedding").crossJoin(cells)
    first = retrieval._visits(known, places, 5, False).count()
    reach = retrieval.nearest(queries, chunks, 5, chunk_block=500).groupBy("query_id").agg(F.max("distance").alias("reach"))
    more = retrieval._visits(known.join(reach, "query_id").select("query_id", "source", "embedding", "cells", "reach"), places, 5, True).count()
    assert len(places) > 25 and first + more < 0.2 * len(asked) * len(places)


def test_links_of_a_base_with_a_slash_and_of_comments(spark):
    html = '<a href="/a">x</a><!-- <a href="/hidden">y</a> --><a href="b#c">z</a><a href="http://h/d/e/">w</a><a href="http://other/">v</a>'
    df = spark.createDataFrame([(html, "http://h/d/page")], "html string, url string")
    for base in ("http://h", "http://h/", "http://h//"):
        assert df.select(retrieval.page_links(F.col("html"), F.col("url"), F.lit(base)).alias("x")).first().x == ["http://h/a", "http://h/d/b#c", "http://h/d/e/"]


def test_pages_with_many_open_tags_are_read_in_time(spark):
    html = "<main>" + "<p><li>some text" * 40_000 + "<nav>menu<p></nav>end</main>after"
    begun = time.time()
    got = spark.createDataFrame([("s", "u", html)], "source string, url string, html string")
    text = retrieval.page_text(got).first().content
    assert text.count("some text") == 40_000 and text.endswith("end") and "menu" not in text and time.time() - begun < 20
