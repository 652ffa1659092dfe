"""op11 and op13 against plain Python over whole tables, op12's edges (its query is held against SQL), and edges of all three."""

import datetime as dt
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from palimpsest.llm import centroids, late_overwrite, queries, url_filter
from palimpsest.llm.common import scratch_path

# ---------------------------------------------------------------- centroids


def lloyd(ids, vectors, k=8, rounds=10, seed=3):
    """Clusters, squared distances and centroids by comparing all distances."""
    x = np.array(vectors, np.int64)
    first = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), vectors[i]))[:k]
    c = x[first].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if turn < rounds:
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = [int(v) // int((a == j).sum()) for v in x[a == j].sum(0)]
    return a, d.min(1), c


def test_centroids_of_all_embeddings(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    ids, ints = [r["vec_id"] for r in rows], [[math.floor(1024 * v) for v in r["embedding"]] for r in rows]
    a, d, c = lloyd(ids, ints)
    digests = centroids.centroid_hashes(c)
    want = {(i, int(k), int(n), int(d[a == k].sum()), int(d.sum()), digests[k]) for i, k, n in zip(ids, a, d)}
    made = queries.op11_centroids(spark, sf_dir).collect()
    assert len(made) == len(rows) and set(map(tuple, made)) == want


def test_bounds_keep_ties_and_save_distances(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(400)]  # few places, so many ties
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = centroids.cluster_vectors(docs, components=3, scale=8.0, k=6, rounds=7, seed=1)
    a, d, c = lloyd([r[0] for r in rows], [[int(8 * v) for v in r[1]] for r in rows], 6, 7, 1)
    assert found.centroids.tolist() == c.tolist()
    assert {(r.vec_id, r.cluster, r.distance) for r in found.rows.collect()} == {(i, int(k), int(n)) for (i, _), k, n in zip(rows, a, d)}
    assert found.computed[0] == 6 * 400 and sum(found.computed[1:]) < 7 * 6 * 400 * 0.8


def test_vectors_that_are_not_kept_and_odd_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25], "a", 1), (2, [1.0], "a", 1), (3, None, "a", 1), (4, [nan, 1.0], "a", 1), (5, [inf, 0.0], "a", 1), (6, [None, 0.0], "a", 1), (1, [0.5, 0.25], "a", 1), (None, [-1e300, 1e300], "a", 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance int")
    found = centroids.cluster_vectors(docs, components=2, scale=4.0, k=2, rounds=2)
    got = sorted(((r.vec_id, r.distance) for r in found.rows.collect()), key=str)
    assert [i for i, _ in got] == [1, 1, None]  # repeated rows stay, others aren't kept
    clipped = spark.createDataFrame([(7, [-1e300, 1e300])], "vec_id long, embedding array<double>")
    assert centroids.cluster_vectors(clipped, components=2, k=1).centroids.tolist() == [[-centroids.LARGEST, centroids.LARGEST]]
    few = centroids.cluster_vectors(docs.filter("vec_id = 1"), components=2, k=8, rounds=3)
    assert [(r.cluster, r.distance) for r in few.rows.collect()] == [(0, 0), (0, 0)] and len(few.centroids) == 2
    assert centroids.cluster_vectors(docs.limit(0), components=2).rows.count() == 0


# ---------------------------------------------------------------- URLs

LIST = [("example.com", "/a/", "block"), ("b.example.com", "/a/", "allow"), ("example.com", "/a/b", "allow"), ("net", "", "block"), ("Org", None, "block"), (None, "/", "block"), ("", "", "block"), ("net", "", "block")]
URLS = [
    ("http://example.com/a/x", "block"), ("http://EXAMPLE.com/a/x", "block"), ("https://b.example.com/a/b", "allow"), ("https://c.b.example.com/a/", "allow"), ("http://example.com/a/bc?q", "allow"), ("http://example.com/A/", "allow"),
    ("http://badexample.com/a/", "allow"), ("http://x.net", "block"), ("net://net", "block"), ("http://x.org#net", "block"), ("http://net.io/a/", "allow"), ("no scheme", "allow"), (None, "allow"), ("", "allow"), ("http://", "allow"),
    ("http://x.net:80/", "allow"), ("http://a://net/", "allow"), ("http://" + "a." * 20000 + "net/" + "p" * 50000, "block"), ("line\nhttp://x.net/\nq", "block"), ("http://x.net/", "block"), ("http://x.net/", "block"),
]


@pytest.mark.parametrize("blocks, bits, share", [(url_filter.BROADCAST_BLOCKS, url_filter.BITS_PER_KEY, url_filter.HOT_SHARE), (0, 1, 1)])
def test_url_verdicts(spark, monkeypatch, blocks, bits, share):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(url_filter, "HOT_SHARE", share)
    pages = spark.createDataFrame([(k, u, "mine") for k, (u, _) in enumerate(URLS)], "id long, url string, key string")
    listed = spark.createDataFrame(LIST + [(f"h{k}.io", f"/{'x' * (k % 7)}", "block") for k in range(300)], "host string, path string, verdict string")
    got = {r.id: r for r in url_filter.filter_urls(pages, listed, bits_per_key=bits).collect()}
    assert len(got) == len(URLS) and {k: r.verdict for k, r in got.items()} == {k: v for k, (_, v) in enumerate(URLS)}
    assert got[3].entry_host == "b.example.com" and got[3].entry_path == "/a/" and got[3].key == "mine" and got[1].host == "example.com" and got[12].host == "" and got[4].path == "/a/bc"
    assert url_filter.filter_urls(pages, listed.limit(0)).filter("verdict != 'allow'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_filter_passes_every_listed_key_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    n_blocks = -(-20_000 * url_filter.BITS_PER_KEY // 256)
    blocks = url_filter.bloom_blocks(keys, n_blocks)
    assert url_filter.possible(keys, blocks, n_blocks).count() == 20_000
    assert url_filter.possible(spark.range(20_000).selectExpr("concat('other', id) AS key"), blocks, n_blocks).count() < 200


# ---------------------------------------------------------------- late rows

EPOCH = dt.datetime(1970, 1, 1)
CUT = dt.datetime(2024, 3, 20)


def us(t):
    return None if t is None else (t - EPOCH) // dt.timedelta(microseconds=1)


def day_of(row):
    return -1 if row["sold_at"] is None else us(row["sold_at"]) // 86_400_000_000


def latest(rows):
    """Of each id the row that arrived last; of equal ones the greatest."""
    low = lambda v: (v is not None, v if v is not None else 0)
    best = {}
    for x in rows:
        order = [low(x["arrived_at"]), *[low(v) for c, v in x.items() if c != "arrived_at"]]
        if x["sale_id"] not in best or order > best[x["sale_id"]][0]:
            best[x["sale_id"]] = (order, x)
    return {k: x for k, (_, x) in best.items()}


def final_files(rows, rows_per_file):
    """The start's ids and days, and by (day, file_no) the rows of the last layout with whether its day was rewritten."""
    late = [x for x in rows if x["arrived_at"] is None or x["arrived_at"] >= CUT]
    start, last = latest([x for x in rows if x not in late]), latest(rows)
    days = set()
    for i, x in latest(late).items():
        if x == last[i]:
            days |= {day_of(x)} | ({day_of(start[i])} if i in start else set())
    by, out = {}, {}
    for x in last.values():
        by.setdefault(day_of(x), []).append(x)
    for d, xs in by.items():
        xs.sort(key=lambda x: (x["sold_at"] or EPOCH, x["sale_id"] is not None, x["sale_id"] or 0))
        for k in range(0, len(xs), rows_per_file):
            out[d, k // rows_per_file] = (xs[k:k + rows_per_file], d in days)
    return out


def test_late_sales_of_the_whole_table(spark, sf_dir):
    sales = pq.read_table(f"{sf_dir}/sales.parquet").to_pylist()
    rows = list(sales)
    for x in sales:
        h = zlib.crc32(str(x["sale_id"]).encode())
        if h % 3 == 0 and day_of(x) % 4 == 0:
            rows.append({**x, "total": None if x["total"] is None else x["total"] + 1, "sold_at": x["sold_at"] + dt.timedelta(days=h % 2), "arrived_at": x["arrived_at"] + dt.timedelta(days=1 + h % 97)})
    text = lambda v: "" if v is None else str(v)
    want = {}
    for key, (xs, rewritten) in final_files(rows, 1 + len(sales) // 1100).items():
        cents = sum(0 if x["total"] is None else math.floor(100 * x["total"] + 0.5) for x in xs)
        crc = sum(zlib.crc32(f"{x['sale_id']}:{text(us(x['sold_at']))}:{text(us(x['arrived_at']))}".encode()) for x in xs)
        want[key] = (len(xs), cents, crc, ",".join(list(sales[0])), hashlib.sha256(",".join(str(x["sale_id"]) for x in xs).encode()).hexdigest(), rewritten)
    made = queries.op13_late_overwrite(spark, sf_dir).collect()
    assert len(made) == len(want) and {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.columns, r.ids_sha256, r.rewritten) for r in made} == want
    # the files hold what the rows say, and there are no others
    own = {r.path.removeprefix("file://") for r in made}
    root = os.path.dirname(os.path.dirname(next(iter(own))))
    assert {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")} == own
    for r in made[::50]:
        held = pq.ParquetFile(r.path.removeprefix("file://")).read()
        assert ",".join(held.column_names) == r.columns and hashlib.sha256(",".join(map(str, held["sale_id"].to_pylist())).encode()).hexdigest() == r.ids_sha256


KIND = "sale_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, day string, part int"


def sale(i, sold, arrived, day="x", part=0):
    at = lambda s: None if s is None else dt.datetime.fromisoformat(f"2024-0{s}")
    return {"sale_id": i, "sold_at": at(sold), "arrived_at": at(arrived), "day": day, "part": part}


EARLY = [sale(1, "1-01", "1-02"), sale(1, "1-01", "1-01"), sale(2, "1-01", "1-02"), sale(2, "1-01", "1-02"), sale(3, "1-02", "1-02"), sale(4, None, "1-02"), sale(5, "1-03", "1-03"), sale(None, "1-05", "1-05"), sale(6, "1-06", "1-06"), sale(7, "1-06", "1-06"), sale(9, "1-06", "1-06", None, None)]
LATE = [sale(3, "1-01", "3-21"), sale(4, "1-04", "3-21"), sale(5, "1-03", "3-21", "y"), sale(5, "1-03", "3-21", "z", 4), sale(8, "1-07", None), sale(None, None, "3-22"), sale(2, "1-09", None)]


def contents(layout):
    root, out = layout.path.removeprefix("file://"), {}
    for d, _, names in os.walk(root):
        for f in names:
            if f.endswith(".parquet"):
                out[os.path.join(d, f)] = open(os.path.join(d, f), "rb").read()
    return out


def held(spark, layout):
    """By (day, file_no) the rows in the order of the files."""
    files = {(r.day, r.part): r.file_no for r in late_overwrite.layout_files(spark, layout).collect()}
    out = {}
    for r in sorted(layout.standing(spark).collect(), key=lambda r: (r.day, r.part, r.row_index)):
        out.setdefault((r.day, files[r.day, r.part]), []).append(dict(zip(layout.schema.names, r[:len(layout.schema)])))
    return out


def test_late_rows_edges(spark):
    make = lambda rows: spark.createDataFrame([tuple(x.values()) for x in rows], KIND)
    layout = late_overwrite.Layout(scratch_path(spark, "edges"), make(EARLY).schema, "sale_id", "sold_at", "arrived_at", 2)
    late_overwrite.write_layout(make(EARLY).repartition(3), layout)
    before = contents(layout)
    days = late_overwrite.merge_late(make(LATE).repartition(2), layout)
    want = final_files(EARLY + LATE, 2)
    assert held(spark, layout) == {k: xs for k, (xs, _) in want.items()}
    after = contents(layout)
    untouched = {f for f in before if int(f.split("day_=")[1].split("/")[0]) not in days}
    assert untouched and all(after[f] == before[f] for f in untouched) and not (set(before) - untouched) & set(after)
    # day 2024-01-02 and the null id's old day have lost all their rows
    assert {19724, 19727} <= set(days) and not {k for k, _ in want} & {19724, 19727}
    # the same late rows again, and late rows of none
    again = late_overwrite.merge_late(make(LATE), layout)
    assert held(spark, layout) == {k: xs for k, (xs, _) in want.items()} and set(again) <= set(days)
    assert late_overwrite.merge_late(make([]), layout) == []
    # a row that is older than the one that stands changes nothing
    assert late_overwrite.merge_late(make([sale(3, "1-09", "1-01")]), layout) == []


def test_late_rows_without_a_start_and_without_any(spark):
    make = lambda rows: spark.createDataFrame([tuple(x.values()) for x in rows], KIND)
    layout = late_overwrite.Layout(scratch_path(spark, "edges"), make(EARLY).schema, "sale_id", "sold_at", "arrived_at", 3)
    late_overwrite.write_layout(make([]), layout)
    assert late_overwrite.layout_files(spark, layout).count() == 0
    assert late_overwrite.merge_late(make([]), layout) == []
    late_overwrite.merge_late(make(EARLY), layout)
    assert held(spark, layout) == {k: xs for k, (xs, _) in final_files(EARLY, 3).items()}


def test_many_rows_of_a_day_and_a_moment(spark):
    rows = [sale(i, "1-01", "1-02") for i in range(3000)] + [sale(i, None, "1-02") for i in range(3000, 3500)]
    more = [sale(i, "1-01" if i % 2 else "1-02", "3-21") for i in range(0, 4000, 3)]
    make = lambda rows: spark.createDataFrame([tuple(x.values()) for x in rows], KIND)
    layout = late_overwrite.Layout(scratch_path(spark, "edges"), make(rows).schema, "sale_id", "sold_at", "arrived_at", 7)
    late_overwrite.write_layout(make(rows), layout)
    late_overwrite.merge_late(make(more), layout)
    assert held(spark, layout) == {k: xs for k, (xs, _) in final_files(rows + more, 7).items()}
