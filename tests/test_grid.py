import math

import pytest
from pyspark.sql import functions as F

from fernwerk.operators import network as N, sites as Z, spatial as S, stencil as T
from fernwerk.operators.graph import connected_components


def plane(spark, n, f):
    return spark.createDataFrame([(r, c, f(r, c)) for r in range(n) for c in range(n)], "row int, col int, z double")


@pytest.mark.parametrize("bearing", [0, 45, 90, 135, 180, 225, 270, 315])
def test_a_plane_faces_where_it_falls(spark, bearing):
    tilt, res = math.tan(math.radians(20)), 30.0
    east, north = math.sin(math.radians(bearing)), math.cos(math.radians(bearing))
    cells = plane(spark, 5, lambda r, c: 1000 - tilt * res * (c * east - r * north))
    got = T.slope_aspect(cells, res).where("row = 2 and col = 2").first()
    assert got["slope"] == pytest.approx(20, abs=1e-6)
    assert min(abs(got["aspect"] - bearing), 360 - abs(got["aspect"] - bearing)) < 1e-6


def test_level_ground_and_holes(spark):
    cells = plane(spark, 5, lambda r, c: None if (r, c) == (2, 2) else 7.0)
    got = {(x["row"], x["col"]): (x["slope"], x["aspect"]) for x in T.slope_aspect(cells, 30.0, sigma=1.0).collect()}
    assert got[2, 2] == (None, None)
    assert got[0, 0] == (pytest.approx(0, abs=1e-9), pytest.approx(180))


def test_distance_to_water(spark):
    rows = spark.createDataFrame([(0, c, c == 0) for c in range(5)], "row int, col int, water boolean")
    assert [r["distance"] for r in T.distance_to(rows, 30.0).orderBy("col").collect()] == [0, 30, 60, 90, 120]
    none = rows.withColumn("water", F.lit(False))
    assert {r["distance"] for r in T.distance_to(none, 30.0).collect()} == {None}


def test_no_window_of_the_column_pass_shrinks(spark):
    """Spark goes through a window from the cell to the end anew for each cell: the square of the rows."""
    cells = plane(spark, 6, lambda r, c: float(r * 6 + c) if (r + c) % 4 == 0 else None)
    near = T.nearest_source(cells, F.col("z").isNotNull(), "z")
    plan = near._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "currentrow" in plan and "unboundedfollowing" not in plan
    sources = [(r, c) for r in range(6) for c in range(6) if (r + c) % 4 == 0]
    for x in near.collect():
        d, r, c = min(((r - x["row"]) ** 2 + (c - x["col"]) ** 2, r, c) for r, c in sources)
        assert x["_d"] == d and x["_v"] == r * 6 + c


def test_valley_floor_lies_below_its_surroundings(spark):
    v = plane(spark, 21, lambda r, c: abs(c - 10) * 10.0)
    got = T.topographic_position(v, 30.0, 90.0)
    assert got.where("row = 10 and col = 10").first()["tpi"] < 0
    assert got.where("row = 10 and col = 3").first()["tpi"] == pytest.approx(0)


def test_a_lone_seed_peaks_at_the_kernel(spark):
    cells = plane(spark, 15, lambda r, c: 0.0)
    seeds = spark.createDataFrame([(7, 7, 1.0)], "row int, col int, weight double")
    got = T.proximity(seeds, cells, 1.0)
    w = T.gaussian_weights(1.0)
    assert got.where("row = 7 and col = 7").first()["spread"] == pytest.approx(w[0] ** 2)
    assert got.agg(F.sum("spread")).first()[0] == pytest.approx(1)
    assert got.where("row = 7 and col = 12").first()["spread"] == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    up = list(range(120))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


def brute(cost, sources, res):
    best = {s: 0.0 for s in sources}
    changed = True
    while changed:
        changed = False
        for (r, c), d in list(best.items()):
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    n = (r + dr, c + dc)
                    if n in cost and n != (r, c):
                        new = d + (cost[r, c] + cost[n]) / 2 * math.hypot(dr, dc) * res
                        if new < best.get(n, math.inf) - 1e-12:
                            best[n] = new
                            changed = True
    return best


@pytest.mark.parametrize("tile", [512, 5])
def test_least_cost_with_a_wall_and_two_sources(spark, tile):
    cost = {(r, c): 50.0 if c == 5 and r != 8 else 1.0 + (r * 7 + c) % 3 for r in range(11) for c in range(11)}
    sources = {(0, 0), (10, 2)}
    rows = spark.createDataFrame([(r, c, x, (r, c) in sources) for (r, c), x in cost.items()], "row int, col int, cost double, source boolean")
    got = {(x["row"], x["col"]): x for x in N.least_cost(rows, 2.0, tile).collect()}
    want = brute(cost, sources, 2.0)
    assert all(got[k]["minutes"] == pytest.approx(v) for k, v in want.items())
    assert got[0, 0]["metres"] == 0 and (got[10, 2]["root_row"], got[10, 2]["root_col"]) == (10, 2)
    assert all(x["metres"] >= 2.0 * max(abs(x["row"] - x["root_row"]), abs(x["col"] - x["root_col"])) - 1e-9 for x in got.values())


def test_small_tiles_take_few_rounds(spark, monkeypatch):
    """A strip of thirty tiles is one block, and blocks of any size give the same labels."""
    rows = spark.createDataFrame([(r, c, 1.0 + (r * 7 + c) % 3, r == 0 and c == 1) for r in range(60) for c in range(3)], "row int, col int, cost double, source boolean")
    rounds = []
    monkeypatch.setattr(N, "materialise", lambda df, name, keep=N.materialise: rounds.append(name) or keep(df, name))
    whole = sorted(map(tuple, N.least_cost(rows, 2.0, 2).collect()))
    assert rounds.count("round") <= 2
    assert whole == sorted(map(tuple, N.least_cost(rows, 2.0, 8, block_cells=40).collect())) and rounds.count("round") > 5
    assert len(whole) == 180 and None not in whole[-1]


def test_blocks_are_whole_tiles_within_the_grid():
    assert N.block_shape((0, 143_999, 0, 49), 16, 1_000_000) == (20_000, 64)
    assert N.block_shape((0, 9_999, 0, 9_999), 512, 1_000_000) == (512, 1536)
    assert N.block_shape((-3, 5, -3, 5), 5, 9) == (5, 5)


def test_least_cost_queries_walk_all_of_the_terrain(spark):
    """sf0.01 has 40 rows of 50 cells."""
    from fernwerk.functions import curves as C
    from fernwerk.plans import routes, views as V

    sf = "/root/testdata/sf0.01"
    cells = V.terrain(spark, sf).select("row", "col", C.cost_per_metre(F.col("slope"), F.col("col") % 5 == 0, F.lit(False)).alias("cost")).collect()
    assert max(x["row"] for x in cells) > 30
    want = brute({(x["row"], x["col"]): x["cost"] for x in cells}, {(3, 7), (3, 41), (2, 20)}, 30.0)
    got = {(x["row"], x["col"]): x["minutes"] for x in routes.g05_least_cost(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=2e-5) for k, v in want.items())
    assert {(x["row"], x["col"]) for x in routes.g06_path_length(spark, sf).collect()} == set(want)
    assert {(x["row"], x["col"]) for x in routes.j16_root_drive_time(spark, sf).collect()} == {(x["row"], x["col"]) for x in cells}


def test_ends_at_one_place_are_not_paired(spark, monkeypatch):
    """Against all pairs: chains, places of one square, 150 ends at one place, ends without a place."""
    import random

    rng = random.Random(5)
    points = [(i, rng.choice([0.0, 1.4, 2.0, 3.99, 4.0]) + 10 * rng.randrange(4), rng.choice([-0.0, 0.0, 1.9, 2.1])) for i in range(90)]
    points += [(100 + i, 7.0, 7.0) for i in range(150)] + [(300, None, 7.0), (301, float("nan"), 7.0), (302, float("nan"), 7.0), (303, 7.0, float("inf"))]
    up = {p[0]: p[0] for p in points}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x, y in points:
        for j, u, v in points:
            if i < j and x is not None and u is not None and math.sqrt((x - u) ** 2 + (y - v) ** 2) <= 2:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    edges = []
    monkeypatch.setattr(N, "connected_components", lambda e, *names, find=N.connected_components: edges.append(e.count()) or find(e, *names))
    got = N.junctions(spark.createDataFrame(points, "point long, x double, y double")).collect()
    assert {r["point"]: r["node"] for r in got} == {p[0]: find(p[0]) for p in points} and len(got) == len(points)
    assert edges[0] < 500  # 150 ends at one place are 11,175 pairs


def test_frontier_and_heap_agree(spark):
    edges = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 5.0), (8, 9, 1.0)], "a long, b long, minutes double")
    a = {r["node"]: r["minutes"] for r in N.shortest_times(edges, 0).collect()}
    b = {r["node"]: r["minutes"] for r in N.shortest_times(edges, 0, heap_edges=0).collect()}
    assert a == b == {0: 0.0, 1: 3.0, 2: 1.0, 3: 8.0}


def test_patches_are_labelled_by_tiles(spark, monkeypatch):
    """Against a walk over the cells, at any size of tile; only labels that meet at rims are contracted. Two rows of one cell and a
    row without a place stay."""
    import random

    rng = random.Random(4)
    cells = {(r, c) for r in range(-3, 37) for c in range(-2, 18) if rng.random() < 0.45} | {(r, 30) for r in range(30)}
    want, todo = {}, sorted(cells)
    for start in todo:
        walk = [start]
        while walk:
            r, c = walk.pop()
            if (r, c) in cells and (r, c) not in want:
                want[r, c] = start[0] * (1 << 31) + start[1]
                walk += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    edges = []
    monkeypatch.setattr(Z, "connected_components", lambda e, find=Z.connected_components: edges.append(e.count()) or find(e))
    rows = spark.createDataFrame([(r, c, "x") for r, c in [*cells, (5, 30)]] + [(None, 1, "y")], "row int, col int, name string")
    for tile in (Z.TILE, 7):
        got = Z.patches(rows, tile)
        assert got.columns == ["row", "col", "name", "label"] and got.count() == len(cells) + 2
        assert {(x["row"], x["col"]): x["label"] for x in got.collect()} == want | {(None, 1): None}
    assert edges[0] < len(cells) / 10


@pytest.mark.parametrize("chunk", [N.CHUNK_POINTERS, 7])
def test_chains_are_followed_in_few_tables(spark, monkeypatch, chunk):
    """Chains of any order against a walk; one ends in a cell that is not there, one has a step of unknown length."""
    import random

    rng = random.Random(2)
    order = rng.sample(range(300), 300)
    pred = {c: None if i % 60 == 0 else order[i - 1] for i, c in enumerate(order)} | {900: 901, 902: 900}
    metres = {c: None if i == 75 else float(c % 5) for i, c in enumerate([*order, 900, 902])}
    want = {}
    for c in pred:
        root, far = c, 0.0
        while root in pred and pred[root] is not None:
            far = None if far is None or metres[root] is None else far + metres[root]
            root = pred[root]
        if root in pred:
            want[c] = (root, far)
    tables = []
    monkeypatch.setattr(N, "materialise", lambda df, name, keep=N.materialise: tables.append(name) or keep(df, name))
    rows = spark.createDataFrame([(c, p, metres[c]) for c, p in pred.items()], "cell long, pred long, metres double")
    assert {r["cell"]: (r["root"], r["metres"]) for r in N.pointer_roots(rows, chunk=chunk).collect()} == want
    assert tables.count("pointers") == 1
    with pytest.raises(Exception, match="circle"):
        N.pointer_roots(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "cell long, pred long, metres double")).collect()


def test_split_keeps_parts_together(spark):
    rows = [(r, c, 1.0 / (1 + min(abs(c - 3), abs(c - 17)) + abs(r - 2)), 0) for r in range(5) for c in range(21)]
    cells = spark.createDataFrame(rows, "row int, col int, score double, label long")
    parts = {}
    for x in Z.split_oversized(cells, 50, 3).collect():
        parts.setdefault(x["part"], set()).add((x["row"], x["col"]))
    assert len(parts) == 2 and sum(map(len, parts.values())) == 105
    for cells_ in parts.values():
        seen, todo = set(), [next(iter(cells_))]
        while todo:
            r, c = todo.pop()
            if (r, c) in cells_ and (r, c) not in seen:
                seen.add((r, c))
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        assert seen == cells_
    assert {x["part"] for x in Z.split_oversized(cells, 500, 3).collect()} == {0}


def test_a_patch_of_over_two_million_cells_is_split(spark):
    side = 1450
    grid = spark.range(side * side).select((F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"))
    d = F.least(*(F.greatest(F.abs(F.col("row") - r), F.abs(F.col("col") - c)) for r, c in ((300, 300), (1100, 1200))))
    cells = grid.withColumn("score", 1.0 / (1 + d)).withColumn("label", F.lit(0).cast("long"))
    got = {r["part"]: r["count"] for r in Z.split_oversized(cells, 500, 3).groupBy("part").count().collect()}
    assert len(got) == 2 and sum(got.values()) == side * side > 2_000_000


def test_inside_a_ring_with_a_hole(spark):
    ring = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    rings = F.array(ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6)))
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 5.0), (9.9, 9.9)], "x double, y double")
    assert [r[0] for r in pts.select(S.inside(F.col("x"), F.col("y"), rings)).collect()] == [True, False, False, True]


def test_lines_touch_every_cell_on_their_way(spark):
    g = S.Grid(0, 10, 1, 10, 10)
    line = spark.createDataFrame([(0.5, 9.5, 3.5, 8.5)], "x0 double, y0 double, x1 double, y1 double")
    got = {(r["row"], r["col"]) for r in S.line_cells(line, g).select("row", "col").collect()}
    assert {(0, 0), (0, 1), (1, 2), (1, 3)} <= got and len(got) <= 5


def test_utm_known_point_and_albers_origin(spark):
    x, y = S.to_utm(F.lit(-123.0), F.lit(0.0), 10)
    a, b = S.to_albers(F.lit(-126.0), F.lit(45.0))
    row = spark.range(1).select(x, y, a, b).first()
    assert row[0] == pytest.approx(500_000, abs=1e-6) and row[1] == pytest.approx(0, abs=1e-6)
    assert row[2] == pytest.approx(1_000_000, abs=1e-6) and row[3] == pytest.approx(0, abs=1e-6)
    # a quarter meridian arc is 10,001,965.73 m
    top = spark.range(1).select(S.to_utm(F.lit(-123.0), F.lit(90.0 - 1e-9), 10)[1]).first()[0]
    assert top == pytest.approx(0.9996 * 10_001_965.7293, abs=0.01)


def test_grid_limits():
    assert S.Grid(0, 0, 30.0, 1, 1).site_limits(0.5, 250, 600) == (6, 2777, 20)
    g = S.Grid.around(12.0, 1.0, 1201.0, 1001.0, 30.0)
    assert (g.left, g.top, g.rows, g.cols) == (0.0, 1020.0, 34, 41)


@pytest.mark.parametrize("name", ["j01_aligned_layers", "j03_youngest_block"])
def test_every_customer_is_a_block(spark, name):
    """Against the SQL without its filter of customers."""
    import duckdb

    from fernwerk.plans.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    for t in "customer supplier part".split():
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    out = con.execute(ORACLES[name].replace(" WHERE c_custkey % 6 = 0", ""))
    columns = [d[0] for d in out.description]
    got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=repr) == sorted(out.fetchall(), key=repr)
