import random
from collections import Counter

import pytest
from helpers import area, areas_df, finals_by_area, naive, request, requests_df, results_by_id, state_df
from pyspark.sql import functions as F

from turnstile.operators import cut
from turnstile.operators.allocate import allocate
from turnstile.operators.changelog import EVERY, at_positions, segments, with_grids
from turnstile.operators.strategies import pick_first_run, pick_named_seats, register_strategy, refused


@pytest.mark.parametrize(
    "grid, n, seats",
    [
        ("111|111|111", 2, [(0, 0), (0, 1)]),
        ("001|101|011", 2, [(2, 1), (2, 2)]),
        ("101|101|101", 2, None),
        ("11|11", -1, None),
        ("11|11", 0, None),
        ("11|11", 3, None),
        ("", 1, None),
    ],
)
def test_first_run(grid, n, seats):
    rows = grid.split("|")
    assert pick_first_run(bytearray(grid, "ascii"), len(rows), len(rows[0]), n, []) == seats


@pytest.mark.parametrize(
    "grid, seats, ok",
    [
        ("11|11", [(0, 0), (0, 1)], True),
        ("00|00", [(0, 0), (0, 1)], False),
        ("11|11", [(0, 1), (0, 2)], False),
        ("11|11", [(0, -1)], False),
        ("11|11", [(-1, 0)], False),
        ("11|11", [(2, 0)], False),
        ("11|11", [], True),
    ],
)
def test_named_seats(grid, seats, ok):
    assert pick_named_seats(bytearray(grid, "ascii"), 2, 2, 0, seats) == (seats if ok else None)


def run(spark, areas, requests, **how):
    allocation = allocate(requests_df(spark, requests), areas_df(spark, areas), **how)
    return results_by_id(allocation.results()), finals_by_area(allocation.final_areas())


def test_golden_cases_one_area_each(spark):
    """Each case is one request on a fresh 3x3 area."""
    row0 = [(0, 0), (0, 1), (0, 2)]
    cases = {
        "a": (request(1, "RANDOM", 3, area="a", rid="a"), ("SUCCESS", row0, None, None), 6),
        "b": (request(1, "SELF_PICK", 0, row0, area="b", rid="b"), ("SUCCESS", row0, None, None), 6),
        "c": (
            request(1, "SELF_PICK", 0, [(0, 1), (0, 2), (0, 3)], area="c", rid="c"),
            ("FAILED", None, "INVALID_SEAT", "event#c (0, 3) is not a valid seat."),
            9,
        ),
        "d": (
            request(1, "INVALID", 3, area="d", rid="d"),
            ("FAILED", None, "INVALID_ARGUMENT", "INVALID reservation strategy is not implemented"),
            9,
        ),
        "e": (
            request(1, "RANDOM", 4, area="e", rid="e"),
            ("FAILED", None, "NOT_AVAILABLE", "no continuous 4 seats at area e in event event"),
            9,
        ),
    }
    unknown = request(1, "RANDOM", 1, area="B", rid="x")
    results, finals = run(
        spark, [area(3, 3, name=k) for k in cases], [c[0] for c in cases.values()] + [unknown]
    )
    for key, (_, expected, left) in cases.items():
        assert results[key] == expected
        assert finals[f"event#{key}"][0] == left
    assert results["x"] == ("FAILED", None, "INVALID_EVENT_AREA", "event#B event area does not exist")


def test_partly_taken_grids(spark):
    requests = requests_df(
        spark, [request(1, "RANDOM", 2), request(2, "SELF_PICK", 0, [(0, 0), (0, 1)]), request(3, "SELF_PICK", 0, [(2, 0)])]
    )
    blocked = results_by_id(allocate(requests, state_df(spark, "101|101|101")).results())
    assert blocked["r1"] == ("FAILED", None, "NOT_AVAILABLE", "no continuous 2 seats at area A in event event")
    assert blocked["r2"] == ("FAILED", None, "NOT_AVAILABLE", "event#A (0, 1) is unavailable.")
    assert blocked["r3"][0] == "SUCCESS"
    last = results_by_id(allocate(requests, state_df(spark, "001|101|011")).results())
    assert last["r1"] == ("SUCCESS", [(2, 1), (2, 2)], None, None)


def test_repeated_and_empty_seat_lists(spark):
    requests = [
        request(1, "SELF_PICK", 0, [(0, 0), (0, 0)]),
        request(2, "SELF_PICK", 5, []),
        request(3, "RANDOM", 0),
        request(4, "SELF_PICK", 0, [(0, 0)]),
        request(5, "RANDOM", 3),
    ]
    allocation = allocate(requests_df(spark, requests), areas_df(spark, [area(2, 2)]))
    results = results_by_id(allocation.results())
    assert results["r1"] == ("SUCCESS", [(0, 0), (0, 0)], None, None)
    assert results["r2"] == ("SUCCESS", [], None, None)
    assert results["r3"] == ("FAILED", None, "INVALID_ARGUMENT", "0 continuous seats is invalid")
    assert results["r4"][2] == "NOT_AVAILABLE"
    final = allocation.final_areas().first()
    assert (final["available_seats"], final["free_seats"], final["grid"]) == (2, 3, "01|11")
    changes = {r["seq"]: (r["available_seats"], r["grid"]) for r in allocation.changelog().collect()}
    assert changes == {0: (4, "11|11"), 1: (2, "01|11"), 2: (2, "01|11")}


def test_recreated_area_frees_all_seats(spark):
    areas = [area(1, 2), area(2, 2, seq=10)]
    requests = [
        request(1, "RANDOM", 2), request(2, "RANDOM", 1), request(11, "RANDOM", 2), request(12, "SELF_PICK", 0, [(1, 0)]),
        request(3, "RANDOM", 1, area="late"),
    ]
    results, finals = run(spark, areas + [area(1, 1, seq=5, name="late")], requests)
    expected, final = naive(areas + [area(1, 1, seq=5, name="late")], requests)
    assert results == expected
    assert finals == final
    assert results["r3"][2] == "INVALID_EVENT_AREA"


def test_areas_without_rows(spark):
    results, _ = run(spark, [area(0, 4)], [request(1, "RANDOM", 1), request(2, "SELF_PICK", 0, [(0, 0)])])
    assert results["r1"][2] == "NOT_AVAILABLE"
    assert results["r2"][2] == "INVALID_SEAT"


def random_log(seed, areas=3, n=400, side=5, versions=1):
    rnd = random.Random(seed)
    made = [
        area(rnd.randint(1, side), rnd.randint(1, side), seq=rnd.randint(0, n) if v else 0, name=str(a))
        for a in range(areas)
        for v in range(versions)
    ]
    made = list({(a[0], a[1]): a for a in made}.values())
    log = []
    for seq in range(1, n + 1):
        # One area takes most of the load; one is unknown.
        name = rnd.choice(["0"] * 4 + [str(a) for a in range(areas + 1)])
        kind = rnd.choice(["RANDOM", "SELF_PICK", "SELF_PICK", "INVALID"])
        seats = [
            (rnd.randint(-1, side) if rnd.random() < 0.1 else rnd.randrange(side), rnd.randrange(side))
            for _ in range(rnd.randint(0, 3))
        ]
        log.append(request(seq // 3, kind, rnd.randint(-1, 4), seats if kind == "SELF_PICK" else [], area=name, rid=f"r{seq}"))
    return made, log


@pytest.mark.parametrize("seed, versions", [(1, 1), (2, 3), (3, 1), (4, 6)])
def test_random_logs_against_naive(spark, seed, versions):
    """Candidates, fold and answers give what one record at a time gives."""
    areas, log = random_log(seed, versions=versions)
    results, finals = run(spark, areas, log)
    expected, final = naive(areas, log)
    assert results == expected
    assert finals == final


def test_same_result_for_any_partitioning_and_batch_size(spark):
    areas, log = random_log(9)
    expected, _ = naive(areas, log)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}
    try:
        for partitions, batch in (("1", "7"), ("13", "10000")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert run(spark, areas, log)[0] == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for k, v in before.items():
            spark.conf.set(k, v)


def test_large_area_takes_the_salted_path(spark):
    """More seats than Spark's limit for cutting groups before the shuffle."""
    rnd = random.Random(3)
    log = [request(s, "RANDOM", rnd.randint(1, 3), rid=f"r{s}") for s in range(1, 1501)]
    areas = [area(40, 40)]
    results, finals = run(spark, areas, log)
    expected, final = naive(areas, log)
    assert results == expected
    assert finals == final


def test_inactive_requests_stay_without_result(spark):
    requests = requests_df(spark, [request(1, "RANDOM", 2), request(2, "RANDOM", 2)])
    allocation = allocate(requests, areas_df(spark, [area(1, 2)]), active=F.col("seq") > 1)
    results = results_by_id(allocation.results())
    assert results["r1"] == (None, None, None, None)
    assert results["r2"][0] == "SUCCESS"


def positions(rnd, kind, n):
    return {"even": lambda: rnd.randrange(10 * n), "one": lambda: 7, "early": lambda: int(rnd.expovariate(1) ** 6)}[kind]()


@pytest.mark.parametrize("kind", ["even", "one", "early"])
def test_first_rows_are_kept_and_few_others(spark, kind, monkeypatch):
    """Positions of all kinds, rows that are delivered several times, groups of all sizes."""
    monkeypatch.setattr(cut, "RANGES", 8)
    rnd = random.Random(len(kind))
    rows = []
    for group, n, wanted in (("a", 6_000, 5), ("b", 3_000, 700), ("c", 30, 20), ("d", 900, 1)):
        for i in range(n):
            rows += [(group, positions(rnd, kind, n), f"r{i}", wanted)] * rnd.choice([1, 1, 3])
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, seq bigint, reservation_id string, wanted int").repartition(5)
    got = Counter(tuple(r) for r in cut.first_rows(frame, ["g"], "wanted").collect())
    given = Counter(rows)
    for group in "abcd":
        own = sorted({r for r in rows if r[0] == group})
        first = own[: own[0][3]]
        assert all(got[r] == given[r] for r in first)
        assert sum(got[r] > 0 for r in own) <= max(3 * cut.SLACK * own[0][3], 40)
    assert all(given[r] == n for r, n in got.items())


def test_candidates_are_cut_without_ranking_requests(spark):
    from turnstile.operators.allocate import candidates, contested, place
    from turnstile.operators.fold import new_states
    from turnstile.operators.strategies import STRATEGIES

    states = new_states(areas_df(spark, [area(2, 5)]))
    requests = requests_df(spark, [request(1, "RANDOM", 1)]).union(
        spark.range(2, 20_000).select(
            F.col("id").alias("seq"), F.lit(None).cast("timestamp"), F.concat(F.lit("r"), "id"), F.lit("u"),
            F.lit("event"), F.lit("A"), (1 + F.col("id") % 3).cast("int"), F.lit(0), F.lit("RANDOM"),
            F.array().cast("array<struct<row:int,col:int>>"), F.lit("event#A"),
        )
    )
    pool = candidates(contested(place(requests, states), STRATEGIES), STRATEGIES)
    assert "rank" not in pool._jdf.queryExecution().optimizedPlan().toString()
    assert 10 + 4 + 2 <= pool.count() <= 4 * (10 + 4 + 2)


def fold_input(monkeypatch, into):
    """Counts the requests that reach the fold."""
    from turnstile.operators import allocate as module

    fold = module.fold
    monkeypatch.setattr(module, "fold", lambda states, pool, registry: into.append(pool.count()) or fold(states, pool, registry))


def test_handpicked_seats_are_settled_before_the_fold(spark, monkeypatch):
    """Crowded areas, one of them created again, and one with runs as well, which is left to the fold."""
    seen, rnd, log = [], random.Random(11), []
    fold_input(monkeypatch, seen)
    for s in range(1, 2_400):
        seats = [(rnd.randrange(4), rnd.randrange(5)) for _ in range(rnd.randint(1, 4))]
        name = rnd.choice("AAAAAABC")
        log.append(request(s, "SELF_PICK", 0, seats, rid=f"r{rnd.random()}", area=name))
    log.append(request(9, "RANDOM", 2, rid="run", area="B"))
    areas = [area(4, 5), area(4, 5, name="B"), area(4, 5, name="C"), area(4, 5, seq=1200)]
    results, finals = run(spark, areas, log + log[:50])
    expected, final = naive(areas, log)
    assert results == expected
    assert finals == final
    assert seen[0] < 900


def test_a_promise_of_monotony_bounds_the_fold(spark, monkeypatch):
    def last_seats(grid, rows, cols, count, seats):
        free = [i for i, c in enumerate(grid) if c == ord("1")]
        return [divmod(i, cols + 1) for i in free[-count:]] if 0 < count <= len(free) else None

    promise = {
        "rivals": lambda: F.col("num_of_seats").cast("string"),
        "winners": lambda: F.when(F.col("num_of_seats") > 0, F.floor(F.col("row_count") * F.col("col_count") / F.col("num_of_seats"))).otherwise(0),
    }
    refusal = lambda: refused("NOT_AVAILABLE", "none left")
    log = [request(s, "LAST", 1 + s % 3, rid=f"r{s}") for s in range(1, 3_000)]
    outcomes, seen = [], []
    fold_input(monkeypatch, seen)
    for extra in ({}, promise):
        registry = register_strategy("LAST", last_seats, lambda: F.lit(True), refusal, **extra)
        allocation = allocate(requests_df(spark, log), areas_df(spark, [area(3, 4)]), registry=registry)
        outcomes.append(results_by_id(allocation.results()))
    assert outcomes[0] == outcomes[1] and sum(r[0] == "SUCCESS" for r in outcomes[0].values()) == 6
    assert seen[0] == len(log) and seen[1] <= 2 * cut.SLACK * (12 + 6 + 4)
    with pytest.raises(ValueError):
        register_strategy("LAST", last_seats, lambda: F.lit(True), refusal, rivals=promise["rivals"])


def test_third_strategy(spark):
    def corner(grid, rows, cols, count, seats):
        return [(rows - 1, cols - 1)] if grid and grid[-1] == ord("1") else None

    registry = register_strategy("CORNER", corner, lambda: None, lambda: refused("NOT_AVAILABLE", "corner is gone"))
    log = [request(1, "CORNER"), request(2, "CORNER"), request(3, "RANDOM", 2)]
    allocation = allocate(requests_df(spark, log), areas_df(spark, [area(2, 2)]), registry=registry)
    results = results_by_id(allocation.results())
    assert results["r1"] == ("SUCCESS", [(1, 1)], None, None)
    assert results["r2"] == ("FAILED", None, "NOT_AVAILABLE", "corner is gone")
    assert results["r3"] == ("SUCCESS", [(0, 0), (0, 1)], None, None)


def test_request_delivered_twice_wins_once(spark):
    log = [request(1, "RANDOM", 2), request(1, "RANDOM", 2), request(2, "SELF_PICK", 0, [(0, 2)])]
    log += [request(2, "SELF_PICK", 0, [(0, 2)]), request(3, "RANDOM", 1)]
    allocation = allocate(requests_df(spark, log), areas_df(spark, [area(1, 4)]))
    assert allocation.results().count() == 5
    expected, finals = naive([area(1, 4)], [log[0], log[2], log[4]])
    assert results_by_id(allocation.results()) == expected
    assert finals_by_area(allocation.final_areas()) == finals
    assert allocation.changelog().count() == 4


def test_answers_do_not_shuffle_requests_by_area(spark):
    """No exchange on (area, epoch) but those of the fold and of the area tables."""
    log = [request(s, "SELF_PICK", 0, [(0, s % 4)]) for s in range(1, 30)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        results = allocate(requests_df(spark, log), areas_df(spark, [area(1, 4)])).results()
        results.collect()
        plan = results._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    import re

    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not [k for k in keys if re.fullmatch(r"event_area_id#\d+, epoch#\d+L?, \d+", k)]


def test_creation_delivered_twice_counts_once(spark):
    log = [request(1, "RANDOM", 1), request(2, "SELF_PICK", 0, [(0, 0)]), request(3, "SELF_PICK", 0, [(0, 1)])]
    allocation = allocate(requests_df(spark, log), areas_df(spark, [area(1, 2), area(1, 2)]))
    assert allocation.results().count() == 3
    assert results_by_id(allocation.results()) == naive([area(1, 2)], log)[0]
    assert allocation.changelog().count() == 3


def test_grids_are_drawn_from_deltas_at_any_position(spark):
    """The state after each request, for segments of any length, against a naive walk up to there."""
    areas, log = random_log(5, n=200, versions=2)
    requests = requests_df(spark, log)
    allocation = allocate(requests, areas_df(spark, areas))
    asked = requests.select("event_area_id", "seq", "reservation_id")
    found = at_positions(asked, allocation.states).where("epoch is not null")
    columns = ["event_area_id", "reservation_id", "available_seats", "grid"]
    expected = []
    for seq, rid, key in ((r[0], r[2], r[-1]) for r in log):
        _, final = naive([a for a in areas if a[0] <= seq], [r for r in log if (r[0], r[2]) <= (seq, rid)])
        if key in final:
            left, free = final[key]
            expected.append((key, rid, left, "|".join("".join("1" if f else "0" for f in row) for row in free)))
    for every in (1, 7, 10_000):
        rows = with_grids(found, allocation.states, every).select(*columns).collect()
        assert sorted(map(tuple, rows)) == sorted(expected)


def test_changes_carry_no_grid_and_images_stay_few(spark):
    """The rows of changes hold cells in proportion to seats; images are one per segment."""
    log = [request(s, "RANDOM", 1) for s in range(1, 1000)]
    allocation = allocate(requests_df(spark, log), areas_df(spark, [area(20, 20)]))
    changes = allocation.changes()
    assert "grid" not in changes.columns and "taken" not in changes.columns
    cells = [c for r in changes.collect() for c in r["cells"]]
    assert sorted(cells) == list(range(400))
    assert segments(allocation.states).count() == 400 // EVERY + 1
    last = allocation.changelog().orderBy(F.desc("seq")).first()
    assert last["available_seats"] == 0 and "1" not in last["grid"]


def test_partly_taken_start_is_the_first_delta(spark):
    start = state_df(spark, "10|11").withColumn("seq", F.lit(0))
    allocation = allocate(requests_df(spark, [request(1, "RANDOM", 2)]), start)
    rows = {r["number"]: (r["cells"], r["available_seats"]) for r in allocation.changes().collect()}
    assert rows == {0: ([1], 3), 1: ([2, 3], 1)}
    assert {r["seq"]: r["grid"] for r in allocation.changelog().collect()} == {0: "10|11", 1: "10|00"}
