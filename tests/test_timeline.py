import random

import pytest
from pyspark.sql import functions as F

from poolframe.operators import timeline


def frame(spark, rows):
    return spark.createDataFrame(rows, "uniq_id long, jobid long, st long, last long, planned long")


def totals(spark, *rows):
    return spark.createDataFrame(rows, "uniq_id long, total long")


def first(spark, spans, total, after, duration, wanted, end=None):
    points = timeline.timeline(frame(spark, spans), totals(spark, (1, total)))
    rows = timeline.first_fit(points, duration, F.lit(wanted), after, end).collect()
    return rows[0].tm if rows else -1


def test_fits_of_a_short_plan(spark):
    spans = []
    for after, duration, want in ((0, 5, 0), (0, 2, 5), (0, 2, 7), (0, 2, -1), (0, 1, 9)):
        assert first(spark, spans, 1, after, duration, 1, 10) == want
        if want >= 0:
            spans.append((1, len(spans), want, want + duration, 1))
    spans = [s for s in spans if s[2] not in (5, 7)]
    assert first(spark, spans, 1, 0, 5, 1, 10) == -1
    assert first(spark, spans, 1, 0, 4, 1, 10) == 5


def test_points_only_are_candidates(spark):
    assert first(spark, [], 3, 100_000, 100, 2) == -1
    spans = [(1, 1, 100_000, 100_100, 2), (1, 2, 100_100, 100_300, 2)]
    assert first(spark, spans[:1], 3, 100_000, 200, 2) == 100_100
    points = timeline.timeline(frame(spark, spans), totals(spark, (1, 3)))
    got = timeline.next_fits(points, 200, F.lit(1), 5, 100_000).orderBy("place").collect()
    assert [r.tm for r in got] == [100_000, 100_100, 100_300]
    assert [r.tm for r in timeline.next_fits(points, 200, F.lit(1), 2).orderBy("place").collect()] == [0, 100_000]


def test_equals_a_step_function(spark):
    rng = random.Random(7)
    spans = [(p, j, s := rng.randrange(60), s + rng.randint(1, 20), rng.randint(0, 4)) for p in (1, 2, 3) for j in range(25)]
    points = timeline.timeline(frame(spark, spans), totals(spark, (1, 40), (2, 50), (3, 60), (4, 5)))
    left = lambda p, t: {1: 40, 2: 50, 3: 60, 4: 5}[p] - sum(n for q, _, s, e, n in spans if q == p and s <= t < e)
    asked = spark.createDataFrame([(p, t, d) for p in (1, 2, 3, 4) for t, d in ((0, 1), (5, 9), (17, 3), (59, 40), (200, 2))], "uniq_id long, tm long, duration long")
    for r in timeline.at(points, asked).collect():
        assert r.remaining == left(r.uniq_id, r.tm)
    for r in timeline.during(points, asked).collect():
        assert r.least == min(left(r.uniq_id, t) for t in range(r.tm, r.tm + r.duration))
    fits = {r.uniq_id: r.tm for r in timeline.first_fit(points, 6, F.col("total") - 20, 10).collect()}
    for p in (1, 2, 3):
        starts = sorted({0} | {t for q, _, s, e, _ in spans if q == p for t in (s, e)})
        want = [t for t in starts if t >= 10 and min(left(p, u) for u in range(t, t + 6)) >= {1: 40, 2: 50, 3: 60}[p] - 20]
        assert fits.get(p) == (want[0] if want else None)
    assert 4 not in fits


def test_changes_of_spans(spark):
    spans = frame(spark, [(1, 1, 0, 5, 3), (1, 2, 2, 4, 2)])
    less = spark.createDataFrame([(1, 3), (2, 5)], "jobid long, units long")
    assert [(r.jobid, r.planned) for r in timeline.reduce_spans(spans, less).collect()] == [(2, 2)]
    assert timeline.same(timeline.remove_spans(spans, less), spans.limit(0))
    points = timeline.timeline(spans, totals(spark, (1, 6)))
    added = timeline.add_spans(spans, points, frame(spark, [(1, 3, 0, 3, 1), (1, 4, 0, 3, 2)]))
    assert sorted(r.jobid for r in added.collect()) == [1, 2, 3]
    assert {r.tm: r.remaining for r in timeline.change_totals(points, F.lit(-4)).collect()} == {0: 0, 2: 0, 4: 0, 5: 2}
    assert timeline.timeline(spans.limit(0), totals(spark)).count() == 0


@pytest.mark.parametrize("wanted, want", [({"core": 2, "gpu": 1}, 6), ({"gpu": 1}, 3), ({"core": 9}, None)])
def test_all_types_at_once(spark, wanted, want):
    rows = [(1, 1, 0, 6, "core", 3), (1, 1, 0, 6, "gpu", 0), (1, 2, 0, 3, "core", 0), (1, 2, 0, 3, "gpu", 2)]
    spans = spark.createDataFrame(rows, "uniq_id long, jobid long, st long, last long, rtype string, planned long")
    by = ("uniq_id", "rtype")
    points = timeline.timeline(spans, spark.createDataFrame([(1, "core", 4), (1, "gpu", 2)], "uniq_id long, rtype string, total long"), by)
    got = timeline.fits_all(points, 2, wanted).agg(F.min("tm").alias("tm")).collect()[0].tm
    assert got == want


def sequential(spans, totals_of, new):
    """New spans (pool, job, st, last, {type: units}) in order, each with all its types or not at all."""
    held, taken = list(spans), []
    for pool, job, st, last, units in sorted(new, key=lambda x: (x[0], x[1], x[2], x[3])):
        fits = all(totals_of[pool, kind] - sum(u.get(kind, 0) for p, _, s, e, u in held if p == pool and s <= t < e) >= n for kind, n in units.items() for t in range(st, last))
        if fits:
            held.append((pool, job, st, last, units))
            taken.append((pool, job, st, last))
    return sorted(taken)


def test_new_spans_that_clash(spark):
    spans = frame(spark, [(1, 1, 0, 20, 1)])
    points = timeline.timeline(spans, totals(spark, (1, 4)))
    added = timeline.add_spans(spans, points, frame(spark, [(1, 2, 3, 9, 2), (1, 3, 5, 8, 2), (1, 4, 8, 9, 1), (1, 5, 9, 12, 3)]))
    assert sorted(r.jobid for r in added.collect()) == [1, 2, 4, 5]
    for seed in range(3):
        rng = random.Random(seed)
        old = [(p, j, s := rng.randrange(50), s + rng.randint(1, 15), rng.randint(0, 2)) for p in (1, 2, 3) for j in range(12)]
        new = [(p, 100 + j, s := rng.randrange(60), s + rng.randint(1, 12), rng.randint(1, 4)) for p in (1, 2, 3) for j in range(40)]
        most = {(p, "x"): 12 for p in (1, 2, 3)}
        base = frame(spark, old)
        got = timeline.add_spans(base, timeline.timeline(base, totals(spark, (1, 12), (2, 12), (3, 12))), frame(spark, new))
        want = sequential([(p, j, s, e, {"x": n}) for p, j, s, e, n in old], most, [(p, j, s, e, {"x": n}) for p, j, s, e, n in new])
        assert sorted((r.uniq_id, r.jobid, r.st, r["last"]) for r in got.where("jobid >= 100").collect()) == want and len(want) < 120


def test_new_spans_of_several_types(spark):
    rng = random.Random(5)
    schema, by = "uniq_id long, jobid long, st long, last long, rtype string, planned long", ("uniq_id", "rtype")
    old = [(p, j, s := rng.randrange(40), s + rng.randint(1, 15), {"core": rng.randint(0, 2), "gpu": rng.randint(0, 1)}) for p in (1, 2) for j in range(10)]
    new = [(p, 100 + j, s := rng.randrange(50), s + rng.randint(1, 9), {"core": rng.randint(1, 3), "gpu": rng.randint(0, 2)}) for p in (1, 2) for j in range(40)]
    rows = lambda x: spark.createDataFrame([(p, j, s, e, k, n) for p, j, s, e, u in x for k, n in u.items()], schema)
    most = {(p, k): n for p in (1, 2) for k, n in (("core", 9), ("gpu", 5))}
    base = rows(old)
    points = timeline.timeline(base, spark.createDataFrame([(p, k, n) for (p, k), n in most.items()], "uniq_id long, rtype string, total long"), by)
    got = timeline.add_spans(base, points, rows(new), by, kind=("rtype",)).where("jobid >= 100")
    want = sequential(old, most, new)
    assert sorted({(r.uniq_id, r.jobid, r.st, r["last"]) for r in got.collect()}) == want and 0 < len(want) < 80
    assert got.count() == 2 * len(want)


@pytest.mark.parametrize("runs", [2, 16])
def test_every_question_is_answered(spark, monkeypatch, runs):
    monkeypatch.setattr(timeline, "RUNS", runs)
    points = timeline.timeline(frame(spark, [(1, 1, 5, 9, 2)]), totals(spark, (1, 3)))
    asked = spark.createDataFrame([(1, 4, 3), (1, 4, 3), (9, 4, 3), (1, -5, 2), (1, -5, 50), (1, 9, 1000)], "uniq_id long, tm long, duration long")
    got = sorted(((r.uniq_id, r.tm, r.duration), r.least) for r in timeline.during(points, asked).collect())
    assert got == [((1, -5, 2), None), ((1, -5, 50), 1), ((1, 4, 3), 1), ((1, 4, 3), 1), ((1, 9, 1000), 3), ((9, 4, 3), None)]
    assert timeline.at(points, asked).count() == 6


def test_one_window_is_read_without_numbering(spark):
    rng = random.Random(11)
    spans = [(p, j, s := rng.randrange(60), s + rng.randint(1, 20), rng.randint(0, 4)) for p in (1, 2, 3) for j in range(25)]
    points = timeline.timeline(frame(spark, spans), totals(spark, (1, 40), (2, 50), (3, 60), (4, 5)), start=-3)
    for st, duration in ((-9, 2), (-9, 30), (0, 1), (17, 9), (59, 40), (300, 1)):
        asked = points.select("uniq_id", F.lit(st).cast("long").alias("tm"), F.lit(duration).cast("long").alias("duration")).distinct()
        want = {r.uniq_id: r.least for r in timeline.during(points, asked).collect()}
        got = points.groupBy("uniq_id").agg(timeline.least_over(st, duration).alias("least"))
        assert {r.uniq_id: r.least for r in got.collect()} == want
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        timeline.least_over(4, 0)


def test_kinds_side_by_side_equal_kinds_apart(spark):
    rng = random.Random(3)
    wide = [(p, j, s := rng.randrange(40), s + rng.randint(1, 9), rng.randint(0, 3), rng.randint(0, 1)) for p in (1, 2, 3) for j in range(20)]
    spans = spark.createDataFrame(wide, "uniq_id long, jobid long, st long, last long, core long, gpu long")
    apart = spark.createDataFrame([(p, j, s, e, k, n) for p, j, s, e, c, g in wide for k, n in (("core", c), ("gpu", g))], "uniq_id long, jobid long, st long, last long, rtype string, planned long")
    long = timeline.peak_timeline(apart, ("uniq_id", "rtype"))
    points = timeline.peak_timelines(spans, ["core", "gpu"])
    assert sorted((r.uniq_id, r.tm, k, r[k]) for r in points.collect() for k in ("core", "gpu")) == sorted((r.uniq_id, r.tm, r.rtype, r.remaining) for r in long.collect())
    want = sorted(tuple(r) for r in timeline.fits_all(long, 4, {"core": 3, "gpu": 1}, 5).collect())
    assert sorted(tuple(r) for r in timeline.fits_at_once(points, 4, {"core": 3, "gpu": 1}, 5).collect()) == want and want


def test_short_windows_meet_one_row(spark):
    rng = random.Random(2)
    spans = [(p, j, s := rng.randrange(-90, 900) * (1 if p < 3 else 1000), s + rng.randint(1, 50), rng.randint(0, 4)) for p in (1, 2, 3) for j in range(60)]
    points = timeline.timeline(frame(spark, spans), totals(spark, (1, 90), (2, 90), (3, 90), (4, 5)), start=-20)
    rows = [(rng.randint(1, 5), rng.randrange(-150, 1000) * rng.choice((1, 1000)), rng.randint(0, 40), n // 2) for n in range(400)]
    asked = spark.createDataFrame([*rows, rows[0], (1, None, 3, 7)], "uniq_id long, tm long, duration long, note long")
    key = lambda r: tuple(-(10**9) if v is None else v for v in r)
    want = sorted(map(key, timeline.during(points, asked).collect()))
    assert sorted(map(key, timeline.during(points, asked, longest=40).collect())) == want
    with pytest.raises(Exception, match="longer than 39"):
        timeline.during(points, asked.where("duration = 40"), longest=39).collect()


@pytest.mark.parametrize("bundle", [1, 3, 64])
def test_stretches_are_tried_in_bundles(spark, monkeypatch, bundle):
    monkeypatch.setattr(timeline, "BUNDLE", bundle)
    rng = random.Random(4)
    new = [(p, 100 + j, s := rng.randrange(400), s + rng.randint(1, 9), rng.randint(1, 4)) for p in (1, 2) for j in range(60)]
    base = frame(spark, [(1, 1, 5, 390, 1)])
    got = timeline.add_spans(base, timeline.timeline(base, totals(spark, (1, 5), (2, 5))), frame(spark, new), longest=9).where("jobid >= 100")
    want = sequential([(1, 1, 5, 390, {"x": 1})], {(1, "x"): 5, (2, "x"): 5}, [(p, j, s, e, {"x": n}) for p, j, s, e, n in new])
    assert sorted((r.uniq_id, r.jobid, r.st, r["last"]) for r in got.collect()) == want and len(want) < len(new)
