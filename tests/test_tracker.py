"""The tracker against an implementation in plain loops, one matrix at a time, and what is made of its tracks."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.functions.geometry import iou_of, least_overlap
from waymesh.operators import fleet, tracking as T
from waymesh.plans import tracks as plans

SF = "/root/testdata/sf0.001"


class Plain:
    """One track a dictionary; constant acceleration."""

    def __init__(self, number, cleanup, compat):
        self.number, self.cleanup, self.compat, self.born, self.live = number, cleanup, compat, 0, []

    @staticmethod
    def moved(k, dt):
        f = np.eye(6)
        for a in (0, 1):
            f[a, a + 2] = f[a + 2, a + 4] = dt
            f[a, a + 4] = dt * dt
        return f @ k["x"], f @ k["p"] @ f.T + T.process_noise(1)

    def gate(self, k, t):
        x, p = self.moved(k, t - k["updated"])
        big, small = sorted(np.linalg.eigvalsh(p[:2, :2]), reverse=True)
        return [x[0], x[1], k["box"][0] + 3 * math.sqrt(max(big, 0)), k["box"][1] + 3 * math.sqrt(max(small, 0)), k["box"][2]]

    def batch(self, t, dets):
        near = []
        for i, k in enumerate(self.live if dets else []):
            gate = self.gate(k, t)
            for j, d in enumerate(dets):
                if math.hypot(gate[0] - d[0], gate[1] - d[1]) > math.hypot(*gate[2:4]) + math.hypot(*d[2:4]):
                    continue
                iou = iou_of(np.array([gate]), np.array([d[:5]]))[0]
                if iou > 0.5:
                    near.append((1 - iou, i, j))
        owner, known = {}, set()
        pairs = []
        if self.compat:
            for i in range(len(self.live)):
                has = False
                for d, _, j in sorted((d, i, j) for d, k, j in near if k == i):
                    if has:
                        owner.setdefault(j, (None, 1.0))
                    elif j not in owner:
                        owner[j], has = (len(pairs), d), True
                        pairs.append((i, j))
                    elif owner[j][1] > d:
                        if owner[j][0] is not None:
                            pairs[owner[j][0]] = None
                        pairs.append((i, j))
                        owner[j], has = (None, 1.0), True
            known = set(owner)
        else:
            used = set()
            for _, i, j in sorted(near):
                if i not in used and j not in known:
                    used.add(i)
                    known.add(j)
                    pairs.append((i, j))
            known |= {j for _, _, j in near}
        for i, j in filter(None, pairs):
            self.live[i]["z"].append(dets[j])
            self.live[i]["seen"] = t
        for j, d in enumerate(dets):
            if j not in known:
                k = {"id": T.IDS * self.number + self.born, "box": d[2:5], "x": np.zeros(6), "p": np.zeros((6, 6)), "steps": 0, "seen": t, "updated": t, "z": [d]}
                k["p"][0, 0] = k["p"][1, 1] = 1
                if not self.compat:
                    k["x"][:2], k["p"][:2, :2] = d[:2], [[d[5], d[6]], [d[6], d[7]]]
                self.live.append(k)
                self.born += 1
        self.live = [k for k in self.live if k["seen"] > t - self.cleanup]

    def fuse(self, t):
        out = []
        for k in self.live:
            measured = [(np.array(d[:2]), np.array([[d[5], d[6]], [d[6], d[7]]]), d[8]) for d in k["z"]]
            if k["steps"] == 0:
                k["x"] = np.zeros(6)
                if len(measured) == 1:
                    place, cov = measured[0][:2]
                elif self.compat:
                    cov = sum(c for _, c, _ in measured)
                    place = cov @ sum(c @ z for z, c, _ in measured)
                else:
                    cov = np.linalg.inv(sum(np.linalg.inv(c) for _, c, _ in measured))
                    place = cov @ sum(np.linalg.inv(c) @ z for z, c, _ in measured)
                k["x"][:2], k["p"][:2, :2] = place, cov
            else:
                k["x"], k["p"] = self.moved(k, 0.1)
                for z, c, trust in measured:
                    if trust < 1.2:
                        gain = k["p"][:, :2] @ np.linalg.inv(k["p"][:2, :2] + c * trust)
                        k["x"] = k["x"] + gain @ (z - k["x"][:2])
                        k["p"] = k["p"] - gain @ k["p"][:2]
            k["steps"] += 1
            k["updated"], n, k["z"] = t, len(k["z"]), []
            if k["steps"] > 4:
                out.append((k["id"], n, k["steps"], *k["x"][:4], k["p"][0, 0], k["p"][0, 1], k["p"][2, 2]))
        return out


@pytest.fixture(scope="module")
def detections(spark):
    rows = plans.global_detections(spark, SF).where("run_id = 0 AND frame < 9 AND (batch_ord IS NULL OR batch_ord IN (0, 2, 5) AND det_ord < 12)").withColumn("trust", F.when(F.col("det_ord") % 5 == 0, 1.3).when(F.col("det_ord") % 7 == 0, 1.1).otherwise(1.0))
    return rows.cache()


@pytest.mark.parametrize("compat", [True, False])
def test_tracks_equal_plain_loops(detections, compat):
    frames = defaultdict(lambda: defaultdict(list))
    times = {}
    for r in detections.orderBy("frame", "batch_ord", "det_ord").collect():
        times[r.frame] = r.t
        if r.cx is not None:
            frames[r.frame][r.batch_ord].append([r.cx, r.cy, r.width, r.length, r.angle, r.c00, r.c01, r.c11, r.trust])
    plain, want = Plain(plans.EVERYWHERE, 0.5, compat), {}
    for f in sorted(times):
        for b in sorted(frames[f]) or [None]:
            plain.batch(times[f], frames[f][b] if b is not None else [])
        want |= {(f, row[0]): row[1:] for row in plain.fuse(times[f])}
    got = {(r.frame, r.track_id): (r.n_meas, r.steps, r.x, r.y, r.dx, r.dy, r.c00, r.c01, r.d00) for r in T.tracks(detections, 0.5, compat).collect()}
    assert set(got) == set(want) and len(got) > 20
    for k, row in want.items():
        assert got[k][:2] == row[:2] and np.allclose(got[k][2:], row[2:], rtol=1e-5, atol=1e-6), (k, got[k], row)


def test_batches_do_not_matter(spark, detections):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = sorted(map(tuple, T.tracks(detections, 0.5).collect()))
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert sorted(map(tuple, T.tracks(detections, 0.5).collect())) == want and want
    finally:
        spark.conf.set(key, before)
    other = T.tracks(detections, 0.5, distance="gated_euclidean").count()
    assert other > 0
    with pytest.raises(ValueError):
        T.Tracker(1, distance="other")._distances(np.ones((1, 5)), np.ones((1, 5)))


def test_members_and_consistency(detections):
    rows = detections.withColumns({"sensor_id": F.concat(F.lit("s"), F.col("batch_ord").cast("string")), "confidence": F.lit(0.5)})
    found, joined = T.with_members(detections, 0.5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, T.tracks(detections, 0.5).collect()))
    count = {(r.frame, r.track_id): r.n_meas for r in found.collect() if r.n_meas}
    of = defaultdict(list)
    for r in joined.collect():
        of[r.frame, r.track_id].append((r.batch_ord, r.det_ord))
    assert {k: len(v) for k, v in of.items()} == count
    fused = {(r.frame, r.track_id): r for r in found.collect()}
    measured = {(r.frame, r.batch_ord, r.det_ord): r for r in rows.where("cx IS NOT NULL").collect()}
    got = {(r.frame, r.track_id): r for r in T.consistency(found, joined, rows).collect()}
    assert set(got) == set(of)
    for k, pairs in of.items():
        t = fused[k]
        axes = np.linalg.eigvalsh([[t.c00, t.c01], [t.c01, t.c11]])
        own = math.sqrt(max(axes[0], 0) + max(axes[1], 0)) if t.c00 != 0 and t.c01 != 0 else 0.0
        want = []
        for b, d in pairs:
            m = measured[k[0], b, d]
            values, vectors = np.linalg.eigh([[m.c00, m.c01], [m.c01, m.c11]])
            (small, big), phi = np.sqrt(np.maximum(values, 0)), math.atan2(vectors[1, 1], vectors[0, 1])
            reach = [big * small / math.sqrt((big * math.sin(phi - a)) ** 2 + (small * math.cos(phi - a)) ** 2 + 1e-10) for a in (0, math.pi / 2)]
            want.append((f"s{b}", b, d, math.hypot(m.cx - t.x, m.cy - t.y) / (math.hypot(*reach) - own)))
        want.sort()
        assert [s.sensor_id for s in got[k].sensors] == [w[0] for w in want] and [(s.sensor_id, s.confidence) for s in got[k].trust] == [(w[0], 0.5) for w in want]
        assert np.allclose([s.score for s in got[k].sensors], [w[3] for w in want], rtol=1e-4)


def test_twins_equal_brute_force(detections):
    rows = T.tracks(detections, 0.5).collect()
    want = set()
    by_frame = defaultdict(list)
    for r in rows:
        by_frame[r.frame].append(r)
    for a in rows:
        for b in by_frame[a.frame]:
            if a.track_id < b.track_id and math.hypot(a.x - b.x, a.y - b.y) < 10:
                d = 1 - round(float(iou_of(np.array([[a.x, a.y, a.width, a.length, a.angle]]), np.array([[b.x, b.y, b.width, b.length, b.angle]]))[0]), 9)
                if 0.001 < d <= 0.25:
                    first = (a.last_seen, a.steps) >= (b.last_seen, b.steps)
                    if (a if first else b).steps >= 4:
                        want.add((a.frame, a.track_id, b.track_id, b.track_id if first else a.track_id))
    got = {(r.frame, r.a_id, r.b_id, r.loser) for r in T.twins(T.tracks(detections, 0.5)).collect()}
    assert got == want


def test_tracks_are_written(spark, detections, tmp_path):
    from waymesh.sources import telemetry

    telemetry.write_tracks(T.tracks(detections, 0.5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == T.tracks(detections, 0.5).count() and (tmp_path / "t" / "run_id=0").is_dir()


def arc(rng, n=200):
    """Places of an object that turns at a changing rate, as measured."""
    x, y, v, phi = 30.0, -20.0, 9.0, 0.4
    out = []
    for k in range(n):
        phi += 0.1 * 0.3 * math.sin(k / 40)
        x, y = x + 0.1 * v * math.cos(phi), y + 0.1 * v * math.sin(phi)
        out.append([x + rng.normal(0, 0.2), y + rng.normal(0, 0.2), 1.8, 4.5, 0.3, 0.05 + 0.01 * (k % 3), 0.01, 0.06])
    return out


def plain_online_step(x, p):
    """The online filter's motion and covariance a tenth of a second later, element by element."""
    v, phi, w, dt = x[2], x[3], x[4], 0.1
    after = phi + dt * w
    vx = vy = px = py = wx = wy = 999.9
    if phi != 0:
        vx, vy = (math.sin(after) - math.sin(phi)) / w, (math.cos(phi) - math.cos(after)) / w
        px, py = v / w * (math.cos(after) - math.cos(phi)), v / w * (math.sin(after) - math.sin(phi))
    if w != 0:
        wx = v * dt / w * math.cos(after) - v / w**2 * (math.sin(after) - math.sin(phi))
        wy = v * dt / w * math.sin(after) - v / w**2 * (math.cos(phi) - math.cos(after))
    f = np.array([[1, 0, vx, px, wx], [0, 1, vy, py, wy], [0, 0, 1, 0, 0], [0, 0, 0, 1, dt], [0, 0, 0, 0, 1]])
    a, b, c = 0.9 * 0.7**4 / 4, 0.9 * 0.7**3 / 2, 0.9 * 0.7**2
    q = np.array([[a, 0, b, 0, 0], [0, a, 0, b, 0], [b, b, c, 0, 0], [0, 0, 0, c, 0], [0, 0, 0, 0, c]])
    return f @ x, f @ p @ f.T + q


def plain_step(x, p):
    """The extended filter: along an arc, with a derivative taken by differences."""

    def go(s):
        v, phi, w = s[2:]
        if abs(w) < 1e-9:
            return np.array([s[0] + v * 0.1 * math.cos(phi), s[1] + v * 0.1 * math.sin(phi), v, phi + 0.1 * w, w])
        return np.array([s[0] + v / w * (math.sin(phi + 0.1 * w) - math.sin(phi)), s[1] + v / w * (math.cos(phi) - math.cos(phi + 0.1 * w)), v, phi + 0.1 * w, w])

    f = np.column_stack([(go(x + e) - go(x - e)) / 2e-5 for e in np.eye(5) * 1e-5])
    return go(x), f @ p @ f.T + np.diag([0.9 * 0.7**4 / 4] * 2 + [0.9 * 0.7**2] * 2 + [0.9 * 0.7])


@pytest.mark.parametrize("compat", [True, False])
def test_turning_tracks_equal_plain_loops(compat):
    rng = np.random.default_rng(2)
    tracker, measured = T.Tracker(3, 1e9, compat, 2), [np.array(m) for m in arc(rng)]
    tracker.observe(0.0, measured[0][None])
    x = p = None
    errors, scale = [], 1.0
    for k, z in enumerate(measured):
        tracker.waiting = [[z]] if k % 7 != 3 else [[]]  # now and then unseen
        row = tracker.fuse(k / 10)
        if k == 0:
            x, p = np.zeros(5), np.zeros((5, 5))
            x[:2], p[:2, :2] = z[:2], [[z[5], z[6]], [z[6], z[7]]]
        else:
            x, p = (plain_online_step if compat else plain_step)(x, p)
            scale = max(1.0, np.abs(p).max())  # what the update takes from
            if k % 7 != 3:
                gain = p[:, :2] @ np.linalg.pinv(p[:2, :2] + np.array([[z[5], z[6]], [z[6], z[7]]]))
                x, p = x + gain @ (z[:2] - x[:2]), p - gain @ p[:2]
        assert np.allclose(tracker.x[0], x, rtol=1e-4, atol=1e-4) and np.allclose(tracker.p[0], p, rtol=1e-3, atol=1e-8 * scale), k
        tracker.x[0], tracker.p[0] = x, p  # each step alone: the online filter makes much of small differences
        if row:
            assert np.allclose(row[0][6:8], (x[2] * math.cos(x[3]), x[2] * math.sin(x[3])), rtol=1e-3, atol=1e-3)
            errors.append(math.hypot(*(x[:2] - z[:2])))
    assert compat or np.median(errors[20:]) < 0.4


def test_turning_gates_are_predicted():
    tracker = T.Tracker(1, 1.0, False, 2)
    tracker.observe(0.0, np.array([[0.0, 0, 2, 4, 0, 0.1, 0, 0.1]]))
    tracker.fuse(0.0)
    tracker.x[0] = [5, 5, 10, math.pi / 2, 0.5]
    tracker.gates = None
    gate = tracker._gates(0.1)[0]
    assert gate[:2] == pytest.approx([5 + 20 * (math.sin(math.pi / 2 + 0.05) - 1), 5 + 20 * (0 - math.cos(math.pi / 2 + 0.05))])
    assert T.Tracker(1, 1.0, True, 2).compat


def test_written_runs_replace_only_themselves(spark, detections, tmp_path):
    from waymesh.sources import telemetry

    rows = T.tracks(detections, 0.5)
    telemetry.write_tracks(rows.withColumn("run_id", F.lit(7)), str(tmp_path / "t"))
    telemetry.write_tracks(rows, str(tmp_path / "t"))
    telemetry.write_tracks(rows, str(tmp_path / "t"))
    n = rows.count()
    assert {(r.run_id, r["count"]) for r in spark.read.parquet(str(tmp_path / "t")).groupBy("run_id").count().collect()} == {(0, n), (7, n)}


def test_metrics_of_fused_tracks(spark):
    """Counts and scores of all platforms' tracks against what all can see, in plain loops."""
    from waymesh.plans import perception, views

    found = {(r.run_id, r.frame, r.ego_id): r for r in plans.global_track_metrics(spark, SF).collect()}
    tracks = T.tracks(plans.global_detections(spark, SF), cleanup=0.5).collect()
    truths = perception._truth_of(views.sightings(spark, SF), ["run_id", "frame"]).collect()
    by_frame = defaultdict(lambda: ([], []))
    for side, rows in enumerate((truths, tracks)):
        for r in rows:
            by_frame[r.run_id, r.frame][side].append(r)
    box = lambda x, y, r: np.array([[x, y, r.width, r.length, 0.0]])
    for (run, frame), (seen, fused) in by_frame.items():
        taken, hits = set(), 0
        for t in sorted(fused, key=lambda r: r.track_id % T.IDS):
            for o in sorted(seen, key=lambda r: r.slot):
                if o.slot not in taken and round(float(iou_of(box(t.x, t.y, t), box(o.cx, o.cy, o))[0]), 9) > 0.5:
                    taken.add(o.slot)
                    hits += 1
                    break
        f1 = 2 * hits / (len(fused) + len(seen)) if hits else 0.0
        if seen:
            assert found[run, frame, None].f1 == pytest.approx(f1, abs=1e-6)
    for e in perception._egos(spark, SF).where("frame % 9 = 6").collect():
        n, c, s = 0, math.cos(e.yaw), math.sin(e.yaw)
        for t in by_frame[e.run_id, e.frame][1]:
            dx, dy, dvx, dvy = t.x - e.x, t.y - e.y, t.dx - e.evx, t.dy - e.evy
            brake = 4.6 * 0.25 / 2
            n += dx * c + dy * s < math.hypot(e.evx, e.evy) * 0.5 + brake + 0.5 * (dvx * c + dvy * s) or -dx * s + dy * c < brake + 0.5 * (-dvx * s + dvy * c)
        assert found[e.run_id, e.frame, e.ego_id].envelope_seen == n


@pytest.mark.parametrize("compat, mode, distance", [(True, 1, "iou"), (False, 1, "iou"), (True, 2, "iou"), (False, 0, "gated_euclidean")])
def test_trackers_in_step_equal_one_after_the_other(spark, monkeypatch, compat, mode, distance):
    rows = plans.platform_detections(spark, SF).where("run_id = 0 AND (frame < 20 OR tracker_id <> 1000 AND frame < 26)").cache()
    tables = [g.sort_values(T.ORDER) for _, g in rows.toPandas().groupby(["run_id", "tracker_id"])]
    columns = [c.split()[0] for c in T.TRACKS.split(", ")][2:]
    want = sorted((0, int(g["tracker_id"].iloc[0]), *r) for g in tables for r in T.Tracker(int(g["tracker_id"].iloc[0]), 0.3, compat, mode, distance).run(g))
    assert len(tables) > 4 and want and len(columns) + 2 == len(want[0])
    for held in (fleet.HELD, 300):  # all side by side, and a tracker taken up where it was left
        monkeypatch.setattr(fleet, "HELD", held)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        try:
            got = sorted(map(tuple, T.tracks(rows, 0.3, compat, mode, distance).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose(np.array(got, float), np.array(want, float), rtol=1e-6, equal_nan=True)


def test_pairs_that_are_left_out_have_little_in_common():
    draw = np.random.default_rng(3)
    a, b = (np.column_stack((draw.normal(0, 1, (4000, 2)), draw.uniform(1, 5, (4000, 2)), draw.uniform(0, 7, 4000))) for _ in "ab")
    can = least_overlap(a, b, 0.5)
    assert (iou_of(a[~can], b[~can]) <= 0.5).all() and (iou_of(a[can], b[can]) > 0.5).any() and (~can).sum() > 1000


def test_twins_run_their_trackers_once(detections):
    sides = T.twins(T.tracks(detections, 0.5))
    assert "MapInArrow" not in sides._jdf.queryExecution().optimizedPlan().toString()
