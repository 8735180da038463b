"""Small frames on the one-minute grid."""
from anchorline.spec import MINUTE

T0 = 1_704_067_200_000_000
SCHEMA = "participant_id string, row_order long, us long, sensor_a double, activity double, anchor_label string, dose double"


def minute_rows(n=900, meals=(400,), value=lambda i: 100 + 0.05 * i, pid="p1", activity=1.5, dose=50.0, holes=()):
    holes = set(holes)
    return [(pid, i, T0 + i * MINUTE, None if i in holes else float(value(i)), activity, "Lunch" if i in meals else None, dose if i in meals else None) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def cohort_rows(n_people=12, n_events=10, seed=3, gap_hours=6):
    import numpy as np
    rng = np.random.default_rng(seed)
    out = []
    for p in range(n_people):
        beta, gamma = 1.0 + 0.3 * rng.normal(), -0.2 + 0.05 * rng.normal()
        for e in range(n_events):
            c, a, b = float(rng.uniform(20, 90)), float(rng.uniform(1, 3)), float(rng.uniform(90, 130))
            y = float((beta + gamma * a) * c + rng.normal() * 8)
            out.append((f"p{p:02d}", f"p{p:02d}-m{e:03d}", T0 + e * gap_hours * 60 * MINUTE, c, a, b, y, int(b + y >= 180 - 1e-6), "ABC"[p % 3]))
    return out


COHORT = "participant_id string, event_id string, us long, carbs_g double, activity_level double, baseline_glucose double, peak_glucose_rise double, label_exceeds_180 int, grp string"
