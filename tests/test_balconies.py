"""Balconies on striped regions, against going through regions and labels one by one."""

from __future__ import annotations

import random

from quoin.operators.balconies import on_stripes

REGION = "plan long, region int, x double, y double, w double, h double, lines int, spacing double, level boolean"
LABEL = "plan long, label int, x double, y double, name string, confidence double"


def plain(regions, labels, ppm, height):
    out, used, count = [], set(), {}
    for plan, region, x, y, w, h, lines, spacing, level in regions:
        if None in (x, y, w, h) or w <= 1 or h <= 1:
            continue
        run, onward = (w, h) if level else (h, w)
        if 4 <= lines <= 30 and 0.35 <= onward / run <= 2.8 and 0.045 <= spacing / run <= 0.35:
            continue
        for p, label, lx, ly, name, sure in labels:
            if p == plan and (p, label) not in used and lx is not None and x <= lx <= x + w and y <= ly <= y + h:
                used.add((p, label))
                box = [max(0.0, v) / ppm for v in (x, height - y - h, x + w, height - y)]
                if box[2] - box[0] >= 0.3 and box[3] - box[1] >= 0.3:
                    k = count[plan] = count.get(plan, -1) + 1
                    out.append((plan, f"balcony_{k:03d}", region, label, name, *box, min(sure, 0.78 + min(lines, 12) * 0.015)))
                break
    return out


def rounded(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def test_regions_take_the_first_label_left(spark):
    rng, regions, labels = random.Random(3), [], []
    for plan in range(10, 40):
        for k in range(8):
            regions.append((plan, k, rng.randrange(-20, 60) * 1.0, rng.randrange(-20, 100) * 1.0, rng.choice([1.0, 4.0, 40.0, 90.0, 120.0]), rng.choice([0.5, 5.0, 30.0, 60.0, 80.0]), rng.randrange(2, 35), rng.choice([1.0, 5.0, 40.0]), rng.random() < 0.5))
            labels.append((plan, k, rng.randrange(0, 60) * 1.0, rng.randrange(0, 60) * 1.0, f"Balcony {k}", rng.random()))
    # Three regions share two labels; a small one takes the first of them and becomes nothing.
    regions += [(9, 0, 10.0, 10.0, 5.0, 5.0, 2, 1.0, True), (9, 1, 0.0, 0.0, 50.0, 50.0, 2, 1.0, True), (9, 2, 0.0, 0.0, 50.0, 50.0, 2, 1.0, True), (9, 3, None, 0.0, 9.0, 9.0, 2, 1.0, True)]
    labels += [(9, 0, 10.0, 10.0, "a", 0.9), (9, 1, 50.0, 50.0, "b", 0.5), (9, 2, None, 4.0, "c", 0.5), (9, 3, 51.0, 9.0, "d", 0.5)]
    expected = plain(regions, labels, 30.0, 100.0)
    got = on_stripes(spark.createDataFrame(regions, REGION), spark.createDataFrame(labels, LABEL), 30.0, 100.0).collect()
    assert rounded(got) == rounded(expected) and len(expected) > 5
    assert [r[2:4] for r in rounded(got) if r[0] == 9] == [(1, 1)]


def test_empty_tables_give_none(spark):
    assert on_stripes(spark.createDataFrame([], REGION), spark.createDataFrame([], LABEL), 30.0, 100.0).count() == 0
