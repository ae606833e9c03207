"""Boxes without overlaps against the rule box by box."""

import time

import numpy as np
import pytest

from pagewright.operators import matching


def plain_kept(rows, most=0.85):
    kept = []
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    for i, b in enumerate(rows):
        for j in kept:
            k = rows[j]
            wide, high = min(b[2], k[2]) - max(b[0], k[0]), min(b[3], k[3]) - max(b[1], k[1])
            common, least = (wide * high if wide > 0 and high > 0 else 0), min(area(b), area(k))
            if least > 0 and common / least >= most:
                break
        else:
            kept.append(i)
    return kept


def some_boxes(r, n, span=0.3):
    x, y = r.random(n) * 0.7, r.random(n) * 0.7
    w, h = r.random(n) * r.choice([0.01, 0.1, span], n), r.random(n) * r.choice([0.0, 0.1, span], n)
    return np.round(np.stack([x, y, x + w, y + h]), 2)


@pytest.mark.parametrize("n", [1, 2, 40, 300])
def test_swept_and_together_equal_the_rule(n):
    r = np.random.default_rng(n)
    for _ in range(10):
        boxes = some_boxes(r, n)
        want = plain_kept(boxes.T.tolist())
        assert np.flatnonzero(matching.kept_swept(boxes, 0.85)).tolist() == want
        padded = np.concatenate([boxes, np.zeros((4, 5))], axis=1)[:, None, :]
        assert np.flatnonzero(matching.kept_together(padded, np.array([n]), 0.85)[0]).tolist() == want


def test_pages_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(matching, "CROWDED", 20)
    r = np.random.default_rng(2)
    rows, want = [], {}
    for page in range(30):
        n = int(r.integers(1, 60))
        boxes, confidence = some_boxes(r, n), np.round(r.random(n), 1)
        order = sorted(range(n), key=lambda i: (-(confidence[i] if i % 5 else 0.0), -((boxes[2, i] - boxes[0, i]) * (boxes[3, i] - boxes[1, i])), i))
        want[page] = {order[k] for k in plain_kept(boxes[:, order].T.tolist())}
        rows += [(page, i, "text", float(confidence[i]) if i % 5 else None, *map(float, boxes[:, i])) for i in range(n)]
    found = spark.createDataFrame(rows, "page_id long, pred_id long, cls string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for x in matching.without_overlaps(found, ["page_id"]).collect():
        got.setdefault(x.page_id, set()).add(x.pred_id)
    assert got == want
    assert matching.without_overlaps(found.limit(0), ["page_id"]).collect() == []


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_twenty_thousand_boxes_on_a_page(spread):
    """All in one place, half spread out, and all over the page, a few of them as wide as it."""
    r = np.random.default_rng(3)
    x, y = r.random((2, 20_000)) * spread
    w = np.where(r.random(20_000) < 0.001, 0.9, 0.01)
    boxes = np.stack([x, y, x + w, y + 0.01])
    began = time.time()
    alive = matching.kept_swept(boxes, 0.85)
    assert time.time() - began < 20 and alive[0] and (spread or alive.sum() <= 30)
