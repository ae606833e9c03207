"""Order of the pages table and drafts over stored boxes against plain versions."""

import functools
import random
import re
import unicodedata
from datetime import datetime

import pytest

from pagewright.operators import drafts, sorting


def base_letters(text):
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def compared(a, b):
    """Part by part: numbers as numbers, other parts by their base letters."""
    x, y = (re.findall(r"\d+|\D+", base_letters(t)) for t in (a, b))
    for p, q in zip(x, y):
        if p == q:
            continue
        if p.isdigit() and q.isdigit():
            if int(p) != int(q):
                return -1 if int(p) < int(q) else 1
        elif p != q:
            return -1 if p < q else 1
    return (len(x) > len(y)) - (len(x) < len(y))


@pytest.mark.parametrize("direction", ["asc", "desc", None, "sideways"])
@pytest.mark.parametrize("column", ["id", "rel_path", "status", "created_at", "size", None])
def test_pages_in_order(spark, column, direction):
    r = random.Random(5)
    words = ["page2", "page10", "Page1", "page01", "éclair", "eclair", "zebra", "Zoo", "a1b20", "a1b3", "a01b3"]
    dates = ["2024-01-02T00:00:00+00:00", "2023-05-01T12:00:00+00:00", "", None, "no date", "2024-01-01T23:00:00-05:00"]
    rows = [(i, r.choice(words), r.choice([" New ", "ocr_done", "OCR_DONE", None]), r.random() < 0.3, r.choice(dates)) for i in r.sample(range(1, 200), 60)]
    pages = spark.createDataFrame(rows, "page_id long, rel_path string, status string, is_missing boolean, created_at string")
    key = column if column in sorting.DIRECTIONS else "created_at"
    down = (direction if direction in ("asc", "desc") else sorting.DIRECTIONS[key]) == "desc"

    def stamp(x):
        try:
            return datetime.fromisoformat(x).timestamp()
        except (TypeError, ValueError):
            return float("-inf")

    def rank(x, y):
        if key == "id":
            c = x[0] - y[0]
        elif key == "rel_path":
            c = compared(x[1], y[1])
        elif key == "status":
            c = compared(*("missing" if p[3] else (p[2] or "").strip().lower() for p in (x, y)))
        else:
            c = (stamp(x[4]) > stamp(y[4])) - (stamp(x[4]) < stamp(y[4]))
        return (-c if down else c) or x[0] - y[0]

    want = [x[0] for x in sorted(rows, key=functools.cmp_to_key(rank))]
    assert [x.page_id for x in sorting.sorted_pages(pages, column, direction).collect()] == want


def test_drafts_are_merged_field_by_field(spark):
    fields = "class_name string, orientation string, reading_order int, x1 double, y1 double, x2 double, y2 double"
    base = ("text", "horizontal", 1, 0.1, 0.1, 0.5, 0.5)
    with_ = lambda **kw: tuple(kw.get(f, v) for f, v in zip(drafts.FIELDS, base))
    stored = {1: base, 2: with_(class_name="table"), 3: with_(class_name="table", x1=0.2), 4: with_(reading_order=5), 5: base, 6: base}
    draft = {1: with_(x1=0.3), 2: with_(reading_order=2), 3: with_(class_name="Caption", x1=0.2), 4: with_(reading_order=5, x2=0.50001), 5: with_(orientation="vertical"), 9: base}
    s = spark.createDataFrame([(i, *v) for i, v in stored.items()], f"layout_id long, {fields}")
    d = spark.createDataFrame([(i, *v, *base) for i, v in draft.items()], f"layout_id long, {fields}, " + ", ".join(f"base_{x}" for x in fields.split(", ")))
    got = {r.layout_id: (tuple(r[f] for f in drafts.FIELDS), r.drafted, r.conflicts) for r in drafts.overlaid(s, d, spark.createDataFrame([(5,)], "layout_id long")).collect()}
    assert got == {
        1: (with_(x1=0.3), True, []), 2: (with_(class_name="table", reading_order=2), True, []), 3: (with_(class_name="Caption", x1=0.2), True, ["class_name"]), 4: (with_(reading_order=5), True, []), 6: (base, False, []),
    }
