"""Ruled tables and page composition, on drawn pages."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import layout, pages


def drawn(xs, ys, merged=()):
    """Unit rulings of a grid, jittered, without those inside merged pairs of neighbours; and the boxes they close."""
    rng = random.Random(len(xs) * 31 + len(ys))
    gone_down = {(i + 1, j) for (i, j), (k, m) in merged if j == m and k == i + 1}
    gone_across = {(i, j + 1) for (i, j), (k, m) in merged if i == k and m == j + 1}
    shake = lambda: rng.uniform(-0.8, 0.8)
    lines = [(xs[i] + shake(), y + (t := shake()), xs[i + 1] + shake(), y + t) for i in range(len(xs) - 1) for j, y in enumerate(ys) if (i, j) not in gone_across]
    lines += [(x + (t := shake()), ys[j] + shake(), x + t, ys[j + 1] + shake()) for i, x in enumerate(xs) for j in range(len(ys) - 1) if (i, j) not in gone_down]
    rng.shuffle(lines)
    return np.array(lines)


def plain_cells(across, down, meets):
    """Every least rectangle by trying all pairs of corners."""
    out = []
    for i, j in itertools.product(range(len(across)), range(len(down))):
        best = None
        for a, b in itertools.product(range(len(across)), range(len(down))):
            if across[a, 0] > across[i, 0] and down[b, 0] > down[j, 0] and meets[i, j] and meets[a, j] and meets[i, b] and meets[a, b]:
                key = (across[a, 0], down[b, 0])
                best = min(best, key) if best else key
        if best:
            out.append((down[j, 0], across[i, 0], best[1], best[0]))
    return sorted(out, key=lambda c: (c[1], c[0]))


def test_cells_of_grids_with_merged_cells():
    for n, m, merged in ((2, 2, ()), (4, 3, (((0, 0), (1, 0)),)), (5, 6, (((1, 1), (1, 2)), ((3, 0), (4, 0)))), (1, 1, ())):
        lines = drawn([50.0 + 60 * i for i in range(n + 1)], [100.0 + 25 * j for j in range(m + 1)], merged)
        boxes = pages.cells(lines)
        assert len(boxes) == n * m - len(merged)
        assert all(min(abs(b[0] - 50 - 60 * i) for i in range(n + 1)) < 1.5 for b in boxes)
        flat = np.abs(lines[:, 3] - lines[:, 1]) <= pages.SNAP
        low, high = np.minimum(lines[:, :2], lines[:, 2:]), np.maximum(lines[:, :2], lines[:, 2:])
        across = pages.joined(pages.snapped(((low + high) / 2)[flat, 1]), low[flat, 0], high[flat, 0])
        down = pages.joined(pages.snapped(((low + high) / 2)[~flat, 0]), low[~flat, 1], high[~flat, 1])
        meets = np.array([[down[j, 1] - 5 <= across[i, 0] <= down[j, 2] + 5 and across[i, 1] - 5 <= down[j, 0] <= across[i, 2] + 5 for j in range(len(down))] for i in range(len(across))])
        assert (pages.crossings(across, down) == meets).all()
        assert np.allclose(boxes, plain_cells(across, down, meets))


def test_tables_apart_and_single_boxes():
    two = np.concatenate((drawn([0.0, 50, 100], [0.0, 20, 40]), drawn([0.0, 50, 100], [200.0, 220])))
    alone = drawn([300.0, 340], [0.0, 30])  # a frame is no table
    found = pages.tables_of(pages.cells(np.concatenate((two, alone))))
    assert [len(t) for t in found] == [4, 2]
    assert pages.tables_of(pages.cells(np.zeros((0, 4)))) == []


def test_text_of_cells():
    words = [(10.0, 40.0, 50.0, "b"), (11.0, 5.0, 20.0, "a"), (11.0, 21.0, 30.0, "A"), (30.0, 5.0, 9.0, "c")]
    assert pages.cell_text(words) == "aA b\nc"
    boxes = np.array([(0.0, 0, 50, 20), (50, 0, 100, 20), (0, 20, 100, 40)])
    assert pages.filled(boxes, np.array([(60.0, 2, 70, 12), (10, 22, 20, 32)]), ["x", "y"]) == [["", "x"], ["y", None]]


LINES = "doc_id long, page_no int, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string"


def line(page, x, y, text, width=100.0):
    return (1, page, 600.0, 900.0, x, y, x + width, y + 12, text)


def test_pages_are_composed(spark):
    rows = [line(0, 50.0, 20.0, "header"), line(0, 50.0, 860.0, "footer"), line(0, 50.0, 120.0, "one"), line(0, 50.0, 134.0, "two"), line(0, 50.0, 200.0, "three"), line(0, 330.0, 120.0, "right"), line(0, 330.0, 134.0, "more"), line(0, 50.0, 150.0, " "), line(1, 50.0, 300.0, "next page"), (2, 0, 600.0, 900.0, 50.0, 300.0, 90.0, 310.0, None)]
    xs, ys = [50.0, 110.0, 170.0], [400.0, 420.0, 440.0, 460.0]
    cell = [(0, xs[c] + 4, ys[r] + 4, f"{r}{c}") for r in range(3) for c in range(2)]
    rows += [line(p, x, y, t, 20.0) for p, x, y, t in cell]
    rulings = spark.createDataFrame([(1, 0, *map(float, x)) for x in drawn(xs, ys)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.doc_id, r.page_no): r.markdown for r in pages.compose_pages(spark.createDataFrame(rows, LINES), rulings).collect()}
    grid = "[TABLE_START]\n| 00 | 01 |\n|---|---|\n| 10 | 11 |\n| 20 | 21 |\n[TABLE_END]"
    assert got == {(1, 0): f"one\ntwo\n\nthree\n\n{grid}\n\nright\nmore", (1, 1): "next page"}
    none = pages.compose_pages(spark.createDataFrame([], LINES), rulings.limit(0))
    assert none.collect() == []


def test_spans_make_lines_and_tables_are_kept_once(spark):
    spans = [(1, 0, 600.0, 900.0, 0, 0, s, 10.0 * s, 0.0, 10.0 * s + 9, 12.0, t) for s, t in ((1, "b"), (0, "a"), (2, None))]
    got = pages.spans_to_lines(spark.createDataFrame(spans, LINES.replace("page_height double,", "page_height double, block_no int, line_no int, span_no int,"))).first()
    assert (got.text, got.x0, got.x1) == ("ab", 0.0, 29.0)
    tables = spark.createDataFrame([(1, 0, s, x, 0.0, x + 100, 50.0) for s, x in ((0, 0.0), (1, 5.0), (2, 90.0))], "doc_id int, page_no int, seq int, x0 double, y0 double, x1 double, y1 double")
    assert [r.seq for r in layout.distinct_tables(tables).orderBy("seq").collect()] == [0, 2]
    edge = spark.createDataFrame([(60.0, 79.0), (60.0, 81.0), (70.0, 85.0), (800.0, 815.0), (821.0, 890.0)], "y0 double, y1 double")
    assert [r[0] for r in edge.select(layout.is_header_footer(F.lit(900.0))).collect()] == [True, False, True, False, True]


def test_pages_of_a_batch_are_as_pages_alone(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    box = [(c, pa.float64()) for c in layout.BOX]
    kinds = pa.list_(pa.struct(box)), pa.list_(pa.struct([*box, ("text", pa.string())]))
    rulings, words = [], []
    for n in range(60):
        lines = drawn([50.0 + 60 * i for i in range(n % 5 + 1)], [100.0 + 25 * j for j in range(n % 4 + 1)], (((0, 0), (1, 0)),) if n % 3 == 0 else ())
        rulings.append([dict(zip(layout.BOX, line)) for line in lines.tolist() if rng.random() < 0.95] if n % 7 else None)
        spots = [(float(rng.randint(50, 300)), float(rng.randint(100, 200))) for _ in range(n)]
        words.append([{"x0": x, "y0": y, "x1": x + 9, "y1": y + 8, "text": rng.choice("abc")} for x, y in spots] if n else None)
    whole = pages._tables(pa.array(rulings, kinds[0]), pa.array(words, kinds[1])).to_pylist()
    for r, w, tables in zip(rulings, words, whole):
        boxes = pages.cells(np.array([list(x.values()) for x in r or []]).reshape(-1, 4))
        at = np.array([[x[c] for c in layout.BOX] for x in w or []]).reshape(-1, 4)
        assert [t["rows"] for t in tables] == [pages.filled(t, at, [x["text"] for x in w or []]) for t in pages.tables_of(boxes)]
        for t in tables:  # each word by itself
            middle = {x["text"] for x in w or [] if t["x0"] <= (x["x0"] + x["x1"]) / 2 < t["x1"] and t["y0"] <= (x["y0"] + x["y1"]) / 2 < t["y1"]}
            assert {c for row in t["rows"] for text in row for c in text or "" if c.strip()} <= middle
    monkeypatch.setattr(pages, "PAIRS", 7)
    assert pages._tables(pa.array(rulings, kinds[0]), pa.array(words, kinds[1])).to_pylist() == whole


def test_text_of_many_cells_at_once():
    import pyarrow as pa

    rng = random.Random(2)
    held = [[(float(rng.randint(0, 8)), float(rng.randint(0, 20)), float(rng.randint(5, 25)), rng.choice("abcd")) for _ in range(rng.randint(2, 5))] for _ in range(300)]
    flat = [w for words in held for w in words]
    got = pages._cell_texts(np.array([len(w) for w in held]), np.array([(x0, top, x1, top + 5) for top, x0, x1, _ in flat]), pa.array([w[3] for w in flat]))
    assert got.to_pylist() == [pages.cell_text(w) for w in held]


def test_columns_of_many_pages_at_once():
    rng = random.Random(8)
    edges = [[rng.choice([50.0, 60.0, 200.0, 330.0, 480.0, 50.0 + rng.random()]) for _ in range(rng.randint(1, 9))] for _ in range(80)]
    page = np.repeat(np.arange(80), [len(e) for e in edges])
    got = layout.columns_of(page, np.concatenate([np.array(e) for e in edges]), np.full(80, 600.0))
    for i, e in enumerate(edges):
        assert got[page == i].tolist() == layout.column_labels(np.array(e), 600.0).tolist()


def test_page_queries_work_on_batches_and_shuffle_no_parts(spark):
    from quillon.plans.catalog import QUERIES

    for name, most in (("ruled_tables", 1), ("page_documents", 2)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and plan.count("Exchange hashpartitioning") <= most and plan.count("Scan parquet") == 1
