"""Sheet regions, headers and kinds against a plain walk over a grid."""

from __future__ import annotations

import random
import re
import statistics

import pytest

from quillspark.operators import sheets
from quillspark.operators.scratch import Rounds
from quillspark.plans import sheets as plans

CELLS = "sheet string, row int, col int, raw string, kind string, styled boolean"
MERGES = "sheet string, from_row int, from_col int, to_row int, to_col int"
KINDS = {int: "number", str: "text"}


def is_value(raw, kind):
    return kind != "text" or bool(re.fullmatch(r"[+-]?\d+([.,]\d+)?|\d{4}-\d\d-\d\d", raw.strip())) or len(raw) > 80


class Plain:
    """One sheet: cells {(row, col): (raw, kind, styled)} and merges (r0, c0, r1, c1)."""

    def __init__(self, cells, merges):
        self.cells, self.merges = {k: v for k, v in cells.items() if v[0].strip()}, merges
        self.rows, self.cols = max(r for r, _ in self.cells) + 1, max(c for _, c in self.cells) + 1
        self.grid = set(self.cells)
        for r0, c0, r1, c1 in merges:
            if (r0, c0) in self.cells:
                self.grid |= {(r, c) for r in range(r0, min(r1 + 1, self.rows)) for c in range(c0, min(c1 + 1, self.cols))}

    def runs(self, used):
        out = []
        for n in sorted(used):
            if out and out[-1][1] == n - 1:
                out[-1][1] = n
            else:
                out.append([n, n])
        return out

    def score(self, r, reg):
        top, left, bottom, right = reg
        own = {c: self.cells[r, c] for c in range(left, right + 1) if (r, c) in self.cells}
        if not own or (len(own) < 2 and right > left):
            return 0.0
        under = {c: next((self.cells[x, c][1] for x in range(r + 1, bottom + 1) if (x, c) in self.cells), None) for c in own}
        near = [c for c in range(left, right + 1) if any((x, c) in self.cells for x in range(r + 1, min(bottom, r + 5) + 1))]
        n = len(own)
        text = sum(not is_value(*v[:2]) for v in own.values()) / n
        signal = sum(own[c][1] == "text" and under[c] in ("number", "date") for c in own) / n
        coverage = sum(c in own for c in near) / len(near) if near else 0
        return 0.35 * text + 0.15 * len({v[0].strip().lower() for v in own.values()}) / n + 0.25 * coverage + 0.15 * signal + 0.1 * sum(v[2] for v in own.values()) / n

    def regions(self):
        out, before, end = [], [], -2
        for first, last in self.runs({r for r, _ in self.grid}):
            filled = lambda a, b: {r for r, c in self.grid if first <= r <= last and a <= c <= b}  # noqa: B023, E731
            merged = []
            for left, right in self.runs({c for r, c in self.grid if first <= r <= last}):
                if merged:
                    a, b = merged[-1]
                    x, y = filled(a, b), filled(left, right)
                    if left - b == 2 and b > a and right > left and len(x & y) >= 0.9 * max(len(x), len(y)):
                        merged[-1] = (a, right)
                        continue
                merged.append((left, right))
            mine = []
            for left, right in merged:
                rows = filled(left, right)
                new, best, most = [min(rows), left, max(rows), right], None, 0
                for o in before if first == end + 2 else []:
                    shared = min(o[3], right) - max(o[1], left) + 1
                    if shared > most and shared >= 0.8 * (min(o[3] - o[1], right - left) + 1):
                        best, most = o, shared
                if best is not None and self.goes_on(best, new):
                    best[1], best[2], best[3] = min(best[1], left), new[2], max(best[3], right)
                    mine.append(best)
                else:
                    out.append(new)
                    mine.append(new)
            before, end = mine, last
        return [tuple(o) for o in out]

    def goes_on(self, above, new):
        top = self.score(new[0], new)
        if top < 0.35:
            return True
        stands_out = above[2] > above[0] and self.score(above[0], above) - self.score(above[0] + 1, above) >= 0.15
        return new[3] > new[1] and new[2] > new[0] and stands_out and top - self.score(new[0] + 1, new) < 0.15

    def header(self, reg, most=3):
        top, left, bottom, right = reg
        counts = {r: sum((r, c) in self.cells for c in range(left, right + 1)) for r in range(top, bottom + 1)}
        seen = [n for n in counts.values() if n]
        modal = max(set(seen), key=lambda n: (seen.count(n), n))
        wide = lambda r, n, flat: any(m[0] == r and (not flat or m[2] == r) and m[3] - m[1] + 1 >= n and left <= m[1] <= right and (r, m[1]) in self.cells for m in self.merges)
        title = lambda r: (counts[r] <= 2 and modal >= 4) or (counts[r] == 1 and wide(r, 3, True))
        scores = {r: self.score(r, reg) for r in [r for r in counts if counts[r] and not title(r)][:20]}
        anchor = max(scores, key=lambda r: (scores[r], -r), default=None)
        if anchor is None or scores[anchor] < 0.45:
            return None
        rows, index = [anchor], -1
        for r in range(anchor - 1, top - 1, -1):
            own = [self.cells[r, c] for c in range(left, right + 1) if (r, c) in self.cells]
            if len(rows) >= most or not own:
                break
            if len(own) >= 2 and [v[0].strip() for v in own] == [str(i + 1) for i in range(len(own))]:
                if index >= 0 or r != rows[0] - 1:
                    break
                index = r
            elif any(is_value(*v[:2]) for v in own) or (len(own) <= 2 and not wide(r, 2, False)):
                break
            else:
                rows.insert(0, r)
        return rows, index, anchor + 1, round(scores[anchor], 6)

    def names(self, reg, head):
        top, left, bottom, right = reg
        rows, _, start, _ = head
        out = {}
        for c in range(left, right + 1):
            texts = {" ".join(self.cells[r, c][0].split()): None for r in rows if (r, c) in self.cells}
            fill = sum((r, c) in self.cells for r in range(start, bottom + 1)) / (bottom - start + 1) if bottom >= start else 0
            if texts or fill >= 0.05:
                once = {}
                for t in texts:
                    once.setdefault(t.lower(), t)
                out[c] = (" / ".join(once.values()) or f"Spalte {c + 1}", round(fill, 6))
        return out

    def kind(self, reg, open_ended):
        top, left, bottom, right = reg
        held = {k: v for k, v in self.cells.items() if top <= k[0] <= bottom and left <= k[1] <= right}
        covers = {(m[0], m[1]): m[3] for m in self.merges}
        pairs = 0
        for (r, c), v in held.items():
            after = [x for x in range(c + 1, right + 1) if (r, x) in held]
            pairs += v[1] == "text" and sum(k[0] == r for k in held) <= 2 and bool(after) and after[0] <= covers.get((r, c), c) + 1
        pairs /= len(held)
        merges = sum(m[0] <= bottom and m[2] >= top and m[1] <= right and m[3] >= left for m in self.merges)
        head = self.header(reg)
        names = self.names(reg, head) if head else {}
        low = False
        if head and names:
            data = sorted(self.score(r, reg) for r in range(head[2], min(bottom, head[2] + 4) + 1))
            low = merges >= 1 and (head[3] - data[len(data) // 2] if data else 1) < 0.15
        if pairs >= 0.4 and (merges >= 5 or low):
            return "form"
        if head and names:
            n, fills = bottom - head[2] + 1, [f for _, f in names.values() if f >= 0.05]
            enough = n >= 3 or (open_ended and n >= 1)
            texts = [self.cells[r, next(iter(names))][0].strip() for r in range(head[2], bottom + 1) if (r, next(iter(names))) in self.cells]
            short = bool(texts) and not any(t.endswith(".") for t in texts) and sum(len(t) <= 40 for t in texts) >= 0.8 * len(texts)
            if enough and fills and statistics.mean(fills) >= 0.5 and (len(names) > 1 or short):
                return "table"
        return "form" if pairs >= 0.4 or merges >= 5 else "prose"


def random_sheet(rng):
    cells, merges, row = {}, [], rng.randrange(3)
    for _ in range(rng.randrange(1, 5)):
        height, style = rng.randrange(1, 9), rng.random() < 0.5
        spans, at = [], rng.randrange(2)
        for _ in range(rng.randrange(1, 4)):
            width = rng.randrange(1, 5)
            spans.append((at, at + width))
            at += width + rng.choice([1, 1, 2])
        same = rng.random() < 0.7
        for a, b in spans:
            for r in range(row, row + (height if same else rng.randrange(1, height + 1))):
                for c in range(a, b):
                    if rng.random() < 0.92:
                        if r == row and rng.random() < 0.7:
                            v = rng.choice(["Name", "Ort", "Größe", "Datum", "name ", "x\ny"]) + rng.choice(["", str(c)])
                        else:
                            v = rng.choice(["Berlin", 12, 3, "2024-01-05", "x", "ein Satz.", "w" * 90, "1", 2])
                        cells[r, c] = (str(v), KINDS[type(v)], r == row and style)
        if rng.random() < 0.4:
            a, b = spans[0]
            merges.append((row, a, row + rng.choice([0, 0, 1]), min(b, a + rng.randrange(1, 4))))
        if rng.random() < 0.2:
            cells |= {(row, c): (str(i + 1), "number", False) for i, c in enumerate(range(*spans[0]))}
        row += height + rng.choice([1, 1, 2, 3])
    return cells, merges


FORM = {(r, c): (v, "text", False) for r, (a, b) in enumerate([("Name", "Anna"), ("Ort", "Ulm"), ("Amt", "Bau"), ("Art", "neu")]) for c, v in ((0, a), (3, b))}


@pytest.fixture(scope="module")
def given():
    rng = random.Random(12)
    out = {f"s{i}": random_sheet(rng) for i in range(120)}
    out["form"] = (FORM, [(r, 0, r, 2) for r in range(4)] + [(1, 3, 1, 4)])
    return {k: v for k, v in out.items() if v[0]}


def tables(spark, given):
    cells = [(s, r, c, *v) for s, (cells, _) in given.items() for (r, c), v in cells.items()] + [("s0", 1, None, "lost", "text", None), (None, 0, 0, "lost", "text", None), ("blank", 0, 0, " ", "text", None)]
    return spark.createDataFrame(cells, CELLS), spark.createDataFrame([(s, *m) for s, (_, merges) in given.items() for m in merges], MERGES)


def test_regions_headers_and_kinds(spark, given):
    with Rounds(spark) as rounds:
        compared(given, rounds, *map(rounds.keep, tables(spark, given)))


def compared(given, rounds, cells, merges):
    found = rounds.keep(sheets.regions(cells, merges))
    plain = {s: Plain(*x) for s, x in given.items()}
    want = {(s, *reg): p for s, p in plain.items() for reg in p.regions()}
    assert {(r.sheet, r.top, r.left, r.bottom, r.right): r.open_ended for r in found.collect()} == {k: k[3] == max(r for r, _ in p.grid) for k, p in want.items()}
    heads = rounds.keep(sheets.headers(cells, found, merges))
    got = {(r.sheet, r.top, r.left): (list(r.header_rows), r.index_row, r.data_start, r.confidence) for r in heads.collect()}
    expected = {k[:3]: p.header(k[1:]) for k, p in want.items()}
    assert got == {k: pytest.approx(v) if v is None else (v[0], v[1], v[2], pytest.approx(v[3])) for k, v in expected.items() if v}
    names, named = {}, rounds.keep(sheets.header_names(cells, found, heads))
    for r in named.collect():
        names.setdefault((r.sheet, r.top, r.left), {})[r.col] = (r.name, r.fill)
    assert names == {k[:3]: n for k, p in want.items() if expected[k[:3]] and (n := p.names(k[1:], expected[k[:3]]))}
    kinds = {(r.sheet, r.top, r.left): r.kind for r in sheets.kinds(cells, found, heads, named, merges).collect()}
    assert kinds == {k[:3]: p.kind(k[1:], k[3] == max(r for r, _ in p.grid)) for k, p in want.items()}
    assert kinds["form", 0, 0] == "form" and set(kinds.values()) == {"form", "table", "prose"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], CELLS)
    found = sheets.regions(empty)
    assert found.count() == 0 and sheets.headers(empty, found).count() == 0


def test_registered(spark):
    out = {(r.sheet, r.top, r.left): r for r in plans.sheet_headers(spark, "/root/testdata/sf0.01").collect()}
    assert len({s for s, _, _ in out}) == 25
    for s in {s for s, _, _ in out}:
        main = [r for r in out.values() if r.sheet == s and r.names == "Customer|Key|Segment|Balance"]
        assert [(r.kind, r.top, r.left, r.data_start) for r in main] == [("table", 2, 0, 3)]
