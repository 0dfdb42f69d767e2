"""How packing deals its pieces into groups."""

from __future__ import annotations

from collections import Counter

from quillspark.llm import packing
from quillspark.llm.common import stored


def packed(spark, rows, group):
    pieces = stored(spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long"))
    return packing.pack(pieces, 2048, group=group).collect()


def test_equal_rows_spread_over_all_groups(spark):
    out = packed(spark, [(None, 0, 0, 1, 7)] * 20_000, 7000)
    dealt = Counter(r.sequence_id >> 24 for r in out)
    assert len(out) == 20_000 and len(dealt) == 3 and max(dealt.values()) < 7500
    assert len({r.sequence_id for r in out}) <= -(-20_000 // 2048) + 3  # at most one more a group
    assert len({(r.sequence_id, r.offset) for r in out}) == 20_000


def test_sequences_are_gapless_in_every_group(spark):
    rows = [(i, 0, 0, i * 37 % 2048 + 1, i) for i in range(900)] + [(5, 0, 0, 186, 5)] * 300
    out = packed(spark, rows, 200)
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == Counter(rows)
    ends = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
