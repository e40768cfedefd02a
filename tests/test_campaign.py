"""The corpus generator, and campaigns over it."""

from collections import Counter

from snapweave.plans.campaign import campaign, controls, shifted_boundaries
from snapweave.sources import corpus as k


def test_files_are_made_alike_and_by_themselves(spark):
    made = [{r.path: (bytes(r.content), r.mtime_ns) for r in k.corpus(spark, g, 200, 3).collect()} for g in (0, 0, 1)]
    assert made[0] == made[1] and len(made[0]) == 200
    assert all(k.LEAST <= len(x) < k.LEAST + k.SPREAD for x, _ in made[0].values())
    kinds = Counter(p.split("/")[0] for p in made[0])
    assert 60 < kinds["docs"] < 120 and 40 < kinds["db"] < 100 and 20 < kinds["blobs"] < 60
    changed = {p for p in made[0] if p in made[2] and made[0][p][0] != made[2][p][0]}
    assert len(set(made[2]) - set(made[0])) == 2 and len(set(made[0]) - set(made[2])) <= 8 and 1 <= len(changed) <= 20
    assert all(made[2][p][1] == 10**9 for p in changed)


def test_a_file_stays_gone():
    alive = [[k.file_at(n, g, 100, 5) is not None for g in range(30)] for n in range(100)]
    assert all(row == sorted(row, reverse=True) for row in alive) and any(not row[-1] for row in alive)
    assert k.file_at(100, 0, 100, 5) is None and k.file_at(100, 1, 100, 5) is not None


def test_campaign_sends_what_changed(spark):
    rows = {(r.part, r.generation): r for r in campaign(spark, 3, 60).collect()}
    assert set(rows) == {("seed", 0), ("incremental", 1), ("incremental", 2), ("seed", -1), ("incremental", -1), ("campaign", -1)}
    seed, later, all_ = rows["seed", -1], rows["incremental", -1], rows["campaign", -1]
    assert 30 < seed.reduction_pct < 75 and later.reduction_pct > 90 and seed.chunks_sent == seed.chunks_total
    assert all_.wire_bytes == seed.wire_bytes + later.wire_bytes and seed.compressed_bytes < seed.payload_bytes


def test_controls(spark):
    rows = {r.control: r for r in controls(spark, 1_000_000).collect()}
    assert -2 < rows["incompressible"].reduction_pct < 0 and rows["one byte"].chunks_sent <= 2 and rows["one byte"].reduction_pct > 90
    share = {r.cut: r.share for r in shifted_boundaries(spark, 1 << 20).collect()}
    assert share["content"] > 0.98 and share["size"] < 0.02
