"""Additive tile state: streams equal builds, redelivery changes nothing, versions, width, size."""

import numpy as np
import pytest

from tessella.operators import polygons, tilearrays, tilestate
from tests.test_cuts import frames_of, turned_frames

ORDER, WIDTH = 5, 16


def versioned(spark, rows, version="1"):
    return frames_of(spark, rows).selectExpr("*", f"'{version}' AS version")


def built(frames):
    sampled = tilearrays.sample_frames(frames, ORDER, WIDTH)
    return {r["npix"]: r["pixels"] for r in tilearrays.coadd(sampled).collect()}


def held(spark, path):
    return {r["npix"]: r["pixels"] for r in tilestate.tiles_of(tilestate.sums(spark, path, WIDTH)).collect()}


def same(a, b):
    keep = {k: v for k, v in a.items() if not np.isnan(v).all()}
    other = {k: v for k, v in b.items() if not np.isnan(v).all()}
    assert keep.keys() == other.keys()
    for k in keep:
        np.testing.assert_allclose(keep[k], other[k], rtol=1e-12)


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("part-*.parquet")}


def test_batches_redelivery_versions_and_compaction(spark, tmp_path):
    rows = turned_frames(18, 21)
    path = str(tmp_path / "state")
    assert tilestate.ledger(spark, path).count() == 0 and held(spark, path) == {}
    assert tilestate.merge(path, versioned(spark, rows[:7]), ORDER, WIDTH, 0).count() == 0
    tilestate.merge(path, versioned(spark, rows[7:12] + rows[7:9]), ORDER, WIDTH, 1)  # sources that come twice
    same(held(spark, path), built(frames_of(spark, rows[:12])))
    # The same batch again, and old sources in a new batch.
    tilestate.merge(path, versioned(spark, rows[7:12]), ORDER, WIDTH, 1)
    tilestate.merge(path, versioned(spark, rows[:5] + rows[12:]), ORDER, WIDTH, 2)
    same(held(spark, path), built(frames_of(spark, rows)))
    assert tilestate.ledger(spark, path).count() == 18
    # A new version isn't added; its tiles, old and new, are computed afresh.
    changed = [(*rows[3][:3], rows[3][3] + 1.0, *rows[3][4:-1], [v * 2 for v in rows[3][-1]])]
    stale = tilestate.merge(path, versioned(spark, changed, "2"), ORDER, WIDTH, 3)
    same(held(spark, path), built(frames_of(spark, rows)))
    old = polygons.footprint_cells(frames_of(spark, rows[3:4]), ORDER, ())
    now = rows[:3] + changed + rows[4:]
    every = versioned(spark, rows[:3] + rows[4:]).unionByName(versioned(spark, changed, "2"))
    unknown = versioned(spark, [(900, *changed[0][1:])])  # not in the ledger: not counted
    tilestate.recompute(path, stale.unionByName(old), every.unionByName(unknown), ORDER, WIDTH, 4)
    same(held(spark, path), built(frames_of(spark, now)))
    assert {r["source"]: r["version"] for r in tilestate.ledger(spark, path).collect()}["3"] == "2"
    tilestate.compact(spark, path, WIDTH, 5)
    same(held(spark, path), built(frames_of(spark, now)))
    assert tilestate.ledger(spark, path).count() == 18
    tiles = spark.read.parquet(f"{path}/tiles/5")
    assert tiles.count() == tiles.select("npix").distinct().count()  # a row per tile, however many sources
    tilestate.merge(path, versioned(spark, turned_frames(3, 77)[:2]), ORDER, WIDTH, 6)  # ids 0 and 1 are known: their version stays
    same(held(spark, path), built(frames_of(spark, now)))


def test_a_stream_equals_a_build(spark, tmp_path):
    rows = turned_frames(12, 31)
    table, path = versioned(spark, rows), str(tmp_path / "state")
    for k, part in enumerate((rows[:4], rows[4:9], rows[2:6] + rows[9:])):
        versioned(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    found = []
    run = tilestate.sink(path, lambda batch: batch, ORDER, WIDTH, stale=lambda tiles, n: found.append(tiles.count()))
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert len(found) == 3 and not any(found)
    same(held(spark, path), built(frames_of(spark, rows)))


def test_width_is_checked_and_gaps_are_found(spark, tmp_path):
    rows, path = turned_frames(3, 41), str(tmp_path / "state")
    tilestate.merge(path, versioned(spark, rows[:2]), ORDER, WIDTH, 0)
    with pytest.raises(Exception, match="another width"):
        tilestate.sums(spark, path, 8).collect()
    with pytest.raises(ValueError):
        tilestate.merge(path, versioned(spark, rows), ORDER, WIDTH, 1, overlay="first")
    state = tilestate.sums(spark, path, WIDTH)
    dirty, index = polygons.footprint_cells(frames_of(spark, rows), ORDER, ()), polygons.footprint_cells(frames_of(spark, rows[:2]), ORDER, ())
    assert tilestate.lacking(state, dirty, index.join(state, "npix", "left_semi")).count() == 0
    one = state.orderBy("npix").limit(1).select("npix")
    assert [tuple(r) for r in tilestate.lacking(state.join(one, "npix", "left_anti"), dirty, one).collect()] == [tuple(r) for r in one.collect()]
