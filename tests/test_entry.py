import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own == set(entry.oracle_sql()) - set(entry.LLM_SQL) and len(own) >= 67


def rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["read_rois", "read_markers", "write_events", "detect_v1", "markers_v2", "fcpxml_lines", "conform_timeline", "merge_counts", "run_game_batch"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    assert rows(got.toPandas()) == rows(db.execute(entry.oracle_sql()[name]).df())


def test_merge_counts_covers_every_game(spark):
    from peakline.catalog import fixtures as X

    sf = SF.replace("sf0.001", "sf0.01")
    markers = X.markers(spark, sf)
    src, dst = X.merge_sides_of_all(markers)
    assert src.unionByName(dst).distinct().count() == markers.count()
    got = entry.queries()["merge_counts"](spark, sf).collect()
    assert {r.game_id for r in got} == {r.game_id for r in markers.select("game_id").distinct().collect()}
    assert all(r.copied > 0 and r.skipped > 0 for r in got)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_checkpoint_folder_is_the_sessions(spark):
    from peakline.operators.cut import checkpoint_folder

    assert checkpoint_folder(spark) == spark.sparkContext.getCheckpointDir()
