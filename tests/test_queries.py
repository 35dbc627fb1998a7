import pytest

from tilewright.plans import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_sql(name, spark, sf_dir, same):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLE[name])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 350


def _events(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, event_type string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def _by_sql(path, name):
    import duckdb

    return sorted(duckdb.sql(f"WITH events AS (SELECT * FROM '{path}/events.parquet/*.parquet') {registry.ORACLE[name]}").fetchall(), key=str)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_container_enum_has_no_bound_on_rows(spark, sf_dir, same, monkeypatch):
    monkeypatch.setattr(registry, "MOST_ROWS", 100)
    monkeypatch.setattr(registry, "ROWS_EACH", 70, raising=False)
    same(registry.container_enum(spark, sf_dir), registry.ORACLE["container_enum"])


@pytest.mark.parametrize("rows", [
    [],
    [(7, "view"), (2999, "click"), (1_000_000_000_000, "view")],
    [(3, None), (4, "-1"), (0, ""), (1, "base")],
    [(5, "view"), (5, "click"), (5, "view"), (6, None)],
], ids=["none", "gaps", "null and odd types", "repeated"])
def test_container_enum_places_rows_by_id(spark, tmp_path, rows):
    path = _events(spark, tmp_path, rows)
    assert _rows(registry.container_enum(spark, path)) == _by_sql(path, "container_enum")


def test_u64_json_beyond_64_bits(spark, tmp_path):
    ids = [0, 1000, 1001, 1_023_999, 1_024_001, 2_048_001, 5_999_999, 2**63 - 1, -1, -(2**63), None]
    path = _events(spark, tmp_path, [(k, "view") for k in ids])

    def text(v):
        return v if v is None else f'"{v}"' if v > 2**53 else str(v)

    want = [(k, text(None if k is None else k * 9007199254740)) for k in ids]
    assert _rows(registry.u64_json(spark, path)) == sorted(want, key=str)


def test_unsigned_wrap_has_no_bound_on_rows(spark, sf_dir, same, monkeypatch):
    monkeypatch.setattr(registry, "MOST_ROWS", 100)
    monkeypatch.setattr(registry, "ROWS_EACH", 70, raising=False)
    same(registry.unsigned_wrap(spark, sf_dir), registry.ORACLE["unsigned_wrap"])


@pytest.mark.parametrize("ids", [[], [3, 3, 2**31, 70_000, 5_999_999]], ids=["none", "gaps and repeated"])
def test_unsigned_wrap_of_odd_ids(spark, tmp_path, ids):
    path = _events(spark, tmp_path, [(k, "view") for k in ids])
    assert _rows(registry.unsigned_wrap(spark, path)) == _by_sql(path, "unsigned_wrap")
