"""Stored postings in buckets: what an upsert writes, other writers, lookups, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from rolegrid.operators import store as S
from rolegrid.sources.tables import BucketTable, Files
from tests.test_store import T0, batch, by_id, posting, table


def filled(spark, path, n=30, buckets=8):
    stored = BucketTable(spark, str(path), buckets)
    stored.upsert(batch(spark, [posting(url=f"u{i}", job_id=f"J{i}" if i % 2 else None) for i in range(n)]))
    return stored


def test_upsert_of_one_row_writes_one_bucket(spark, tmp_path):
    stored = filled(spark, tmp_path / "t")
    before, rows = stored.state(), by_id(stored.read())
    assert len(before["rows"]) > 4 and len(rows) == 30
    result = stored.upsert(batch(spark, [posting(url="u7", title="again")]))
    after = stored.state()
    assert [r.action for r in result["outcome"].collect()] == ["updated"]
    changed = [b for b in after["rows"] if after["rows"][b] != before["rows"].get(b)]
    assert len(changed) == 1 and after["keys"] == before["keys"] and after["next_id"] == before["next_id"]
    now = by_id(stored.read())
    assert {i for i in now if now[i] != rows[i]} == {8} and now[8]["title"] == "again"


def test_new_and_moved_postings(spark, tmp_path):
    stored = filled(spark, tmp_path / "t")
    result = stored.upsert(batch(spark, [posting(url="new", job_id="J1", title="moved"), posting(url="other", job_id="X"), posting(url="u3", job_id="J5", title="both")]))
    assert {r.seq: r.action for r in result["outcome"].collect()} == {1: "updated", 2: "inserted", 3: "conflict"}
    rows = by_id(stored.read())
    assert (rows[2]["url"], rows[2]["source_job_id"], rows[31]["url"]) == ("new", "J1", "other") and len(rows) == 31
    found = lambda *keys: {r.url for r in stored.lookup(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert "new" in found("i:acme:J1") and "new" in found("u:new") and found("u:u1") == set() and "other" in found("i:acme:X")


def test_same_as_the_upsert_of_whole_tables(spark, tmp_path):
    stored, plain = BucketTable(spark, str(tmp_path / "t"), 4), table(spark, [])
    for step in range(3):
        rows = [posting(url=f"u{(i * (step + 3)) % 17}", job_id=f"J{(i + step) % 9}" if i % 3 else None, title=f"{step}-{i}") for i in range(12)]
        one, two = stored.upsert(batch(spark, rows)), S.upsert_postings(plain, batch(spark, rows))
        plain = spark.createDataFrame(two["store"].collect(), two["store"].schema)
        assert sorted(map(str, one["outcome"].collect())) == sorted(map(str, two["outcome"].collect()))
        assert sorted(map(str, stored.read().collect())) == sorted(map(str, plain.collect()))


def test_two_writers_lose_nothing(spark, tmp_path):
    stored, errors = filled(spark, tmp_path / "t", n=4), []

    def write(who):
        try:
            other = BucketTable(spark, str(tmp_path / "t"))
            for i in range(3):
                other.upsert(batch(spark, [posting(url=f"{who}{i}", title=who), posting(url="u1", title=f"{who}{i}")]))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    rows = by_id(stored.read())
    assert {r["url"] for r in rows.values()} == {"u0", "u1", "u2", "u3", "a0", "a1", "a2", "b0", "b1", "b2"}
    assert sorted(rows) == list(range(1, 11)) and stored.versions() == list(range(1, 8))


def test_a_lost_commit_is_tried_again(spark, tmp_path):
    stored = filled(spark, tmp_path / "t", n=2)
    publish, late = stored._publish, []

    def slow(before, **changes):
        if not late:
            late.append(BucketTable(spark, str(tmp_path / "t")).upsert(batch(spark, [posting(url="first")])))
        return publish(before, **changes)

    stored._publish = slow
    stored.upsert(batch(spark, [posting(url="second"), posting(url="first", title="seen")]))
    rows = by_id(stored.read())
    assert [(i, rows[i]["url"]) for i in sorted(rows)] == [(1, "u0"), (2, "u1"), (3, "first"), (4, "second")] and rows[3]["title"] == "seen"


def test_a_file_is_created_once(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    assert files.create(f"{tmp_path}/c/1.json", "é") and not files.create(f"{tmp_path}/c/1.json", "b")
    assert files.read(f"{tmp_path}/c/1.json") == "é" and files.names(f"{tmp_path}/none") == []
    assert [n for n in files.names(f"{tmp_path}/c") if not n.startswith(".")] == ["1.json"]


def test_batches_of_a_stream_count_once(spark, tmp_path):
    stored = BucketTable(spark, str(tmp_path / "t"), 4)
    rows = batch(spark, [posting(url="a")])
    assert stored.upsert(rows, batch=("s", 0)) and stored.upsert(rows, batch=("s", 0)) is None
    assert stored.committed("s", 0) and not stored.committed("s", 1) and not stored.committed("t", 0) and stored.versions() == [1]


def test_updates_write_changed_buckets(spark, tmp_path):
    stored = filled(spark, tmp_path / "t")
    before = stored.state()
    changes = spark.createDataFrame([("u3", "archived"), ("u5", "active")], "url string, job_status string")
    keys = changes.select(F.concat(F.lit("u:"), "url").alias("key"))
    changed = stored.update(lambda old: S.set_status(old, changes), keys)
    assert [r.id for r in changed.collect()] == [4] and by_id(stored.read())[4]["job_status"] == "archived"
    after = stored.state()
    assert sum(after["rows"][b] != before["rows"][b] for b in after["rows"]) == 1 and after["keys"] == before["keys"]
    now = F.lit(T0.replace(year=2027))
    stale = stored.update(lambda old: S.mark_stale(old, 7, now)["store"])
    assert stale.count() == 29 and stored.read().where("job_status = 'stale'").count() == 29


@pytest.mark.parametrize("keep", [1, 2])
def test_compact_and_clean(spark, tmp_path, keep):
    stored = filled(spark, tmp_path / "t", buckets=2)
    for i in range(3):
        stored.upsert(batch(spark, [posting(url=f"more{i}")]))
    rows = by_id(stored.read())
    stored.compact()
    assert all(len(p) == 1 for kind in ("rows", "keys") for p in stored.state()[kind].values())
    stored.clean(keep)
    assert by_id(stored.read()) == rows and len(stored.versions()) == keep
    stored.upsert(batch(spark, [posting(url="more1", title="x")]))
    assert by_id(stored.read())[32]["title"] == "x"
