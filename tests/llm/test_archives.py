"""WARC archives where tasks are repeated, keys are hot and rows are odd."""

import random

from ragloom.llm import common, warc

SCHEMA = "page_id long, url string, html string, record_type string, payload_digest string, same string"


def page_rows(n=90):
    rng = random.Random(4)
    return [(i, f"http://x/{i}", rng.choice(["hot", None, "", f"<p>{i}</p>" * 9, "two" * (i % 2)]), "old", "old", "old") for i in range(n)]


def as_rows(df):
    return sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


def test_archives_of_repeated_attempts_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 900)
    pages = spark.createDataFrame(page_rows(), SCHEMA)
    folder = f"file://{tmp_path}/a"
    plan = warc.record_plan(pages)
    # An attempt whose rows come in another order cuts elsewhere; its archives stay in the folder and no manifest lists them.
    warc.write_archives(plan.orderBy("payload").coalesce(2), folder, None)
    (tmp_path / "a" / "pages-000000-00000-broken.warc.zst").write_bytes(b"cut off")
    manifest = warc.write_archives(plan.coalesce(2), folder, None)
    assert manifest.count() > 4
    got = warc.read_listed(manifest, folder)
    assert sorted(r["page_id"] for r in got.collect()) == list(range(90))
    assert as_rows(got) == as_rows(warc.round_trip(pages))


def test_plan_is_the_same_shuffled_or_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([*page_rows(), (None, None, "hot", "", "", ""), (7, "http://again", "other", "", "", ""), (7, "http://again", "other", "", "", "")], SCHEMA)
    rows = lambda: sorted(map(str, warc.record_plan(pages).collect()))
    broadcast = rows()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert rows() == broadcast
    monkeypatch.setattr(common, "HEAVY_SHARE", 2)
    assert rows() == broadcast and len(broadcast) == 93


def test_revisits_name_the_payload_they_repeat(spark):
    good = warc.make_record("revisit", 1, "u", b"abc", 2)
    assert warc.parse_record(good)["refers_to"] == warc.record_id(2, warc.payload_digest(b"abc"))
    other = good.replace(b"urn:x-page:2:" + warc.payload_digest(b"abc").encode(), b"urn:x-page:2:" + warc.payload_digest(b"xyz").encode())
    try:
        warc.parse_record(other)
        raise AssertionError
    except warc.WarcError:
        pass
    digests = [warc.payload_digest(x) for x in (b"a", b"b")]
    records = spark.createDataFrame([(1, "response", digests[0], None), (2, "revisit", digests[0], 1), (3, "revisit", digests[1], 1), (4, "revisit", digests[1], 1)], "page_id long, record_type string, payload_digest string, refers_to long")
    assert [tuple(r) for r in warc.dangling(records).collect()] == [(1, digests[1])]
    # A page that is written twice with other payloads has two identities.
    assert warc.record_id(7, digests[0]) != warc.record_id(7, digests[1])


def test_lookup_of_null_and_missing_keys(spark, monkeypatch):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("c", 4), ("a", 5)], "k string, v int")
    right = spark.createDataFrame([("a", 2, "x"), ("b", 1, "y"), ("z", 0, "w")], "k string, n long, w string")
    expected = [(1, "x"), (2, None), (3, "y"), (4, None), (5, "x")]
    for most, share in ((10, 1000), (0, 1000), (0, 2), (0, 1)):
        monkeypatch.setattr(common, "HEAVY_SHARE", share)
        assert sorted((r["v"], r["w"]) for r in common.lookup(left, right, "k", "n", most).collect()) == expected


def test_row_slices_are_bounded_and_complete(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "SLICE_ROWS", 5)
    monkeypatch.setattr(common, "SLICE_BYTES", 20)
    column = pa.array(["a" * n for n in (1, 50, 2, 3, 4, 0, 0, 0, 0, 0, 0, 19, 19, 7)] + [None] * 3)
    ranges = list(common.row_slices([column]))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(column)))
    assert all(b - a == 1 or (b - a <= 5 and sum(len(x or "") + 1 for x in column[a:b].to_pylist()) <= 20) for a, b in ranges)
    assert list(common.row_slices([])) == [] and list(common.row_slices([column[:0]])) == []
