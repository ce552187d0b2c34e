import random
from datetime import datetime, timedelta

from threadloom.llm.nearest import DAY, NearestState, match_events, nearest_pairs, nearest_stream


def brute(lefts, rights):
    out = set()
    for p, q, t, tol in set(lefts):
        near = [(abs(u - t), u, k) for k, r, u in rights if r == q and abs(u - t) <= tol]
        if near:
            d, u, k = min(near)
            out.add((p, q, t, k, u))
    return out


def test_against_brute_force_with_a_hot_entity_and_ties(spark):
    r = random.Random(4)
    q = lambda: r.choice(["hot"] * 5 + ["a", "b"])
    lefts = [(f"p{i}", q(), r.randrange(400) * DAY // 4, r.choice([0, 1, 3, 20]) * DAY) for i in range(300)]
    rights = [(f"k{r.randrange(80):02d}", q(), r.randrange(400) * DAY // 4) for _ in range(300)]
    a = spark.createDataFrame(lefts + lefts[:5], "private_id string, qid string, at bigint, tolerance bigint")
    b = spark.createDataFrame(rights + rights[:5], "key string, qid string, at bigint")
    for rows in (4096, 16):  # 16: cells of the hot entity are cut into slices
        assert {tuple(x) for x in nearest_pairs(a, b, rows).collect()} == brute(lefts, rights)
    # a row of ten years, and events far from any cell with left rows
    lefts += [("ten years", "hot", 3000 * DAY, 3650 * DAY), ("ten years", "a", -900 * DAY, 3650 * DAY), ("short", "b", 5000 * DAY, DAY)]
    rights += [("far", "b", 5001 * DAY), ("further", "b", 9000 * DAY)]
    a, b = spark.createDataFrame(lefts, a.schema), spark.createDataFrame(rights, b.schema)
    assert {tuple(x) for x in nearest_pairs(a, b, 16).collect()} == brute(lefts, rights)


def test_the_machine_emits_by_watermark_and_evicts():
    m = NearestState()
    m.right(0, "a")
    m.left(10, 5, "x")
    m.right(14, "b")
    m.right(14, "a")
    assert list(m.advance(15)) == [] and list(m.advance(16)) == [("x", 14, "a")]
    m.left(30, 20, "y")
    assert list(m.advance(40)) == [] and (14, "a") in m.rights  # y still reaches back to it
    m.right(41, "c")
    assert list(m.advance(60)) == [("y", 41, "c")]
    for at in range(61, 200):
        m.right(at, "d")
        assert list(m.advance(at)) == []
    assert len(m.rights) < 60


def test_random_watermarks_against_brute_force():
    r = random.Random(9)
    for _ in range(200):
        lefts = [(f"p{i}", "q", r.randrange(60), r.randrange(15)) for i in range(12)]
        rights = sorted({(f"k{r.randrange(9)}", "q", r.randrange(60)) for _ in range(12)})
        m, got = NearestState(), []
        for at, side, x in sorted([(x[2], 1, x) for x in lefts] + [(x[2], 0, x) for x in rights]):
            (m.left(at, x[3], (x[0], "q", at)) if side else m.right(at, x[0]))
            got += m.advance(at)
        got += m.end()
        assert {(*row, key, key_at) for row, key_at, key in got} == brute(lefts, rights)


def test_nulls_negative_windows_days_and_empty_tables(spark):
    t = datetime(2000, 1, 1, 23)
    m = spark.createDataFrame([("p", "q", t, 1, 1), ("p", "q", t, 1, 1), (None, "q", t, 1, 1), ("n", "q", None, 1, 1), ("m", "q", t, -1, 1), ("w", "q", t, None, 1)], "private_id string, anchor_qid string, private_ts timestamp_ntz, window_days int, days_apart int")
    e = spark.createDataFrame([("e2", t + timedelta(hours=2), ["q", None]), ("e1", t - timedelta(hours=2), ["q"]), ("e0", None, ["q"]), ("e3", t, None), ("e4", t, [])], "doc_id string, event_ts timestamp_ntz, qids array<string>")
    got = match_events(m, e).collect()
    assert [tuple(r)[:5] for r in got] == [("p", "q", "e1", 0, 0)]
    assert tuple(match_events(m, e.filter("doc_id = 'e2'")).first())[2:5] == ("e2", 1, 1)
    assert match_events(m.limit(0), e).count() == 0 and match_events(m, e.limit(0)).count() == 0


def test_stream_gives_what_the_table_join_gives(spark, tmp_path):
    r = random.Random(8)
    start = datetime(2020, 1, 1)
    day = lambda n: start + timedelta(days=n)
    lefts = [(f"p{i}", r.choice("ab"), day(r.randrange(60)), r.choice([1, 5]) * DAY) for i in range(60)]
    rights = [(f"k{i}", r.choice("ab"), day(r.randrange(60))) for i in range(60)]
    ls, rs = "private_id string, qid string, ts timestamp, tolerance bigint", "key string, qid string, ts timestamp"
    for n, low in enumerate(range(0, 60, 20)):
        part = lambda rows, i: [x for x in rows if low <= (x[i] - start).days < low + 20]  # noqa: B023, E731
        spark.createDataFrame(part(lefts, 2), ls).coalesce(1).write.parquet(f"{tmp_path}/l/{n}")
        spark.createDataFrame(part(rights, 2), rs).coalesce(1).write.parquet(f"{tmp_path}/r/{n}")
    # a row far ahead moves the watermark past every horizon
    spark.createDataFrame([("end", "z", day(400), 0)], ls).coalesce(1).write.parquet(f"{tmp_path}/l/9")
    read = lambda s, side: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{side}")
    q = nearest_stream(read(ls, "l"), read(rs, "r"), 5, "70 days").writeStream.format("memory").queryName("near").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    micro = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    want = brute([(p, k, micro(t), tol) for p, k, t, tol in lefts], [(k, e, micro(t)) for k, e, t in rights])
    assert {tuple(x) for x in spark.table("near").collect()} == want
