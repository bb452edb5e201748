"""Files of our own making, read through the engine and compared with the arrays they were made from."""

import random
import zlib

import numpy as np
import pytest

from rasterlake.functions import codec
from rasterlake.model import CorruptObject, ObjectChanged, Options, StaleSidecar, TransportError, Unsupported, normalise
from rasterlake.operators import tiles
from rasterlake.plans.driver_tables import MemoryTransport
from rasterlake.reader import Lake, Stats
from rasterlake.sources import catalog, restart
from rasterlake.sources.tiff import describe, write
from rasterlake.sources.transport import FileTransport, HttpTransport, Range, as_range, checked

rng = np.random.default_rng(3)


def image(h, w, dtype="u2"):
    if dtype == "f4":
        return (rng.random((h, w)) * 1000).astype("f4")
    return np.cumsum(rng.integers(0, 400, (h, w)) % 7, axis=1).astype(dtype)


IMAGES = {
    "p1.tif": (image(1024, 1024), 256, {"predictor": 1}),
    "p2.tif": (image(1024, 1024), 256, {"predictor": 2}),
    "i2.tif": (image(300, 500, "i2") - 900, 256, {"predictor": 2}),
    "p3.tif": (image(700, 900, "f4"), 256, {"predictor": 3}),
    "big.tif": (image(1024, 1024), 512, {"predictor": 2, "big": True}),
    "sparse.tif": (image(700, 900, "u1"), 256, {"predictor": 2, "empty": {0, 5}, "nodata": 255.0}),
}
FILES = {k: write([a, a[::2, ::2].copy()], t, **o) for k, (a, t, o) in IMAGES.items()}
for _k, _blocks in (("sparse.tif", (0, 5)),):
    for _b in _blocks:
        IMAGES[_k][0][_b // 4 * 256 : _b // 4 * 256 + 256, _b % 4 * 256 : _b % 4 * 256 + 256] = 255
FILES |= {"lzw.tif": write([image(300, 300)], 256, compression=5), "be.tif": write([image(300, 300)], 256, order=">"), "no.tif": b"nothing at all here"}


@pytest.fixture(scope="module")
def lake(spark):
    t = MemoryTransport(FILES)
    objects = catalog.scan(spark.createDataFrame([(k,) for k in FILES], "key string"), t).cache()
    return Lake(spark, objects, t, Options(min_fetch=512))


def expected(key, level, x, y, w, h, fill=0.0):
    a = IMAGES[key][0]
    out = np.full((h, w), fill)
    if level:
        a = describe_level(key)
    ys, xs = slice(max(0, y), min(a.shape[0], y + h)), slice(max(0, x), min(a.shape[1], x + w))
    out[ys.start - y : ys.stop - y, xs.start - x : xs.stop - x] = a[ys, xs]
    return out


def describe_level(key):
    """Level 1 by a plain decode of all its tiles."""
    d = FILES[key]
    lv = describe(lambda s, n: d[s : s + n], len(d))["levels"][1]
    t = lv["blockw"]
    out = np.zeros((lv["nby"] * t, lv["nbx"] * t))
    for b, (o, n) in enumerate(zip(lv["offsets"], lv["bytecounts"])):
        raw = np.frombuffer(zlib.decompress(d[o : o + n]), np.uint8).reshape(t, -1)
        out[b // lv["nbx"] * t :, :][:t, b % lv["nbx"] * t :][:, :t] = codec.undo_predictor(raw, lv["dtype"], t, lv["predictor"])
    return out[: lv["height"], : lv["width"]]


REQUESTS = [(k, 0, *r) for k in ("p1.tif", "p2.tif", "big.tif") for r in ((300, 20, 1, 1), (1023, 1023, 1, 1), (0, 0, 100, 100), (250, 250, 300, 12), (900, 900, 124, 124), (255, 256, 1, 1))]
REQUESTS += [("i2.tif", 0, 490, 250, 10, 50), ("p3.tif", 0, 250, 200, 300, 400), ("sparse.tif", 0, 0, 0, 700, 600), ("p2.tif", 1, 100, 100, 400, 300), ("big.tif", 1, 511, 0, 1, 512), ("sparse.tif", 1, 3, 4, 5, 6)]


def test_windows_points_and_overviews(lake):
    for r, got in zip(REQUESTS, lake.read(REQUESTS)):
        assert np.array_equal(got, expected(*r)), r
    assert lake.stats.requests > 0 and lake.stats.bytes < sum(map(len, FILES.values()))
    assert np.array_equal(lake.sample([(k, x, y) for k, _, x, y, *_ in REQUESTS[:5]]), [expected(k, 0, x, y, 1, 1)[0, 0] for k, _, x, y, *_ in REQUESTS[:5]])


def test_fewer_bytes_for_shallow_rows_and_merging_by_cost(lake, spark):
    plan = {r.deep: r.prefix for r in lake.plan([("big.tif", 0, 5, y, 1, 1) for y in (3, 500)][:1]).collect()}
    whole = describe(lambda s, n: FILES["big.tif"][s : s + n], len(FILES["big.tif"]))["levels"][0]["bytecounts"][0]
    assert plan[3] == int(min(whole, max(512, whole * (4 / 512 + 0.03))))
    tops = [("p2.tif", lv, x, y, 1, 1) for lv, n in ((0, 1024), (1, 512)) for x in range(0, n, 256) for y in range(0, n, 256)]
    job = lake.plan(tops)
    n = [tiles.coalesce(job, Options(rtt_s=r, bandwidth_mbps=b)).count() for r, b in ((0, 100), (0.0001, 10), (0.05, 100), (1, 0))]
    assert n == sorted(n, reverse=True) and n[0] > n[-1] >= 2  # levels are never joined
    sums = tiles.coalesce(job, Options()).selectExpr("sum(job_bytes)", "sum(n_jobs)").first()
    assert sums[0] == job.selectExpr("sum(prefix)").first()[0] and sums[1] == 16 + 4
    with pytest.raises(Unsupported):
        Lake(spark, lake.objects, lake.transport, Options(max_fetch_bytes=10)).read([("p1.tif", 0, 0)])


def test_refusals(lake):
    why = {k: lake.why_unsupported(k) for k in ("p1.tif", "lzw.tif", "be.tif", "no.tif", "absent.tif")}
    assert why["p1.tif"] is None and "Deflate" in why["lzw.tif"] and "endian" in why["be.tif"] and why["no.tif"].startswith("not described") and why["absent.tif"] == "not in the catalog"
    assert lake.why_unsupported("p1.tif", 2) == "no such level"
    for bad in ([("p1.tif", 0, 1000, 1000, 64, 64)], [("p1.tif", 0, 0, 0, 0, 5)], [("lzw.tif", 0, 0)], [("p1.tif", -1, 0, 0, 1, 1)]):
        with pytest.raises(Unsupported):
            lake.read(bad)
    got = lake.read([("p1.tif", 0, 1000, 1000, 64, 64)], allow_partial=True)[0]
    assert np.array_equal(got[:24, :24], expected("p1.tif", 0, 1000, 1000, 24, 24)) and not got[24:].any() and not got[:, 24:].any()
    ok, no = lake.split([("p1.tif", 0, 0), ("lzw.tif", 1, 1), ("p2.tif", 2, 2)])
    assert [r.req_id for r in ok.orderBy("req_id").collect()] == [0, 2] and no.first().req_id == 1
    seen = lake.read_any([("lzw.tif", 1, 1), ("p1.tif", 5, 5)], fallback=lambda *r: np.full((1, 1), 7.0))
    assert seen[0][0, 0] == 7 and seen[1][0, 0] == IMAGES["p1.tif"][0][5, 5] and lake.stats.delegated == 1
    for bad in (("a", 1), ("", 0, 0), ("a", 1.5, 0), ("a", True, 0), (5, 0, 0)):
        with pytest.raises(ValueError):
            normalise(bad)
    for kw in ({"margin": -1}, {"min_fetch": 0}, {"workers": True}, {"workers": 0}, {"rtt_s": -1}, {"max_block_bytes": 0}):
        with pytest.raises(ValueError):
            Options(**kw)


def test_changed_and_broken_objects(spark, lake):
    other = dict(FILES) | {"p1.tif": FILES["p1.tif"] + b"x"}
    with pytest.raises(ObjectChanged):
        Lake(spark, lake.objects, MemoryTransport(other)).read([("p1.tif", 0, 0)])
    d = FILES["p2.tif"]
    start = describe(lambda s, n: d[s : s + n], len(d))["levels"][0]["offsets"][0]
    broken = d[:start] + bytes(50) + d[start + 50 :]
    with pytest.raises(CorruptObject):
        Lake(spark, lake.objects, MemoryTransport(dict(FILES) | {"p2.tif": broken})).read([("p2.tif", 0, 0)])
    closed = Lake(spark, lake.objects, lake.transport)
    with closed:
        pass
    with pytest.raises(RuntimeError):
        closed.read([("p1.tif", 0, 0)])


def test_mutated_headers_are_refused_or_read(spark):
    d = FILES["p2.tif"]
    first = describe(lambda s, n: d[s : s + n], len(d))["header_bytes"]
    random.seed(1)
    for _ in range(60):
        m = bytearray(d)
        for _ in range(random.randint(1, 11)):
            m[random.randrange(first)] = random.randrange(256)
        try:
            describe(lambda s, n: bytes(m[s : s + n]), len(m))
        except CorruptObject:
            pass


def test_restart_points_give_the_same_values(spark, lake, tmp_path):
    big = {"big.tif": write([IMAGES["big.tif"][0]], 512, predictor=2, level=1)}
    t = MemoryTransport(big)
    objects = catalog.scan(spark.createDataFrame([("big.tif",)], "key string"), t).cache()
    plain = Lake(spark, objects, t, Options(min_fetch=64))
    need = spark.createDataFrame([("big.tif", 0, b) for b in range(4)], "key string, level int, block int")
    points = restart.build(need, objects, t, span=65536).cache()
    assert points.count() > 0 and restart.usable(points, objects).count() == points.count()
    fast = Lake(spark, objects, t, Options(min_fetch=64), restart.usable(points, objects))
    deep = [("big.tif", 0, 5, 500, 9, 3), ("big.tif", 0, 600, 1010, 1, 1)]
    # A tile is read once: one also asked for its first row is decoded from its start, and near ranges
    # merge into one from there to the last tile, which the restart point of that last one cannot shorten.
    for req, restarted, merged in ((deep, 2, False), (deep + [("big.tif", 0, 0, 0, 4, 4)], 1, True)):
        plain.stats, fast.stats = Stats(), Stats()
        a, b = plain.read(req), fast.read(req)
        assert all(np.array_equal(x, y) for x, y in zip(a, b)) and fast.stats.restarted == restarted and fast.stats.sidecars_loaded == 1
        assert (fast.stats.requests, fast.stats.bytes) == (1, plain.stats.bytes) if merged else fast.stats.bytes < plain.stats.bytes
    assert restart.index_bytes(points).first().bytes > 0
    from pyspark.sql import functions as F

    for change in ({"identity": F.lit("etag:other")}, {"source_size": F.col("source_size") + 1}, {"window_crc": F.col("window_crc") + 1}, {"bits": F.lit(9)}):
        assert restart.usable(points.withColumns(change), objects).count() == 0
        # a lake falls back by itself, and counts why
        other = Lake(spark, objects, t, Options(min_fetch=64), points.withColumns(change))
        assert all(np.array_equal(x, y) for x, y in zip(other.read(deep), plain.read(deep))) and other.stats.restarted == 0
        assert (other.stats.stale_sidecars, other.stats.invalid_sidecars) == ((1, 0) if {"identity", "source_size"} & set(change) else (0, 1))
    assert restart.missing(need, points).count() == 4 - points.select("block").distinct().count()
    # the caller's own name for the content
    named = spark.createDataFrame([("big.tif", "sha:1")], "key string, identity string")
    own = Lake(spark, objects, t, Options(min_fetch=64), points.withColumn("identity", F.lit("sha:1")), named)
    assert np.array_equal(own.read(deep)[0], plain.read(deep)[0]) and own.stats.restarted == 2
    # as files and back
    written = restart.write_sbx(points, str(tmp_path)).collect()
    (tmp_path / "bad.sbx").write_bytes(b"SBX3 but broken")
    back = restart.read_sbx(spark, str(tmp_path), str(tmp_path))
    assert [r.key for r in written] == ["big.tif"] and back.filter("error is not null").first().key == "bad"
    cols = ["key", "block", "seq", "out", "in_byte", "bits", "window_crc", "source_size", "layout_hash", "identity"]
    assert sorted(map(tuple, back.filter("error is null").select(cols).collect())) == sorted(map(tuple, points.select(cols).collect()))


def test_restart_codec():
    data = zlib.compress(image(512, 512).tobytes(), 1)
    points, out = codec.restart_points(data, 65536)
    assert points and out == zlib.decompress(data)
    for p in points:
        assert codec.inflate_at(data[p.in_byte - (p.bits > 0) :], p.bits, p.window, 1000) == out[p.out : p.out + 1000]
    assert codec.read_range(data, points, 300000, 300100) == out[300000:300100] and codec.read_range(data, points, 5, 9) == out[5:9]
    used = codec.consumed_at(data, [1000, 200000, len(out)])
    assert used == sorted(used) and len(zlib.decompressobj().decompress(data[: used[1]], 200000)) == 200000
    fetched, decoded = codec.range_cost(data, points, 300000, 300100)
    p = codec.nearest(points, 300000)
    assert decoded == 300100 - p.out and fetched < len(data)
    kept = restart.to_sbx({3: points, 1: points[:1]}, 99, "00000000000000ff", "etag:1")
    assert restart.from_sbx(kept, 99, "00000000000000ff", "etag:1") == {1: points[:1], 3: points}
    for bad in ((98, None, None), (None, "00000000000000fe", None), (None, None, "etag:2")):
        with pytest.raises(StaleSidecar):
            restart.from_sbx(kept, *bad)
    random.seed(2)
    for _ in range(24):
        m = bytearray(kept)
        m[random.randrange(80)] ^= random.randrange(1, 256)
        try:
            restart.from_sbx(bytes(m))
        except (ValueError, StaleSidecar):
            pass
    side = restart.Sidecar(kept)
    assert side.best(3, points[-1].out) == points[-1] and side.best(3, 0) is None and side.points(9) == []
    old = b"SBX2" + kept[4:28] + kept[30 + 6 : 30 + 6 + 32]  # no identity: of an unknown version
    with pytest.raises(StaleSidecar):
        restart.Sidecar(b"SBX2" + bytes(24)).check(identity="etag:1")
    with pytest.raises(ValueError):
        restart.Sidecar(old[:20])
    h = 0xCBF29CE484222325
    for v in (1, 2, 3, 4):
        for b in v.to_bytes(8, "little"):
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert codec.layout_fingerprint([1, 2], [3, 4]) == f"{h:016x}"


def test_rows_come_back_from_a_cut_off_tile():
    a = image(256, 256)
    data = zlib.compress(codec.apply_predictor(a, 2), 6)
    for row in (0, 10, 255):
        used = codec.consumed_at(data, [(row + 1) * 512])[0]
        raw = codec.inflate_prefix(data[:used], (row + 1) * 512)
        back = codec.undo_predictor(np.frombuffer(raw, np.uint8).reshape(-1, 512), "uint16", 256, 2)
        assert np.array_equal(back, a[: row + 1]) and (row == 255 or used < len(data))


def test_predictors_round_trip():
    for dtype, p in (("u1", 2), ("u2", 2), ("i4", 2), ("u4", 2), ("f4", 3), ("f8", 3), ("u2", 1)):
        a = (rng.random((5, 64)) * 200).astype(dtype)
        back = codec.undo_predictor(np.frombuffer(codec.apply_predictor(a, p), np.uint8).reshape(5, -1), {"u": "uint", "i": "int", "f": "float"}[dtype[0]] + str(8 * int(dtype[1])), 64, p)
        assert np.array_equal(a, back), dtype


def test_sources(spark, tmp_path, lake):
    (tmp_path / "a.tif").write_bytes(FILES["p1.tif"])
    spark.dataSource.register(catalog.CogIndex)
    row = spark.read.format("cogindex").option("root", str(tmp_path)).option("keys", "a.tif,b.tif").load().orderBy("key").collect()
    assert row[0]["size"] == len(FILES["p1.tif"]) and len(row[0]["levels"]) == 2 and row[1].error.startswith("TransportError")
    catalog.write_json(lake.objects, str(tmp_path / "index"))
    assert sorted(map(str, catalog.read_json(spark, str(tmp_path / "index")).collect())) == sorted(map(str, lake.objects.collect()))
    seeded = catalog.scan(spark.createDataFrame([("p1.tif",), ("p2.tif",)], "key string"), lake.transport, seed=lake.objects.filter("key = 'p1.tif'"))
    assert seeded.count() == 2
    assert FileTransport(str(tmp_path)).get_range("a.tif", 0, 4).data == FILES["p1.tif"][:4]
    for url in ("ftp://a", "http://", "http://a?b", "http://u:p@a", "a/b"):
        with pytest.raises(ValueError):
            HttpTransport(url)
    assert as_range((b"ab", 2)) == Range(b"ab", 2)
    with pytest.raises(TypeError):
        as_range(("ab", 2))
    with pytest.raises(Unsupported):
        checked(Range(b"", 5), 6, None, "k")


def test_http_transport():
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    data, fails = bytes(range(256)) * 40, [503]

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_):
            pass

        def do_GET(self):
            if self.path != "/store/a%20b.tif":
                return self.send(403, b"")
            if fails:
                return self.send(fails.pop(), b"")
            a, z = map(int, self.headers["Range"][6:].split("-"))
            z = min(z, len(data) - 1)
            self.send(206, data[a : z + 1], ("Content-Range", f"bytes {a}-{z}/{len(data)}"), ("ETag", '"t"'))

        def send(self, code, body, *headers):
            self.send_response(code)
            for h in (*headers, ("Content-Length", str(len(body)))):
                self.send_header(*h)
            self.end_headers()
            self.wfile.write(body)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    t = HttpTransport(f"http://127.0.0.1:{server.server_port}/store", backoff_s=0.01)
    assert t.get_range("a b.tif", 10, 5) == Range(data[10:15], len(data), 'etag:"t"', 2)
    assert t.get_range("a b.tif", len(data) - 3, 50).data == data[-3:]
    with pytest.raises(TransportError):
        t.get_range("secret", 0, 5)
    server.shutdown()


def test_values_keep_their_type(spark):
    deep = (np.arange(300 * 300).reshape(300, 300) + 2**60).astype("i8")
    files = dict(FILES) | {"i8.tif": write([deep], 256)}
    t = MemoryTransport(files)
    own = Lake(spark, catalog.scan(spark.createDataFrame([(k,) for k in ("i8.tif", "p3.tif", "p1.tif", "sparse.tif")], "key string"), t), t)
    got = own.read([("i8.tif", 0, 250, 250, 20, 20), ("p3.tif", 0, 0, 0, 3, 3), ("p1.tif", 0, 0), ("sparse.tif", 0, 0, 0, 2, 2)])
    assert [a.dtype for a in got] == [np.dtype(x) for x in ("i8", "f4", "u2", "u1")] and np.array_equal(got[0], deep[250:270, 250:270])
    assert own.sample([("i8.tif", 299, 299)])[0] == deep[-1, -1]


def test_failed_requests_are_rows(spark, lake):
    other = MemoryTransport(dict(FILES) | {"p1.tif": FILES["p1.tif"] + b"x"})
    broken = Lake(spark, lake.objects, other)
    rows = broken.sample_frame([("p1.tif", 0, 0), ("p2.tif", 3, 3), ("p1.tif", 900, 900), ("p2.tif", 700, 7)]).orderBy("req_id").collect()
    assert [r.req_id for r in rows] == [0, 1, 2, 3] and [r.error is None for r in rows] == [False, True, False, True]
    assert rows[0].error.startswith("ObjectChanged") and rows[0].value is None and rows[1].value == IMAGES["p2.tif"][0][3, 3]


def test_statistics_add_up(spark, lake):
    own = Lake(spark, lake.objects, lake.transport, Options(min_fetch=512))
    own.read([("p1.tif", 0, 0), ("p1.tif", 5, 5), ("p2.tif", 1000, 1000)])
    one = own.stats.as_dict()
    assert one["blocks"] == 2 and one["groups"] == one["requests"] - one["undershoots"] == 2 and one["retries"] == 0
    assert one["gain_over_whole_blocks"] == round(one["whole_bytes"] / one["bytes"], 3) and one["blocks_per_request"] == round(2 / one["requests"], 2)
    own.read([("p1.tif", 0, 0)])
    assert own.stats.blocks == 3 and Stats().as_dict()["blocks_per_request"] is None


def test_what_cannot_be_read_goes_to_a_fallback_on_the_executors(spark, lake):
    seen = lake.read_any_frame([("lzw.tif", 1, 1), ("p1.tif", 5, 5), ("absent.tif", 0, 0)], fallback=lambda key, level, x, y, w, h: np.full((h, w), 7, "u1") if key == "lzw.tif" else 1 / 0)
    rows = {r.req_id: r for r in seen.collect()}
    assert rows[0].value == 7 and rows[1].value == IMAGES["p1.tif"][0][5, 5] and "ZeroDivisionError" in rows[2].error


def test_objects_are_described_again_after_a_failure(spark):
    bad = MemoryTransport({"p1.tif": b"not yet", "p2.tif": FILES["p2.tif"]})
    keys = spark.createDataFrame([("p1.tif",), ("p2.tif",)], "key string")
    first = Lake(spark, spark.createDataFrame(catalog.scan(keys, bad).collect(), catalog.OBJECT), MemoryTransport(FILES))
    assert not first.supports("p1.tif") and first.supports("p2.tif")
    assert first.retry().supports("p1.tif")


def test_catalogs_from_elsewhere(spark, lake, tmp_path):
    import json as _json

    records = {r.key: {k: v for k, v in r.asDict(recursive=True).items() if k != "key"} for r in lake.objects.filter("key in ('p1.tif', 'sparse.tif')").collect()}
    want = sorted(map(str, lake.objects.filter("key in ('p1.tif', 'sparse.tif')").collect()))
    assert sorted(map(str, catalog.from_index(spark, records).collect())) == want
    (tmp_path / "i.json").write_text(_json.dumps(records))
    assert sorted(map(str, catalog.from_index(spark, str(tmp_path / "i.json")).select(lake.objects.columns).collect())) == want
    d = {r.key: r for r in catalog.details(lake.objects.filter("levels is not null")).collect()}
    assert d["sparse.tif"].details[0].empty_tiles == 2 and d["p1.tif"].details[1].sum_bytes == sum(records["p1.tif"]["levels"][1]["bytecounts"])


def test_a_tile_that_very_many_ask_for_is_dealt_to_several_tasks(spark, lake, monkeypatch):
    from rasterlake import reader

    monkeypatch.setattr(reader, "ITEMS", 10)
    points = [("p1.tif", k % 200, k % 150) for k in range(100)]
    own = Lake(spark, lake.objects, lake.transport)
    assert np.array_equal(own.sample(points), [IMAGES["p1.tif"][0][y, x] for _, x, y in points]) and own.stats.blocks == 10
