"""Sources in time, orders, discovery, conformance, timings, and containers to files."""

import glob
import struct

import pytest
from pyspark.sql import functions as F

from splatspark.operators import bounds, sequence_codec
from splatspark.plans.views import tracks
from splatspark.sources import container, decompress, ply, plugins
from splatspark.sources.registry import Format, Registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark):
    return plugins.TableSource(tracks(spark, SF).where("gid < 40").cache(), 12)


def test_conformance(source):
    assert set(plugins.conformance(source).values()) == {"pass"}
    assert plugins.conformance(object()) == {"protocol": "no protocol is kept"}

    class Broken(plugins.TableSource):
        def frame(self, number):
            raise OSError("gone")

    assert plugins.conformance(Broken(source.splats, 12))["frames"] == "OSError: gone"


def test_batch_is_each_time(spark, source):
    times = [-1.0, 0.0, 2.25, 7.0, 10.5, 99.0]
    batch = source.evaluate_batch(spark.createDataFrame([(t,) for t in times], "t double")).toPandas()
    one = source.splats.drop("qw", "qx", "qy", "qz", "s0", "s1", "s2", "opacity", "active")
    for t in times:
        want = plugins.TableSource(one, 12).evaluate(t).toPandas().sort_values("gid")
        got = batch[batch.t == t].sort_values("gid")
        assert abs(got[["x", "y", "c0"]].to_numpy() - want[["x", "y", "c0"]].to_numpy()).max() < 1e-12


def test_orders(source):
    for name in plugins.ORDERS:
        got = plugins.ordered(source.splats, name).groupBy("frame").agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("most")).collect()
        assert all(r.n == 40 and r.most == 39 for r in got)
    with pytest.raises(LookupError):
        plugins.ordered(source.splats, "nothing")


def test_discovery(tmp_path):
    (tmp_path / "good.py").write_text("from splatspark.sources.registry import Format\n\ndef register(r):\n    r.add(Format('mine', ('.mine',)))\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError('no')\n")
    (tmp_path / "_hidden.py").write_text("raise RuntimeError('no')\n")
    registry = Registry()
    registry.add(Format("other", (".o",)))
    assert plugins.discover(registry, str(tmp_path)) == {"bad": "error: RuntimeError: no", "good": "mine"}
    assert registry.find("a.MINE").name == "mine"


def test_timings():
    t = plugins.Timings()
    with t.stage("a"):
        pass
    t.record("b", 2.0)
    t.record("b", 3.0)
    stages, total = t.stop()
    assert stages["b"] == 5.0 and stages["a"] >= 0 and total >= stages["a"]


def test_decompress(spark, source, tmp_path):
    rows = source.splats
    order = sequence_codec.ranks(rows)
    frames = sequence_codec.encoded(rows, bounds.ranges(rows), order, order.count()).withColumn("path", F.lit("dir/scene.gsav"))
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "scene.gsav").write_bytes(sequence_codec.files(frames, bounds.ranges(rows)).first().content)
    decompress.main([str(tmp_path / "in"), str(tmp_path / "out"), "--frames", "2", "4"], spark)
    names = sorted(glob.glob(f"{tmp_path}/out/*.ply"))
    assert [n[-11:] for n in names] == ["e_00002.ply", "e_00003.ply", "e_00004.ply"]
    got = ply.parse(open(names[0], "rb").read())
    want = rows.where("frame = 2 AND active").join(order, "gid").orderBy("rank").toPandas()
    assert len(got["x"]) == len(want)
    assert abs(got["x"] - want["x"].to_numpy()).max() < 1e-3 and abs(got["s0"] - want["s0"].to_numpy()).max() < 2e-2


def test_ivf():
    frames = [b"abc", b"", b"12345"]
    data = b"DKIF" + struct.pack("<HH", 0, 32) + bytes(24) + b"".join(struct.pack("<IQ", len(x), 3 * i) + x for i, x in enumerate(frames))
    assert container.ivf_frames(data) == [(3 * i, x) for i, x in enumerate(frames)]
    for bad in (data[:-1], b"RIFF" + data[4:], b"DKIF"):
        with pytest.raises(ValueError):
            container.ivf_frames(bad)
