"""Round trips of stores and text formats, codecs and rate maps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import metadata as md
from kinweave.functions.ratemap import RateMap, read_hapmap
from kinweave.operators import transforms as tr
from kinweave.sources import arrays, formats, store
from tests.brute import Plain, build


def test_parquet_and_text(spark, weave, tmp_path):
    store.save(weave, str(tmp_path / "g"))
    back = store.load(spark, str(tmp_path / "g"))
    assert back.sequence_length == 12 and tr.difference(weave, back) == {}
    assert store.load(spark, str(tmp_path / "g"), skip=("sites",)).sites.count() == 0
    folder = str(tmp_path / "text")
    store.dump_text(weave, folder, precision=3)
    t = store.load_text(spark, 12.0, **{k: f"{folder}/{k}.txt" for k in ("nodes", "edges", "sites", "mutations")})
    for k in ("edges", "sites", "mutations"):
        a, b = getattr(tr.sort(weave), k).drop("metadata"), getattr(t, k).drop("metadata")
        assert a.exceptAll(b).count() == 0 and b.count() == a.count()
    (tmp_path / "e.txt").write_text("left right parent child\n0 1 4 0,1\n0.5  1 5 2,3,\n")
    e = store.parse_table(spark, "edges", str(tmp_path / "e.txt"), strict=False)
    assert [tuple(r) for r in e.select("left", "parent", "child").orderBy("id").collect()] == [(0, 4, 0), (0, 4, 1), (0.5, 5, 2), (0.5, 5, 3)]


def test_arrays(spark, lone, tmp_path):
    p = str(tmp_path / "x.trees")
    arrays.write_trees(lone, p, "own.trees")
    back = arrays.read_trees(spark, p, arrays.format_name(p))
    with pytest.raises(ValueError):
        arrays.read_trees(spark, p, "other")
    assert arrays.read_trees(spark, p, skip_tables=True).edges.count() == 0
    assert tr.difference(tr.sort(lone), back, ["edges", "sites", "mutations"]).keys() <= {"edges", "sites", "mutations"}
    for t in ("nodes", "edges", "sites", "mutations"):
        a, b = getattr(tr.sort(lone), t).drop("metadata"), getattr(back, t).drop("metadata")
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    s = arrays.read_store(p)
    assert s["mutations/time"].view("uint64")[0] == arrays.UNKNOWN_TIME and s["indexes/edge_insertion_order"].tolist() == sorted(range(6))


def test_vcf_fasta_nexus_ms(spark, lone):
    g = build(spark, 10, [0, 0, 0, 0, 1, 2, 3], range(4), [(0, 10, 4, 0), (0, 10, 4, 3), (0, 6, 5, 1), (0, 10, 5, 4), (6, 10, 6, 1), (0, 10, 6, 2), (0, 10, 6, 5)], [(1, "A"), (4.5, "A"), (8, "A")], [(0, 4, -1, None, "T"), (1, 1, -1, None, "T"), (2, 5, -1, None, "T")])
    p = Plain(g)
    rows_ = [["01"[a != "A"] for a in row] for _, row in sorted(p.genotypes().items())]
    head, rows = formats.vcf_lines(g, ploidy=2)
    assert head[-1].endswith("FORMAT\tsample_0\tsample_1")
    lines = [r["line"].split("\t") for r in rows.orderBy("site").collect()]
    assert lines[0][:9] == ["1", "1", "0", "A", "T", ".", "PASS", ".", "GT"] and [x[1] for x in lines] == ["1", "4", "8"]
    assert [x[9:] for x in lines] == [[f"{r[0]}|{r[1]}", f"{r[2]}|{r[3]}"] for r in rows_]
    f = {r["sample"]: r["record"] for r in formats.fasta(g.with_tables(sites=g.sites.withColumn("position", F.floor("position").cast("double"))), "C" * 10, 4).collect()}
    for i in range(4):
        text = list("C" * 10)
        for x, row in zip((1, 4, 8), sorted(p.genotypes().items())):
            text[x] = row[1][i]
        text = "".join(text)
        assert f[i] == "\n".join([f">n{i}", text[:4], text[4:8], text[8:]])
    nx = list(formats.nexus(g, 2))
    assert nx[3] == "  TAXLABELS n0 n1 n2 n3;" and nx[6].startswith("  TREE t0.00^6.00 = [&R] (") and len(nx) == 6 + len(p.trees) + 1
    ms = list(formats.ms_lines(g))
    assert ms[0] == "ms 4 1" and ms[4] == "segsites: 3" and ms[6:] == ["".join(r[i] for r in rows_) for i in range(4)]
    assert formats.networkx_dict(lone).count() == 3


def test_fam(spark, tmp_path):
    (tmp_path / "a.fam").write_text("F a 0 0 1 0\nF b 0 0 2 0\nF c a b 1 0\n")
    got = {r["name"]: r["parents"] for r in formats.parse_fam(spark, str(tmp_path / "a.fam")).collect()}
    assert got == {"a": [-1, -1], "b": [-1, -1], "c": [0, 1]}


def test_codecs(spark):
    s = {"codec": "struct", "type": "object", "properties": {"b": {"type": "array", "items": {"type": "number", "binaryFormat": "d"}, "arrayLengthFormat": "H"}, "a": {"type": "number", "binaryFormat": "i"}, "c": {"type": "string", "binaryFormat": "4s"}, "z": {"type": "string", "binaryFormat": "c", "nullTerminated": True}}}
    v = {"a": -3, "b": [1.5, 2.5], "c": "xy", "z": "end"}
    c = md.codec_of(s)
    assert c.encode(v)[:4] == b"\xfd\xff\xff\xff" and c.decode(c.encode(v)) == v
    both = {"codec": "json+struct", "json": {"type": "object"}, "struct": {k: x for k, x in s.items() if k != "codec"}}
    w = v | {"name": "é"}
    raw = md.codec_of(both).encode(w)
    assert raw[:4] == b"JBLB" and md.codec_of(both).decode(raw) == w
    j = {"codec": "json", "type": "object", "properties": {"q": {"default": 5}}}
    assert md.codec_of(j).decode(b"") == {"q": 5} and md.codec_of(None).decode(b"x") == b"x"
    df = spark.createDataFrame([(bytearray(c.encode(v)),), (bytearray(c.encode(v | {"a": 9})),)], "m binary")
    assert [r["x"]["a"] for r in df.select(md.decoded(F.col("m"), s, "a int, c string").alias("x")).collect()] == [-3, 9]
    js = spark.createDataFrame([(bytearray(b'{"k": 1}'),), (bytearray(b""),), (None,)], "m binary")
    assert [r["x"]["k"] for r in js.select(md.decoded(F.col("m"), {"codec": "json"}, "k int").alias("x")).collect()] == [1, None, None]
    assert [r[0] for r in js.select(md.field_of(F.col("m"), "$.k", 0)).collect()] == ["1", "0", "0"]
    with pytest.raises(ValueError):
        md.codec_of({"codec": "nope"})


def test_ratemap(spark, tmp_path):
    r = RateMap([0, 10, 20, 30], [0.1, math.nan, 0.4])
    assert r.total_mass == pytest.approx(5) and r.mean_rate == pytest.approx(0.25) and r.num_missing_intervals == 1 and len(r) == 3
    assert r.get_cumulative_mass([5, 15, 25]).tolist() == pytest.approx([0.5, 1, 3]) and r.find_index([0, 10, 29]).tolist() == [0, 1, 2]
    assert r.slice(5, 25, trim=True) == RateMap([0, 5, 15, 20], [0.1, math.nan, 0.4]) and r.slice(5, 25).num_missing_intervals == 3
    df = spark.createDataFrame([(0.0,), (12.0,), (29.0,), (30.0,), (None,)], "x double")
    assert [x[0] for x in df.select(r.rate_at(F.col("x"))).collect()] == [0.1, None, 0.4, None, None]
    assert r.to_frame(spark).count() == 3 and np.isnan(r.get_rate([11])[0])
    (tmp_path / "h.txt").write_text("chr pos rate map\nc 10 2.0 0.0\nc 30 4.0 0.4\n")
    h = read_hapmap(spark, str(tmp_path / "h.txt"), 50)
    assert h.position.tolist() == [0, 10, 30, 50] and h.rate[1] == pytest.approx(2e-8) and np.isnan(h.rate[[0, 2]]).all()
