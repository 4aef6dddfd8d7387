"""Whole documents and archives: what a reader of the files finds."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pigmentum.operators import archive, documents

LAYERS = (
    "pid long, scene int, z int, id string, name string, type string, x double, y double, w double, h double, visible boolean, locked boolean, opacity double, rotation double, src string, fit string, fill string, radius double,"
    " txt string, size double, weight int, family string, align string, spacing double, line_height double, upper_case boolean, t_in double, t_out double, motion array<struct<t:double,dx:double,dy:double,scale:double,opacity:double,easing:string>>"
)


def layer(pid, z, kind, **own):
    base = {"pid": pid, "scene": 1, "z": z, "id": f"i{z}", "name": f"Größe {z}", "type": kind, "x": 1.5, "y": 2.0, "w": 10.0, "h": 5.0, "visible": True, "locked": False, "opacity": 0.5, "rotation": 0.0, "radius": 3.0, "size": 20.0, "weight": 700, "family": "Inter", "align": "left", "spacing": 1.0, "line_height": 1.5, "upper_case": True}
    base |= {"src": "data:image/png;base64,YWJj", "fit": "cover"} if kind in ("image", "background") else {"fill": "#102030", "txt": 'say "hi"'}
    return {n.strip().split(" ")[0]: None for n in LAYERS.split(", ") if "<" not in n} | {"motion": None} | base | own


@pytest.fixture(scope="module")
def design(spark):
    scenes = spark.createDataFrame([(1, "One", 600, 400, "#FFFFFF", "Poster"), (2, "Empty", 600, 400, "#FFFFFF", None)], "pid long, name string, width int, height int, background string, design_type string")
    rows = [layer(1, 0, "background"), layer(1, 2, "text"), layer(1, 1, "shape", fill=None)]
    names = spark.createDataFrame([], LAYERS).columns
    layers = spark.createDataFrame([tuple(x[n] for n in names) for x in rows], LAYERS)
    palette = spark.createDataFrame([(1, 1, "#0000FF", "Blue", "accent"), (1, 0, "#FF0000", "Red", "primary")], "pid long, ord int, hex string, name string, role string")
    texts = spark.createDataFrame([(1, i, f, 400, 12.0, "body") for i, f in enumerate(("Lora", "Inter", "Lora"))], "pid long, ord int, family string, weight int, size double, role string")
    return scenes, layers, palette, texts


def read(df):
    return {r.pid: json.loads(r.json) for r in df.collect()}


def test_documents_of_scenes(design):
    scenes, layers, palette, texts = design
    d = read(documents.layer_document(scenes, layers, palette))
    assert [x["kind"] for x in d[1]["layers"]] == ["textLayer", "solidColorLayer", "backgroundLayer"]
    assert d[1]["layers"][0]["text"]["color"] == {"r": 16, "g": 32, "b": 48}
    assert d[1]["analysis"] == {"designType": "Poster", "palette": ["#FF0000", "#0000FF"]}
    assert d[2]["layers"] == [] == d[2]["analysis"]["palette"]
    n = read(documents.node_document(scenes, layers, palette, texts))
    frame = n[1]["document"]["children"][0]["children"][0]
    assert [x["type"] for x in frame["children"]] == ["RECTANGLE", "RECTANGLE", "TEXT"]
    assert "color" not in frame["children"][1]["fills"][0]  # a shape without a fill
    assert n[1]["images"] == {"i0": "data:image/png;base64,YWJj"} and n[2]["images"] == {}
    assert [t["fontFamily"] for t in n[1]["styles"]["text"]] == ["Lora", "Inter"]
    p = read(documents.page_document(scenes, layers, palette, texts))
    assert p[1]["pages"][0]["elements"][2]["text"]["content"] == 'SAY "HI"'
    assert p[1]["brandKit"] == {"colors": ["#FF0000", "#0000FF"], "fonts": ["Lora", "Inter"]}
    assert p[2]["pages"][0]["elements"] == []


def test_video_archive_is_read_back(spark, design, tmp_path):
    _, layers, _, _ = design
    videos = spark.createDataFrame([(1, "a.mp4", 1280, 720, 70.0), (2, "b.mp4", 64, 48, 1.0)], "pid long, file_name string, width int, height int, duration double")
    scenes = spark.createDataFrame([(1, 1, 0.0, 65.96, "cut", [0.5], 600, 338, "data:image/jpeg;base64,eHl6"), (1, 12, 65.96, 70.0, None, None, 600, 338, "data:image/png;base64,eA==")], "pid long, scene int, start double, end double, transition string, keyframes array<double>, width int, height int, original string")
    rebuilt = spark.createDataFrame([(1, 1, bytearray(b"frame"))], "pid long, scene int, content binary")
    files = documents.video_files(videos, scenes, layers, "pid", rebuilt)
    done = {r.pid: r for r in archive.write(files, "pid", str(tmp_path / "zips")).collect()}
    assert sorted(done) == [1, 2] and not list((tmp_path / "zips").glob(".*"))
    with zipfile.ZipFile(done[1].file) as z:
        assert z.testzip() is None
        first, last = "scenes/01-0m00.0s-1m06.0s", "scenes/12-1m06.0s-1m10.0s"
        assert z.namelist() == [f"{first}/background.png", f"{first}/keyframe.jpg", f"{first}/rebuilt.png", f"{last}/keyframe.png", "timeline.json"]
        assert z.read(f"{first}/background.png") == b"abc" and z.read(f"{first}/rebuilt.png") == b"frame"
        t = json.loads(z.read("timeline.json"))
    assert [s["index"] for s in t["scenes"]] == [1, 12] and t["scenes"][1]["layers"] == [] and "transition" not in t["scenes"][1]
    assert [(x["in"], x["out"]) for x in t["scenes"][0]["layers"]] == [(0.0, 65.96)] * 3
    assert t["scenes"][0]["layers"][0]["file"] == f"{first}/background.png" and t["scenes"][0]["videoScale"] == 2.1333
    with zipfile.ZipFile(done[2].file) as z:
        assert json.loads(z.read("timeline.json"))["scenes"] == []


def test_archive_edges(spark):
    rows = [(1, f"ü{i % 40:02}", bytearray(bytes([i]) * (i * 37))) for i in range(50)] + [(1, "none", None), (2, None, bytearray(b"x"))]
    files = spark.createDataFrame(rows, "k int, path string, content binary").repartition(7)
    got = archive.parts(files, "k").orderBy("offset").collect()
    assert {r.k for r in got} == {1}
    with zipfile.ZipFile(io.BytesIO(b"".join(bytes(r.bytes) for r in got))) as z:
        assert z.testzip() is None and len(z.infolist()) == 51
        assert sorted(z.read(i) for i in z.infolist()) == sorted(bytes(c or b"") for _, p, c in rows if p)
    assert archive.parts(files.limit(0), "k").count() == 0
    many = spark.range(archive.MOST_FILES + 1).select(F.lit(1).alias("k"), F.col("id").cast("string").alias("path"), F.lit(b"").alias("content"))
    with pytest.raises(Exception, match="too many files"):
        archive.entries(many, "k").agg(F.sum("offset")).collect()
