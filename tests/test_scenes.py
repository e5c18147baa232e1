"""Scene documents: a round trip, defaults, text scenes in JSON, and what fails the read."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.sources import scenes, timed_text


def scene(**more):
    return {"scene": 1, "orientation": {"yaw_deg": 90, "roll_rad": 0.5}, "objects": [
        {"name": "voix é", "bed": ["lr", "c"], "automation": [{"t": 0, "x": 0.5, "y": 0, "z": 1, "interp": "hold"}, {"t": 1.5, "x": 1, "y": 0.25, "z": 0, "gain": 0.5, "lfe": 0.1}]},
        {"automation": [{"t": 2, "x": 0, "y": 0, "z": 0}]},
        {"name": "empty", "automation": []},
    ]} | more


def put(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder)


def plain(rows):
    return sorted((tuple(r)[1:] for r in rows.collect()), key=str)


def test_round_trip(spark, tmp_path):
    rows = scenes.read_scene_json(spark, put(tmp_path / "a", "s.json", scene()), "scene")
    got = plain(rows)
    turn = (math.pi / 2, 0.0, 0.5)
    assert got == sorted([(*turn, 0, "voix é", ["lr", "c"], 0.0, 0.5, 0.0, 1.0, 1.0, 0.0, "hold"), (*turn, 0, "voix é", ["lr", "c"], 1.5, 1.0, 0.25, 0.0, 0.5, 0.1, "linear"), (*turn, 1, "", [], 2.0, 0.0, 0.0, 0.0, 1.0, 0.0, "linear"), (*turn, 2, "empty", [], None, None, None, None, None, None, None)], key=str)
    value = scenes.scene_documents(rows, "scene").first().value
    assert plain(scenes.read_scene_json(spark, put(tmp_path / "b", "s.json", value), "scene")) == got
    assert list(json.loads(value)) == ["scene", "orientation", "objects"]


def test_text_scenes_in_json(spark, tmp_path):
    text = timed_text.read_scene(spark, put(tmp_path / "t", "s.txt", "0 0 0.1 0.2 0.3\n1 0.5 1 1 1 0.25 0.5 # low\n0 2 0.4 0.5 0.6\n"))
    asked = text.select("file", *(F.lit(0.0).alias(f"{a}_rad") for a in scenes.ANGLES), "object", F.lit("").alias("name"), F.array().cast("array<string>").alias("bed"), "time_s", "x", "y", "z", "gain", "lfe_send", F.lit("linear").alias("interp"))
    back = scenes.read_scene_json(spark, put(tmp_path / "j", "s.json", scenes.scene_documents(asked, "scene").first().value), "scene")
    columns = ["object", "time_s", "x", "y", "z", "gain", "lfe_send"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, text.select(columns).collect()))


P = {"t": 0, "x": 0, "y": 0, "z": 0}


@pytest.mark.parametrize(
    "bad",
    [
        "{", "[]", scene(scene=2), scene(extra=1), scene(objects=None), scene(orientation={"yaw": 1}), scene(orientation={"yaw_rad": 1, "yaw_deg": 1}), scene(orientation=3),
        scene(objects=[{"name": "x"}]), scene(objects=[{"automation": [], "colour": 1}]), scene(objects=[{"automation": [], "bed": ["front"]}]), scene(objects=[{"automation": [], "name": 7}]), scene(objects=[3]),
        scene(objects=[{"automation": [{"t": 0, "x": 0, "y": 0}]}]), scene(objects=[{"automation": [P | {"w": 1}]}]), scene(objects=[{"automation": [P | {"interp": "jump"}]}]), scene(objects=[{"automation": [P | {"x": "0"}]}]), scene(objects=[{"automation": [P | {"gain": True}]}]), scene(objects=[{"automation": [4]}]),
    ],
)
def test_what_is_no_scene_fails(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a scene"):
        scenes.read_scene_json(spark, put(tmp_path / "x", "s.json", bad), "scene").collect()
