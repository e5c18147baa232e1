"""ASS files: syllable times, field orders, singers, layers and translations."""

from tidemark.sources import karaoke

HEAD = "[Script Info]\nTitle: x\n\n[V4+ Styles]\nFormat: Name, Fontname\nStyle: Default,Arial\n\n[Events]\n"


def read(spark, tmp_path, events, head=HEAD):
    (tmp_path / "a.ass").write_text(head + events)
    return sorted(karaoke.read_ass(spark, str(tmp_path / "a.ass")).collect(), key=lambda r: r.seq)


def test_syllables_and_plain_lines(spark, tmp_path):
    rows = read(spark, tmp_path, """Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Comment: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\k50}no
Dialogue: 0,0:00:12.00,0:00:15.50,Default,,0,0,0,,Oh {\\k50}Should {\\kf30\\b1}auld {\\K80}acquaint{\\ko20}ance
Dialogue: 0,1:00:12.05,1:00:15.50,Default,,0,0,0,,A line, with {\\i1}commas{\\i0},\\Nand a break
Dialogue: 0,0:00:20.00,0:00:21.00,Default,,0,0,0,,{\\p1}m 0 0 l 1 1{\\p0}
Dialogue: 0,0:00:22.00,0:00:23.00,Default,,0,0,0,,{\\k10\\k20}two{\\k5}
Dialogue: 0,broken,0:00:23.00,Default,,0,0,0,,x
""")  # fmt: skip
    assert [(r.start_ms, r.end_ms, r.text) for r in rows] == [(12000, 15500, "Oh Should auld acquaintance"), (3612050, 3615500, "A line, with commas, and a break"), (22000, 23000, "two")]
    assert [tuple(w) for w in rows[0].words] == [("Oh ", 12000, 12000), ("Should ", 12000, 12500), ("auld ", 12500, 12800), ("acquaint", 12800, 13600), ("ance", 13600, 13800)]
    assert rows[1].words == [] and [tuple(w) for w in rows[2].words] == [("two", 22100, 22300), ("", 22300, 22350)]
    assert [r.singer for r in rows] == [None] * 3


def line(start, style, actor, text):
    return f"Dialogue: {start},0:00:{start:02}.00,0:00:{start + 1:02}.00,{style},{actor},0,0,0,,{text}\n"


def test_singers_and_lines_at_one_time(spark, tmp_path):
    events = line(2, "A", "Bob", "{\\k9}b") + line(1, "A", "Ann", "{\\k9}a") + line(3, "A", "", "{\\k9}c") + line(4, "A", "Ann", "plain")
    assert [(r.text, r.singer) for r in read(spark, tmp_path, events)] == [("b", 1), ("a", 2), ("c", None), ("plain", None)]
    events = line(1, "Low", "Ann", "{\\k9}a") + line(2, "High", "Ann", "{\\k9}b") + line(3, "Other", "Cy", "plain")
    assert [(r.text, r.singer) for r in read(spark, tmp_path, events)] == [("a", 1), ("b", 2), ("plain", None)]
    events = line(1, "A", "", "{\\k9}a") + line(1, "A", "", "{\\k9}a") + line(1, "T", "", "translated") + line(1, "A", "", "also") + line(2, "T", "", "x") + line(2, "A", "", "y") + line(3, "A", "", "z") + line(4, "T", "", "w")
    assert [r.text for r in read(spark, tmp_path, events)] == ["a", "also", "y", "z", "w"]
    moved = HEAD + "Format: Start, End, Text\n"
    assert [(r.start_ms, r.text, r.style) for r in read(spark, tmp_path, "Dialogue: 0:00:01.00,0:00:02.00,a, b\n", moved)] == [(1000, "a, b", "")]
    assert read(spark, tmp_path, "") == []
