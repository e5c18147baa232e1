"""Include resolution against a plain reading of its rule, linker maps against a line-by-line parser, pitch on tones."""

import math
import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import census, includes
from tidemark.sources import histories


def plain(files, path, lib, spelling):
    """The rule, one include at a time."""
    if spelling is None:
        return None, None, None, None
    at = posixpath.normpath(posixpath.join(posixpath.dirname(path), spelling))
    if at in files:
        return at, files[at], "/include/" in at, None
    named = []
    for f, owner in files.items():
        g = f[:-3] if f.endswith((".hpp.in", ".h.in")) else f
        parts = g.split("/")
        names = [g.split("/include/", 1)[1]] if "/include/" in g else ["/".join(parts[i:]) for i in range(len(parts)) if len(parts) - i <= 5]
        if spelling in names:
            named.append((f, owner))
    if not named:
        return None, None, None, None
    own = [f for f, owner in named if owner == lib]
    public = [f for f, _ in named if "/include/" in f]
    pick = min(own or public or [f for f, _ in named])
    owners = sorted({o for _, o in named})
    return pick, files[pick], "/include/" in pick, owners if not own and len(owners) > 1 else None


def test_includes(spark):
    draw = random.Random(2)
    paths = {f"{lib}/{mid}{name}" for lib in ("a", "b", "c") for mid in ("src/", "include/x/", "src/deep/er/", "") for name in ("one.hpp", "two.hpp", "cfg.h.in", "v/w/x/y/z/far.hpp") if draw.random() < 0.6}
    files = {p: p.split("/")[0] for p in sorted(paths)}
    spelled = ["one.hpp", "x/one.hpp", "two.hpp", "./two.hpp", "../one.hpp", "../../one.hpp", "../../../../one.hpp", "cfg.h", "x/cfg.h", "x/y/z/far.hpp", "v/w/x/y/z/far.hpp", "src//one.hpp", "none.hpp", None, "src/deep/../one.hpp"]
    asked = [(f, lib, s) for f, lib in files.items() for s in spelled] + [("main.cpp", "z", s) for s in spelled] * 2
    got = includes.resolve(spark.createDataFrame(asked, "path string, lib string, spelling string"), spark.createDataFrame([*files.items(), (None, "a")], "path string, lib string"))
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == sorted(((*x, *plain(files, *x)) for x in asked), key=str)
    assert any(r[6] for r in rows) and any(r[5] for r in rows)
    assert includes.resolve(spark.createDataFrame([], "path string, lib string, spelling string"), spark.createDataFrame([], "path string, lib string")).count() == 0


def test_normal_paths(spark):
    for raw in ("a/./b//c", "a/../b", "../a", "a/../../b", "..", "a/b/../../..", "x"):
        want = posixpath.normpath(raw)
        assert spark.range(1).select(includes.normal_path(F.lit(raw))).first()[0] == ("" if want == "." else want), raw


MAP = """Archive member included to satisfy reference by file (symbol)

Discarded input sections

 .text.unused   0x00000000       0x99 lib/libx.a(gone.o)
 .text._ZN4verylongnamethatneedsitsownlineEv
                0x00000000       0x77 lib/libx.a(gone.o)

Memory Configuration

 .text          0x00001000       0x20 main.o
 .text._ZN3foo3barEv
                0x00001020       0x1a4 build/libs/libx.a(core.o)
 .rodata.table  0x00002000       0x10 build/core.o
 .rodata.empty  0x00002010        0x0 build/core.o
 .bss._pool
                0x20000000      0x400 lib/liby.a(pool.o)
 .tbss          0x20000400        0x8 pool.o
 .debug_info    0x00000000     0x9999 main.o
 .text.first
 .text.second
                0x00003000       0x40 lost.o
 .text.third
 .text.fourth
 .text.fifth
                0x00003100       0x44 kept.o
 .text.waits
 *fill*         0x00003200        0x4
                0x00003204       0x48 lost.o
 .data.x        0x30000000       0x10 main.o
"""


def lines_read(text):
    """The parser of the format's description, a line at a time."""
    full, body, name = re.compile(r"^\s(\.\w[\w.$-]*)\s+(0x[0-9a-f]+)\s+(0x[0-9a-f]+)\s+(\S+)"), re.compile(r"^\s+(0x[0-9a-f]+)\s+(0x[0-9a-f]+)\s+(\S+)"), re.compile(r"^\s(\.\w[\w.$-]*)\s*$")
    out, waits, gone = [], None, False
    for k, line in enumerate(text.splitlines()):
        if line.startswith("Discarded input sections"):
            gone, waits = True, None
        elif gone and (not line or line[0].isspace()):
            continue
        else:
            gone = False
            if m := full.match(line):
                out.append((k, m[1], int(m[3], 16), m[4]))
                waits = None
            elif waits:
                if m := body.match(line):
                    out.append((k, waits, int(m[2], 16), m[3]))
                waits = None
            elif m := name.match(line):
                waits = m[1]
    kinds = {".text": "text", ".roda": "text", ".bss": "bss", ".bss.": "bss", ".tbss": "bss"}
    return [(k, s, kinds[s[:5]], o.rsplit("(", 1)[-1].rstrip(")").rsplit("/", 1)[-1], n) for k, s, n, o in out if s[:5] in kinds and n]


def test_linker_map(spark, tmp_path):
    (tmp_path / "a.map").write_text(MAP)
    draw = random.Random(4)
    lines = MAP.splitlines()[4:]
    (tmp_path / "b.map").write_text("\n".join(draw.choice(lines) for _ in range(400)) + "\n")
    got = histories.read_map(spark, str(tmp_path))
    for f in "ab":
        mine = sorted(tuple(r)[1:] for r in got.collect() if r.file.endswith(f"{f}.map"))
        assert mine == lines_read((tmp_path / f"{f}.map").read_text())
    bytes_ = {(r.kind, r.object): r.bytes for r in census.footprint(got.where("file LIKE '%a.map'"), "kind", "object", "size").collect()}
    assert bytes_ == {("text", "main.o"): 0x20, ("text", "core.o"): 0x1B4, ("bss", "pool.o"): 0x408, ("text", "kept.o"): 0x44}


def tone(hz, rate, n, amplitude=0.3, offset=0.0):
    return [offset + amplitude * math.sin(2 * math.pi * hz * k / rate) for k in range(n)]


@pytest.mark.parametrize("rate", [8000, 16_000, 44_100, 48_000])
def test_pitch_of_tones(spark, rate):
    n = rate // 5
    rows = [(k, tone(hz, rate, n, offset=off)) for k, (hz, off) in enumerate([(220.0, 0.0), (220.0, 0.3), (82.4, 0.0), (987.8, -0.2), (50.0, 0.0)])] + [(6, tone(220.0, rate, n, amplitude=0.001)), (7, None), (8, [0.0] * 10)]
    if rate > 16_000:
        rows.append((9, tone(9000.0, rate, n)))
    frame = spark.createDataFrame(rows, "id int, x array<double>")
    frame = arrays.pitch_frames(frame, "x", rate)
    factor = next(f for f in range(1, rate + 1) if rate % f == 0 and rate / f <= 16_000)
    got = frame.withColumn("p", arrays.pitch(rate / factor)(F.col("frame_samples"))).select("id", "frame", "centre", "p.*").collect()
    for k, hz in enumerate([220.0, 220.0, 82.4, 987.8]):
        mine = [r for r in got if r.id == k][2:]
        assert mine and all(abs(1200 * math.log2(r.hz / hz)) < 12 and r.clarity > 0.9 for r in mine), (k, mine)
    assert all(r.hz == 0 for r in got if r.id in (4, 6, 9) and r.frame > 1)
    size, hop, delay = round(rate / factor * 0.064), round(rate / factor * 0.01), 8 * factor if factor > 1 else 0
    assert [r.centre for r in got if r.id == 0] == [(k * hop + size // 2) * factor - delay for k in range((n // factor + (n % factor > 0) - size) // hop + 1)]
    assert [r.hz for r in got if r.id in (7, 8)] == [None, None]


def test_decimation_keeps_constants_and_stops_what_would_fold(spark):
    taps = arrays.low_pass(3)
    assert len(taps) == 49 and abs(taps.sum() - 1) < 1e-12
    gain = lambda f: abs(sum(h * complex(math.cos(2 * math.pi * f * k), -math.sin(2 * math.pi * f * k)) for k, h in enumerate(taps)))
    assert gain(1000 / 48_000) > 0.99 and all(gain(f / 48_000) < 10 ** (-70 / 20) for f in (6900, 9000, 15_000, 23_000))
