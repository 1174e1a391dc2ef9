"""Binary files read in ranges give the rows of one walk from the start."""

import random
import struct

import pytest

from sparklines.sources import dlt
from sparklines.sources.ranges import list_files

MAGIC = dlt.MAGIC


def message(rng, n):
    body = bytes([0x41, 0]) + b"APP1CTX1" + bytes(rng.choice(b"DLT\x01\x21\x00\x07 az") for _ in range(n))
    return bytes([0x21, 7]) + struct.pack(">H", 4 + len(body)) + body


def log(rng, layout, messages):
    out = b""
    for _ in range(messages):
        m = message(rng, rng.choice([0, 3, 20, 50, 200]))
        if rng.random() < 0.05:  # a bad length
            m = m[:2] + struct.pack(">H", rng.choice([0, 1, 5, 70, 65535])) + m[4:]
        if rng.random() < 0.1:  # what looks like the next message
            m = m[:-3] + MAGIC + b"ECU1" if len(m) > 20 else m
        if layout == "storage":
            out += MAGIC + struct.pack("<II", rng.choice([0x80000000, 7]), 5) + b"E\xff\0\1" + m
        elif layout == "simple":
            out += MAGIC + b"ECU1APP1CTX1" + struct.pack(">I", 9) + struct.pack(">H", len(m) if rng.random() < 0.9 else 60000) + m
        else:
            out += m
        if layout != "wire" and rng.random() < 0.05:
            out += bytes(rng.choice(b"DLT\x01xyz") for _ in range(rng.randrange(30)))
    return out


@pytest.mark.parametrize("step", [40, 700, 5000, 1 << 20])
def test_ranges_equal_one_walk(spark, tmp_path, step):
    rng, want = random.Random(step), {}
    for i in range(12):
        data = log(rng, ("storage", "simple", "wire")[i % 3], 25 if step == 40 else 150)
        data = data[: -rng.randrange(1, 30)] if i > 6 else data
        (tmp_path / f"{i}.dlt").write_bytes(data)
        want[i] = [(n, *f) for n, f in enumerate(dlt.frames(data))]
    (tmp_path / "none.dlt").write_bytes(b"")
    (tmp_path / "text.dlt").write_bytes(b"INFO plain text\n" * 20)
    got = {i: [] for i in want}
    for r in dlt.scan_messages(list_files(spark, str(tmp_path)), step).collect():
        got[int(r.src.rsplit("/", 1)[1][:-4])].append((r.line_idx, r.layout, r.seconds, r.micros, *(None if b is None else bytes(b) for b in (r.ecu, r.app, r.ctx, r.msg))))
    assert {i: sorted(rows) for i, rows in got.items()} == want
    assert sum(map(len, want.values())) > 100


@pytest.mark.parametrize("layout", ["storage", "simple", "wire"])
def test_tables_of_a_range_hold_for_every_entry(layout):
    rng = random.Random(1)
    for _ in range(60):
        data = log(rng, layout, 20)
        start = rng.randrange(len(data))
        end = min(len(data), start + rng.choice([1, 30, 400]))
        walk = dlt.Walk(data[start:], layout, start, len(data))
        table = {e: (leave, n) for e, leave, n in walk.ends(start, end)}
        for at in range(start, end):
            rows, entry = list(walk.rows(at, end)), walk.settle(at)
            if entry in table:
                assert table[entry][1] == len(rows)
                beyond = list(walk.rows(table[entry][0], len(data))) if table[entry][0] >= 0 else []
                assert rows + beyond == list(walk.rows(at, len(data)))
            else:
                assert not rows


def test_a_file_beyond_what_one_value_holds_is_only_listed(spark, tmp_path):
    with (tmp_path / "big.dlt").open("wb") as f:  # sparse: nothing but its end is written
        f.write(MAGIC + struct.pack("<II", 7, 5) + b"ECU1" + message(random.Random(2), 20))
        f.truncate(5 << 30)
        f.seek((5 << 30) - 60)
        f.write(MAGIC + struct.pack("<II", 8, 5) + b"ECU1" + message(random.Random(2), 20))
    files = list_files(spark, str(tmp_path))
    assert files.first().size == 5 << 30
    assert [(r.line_idx, r.seconds) for r in dlt.scan_messages(files, 1 << 28).collect()] == [(0, 7), (1, 8)]
