"""One long string in files, read by byte ranges."""

import random

import pytest

from maskloom.operators import sequence as sq
from maskloom.sources import strings
from maskloom.sources.strings import border, byte_ranges, opened, read_string, with_places


def written(folder, *contents):
    folder.mkdir()
    for i, data in enumerate(contents):
        (folder / f"part-{i:03}").write_bytes(data)
    (folder / "_SUCCESS").write_bytes(b"")
    return str(folder)


def whole(df):
    return "".join(r.text for r in df.orderBy("piece").collect())


RNG = random.Random(4)
STRINGS = {
    "no blank": "".join(RNG.choice("abcdefghij") for _ in range(5000)),
    "all blank": " " * 3001,
    "ends with blanks": "a b  ",
    "line ends": "\n\r\n a b\x0b\n",
    "many bytes": "".join(RNG.choice("aé€😀𝔘") for _ in range(4000)),
    "one character": "😀",
    "nothing": "",
}


@pytest.mark.parametrize("name", STRINGS)
@pytest.mark.parametrize("piece_bytes, per_task", [(8, 40), (13, 100), (1 << 20, 64)])
def test_same_string(spark, tmp_path, name, piece_bytes, per_task):
    text = STRINGS[name]
    path = written(tmp_path / "in", text.encode(), b"", (text + "é").encode())
    got = read_string(spark, path, piece_bytes, per_task)
    assert whole(got) == text + text + "é"
    numbers = [r.piece for r in got.select("piece").collect()]
    assert len(set(numbers)) == len(numbers) == sum(-(-len(x.encode()) // piece_bytes) for x in (text, text + "é"))


def test_tasks_follow_the_bytes(spark, tmp_path):
    path = written(tmp_path / "in", b"x" * 10_000)
    assert read_string(spark, path, 100, 10).rdd.getNumPartitions() == 10
    assert [(r.low, r.high, r.piece) for r in byte_ranges([("a", 25), ("b", 3)], 10, 2)] == [(0, 20, 0), (20, 25, 2), (0, 3, 3)]


def test_mark_and_bad_bytes(spark, tmp_path):
    path = written(tmp_path / "in", b"\xef\xbb\xbfab\xff\x80\x80\x80\x80\x80\x80c" + "﻿".encode())
    text = whole(read_string(spark, path, 8))
    assert text.startswith("ab�") and text.endswith("c﻿") and set(text[2:-2]) == {"�"}
    assert border(b"\x80\x80\x80\x80", 0) == 3 and border(b"a\x80", 1) == 2 and border(b"ab", 1) == 1


def test_chunks_of_files(spark, tmp_path):
    text = "".join(RNG.choice("aé€😀 ") for _ in range(3000))
    data = text.encode()
    cut = len(text[:1111].encode())
    path = written(tmp_path / "in", data[:cut], data[cut:])
    pieces = read_string(spark, path, 64, 5)
    parts = {"train": text[:1050], "validation": text[1050:2000], "test": text[2000:]}
    wanted = {(s, i // 100): t[i : i + 100] for s, t in parts.items() for i in range(0, len(t), 100)}
    for df, before in ((pieces, None), (with_places(pieces), "before")):
        out = sq.char_chunks(df, "piece", "text", 100, 1050, 2000, drop_last=False, before=before).collect()
        assert {(r.split, r.chunk_id): r.text for r in out} == wanted


@pytest.mark.parametrize("rows", [0, 100])
def test_places(spark, tmp_path, rows, monkeypatch):
    """Joined or broadcast, the places are the same."""
    monkeypatch.setattr(strings, "BROADCAST_ROWS", rows)
    text = "ab😀é " * 30
    got = with_places(read_string(spark, written(tmp_path / "in", text.encode()), 11)).orderBy("piece").collect()
    assert [r.before for r in got] == [sum(len(x.text) for x in got[:i]) for i in range(len(got))]
    assert "".join(r.text for r in got) == text


def test_names_and_errors(spark, tmp_path):
    path = tmp_path / "odd name %20é"
    path.write_bytes(b"abc ")
    assert whole(read_string(spark, str(path))) == "abc "
    assert opened(f"file:{path}").read() == opened(f"file://{path}").read() == b"abc "
    (tmp_path / "none").mkdir()
    for bad in (tmp_path / "none", tmp_path / "missing"):
        with pytest.raises(ValueError):
            read_string(spark, str(bad))
    with pytest.raises(ValueError):
        read_string(spark, str(path), 7)
