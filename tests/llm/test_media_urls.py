import fnmatch
import random
import re

import pytest

from tidewell.llm import ogg, urls


def slow_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_crc():
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        d = rng.randbytes(n)
        assert ogg.crc(d) == slow_crc(d)


@pytest.mark.parametrize("segments", [1, 2, 7, 255])
def test_round_trip(segments):
    rng = random.Random(segments)
    for _ in range(30):
        streams = {s: [(rng.randbytes(rng.choice([0, 1, 254, 255, 256, 510, 70_000])), k * 10) for k in range(rng.randint(1, 7))] for s in (1, 2, 3)}
        data = b"junk" + ogg.multiplex(streams, segments) + b"tail"
        found, bad = ogg.demultiplex(data, rate=10.0)
        assert bad == 0
        for s, packets in streams.items():
            mine = [(p, no) for serial, no, p, _, _ in found if serial == s]
            assert mine == [(p, no) for no, (p, _) in enumerate(packets)]
        for serial, no, _, granule, seconds in found:
            assert granule in (None, no * 10) and seconds == (None if granule is None else no)


def test_damage():
    body = [(bytes([k]) * 200, k) for k in range(30)]
    data = ogg.multiplex({1: body, 2: body}, segments=4)
    starts = [m.start() for m in re.finditer(b"OggS", data)]
    hit = bytearray(data)
    hit[starts[5] + 40] ^= 1
    found, bad = ogg.demultiplex(bytes(hit))
    assert bad == 1
    for s in (1, 2):
        mine = [p for serial, _, p, _, _ in found if serial == s]
        assert set(mine) < {p for p, _ in body} or s == 1 and set(mine) <= {p for p, _ in body}
    assert len(found) < 60 and ogg.demultiplex(data[: len(data) - 3])[1] == 1
    assert ogg.demultiplex(None) == ([], 0) and ogg.demultiplex(b"") == ([], 0) and ogg.demultiplex(b"OggS") == ([], 1)


def test_lost_continuation():
    data = ogg.multiplex({1: [(b"a", 0), (b"b" * 3000, 1), (b"c", 2)]}, segments=4)
    starts = [m.start() for m in re.finditer(b"OggS", data)]
    cut = data[: starts[2]] + data[starts[3] :]
    assert [p for _, _, p, _, _ in ogg.demultiplex(cut)[0]] == [b"a", b"c"]


def test_opus_times():
    found, _ = ogg.demultiplex(ogg._encode("one\ntwo\nthree"))
    assert [(s, p, g, round(t, 4)) for s, _, p, g, t in found if g is not None] == [(1, b"\x08one", 960, 0.0135), (1, b"\x08three", 1920, 0.0335), (2, b"\x08two", 960, 0.0135)]
    assert [ogg.opus_samples(bytes(x)) for x in ([], [8], [9], [3 << 3, 0], [11, 4], [16 << 3])] == [0, 960, 1920, 2880, 3840, 120]


def laced(serial, no, flags, granule, packets):
    """A page written out by hand, with the slow checksum."""
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    head = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + no.to_bytes(4, "little")
    data = head + bytes(4) + bytes([len(lacing)]) + lacing + b"".join(packets)
    return data[:22] + slow_crc(data).to_bytes(4, "little") + data[26:]


def test_end_trimming():
    """The last page ends 700 samples before its last packet does; the packets before it keep their own ends."""
    head = b"OpusHead\x01\x02" + (312).to_bytes(2, "little") + bytes(7)
    frame = b"\x08" + bytes(30)  # 20 ms
    start = laced(9, 0, 2, 0, [head]) + laced(9, 1, 0, 0, [b"OpusTags"])
    body = laced(9, 2, 0, 2_880, [frame] * 3)
    times = lambda data: [g for *_, g, _ in ogg.demultiplex(data)[0]][2:]
    assert times(start + body + laced(9, 3, 4, 5_060, [frame] * 3)) == [960, 1_920, 2_880, 3_840, 4_800, 5_060]
    assert times(start + laced(9, 2, 4, 1_000, [frame] * 3)) == [960, 1_000, 1_000]  # the first page with sound is the last
    assert times(start + body + laced(9, 4, 4, 5_060, [frame] * 3)) == [960, 1_920, 2_880, None, None, 5_060]  # page 3 lost
    assert times(start + laced(9, 2, 0, 10_000, [frame] * 2)) == [9_040, 10_000]  # a stream cut out of a longer one


def test_vorbis_times():
    head = b"\x01vorbis" + (0).to_bytes(4, "little") + b"\2" + (44100).to_bytes(4, "little") + bytes(14)
    found, _ = ogg.demultiplex(ogg.multiplex({7: [(head, 0), (b"c", 0), (b"s", 0), (b"x", 44100)]}))
    assert found[-1][4] == 1.0


def bits_to_bytes(bits):
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))


def test_vorbis_blocks():
    """Two modes, short and long (256 and 2,048 samples): a packet adds a quarter of its block and of the one before."""
    low = lambda n, width: f"{n:0{width}b}"[::-1]
    setup = "".join(low(ord(c), 8) for c in "\x05vorbis") + "10110" * 40 + low(1, 6) + "".join(low(flag, 1) + low(0, 16) + low(0, 16) + low(k, 8) for k, flag in enumerate((0, 1))) + "1"
    assert ogg.vorbis_modes(bits_to_bytes(setup)) == [0, 1] and ogg.vorbis_modes(b"") == [] and ogg.vorbis_modes(bytes(40)) == []
    head = b"\x01vorbis" + bytes(4) + b"\2" + (44_100).to_bytes(4, "little") + bytes(12) + bytes([8 | 11 << 4]) + b"\1"
    short, long = b"\x00" + bytes(9), b"\x02" + bytes(40)
    start = laced(3, 0, 2, 0, [head]) + laced(3, 1, 0, 0, [b"\x03vorbis", bits_to_bytes(setup)])
    ends = lambda data: [g for *_, g, _ in ogg.demultiplex(data)[0]][3:]
    page = laced(3, 2, 0, 128 + 576 + 1_024, [short, short, long, long])
    assert ends(start + page) == [0, 128, 704, 1_728]
    assert ends(start + page + laced(3, 3, 4, 2_400, [short, short])) == [0, 128, 704, 1_728, 2_304, 2_400]
    assert ends(start + page + laced(3, 4, 0, 9_000, [short, short])) == [0, 128, 704, 1_728, 8_872, 9_000]  # page 3 lost


def test_columns(odd_documents, no_documents):
    media = ogg.documents_as_ogg(odd_documents)
    got = ogg.packets(media)
    assert got.where("id = 6 AND packet = 2").first().n_bytes == 300_001 and got.where("id = 3").count() == 0
    assert got.where("id = 4").count() == 2 + 1 + 2 and got.where("id = 2").count() == 10
    assert ogg.packets(ogg.documents_as_ogg(no_documents)).count() == 0


def test_automaton():
    rng = random.Random(2)
    rules = tuple("".join(rng.choices("ab*?c", k=rng.randint(0, 9))) for _ in range(60)) + ("*", "", "é*")
    machine = urls.Automaton(rules)
    asked = ["".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(300)] + [None, "é", "a" * 3000, ""]
    got = machine.match(asked)
    for u, row in zip(asked, got, strict=True):
        for rule, hit in zip(rules, row, strict=True):
            true = u is not None and re.fullmatch(fnmatch.translate(urls.encoded(rule).decode()), urls.encoded(u).decode()) is not None
            assert true == hit
    assert urls.Automaton(()).match(["a"]).shape == (1, 0)


def test_filter_urls(spark):
    rows = [("HTTP://Www.Cheap-Pills.com:80?x#top",), ("https://a.example.org/en/x?utm_source=f",), (None,), ("",), ("https://a.com:443./b#c",), ("mailto:x#y",), ("https://a.com/x.zip",), ("https://a.com/x.zip",)]
    df = spark.createDataFrame(rows, "url string").withColumnRenamed("url", "url")
    got = [tuple(r) for r in urls.filter_urls(df).select("canonical", "blocked").collect()]
    assert got == [("http://www.cheap-pills.com/?x", True), ("https://a.example.org/en/x?utm_source=f", False), (None, False), ("", False), ("https://a.com:443/b", False), ("mailto:x", False), ("https://a.com/x.zip", True), ("https://a.com/x.zip", True)]
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert urls.filter_urls(df, block=(), allow=()).where("blocked").count() == 0


def test_urls_of_odd_documents(odd_documents, no_documents):
    """Any texts as URLs: null, empty, very long, repeated, and columns named like inner ones."""
    out = urls.filter_urls(odd_documents, block=("*word word*", ""), allow=(), url_col="text")
    assert out.columns == [*odd_documents.columns, "canonical", "rules", "blocked"] and out.count() == odd_documents.count()
    assert {(r.doc_id, r.rules, r.blocked) for r in out.collect() if r.doc_id in (3, 4, 6, 7)} == {(3, "", False), (4, "2", True), (6, "1", True), (7, "", False)}
    assert urls.filter_urls(no_documents, url_col="text").count() == 0
