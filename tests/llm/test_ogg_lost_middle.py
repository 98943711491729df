"""A packet that lost a page in its middle is dropped, however many pages it has."""

import re

import pytest

from tidewell.llm import ogg


@pytest.mark.parametrize("gone", [2, 3, 4, 5])
def test_lost_middle(gone):
    data = ogg.multiplex({1: [(b"a", 0), (b"b" * 6000, 1), (b"c", 2)]}, segments=4)
    starts = [m.start() for m in re.finditer(b"OggS", data)] + [len(data)]
    assert len(starts) > 7  # the packet lies over pages 1 to 6
    cut = data[: starts[gone]] + data[starts[gone + 1] :]
    assert [p for _, _, p, _, _ in ogg.demultiplex(cut)[0]] == [b"a", b"c"]
