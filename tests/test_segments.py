"""Waiting segments of a stream: against a model byte by byte, and in little time."""

import random
import time

from packetloom.operators.flows import FlowConfig
from packetloom.operators.reassembly import Stream


def test_pieces_against_a_byte_model():
    rng = random.Random(2)
    for _ in range(300):
        s, model = Stream(FlowConfig(max_depth=10**6)), {}
        s.begin(0)
        for _ in range(40):
            at, data = rng.randrange(2, 120), bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30)))
            outcome, _ = s.add(at, data)
            held = [model.get(at + i) for i in range(len(data))]
            if None not in held:
                assert outcome == ("conflict" if bytes(held) != data else "duplicate")
            else:
                assert outcome == ("new" if set(held) == {None} else "overlap")
            for i, byte in enumerate(data):
                model.setdefault(at + i, byte)
        assert {a + i: byte for a in s.starts for i, byte in enumerate(s.pieces[a])} == model
        assert sum(map(len, s.pieces.values())) == len(model) == s.waiting and s.starts == sorted(s.pieces)


def test_limits_in_order():
    s = Stream(FlowConfig(max_depth=100, max_segments=3, max_window=50))
    s.begin(0)
    assert s.add(60, b"x") == ("outside", False) and s.add(2**32 - 5, b"x")[0] == "outside"
    assert [s.add(k, b"yy")[0] for k in (10, 20, 30, 40)] == ["new", "new", "new", "limit"]
    s = Stream(FlowConfig(max_depth=10, max_window=50))
    s.begin(0)
    assert s.add(1, b"12345678")[0] == "new" and list(s.ready()) == [(1, b"12345678")]
    assert s.add(9, b"abcdef") == ("cut", True) and list(s.ready()) == [(9, b"ab")] and s.add(11, b"z")[0] == "depth"


def test_many_waiting_segments_take_little_time():
    order = list(range(10_000))
    for shuffled in (False, True):
        if shuffled:
            random.Random(1).shuffle(order)
        s = Stream(FlowConfig(max_window=1 << 30))
        s.begin(0)
        start = time.perf_counter()
        for i in order:
            assert s.add(3 + 80 * i, b"x" * 40)[0] == "new"
        assert time.perf_counter() - start < 2  # 0.1 s; walking all held pieces took 4.7 s
