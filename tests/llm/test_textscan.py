import random
import re

import pyarrow as pa

from quotewell.llm import textscan as ts


def test_words_lines_and_hashes_match_python():
    rng = random.Random(1)
    seen = {}
    for _ in range(200):
        xs = ["".join(rng.choice("ab \n\té") for _ in range(rng.choice([0, 0, 1, 3, 12, 30]))) for _ in range(rng.randint(0, 8))] + ([None] if rng.random() < 0.4 else [])
        rng.shuffle(xs)
        words, lines = [[] for _ in xs], [[] for _ in xs]
        for c in ts.chunks(pa.array(xs, pa.string()), lower=True):
            for d, s, e, h in zip(c.doc, c.start, c.end, c.hashes()):
                words[c.first + d].append(w := c.buf[s:e].tobytes().decode())
                assert seen.setdefault(w, h) == h
            for d, s, e in zip(*c.lines()):
                lines[c.first + d].append(c.buf[s:e].tobytes().decode())
        assert words == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in xs]
        assert lines == [(x or "").split("\n") for x in xs]
    assert len(set(seen.values())) == len(seen)


def test_a_word_longer_than_a_slice_hashes_as_elsewhere():
    long = "x" * (ts._SLICE + 5)
    hashes = [h for t in ([long + " a"], ["b\n" + long]) for c in ts.chunks(pa.array(t)) for h in c.hashes()]
    assert hashes[0] == hashes[3] and len(set(map(int, hashes))) == 3
