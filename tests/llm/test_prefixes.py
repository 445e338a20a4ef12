"""Fingerprints that crowd around one are dealt on by further bits, and no link is lost."""

import random
from collections import Counter

import pytest

from vitrine.llm import near_copies

MOST = 140


def crowded(seed):
    """A third of the fingerprints within 4 bits of one, a chain around another, the rest anywhere."""
    r = random.Random(seed)
    center, marks = r.getrandbits(64), set()
    while len(marks) < 150:
        mark = center
        for bit in r.sample(range(64), r.randint(0, 4)):
            mark ^= 1 << bit
        marks.add(mark)
    mark = r.getrandbits(64)
    for _ in range(20):
        mark ^= (1 << r.randrange(64)) | (1 << r.randrange(64)) | (1 << r.randrange(64))
        marks.add(mark)
    while len(marks) < 450:
        marks.add(r.getrandbits(64))
    return sorted(marks)


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def marks():
    return crowded(4)


@pytest.fixture(scope="module")
def distinct(spark, marks):
    return spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "_fp long").cache()


@pytest.fixture(scope="module")
def levels(distinct):
    return [(p, [(r._fp % (1 << 64), r._prefix % (1 << 64)) for r in rows.collect()]) for p, rows in near_copies.dealt(distinct, 2, 1, most=MOST)]


def test_crowded_prefixes_lose_no_link(marks, distinct):
    near = [(a, b) for i, a in enumerate(marks) for b in marks[:i] if (a ^ b).bit_count() <= 4]
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_copies.fingerprint_links(distinct, prefix_rows=MOST).collect()]
    assert len(near) > 2000
    assert components(marks, found) == components(marks, near)


def test_no_prefix_keeps_more_than_it_may(levels):
    assert len(levels) > 2
    for p, rows in levels:
        assert p == 64 or max(Counter(x for _, x in rows).values(), default=0) <= MOST


def test_every_word_is_dealt_once(marks, levels):
    """Each word within two bits of a fingerprint begins with exactly one of the fingerprint's prefixes."""
    balls = [int(m) for m in near_copies.flips(0, 2)]
    for mark in marks[::45]:
        held = [(p, x) for p, rows in levels for f, x in rows if f == mark]
        assert all(sum((mark ^ w) >> (64 - p) == x for p, x in held) == 1 for w in balls)
