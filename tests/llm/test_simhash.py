import random

import numpy as np
import pytest
from xxhash import xxh64

from gridpulse.llm import simhash

DOCS = "doc_id long, text string, bits long, key long, copies string, component_id string"


def bits_by_force(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups_by_force(bits):
    """Index of the least index that links reach, for each fingerprint."""
    root = list(range(len(bits)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(bits)):
        for i in range(j):
            if (bits[i] ^ bits[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(x) for x in range(len(bits))]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgHIJ") for _ in range(draw.randint(2, 7))) for _ in range(n))


def test_near_duplicates_equal_brute_force(spark):
    texts, draw = [], random.Random(1)
    for group in range(25):
        base = prose(group, 150).split()
        for _ in range(draw.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = "new"
            texts.append("\t".join(copy))
    texts += ["", None, " \n\x0b", "one", "ONE", "two words", "Two\r\nWords", "é à\x85b", prose(9, 80_000), "a b c " * 50, "a b c " * 50]
    rows = list(enumerate(texts)) + [(None, ""), (None, "only without an id"), (3, "one"), (3, "repeated id")]
    bits = [bits_by_force(t) for _, t in rows]
    reach = groups_by_force(bits)
    least = {}
    for (i, _), r in zip(rows, reach):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    want = [(i, f"{b:016x}", least[r]) for (i, _), b, r in zip(rows, bits, reach)]
    frame = spark.createDataFrame([(*r, 0, 0, "clash", "clash") for r in rows], DOCS)
    got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({r for r in reach}) < len(set(bits))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def crowd(seed, n, open_bits):
    """Fingerprints that differ from one another in few bits, many of them in one half."""
    draw = random.Random(seed)
    base = draw.getrandbits(64)
    return {base ^ sum(1 << b for b in open_bits if draw.random() < 0.5) for _ in range(n)}


@pytest.mark.parametrize("limit", [2048, 5])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "CROWD", limit)
    draw = random.Random(4)
    values = {0, 1, 1 << 63, (1 << 64) - 1} | {draw.getrandbits(64) for _ in range(200)}
    values |= crowd(1, 200, range(3, 30, 2)) | crowd(2, 200, range(34, 64, 2)) | crowd(3, 150, range(0, 64, 5))
    for x in list(values)[:60]:
        values.add(x ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4))))
    values = sorted(values)
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "bits long")
    place = {int(np.uint64(v).view(np.int64)): i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    found = simhash.links(frame).collect()
    for r in found:
        x, y = sorted((find(place[r.a]), find(place[r.b])))
        root[y] = x
    assert [find(x) for x in range(len(values))] == groups_by_force(values)


def test_edge_of_the_radius():
    flips = lambda *at: sum(1 << b for b in at)
    for other in (flips(0, 1, 2), flips(61, 62, 63), flips(0, 40, 50), flips(3, 5, 40)):
        keys = []
        for x in (0b1000 << 30, 0b1000 << 30 ^ other):
            bits = np.array([x], np.uint64)
            keys.append({(h, int(v)) for h in (0, 1) for v in simhash.ball(simhash._segment(bits, 32 * h, 32), 32)[1]})
        assert keys[0] & keys[1]


def test_forest_keeps_what_is_connected():
    forest = simhash.Forest()
    forest.add(np.array([5, 7, 9], np.uint64), np.array([3, 5, 8], np.uint64))
    forest.settle()
    forest.add(np.array([8], np.uint64), np.array([7], np.uint64))
    forest.settle()
    assert dict(zip(forest.a.tolist(), forest.b.tolist())) == {5: 3, 7: 3, 8: 3, 9: 3}
