import random

import pytest

from auditloom.llm import packing as P

DOC = "doc_id long, text string, tokens int, container string"
WIN = "window_id int, window_name string, capacity_tokens int"


def brute_choice(counts, size, capacity):
    """The smallest sum of squares that a placement reaches."""
    def after(gap):
        c = dict(counts)
        if gap is not None:
            c[gap] -= 1
        left = (capacity if gap is None else gap) - size
        if left:
            c[left] = c.get(left, 0) + 1
        return sum(v * v for v in c.values())

    return min(after(g) for g in [None, *[g for g, n in counts.items() if n and g >= size]])


@pytest.mark.parametrize("seed", range(4))
def test_each_step_is_best(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    items = [rng.randint(1, capacity) for _ in range(300)]
    boxes = P.packed(items, capacity)
    filled: dict = {}
    for n, (size, box) in enumerate(zip(items, boxes)):
        counts: dict = {}
        for used in filled.values():
            if used < capacity:
                counts[capacity - used] = counts.get(capacity - used, 0) + 1
        best = brute_choice(counts, size, capacity)
        filled[box] = filled.get(box, 0) + size
        assert filled[box] <= capacity
        now: dict = {}
        for used in filled.values():
            if used < capacity:
                now[capacity - used] = now.get(capacity - used, 0) + 1
        assert sum(v * v for v in now.values()) == best


def test_containers(spark):
    rng = random.Random(9)
    texts = [(n, " ".join(rng.choice(["trial", "run", "gate", "表"]) for _ in range(rng.randint(1, 90))), 0, "") for n in range(60)]
    rows = texts + [texts[0], (100, None, 0, ""), (101, "", 0, ""), (None, "x", 0, ""), (102, "a" * 200_000, 0, "")]
    windows = [(1, "a", 64), (2, "b", 128), (2, "b", 128), (3, "c", None), (4, "d", 0)]
    docs, wins = spark.createDataFrame(rows, DOC), spark.createDataFrame(windows, WIN)
    got = P.containers(docs, wins, group=25).collect()
    path = P.tokenizer_file(spark)
    want = {n: P.count_tokens(t, path) for n, t, *_ in rows if n is not None and t}
    for window, capacity in ((1, 64), (2, 128)):
        own = [r for r in got if r["window_id"] == window]
        assert {n: sum(r["tokens"] for r in own if r["doc_id"] == n) for n in want} == want
        boxes: dict = {}
        for r in own:
            boxes[r["container"]] = boxes.get(r["container"], 0) + r["tokens"]
        assert max(boxes.values()) <= capacity
        assert all(len([r for r in own if r["doc_id"] == n]) == -(-want[n] // capacity) for n in want)
    assert {r["window_id"] for r in got} == {1, 2}
    usage = {r["window_id"]: r for r in P.usage(P.containers(docs, wins), wins).collect()}
    assert usage[1]["unused"] / usage[1]["tokens"] < 0.05


def test_empty(spark):
    docs, wins = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a", 5)], WIN)
    assert P.containers(docs, wins).count() == 0
    assert P.containers(spark.createDataFrame([(1, "x y", 0, "")], DOC), spark.createDataFrame([], WIN)).count() == 0


def test_pieces_of_long_texts_count_like_the_whole(spark):
    path = P.tokenizer_file(spark)
    text = "the gate fell to 3.5 in run r12. " * 6000
    assert P.count_tokens(text, path) == len(P._encoder(path).encode_ordinary(text))


def test_more_windows_than_in_one_branch(spark, monkeypatch):
    monkeypatch.setattr(P, "WINDOWS", 2)
    docs = spark.createDataFrame([(n, "word " * n) for n in range(1, 6)], "doc_id long, text string")
    wins = spark.createDataFrame([(n, 10 * n) for n in range(1, 6)], "window_id int, capacity_tokens int")
    assert {r["window_id"] for r in P.containers(docs, wins).collect()} == {1, 2, 3, 4, 5}
