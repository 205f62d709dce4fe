import random

import numpy as np
import pytest

from auditloom.llm import spans as S

LENGTH = 240


def brute(texts, length=LENGTH):
    where: dict = {}
    for key, text in texts.items():
        for i in range(len(text) - length + 1):
            where.setdefault(text[i : i + length], set()).add(key)
    out = {}
    for key, text in texts.items():
        hit = [i for i in range(len(text) - length + 1) if len(where[text[i : i + length]]) > 1]
        if hit:
            out[key] = len({j for i in hit for j in range(i, i + length)})
    return out


def words(rng, n):
    return "".join(rng.choice("abcdefghij klmno é表 ") for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (239, 240, 241, 250, 290, 400, 900, 3000)]
    passages += ["=-" * 300, " " * 700, "x" * 500, words(rng, 30) * 20]
    texts = {}
    for key in range(40):
        parts = [words(rng, rng.randint(0, 400))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - 260)) if rng.random() < 0.5 else 0
            parts += [p[a:], words(rng, rng.randint(0, 300))]
        texts[key] = "".join(parts)
    texts[50], texts[51] = texts[3], texts[3]
    texts[52] = passages[6] + passages[6]
    texts[53] = passages[5] + passages[7]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    rows = [(k, t, 1, "clash") for k, t in texts.items()] + [(0, texts[0], 1, ""), (90, None, 1, ""), (91, "", 1, ""), (None, texts[3], 1, "")]
    got = {r["doc_id"]: r["shared_chars"] for r in S.shared_amounts(spark.createDataFrame(rows, "doc_id long, text string, place int, print string"), "doc_id", "text").collect()}
    assert got == brute(texts)


def test_empty(spark):
    assert S.shared_amounts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
    assert S.shared_amounts(spark.createDataFrame([(1, "a" * 300)], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_equal_substrings_have_equal_anchors_inside():
    rng = random.Random(4)
    middle = words(rng, 2000)
    places = []
    for _ in range(5):
        head = words(rng, rng.randint(0, 500))
        codes = S._codes(head + middle + words(rng, 300))
        at = S.anchors(codes, np.array([len(codes) - 1]), 60) - len(head)
        places.append(set(at[(at >= 150) & (at < 1850)].tolist()))
        assert max(np.diff(sorted(at))) <= 60
    assert all(p == places[0] for p in places)


def test_any_span_holds_a_common_anchor_in_its_first_half():
    rng = random.Random(6)
    plain = "abcdefghij klmno é表 "
    for n in range(20_000):
        span = "".join(rng.choices(plain, k=rng.choice((LENGTH, LENGTH, 300, 600)))) if n % 10 else words(rng, rng.randint(1, 20)) * LENGTH
        both = []
        for _ in range(2):
            head = rng.choices(plain, k=rng.randint(0, 300))
            codes = S._codes("".join([*head, span, *rng.choices(plain, k=rng.randint(0, 300))]))
            both.append({int(a) - len(head) for a in S.anchors(codes, np.array([len(codes) - 1]), LENGTH // 2)})
        assert any(0 <= a <= LENGTH // 2 for a in both[0] & both[1]), span


def test_anchors_of_several_texts_are_those_of_each():
    rng = random.Random(7)
    texts = [words(rng, n) for n in (100, 239, 240, 1000, 119, 3000)]
    arrays = [S._codes(t) for t in texts]
    ends = np.cumsum([len(a) for a in arrays])
    got = S.anchors(np.concatenate(arrays), ends - 1, 120).tolist()
    want = [int(e - len(a) + p) for a, e in zip(arrays, ends) for p in S.anchors(a, np.array([len(a) - 1]), 120)]
    assert got == want


def test_fingerprints():
    rng = random.Random(5)
    text = words(rng, 1000)
    a, b = S._Prints(S._codes(text + "zz" + text)), S._Prints(S._codes(text[100:]))
    at = np.array([100, 1102])
    assert len({*a.of(at, 50).tolist(), *b.of(np.array([0]), 50).tolist()}) == 1
    assert a.of(np.array([100]), 50) != a.of(np.array([101]), 50)
