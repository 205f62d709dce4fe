"""Broken lines against a hand-written reader of the same rules."""

import json
import random
import re

import pytest

from auditloom.operators import rejects

SCHEMA = "line_id long, ledger_path string, line_no int, raw_line string, trial string, gate string"
HEAD = "trial,status,accuracy,note"


def cut(line, sep):
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, cell = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] != '"':
                        break
                    cell, j = cell + '"', j + 2
                    continue
                cell, j = cell + line[j], j + 1
            i = j + 1
            out.append(cell)
            if i >= len(line):
                return out
            if line[i] != sep:
                return None
            i += 1
        else:
            j = line.find(sep, i)
            cell = line[i:] if j < 0 else line[i:j]
            if '"' in cell:
                return None
            out.append(cell)
            if j < 0:
                return out
            i = j + 1


def reason(path, line, head):
    if line is None:
        return "syntax"
    if path and path.endswith((".csv", ".tsv")):
        cells = cut(line, "," if path.endswith("csv") else "\t")
        if cells is None:
            return "syntax"
        if head is None or len(cells) != len(head):
            return "columns"
        row = dict(zip(head, (c.strip(" ") for c in cells)))
        text = row["accuracy"]
        number = None if text == "" else text
        fits = number is None or (re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", number) and 0 <= float(number) <= 100)
        return None if row["trial"].strip() and row["status"].lower() in rejects.STATUSES and fits else "value"
    try:
        v = json.loads(line, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return "syntax"
    inner = v.get("metrics") if isinstance(v, dict) else None
    inner = inner if isinstance(inner, dict) else {}
    if not isinstance(v, dict) or "trial" not in v or "status" not in v or ("accuracy" not in v and "accuracy" not in inner):
        return "columns"
    a = v["accuracy"] if "accuracy" in v else inner["accuracy"]
    fits = a is None or (type(a) in (int, float) and 0 <= a <= 100)
    return None if isinstance(v["trial"], str) and v["trial"].strip() and isinstance(v["status"], str) and v["status"].lower() in rejects.STATUSES and fits else "value"


LINES = [
    "a,keep,1,x", 'a,"keep",1,x', 'a,"keep" ,1,x', 'a, "keep",1,x', 'a,ke"ep,1,x', 'a,"ke""ep",1,x', 'a,keep,1,"x, y"', 'a,keep,1,"x""', '"a,keep,1,x', "a,keep,1", "a,keep,1,x,y", "", ",keep,1,x",
    "  ,keep,1,x", "a,KEEP , 1 ,x", "a,kept,1,x", "a,keep,,x", "a,keep,100,x", "a,keep,100.1,x", "a,keep,-0.1,x", "a,keep,1e1,x", "a,keep,nan,x", "a,keep,0x1,x", 'a,keep,"","""x"""', "a,keep,\"1\"\"\",x",
]
JSONS = [
    '{"trial":"a","status":"keep","accuracy":1}', '{"trial":"a","status":"keep","accuracy":null}', '{"trial":"a","status":"keep","accuracy":"1"}', '{"trial":"a","status":"keep","metrics":{"accuracy":3.5}}',
    '{"trial":"a","status":"keep","metrics":[1]}', '{"trial":"a","status":"Keep","accuracy":101}', '{"trial":" ","status":"keep","accuracy":1}', '{"trial":1,"status":"keep","accuracy":1}', '{"Trial":"a","status":"keep","accuracy":1}',
    "null", "[1]", '"x"', "7", "", " ", "{}", '{"trial":"a"', '{"trial":"a","status":"keep","accuracy":1} ', '{"trial":"a","status":"keep","accuracy":1}{}', '{"trial":"a","status":"keep","accuracy":1},{}',
    "{'trial':'a'}", '{"trial":"a","status":"keep","accuracy":NaN}', '{"trial":"a","status":"keep","accuracy":true}', '{"trial":"a","status":"keep","accuracy":01}', '{"trial":"a","status":null,"accuracy":1}',
    '{"trial":"a","trial":"b","status":"keep","accuracy":1}', '{"trial":"a","status":"keep","accuracy":[1]}', '{"trial":"a","status":"keep","accuracy":1,}',
]


def found(spark, rows):
    return {r["line_id"]: r["reason"] for r in rejects.rejected(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    noisy = ["".join(rng.choice('ab,"1 ') for _ in range(rng.randint(0, 14))) for _ in range(150)]
    rows = [(1, "f.csv", 1, HEAD, "x", "x"), (2, "f.csv", 1, "other,head", "x", "x"), (3, "g.tsv", 1, HEAD.replace(",", "\t"), "x", "x")]
    rows += [(100 + n, "f.csv", n + 2, x, None, None) for n, x in enumerate(LINES + noisy)]
    rows += [(1000 + n, "g.tsv", n + 2, x.replace(",", "\t"), None, None) for n, x in enumerate(LINES)]
    rows += [(2000 + n, "h.jsonl", n + 1, x, None, None) for n, x in enumerate(JSONS)]
    head = HEAD.split(",")
    expected = {i: r for i, p, n, x, *_ in rows if not (p != "h.jsonl" and n == 1) and (r := reason(p, x, head))}
    assert found(spark, rows) == expected


def test_nulls_missing_headers_and_repeats(spark):
    rows = [
        (1, "f.csv", 5, "a,keep,1,x", None, None), (2, None, 1, None, None, None), (3, None, None, '{"trial":"a","status":"keep","accuracy":1}', None, None), (4, "f.csv", None, "a,keep,1,x", None, None),
        (5, "b.csv", 1, 'tri"al,x', None, None), (6, "b.csv", 2, "a,b", None, None), (7, "h.jsonl", 1, "x", None, None), (7, "h.jsonl", 1, "x", None, None),
    ]
    assert found(spark, rows) == {1: "columns", 2: "syntax", 4: "columns", 6: "columns", 7: "syntax"}


def test_experiments_are_what_the_rejects_leave(spark):
    rows = [(1, "f.csv", 1, HEAD, "x", "x"), (2, "f.csv", 2, ' a , KEEP ,8.5e1,"n"', "x", "x"), (3, "f.csv", 3, "a,keep,,x", "x", "x"), (4, "f.csv", 4, "a,no,1,x", "x", "x"), (5, "h.jsonl", 1, '{"trial":"b","status":"Crash","metrics":{"accuracy":null}}', "x", "x")]
    got = {r["line_id"]: (r["trial"], r["status"], r["accuracy"]) for r in rejects.experiments(spark.createDataFrame(rows + rows[1:2], SCHEMA)).collect()}
    assert got == {2: ("a", "keep", 85.0), 3: ("a", "keep", None), 5: ("b", "crash", None)}


def test_empty_and_long(spark):
    assert found(spark, []) == {}
    long = ",".join(['"' + 'x""' * 3000 + '"', "keep", "1", "y" * 100_000])
    assert found(spark, [(1, "f.csv", 1, HEAD, None, None), (2, "f.csv", 2, long, None, None)]) == {}


@pytest.mark.parametrize("quotes", [1, 2, 3])
def test_one_hot_file_is_spread(spark, quotes):
    rows = [(0, "f.csv", 1, HEAD, None, None)] + [(n, "f.csv", n + 1, "a,keep,1," + '"' * quotes, None, None) for n in range(1, 200)]
    assert len(found(spark, rows)) == (0 if quotes == 2 else 199)


def test_private_characters_inside_quotes_stay(spark):
    rows = spark.createDataFrame([('a,"x\ue001y,z\ue001b\ue001a",c',)], "l string")
    assert rows.select(rejects.cells_of(rejects.F.col("l"), rejects.F.lit(",")).alias("c")).first()["c"] == ["a", "x\ue001y,z\ue001b\ue001a", "c"]
