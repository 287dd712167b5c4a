"""The structural index against a plain character-by-character reader."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sluicebox.operators.parse_rejects import NumberRule, RecordFormat, parse_records, rejected_rows, valid_rows

FORM = RecordFormat(("a", "n", "p"), (NumberRule(1, "bad_n", whole=True, low=1), NumberRule(2, "bad_p", high=1)))


def read(line, form=FORM):
    line = "" if line is None else line
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            text, i = "", i + 1
            while True:
                if i >= len(line):
                    return "bad_quoting", None
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    text, i = text + '"', i + 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    text, i = text + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return "bad_quoting", None
        else:
            end = line.find(",", i)
            end = len(line) if end < 0 else end
            text, i = line[i:end], end
            if '"' in text:
                return "bad_quoting", None
        fields.append(text)
        if i >= len(line):
            break
        i += 1
    if len(fields) != len(form.columns):
        return "column_count", None
    if not re.fullmatch("[0-9]+", fields[1].strip(" \t")) or int(fields[1].strip(" \t")) < 1:
        return "bad_n", None
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)?", fields[2].strip(" \t")) or float(fields[2]) > 1:
        return "bad_p", None
    return None, fields


def compare(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    got = {r.id: (r.reason, r.fields) for r in parse_records(df, form=FORM).collect()}
    for i, line in enumerate(lines):
        want = read(line)
        assert got[i] == want if line is not None else got[i] == ("column_count", None), line


def test_cases(spark):
    compare(spark, [
        "x,1,0.5", '"x",1,1', '"a,""b""",2,0', 'a"b,1,0', '"a"b,1,0', '"a,1,0', "x,1", "x,1,0,", "", None, "x, 7 ,\t0.1 ", "x,1,0.5\r", '"x\ny",1,0', "x,0,0", "x,1.0,0", "x,٣,0", "x,1,1.01", "x,1,.5", "x,1,5.",
        "x,,0", "x,1,", '"",1,0', '"""",1,0', '"a"",1,0', 'x,"1","0.2"', 'x," 1 ",0', "x,00012,0", "x,1," + "0" * 5000 + "1", "ü" * 20000 + ",1,0", '"x" ,1,0', "x,1,0\r\r", 'x,1,"0\r"', "x,-1,0", "x,1e3,0",
    ])


def test_random(spark):
    rng = random.Random(1)
    compare(spark, ["".join(rng.choice('"",,1 0.x\r\n') for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["".join(rng.choice(['"a"', ",", "1", '""', ",0", "x"]) for _ in range(rng.randint(1, 8))) for _ in range(4000)])


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("old", "x,1,0", 5), ("old", "x", 6)], "reason string, line string, a int")
    out = parse_records(df, form=FORM)
    assert sorted(out.columns) == ["a", "fields", "line", "reason"]
    assert [r.reason for r in out.orderBy("a").collect()] == [None, "column_count"]
    assert [tuple(r) for r in valid_rows(out, FORM).select("a", "n", "p").collect()] == [("x", 1, 0.0)]
    assert rejected_rows(out).count() == 1
    assert parse_records(df.where("false"), form=FORM).count() == 0
    with pytest.raises(ValueError, match="no column"):
        parse_records(df, "absent")


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([("x,1,0",)] * 50, "line string")
    assert parse_records(df, form=FORM).where(F.col("reason").isNull()).count() == 50
