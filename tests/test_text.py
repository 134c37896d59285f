import random
import re

import pytest
from pyspark.sql import functions as F

from casegrid.functions.text import decode_utf8, normalize, strip

# input -> normalised text, written out
NORMALISED = {
    "a  b   c": "a b c",
    "line1\r\n\r\n\r\n\r\nline2": "line1\n\nline2",
    "nul\x00here": "nulhere",
    "\ttabbed\t\tline\t": "tabbed line",
    " nbsp edges ": "nbsp edges",
    "　ideographic　": "ideographic",
    "next\u0085line": "next\u0085line",
    "seps\x1c\x1d\x1e\x1f": "seps",
    "zero​width kept​": "zero​width kept​",
    "﻿bom kept": "﻿bom kept",
    "   \n   \n  text  \n   \n   ": "text",
    "": "",
    "\r\r\rcr only": "cr only",
    "a\n \t\n\n \nb": "a\n\nb",
    "a   b": "a   b",
    "x\x0b\x0cy\x0b": "x\x0b\x0cy",
    "one\n\ntwo\nthree": "one\n\ntwo\nthree",
}
STRIPPED = {" \t a \n": "a", "  ": "", "​": "​", "\x1fx\x1c": "x", "a b": "a b", "᠎a": "᠎a"}
DECODED = {
    b"ab\xffc": "ab�c", b"\xe2\x82": "�", b"\xf0\x9f\x98": "�", b"\xc0\xaf": "��",
    b"\xed\xa0\x80": "���", b"\xe2\x28\xa1": "�(�", b"\xef\xbb\xbfbom": "﻿bom", b"": "",
}


def _run(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(values)], f"i int, s {kind}")
    return [r.o for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(("fn", "table", "kind"), [(normalize, NORMALISED, "string"), (strip, STRIPPED, "string"), (decode_utf8, DECODED, "binary")])
def test_tables(spark, fn, table, kind):
    assert dict(zip(table, _run(spark, table, fn, kind), strict=True)) == table


def test_normalize_properties(spark):
    rnd = random.Random(7)
    pieces = list("ab .,") + ["\t", "\n", "\r", "\r\n", "\x00", " ", "　", "\u0085", "\x1c", "​", "﻿", "  ", "\n\n\n\n", "é"]
    dirty = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    clean = _run(spark, dirty, normalize)
    assert _run(spark, clean, normalize) == clean
    for before, after in zip(dirty, clean, strict=True):
        assert not re.search("\x00|\r|\t|  |\n\n\n", after) and after == after.strip()
        assert all(line == line.strip() for line in after.split("\n"))
        visible = lambda t: re.sub(r"[\s\x00]", "", t)
        assert visible(before) == visible(after)


def test_normalize_keeps_long_texts_whole(spark):
    text = "word " * 200_000
    assert _run(spark, [text], normalize) == [text.strip()]
