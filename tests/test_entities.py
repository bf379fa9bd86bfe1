"""Character references against the standard decoder."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from capsule.functions.entities import unescape


def test_every_reference(spark):
    rng = random.Random(1)
    texts = [f"a &{n} b" for n in html5] + [f"&{n}x&{n}" for n in html5 if not n.endswith(";")]
    texts += [f"&#{n};&#x{n:X}; &#{n}z" for n in [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFE, 0xFFFF, 0x10000, 0x1F642, 0x1FFFE,
                                                  0x10FFFF, 0x110000, 10 ** 12]]
    pieces = ["&", "amp", ";", "&amp;", "&AMP", "#", "#x", "&#", "&#x", "41", "0041", " ", "lt", "&notit;", "&notin;", "&#0;", "&#128;", "é", "&eacute", "\U0001F642", "<", "\t"]
    texts += ["".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(3000)] + ["", "&", "&&", "&#;", "&#x;", "no reference"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").repartition(4)
    got = {r.t: r.u for r in df.select("t", unescape(F.col("t")).alias("u")).collect()}
    assert got.pop(None) is None
    assert {t: u for t, u in got.items() if u != html.unescape(t)} == {}
