"""The commonest script of a text, against a count of its letters."""

import random

from pyspark.sql import functions as F

from paralex.functions import text as T

LETTERS = {"Latn": "aZéßǆ", "Cyrl": "жЯѣ", "Grek": "αΩἀ", "Arab": "بم", "Hebr": "אש", "Deva": "कह"}
OTHERS = "1 .,\u0301漢あʹ€\U0001f600"


def brute(text):
    found = [(sum(c in letters for c in text), -min(map(text.index, filter(text.__contains__, letters)), default=0), name) for name, letters in LETTERS.items()]
    best = max(found)
    return best[2] if best[0] else None


def test_scripts(spark):
    rng = random.Random(8)
    rows = ["".join(rng.choice(rng.choice(rng.sample([*LETTERS.values(), OTHERS], 3))) for _ in range(rng.randrange(12))) for _ in range(1500)]
    rows += ["", OTHERS, "plain words", "漢字 zaZ"]
    got = {r["x"]: r["s"] for r in spark.createDataFrame([(x,) for x in rows], "x string").select("x", T.dominant_script(F.col("x")).alias("s")).collect()}
    assert got == {x: brute(x) for x in rows}


def test_latin_texts_are_not_counted_by_script(spark):
    """Two searches tell a text that holds no other script; counts come after them only."""
    plan = str(T.dominant_script(F.col("x"))._jc.toString())
    assert plan.startswith("CASE WHEN RLIKE(x,") or plan.startswith("CASE WHEN rlike(x,")
