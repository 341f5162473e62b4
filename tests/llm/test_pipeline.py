"""Each stage of the pipeline against a brute-force version of it, and the odd rows that a stage may meet."""

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(9)
    vocabulary = {"en": ["the", "of", "thing", "with", "there", "and", "on"], "de": ["der", "und", "schön", "größe", "nicht", "ein", "zu"]}
    out = []
    for k in range(120):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "", "er", "ing", str(rng.randrange(9))]) for _ in range(rng.randrange(5, 90))]
        text = " ".join(w + ("\n" if rng.random() < 0.15 else "") for w in words)
        out.append([k, text, lang, rng.choice(["s1", "s1", "s2", None]), len(text)])
    for k in range(120, 150):
        text = out[k - 100][1]
        if k % 2:
            text = text.replace(" ", " x ", 1)
        out.append([k, text, None, "s3", len(text)])
    out += [[150, None, None, None, None], [151, "", "en", "s1", 0], [152, "12 34 ...", "en", "s1", 9], [None, "the thing of there", "en", "s2", 18], [3, out[3][1], "en", "s1", 1], [160, "Ωμέγα άλφα βήτα γάμμα δέλτα", None, "s1", 27]]
    return [tuple(r) for r in out]


def table(spark, some, schema=SCHEMA):
    return spark.createDataFrame(some, schema).repartition(3)


def as_set(df):
    return sorted(map(repr, map(tuple, df.select(pipeline.COLUMNS).collect())))


def test_language_id(spark):
    got = pipeline.language_id(spark, table(spark, rows()), "")
    kept = {r["doc_id"]: r for r in got.collect()}
    assert not kept.keys() & {150, 151, 152, 160}
    assert set(range(150)) <= kept.keys() and None in kept
    assert {kept[k]["lang"] for k in range(120, 150)} <= {"en", "de"}
    assert all(kept[i]["text"] == t for i, t, *_ in rows() if i in kept and i != 3)


def test_line_dedup(spark):
    some = rows()
    seen, want = {}, []
    order = sorted(range(len(some)), key=lambda k: (some[k][0] is not None, some[k][0] or 0, some[k][1] or ""))
    for k in order:  # the earliest place of each window; rows of one doc_id share places
        lines = (some[k][1] or "").split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            place = (some[k][0] is not None, some[k][0] or 0, i)
            if re.search(WORD, "".join(w)):
                seen[w] = min(seen.get(w, place), place)
    for i, text, lang, source, n in some:
        lines = (text or "").split("\n")
        gone = {p for j in range(len(lines) - 2) if seen.get(tuple(lines[j : j + 3]), (i is not None, i or 0, j)) < (i is not None, i or 0, j) for p in range(j, j + 3)}
        left = "\n".join(x for p, x in enumerate(lines) if p not in gone)
        if not gone or re.search(WORD, left):
            want.append((i, left if text is not None else None, lang, source, len(left) if gone else n))
    assert as_set(pipeline.line_dedup(spark, table(spark, some), "")) == sorted(map(repr, want))


def test_jaccard_join(spark):
    some = rows()
    long = [some[k] for k in range(120) if len(some[k][1].split()) > 60]
    alone = " ".join(f"only{k}" for k in range(80))
    # near copies that share a doc_id, copies without one, and near copies of which none has one
    some += [(long[0][0], long[0][1] + " x", "en", "s1", 1), (None, long[1][1], "en", "s1", 1), (None, alone, "en", "s1", 1), (None, alone + " more", "en", "s1", 1)]

    def shingles(text):
        w = re.findall(WORD, (text or "").lower())
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    unique = list(dict.fromkeys(some))
    sets = [shingles(r[1]) for r in unique]
    root = list(range(len(unique)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(unique)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups: dict = {}
    for i, r in enumerate(unique):
        groups.setdefault(find(i), []).append(r)
    least = sorted(repr(min((r[0] for r in g if r[0] is not None), default=None)) for g in groups.values())
    group = {r: k for k, g in groups.items() for r in g}
    got = [tuple(r) for r in pipeline.jaccard_join(spark, table(spark, some), "").select(pipeline.COLUMNS).collect()]
    assert sorted(group[r] for r in got) == sorted(groups)  # one of each group
    assert sorted(repr(r[0]) for r in got) == least


def test_mix_sources(spark):
    some = rows()
    got = pipeline.mix_sources(spark, table(spark, some), "").collect()
    times: dict = {}
    for r in got:
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert times.keys() <= set(some) and max(times.values()) <= 2
    size = lambda t: len(re.findall(WORD, t or ""))
    total, taken = sum(size(r[1]) for r in some), sum(size(r[1]) * n for r, n in times.items())
    assert abs(taken - 1.5 * total) <= 4 * max(size(r[1]) for r in some)


def test_run_and_empty(spark, tmp_path):
    table(spark, rows()).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r["doc_id"] for r in got} <= {r[0] for r in rows()}
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 2048 for r in got)
    nothing = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
