"""Golden cases, property tests against sequential folds, readers, registry, streaming."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from paralex.functions import tensor
from paralex.functions import text as T
from paralex.operators import batching, compare, metrics, monitor, registry, replay, validate
from paralex.sources import readers, sinks
from paralex.streaming import events as stream


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r["y"] for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_text_functions(spark):
    assert column(spark, ["  Price:\t 1,234.50!  ", "é"], T.normalize_text) == ["Price: 1,234.50!", "é"]
    assert column(spark, ["Hello, world!", "Straße", "!!!"], T.signature) == ["helloworld", "strasse", "!!!"]
    assert column(spark, ["helloworld", "strasse", "!!!"], lambda x: T.bucket(x, 42)) == [0.7584235887623191, 0.4367818058004244, 0.8016564926663846]
    marks = ["<b>x</b>", "<br/>", "plain", "a < b", "<b><i>x</b></i>", "<br>", "</a/>", "x > y"]
    assert column(spark, marks, T.markup_balanced) == [True, True, True, False, False, False, False, False]
    assert column(spark, ["abc", "где мы a", "", "12", "αβγ"], T.dominant_script) == ["Latn", "Cyrl", None, None, "Grek"]
    assert column(spark, ["", " ", "a  b c"], T.word_count) == [0, 0, 3]
    assert column(spark, ["pair-v1.20.3", "none"], T.semver) == [(1, 20, 3), None]
    assert column(spark, ["ok_1", "-no", "", "end\n"], T.is_identifier) == [True, False, False, False]


def test_case_folding_is_full(spark):
    """Final sigma, long s, ligatures, dotted I and every other character with case."""
    texts = ["ΟΔΟΣ οδος", "Straſſe STRASSE", "ﬁne Oﬃce", "İstanbul", "ẞ ŉ µ"]
    assert column(spark, texts, T.casefold) == [x.casefold() for x in texts]
    letters = [chr(k) for k in range(0x20000) if chr(k).casefold() != chr(k)]
    assert column(spark, letters, T.casefold) == [x.casefold() for x in letters]


def test_settled_texts_are_in_normal_form():
    import unicodedata

    settled = [chr(c) for c in (*range(0x300), *range(0x2002, 0x20D0))]
    seconds = {unicodedata.normalize("NFD", chr(c))[-1] for c in range(0x30000) if len(unicodedata.normalize("NFD", chr(c))) > 1}
    assert all(unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c not in seconds for c in settled)


def test_preservation(spark):
    s = "Save {name} as <b>file 12</b>!"
    rows = spark.createDataFrame([(s, s, s)], "source string, reference string, candidate string")
    got = metrics.text_metrics(rows).first()
    assert [got[f"{k}_accuracy"] for k in ("number", "punctuation", "placeholder", "markup")] == [1.0] * 4 and got["exact_match"] == 1.0
    assert column(spark, ["12 and 12 and 1,5"], lambda x: T.preservation(x, F.lit("12 x 1,5"), T.NUMBER)) == [2 / 3]


def records(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord long, source string, target string")


def test_conflicts(spark):
    rules = validate.Rules(maximum_ratio=4.0)
    got = validate.validate(records(spark, [("aa", "bb"), ("aa", "bb"), ("aa", "cc"), ("dd", "bb"), ("", "ee")]), rules)
    assert [r["reasons"] for r in got.orderBy("ord").collect()] == [
        [],
        ["duplicate_pair", "source_duplicate", "target_duplicate"],
        ["source_duplicate", "conflicting_translation"],
        ["target_duplicate", "conflicting_translation"],
        ["empty", "missing_value"],
    ]
    r = validate.report(got).first()
    assert (r["total_rows"], r["rejected_rows"], r["duplicate_rows"], r["conflicting_pairs"], r["empty_rows"]) == (5, 4, 1, 2, 1)


def fold(rows):
    sources, targets, kept = set(), set(), []
    for k, (s, t) in enumerate(rows):
        if s not in sources and t not in targets:
            sources.add(s)
            targets.add(t)
            kept.append(k)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_greedy_is_the_sequential_fold(spark, seed):
    """By rounds, by components, and by the first rows of components that are too large."""
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(12)}", f"t{rng.randrange(12)}") for _ in range(60)] + [("chain0", "c0"), ("chain0", "c1"), ("chain1", "c1"), ("chain1", "c2")]
    rows += [(f"u{rng.randrange(200)}", f"v{rng.randrange(200)}") for _ in range(240)]
    for rounds, largest in ((2, 1000), (0, 1000), (0, 20)):
        got = validate.greedy_accept(records(spark, rows).repartition(3), rounds, largest)
        assert sorted(r["ord"] for r in got.collect()) == fold(rows)


@pytest.mark.parametrize("order", ["rising", "random"])
def test_a_long_chain_takes_few_tables(spark, monkeypatch, order):
    """10,000 rows, each of which shares its source with the one before and its target with the one after."""
    rows = [(f"s{(k + 1) // 2}", f"t{k // 2}") for k in range(10_000)]
    if order == "random":
        random.Random(1).shuffle(rows)
    tables = []
    write = validate.written
    monkeypatch.setattr(validate, "written", lambda df, name: (tables.append(name), write(df, name))[1])
    got = validate.greedy_accept(records(spark, rows))
    assert sorted(r["ord"] for r in got.collect()) == fold(rows)
    assert len(tables) < 30


def test_components(spark):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(150)}", f"t{rng.randrange(150)}") for _ in range(160)]
    label = {k: k for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(rows):
            for b, y in enumerate(rows):
                if (x[0] == y[0] or x[1] == y[1]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    table = records(spark, rows).select("ord", F.col("source").alias("s"), F.col("target").alias("t"))
    groups: dict = {}
    for r in validate.components(table).collect():
        groups.setdefault(r["label"], set()).add(r["ord"])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(k for k in label if label[k] == v) for v in set(label.values()))


def test_split_of_sixty_rows(spark):
    rows = records(spark, [(f"item {k}", f"line {k}") for k in range(1, 61)])
    sizes = {r["split"]: r["rows"] for r in validate.split_sizes(validate.split(rows, 0.7, 0.15, 42)).collect()}
    assert sizes == {"train": 49, "validation": 6, "test": 5}
    assert {r["split"]: r["rows"] for r in validate.split_sizes(validate.split(rows.limit(0))).collect()} == {"train": 0, "validation": 0, "test": 0}


def test_replay(spark):
    new, old = records(spark, [(f"n{k}", "x") for k in range(3)]), records(spark, [(f"o{k}", "y") for k in range(10)])
    got, report = replay.mixture(new, old, "balanced", 1, "ord")
    assert got.count() == 6 and report["sampled_historical_examples"] == 3 and report["effective_new_fraction"] == 0.5
    assert replay.mixture(new, old, None, 1, "ord")[1]["mode"] == "new_data_only"
    assert replay.sample(old, 25, 1, "ord").count() == 25
    assert [replay.history_count("percentage", 5, new_ratio=1.0, history_ratio=0.5), replay.history_count("weighted", 7, new_ratio=1.0, history_ratio=0.5)] == [2, 4]
    with pytest.raises(ValueError):
        replay.mixture(new.limit(0), old, "balanced", 1, "ord")


def fold_batches(lengths, budget):
    out, batch, rows, longest = [], 0, 0, 0
    for length in lengths:
        if rows and max(longest, length) * (rows + 1) * 2 > budget:
            batch, rows, longest = batch + 1, 0, 0
        rows, longest = rows + 1, max(longest, length)
        out.append(batch)
    return out


def test_batches_of_any_order_are_the_sequential_fold(spark):
    """Over one and many blocks, down to blocks as long as a batch."""
    rng = random.Random(8)
    for budget, block in ((1, 1), (16, 8), (16, 24), (60, 31), (200, None)):
        lengths = [rng.choice([1, 1, 2, rng.randrange(1, 30)]) for _ in range(300)]
        rows = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "k long, length long").repartition(3)
        got = [r["batch_id"] for r in batching.greedy_batches(rows, "k", "length", budget, block).orderBy("k").collect()]
        assert got == fold_batches(lengths, budget)
    assert batching.greedy_batches(rows.limit(0), "k", "length", 16).count() == 0
    with pytest.raises(ValueError):
        batching.greedy_batches(rows, "k", "length", 16, 4)


def test_batches_are_the_sequential_fold(spark):
    rng = random.Random(4)
    for budget in (1, 16, 200):
        lengths = sorted(rng.randrange(1, 30) for _ in range(120))
        rows = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "k long, length long")
        got = [r["batch_id"] for r in batching.sorted_batches(rows, "length", "k", budget).orderBy("k").collect()]
        assert got == fold_batches(lengths, budget)
    for _ in range(500):
        lengths = sorted(rng.randrange(1, 9) for _ in range(rng.randrange(1, 30)))
        counts = sorted({n: lengths.count(n) for n in lengths}.items())
        budget, out = rng.randrange(1, 60), []
        for (n, rows), (_, first, room, capacity) in zip(counts, batching.plan_sorted(counts, budget), strict=True):
            out += [first if j < room else first + 1 + (j - room) // capacity for j in range(rows)]
        assert out == fold_batches(lengths, budget)


def test_word_edits_are_those_of_the_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(least, 90))] for least in (0, 1))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        assert metrics._distance(a, metrics._masks(b), len(b)) == row[-1]


def test_corpus_metrics(spark):
    rows = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("a b c d", "a b x d")], "candidate string, reference string")
    assert abs(metrics.bleu_score(metrics.bleu_statistics(rows.limit(1))) - 100.0) < 1e-9
    assert metrics.bleu_score(metrics.bleu_statistics(rows.limit(0))) == metrics.chrf_score(metrics.chrf_statistics(rows.limit(0))) == 0.0
    # matches 3, 1, 0, 0 of 4, 3, 2, 1: the last two orders count half and a quarter of a match
    smoothed = metrics.bleu_statistics(spark.createDataFrame([("a b x d", "a b c d")], "candidate string, reference string"))
    assert abs(metrics.bleu_score(smoothed) - 100 * (3 / 4 * 1 / 3 * 0.5 / 2 * 0.25 / 1) ** 0.25) < 1e-9
    stats = metrics.bleu_statistics(rows).first().asDict()
    assert (stats["match_1"], stats["total_1"], stats["match_4"], stats["total_4"]) == (9, 10, 3, 4)
    assert abs(metrics.chrf_score(metrics.chrf_statistics(rows.limit(1))) - 100.0) < 1e-9
    assert metrics.ter_edits("b c d a", "a b c d") == (1, 4)
    assert metrics.ter_edits("a b", "a b c") == (1, 3)
    assert metrics.ter(rows).first()["edits"] == 1
    t = metrics.tokenize_13a
    assert column(spark, ["Hello, world! 1,000.5 it's &amp; x-y 5-6."], t, "string")[0] == ["Hello", ",", "world", "!", "1,000.5", "it's", "&", "x-y", "5", "-", "6", "."]


def test_tensors(spark):
    rows = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 3.0])], "label int, x array<double>")
    loss = rows.select(F.avg(tensor.smoothed_cross_entropy(tensor.log_softmax(F.col("x")), F.col("label"), 0.0)).alias("l")).first()["l"]
    assert abs(loss - math.log(1 + math.exp(-3))) < 1e-12
    assert column(spark, [[1.0, 5.0, 5.0]], tensor.argmax, "array<double>") == [1]
    assert column(spark, [[1.0, 5.0, 5.0]], lambda x: tensor.top_k(x, 2), "array<double>") == [[1, 2]]


VERSIONS = [
    ("aa-bb-aa-to-bb-v1.0.0", "v1.0.0", None, "approved", False),
    ("aa-bb-aa-to-bb-v1.1.0", "v1.1.0", "aa-bb-aa-to-bb-v1.0.0", "approved", False),
    ("aa-bb-aa-to-bb-v1.10.0", "v1.10.0", "aa-bb-aa-to-bb-v1.1.0", "candidate", False),
    ("aa-bb-aa-to-bb-v1.2.0", "v1.2.0", "aa-bb-aa-to-bb-v1.1.0", "approved", False),
    ("aa-bb-aa-to-bb-v2.0.0", "v2.0.0", None, "rejected", False),
]


def versions_of(spark, rows=VERSIONS):
    return spark.createDataFrame(rows, "version_id string, version_label string, parent_version string, status string, protected boolean")


def test_registry(spark, tmp_path):
    held = registry.Registry(spark, str(tmp_path / "registry"))
    assert held.versions() is None and held.production() is None
    held.add(versions_of(spark))
    ids = [v[0] for v in VERSIONS]
    held.promote(ids[1])
    assert {(r["parent"], r["label"]) for r in registry.free_labels(held.versions()).collect()} == {(1, "v1.11.0"), (2, "v2.1.0"), (None, "v3.0.0")}
    assert [r["version_label"] for r in registry.sorted_versions(held.versions()).collect()] == ["v1.0.0", "v1.1.0", "v1.2.0", "v1.10.0", "v2.0.0"]
    for wrong in (lambda: held.promote(ids[4]), lambda: held.promote("nowhere"), lambda: held.update(ids[1], parent_version="x"), lambda: held.resolve("v7.0.0"), lambda: held.rollback("v2.0.0"), lambda: held.add(versions_of(spark, VERSIONS[:1]))):
        with pytest.raises(registry.RegistryError):
            wrong()
    assert held.log.length() == 2
    held.promote(ids[3])
    held.rollback("v1.1.0")
    held.protect(ids[4])
    held.rollback("v2.0.0")
    held.add(versions_of(spark, [("aa-bb-aa-to-bb-v3.0.0", "v3.0.0", ids[4], "candidate", False)]))
    rows = {r["version_label"]: (r["status"], r["protected"]) for r in held.versions().collect()}
    assert rows == {"v1.0.0": ("approved", False), "v1.1.0": ("approved", True), "v1.10.0": ("candidate", False), "v1.2.0": ("approved", True), "v2.0.0": ("production", True), "v3.0.0": ("candidate", False)}
    assert held.resolve("production") == ids[4] == held.production()
    assert {r["status"] for r in held.versions(held.log.entries()[:2]).collect() if r["version_id"] == ids[1]} == {"production"}
    up = {(r["version_id"][-6:], r["ancestor"][-6:], r["depth"]) for r in registry.ancestry(held.versions()).collect()}
    assert {x for x in up if x[0] == "1.10.0"} == {("1.10.0", "1.10.0", 0), ("1.10.0", "v1.1.0", 1), ("1.10.0", "v1.0.0", 2)}
    assert compare.interpretation({"chrf": 1.0, "bleu": 0.0, "markup_accuracy": -0.1}, True)["formatting_regression"]


def test_writers_race(spark, tmp_path):
    """Of writers of one number a single one wins; the others decide again on what it wrote, and none is lost."""
    from concurrent.futures import ThreadPoolExecutor

    from paralex.sources.commits import Log, put_new

    log = Log(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: log.put(0, {"by": k}), range(8)))
        assert sum(won) == 1 and log.entries() == [{"by": won.index(True)}]
        list(pool.map(lambda k: log.commit(lambda now: {"by": k, "saw": len(now)}), range(8)))
    entries = log.entries()[1:]
    assert [e["saw"] for e in entries] == list(range(1, 9)) and sorted(e["by"] for e in entries) == list(range(8))
    assert log.commit(lambda now: None) == 9
    assert put_new(spark, str(tmp_path / "x.txt"), "é") and not put_new(spark, str(tmp_path / "x.txt"), "other") and (tmp_path / "x.txt").read_text() == "é"


def test_two_registries_of_one_folder(spark, tmp_path):
    """A promotion that loses the race sees the winner's version in production and sends that back to approved."""
    a, b = (registry.Registry(spark, str(tmp_path / "r")) for _ in range(2))
    a.add(versions_of(spark))
    commit, ids = b.log.commit, [v[0] for v in VERSIONS]

    def late(decide):
        def overtaken(entries):
            if len(entries) == 1:
                a.promote(ids[0])
            return decide(entries)

        return commit(overtaken)

    b.log.commit = late
    b.promote(ids[1])
    assert [e.get("production") for e in a.log.entries()] == [None, ids[0], ids[1]]
    assert {r["version_id"] for r in a.versions().where("status = 'production'").collect()} == {ids[1]}


def test_readers(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "source.txt").write_text("a b\nc", "utf-8")
    (raw / "target.txt").write_text("x\ny\nz\n", "utf-8")
    (raw / "p.tsv").write_text('source_text\ttarget_text\tdomain\ns1\tt1\tgeneral\n\ns2\n"q ""x"""\tt3\t\n', "utf-8")
    (raw / "p.csv").write_text("source_text,target_text,domain,extra\nc1,d1,,e\n\nc2,,dom,f\n", "utf-8")
    (raw / "p.jsonl").write_text('{"source": "j1", "target_text": "k1", "n": 1}\n{"source": 5, "target": "k2", "domain": "d"}\n', "utf-8")
    root = str(tmp_path)
    inputs = readers.discover_inputs(spark, root)
    assert inputs == ["raw/source.txt", "raw/target.txt", "raw/p.tsv", "raw/p.csv", "raw/p.jsonl"]
    rows = readers.read_all(spark, root, inputs).orderBy("file_ord", "row_number").collect()
    got = [(r["source"], r["target"], r["row_number"], r["domain"]) for r in rows]
    assert got == [
        ("a", "x", 1, None), ("b", "y", 2, None), ("c", "z", 3, None),
        ("s1", "t1", 2, "general"), ("", "", 3, None), ("s2", "", 4, None), ('q "x"', "t3", 5, None),
        ("c1", "d1", 2, None), ("c2", "", 3, "dom"),
        ("j1", "k1", 1, None), ("", "k2", 2, "d"),
    ]
    assert json.loads(rows[7]["metadata"]) == {"extra": "e"}
    (raw / "target.txt").write_text("x\n", "utf-8")
    with pytest.raises(readers.DatasetAlignmentError):
        readers.read_parallel_text(spark, root, "raw/source.txt", "raw/target.txt")
    (raw / "bad.jsonl").write_text("{}\n[1]\n", "utf-8")
    with pytest.raises(Exception, match="no object"):
        readers.read_jsonl(spark, root, "raw/bad.jsonl").count()
    (raw / "bad.tsv").write_bytes(b"a\xff\tb\n")
    with pytest.raises(Exception, match="not UTF-8"):
        readers.read_tsv(spark, root, "raw/bad.tsv").count()
    with pytest.raises(FileNotFoundError):
        readers.discover_inputs(spark, str(tmp_path / "none"))


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """Against str.splitlines: all line ends, a mark at the front, blank and last lines, blocks of a few bytes."""
    ends = ["\n", "\r", "\r\n", "\x0b", "\u2028", "\x85", "\n\n"]
    whole = "\ufeff" + "".join(f"line {k} é{ends[k % len(ends)]}" for k in range(300))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        for k, text in enumerate([whole, whole + "end", whole + "end\x0b", "a\x0b\n", "", "\n", "x"]):
            path = tmp_path / f"{k}.txt"
            path.write_bytes(text.encode())
            got = readers.numbered_lines(spark, str(path)).orderBy("row_number").collect()
            assert [r["line"] for r in got] == text.splitlines()
            assert [r["row_number"] for r in got] == list(range(1, len(got) + 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inputs_to_translate(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n", "utf-8")
    (tmp_path / "b.txt").write_text("one\n \n", "utf-8")
    (tmp_path / "c.txt").write_text("", "utf-8")
    assert [r["source"] for r in readers.read_inputs(spark, str(tmp_path / "a.txt")).orderBy("row_number").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="blank line 2"):
        readers.read_inputs(spark, str(tmp_path / "b.txt")).collect()
    with pytest.raises(readers.DatasetFormatError):
        readers.read_inputs(spark, str(tmp_path / "c.txt"))


def test_digest_trees(spark, tmp_path):
    """Differences against a look at all rows; only unequal ranges are read; order and files don't count."""
    old = {k: (f"text {k}", None if k % 5 else "x") for k in range(400)}
    new = {k: v for k, v in old.items() if k % 97} | {11: ("other", None), 12: (None, "x"), 1000: ("new", "y")}
    schema, paths, roots = "k long, text string, more string", [], []
    for name, rows in (("a", old), ("b", new), ("c", dict(reversed(old.items())))):
        paths.append(str(tmp_path / name))
        table = spark.createDataFrame([(k, *v) for k, v in rows.items()], schema).repartition(len(name) + len(rows) % 3)
        roots.append(sinks.write_tree(table, "k", paths[-1], leaves=64, fan=4))
    assert roots[0] == roots[2] != roots[1]
    got = {r["k"]: r["change"] for r in sinks.tree_difference(spark, paths[0], paths[1]).collect()}
    assert got == {k: "added" if k not in old else "removed" if k not in new else "changed" for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    assert sinks.tree_difference(spark, paths[0], paths[2]).count() == 0
    sinks.write_tree(spark.createDataFrame([], schema), "k", str(tmp_path / "none"), leaves=64, fan=4)
    assert sinks.tree_difference(spark, str(tmp_path / "none"), paths[0]).where("change = 'added'").count() == 400


def test_versioned_dataset(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.tsv").write_text("\n".join(f"item {k}\tline {k}\tgeneral" for k in range(1, 61)), "utf-8")
    inputs = readers.discover_inputs(spark, str(tmp_path))
    version = sinks.fingerprint(sinks.file_hashes(spark, str(tmp_path), inputs), {"seed": 42})
    rows = readers.read_all(spark, str(tmp_path), inputs).withColumn("ord", F.shiftleft(F.col("file_ord").cast("long"), 40) + F.col("row_number"))
    judged = validate.validate(rows, validate.Rules())
    ok = validate.split(judged.where(F.size("reasons") == 0), 0.7, 0.15)
    out = str(tmp_path / "out")
    base = sinks.write_dataset(ok, judged.where(F.size("reasons") > 0), validate.report(judged).first().asDict(), out, version, {"inputs": inputs})
    assert spark.read.parquet(f"{base}/processed").where("split = 'train'").count() == 49
    assert readers.read_document(spark, f"{out}/current.json")["dataset_version"] == version
    assert readers.read_document(spark, f"{out}/missing.json", 7) == 7


def test_scans_of_long_runs(spark, request):
    """One run over all partitions, a short one, one without values, one without a name: against a walk over the rows."""
    rng = random.Random(6)
    values = lambda n: [None if rng.random() < 0.1 else float(rng.randrange(40) + 3 * (k % 7)) for k in range(n)]
    runs = {1: [None, None, *values(900)], 2: values(5), 3: [None] * 4, None: values(30)}
    rows = [(run, k, v) for run, vs in runs.items() for k, v in enumerate(vs)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "run int, step int, loss double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else be one partition
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert len({r["__p"] for r in monitor._parts(table, "run", "step").where("run = 1").collect()}) > 1
    want, sums = {}, {}
    for run, vs in runs.items():
        best, streak, total = None, 0, None
        for k, v in enumerate(vs):
            improved = True if best is None else None if v is None else v < best
            best = best if v is None else v if best is None else min(best, v)
            streak = 0 if improved else streak + 1
            total = total if v is None else v + (total or 0)
            want[run, k], sums[run, k] = (improved, best, streak), total
    assert {(r["run"], r["step"]): (r["improved"], r["best"], r["streak"]) for r in monitor.best_so_far(table, "run", "step", "loss").collect()} == want
    assert {(r["run"], r["step"]): r["running_loss"] for r in monitor.running_totals(table, "run", "step", "loss").collect()} == sums
    kept = monitor.retained(table.where("run = 1"), 3, F.desc("step")).where("NOT deleted").collect()
    assert sorted(r["step"] for r in kept) == [899, 900, 901]


def test_events(spark, tmp_path):
    losses = [5.0, 4.0, 4.5, 4.2, 3.9, 4.0, 4.1, 4.2]
    path = str(tmp_path / "log" / "events.jsonl")
    (tmp_path / "log").mkdir()
    lines = [json.dumps({"run": "r", "step": k, "event": "validation", "loss": loss, "timestamp": f"2024-01-01T00:0{k}:00Z"}) for k, loss in enumerate(losses)]
    (tmp_path / "log" / "events.jsonl").write_text("\n".join([*lines, '{"run": "r", "st']), "utf-8")
    rows = readers.read_events(spark, path, stream.EVENT)
    assert rows.count() == len(losses)
    assert monitor.early_stop(rows, "run", "step", "loss", 3).first()["stop"] == 7
    query = stream.early_stopping(stream.tail(spark, str(tmp_path / "log")), 3).writeStream.format("memory").queryName("stops").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("stops").orderBy("step").collect()
    assert [r["streak"] for r in got] == [0, 0, 1, 2, 0, 1, 2, 3] and got[-1]["stopped"] and got[-1]["best"] == 3.9


def test_subword(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from paralex.functions import subword
    from paralex.operators import encode

    path = tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([("Hello there", "Hallo du", None), ("", "x " * 50, "d")], "source string, target string, domain string")
    got = encode.encoded(rows, path, path)
    plain = subword.processor(path).encode("Hello there")
    first = got.where("source = 'Hello there'").first()
    assert first["source_ids"] == [1, *plain, 2] and first["length"] == max(len(first["source_ids"]), len(first["target_ids"]))
    assert encode.within(got, 20).count() == 1 and encode.lengths_report(got, 20).first()["skipped_overlength"] == 1
    assert encode.encoded(rows, path, path, reverse=True).first()["source"] == "Hallo du"
    assert [r["d"] for r in got.select(subword.decode(F.col("source_ids"), path).alias("d")).collect()] == ["Hello there", ""]
    assert got.select(subword.pieces(F.col("source"), path).alias("p")).first()["p"] == subword.processor(path).encode("Hello there", out_type=str)


def test_commands(spark, tmp_path, capsys):
    from paralex import cli

    sinks.write_document(spark, f"{tmp_path}/runs/e1/manifest.json", {"pair": "aa-bb", "experiment_id": "e1"})
    assert readers.experiments(spark, str(tmp_path / "runs"), "experiment_id string, pair string").first()["pair"] == "aa-bb"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.tsv").write_text("one\teins\none\teins\n\ttwo\n", "utf-8")
    cli.main(["dataset", "prepare", str(tmp_path)])
    out = json.loads(capsys.readouterr().out)
    assert (out["accepted_rows"], out["duplicate_rows"], out["empty_rows"]) == (1, 1, 1)
    assert readers.read_document(spark, f"{tmp_path}/prepared/current.json")["dataset_version"] == out["dataset_version"]


def test_compare_versions(spark):
    from paralex.operators import evaluate

    rows = [(k, f"source {k}", f"the reference number {k} is here", f"the reference number {k} is here") for k in range(5)]
    schema = "row_id long, source string, reference string, candidate string"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([(k, s, r, c.replace("here", "there") if k == 2 else c) for k, s, r, c in rows if k], schema)
    limits = {"minimum_chrf_change": 0.0, "maximum_bleu_regression": 0.5, "maximum_number_accuracy_regression": 0.1, "maximum_placeholder_accuracy_regression": 0.0}
    got = evaluate.compare_versions(a, b, limits)
    assert got["changed"] == 1 and got["samples"][0]["row_id"] == 2 and not got["gates"]["passed"] and got["interpretation"]["regressed"]
    assert abs(got["metrics"]["a"]["bleu"] - 100) < 1e-9 and got["metrics"]["deltas"]["chrf"] < 0 and got["metrics"]["a"]["sentence_count"] == 4
    v = versions_of(spark)
    assert evaluate.find_version([v.limit(3), v.exceptAll(v.limit(3))], "v2.0.0") == "aa-bb-aa-to-bb-v2.0.0"
    with pytest.raises(LookupError):
        evaluate.find_version([v], "v7.0.0")
