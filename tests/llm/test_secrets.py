"""The secret scan against brute force."""

import hashlib
import math
import random
import re
import string

from pyspark.sql import functions as F

from paralex.llm import secrets
from paralex.llm.secrets import ENCODINGS, _battery, secret_scan

KEY = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in KEY.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark):
    rng = random.Random(7)
    bits = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "é", "\U0001f600", "abc", "AKIA", "deadbeef0123", "x1Y2z3", "\n", "secret"]
    texts = [None, "", "token=token:abcdef", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 24, "f" * 23, "\U0001f600passwd = 'a.b/c=d'"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "token: abcdef"), (3, texts[3])]
    got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "base_text").collect()
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got) == sorted((i is None, i or 0, brute(t or "")) for i, t in rows)


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    b62 = string.ascii_letters + string.digits
    secrets = ["".join(rng.choice(b62) for _ in range(40)) for _ in range(60)]
    secrets += ["".join(rng.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(60)]
    plain = ["some-path/with_words/andMoreWords" + str(k) for k in range(60)] + ["A1" * 20, "=" * 40, "Abcdefghijklmnopqrstuvwxyz0123456789", "thequickbrownfoxjumpsover"]
    rows = [(k, f"see {s} here") for k, s in enumerate(secrets + plain)]
    got = {r["doc_id"]: r for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = [got[k]["n_random"] for k in range(len(rows))]
    assert sum(hit[: len(secrets)]) >= 0.9 * len(secrets)
    assert sum(hit[len(secrets) :]) == 0
    assert got[0]["spans_text"] == "random:4:44"


def test_secrets_glued_to_names_are_found(spark):
    rng = random.Random(4)
    b62 = string.ascii_letters + string.digits
    drawn = lambda letters: "".join(rng.choice(letters) for _ in range(38))
    rows, want = [], []
    glues = [("AWS_SECRET_ACCESS_KEY=", "+/", ""), ("http://host.example/?key=", "", "&page=2"), ("?key=", "-_", "=="), ("config/prod_", "+/", "="), ("store-path/", "_-", "")]
    glues += [("sk-live-", None, "")]
    for k in range(240):
        before, more, after = glues[k % len(glues)]
        own = drawn(b62 + more) if more is not None else drawn(string.ascii_lowercase + string.digits)
        value = own if not more else own[:12] + more[0] + own[12:25] + more[1] + own[25:] + "aB3"
        rows.append((k, f"\U0001f600 see {before}{value}{after} here"))
        start = 6 + len(before)
        want.append((start, start + len(value)))
    plain = [(1000 + k, f"see LONG_SETTING_NAME_HERE=plainwordsgohere and?text=thequickbrownfoxjumpsover{k % 10}dogs") for k in range(20)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan(spark.createDataFrame(rows + plain, "doc_id long, text string")).collect()}
    for j in range(len(glues)):
        hit = [any(x["start"] <= s and x["end"] >= e for x in got[k]) for k, (s, e) in enumerate(want) if k % len(glues) == j]
        assert sum(hit) >= 0.9 * len(hit), glues[j]
    assert all(a["end"] <= b["start"] for spans in got.values() for a, b in zip(spans, spans[1:]) if a["kind"] == b["kind"] == 3)
    assert all(len(text[x["start"] : x["end"]].split()) == 1 for k, text in rows for x in got[k])


def test_empty_table(spark):
    assert secret_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def battery(value, alphabet):
    """Three times the least p-value, by the definitions."""
    n, k = len(value), len(alphabet)
    normal = lambda z: math.erfc(z / math.sqrt(2)) / 2
    pairs, mean = sum(value.count(c) * (value.count(c) - 1) / 2 for c in set(value)), n * (n - 1) / 2 / k
    if mean < 200:
        term, below = math.exp(-mean), 0.0
        for i in range(int(pairs)):
            below += term
            term *= mean / (i + 1)
        chi = max(1e-16, 1 - below)
    else:
        chi = normal(max(0.0, (pairs - mean) / math.sqrt(mean * (1 - 1 / k))))
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    kinds = [kind(c) for c in alphabet]
    # moments of the number of changes, by all draws of two and three symbols
    q = sum(a != b for a in kinds for b in kinds) / k**2
    r = sum(a != b != c for a in kinds for b in kinds for c in kinds) / k**3
    changes = sum(kind(a) != kind(b) for a, b in zip(value, value[1:]))
    runs = (changes - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (r - q * q))
    x = [alphabet.index(c) - (k - 1) / 2 for c in value]
    serial = sum(a * b for a, b in zip(x, x[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    return min(1.0, 3 * min(chi, 2 * normal(abs(runs)), 2 * normal(abs(serial))))


def test_p_values(spark):
    rng = random.Random(9)
    rows = []
    for k, (_, _, alphabet) in enumerate(ENCODINGS):
        for n in (20, 33, 70, 300):
            rows += [("".join(rng.choice(alphabet) for _ in range(n)), k), ("".join(rng.choice(alphabet[: 3 + k]) for _ in range(n)), k), (alphabet[0] * (n - 1) + alphabet[1], k)]
    got = spark.createDataFrame(rows, "value string, encoding int").select("value", "encoding", _battery(F.col("value"), F.col("encoding"))["p"].alias("p")).collect()
    for r in got:
        want = battery(r["value"], ENCODINGS[r["encoding"]][2])
        assert abs(r["p"] - want) <= 1e-6 + 1e-6 * want


def test_names_are_not_secrets(spark):
    rng = random.Random(12)
    words = "the quick brown fox jumps over lazy dog user account name value index of table setting default path service request second minute window".split()
    prose = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(300)]
    names = ["getUserAccountByName2Id", "theQuickBrownFoxJumpsOverTheLazyDog", "DEFAULT_SERVICE_REQUEST_WINDOW_2", "com/example/Service2/RequestTable"]
    names += ["".join(w.capitalize() for w in rng.choices(words, k=rng.randrange(4, 9))) + str(k % 10) for k in range(200)]
    drawn = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(32, 60))) for _ in range(100)]
    rows = [*enumerate(prose), *((1000 + k, f"call {x} here") for k, x in enumerate(names)), *((2000 + k, f"call {x} here") for k, x in enumerate(drawn))]
    got = {r["doc_id"]: r["n_random"] for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    false, true = sum(got[1000 + k] for k in range(len(names))), sum(got[2000 + k] for k in range(len(drawn)))
    assert not any(got[1000 + k] for k in range(4)) and false <= 4 and true >= 95
    assert sum(got[k] for k in range(len(prose))) == 0


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(1)
    key = "".join(rng.choice("0123456789ABCDEF") for _ in range(64))
    text = "some words of text " * 20_000 + key + " token: abcdef" + " \U0001f600 tail"
    docs = spark.createDataFrame([(1, text), (2, "only words here " * 50)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan(docs.withColumn("runs", F.lit(1)).withColumn("base", F.lit("x")).withColumn("spans", F.lit(None))).collect()}
    assert got[1]["spans_text"] == "random:380000:380064,assign:380065:380078" and got[2]["spans_text"] == ""


def test_positions_of_many_matches(spark):
    """More matches than a chunk of the running sums, against Python's."""
    rng = random.Random(3)
    text = "".join(rng.choice(["token=abcdef12 ", "é token: x ", "word ", "𝒳", "AKIA" + "B" * 16 + " "]) for _ in range(4000))
    found = spark.createDataFrame([(1, text), (2, ""), (3, "none")], "doc_id int, text string").select("doc_id", secrets._spans(F.col("text"), secrets.ASSIGN, 0).alias("s"))
    got = {r["doc_id"]: [(s["start"], s["end"], s["value"]) for s in r["s"]] for r in found.collect()}
    assert got == {1: [(m.start(), m.end(), m[0]) for m in re.finditer(secrets.ASSIGN, text)], 2: [], 3: []}
    assert len(got[1]) > 4 * secrets.CHUNK


def test_the_null_model_counts_the_words_of_all_documents(spark):
    """Half of the words stand in documents beyond any sample of two hundred, after two thousand others: their share holds."""
    rows = [(k, "first " * 25) for k in range(1, 2000)] + [(0, "second " * 49_975)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in secrets.word_counts(docs).collect()} == {"first": 1999 * 25, "second": 49_975}
    text = "".join(r["value"] for r in secrets.null_strings(docs, 20).where("way = 1").collect()).lower()
    assert 0.45 < text.count("second") / (text.count("first") + text.count("second")) < 0.55
