"""Secret scan: fixed patterns, and strings that a battery of randomness tests can't tell from random ones.

Everything is DataFrame functions.  Positions are not given by any built-in regular-expression function, so they come
from the lengths of the pieces between matches.

The battery looks at each run of 20 or more characters that secrets are written in; '=' belongs to it only as padding
at its end, so NAME=VALUE is two runs.  Its encoding is inferred from the characters used; runs of letters of one case
are words, not an encoding.  A run that fits no encoding, as where a path or a name is glued to a key, is tested by its
parts: those between one base64 alphabet's own symbols, the other's, and both; random parts that overlap are one span.
Three tests ask whether its
symbols could be uniform draws from that alphabet: chi-squared (by the number of equal pairs, which is nearly Poisson),
runs of character classes (lower and upper case, digits, others), and serial correlation.  Three times the least p-value
is the run's own; below RANDOM_LEVEL the run is not random, and no secret.  How near to text it is comes from the first
two tests, one-sided, and runs of vowels: text repeats its letters, seldom changes class, and alternates vowels.

What is reported must also be unlike text.  Null strings are made of the corpus' own words, and of words usual in names,
glued as names and paths are
(camelCase, snake_case, a/path and so on) and cut at the lengths of the classes, and they go through the same battery.
A run's p-value is the share of null strings of its length class that have its encoding and are no nearer to text, for
the way of gluing that gives the largest share.
Runs are found by Benjamini-Hochberg within each class of encoding and length: at most a share FDR of those reported are
text by expectation, and short classes, where text may look random, do not profit from long ones.  They are reported as
``random``, unless a fixed pattern covers part of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.functions.text import let
from paralex.llm.common import shuffle_partitions, stash

KINDS = ["assign", "access", "hex", "random"]
#: The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: a match always runs to the end of its run
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_-]))?"
#: Parts of a run that fits no encoding.
PARTS = [r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}"]
_DIGIT, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VOWELS = "AEIOUaeiou"
#: Encodings in the order they are tried: name, pattern, alphabet.
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGIT + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGIT + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UP + "234567"),
    ("lower36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGIT + _LOW),
    ("upper36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGIT + _UP),
    ("base62", r"^(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", _UP + _LOW + _DIGIT),
    ("base64", r"^(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", _UP + _LOW + _DIGIT + "+/"),
    ("base64url", r"^(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", _UP + _LOW + _DIGIT + "-_"),
]
#: Lower ends of the length classes.
LENGTHS = [20, 32, 48, 96]
BINS_PER_DECADE, MOST_BIN = 20, 400
#: Three times the least p-value of the battery that a random run has (so one in a thousand is lost).
RANDOM_LEVEL = 1e-3
#: Words that null strings are made of, how many characters of them a text of the model gives at least (by repeating them),
#: and its words.
NULL_WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{1,15}[0-9]{0,2}(?![A-Za-z0-9+/_=-])"
NULL_CHARS = 2 * LENGTHS[-1]
NULL_WORDS = 300
#: Words usual in names: null strings are made of these too, in so many orders, as a small corpus says little of names.
NAME_WORDS = (
    "account action add address admin all and app area array auth base batch block body buffer build by cache call change channel check class "
    "client code color column config content count create current data date default delete device dir disk document domain draw edit end entry error event "
    "example export field file filter find first folder for format from function get group handler has height host id image in index info input is item job "
    "label last length level line link list load local log main map max message method min mode model more name net new next node number object of on open "
    "option order output page parent path period plan point pool port prefix print process query queue random range read record request reset result role root "
    "row run save scan schema search second select send server service session set setting size sort source start state status step stop store stream string "
    "style system table task test text time title to tree type update url user value version view wait width window with word write zone"
).split()
NAME_ORDERS = 40
#: Values of one running sum.
CHUNK = 256
#: Expected equal pairs from which the Poisson tail is taken by the normal one.
MANY_PAIRS = 200.0


def _running(values: Column) -> Column:
    """Running sums of an array, in chunks: arrays can't be grown in place, and growing one is quadratic in its length."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))

    def summed(chunks: Column, sums: Column) -> Column:
        def within(chunk: Column, j: Column) -> Column:
            return let([total(F.slice(sums, F.lit(1), j))], lambda before: F.transform(chunk, lambda _, i: before + total(F.slice(chunk, F.lit(1), i + 1))))

        return F.flatten(F.transform(chunks, within))

    return let([F.transform(starts, lambda k: F.slice(values, k, F.lit(CHUNK)))], lambda chunks: let([F.transform(chunks, total)], lambda sums: summed(chunks, sums)))


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Array of (start, kind, end, value) of the matches, in code points; keep: a flag for each."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def found(hits: Column, gaps: Column, flags: Column) -> Column:
        advance = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: g + F.length(h))
        ends = let([advance], _running)
        each = F.arrays_zip(ends.alias("end"), hits.alias("value"), flags.alias("ok"))
        kept = F.filter(each, lambda x: x["ok"])
        return F.transform(kept, lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    flags = keep if keep is not None else F.transform(hits, lambda _: F.lit(True))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(F.size(hits) == 0, none).otherwise(let([hits, gaps, flags], found))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0: the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * series


def _encoding(value: Column) -> Column:
    return reduce(lambda rest, k: F.when(value.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(rest), reversed(range(len(ENCODINGS))), F.lit(-1))


def _parts(run: Column) -> Column:
    """The run itself, or the parts of one that fits no encoding."""
    found = F.flatten(F.array(*(_spans(run["value"], p, 3) for p in PARTS)))

    def placed(s: Column) -> Column:
        end = F.when(s["end"] == F.length(run["value"]), run["end"]).otherwise(run["start"] + s["end"])
        return F.struct((run["start"] + s["start"]).alias("start"), s["kind"].alias("kind"), end.alias("end"), s["value"].alias("value"), _encoding(s["value"]).alias("encoding"))

    return F.when(run["encoding"] >= 0, F.array(run)).otherwise(F.array_distinct(F.transform(found, placed)))


def _merged(spans: Column) -> Column:
    """Spans of one kind, those that overlap as one."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.coalesce(last["end"] > x["start"], F.lit(False)), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.array_append(acc, x))

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), none, step))


def _poisson_tail(x: Column, mean: Column) -> Column:
    """P(X >= x) of a Poisson variable: the sum of the terms below x, which suffices where mean is under MANY_PAIRS."""
    start = F.struct(F.exp(-mean).alias("term"), F.lit(0.0).alias("sum"))
    below = F.aggregate(
        F.when(x >= 1, F.sequence(F.lit(1), x.cast("int"))).otherwise(F.array().cast("array<int>")),
        start,
        lambda acc, i: F.struct((acc["term"] * mean / i).alias("term"), (acc["sum"] + acc["term"]).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.greatest(F.lit(1e-16), 1 - below)


def _class(c: Column) -> Column:
    """0 to 3: lower case, upper case, digit, other."""
    return F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)


def _let(x: Column, then) -> Column:
    """then(x), with x evaluated once."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _battery(value: Column, encoding: Column) -> Column:
    """(p, near): three times the least p-value of the battery; and by how much the run leans towards text, the negated
    sum of the decimal logarithms (Fisher) of the chances that a random run has so many equal pairs, so few runs of
    classes, and so many of vowels and consonants."""
    of = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), encoding + 1)
    alphabet = F.element_at(F.array(*(F.lit(a) for _, _, a in ENCODINGS)), encoding + 1)
    k, n = of(len(a) for _, _, a in ENCODINGS), F.length(value).cast("double")

    def moments(classes: list[str]) -> tuple[Column, Column]:
        """Of neighbours of different classes, a mean and a variance a run: each pair has chance q of it, two that share
        a symbol have chance r of both."""
        shares = [[sum(c in x for c in a) / len(a) for x in classes] for _, _, a in ENCODINGS]
        shares = [[*x, max(0.0, 1 - sum(x))] for x in shares]
        q, r = of(1 - sum(p * p for p in x) for x in shares), of(sum(p * (1 - p) ** 2 for p in x) for x in shares)
        return (n - 1) * q, (n - 1) * q * (1 - q) + 2 * (n - 2) * (r - q * q)

    # each symbol once: its place in the alphabet, its class, whether it is a vowel
    read = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.struct(F.instr(alphabet, c).cast("double").alias("at"), _class(c).alias("class"), (F.instr(F.lit(VOWELS), c) > 0).alias("vowel")))
    mid = (k + 1) / 2
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("changes", "vowels", "products")), F.lit(None).cast("struct<at:double,class:int,vowel:boolean>").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        last, plus = acc["last"], lambda flag: F.coalesce(flag.cast("double"), F.lit(0.0))
        return F.struct(
            (acc["changes"] + plus(last["class"] != x["class"])).alias("changes"),
            (acc["vowels"] + plus(last["vowel"] != x["vowel"])).alias("vowels"),
            (acc["products"] + plus((last["at"] - mid) * (x["at"] - mid))).alias("products"),
            x.alias("last"),
        )

    counts = F.transform(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
    pairs = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v * (v - 1) / 2)
    mean = n * (n - 1) / 2 / k
    above = lambda z: F.greatest(F.lit(1e-20), F.when(z > 0, _upper_tail(F.abs(z))).otherwise(1 - _upper_tail(F.abs(z))))

    def scores(x: Column) -> Column:
        m, v = moments([_LOW, _UP, _DIGIT])
        m_vowel, v_vowel = moments([VOWELS])
        z = (x["pairs"] - mean) / F.sqrt(mean * (1 - 1 / k))
        chi = F.when(mean < MANY_PAIRS, _poisson_tail(x["pairs"], F.least(mean, F.lit(MANY_PAIRS)))).otherwise(_upper_tail(F.greatest(z, F.lit(0.0))))
        serial = x["seen"]["products"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
        return F.struct(chi.alias("chi"), ((x["seen"]["changes"] - m) / F.sqrt(v)).alias("runs"), ((x["seen"]["vowels"] - m_vowel) / F.sqrt(v_vowel)).alias("vowels"), serial.alias("serial"))

    def judged(x: Column) -> Column:
        p = F.least(F.lit(1.0), 3 * F.least(x["chi"], 2 * _upper_tail(F.abs(x["runs"])), 2 * _upper_tail(F.abs(x["serial"]))))
        near = -F.log10(F.greatest(x["chi"], F.lit(1e-20))) - F.log10(above(-x["runs"])) - F.log10(above(x["vowels"]))
        return F.struct(p.alias("p"), near.alias("near"))

    found = F.struct(pairs.alias("pairs"), F.aggregate(read, zero, step).alias("seen"))
    return _let(found, lambda x: _let(scores(x), judged))


def _stratum(value: Column, encoding: Column) -> Column:
    """The class of encoding and length; remainder by the number of lengths: the class of length."""
    length_class = sum(((F.length(value) >= low).cast("int") for low in LENGTHS[1:]), F.lit(0))
    return encoding * len(LENGTHS) + length_class


def _bin(value: Column, encoding: Column) -> Column:
    """How near to text a random run is, on a grid of decimal logarithms; MOST_BIN for one that is not random."""
    at = lambda b: F.when(b["p"] < RANDOM_LEVEL, F.lit(MOST_BIN)).otherwise(F.least(F.lit(MOST_BIN - 1), F.floor(b["near"] * BINS_PER_DECADE))).cast("int")
    return _let(_battery(value, encoding), at)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word that null strings are made of stands in all texts."""
    words = F.regexp_extract_all("text", F.lit(NULL_WORD), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def null_strings(docs: DataFrame, documents: int) -> DataFrame:
    """(way, value): text as names, paths and identifiers have it, words of whole texts glued in some way and cut at
    each length class.

    The model of text is the frequency of every word, counted over all documents.  It is made to write `documents` texts
    of about NULL_WORDS words each: a word comes as often as its share of all words asks for, a fraction being rounded up
    or down by the word's hash so that it holds on average, in an order by hashes.
    """
    counts = stash(word_counts(docs), "secrets-words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    chance = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(F.col("n") * (documents * NULL_WORDS / total) + chance).cast("int")
    places = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i")
    drawn = counts.select("word", times.alias("times")).where("times > 0").select("word", places).withColumn("h", F.xxhash64("word", "i"))
    written = drawn.groupBy(F.pmod("h", F.lit(documents)).alias("pick")).agg(F.array_sort(F.collect_list(F.struct("h", "word"))).alias("found"))
    words = written.select("pick", F.transform("found", lambda x: x["word"]).alias("words"))
    orders = docs.sparkSession.range(NAME_ORDERS).select(F.col("id").alias("pick"), F.transform(F.array_sort(F.transform(F.array(*map(F.lit, NAME_WORDS)), lambda w: F.struct(F.xxhash64("id", w).alias("h"), w.alias("w")))), lambda x: x["w"]).alias("words"))
    words = words.unionByName(orders).repartition(shuffle_partitions(docs.sparkSession), "pick")  # little data, much work
    low = F.transform("words", F.lower)
    glued = [
        F.concat_ws("", F.transform(low, F.initcap)),
        F.concat_ws("", "words"),
        F.concat_ws("_", low),
        F.upper(F.concat_ws("_", low)),
        F.concat_ws("-", low),
        F.concat_ws("/", low),
        F.concat_ws("/", F.transform(low, F.initcap)),
        F.concat_ws("", F.transform(low, lambda w, i: F.concat(F.when(i % 3 == 2, F.initcap(w)).otherwise(w), F.when(i % 3 == 1, "").otherwise("/")))),
        F.concat_ws("", F.transform(low, lambda w, i: F.concat(F.when(i % 3 == 2, F.initcap(w)).otherwise(w), F.when(i % 3 == 1, "").otherwise("_")))),
        F.concat_ws("", F.transform(low, lambda w, i: F.concat(w, F.when(i % 3 == 2, F.pmod(F.length(w), F.lit(10)).cast("string")).otherwise("")))),
    ]
    cuts = []
    for way, text in enumerate(glued):
        text = F.concat(text, F.lit("_"))
        text = F.repeat(text, F.ceil(NULL_CHARS / F.length(text)).cast("int"))
        for length in LENGTHS:
            cuts.append(F.struct(F.lit(way).alias("way"), F.regexp_extract_all(text, F.lit(f".{{{length}}}"), F.lit(0)).alias("values")))
    return words.select(F.inline(F.array(*cuts))).select("way", F.explode("values").alias("value"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, fdr: float = 0.01, null_documents: int = 200) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, base and spans (arrays of start, kind, end), n_assign,
    n_access, n_hex, n_random, base_text and spans_text.

    Positions count code points, the end exclusive.  A null or empty text has no spans.  Rows are independent but for
    the false-discovery control, which takes all rows: repeated rows count as often as they occur, and an empty table
    gives no rows.  Other columns are not carried.  The model of text is fitted on all documents, and on
    names made of NAME_WORDS; null_documents: the texts that it writes for comparison.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    found = docs.select(
        "doc_id",
        F.array_sort(F.concat(_spans(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= 6)), _spans(text, ACCESS, 1), _spans(text, HEX, 2))).alias("base"),
        _spans(text, RUN, 3).alias("runs"),
    )
    found = found.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"], r["kind"], r["end"], F.rtrim(r["value"], F.lit("=")).alias("value"))))
    found = found.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"], r["kind"], r["end"], r["value"], _encoding(r["value"]).alias("encoding"))))
    found = found.withColumn("runs", F.flatten(F.transform("runs", _parts)))
    found = found.withColumn("runs", F.filter("runs", lambda r: (r["encoding"] >= 0) & (F.length(r["value"]) >= LENGTHS[0]) & ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))

    def judged(r: Column) -> Column:
        return F.struct(r["start"], r["kind"], r["end"], _stratum(r["value"], r["encoding"]).alias("stratum"), _bin(r["value"], r["encoding"]).alias("bin"))

    plain = "transform(base, b -> named_struct('start', b.start, 'kind', b.kind, 'end', b.end))"
    found = stash(found.select("doc_id", F.expr(plain).alias("base"), F.transform("runs", judged).alias("runs")), "secrets")

    # p-values against text, on the grid: at most strata x bins rows
    null = null_strings(docs, null_documents).withColumn("encoding", _encoding(F.col("value")))
    near = F.when(F.col("encoding") >= 0, _bin(F.col("value"), F.greatest("encoding", F.lit(0))))
    length = F.pmod(_stratum(F.col("value"), F.lit(0)), F.lit(len(LENGTHS)))
    null = null.select("way", length.alias("length"), _stratum(F.col("value"), F.col("encoding")).alias("stratum"), near.alias("bin"))
    null = stash(null.groupBy("way", "length", "stratum", "bin").count(), "secrets-null")
    ways = null.groupBy("way", "length").agg(F.sum("count").alias("strings"))
    each = found.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.bin").agg(F.count("*").alias("runs"))
    each = each.withColumn("length", F.pmod("stratum", F.lit(len(LENGTHS)))).join(ways, "length")
    alike = null.where("bin is not null").select("way", "stratum", F.col("bin").alias("null_bin"), "count")
    each = each.join(alike, ["way", "stratum"], "left").withColumn("count", F.when(F.col("null_bin") <= F.col("bin"), F.col("count")).otherwise(0))
    each = each.groupBy("stratum", "bin", "runs", "way", "strings").agg(F.sum("count").alias("nulls"))
    each = each.groupBy("stratum", "bin", "runs").agg(F.max((1 + F.col("nulls")) / (1 + F.col("strings"))).alias("p"))
    each = each.withColumns({"rank": F.sum("runs").over(W.partitionBy("stratum").orderBy("bin")), "m": F.sum("runs").over(W.partitionBy("stratum"))})
    # Benjamini-Hochberg: of each stratum the last bin whose p-value is low enough for its rank
    passed = each.where(F.col("p") <= fdr * F.col("rank") / F.col("m"))
    limits = passed.groupBy("stratum").agg(F.max("bin").alias("bin")).collect()  # a row a stratum
    limit = F.create_map(*(F.lit(v) for row in [*limits, {"stratum": -1, "bin": 0}] for v in (row["stratum"], row["bin"])))
    random = F.filter("runs", lambda r: (r["bin"] < MOST_BIN) & (r["bin"] <= F.coalesce(F.try_element_at(limit, r["stratum"]), F.lit(-1))))
    out = found.withColumn("added", _merged(F.transform(random, lambda r: F.struct(r["start"], r["kind"], r["end"]))))
    out = out.withColumn("spans", F.array_sort(F.concat("base", "added")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", "base", "spans", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), _joined(F.col("base")).alias("base_text"), _joined(F.col("spans")).alias("spans_text"))
