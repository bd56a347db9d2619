"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bind, bounded_sample, indices, set_apart

#: Kinds and patterns; matches are leftmost and non-overlapping, then judged.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough is found at the same place whether its length is judged inside the pattern or after it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the models, besides the values of assignments.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Parts of ordinary identifiers, of which the negative samples are made together with words of the corpus.
PARTS = (
    "get set add remove update create delete find load store read write open close start stop run build make parse format print show list item "
    "user name count index value key data file path line text word page link table column row field type class object method function module "
    "package import export default config option param argument result error message event handler listener request response session client "
    "server host port address query filter sort order group limit offset cache buffer stream batch queue task job worker thread process "
    "document image video audio title header footer body section chapter version release branch commit merge test check valid number string "
    "international responsibility characteristic understanding nevertheless internationalization straightforward representation"
).split()
#: Of the corpus, the negative samples take the words of so many documents, at most so many words.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 300, 2000


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratios, random over ordinary, of each pair of neighbouring characters of ALPHABET: row-major, len(ALPHABET) squared."""

    ratios: tuple[float, ...]


def corpus_words(docs: DataFrame) -> DataFrame:
    """_i, word: at most SAMPLE_WORDS words of 2 to 16 ASCII letters from SAMPLE_DOCUMENTS documents, those with the smallest hashes, and PARTS, numbered from 0."""
    few = bounded_sample(docs.filter(F.col("text").isNotNull()).select("text"), None, SAMPLE_DOCUMENTS, "text")
    words = few.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![^\s])[A-Za-z]{2,16}(?=[\s.,]|$)"), 0))).alias("word")).distinct()
    some = words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS)
    every = some.unionByName(docs.sparkSession.createDataFrame([(p,) for p in PARTS], "word string")).distinct()
    return every.select((F.row_number().over(Window.orderBy(F.xxhash64("word"), "word")) - 1).alias("_i"), "word")  # a bounded sample: one task


def labelled_samples(spark: SparkSession, words: DataFrame | None = None, n: int = 8000, salt: str = "sample") -> DataFrame:
    """text, random: 2 n generated strings. n of them are random, in eight alphabets (hex, base64, base62, base36 and base32 in either case); n are ordinary, identifiers
    in six styles of four words (of corpus_words(); PARTS if there are none), numbers and dates among them.

    A fixed, bounded set: the same at every corpus size. Another salt gives other strings, to measure on.
    """
    words = words if words is not None else spark.createDataFrame(list(enumerate(PARTS)), "_i int, word string")
    ids = spark.range(n).withColumn("kind", F.col("id") % 8)
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    wide = F.base64(F.unhex(F.concat(digest, F.sha2(digest, 256))))
    plain = F.regexp_replace(wide, "[+/=]", "")
    length = (F.lit(20) + F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(21))).cast("int")
    alphabets = (digest, F.upper(digest), wide, plain, F.lower(plain), F.regexp_replace(F.upper(plain), "[0189]", "7"), F.regexp_replace(F.lower(plain), "[0189]", "7"), F.concat_ws("-", F.substring(plain, 1, 12), F.substring(plain, 13, 40)))
    random = ids.select(F.substring(F.get(F.array(*alphabets), F.col("kind").cast("int")), F.lit(1), length).alias("text"), F.lit(True).alias("random"))
    picks = ids.select("id", "kind", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    picks = picks.crossJoin(F.broadcast(words.agg(F.count("*").alias("_all")))).withColumn("_i", F.pmod(F.xxhash64(F.lit(salt), "k", "id"), F.col("_all")).cast("int"))
    named = picks.join(F.broadcast(words), "_i").groupBy("id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.lower("word").alias("word")))), lambda x: x["word"]).alias("w"))
    camel = F.concat(F.get("w", 0), F.array_join(F.transform(F.slice("w", 2, 3), lambda x: F.initcap(x)), ""))
    number = F.pmod(F.xxhash64(F.lit(salt), "id", "kind"), F.lit(100000)).cast("string")
    styles = (F.array_join("w", "_"), camel, F.initcap(camel), F.concat_ws("-", F.array_join("w", "-"), number), F.array_join("w", "/"), F.upper(F.array_join("w", "_")), F.array_join("w", ""),
              F.concat_ws("-", F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string"), F.lpad(number, 12, "0"), F.get("w", 0)))
    return random.unionByName(named.select(F.get(F.array(*styles), F.col("kind").cast("int")).alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> MarkovModels:
    """First-order models of both labels with add-one smoothing. Characters outside ALPHABET are skipped; at most len(ALPHABET)^2 counts are collected."""
    size = len(ALPHABET)
    places = bind(F.col("text"), lambda t: F.transform(indices(F.char_length(t)), lambda i: F.instr(F.lit(ALPHABET), F.substring(t, i + 1, F.lit(1))) - 1))
    pairs = samples.select("random", bind(places, lambda p: F.transform(indices(F.size(p) - 1), lambda i: F.struct(p[i].alias("a"), p[i + 1].alias("b")))).alias("p"))
    counted = (
        pairs.select("random", F.explode("p").alias("p"))
        .filter("p.a >= 0 and p.b >= 0")
        .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    )
    every = samples.sparkSession.range(size * size).select((F.col("id") / size).cast("int").alias("a"), (F.col("id") % size).cast("int").alias("b"))
    full = every.join(F.broadcast(counted), ["a", "b"], "left").fillna(0)
    row = Window.partitionBy("a")
    ratio = F.log((F.col("r") + 1) / (F.sum("r").over(row) + size)) - F.log((F.col("o") + 1) / (F.sum("o").over(row) + size))
    return MarkovModels(tuple(float(r[0]) for r in full.select(ratio.alias("x"), "a", "b").orderBy("a", "b").select("x").collect()))


def log_ratio(token: Column, models: MarkovModels) -> Column:
    """Sum over the neighbouring characters of a token; pairs with a character that isn't in ALPHABET count nothing."""
    table = F.array(*map(F.lit, models.ratios))
    code = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pair = lambda p, i: F.when((p[i] >= 0) & (p[i + 1] >= 0), F.get(table, p[i] * len(ALPHABET) + p[i + 1])).otherwise(0.0)
    return bind(code, lambda p: F.aggregate(indices(F.size(p) - 1), F.lit(0.0), lambda a, i: a + pair(p, i)))


def running_sums(numbers: Column) -> Column:
    """Sums of the first 0, 1, .., n numbers. Done in blocks of 256 and over blocks, as appending to a long array copies it each time."""

    def grow(start: Column, values: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda a, v: F.array_append(a, F.element_at(a, -1) + v))

    def blocks(x: Column) -> Column:
        cut = F.transform(indices(F.ceil(F.size(x) / 256)), lambda b: F.slice(x, b * 256 + 1, 256))
        return bind(
            cut,
            lambda c: bind(
                grow(F.lit(0), F.transform(c, lambda v: F.aggregate(v, F.lit(0), lambda a, y: a + y))),
                lambda starts: F.concat(F.array(F.lit(0)), F.flatten(F.transform(c, lambda v, b: F.slice(grow(starts[b], v), 2, F.size(v))))),
            ),
        )

    return bind(numbers, blocks)


def matches(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, order, stop, kind, found), in code points from 0."""
    nothing = F.array().cast("array<struct<start:int,order:int,stop:int,kind:string,found:string>>")

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
        lengths = F.transform(found, lambda m: F.char_length(m))
        return bind(
            F.struct(running_sums(gaps).alias("g"), running_sums(lengths).alias("m")),
            lambda s: F.transform(
                found,
                lambda m, i: F.struct(
                    (s["g"][i + 1] + s["m"][i]).alias("start"), F.lit(order).alias("order"), (s["g"][i + 1] + s["m"][i + 1]).alias("stop"), F.lit(kind).alias("kind"), m.alias("found")
                ),
            ),
        )

    return bind(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, nothing).otherwise(place(found)))


def scan_secrets(docs: DataFrame, models: MarkovModels | None = None, threshold: float = 10.0, into: str = "_secrets") -> DataFrame:
    """All columns of docs (text) with `into`: array of (start, order, stop, kind, found, log_ratio), by start and then kind (assign, access, hex, random).

    Spans of kind random are those whose log-likelihood ratio under the two models is above the threshold: the values of assignments (so a password that
    was made by a machine is told from a placeholder), and runs of 20 or more characters of ALPHABET that overlap no span of another kind. Only they
    have a log_ratio. The threshold was chosen on held-out samples: see the tests.

    A null or empty text has no spans; an empty table gives no rows; equal rows get equal results. Everything is computed within a row, over the whole text;
    models default to those of labelled_samples() with words of docs. An input column of the name `into` is replaced, and no other name matters.
    """
    models = models or train(labelled_samples(docs.sparkSession, corpus_words(docs)))
    fields = ("start", "order", "stop", "kind", "found")

    def scan(text: Column) -> Column:
        assign = F.filter(matches(text, ASSIGN, "assign", 0), lambda m: F.char_length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 6)
        base = F.concat(assign, matches(text, ACCESS, "access", 1), matches(text, HEX, "hex", 2))

        def value(m: Column) -> Column:
            return bind(F.regexp_extract(m["found"], ASSIGN, 2), lambda v: random_at(m["stop"] - F.char_length(v), m["stop"], v))

        def random_at(start: Column, stop: Column, found: Column) -> Column:
            return F.struct(start.alias("start"), F.lit(3).alias("order"), stop.alias("stop"), F.lit("random").alias("kind"), found.alias("found"))

        def both(b: Column) -> Column:
            free = F.filter(matches(text, CANDIDATE, "random", 3), lambda m: ~F.exists(b, lambda o: (o["start"] < m["stop"]) & (m["start"] < o["stop"])))
            asked = F.concat(F.transform(F.filter(b, lambda m: m["order"] == 0), value), free)
            scored = F.transform(asked, lambda m: F.struct(*[m[c].alias(c) for c in fields], log_ratio(m["found"], models).alias("log_ratio")))
            plain = F.transform(b, lambda m: F.struct(*[m[c].alias(c) for c in fields], F.lit(None).cast("double").alias("log_ratio")))
            return F.array_sort(F.concat(plain, F.filter(scored, lambda m: m["log_ratio"] > threshold)))

        return bind(base, both)

    rows, _, text, back = set_apart(docs, into)
    return back(rows, bind(F.coalesce(text, F.lit("")), scan))


def span_list(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["stop"].cast("string"))), ",")
