"""Secret scans with SQL functions only: fixed base patterns, plus character Markov models for other random strings.

Two first-order models over the characters of tokens, one trained from labelled random strings and one from ordinary
identifiers, are compared by their log-likelihood ratio; a long token that the random model explains better is a secret.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, the group that must have a least length, and that length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Tokens that the models judge, their alphabet, and the mean log ratio per step from which a token is random.
TOKEN, ALPHABET, THRESHOLD = r"[A-Za-z0-9+/_=-]{20,}", string.ascii_letters + string.digits + "+/_=-", 0.35
#: Generated random strings among the labelled samples; all other samples come from all documents.
RANDOM_STRINGS = 2000
RANDOM_KIND = "random"
MASK = "[secret]"
_SPAN = "array<struct<start:int,kind_order:int,kind:string,end:int>>"
#: Matches that one inner list of positions holds, so that lists of any length are built in near linear time.
_CHUNK = 256


def match_spans(text: Column, kind: str, order: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches in code points: what lies between the matches and the matches themselves, summed up in turn."""
    p = F.lit(pattern)
    between, whole, value = F.split(text, pattern), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    steps = F.zip_with(F.slice(between, 1, F.size(whole)), F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("w"), F.length(v).alias("v"))),
                       lambda b, m: F.struct(F.length(b).alias("gap"), m["w"].alias("w"), m["v"].alias("v")))
    empty = F.array().cast(_SPAN)

    def put(acc, x):
        start = (acc["at"] + x["gap"]).cast("int")
        end = (start + x["w"]).cast("int")
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["v"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def chunk(acc, i):
        inner = F.aggregate(F.slice(steps, i * _CHUNK + 1, _CHUNK), F.struct(acc["at"].alias("at"), empty.alias("spans")), put)
        return F.struct(inner["at"].alias("at"), F.concat(acc["lists"], F.array(inner["spans"])).alias("lists"))

    chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / F.lit(_CHUNK)).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("lists"))
    found = F.flatten(F.aggregate(chunks, start, chunk)["lists"])
    return F.when(F.regexp_like(text, p), found).otherwise(empty)


def labelled_samples(docs: DataFrame, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """(sample, random, n): training strings of all documents and how often each counts.

    SHA-2 digests in hex and base64 and the distinct strings that the base patterns catch are random and count once, so that
    copies of one secret weigh nothing; other tokens of 8 characters or more are ordinary and count as often as they occur.
    Tokens are counted per task before they are shuffled.
    """
    texts = docs.where("text is not null").select("text")
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    made = docs.sparkSession.range(random_strings).select(F.explode(F.array(F.substring(digest, 1, 40), F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""))).alias("sample"))
    caught = texts.select(F.explode(F.array_union(F.regexp_extract_all("text", F.lit(BASE[0][1]), F.lit(2)), F.regexp_extract_all("text", F.lit(BASE[2][1]), F.lit(0)))).alias("sample"))
    random = made.union(caught.where("length(sample) >= 16")).distinct().select("sample", F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))
    rest = F.regexp_replace(F.regexp_replace(F.col("text"), BASE[0][1], " "), f"{BASE[1][1]}|{BASE[2][1]}", " ")
    ordinary = texts.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{8,}"), F.lit(0))).alias("sample")).where("not sample rlike '^[0-9]+$'")
    return random.union(ordinary.groupBy("sample").agg(F.count("*").alias("n")).select("sample", F.lit(False), "n"))


def pair_counts(samples: DataFrame) -> DataFrame:
    """(random, pair, n): how often each two characters of the alphabet follow each other in the samples."""
    chars = F.filter(F.split("sample", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    pairs = samples.select("random", "n", chars.alias("c")).where("size(c) > 1")
    steps = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.concat(a, b))
    return pairs.select("random", "n", F.explode(steps).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n"))


def train_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of every step between two characters, row by row of the alphabet.

    Counts are smoothed by half a step; only alphabet squared times two counts reach the driver.
    """
    counts = {(r["random"], r["pair"]): r["n"] for r in pair_counts(samples).collect()}

    def log_share(kind, a, b):
        row = sum(counts.get((kind, a + c), 0) for c in ALPHABET)
        return math.log((counts.get((kind, a + b), 0) + 0.5) / (row + 0.5 * len(ALPHABET)))

    return [round(log_share(True, a, b) - log_share(False, a, b), 3) for a in ALPHABET for b in ALPHABET]


def random_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per step of a token."""
    table = F.split(F.lit(" ".join(map(str, ratios))), " ").cast("array<double>")
    places = F.transform(F.slice(F.split(token, ""), 1, F.length(token)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places)), lambda a, b: F.element_at(table, a * len(ALPHABET) + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.lit(1), F.size(steps))


def find_secrets(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """All columns of `docs` plus base_spans and all_spans, sorted arrays of (start, kind_order, kind, end) in code points.

    Base spans are the leftmost non-overlapping matches of each base pattern; of different kinds they may overlap. A random
    token adds a span only where no base span overlaps it. Null and empty texts have none. Repeated rows repeat.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.withColumn("base_spans", F.array_sort(F.concat(*[match_spans(text, kind, k, p, group, least) for k, (kind, p, group, least) in enumerate(BASE)])))
    tokens = F.filter(F.zip_with(
        match_spans(text, RANDOM_KIND, len(BASE), TOKEN), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        lambda s, t: F.struct(s.alias("span"), t.alias("token"))), lambda x: x["span"].isNotNull())
    free = lambda x: ~F.exists("base_spans", lambda b: (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"]))
    random = F.filter(tokens, lambda x: free(x) & (random_ratio(x["token"], ratios) >= THRESHOLD))
    added = F.when(F.regexp_like(text, F.lit(TOKEN)), F.transform(random, lambda x: x["span"])).otherwise(F.array().cast(_SPAN))
    return spans.withColumn("all_spans", F.array_sort(F.concat("base_spans", added)))


def fit_secrets(docs: DataFrame) -> list[float]:
    """Ratios learned from all texts; without any text, from the generated strings alone."""
    return train_markov(labelled_samples(docs))


def span_text(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by MASK; overlapping spans by one."""

    def put(acc, s):
        part = F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), part.alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def mask_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns with all secrets in `text` masked and n_chars, where there is one, counted anew.

    A null text stays null.
    """
    names = {"text": F.when(F.col("d.text").isNotNull(), masked(F.col("d.text"), F.col("all_spans")))}
    if "n_chars" in docs.columns:
        names["n_chars"] = F.when(F.size("all_spans") == 0, F.col("d.n_chars")).otherwise(F.length(names["text"]).cast(docs.schema["n_chars"].dataType))
    found = find_secrets(docs.select(F.struct(*docs.columns).alias("d"), "text"), fit_secrets(docs))
    return found.select(*[names.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns])
